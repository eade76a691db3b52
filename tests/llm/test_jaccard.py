import random
import re
from itertools import combinations

import numpy as np
import pytest

from kinweave.llm import jaccard
from kinweave.llm.components import components


def sets_of(rows, words):
    out = []
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        out.append((i, {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()))
    return out


def brute(rows, words, num):
    sets = sets_of(rows, words)
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and 100 * len(a & b) >= num * len(a | b):
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 6, 10, 15, 25, 60, 150, 300]))] for _ in range(40)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
            k = rng.randrange(len(w))
            w[k] = rng.choice(vocabulary) if rng.random() < 0.7 else w[k].upper()
        if rng.random() < 0.3:
            w += [rng.choice(vocabulary) for _ in range(rng.randint(1, 6))]
        rows.append((i * 3 + 5, rng.choice([" ", "\n", "\t "]).join(w)))
    return rows + [(1, None), (2, ""), (3, " \n"), (4, "a"), (0, "A"), (9999, "é É"), (9998, "é É"), (9997, "é é")]


@pytest.mark.parametrize(("words", "num"), [(3, 90), (5, 80), (2, 50)])
def test_like_brute_force(docs, words, num):
    rows = corpus(words)
    got = sorted(map(tuple, jaccard.join(docs(rows), words, num, 100).collect()))
    assert got == brute(rows, words, num)


@pytest.mark.parametrize(("name", "value"), [("MAX_IN_BATCH", 3), ("MAX_SHARERS", 4), ("BUCKET_BYTES", 500)])
def test_limits_change_nothing(docs, monkeypatch, name, value):
    monkeypatch.setattr(jaccard, name, value)
    rows = corpus(17, 150)
    assert sorted(map(tuple, jaccard.join(docs(rows), 3, 80, 100).collect())) == brute(rows, 3, 80)


def test_sketches_rule_out_no_similar_pair():
    rng = np.random.default_rng(9)
    scheme = jaccard.Scheme(80, 100)
    for _ in range(100):
        n = int(rng.integers(5, 600))
        core = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        sets = [core[rng.random(len(core)) > p] for p in (0, 0.05, 0.1, 0.3, 0.6)] + [np.unique(rng.integers(0, 2**63, n).astype(np.uint64))]
        sets = [s for s in sets if len(s)]
        label = jaccard.unruled_classes([jaccard.sketch(s) for s in sets], np.array([len(s) for s in sets]), scheme)
        for i, j in combinations(range(len(sets)), 2):
            if scheme.linked(np.array(len(np.intersect1d(sets[i], sets[j]))), np.array(len(sets[i])), np.array(len(sets[j]))):
                assert label[i] == label[j]
        assert n < 50 or label[0] != label[-1]


def test_large_groups_are_dealt_into_blocks(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 20)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(120)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    assert sorted(map(tuple, jaccard.join(docs(rows), 3, 90, 100).collect())) == brute(rows, 3, 90)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(4)
    for num in (50, 80, 90):
        scheme = jaccard.Scheme(num, 100)
        for _ in range(200):
            n = int(rng.integers(1, 400))
            core = rng.integers(0, 2**63, n).astype(np.uint64)
            cut = int(rng.integers(0, max(1, n * (100 - num) // 100 + 1)))
            a, b = np.unique(core[cut:]), np.unique(core)
            inter = len(np.intersect1d(a, b))
            if len(a) and bool(scheme.linked(np.array(inter), np.array(len(a)), np.array(len(b)))):
                owner, sig = jaccard.signatures([a, b], scheme)
                assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist())


def test_repeated_rows_and_null_ids(docs):
    got = sorted(jaccard.join(docs([(7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (3, "a b c d e")]), 3, 90, 100).collect(), key=str)
    assert [(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None] == [(3, 3), (7, 3), (7, 3)]
    assert jaccard.join(docs([])).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)] + [(300, 300)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    loops = {a for a, b in edges if a == b}
    want = {x: find(x) for x in parent if x not in loops or any(x in e and e[0] != e[1] for e in edges)}
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_id_with_two_texts(docs):
    a, b = " ".join(f"w{k}" for k in range(50)), " ".join(f"v{k}" for k in range(50))
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.join(docs([(2, a), (2, b), (1, a), (3, b)]), 3, 90, 100).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)} or got == {(1, 1), (2, 1), (3, 2), (2, 2)}


def test_hot_classes(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_ROWS", 5)
    rows = corpus(23, 200) + [(20000 + i, "one text that very many rows share between them") for i in range(60)] + [(30000 + i, None) for i in range(30)]
    assert sorted(map(tuple, jaccard.join(docs(rows), 3, 90, 100).collect())) == brute(rows, 3, 90)


def test_long_texts_in_pieces(docs, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(900)}" * rng.choice([1, 1, 40]) for _ in range(700))) for i in range(6)]
    rows += [(10 + i, t.replace(" ", "\n\n") + " end") for i, t in rows] + [(30, "x" * 5000), (31, "X" * 5000 + " ")]
    whole = [jaccard.shingles(t, 3) for _, t in rows]
    monkeypatch.setattr(jaccard, "PIECE_BYTES", 64)
    assert all((a == jaccard.shingles(t, 3)).all() for a, (_, t) in zip(whole, rows, strict=True))
    monkeypatch.setattr(jaccard, "COMPARED_BYTES", 100)
    assert sorted(map(tuple, jaccard.join(docs(rows), 3, 90, 100).collect())) == brute(rows, 3, 90)


def test_nothing_is_left_behind(docs, spark):
    import os

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/kinweave"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    jaccard.join(docs(corpus(5, 80)), 3, 90, 100).collect()
    left = {x.rpartition("-")[0] for x in set(os.listdir(folder)) - before}
    assert left == {"shingle-sets", "classes"}
