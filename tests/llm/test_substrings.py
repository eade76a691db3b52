import hashlib
import random

import numpy as np

from kinweave.llm import substrings as sub


def check(docs, rows, **sizes):
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in sub.remove_repeats(docs(rows), **sizes).collect())
    assert got == sorted(sub.brute_force([(i, (t or "").encode()) for i, t in rows]))


def corpus():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcd ef") for _ in range(rng.randint(20, 400))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(base)[rng.randint(0, 30) :][: rng.randint(40, 300)] for _ in range(rng.randint(0, 6)))) for i in range(110)]
    odd = [None, "", "é" * 60 + "x", "é" * 61, "ab" * 4000, "b" + "ab" * 3000, "a\0" * 100, "\0" * 80, "\0" * 70, "x" * 49, "x" * 50, "x" * 51]
    return rows + [(200 + k, t) for k, t in enumerate(odd)]


def test_like_brute_force(docs):
    check(docs, corpus())


def test_many_shards_and_merged_arrays(docs, monkeypatch):
    monkeypatch.setattr(sub, "PART_BYTES", 1500)
    check(docs, corpus(), shard_bytes=4000, array_bytes=2500)


def test_arrays_of_several_shards_are_merged(docs, monkeypatch):
    # at the sizes of production a part of 1 MB makes two arrays or more; here all sizes are smaller in proportion
    merged = []
    plain = sub.WindowArray.merge
    monkeypatch.setattr(sub.WindowArray, "merge", lambda a, b: (merged.append(len(a.first)), plain(a, b))[1])
    assert sub.ARRAY_BYTES < sub.PART_BYTES
    text = np.random.default_rng(2).integers(97, 123, 6000).astype(np.uint8)
    n = len(text) // 100
    start, windows = np.arange(n) * 100, np.full(n, 51)
    start = np.concatenate((start, start))
    args = (text, start, np.concatenate((windows, windows)), np.arange(2 * n).astype(np.uint64), np.arange(2 * n)[::-1].copy(), np.full(2 * n, 9999), np.repeat(np.arange(4), n // 2), 1500)
    rows = sub._smallest(*args)
    assert merged and {int(x) for r in rows for x in np.frombuffer(r[4], np.int64)} == set(range(n))


def test_long_texts_in_parts(docs, monkeypatch):
    monkeypatch.setattr(sub, "CHUNK_BYTES", 130)
    check(docs, corpus(), shard_bytes=3000, array_bytes=2000)
    monkeypatch.setattr(sub, "CHUNK_BYTES", 50)
    check(docs, corpus()[60:])


def test_repeated_rows(docs):
    text = "".join(chr(97 + k * 7 % 26) for k in range(80))
    check(docs, [(5, text), (5, text), (6, text)])


def test_empty(docs):
    assert sub.remove_repeats(docs([])).count() == 0


def test_null_ids(docs):
    text = "".join(chr(97 + k * 7 % 26) for k in range(80))
    out = {r["doc_id"]: r["n_removed"] for r in sub.remove_repeats(docs([(None, text), (1, text)])).collect()}
    assert out == {None: 0, 1: 0}
    rows = [(None, text), ((1 << 60) + 1, text), ((1 << 60) + 3, "x" + text), ((1 << 60) + 2, "y")]
    out = {r["doc_id"]: r["n_removed"] for r in sub.remove_repeats(docs(rows)).collect()}
    assert out == {None: 0, (1 << 60) + 1: 0, (1 << 60) + 3: 80, (1 << 60) + 2: 0}


def test_one_id_on_many_rows(docs):
    rows = [(1, t) for _, t in corpus()] + [(0, corpus()[3][1]), (2, corpus()[4][1])]
    check(docs, rows, shard_bytes=3000)


def test_suffix_ranks_order_prefixes():
    rng = random.Random(1)
    text = np.frombuffer("".join(rng.choice("ab") for _ in range(3000)).encode(), np.uint8)
    room = len(text) - np.arange(len(text))
    rank = sub.suffix_ranks(sub.words_at(text), room)
    raw = text.tobytes()
    keys = [raw[k : k + sub.WIDTH] for k in range(len(text) - sub.WIDTH + 1)]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    for a, b in zip(order, order[1:], strict=False):
        assert rank[a] <= rank[b] and (rank[a] == rank[b]) == (keys[a] == keys[b])
