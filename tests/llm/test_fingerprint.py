import hashlib
import random

import numpy as np

from pyspark.sql import functions as F

from kinweave.llm import fingerprint as fp
from kinweave.llm.common import partition_keys


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_gear_hash_rolls():
    data = np.frombuffer(words(1, 200).encode(), np.uint8)
    slow, h = [], 0
    for b in data.tolist():
        h = (h * 2 + int(fp.GEAR[b])) & 0xFFFFFFFF
        slow.append(h)
    assert fp.gear_hashes(data).tolist() == slow


def test_chunks_cover_the_text():
    for text in ("", "a", "a" * 5000, words(2, 3000)):
        ends = fp.boundaries(text.encode())
        assert (ends[-1] if ends else 0) == len(text) and ends == sorted(set(ends))
        sizes = np.diff([0, *ends])
        assert (sizes <= fp.MAX_CHUNK).all()


def test_shift_resistance():
    text = words(3, 2000)
    a, b = fp.fingerprint(text), fp.fingerprint("some new words here " + text)
    assert fp.containment(a, b) > 0.97 and fp.containment(a, fp.fingerprint(words(4, 2000))) < 0.02
    assert fp.containment(a, a) == 1 and fp.containment({}, {}) == 1 and fp.containment(a, {}) == 0
    assert fp.parsed(fp.written(a)) == a


def check(docs, rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = sorted(fp.edit_report(docs(rows)).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["fingerprint"]))
    assert len(got) == len(rows)
    want = []
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b = fp.fingerprint(text), fp.fingerprint(edited)
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.written(a), fp.written(b), fp.containment(a, b), fp.containment(a, fp.fingerprint(following))))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_report(docs, monkeypatch):
    monkeypatch.setattr(fp, "PART_BYTES", 3000)
    rows = [(i * 3, words(i, 5 + i % 60)) for i in range(80)] + [(500, None), (501, ""), (502, "é" * 7), (503, words(9, 4000)), (504, words(9, 4000))]
    check(docs, rows)
    check(docs, [(1, "only one text in here")])
    check(docs, [(2, "same"), (2, "same"), (None, "no id")])
    check(docs, [(7, words(i, 40)) for i in range(40)] + [(None, words(i, 9)) for i in range(9)] + [(8, "x")])
    check(docs, [(i - (1 << 40), words(i, 8000 if i == 30 else 3)) for i in range(60)])
    assert fp.edit_report(docs([])).count() == 0


def test_equal_texts(docs):
    out = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprints(docs([(1, "x y z" * 50), (2, "x y z" * 50), (3, None), (4, "")])).collect()}
    assert out[1] == out[2] and out[3] == out[4] == ""


def test_pieces_change_nothing(monkeypatch):
    text = words(5, 3000)
    whole = fp.fingerprint(text)
    monkeypatch.setattr(fp, "PIECE", 100)
    assert fp.fingerprint(text) == whole


def test_partition_keys(spark):
    for n in (1, 2, 7, 200):
        keys = partition_keys(n)
        got = spark.createDataFrame([(int(k), i) for i, k in enumerate(keys)], "k int, i int").repartition(n, "k").select("i", F.spark_partition_id().alias("p"))
        assert all(r["i"] == r["p"] for r in got.collect())
