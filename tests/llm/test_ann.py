import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, v string, id int"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "v", 2) for i, v in vectors], SCHEMA)


def brute(vectors, every, k):
    good = [(i, np.array(np.float32(v), float)) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            out[i] = sorted(((-float(q @ x), j) for j, x in good if j != i))[:k]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, v / np.linalg.norm(v)) for i, v in enumerate(rng.standard_normal((3000, 32)))]
    got, want = answers(ann.search(table(spark, vectors), F.col("id") % 20 == 0)), brute(vectors, 20, 20)
    hits = [len({j for _, j in got[i]} & {j for _, j in want[i]}) / 20 for i in want]
    assert set(got) == set(want) and np.mean(hits) >= 0.95


def test_norms_count(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, v * (1 + i % 5)) for i, v in enumerate(rng.standard_normal((600, 16)))]
    got, want = answers(ann.search(table(spark, vectors), F.col("id") % 20 == 0, miss=0.0)), brute(vectors, 20, 20)
    for i in want:
        assert [j for _, j in got[i]] == [j for _, j in want[i]]
        assert np.allclose([s for s, _ in got[i]], [s for s, _ in want[i]])


def test_equal_vectors_and_odd_ones(spark):
    rng = np.random.default_rng(2)
    hot = rng.standard_normal(8)
    vectors = [(i, hot if i % 3 == 0 else rng.standard_normal(8)) for i in range(300)]
    vectors += [(1000, None), (1020, [0.0] * 8), (1040, [1.0] * 7 + [None]), (1060, [float("nan")] * 8), (1080, [float("inf")] + [1.0] * 7)]
    got, want = answers(ann.search(table(spark, vectors), F.col("id") % 20 == 0, miss=0.0)), brute(vectors, 20, 20)
    assert set(got) == set(want)
    for i in want:
        assert [j for _, j in got[i]] == [j for _, j in want[i]]


def test_few_rows(spark):
    assert ann.search(table(spark, []), F.col("id") % 20 == 0).count() == 0
    assert ann.search(table(spark, [(0, [1.0, 2.0])]), F.col("id") % 20 == 0).count() == 0
    assert ann.search(table(spark, [(1, [1.0, 2.0])]), F.col("id") % 20 == 0).count() == 0
    assert answers(ann.search(table(spark, [(0, [1.0, 2.0]), (1, [3.0, 1.0])]), F.col("id") % 20 == 0)) == {0: [(-5.0, 1)]}
    with pytest.raises(ValueError):
        ann.search(table(spark, [(0, [1.0, 2.0]), (1, [3.0])]), F.col("id") % 20 == 0)




def test_scan_abandons_only_the_far():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turned = x @ ann.rotation(64)
    d = ((x[1:] - x[0]) ** 2).sum(1)
    bound = np.sort(d)[20:21]
    q, c, read = ann.scan(ann.Columns(turned[1:]), ann.Columns(turned[:1]), bound.astype(np.float32))
    assert not q.any() and len(c) < 60 and len(set(np.argsort(d)[:20]) & set(c.tolist())) >= 19
    assert read < 0.7 * 1999 * 64  # 1 % of uniform directions are near: a wide bound


def test_steps_are_quantiles():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((40000, 65)) ** 2
    share = np.cumsum(x, 1) / x.sum(1, keepdims=True)
    plan = ann.steps(65)
    assert [b for _, b, _ in plan] == [16, 32, 48, 65] and plan[-1][2] == 1.0
    for _, b, most in plan[:-1]:
        assert abs((share[:, b - 1] > most).mean() - ann.ALPHA) < 0.004


def counted_search(vectors, every, k, lists):
    """Neighbours by all lists and waves in one process, and the share of candidate dimensions read."""
    dim = vectors.shape[1]
    prepared = ann.Prepared(float(np.linalg.norm(vectors, axis=1).max()), dim, 0)
    x = prepared(vectors, False)
    centres = ann.kmeans(x, lists)
    own = ann.nearest(x, centres)
    sizes = np.bincount(own, minlength=lists).astype(float)
    spread = np.sqrt(np.bincount(own, ((x - centres[own]) ** 2).sum(1), lists) / np.maximum(1, sizes) / (dim + 1)) + 1e-6
    ask = np.arange(0, len(vectors), every)
    q, counted, probed, best = vectors[ask], [], 0, {i: [] for i in range(len(ask))}
    near, seen, bound = prepared(q, True) @ centres.T, np.zeros((len(ask), lists), bool), np.full(len(ask), -np.inf)
    norm = np.linalg.norm(q, axis=1) * prepared.top
    for wave in range(3):
        if wave == 0:
            take = np.argsort(np.argsort(-(near + spread), 1), 1) < 3
        else:
            take = ann.choose(near, bound / norm, seen, sizes, spread, ann.MISS, max(2, lists // 10) if wave == 1 else lists)
        seen |= take
        probed += (take * sizes).sum()
        for j in range(lists):
            rows, who = np.flatnonzero(own == j), np.flatnonzero(take[:, j])
            if len(rows) and len(who):
                a, b, s = ann.search_block(vectors[rows], [np.array([r]) for r in rows], q[who], bound[who], k + 1, prepared, counted)
                for i, c, v in zip(who[a].tolist(), b.tolist(), s.tolist(), strict=True):
                    best[i].append((-v, c))
        for i, found in best.items():
            best[i] = sorted(found)[: k + 1]
            if len(best[i]) > k:
                bound[i] = -best[i][-1][0]
    exact = np.argsort(-(q @ vectors.T), 1)[:, : k + 1]
    recall = np.mean([len({c for _, c in best[i]} & set(exact[i].tolist())) / (k + 1) for i in best])
    whole = len(ask) * len(vectors)
    return recall, sum(counted) / (whole * (dim + 1)), probed / whole


def test_dimensions_read():
    rng = np.random.default_rng(5)
    uniform = rng.standard_normal((12000, 64))
    uniform /= np.linalg.norm(uniform, axis=1, keepdims=True)
    middles = rng.standard_normal((60, 64))
    clustered = middles[rng.integers(0, 60, 12000)] + 0.4 * rng.standard_normal((12000, 64))
    recall, read, probed = counted_search(uniform, 60, 20, 100)
    assert recall >= 0.9 and read < 0.6, (recall, read, probed)
    recall, read, probed = counted_search(clustered, 60, 20, 100)
    assert recall >= 0.9 and read < 0.2, (recall, read, probed)


def test_ties_over_classes(spark):
    vectors = [(0, [1.0, 0.0])] + [(i, [1.0, 0.0]) for i in [1, *range(100, 130)]] + [(i, [1.0, 3.0]) for i in range(2, 12)]
    got, want = answers(ann.search(table(spark, vectors), F.col("id") == 0)), brute(vectors, 1000, 20)
    assert got[0] == want[0] and [j for _, j in got[0]][:11] == list(range(1, 12))


def test_ties_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 7)
    monkeypatch.setattr(ann, "SLICE_QUERIES", 3)
    monkeypatch.setattr(ann, "HOT_ROWS", 4)
    rng = np.random.default_rng(6)
    grid = [[float(a), float(b), 1.0] for a in (-1, 0, 1) for b in (-1, 0, 1)]
    vectors = [(i, grid[rng.integers(0, 9)] + [float(rng.integers(0, 4))]) for i in range(400)]
    got, want = answers(ann.search(table(spark, vectors), F.col("id") % 5 == 0, miss=0.0)), brute(vectors, 5, 20)
    assert got == want


def test_repeated_ids(spark):
    vectors = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (2, [0.1, 1.0])]
    found = ann.search(table(spark, vectors), F.col("id") == 0, k=1).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"] > 0.9) for r in found) == [(1, 1, True), (1, 2, True)]


def test_recall_on_the_given_table(spark):
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()
    got, want = answers(ann.search(spark.read.parquet(f"{d}/embeddings.parquet"), F.col("id") % 20 == 0)), brute([tuple(r) for r in rows], 20, 20)
    assert set(got) == set(want)
    assert np.mean([len({j for _, j in got[i]} & {j for _, j in want[i]}) / 20 for i in want]) >= 0.9
