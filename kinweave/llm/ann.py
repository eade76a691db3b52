"""Approximate nearest neighbours by inner product: an adaptive dimension scan over inverted lists.

1. Equal vectors count once: a class of equal vectors keeps its smallest ids (as many as an answer can need), so that
   a vector which fills a third of the table is scanned once.
2. Vectors are divided by the largest norm and get one more dimension that makes all norms 1, so that the largest inner
   product is the smallest distance; a random rotation spreads each difference evenly over the dimensions.
3. Centroids are fitted by k-means on a bounded sample (FIT_ROWS) and every class goes to its nearest list. Long
   lists are split into blocks of at most BLOCK_ROWS, and the queries of a block into slices of about SLICE_QUERIES.
4. Queries probe lists in waves: the nearest ones, then some more, then the rest that the stopping rule leaves. Each
   wave starts from the bound of the ones before: the score of the (k + 1)-th best found so far. The rule: the number
   of members of a list that score above the bound is estimated from the list's centroid, spread and size; lists are
   probed in the order of that number until the lists left out hold no more than MISS of it.
5. Within a list, blocks of columns are added up for all pairs of query and candidate. After a random rotation, the
   share of a squared distance that d of D dimensions hold follows a Beta(d/2, (D-d)/2) distribution. A pair is
   abandoned once its partial distance exceeds what a distance within the bound has with probability 1 - ALPHA. The
   bound is tightened after each CHUNK of candidates. What is left is scored exactly on the original vectors.

Null vectors, zero vectors, and such as hold null or non-finite components take no part. Vectors whose length is not
that of the first usable one are an error. Ties go to the smaller id, over all classes, lists and blocks. Rows repeated
under one id count once for each row. Tables with no usable vector or no query give an empty result. Columns besides
those named are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, discard, few_ids, materialize

FIT_ROWS = 16_384
MAX_LISTS = 4_096
BLOCK_ROWS, SLICE_QUERIES = 4_096, 8_192
#: Share of the expected neighbours that the lists left out may hold.
MISS = 0.04
#: Lists that the first wave probes at least, and the share of all lists that the second may.
HOME_LISTS, SECOND_SHARE = 2, 0.1
#: Columns that are added before each test, and the probability that a test abandons a pair at the bound.
STEP_DIMS = 16
ALPHA = 0.01
#: Candidates after which the bound is tightened, and pairs that are looked at together.
CHUNK, TILE_PAIRS = 1_024, 1 << 20
#: What single precision may be off in a squared distance; all norms are 1.
LOOSE = 2e-5
#: Rows that ask for one and the same vector, beyond which they are salted.
HOT_ROWS = 4_096


def rotation(dim: int, seed: int = 0) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Plain k-means in float32; empty clusters keep their centre."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        by = np.argsort(own, kind="stable")
        firsts = np.flatnonzero(np.concatenate(([True], own[by][1:] != own[by][:-1])))
        n = np.bincount(own, minlength=k)
        centres[own[by][firsts]] = np.add.reduceat(x[by], firsts) / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of each row, in slices of bounded memory."""
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(x[k : k + 4096] @ centres.T - half, 1) for k in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


@functools.cache
def steps(dim: int, step: int = STEP_DIMS, alpha: float = ALPHA) -> list[tuple[int, int, float]]:
    """Blocks of columns (from, to), each with the share of a squared distance that the columns up to its end exceed
    with probability alpha only: a quantile of Beta(d/2, (D-d)/2), by its density over the angle."""
    ends = [*range(step, dim - step // 2, step), dim]
    angle = (np.arange(20_000) + 0.5) * (np.pi / 40_000)
    out = []
    for a, d in zip([0, *ends], ends, strict=False):
        if d == dim:
            out.append((a, d, 1.0))
            continue
        density = (d - 1) * np.log(np.sin(angle)) + (dim - d - 1) * np.log(np.cos(angle))
        mass = np.cumsum(np.exp(density - density.max()))
        out.append((a, d, float(np.sin(angle[np.searchsorted(mass, (1 - alpha) * mass[-1])]) ** 2)))
    return out


class Columns:
    """Rotated vectors in blocks of columns, each block row by row, with the squared norms of its rows."""

    def __init__(self, x: np.ndarray) -> None:
        self.dim = x.shape[1]
        self.blocks = [np.ascontiguousarray(x[:, a:b]) for a, b, _ in steps(self.dim)]
        self.norms = [np.einsum("ij,ij->i", b, b) for b in self.blocks]

    def part(self, rows: slice) -> Columns:
        """Some rows."""
        out = object.__new__(Columns)
        out.dim, out.blocks, out.norms = self.dim, [b[rows] for b in self.blocks], [n[rows] for n in self.norms]
        return out


def scan(candidates: Columns, queries: Columns, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (query, candidate) whose squared distance may be within the query's bound, by the adaptive dimension scan,
    and how many dimensions of candidates were read.

    After each block of columns, a pair goes on if its partial distance is not above the largest that a distance within
    the bound has at that dimension, but with probability ALPHA (see `steps`).
    """
    plan = steps(candidates.dim)
    near = candidates.norms[0] + queries.norms[0][:, None] - 2 * (queries.blocks[0] @ candidates.blocks[0].T)
    q, c = np.nonzero(near <= (bound * plan[0][2] + LOOSE)[:, None])
    partial, read = near[q, c], near.size * plan[0][1]
    for (a, b, share), cb, qb, cn, qn in list(zip(plan, candidates.blocks, queries.blocks, candidates.norms, queries.norms, strict=True))[1:]:
        read += len(q) * (b - a)
        partial = partial + cn[c] + qn[q] - 2 * np.einsum("ij,ij->i", cb[c], qb[q])
        keep = partial <= bound[q] * share + LOOSE
        q, c, partial = q[keep], c[keep], partial[keep]
    return q, c, read


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, in double precision, added up dimension by dimension: always the same for equal vectors."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def best_of(query: np.ndarray, score: np.ndarray, cls: np.ndarray, k: int) -> np.ndarray:
    """Indices of the pairs that score no less than their query's k-th best; of equal scores all."""
    by = np.lexsort((-score, query))
    q = query[by]
    first = np.searchsorted(q, q, side="left")
    cut = np.minimum(first + k - 1, np.searchsorted(q, q, side="right") - 1)
    return by[score[by] >= score[by][cut]]


def search_block(cand: np.ndarray, cand_ids: list[np.ndarray], ask: np.ndarray, bound: np.ndarray, k: int, prepared, counted: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k smallest-ranked ids of a block for each query, as far as they reach the query's bound.

    cand, ask: original vectors; bound: the least score that counts, -inf if none is known; `prepared` rotates them.
    """
    columns, turned = Columns(prepared(cand, False)), Columns(prepared(ask, True))
    norm = np.sqrt(products(ask, ask)) * prepared.top
    out = []
    width = max(1, TILE_PAIRS // min(len(cand), CHUNK))
    for a in range(0, len(ask), width):
        tile = slice(a, min(len(ask), a + width))
        least, q_cols = bound[tile].copy(), turned.part(tile)
        n = tile.stop - a
        found_q, found_c, found_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for at in range(0, len(cand), CHUNK):
            c_cols = columns.part(slice(at, at + CHUNK))
            limit = 2 - 2 * least / norm[tile]  # scores as squared distances
            open_ = np.flatnonzero(np.isinf(limit))
            size = len(c_cols.norms[0])
            if len(open_) and size > k:  # nothing is known of these yet: the chunk's own k-th best, over all columns
                near = sum(cn + qn[open_, None] - 2 * (qb[open_] @ cb.T) for cb, qb, cn, qn in zip(c_cols.blocks, q_cols.blocks, c_cols.norms, q_cols.norms, strict=True))
                limit[open_] = np.partition(near, k - 1, 1)[:, k - 1] + LOOSE
                if counted is not None:
                    counted.append(near.size * columns.dim)
            limit[np.isinf(limit)] = 5.0
            q, c, read = scan(c_cols, q_cols, limit.astype(np.float32))
            if counted is not None:
                counted.append(read)
            score = products(ask[a + q], cand[at + c])
            hit = score >= least[q]
            found_q, found_c, found_s = np.concatenate((found_q, q[hit])), np.concatenate((found_c, at + c[hit])), np.concatenate((found_s, score[hit]))
            if len(found_q):
                top = best_of(found_q, found_s, found_c, k)
                found_q, found_c, found_s = found_q[top], found_c[top], found_s[top]
                # the k-th best of the queries that have so many
                ends = np.searchsorted(found_q, np.arange(n), side="left") + k - 1
                have = np.bincount(found_q, minlength=n) >= k
                least[have] = np.maximum(least[have], found_s[ends[have]])
        # classes become ids: of equal scores the smallest ids, over all classes of the score
        times = np.array([len(cand_ids[c]) for c in found_c], np.int64)
        ids = np.concatenate([cand_ids[c] for c in found_c]) if len(found_c) else np.zeros(0, np.int64)
        q, s = np.repeat(found_q, times), np.repeat(found_s, times)
        by = np.lexsort((ids, -s, q))
        q, s, ids = q[by], s[by], ids[by]
        keep = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
        out.append((a + q[keep], ids[keep], s[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Prepared:
    """Rotated unit vectors: candidates over the largest norm, with what is missing as a last dimension; queries over
    their own norm, with 0 there."""

    def __init__(self, top: float, dim: int, seed: int) -> None:
        self.top, self.turn = top, rotation(dim + 1, seed)

    def __call__(self, v: np.ndarray, query: bool) -> np.ndarray:
        if query:
            peak = np.abs(v).max(1, keepdims=True)
            v = v / peak
            whole = np.hstack((v / np.sqrt((v**2).sum(1, keepdims=True)), np.zeros((len(v), 1))))
        else:
            v = v / self.top
            whole = np.hstack((v, np.sqrt(np.maximum(0, 1 - (v**2).sum(1, keepdims=True)))))
        return (whole @ self.turn).astype(np.float32)


def _unpacked(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


_GRID = np.linspace(-8, 8, 4001)
_TAIL = np.array([math.erfc(z / math.sqrt(2)) / 2 for z in _GRID])


def tail(z: np.ndarray) -> np.ndarray:
    """Probability that a standard normal variable exceeds z."""
    return np.interp(z, _GRID, _TAIL)


def choose(products_: np.ndarray, bound: np.ndarray, seen: np.ndarray, sizes: np.ndarray, spread: np.ndarray, miss: float, most: int) -> np.ndarray:
    """Lists to probe next, as a mask (query, list): in the order of the members expected above the bound, until the
    lists left out hold no more than `miss` of all that are expected; `most` at most."""
    expected = sizes * tail((bound[:, None] - products_) / spread)
    order = np.argsort(np.where(seen, 1.0, -expected), 1, kind="stable")
    sorted_ = np.take_along_axis(np.where(seen, 0.0, expected), order, 1)
    left = np.cumsum(sorted_[:, ::-1], 1)[:, ::-1]  # what a list and all after it hold
    take = (left > miss * expected.sum(1, keepdims=True)) & (sorted_ > 0)
    take[:, most:] = False
    out = np.zeros(seen.shape, bool)
    np.put_along_axis(out, order, take, 1)
    return out & ~seen


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, key, v (packed doubles), dim and norm of the rows that take part."""
    v = F.col("v")
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = given.filter(v.isNotNull() & F.col("id").isNotNull()).filter((F.size("v") > 0) & ~bad & F.exists(v, lambda x: x != 0))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            arrays = [np.asarray(x, np.float64) + 0.0 for x in frame["v"]]  # no negative zeros
            peak = [float(np.abs(x).max()) for x in arrays]
            yield pd.DataFrame({"id": frame["id"], "v": [x.tobytes() for x in arrays], "dim": [len(x) for x in arrays], "norm": [p * math.sqrt(float(((x / p) ** 2).sum())) for x, p in zip(arrays, peak, strict=True)]})

    return good.mapInPandas(pack, "id long, v binary, dim int, norm double").withColumn("key", F.unhex(F.md5("v")))


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", miss: float = MISS, seed: int = 0) -> DataFrame:
    """query_id, rank (from 1), id_col and score of the k nearest of every row where `is_query` holds.

    `is_query` is a condition on the column `id`. A query is no candidate of its own. With `miss` 0, every list that may
    hold a neighbour is probed.
    """
    spark = vectors.sparkSession
    most = k + 1  # one of them may be the asking row itself
    rows = _usable(vectors, id_col, vector_col)
    asks = F.coalesce(is_query, F.lit(False))
    # Of equal vectors, only the smallest ids can be in an answer; how many ask is counted before the shuffle.
    members = rows.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).filter(F.col("n") <= most)
    classes = members.groupBy("key").agg(F.first("v").alias("v"), F.max("dim").alias("dim"), F.max("norm").alias("norm"), F.sort_array(F.collect_list("id")).alias("ids"))
    asked = rows.filter(asks)
    classes = materialize(classes.join(asked.groupBy("key").agg(F.count("*").alias("asking")), "key", "left"), "ann-classes")
    facts = classes.agg(F.count("*").alias("n"), F.max("norm").alias("top"), F.max("dim").alias("dim"), F.min("dim").alias("low")).first()
    if not facts["n"]:
        discard(classes)
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    if facts["dim"] != facts["low"]:
        raise ValueError("vectors differ in length")
    n, dim = facts["n"], int(facts["dim"])
    prepared = Prepared(float(facts["top"]), dim, seed)

    place = F.pmod(F.xxhash64("v", F.lit("ann")), F.lit(1 << 30)) / F.lit(float(1 << 30))  # classes differ in v
    sample = classes.filter(place < min(1.0, FIT_ROWS / n)).select("v").toPandas().sort_values("v")
    if not len(sample):
        sample = classes.select("v").limit(1).toPandas()
    lists = int(max(1, min(MAX_LISTS, len(sample) / 8, np.sqrt(n))))
    centres = kmeans(prepared(_unpacked(sample["v"]), False), lists, seed=seed)
    shared = spark.sparkContext.broadcast(centres)  # MAX_LISTS vectors at most

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, 4096):
            x = prepared(_unpacked(frame["v"]), False)
            own = nearest(x, shared.value)
            yield pd.DataFrame({"v": frame["v"], "ids": [np.asarray(i, np.int64).tobytes() for i in frame["ids"]], "list": own.astype(np.int32), "rest": ((x - shared.value[own]) ** 2).sum(1, dtype=np.float64)})

    placed = materialize(classes.select("v", "ids").mapInPandas(assign, "v binary, ids binary, list int, rest double"), "ann-lists")
    stats = placed.groupBy("list").agg(F.count("*").alias("n"), F.sum("rest").alias("rest")).collect()  # MAX_LISTS rows at most
    sizes, spread = np.zeros(lists), np.full(lists, 1e-6)
    for r in stats:
        # what a list's members may add to their centre's product, if they lie around it in all directions alike
        sizes[r["list"]], spread[r["list"]] = r["n"], max(1e-6, math.sqrt(r["rest"] / r["n"] / (dim + 1)))
    known = spark.sparkContext.broadcast((sizes, spread))

    state = classes.filter("asking is not null").select("key", "v", F.lit(None).cast("double").alias("bound"), F.array().cast("array<int>").alias("seen"))
    best = None
    temporary = [classes, placed]
    for wave in range(3):

        def probe(frames: Iterator[pd.DataFrame], wave: int = wave) -> Iterator[pd.DataFrame]:
            size, wide = known.value
            for frame in batches(frames, 256):
                v = _unpacked(frame["v"])
                near = (prepared(v, True) @ shared.value.T).astype(np.float64)
                seen = np.zeros(near.shape, bool)
                for row, held in zip(seen, frame["seen"], strict=True):
                    row[np.asarray(held, np.int64)] = True
                if wave == 0:  # the nearest lists, until they hold enough to make a bound
                    order = np.argsort(-(near + wide), 1, kind="stable")
                    before = np.cumsum(size[order], 1) - size[order]
                    take = (before < 2 * most) | (np.arange(lists) < HOME_LISTS)
                    chosen = np.zeros(seen.shape, bool)
                    np.put_along_axis(chosen, order, take, 1)
                else:
                    norm = np.sqrt(products(v, v)) * prepared.top
                    bound = frame["bound"].to_numpy(np.float64, na_value=-np.inf) / norm
                    chosen = choose(near, bound, seen, size, wide, miss, max(HOME_LISTS, int(lists * SECOND_SHARE)) if wave == 1 else lists)
                chosen &= size > 0
                yield frame[["key", "v", "bound"]].assign(lists=[np.flatnonzero(x).astype(np.int32) for x in chosen], seen=[np.flatnonzero(x).astype(np.int32) for x in chosen | seen])

        state = materialize(state.mapInPandas(probe, "key binary, v binary, bound double, lists array<int>, seen array<int>"), "ann-probes")
        temporary.append(state)
        load = {r["list"]: r["count"] for r in state.select(F.explode("lists").alias("list")).groupBy("list").count().collect()}  # MAX_LISTS rows at most
        if not load:
            break
        splits = spark.createDataFrame([(j, max(1, -(-int(sizes[j]) // BLOCK_ROWS)), max(1, -(-c // SLICE_QUERIES))) for j, c in load.items()], "list int, blocks int, slices int")
        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        candidates = placed.join(F.broadcast(splits), "list").select("list", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int").alias("block"), upto("slices").alias("slice"), "v", "ids", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("double").alias("bound"))
        queries = state.select("key", "v", "bound", F.explode("lists").alias("list")).join(F.broadcast(splits), "list")
        queries = queries.select("list", upto("blocks").alias("block"), F.pmod(F.hash("key"), F.col("slices")).cast("int").alias("slice"), "v", F.lit(None).cast("binary").alias("ids"), "key", "bound")

        def scan_block(frame: pd.DataFrame) -> pd.DataFrame:
            """The best of a block for each query that probes it."""
            asking = frame["key"].notna()
            cand, ask = frame[~asking], frame[asking]
            if not len(cand) or not len(ask):
                return pd.DataFrame(columns=["key", "id", "score"])
            ids = [np.frombuffer(x, np.int64) for x in cand["ids"]]
            q, i, s = search_block(_unpacked(cand["v"]), ids, _unpacked(ask["v"]), ask["bound"].to_numpy(np.float64, na_value=-np.inf), most, prepared)
            return pd.DataFrame({"key": ask["key"].to_numpy()[q], "id": i, "score": s})

        found = candidates.unionByName(queries).groupBy("list", "block", "slice").applyInPandas(scan_block, "key binary, id long, score double")
        best = found if best is None else best.unionByName(found)
        best = best.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))).filter(F.col("n") <= most).select("key", "id", "score")
        best = materialize(best, "ann-best")
        temporary.append(best)
        bounds = best.groupBy("key").agg(F.when(F.count("*") >= most, F.min("score")).alias("bound"))
        state = state.select("key", "v", "seen").join(bounds, "key", "left")
    if best is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    near = best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "id", "score"))).alias("near"))
    # every asking row of a class takes the class's answer without itself; classes that very many ask for are salted
    hot = classes.filter(F.col("asking") > HOT_ROWS).select("key", F.ceil(F.col("asking") / HOT_ROWS).cast("int").alias("salts"))
    hot = few_ids(materialize(hot, "ann-hot"))
    for table in temporary:
        if table is not best:
            discard(table)
    salted = F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt")
    asking = asked.select("id", "key").join(hot, "key", "left").select(F.col("id").alias("query_id"), "key", salted)
    near = near.join(hot, "key", "left").select("key", "near", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    own = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    full = asking.join(near, ["key", "salt"]).select("query_id", F.posexplode(own).alias("pos", "x"))
    return full.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"))
