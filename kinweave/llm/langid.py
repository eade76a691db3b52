"""Language identification by nearest centroid.

Texts become TF-IDF vectors of hashed character 1- to 3-grams over letters and word gaps, normalised to length 1.
Every language has several centroids (spherical k-means over its own training texts). A text takes the language of
the centroid with the largest cosine; it is rejected where that cosine is below what the centroid's own training
texts reach (REJECT_QUANTILE of them, times REJECT_SLACK).

Document frequencies count all texts that may be learnt from; the centroids are fitted to a bounded sample of them,
about SAMPLE_PER_LANG rows of each language, chosen by a hash of id and text (equal rows count once). There may be any
number of languages: beyond PART_LANGS they make several models, each of which sees all texts, and the best answer wins.

Null texts and texts without a letter are `und` with score 0 and take no part in fitting, nor do null languages. Texts
are read whole, in pieces. Of equal cosines, the first language by code point wins. Repeated rows get the same answer; an
empty table, or one with nothing to learn from, gives `und` for every row. Only the named columns are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Carried, bounded_batches, discard, materialize, small

DIM = 1 << 14
SAMPLE_PER_LANG = 600
CENTROIDS = 4
#: Languages of one model, which a worker holds whole: about 130 MB.
PART_LANGS = 500
REJECT_QUANTILE = 0.01
REJECT_SLACK = 0.7
#: Vectors of document frequencies that are added at a time, and languages whose vectors a task holds.
ADDED, HELD_LANGS = 64, 64
PIECE = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a text and how often each occurs; none if it has no letter."""
    total = None
    text = text or ""
    for at in range(0, len(text), PIECE):
        cp = np.frombuffer(text[at : at + PIECE + 2].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters()[cp]
        if not letter.any():
            continue
        x = np.where(letter, cp, 32).astype(np.uint64)
        x = x[np.concatenate(([True], (x[1:] != 32) | (x[:-1] != 32)))]  # gaps count once
        x = np.concatenate(([32], x, [32])).astype(np.uint64)
        two = x[:-1] << np.uint64(21) | x[1:]
        three = two[:-1] << np.uint64(21) | x[2:]
        keys = np.concatenate((x[x != 32], two, three | np.uint64(1 << 63)))
        found = np.bincount(((keys * _MULT) >> np.uint64(50)).astype(np.int64), minlength=DIM)
        total = found if total is None else total + found
    if total is None:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at].astype(np.int32)


def _weights(idx: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(count)) * idf[idx]
    return (w / max(np.sqrt(w @ w), 1e-12)).astype(np.float32)


def _kmeans(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centre is the mean's nearest vector, each next one the vector farthest from all."""
    k = min(k, len(vectors))
    seed = [int(np.argmax(vectors @ vectors.mean(0)))]
    near = vectors @ vectors[seed[0]]
    while len(seed) < k:
        seed.append(int(np.argmin(near)))
        near = np.maximum(near, vectors @ vectors[seed[-1]])
    centres = vectors[seed].copy()
    for _ in range(rounds):
        own = np.argmax(vectors @ centres.T, 1)
        for j in range(k):
            if (own == j).any():
                m = vectors[own == j].sum(0)
                centres[j] = m / max(np.linalg.norm(m), 1e-12)
    return centres


class Model:
    """idf, and centroids with their language and the cosine below which a text is rejected, for some of the languages."""

    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, least: np.ndarray) -> None:
        self.idf, self.langs, self.least = idf, langs, least
        self.by_feature = np.ascontiguousarray(centroids.T) if len(langs) else np.zeros((DIM, 0), np.float32)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine and whether it is rejected."""
        idx, count = gram_counts(text)
        if not len(idx) or not self.langs:
            return "und", 0.0, True
        cos = _weights(idx, count, self.idf) @ self.by_feature[idx]
        best = int(np.argmax(cos))
        return self.langs[best], float(min(1.0, max(0.0, cos[best]))), bool(cos[best] < self.least[best])


class Models:
    """The models of all languages, one for each PART_LANGS of them; the driver loads one at a time."""

    def __init__(self, idf: np.ndarray, table: DataFrame | None, parts: int) -> None:
        self.idf, self.table, self.parts = idf, table, parts

    def part(self, k: int) -> Model:
        """The k-th model; without languages, one that knows none."""
        if self.table is None:
            return Model(self.idf, [], np.zeros((0, DIM), np.float32), np.zeros(0))
        rows = sorted(self.table.filter(F.col("part") == k).collect(), key=lambda r: (r["lang"].encode("utf-8", "surrogatepass"), r["centroid"]))
        return Model(self.idf, [r["lang"] for r in rows], np.array([r["centroid"] for r in rows], np.float32).reshape(len(rows), DIM), np.array([r["least"] for r in rows]))


def _shares(learn: DataFrame) -> tuple[np.ndarray, int]:
    """Mean over the languages of the share of their texts that have each feature, over all rows; and the languages."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        out = lambda: pd.DataFrame([(k, n, df) for k, (n, df) in held.items()], columns=["lang", "n", "df"])
        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"], strict=True):
                idx, _ = gram_counts(text if isinstance(text, str) else None)
                if not len(idx):
                    continue
                if lang not in held and len(held) == HELD_LANGS:
                    yield out()
                    held.clear()
                own = held.setdefault(lang, [0, np.zeros(DIM, np.int64)])
                own[0] += 1
                own[1][idx] += 1
        if held:
            yield out()

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [key[0]], "n": [frame["n"].sum()], "df": [np.sum(np.stack(frame["df"].to_list()), 0)]})

    def share(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(DIM), 0
        for frame in frames:
            for k, df in sorted(zip(frame["n"], frame["df"], strict=True), key=lambda x: (x[0], x[1].tobytes())):
                total += df / k
                n += 1
        yield pd.DataFrame({"n": [n], "share": [total]})

    kind = "lang string, n bigint, df array<bigint>"
    found = learn.select("lang", "text").mapInPandas(count, kind).withColumn("part", F.floor(F.spark_partition_id() / ADDED))
    by_lang = found.groupBy("lang", "part").applyInPandas(add, kind).groupBy("lang").applyInPandas(add, kind)
    rows = by_lang.mapInPandas(share, "n bigint, share array<double>").collect()  # a vector for each partition
    n = sum(r["n"] for r in rows)
    return (np.sort([r["share"] for r in rows], 0).sum(0) / n if n else np.zeros(DIM)), n


def fit(docs: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_PER_LANG, centroids: int = CENTROIDS) -> Models:
    """Learn from the rows where `usable` holds; the driver gets centroids only."""
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.col(text_col).cast("string")
    place = F.xxhash64(F.col(id_col).cast("string"), text, F.lit("langid"))
    learn = docs.select(place.alias("place"), text.alias("text"), F.col(lang_col).cast("string").alias("lang"), (F.lit(True) if usable is None else usable).alias("use")).filter("use and lang is not null")
    mean, n_langs = _shares(learn)
    if not n_langs:
        return Models(np.zeros(DIM), None, 1)
    # languages weigh alike in the idf, however many texts each has
    idf = np.log1p(1.0 / (mean + 1e-3))
    rates = materialize(learn.groupBy("lang").count().select("lang", F.least(F.lit(1.0), F.lit(float(sample)) / F.col("count")).alias("rate")), "langid-rates")
    share = F.shiftrightunsigned("place", 34) / F.lit(float(1 << 30))
    some = learn.join(small(rates, 200), "lang").filter(share < F.col("rate")).groupBy("lang", "place").agg(F.first("text").alias("text"))

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [gram_counts(t if isinstance(t, str) else None) for t in frame["text"]]
            out = frame[["place", "lang"]].assign(idx=[x[0] for x in found], cnt=[x[1] for x in found])
            yield out[out["idx"].str.len() > 0]

    first = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("place", 34), "place")
    grams = some.mapInPandas(features, "place bigint, lang string, idx array<int>, cnt array<int>").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= sample + sample // 4)

    def clusters(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        vectors = np.zeros((len(frame), DIM), np.float32)
        for row, idx, cnt in zip(vectors, frame["idx"], frame["cnt"], strict=True):
            row[idx] = _weights(np.asarray(idx), np.asarray(cnt), idf)
        centres = _kmeans(vectors, centroids)
        cos = vectors @ centres.T
        own = np.argmax(cos, 1)
        least = [float(np.quantile(cos[own == j, j], REJECT_QUANTILE)) * REJECT_SLACK if (own == j).any() else 0.0 for j in range(len(centres))]
        return pd.DataFrame({"lang": key[0], "centroid": list(centres), "least": least})

    parts = -(-n_langs // PART_LANGS)
    table = grams.select("lang", "place", "idx", "cnt").groupBy("lang").applyInPandas(clusters, "lang string, centroid array<float>, least double")
    table = materialize(table.withColumn("part", F.pmod(F.xxhash64("lang"), F.lit(parts)).cast("int")), "langid-centroids")
    discard(rates)
    return Models(idf, table, parts)


def predict(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text", reject: bool = True) -> DataFrame:
    """id, lang_pred, score and rejected. With `reject`, a rejected text's lang_pred is `und`. No shuffle."""
    spark = docs.sparkSession
    bounded_batches(spark)
    through = Carried(docs, (id_col,))
    answer = "lang_pred string, score double, rejected boolean"
    now = docs.select(*through.given(), F.col(text_col).cast("string").alias("text"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    for k in range(models.parts):
        shared = spark.sparkContext.broadcast(models.part(k))  # PART_LANGS * CENTROIDS * DIM at most
        last = k == models.parts - 1

        def run(frames: Iterator[pd.DataFrame], shared=shared, last: bool = last) -> Iterator[pd.DataFrame]:
            for frame in frames:
                found = []
                for text, *best in zip(frame["text"], frame["lang_pred"], frame["score"], frame["rejected"], strict=True):
                    own = shared.value.predict(text if isinstance(text, str) else None)
                    # the better cosine; of equal ones the first language
                    found.append(own if own[0] != "und" and (best[0] == "und" or (-own[1], own[0].encode("utf-8", "surrogatepass")) < (-best[1], best[0].encode("utf-8", "surrogatepass"))) else best)
                out = pd.DataFrame({"c0": frame["c0"], "lang_pred": ["und" if last and reject and x[2] else x[0] for x in found], "score": [x[1] for x in found], "rejected": [x[2] for x in found]})
                yield out if last else out.assign(text=frame["text"])

        now = now.mapInPandas(run, ", ".join([*through.kinds(), answer]) + ("" if last else ", text string"))
        if not last:  # one model at a time
            now = materialize(now, "langid-answers")
    return now.select(*through.restored(), "lang_pred", "score", "rejected")
