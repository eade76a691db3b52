"""Reports on sources and ground truth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUIRED = ("entity_id", "business_name", "business_address", "country")


def _together(sources: DataFrame) -> DataFrame:
    return sources.withColumn("src", F.substring("entity_id", 1, 2))


def source_sizes(sources: DataFrame) -> DataFrame:
    return _together(sources).groupBy("src").agg(F.count("*").alias("n"))


def country_distribution(sources: DataFrame) -> DataFrame:
    return _together(sources).groupBy("src", "country").agg(F.count("*").alias("n"))


def missingness(sources: DataFrame) -> DataFrame:
    """src, column, n_missing, ratio of empty values, where there are any; one pass for all columns."""
    empty = [F.sum((F.coalesce(c, F.lit("")) == "").cast("long")).alias(c) for c in REQUIRED]
    counts = _together(sources).groupBy("src").agg(F.count("*").alias("total"), *empty)
    long = counts.unpivot(["src", "total"], list(REQUIRED), "column", "n_missing").filter("n_missing > 0")
    return long.select("src", "column", "n_missing", (F.col("n_missing") / F.col("total")).alias("ratio"))


def _degrees(universe: DataFrame, edges: DataFrame) -> DataFrame:
    return universe.select("s1_id").distinct().join(edges.groupBy("s1_id").agg(F.count("*").alias("degree")), "s1_id", "left").fillna(0, ["degree"])


def degree_histogram(universe: DataFrame, edges: DataFrame) -> DataFrame:
    """degree, n, share."""
    n = universe.select("s1_id").distinct().agg(F.count("*").alias("all"))
    return _degrees(universe, edges).groupBy("degree").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).select("degree", "n", (F.col("n") / F.col("all")).alias("share"))


def singleton_rate(universe: DataFrame, edges: DataFrame) -> DataFrame:
    return _degrees(universe, edges).agg(F.avg((F.col("degree") == 0).cast("double")).alias("singleton_rate"))


def source_mix(edges: DataFrame) -> DataFrame:
    """Entities matched in S2 only, S3 only and both."""
    flags = edges.groupBy("s1_id").agg(F.max(F.col("other_id").startswith("S2-").cast("int")).alias("s2"), F.max(F.col("other_id").startswith("S3-").cast("int")).alias("s3"))
    return flags.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in (("s2_only", (F.col("s2") == 1) & (F.col("s3") == 0)), ("s3_only", (F.col("s2") == 0) & (F.col("s3") == 1)), ("s2_and_s3", (F.col("s2") == 1) & (F.col("s3") == 1)))])


def multi_owned(edges: DataFrame) -> DataFrame:
    """Other records that several entities claim."""
    return edges.groupBy("other_id").agg(F.countDistinct("s1_id").alias("owners")).filter("owners > 1")


def run_summary(universe: DataFrame, edges: DataFrame, candidates: DataFrame, predicted: DataFrame) -> DataFrame:
    """Counts of a run: what, n. Each frame is read once; pairs meet in one shuffle."""
    flags = ("true_pairs", "candidates", "predicted_pairs")
    mark = lambda df, own: df.select("s1_id", "other_id", *[F.lit(int(f == own)).cast("long").alias(f) for f in flags])
    pairs = reduce(DataFrame.unionByName, [mark(df, f) for df, f in zip((edges, candidates, predicted), flags, strict=True)])
    pairs = pairs.groupBy("s1_id", "other_id").agg(*[F.sum(f).alias(f) for f in flags])
    by_entity = pairs.groupBy("s1_id").agg(*[F.sum(f).alias(f) for f in flags], F.sum(F.when(F.col("true_pairs") > 0, F.col("candidates")).otherwise(0)).alias("positives"))
    totals = by_entity.agg(*[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in (*flags, "positives")], F.count(F.when(F.col("predicted_pairs") > 0, 1)).alias("predicted_non_singletons"))
    entities = universe.agg(F.countDistinct("s1_id").alias("entities"))
    names = ["entities", "true_pairs", "candidates", "positives", "predicted_pairs", "predicted_non_singletons"]
    return entities.crossJoin(totals).unpivot([], names, "what", "n")
