"""Samples and subsets that come out alike however the data are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def place(*columns: str | Column, seed: int) -> Column:
    """A seeded hash to order by."""
    return F.xxhash64(F.lit(seed), *columns)


def sample_sources(s1: DataFrame, s2: DataFrame, s3: DataFrame, edges: DataFrame, n: int, seed: int | None = 42, distractors: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """n entities of S1, and of each other source their true matches and distractors * n more records; without a seed, the
    first by id."""
    order = lambda k: [*([place("entity_id", seed=seed + k)] if seed is not None else []), F.col("entity_id")]
    few = s1.orderBy(*order(0)).limit(n)
    true = edges.join(few.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi").select(F.col("other_id").alias("entity_id")).distinct()

    def side(other: DataFrame) -> DataFrame:
        more = other.join(true, "entity_id", "left_anti").orderBy(*order(1)).limit(distractors * n)
        return other.join(true, "entity_id", "left_semi").unionByName(more)

    return few, side(s2), side(s3)


def label_pairs(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates with label 1 where the pair is true, else 0."""
    true = edges.select("s1_id", "other_id").distinct().withColumn("label", F.lit(1))
    return candidates.join(true, ["s1_id", "other_id"], "left").fillna(0, ["label"])


def sample_weights(pairs: DataFrame) -> DataFrame:
    """Pairs with weight: one over the number of their entity's pairs."""
    return pairs.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("s1_id")))


def subsample_negatives(labelled: DataFrame, cap: int, seed: int | None = 42) -> DataFrame:
    """All positives, and of each entity at most max(cap * max(positives, 1), 5) negatives, by hash or, without a seed, by id."""
    if cap <= 0:
        return labelled
    by_label = Window.partitionBy("s1_id", "label").orderBy(*([place("other_id", seed=seed)] if seed is not None else []), "other_id")
    n_pos = F.sum("label").over(Window.partitionBy("s1_id"))
    marked = labelled.withColumns({"n_pos": n_pos, "at": F.row_number().over(by_label)})
    limit = F.greatest(F.lit(cap) * F.greatest("n_pos", F.lit(1)), F.lit(5))
    return marked.filter((F.col("label") == 1) | (F.col("at") <= limit)).drop("n_pos", "at")


def hard_negatives(scored: DataFrame, top_k: int = 5000) -> DataFrame:
    """The false positives (prob >= 0.5) of highest and the false negatives of lowest probability. scored: s1_id, other_id, label, prob."""
    fp = scored.filter("label = 0 and prob >= 0.5").orderBy(F.desc("prob"), "s1_id", "other_id").limit(top_k)
    fn = scored.filter("label = 1 and prob < 0.5").orderBy("prob", "s1_id", "other_id").limit(top_k)
    return fp.withColumn("kind", F.lit("false_positive")).unionByName(fn.withColumn("kind", F.lit("false_negative")))


def folds(pairs: DataFrame, n_splits: int, seed: int = 42) -> DataFrame:
    """Pairs with a fold; all pairs of an entity are in one."""
    return pairs.withColumn("fold", F.pmod(place("s1_id", seed=seed), F.lit(n_splits)).cast("int"))
