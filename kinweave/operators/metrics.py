"""Recall of candidates and F-beta of matches, by entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def candidate_recall(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """n_true, n_kept and recall (1 if there is nothing to find). edges: s1_id, other_id."""
    kept = candidates.select("s1_id", "other_id").distinct().withColumn("hit", F.lit(1))
    found = edges.join(kept, ["s1_id", "other_id"], "left").agg(F.count("*").alias("n_true"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_kept"))
    return found.withColumn("recall", F.when(F.col("n_true") > 0, F.col("n_kept") / F.greatest("n_true", F.lit(1))).otherwise(1.0))


def f_beta(n_true: Column, n_pred: Column, hits: Column, beta: float = 0.5) -> Column:
    """F-beta of one entity; an entity without matches scores 1 if none are predicted, else 0."""
    b = beta * beta
    # (1 + b) p r / (b p + r) with p = hits / n_pred and r = hits / n_true
    return F.when((n_true == 0) & (n_pred == 0), 1.0).when(hits == 0, 0.0).otherwise((1 + b) * hits / F.greatest(b * n_true + n_pred, F.lit(1e-300)))


def entity_scores(universe: DataFrame, edges: DataFrame, predicted: DataFrame, beta: float = 0.5) -> DataFrame:
    """s1_id, n_true, n_pred, hits, f: one row for each entity of the universe."""
    true = edges.select("s1_id", "other_id", F.lit(1).alias("t"), F.lit(0).alias("p"))
    pred = predicted.select("s1_id", "other_id").distinct().select("s1_id", "other_id", F.lit(0).alias("t"), F.lit(1).alias("p"))
    pairs = true.unionByName(pred).groupBy("s1_id", "other_id").agg(F.max("t").alias("t"), F.max("p").alias("p"))
    counts = pairs.groupBy("s1_id").agg(F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"), F.sum(F.col("t") * F.col("p")).alias("hits"))
    out = universe.select("s1_id").distinct().join(counts, "s1_id", "left").fillna(0, ["n_true", "n_pred", "hits"])
    return out.withColumn("f", f_beta(F.col("n_true"), F.col("n_pred"), F.col("hits"), beta))


def macro_f(universe: DataFrame, edges: DataFrame, predicted: DataFrame, beta: float = 0.5) -> DataFrame:
    """Mean F-beta over the universe; 0 if it is empty."""
    return entity_scores(universe, edges, predicted, beta).agg(F.count("*").alias("n_entities"), F.coalesce(F.avg("f"), F.lit(0.0)).alias("macro_f"))


def singleton_baseline(universe: DataFrame, edges: DataFrame) -> DataFrame:
    """Macro F of predicting nothing: the share of entities without a match."""
    return macro_f(universe, edges, edges.limit(0))


def threshold_sweep(universe: DataFrame, edges: DataFrame, scored: DataFrame, grid: list[float] | None = None, beta: float = 0.5) -> DataFrame:
    """t and macro_f for every threshold, in one job. scored: s1_id, other_id, prob; a pair counts from prob >= t.

    Pairs are counted by entity and the highest grid step that they reach. Going down the grid, an entity's F changes only
    at steps that some pair of it reaches; these changes are summed by step, and the steps from the top down.
    """
    from pyspark.sql import Window

    grid = grid or [(2 + i) / 40 for i in range(37)]
    spark = universe.sparkSession
    level = F.array_max(F.transform(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(t)).alias("t")) for k, t in enumerate(grid)]), lambda s: s["t"] <= F.col("prob")), lambda s: s["k"]))
    labelled = scored.join(edges.select("s1_id", "other_id", F.lit(1).alias("hit")), ["s1_id", "other_id"], "left").withColumn("k", F.coalesce(level, F.lit(-1)))  # no filter: it would move down and compute prob for every step
    at = labelled.groupBy("s1_id", "k").agg(F.count("*").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("h"))
    base = universe.select("s1_id").distinct().join(edges.groupBy("s1_id").agg(F.count("*").alias("n_true")), "s1_id", "left").fillna(0, ["n_true"])
    down = Window.partitionBy("s1_id").orderBy(F.desc("k"))
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    none = f_beta(F.col("n_true"), F.lit(0), F.lit(0), beta)
    reached = at.join(base, "s1_id").select("s1_id", "k", "n_true", f_beta(F.col("n_true"), F.sum("n").over(upto), F.sum("h").over(upto), beta).alias("f"))
    changes = reached.withColumn("change", F.col("f") - F.coalesce(F.lag("f").over(down), none)).groupBy("k").agg(F.sum("change").alias("change"))
    start = base.agg(F.count("*").alias("entities"), F.coalesce(F.sum(none), F.lit(0.0)).alias("floor"))
    steps = spark.createDataFrame([(k, float(t)) for k, t in enumerate(grid)], "k int, t double").join(F.broadcast(changes), "k", "left")
    summed = F.coalesce(F.sum("change").over(Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))  # a row for each step
    return steps.select("t", summed.alias("above")).crossJoin(F.broadcast(start)).filter("entities > 0").select("t", ((F.col("floor") + F.col("above")) / F.col("entities")).alias("macro_f"))


def best_threshold(sweep: DataFrame) -> tuple[float, float]:
    """The threshold of the largest macro F, the lowest of equals; (0.5, -1) if there is none."""
    rows = sweep.collect()  # one for each step of the grid
    return max(((r["t"], r["macro_f"]) for r in rows), key=lambda x: (x[1], -x[0]), default=(0.5, -1.0))
