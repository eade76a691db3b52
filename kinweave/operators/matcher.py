"""Train and apply the pair matcher: grouped out-of-fold boosting, isotonic calibration, thresholds, consensus."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.base import Estimator, Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import FEATURES
from .sampling import folds, place, sample_weights


def boosting(max_iter: int = 60, step_size: float = 0.05, max_depth: int = 5, seed: int = 42) -> Estimator:
    """The default matcher. Early stopping looks at rows with `validate`, a slice of the training folds."""
    return GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", validationIndicatorCol="validate", maxIter=max_iter, stepSize=step_size, maxDepth=max_depth, minInstancesPerNode=20, subsamplingRate=0.8, featureSubsetStrategy="0.9", seed=seed)


def logistic(seed: int = 42) -> Estimator:
    """A quick matcher for tests."""
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=30)


def assembled(features: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features)


def _probability(model: Model, frame: DataFrame) -> DataFrame:
    return model.transform(frame).withColumn("raw", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")


def train_oof(labelled: DataFrame, n_splits: int = 5, estimator: Callable[[], Estimator] = boosting, seed: int = 42) -> tuple[DataFrame, list[Model]]:
    """Out-of-fold scores and the folds' models. labelled: s1_id, other_id, label and the features.

    Entities are whole in one fold. A tenth of a training set's entities serves early stopping, so that the fold that
    is scored is never looked at. The scores are persisted, and the caller's to unpersist.
    """
    ready = folds(assembled(sample_weights(labelled)), n_splits, seed).withColumn("label", F.col("label").cast("double")).withColumn("validate", F.pmod(place("s1_id", seed=seed + 7), F.lit(10)) == 0)
    ready = ready.select("s1_id", "other_id", "label", "weight", "fold", "validate", "features").persist()
    models, scored = [], []
    for k in range(n_splits):
        model = estimator().fit(ready.filter(F.col("fold") != k))
        models.append(model)
        scored.append(_probability(model, ready.filter(F.col("fold") == k)).select("s1_id", "other_id", "label", "fold", "raw"))
    oof = reduce(DataFrame.unionByName, scored).persist()
    oof.count()
    ready.unpersist()
    return oof, models


def calibrate(oof: DataFrame) -> IsotonicRegressionModel:
    """Isotonic fit of labels on out-of-fold scores; it clips outside their range."""
    return IsotonicRegression(featuresCol="raw", labelCol="label").fit(oof.select("raw", "label"))


def apply_calibration(scored: DataFrame, iso: IsotonicRegressionModel) -> DataFrame:
    return iso.transform(scored).withColumnRenamed("prediction", "prob").withColumn("prob", F.least(F.greatest("prob", F.lit(0.0)), F.lit(1.0)))


def predict(features: DataFrame, models: list[Model], iso: IsotonicRegressionModel) -> DataFrame:
    """s1_id, other_id, prob: the calibrated mean of the folds' models."""
    frame = assembled(features).select("s1_id", "other_id", "features")
    for k, model in enumerate(models):
        frame = _probability(model, frame).withColumnRenamed("raw", f"raw{k}")
    mean = sum((F.col(f"raw{k}") for k in range(len(models))), F.lit(0.0)) / len(models)
    return apply_calibration(frame.select("s1_id", "other_id", mean.alias("raw")), iso).select("s1_id", "other_id", "prob")


def at_threshold(scored: DataFrame, threshold: float) -> DataFrame:
    """Pairs that count as matches."""
    return scored.filter(F.col("prob") >= threshold).select("s1_id", "other_id")


def consensus(prob: Column, second: Column, mode: str = "and", threshold: float = 0.65, second_threshold: float = 0.92) -> Column:
    """Whether matcher and second scorer together accept a pair; `weighted` ignores the thresholds."""
    if mode == "and":
        return (prob >= threshold) & (second >= second_threshold)
    if mode == "or":
        return (prob >= threshold) | (second >= second_threshold)
    if mode == "weighted":
        return 0.6 * second + 0.4 * prob >= 0.5
    raise ValueError(f"unknown consensus mode {mode!r}")


def texts_of(pairs: DataFrame) -> tuple[Column, Column]:
    """The two sides' texts for a second scorer, `name [SEP] address`. pairs: name1, addr1, name2, addr2."""
    side = lambda k: F.concat(F.coalesce(f"name{k}", F.lit("")), F.lit(" [SEP] "), F.coalesce(f"addr{k}", F.lit("")))
    return side(1), side(2)


def tuning_frame(pairs: DataFrame, labelled: DataFrame, top_k: int = 5000) -> DataFrame:
    """text1, text2, label and kind of what a second scorer may be fine-tuned on: the pairs on which the matcher errs most.

    labelled: s1_id, other_id, label, prob.
    """
    from .sampling import hard_negatives

    hard = hard_negatives(labelled, top_k)
    a, b = texts_of(pairs)
    return pairs.select("s1_id", "other_id", a.alias("text1"), b.alias("text2")).join(hard.select("s1_id", "other_id", "label", "kind"), ["s1_id", "other_id"])


def rerank(pairs: DataFrame, scored: DataFrame, scorer: Callable[[Column, Column], Column], mode: str, threshold: float, second_threshold: float) -> DataFrame:
    """Pairs that the consensus accepts. scorer takes the two sides' texts, `name [SEP] address`, and gives a score
    from 0 to 1: a pandas UDF around any model that the user brings."""
    both = pairs.withColumn("second", scorer(*texts_of(pairs))).select("s1_id", "other_id", "second").join(scored, ["s1_id", "other_id"])
    return both.filter(consensus(F.col("prob"), F.col("second"), mode, threshold, second_threshold)).select("s1_id", "other_id")
