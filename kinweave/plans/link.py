"""A whole linkage run: block, score, calibrate, match, write."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.base import Estimator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LinkConfig
from ..functions.similarity import FEATURES, feature_frame
from ..operators import blocking, matcher, metrics, sampling, topk


#: Any model that the user brings, around columns: text -> vector, and two texts -> a score from 0 to 1.
Encoder = Callable[[Column], Column]
Scorer = Callable[[Column, Column], Column]


@dataclass
class Trained:
    """Models of a run, their calibrator and threshold, the out-of-fold score at it, and a second scorer if it was tuned."""

    models: list
    iso: object
    threshold: float
    score: float
    recall: float
    scorer: Scorer | None = None


def together(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def encoded(normed: DataFrame, encoder: Encoder) -> DataFrame:
    """id and vector of every record, by the user's encoder of name and address."""
    text = F.concat(F.coalesce("norm_name", F.lit("")), F.lit(" "), F.coalesce("norm_addr", F.lit("")))
    return normed.select(F.col("entity_id").alias("id"), encoder(text).alias("vector"))


def vectors_of(s1: DataFrame, others: list[DataFrame], config: LinkConfig, encoder: Encoder | None) -> tuple[DataFrame, DataFrame] | None:
    """Vectors of S1 and of all other sources together, if the settings ask for the dense channel."""
    if not config.use_dense:
        return None
    if encoder is None:
        raise ValueError("use_dense needs an encoder")
    return encoded(s1, encoder), together([encoded(o, encoder) for o in others])


def ranked_by_tokens(s1: DataFrame, others: list[DataFrame], min_len: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Each entity's best pairs by shared tokens with all other sources, and the records of S1 that have fewer than `most`.

    Pairs of other channels share 0 and rank after these, so that only those records have room for them.
    """
    from ..sources import cache

    spark, at = s1.sparkSession, cache.scratch(s1.sparkSession, "ranked")
    for other in others:
        blocking.best_by_rare_tokens(s1, other, min_len, most).write.mode("append").parquet(f"{at}/best")
    best = spark.read.parquet(f"{at}/best")
    full = best.groupBy("s1_id").agg(F.count("*").alias("n")).filter(F.col("n") >= most).select(F.col("s1_id").alias("entity_id"))
    s1.join(full, "entity_id", "left_anti").write.parquet(f"{at}/asking")
    return best, spark.read.parquet(f"{at}/asking")


def candidates(s1: DataFrame, others: list[DataFrame], config: LinkConfig, vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Candidate pairs of S1 with every other source by the channels that the settings name, capped.

    vectors: (id, vector) of S1 and of the other sources, for the dense channel; it is under the cap like the others.
    """
    found, most, asking = [], config.max_cands_per_entity, s1
    by_best = config.use_tfidf and not config.use_rare and most > 0
    if by_best:
        best, asking = ranked_by_tokens(s1, others, config.min_len, most)
        found.append(best)
    for other in others:
        if config.use_tfidf:
            for grams in (topk.char_grams, topk.word_grams):
                found.append(topk.tfidf_topk(grams(asking), grams(other), config.tfidf_top_k).select("s1_id", "other_id", F.lit(0).cast("long").alias("shared")))
            if not by_best:
                found.append(blocking.by_rare_tokens(s1, other, config.min_len))
        else:
            found.append(blocking.by_tokens(s1, other, config.min_len, config.max_df))
            found.append(blocking.by_prefix(s1, other, config.prefix_len, config.max_pairs_per_prefix_key))
        if config.use_rare:
            found.append(blocking.by_rare_band(s1, other, config.rare_min_len, config.max_df, config.rare_max_df))
    if config.use_dense and vectors is not None:
        near = topk.dense_topk_cells(vectors[0], vectors[1], config.dense_top_k, config.dense_min_score)
        found.append(near.select(F.col("query_id").alias("s1_id"), F.col("ref_id").alias("other_id"), F.lit(0).cast("long").alias("shared")))
    return blocking.cap_ranked(blocking.union(*found), most)


def features(cands: DataFrame, s1: DataFrame, others: list[DataFrame]) -> DataFrame:
    """Feature frame of candidates; others is the list of other sources."""
    return feature_frame(blocking.pair_frame(cands, s1, together(others)))


def train(
    s1: DataFrame, others: list[DataFrame], edges: DataFrame, universe: DataFrame, config: LinkConfig, estimator: Callable[[], Estimator] | None = None,
    encoder: Encoder | None = None, tune: Callable[[DataFrame], Scorer] | None = None,
) -> Trained:
    """Fit the fold models, the calibrator and the threshold. Warns if candidates have less recall than config.min_recall.

    tune gets text1, text2, label and kind of the pairs on which the matcher errs most, and gives a second scorer.
    """
    cands = candidates(s1, others, config, vectors_of(s1, others, config, encoder)).persist()
    recall = metrics.candidate_recall(edges, cands).first()["recall"]
    if recall < config.min_recall:
        warnings.warn(f"candidate recall {recall:.4f} is below {config.min_recall:.4f}", stacklevel=2)
    labelled = sampling.label_pairs(features(cands, s1, others), edges)
    labelled = sampling.subsample_negatives(labelled, config.neg_per_pos_cap, config.seed)
    make = estimator or (lambda: matcher.boosting(config.max_iter, config.step_size, config.max_depth, config.seed))
    oof, models = matcher.train_oof(labelled, config.n_splits, make, config.seed)
    iso = matcher.calibrate(oof)
    scored = matcher.apply_calibration(oof, iso).select("s1_id", "other_id", "label", "prob")
    t, score = metrics.best_threshold(metrics.threshold_sweep(universe, edges, scored.drop("label")))
    scorer = tune(matcher.tuning_frame(blocking.pair_frame(cands, s1, together(others)), scored)) if tune else None
    oof.unpersist()
    cands.unpersist()
    return Trained(models, iso, t, score, recall, scorer)


def infer(s1: DataFrame, others: list[DataFrame], trained: Trained, config: LinkConfig, scorer: Scorer | None = None, encoder: Encoder | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidates and matches. With a scorer, pairs count if matcher and scorer agree as the settings say."""
    cands = candidates(s1, others, config, vectors_of(s1, others, config, encoder))
    scored = matcher.predict(features(cands, s1, others), trained.models, trained.iso)
    scorer = scorer or trained.scorer
    if scorer is None:
        return cands, matcher.at_threshold(scored, trained.threshold)
    pairs = blocking.pair_frame(cands, s1, together(others))
    return cands, matcher.rerank(pairs, scored, scorer, config.consensus_mode, trained.threshold, config.cross_encoder_threshold)


def run(
    spark: SparkSession, data_dir: str, out_dir: str, config: LinkConfig, cache_dir: str | None = None, save_dir: str | None = None, load_dir: str | None = None, validate: bool = False,
    estimator: Callable[[], Estimator] | None = None, scorer: Scorer | None = None, encoder: Encoder | None = None, tune: Callable[[DataFrame], Scorer] | None = None, single: bool = False,
) -> Trained:
    """Read the files of data_dir, train (or load a model), match the test sources and write both result files.

    encoder serves the dense channel; scorer, or the one that tune makes, reranks. With `single`, results are one file each.
    """
    from ..functions.normalize import add_norm_columns
    from ..operators import validate as rules
    from ..sources import cache, tsv

    def build(name: str, path: str) -> DataFrame:
        return add_norm_columns(tsv.load_source(spark, path, f"S{name[-1]}-"))

    splits = ("test",) if load_dir else ("train", "test")
    files = {f"{split}_source{k}": f"{data_dir}/{split}_source{k}.tsv" for split in splits for k in (1, 2, 3)}
    frames = cache.load_or_build(spark, cache_dir, files, build) if cache_dir else {n: build(n, p) for n, p in files.items()}
    if load_dir:
        models, iso, meta = cache.load_model(spark, load_dir)
        trained = Trained(models, iso, meta["threshold"], meta["oof_score"], float("nan"))
    else:
        s1, s2, s3 = (frames[f"train_source{k}"] for k in (1, 2, 3))
        lists = tsv.load_ground_truth(spark, f"{data_dir}/train_ground_truth.tsv")
        edges = tsv.truth_edges(lists)
        rules.require(rules.referential_report(lists, edges, s1, s2, s3))
        if config.sample_s1:
            s1, s2, s3 = sampling.sample_sources(s1, s2, s3, edges, config.sample_s1, config.seed)
        universe = s1.select(F.col("entity_id").alias("s1_id"))
        edges = edges.join(universe, "s1_id", "left_semi")
        trained = train(s1, [s2, s3], edges, universe, config, estimator, encoder, tune)
        if save_dir:
            cache.save_model(spark, save_dir, trained.models, trained.iso, trained.threshold, trained.score, list(FEATURES))
    s1, s2, s3 = (frames[f"test_source{k}"] for k in (1, 2, 3))
    cands, matches = infer(s1, [s2, s3], trained, config, scorer, encoder)
    cands = cands.persist()  # both results are made of them
    universe = s1.select(F.col("entity_id").alias("s1_id"))
    files = [f"{out_dir}/{name}{'.tsv' if single else ''}" for name in ("matching_results", "candidate_pairs")]
    tsv.write_results(universe, matches, files[0], "matching", single)
    tsv.write_results(universe, cands, files[1], "candidate", single)
    cands.unpersist()
    if validate:
        rules.require(validate_outputs(spark, *files, universe, None))
    return trained


def validate_outputs(spark: SparkSession, matching: str, candidate: str | None, required: DataFrame, known: DataFrame | None) -> DataFrame:
    """Report on result files (or folders of part files that each repeat the header)."""
    from ..operators import validate as rules
    from ..sources import cache, tsv

    reports, lists = [], {}
    for kind, path in (("matching", matching), ("candidate", candidate)):
        if path is None:
            continue
        if not cache.exists(spark, path):
            reports.append(spark.createDataFrame([(rules.ERROR, f"{kind}:no_such_file", 1, path)], "severity string, rule string, n bigint, examples string"))
            continue
        header = "\t".join(tsv.HEADERS[kind])
        lines = tsv.numbered_lines(spark, path).filter(~((F.col("line") > 0) & (F.col("value") == header)))
        lists[kind], found = rules.parse_lists(lines, tsv.HEADERS[kind])
        reports += [found, rules.list_report(lists[kind], required, known, kind)]
    if len(lists) == 2:
        reports.append(rules.matches_beyond_candidates(lists["matching"], lists["candidate"]))
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out
