"""Registered queries of the linkage operators over the derived fixture, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LinkConfig
from ..functions.similarity import edit_features, relational_features, set_jaccard
from ..functions.normalize import add_norm_columns, char_bigrams, tokens
from ..operators import audit, blocking, matcher, metrics, sampling, topk, validate
from ..sources import cache, fixtures, tsv
from . import link, oracle

#: Caps that bite on the small fixtures too.
MAX_DF, PREFIX_CAP, MOST = 50, 2_000, 300

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _all(spark: SparkSession, d: str, normed: bool = True) -> DataFrame:
    return reduce(DataFrame.unionByName, (fixtures.normed if normed else fixtures.sources)(spark, d))


def _over_others(spark: SparkSession, d: str, channel: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    s1, s2, s3 = fixtures.normed(spark, d)
    return channel(s1, s2).unionByName(channel(s1, s3))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return blocking.cap_ranked(block_union(spark, d), MOST)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    s1, s2, s3 = fixtures.normed(spark, d)
    return blocking.pair_frame(_candidates(spark, d), s1, s2.unionByName(s3))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """A deterministic score: mean Jaccard of names' and addresses' words."""
    return _pairs(spark, d).select("s1_id", "other_id", _mean_jaccard().alias("prob"))


def _mean_jaccard() -> F.Column:
    return F.round((set_jaccard(tokens(F.col("name1")), tokens(F.col("name2"))) + set_jaccard(tokens(F.col("addr1")), tokens(F.col("addr2")))) / 2, 9)


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    return matcher.at_threshold(_scored(spark, d), 0.6)


@query
def normalize_name(spark, d):
    return _all(spark, d).select("entity_id", "norm_name")


@query
def normalize_address(spark, d):
    return _all(spark, d).select("entity_id", "norm_addr")


@query
def source_tokens(spark, d):
    return _all(spark, d).select("entity_id", F.array_join(F.array_sort(tokens(F.col("norm_name"))), " ").alias("name_tokens"), F.size(char_bigrams(F.col("norm_name"))).cast("long").alias("n_bigrams"))


@query
def token_document_frequency(spark, d):
    return blocking.document_frequency(blocking.postings(_all(spark, d)))


@query
def posting_capped(spark, d):
    return blocking.capped(blocking.postings(_all(spark, d)), MAX_DF).select("entity_id", "token")


@query
def block_rare_uncapped(spark, d):
    return _over_others(spark, d, blocking.by_rare_tokens)


@query
def block_token_both_caps(spark, d):
    return _over_others(spark, d, lambda a, b: blocking.by_tokens(a, b, max_df=MAX_DF, cap_s1=True))


@query
def block_token_other_cap(spark, d):
    return _over_others(spark, d, lambda a, b: blocking.by_tokens(a, b, max_df=MAX_DF))


@query
def block_rare_band(spark, d):
    return _over_others(spark, d, lambda a, b: blocking.by_rare_band(a, b, 6, 4, MAX_DF))


@query
def block_prefix(spark, d):
    return _over_others(spark, d, lambda a, b: blocking.by_prefix(a, b, 4, PREFIX_CAP)).select("s1_id", "other_id")


@query
def block_union(spark, d):
    return blocking.union(block_token_other_cap(spark, d), _over_others(spark, d, lambda a, b: blocking.by_prefix(a, b, 4, PREFIX_CAP)))


@query
def cap_ranked(spark, d):
    return blocking.cap_ranked(block_union(spark, d), 20)


@query
def block_prefix_by_chunk(spark, d):
    """Caps on prefix keys by chunks of S1."""
    s1, s2, s3 = fixtures.normed(spark, d)
    s1 = blocking.chunks(s1, 300)
    return reduce(DataFrame.unionByName, [blocking.by_prefix(s1, o, 4, 400, chunk="chunk_id") for o in (s2, s3)]).select("s1_id", "other_id")


@query
def block_token_by_chunk(spark, d):
    """Caps on tokens of both sides, of S1 by chunks."""
    s1, s2, s3 = fixtures.normed(spark, d)
    s1 = blocking.chunks(s1, 300)
    return reduce(DataFrame.unionByName, [blocking.by_tokens(s1, o, max_df=20, cap_s1=True, chunk="chunk_id") for o in (s2, s3)])


@query
def candidates_tfidf(spark, d):
    """The candidates of a run with the TF-IDF channels."""
    s1, s2, s3 = fixtures.normed(spark, d)
    return link.candidates(s1, [s2, s3], LinkConfig(use_tfidf=True, max_cands_per_entity=20))


@query
def chunk_slices(spark, d):
    s1, _, _ = fixtures.sources(spark, d)
    return blocking.chunks(s1, 300).groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("entity_id").alias("first_id"))


@query
def pair_frame(spark, d):
    return _pairs(spark, d)


@query
def topk_word_tfidf(spark, d):
    return _over_others(spark, d, lambda a, b: topk.tfidf_topk(topk.word_grams(a), topk.word_grams(b)))


@query
def topk_char_tfidf(spark, d):
    return _over_others(spark, d, topk.char_topk)


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return v.filter("id % 2 = 0"), v.filter("id % 2 = 1")


@query
def dense_topk(spark, d):
    return topk.dense_topk(*_vectors(spark, d), digits=9)


@query
def dense_topk_cells(spark, d):
    return topk.dense_topk_cells(*_vectors(spark, d))


@query
def dense_topk_every_cell(spark, d):
    """With as many probes as cells, cells give the exact result."""
    return topk.dense_topk_cells(*_vectors(spark, d), probes=4096, digits=9)


def _features(*names: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return relational_features(_pairs(spark, d)).select("s1_id", "other_id", *[F.round(n, 9).alias(n) for n in names])

    return run


QUERIES |= {
    "feat_jaccard": _features("name_jaccard", "addr_jaccard"),
    "feat_bigram": _features("name_char_bigram_jaccard"),
    "feat_len": _features("name_len_diff", "addr_len_diff"),
    "feat_country": _features("country_match", "country_either_empty"),
    "feat_rare": _features("rare_token_overlap", "rare_token_union_size"),
    "feat_first_token": _features("name_first_token_match"),
}


@query
def feat_edit(spark, d):
    names = ("name_levenshtein_ratio", "name_token_sort_ratio", "name_partial_ratio", "addr_levenshtein_ratio", "addr_token_sort_ratio")
    return edit_features(_pairs(spark, d)).select("s1_id", "other_id", *names)


@query
def feat_indel_names(spark, d):
    """The part of feat_edit that SQL can express."""
    return feat_edit(spark, d).select("s1_id", "other_id", *[F.round(n, 9).alias(n) for n in ("name_levenshtein_ratio", "name_token_sort_ratio")])


@query
def candidate_recall(spark, d):
    return metrics.candidate_recall(fixtures.truth(spark, d)[0], _candidates(spark, d)).withColumn("recall", F.round("recall", 9))


@query
def candidate_recall_defaults(spark, d):
    """Recall of the candidates that a run makes with its default caps, which hardly bite on the fixture."""
    s1, s2, s3 = fixtures.normed(spark, d)
    return metrics.candidate_recall(fixtures.truth(spark, d)[0], link.candidates(s1, [s2, s3], LinkConfig())).withColumn("recall", F.round("recall", 9))


@query
def entity_fbeta(spark, d):
    edges, universe = fixtures.truth(spark, d)
    return metrics.entity_scores(universe, edges, _predicted(spark, d)).withColumn("f", F.round("f", 9))


@query
def macro_f05(spark, d):
    edges, universe = fixtures.truth(spark, d)
    return metrics.macro_f(universe, edges, _predicted(spark, d)).withColumn("macro_f", F.round("macro_f", 9))


@query
def singleton_baseline(spark, d):
    edges, universe = fixtures.truth(spark, d)
    return metrics.singleton_baseline(universe, edges).withColumn("macro_f", F.round("macro_f", 9))


@query
def audit_source_sizes(spark, d):
    return audit.source_sizes(_all(spark, d, False))


@query
def audit_country(spark, d):
    return audit.country_distribution(_all(spark, d, False))


@query
def audit_missingness(spark, d):
    return audit.missingness(_all(spark, d, False)).withColumn("ratio", F.round("ratio", 9))


@query
def audit_degree(spark, d):
    edges, universe = fixtures.truth(spark, d)
    return audit.degree_histogram(universe, edges).withColumn("share", F.round("share", 9))


@query
def audit_singleton_rate(spark, d):
    edges, universe = fixtures.truth(spark, d)
    return audit.singleton_rate(universe, edges).withColumn("singleton_rate", F.round("singleton_rate", 9))


@query
def audit_source_mix(spark, d):
    return audit.source_mix(fixtures.truth(spark, d)[0])


@query
def audit_multi_owned(spark, d):
    edges, _ = fixtures.truth(spark, d)
    return audit.multi_owned(_damaged_edges(edges))


@query
def run_summary(spark, d):
    edges, universe = fixtures.truth(spark, d)
    scored = _scored(spark, d)
    return audit.run_summary(universe, edges, scored, matcher.at_threshold(scored, 0.6))


def _damaged_edges(edges: DataFrame) -> DataFrame:
    """The truth, and false edges that break each referential rule: more owners, unknown entities, unknown targets."""
    number = F.split_part("s1_id", F.lit("-"), F.lit(2)).cast("long")
    more = edges.filter(number % 50 == 0).select(F.concat(F.lit("S1-"), (number + 1).cast("string")).alias("s1_id"), "other_id")
    unknown = edges.filter(number % 100 == 0).select(F.concat("s1_id", F.lit("x")).alias("s1_id"), F.concat("other_id", F.lit("y")).alias("other_id"))
    return edges.unionByName(more).unionByName(unknown)


@query
def validate_ground_truth(spark, d):
    s1, s2, s3 = fixtures.sources(spark, d)
    edges = _damaged_edges(fixtures.truth(spark, d)[0])
    lists = edges.groupBy("s1_id").agg(F.collect_set("other_id").alias("ids"))
    return validate.referential_report(lists, edges, s1, s2, s3)


def _damaged_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An output with a fault of every kind, what is required, and the candidates' lists."""
    edges, universe = fixtures.truth(spark, d)
    ids = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    n = F.col("doc_id")
    text = lambda p, s="": F.concat(F.lit(p), n.cast("string"), F.lit(s))
    own = F.filter(F.array(F.when(n % 4 != 3, text("S2-")), F.when(n % 5 < 2, text("S3-"))), lambda x: x.isNotNull())
    faulty = (
        F.when(n % 97 == 1, F.concat(own, F.array(text("S2-"), text("S2-"))))
        .when(n % 97 == 2, F.concat(own, F.array(text("S1-"))))
        .when(n % 97 == 3, F.concat(own, F.array(text("X-"))))
        .when(n % 97 == 4, F.concat(own, F.array(text("S2-", "z"))))
        .otherwise(own)
    )
    rows = ids.filter(n % 97 != 5).select(text("S1-").alias("s1_id"), faulty.alias("ids"))
    rows = rows.unionByName(ids.filter(n % 97 == 6).select(text("S1-").alias("s1_id"), own.alias("ids")))
    rows = rows.unionByName(ids.filter(n % 97 == 7).select(text("S1-", "q").alias("s1_id"), own.alias("ids")))
    return rows, universe, ids.select(text("S1-").alias("s1_id"), own.alias("ids"))


@query
def validate_lists(spark, d):
    rows, universe, _ = _damaged_lists(spark, d)
    _, s2, s3 = fixtures.sources(spark, d)
    return validate.list_report(rows, universe, s2.unionByName(s3).select(F.col("entity_id").alias("other_id")))


@query
def validate_subset(spark, d):
    rows, _, cands = _damaged_lists(spark, d)
    return validate.matches_beyond_candidates(rows, cands)


@query
def validate_format(spark, d):
    """Lines made of the fixture's ids: a header with commas, rows with and without tabs, blank rows."""
    n = F.col("doc_id")
    line = F.when(n == 0, "source1_entity_id,matched_entity_ids").when(n % 50 == 1, F.concat(F.lit("S1-"), n.cast("string"))).when(n % 50 == 2, "  ").otherwise(F.concat(F.lit("S1-"), n.cast("string"), F.lit("\tS2-"), n.cast("string")))
    lines = spark.read.parquet(f"{d}/documents.parquet").select(line.alias("value"), n.alias("line"))
    return validate.parse_lists(lines, tsv.HEADERS["matching"])[1]


@query
def pair_labels(spark, d):
    return sampling.label_pairs(_candidates(spark, d), fixtures.truth(spark, d)[0]).select("s1_id", "other_id", "label")


@query
def sample_weights(spark, d):
    return sampling.sample_weights(_candidates(spark, d)).select("s1_id", "other_id", F.round("weight", 9).alias("weight"))


@query
def subsample_negatives(spark, d):
    labelled = sampling.label_pairs(_candidates(spark, d), fixtures.truth(spark, d)[0])
    return sampling.subsample_negatives(labelled, 3, seed=None).select("s1_id", "other_id", "label")


@query
def grouped_folds(spark, d):
    return sampling.folds(_candidates(spark, d), 5).groupBy("s1_id").agg(F.countDistinct("fold").alias("n_folds"))


@query
def sample_sources(spark, d):
    s1, s2, s3 = fixtures.sources(spark, d)
    return reduce(DataFrame.unionByName, sampling.sample_sources(s1, s2, s3, fixtures.truth(spark, d)[0], 50)).select("entity_id")


@query
def sample_sources_by_id(spark, d):
    s1, s2, s3 = fixtures.sources(spark, d)
    return reduce(DataFrame.unionByName, sampling.sample_sources(s1, s2, s3, fixtures.truth(spark, d)[0], 50, seed=None)).select("entity_id")


@query
def threshold_sweep(spark, d):
    edges, universe = fixtures.truth(spark, d)
    return metrics.threshold_sweep(universe, edges, _scored(spark, d)).select(F.round("t", 9).alias("t"), F.round("macro_f", 9).alias("macro_f"))


def _consensus(mode: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        names = set_jaccard(tokens(F.col("name1")), tokens(F.col("name2")))
        both = _pairs(spark, d).select("s1_id", "other_id", _mean_jaccard().alias("prob"), F.round(names, 9).alias("second"))
        return both.filter(matcher.consensus(F.col("prob"), F.col("second"), mode, 0.6, 0.7)).select("s1_id", "other_id")

    return run


QUERIES |= {f"consensus_{m}": _consensus(m) for m in ("and", "or", "weighted")}


@query
def hard_negatives(spark, d):
    labelled = sampling.label_pairs(_scored(spark, d), fixtures.truth(spark, d)[0])
    return sampling.hard_negatives(labelled, 100).select("s1_id", "other_id", "label", "prob", "kind")


@query
def matching_results(spark, d):
    return tsv.result_lists(fixtures.truth(spark, d)[1], _predicted(spark, d))


@query
def candidate_pairs(spark, d):
    return tsv.result_lists(fixtures.truth(spark, d)[1], _candidates(spark, d))


def _source_files(spark: SparkSession, d: str) -> dict[str, str]:
    """The fixture's sources as files with tabs, quoted where they must be."""
    at = cache.scratch(spark, "sources")
    for k, s in enumerate(fixtures.sources(spark, d), 1):
        s.write.csv(f"{at}/source{k}.tsv", sep="\t", header=True, quote='"', escape='"', emptyValue="")
    return {f"source{k}": f"{at}/source{k}.tsv" for k in (1, 2, 3)}


@query
def source_files(spark, d):
    """Sources written as files and loaded again, with the loader's checks."""
    return reduce(DataFrame.unionByName, [tsv.load_source(spark, path, f"S{name[-1]}-") for name, path in _source_files(spark, d).items()])


@query
def source_cache(spark, d):
    """Normalized sources by way of the Parquet cache, which is read the second time."""
    files, at = _source_files(spark, d), cache.scratch(spark, "cache")
    build = lambda name, path: add_norm_columns(tsv.load_source(spark, path, f"S{name[-1]}-"))
    cache.load_or_build(spark, at, files, build)
    frames = cache.load_or_build(spark, at, files, lambda name, path: None)
    return reduce(DataFrame.unionByName, frames.values()).select("entity_id", "norm_name", "norm_addr")


@query
def truth_file(spark, d):
    """The ground truth written as one file and loaded again, as edges."""
    edges, universe = fixtures.truth(spark, d)
    at = cache.scratch(spark, "truth") + "/truth.tsv"
    tsv.write_results(universe, edges, at, "matching", single=True)
    return tsv.truth_edges(tsv.load_ground_truth(spark, at))


@query
def result_file_ids(spark, d):
    """The first cells of a result file."""
    edges, universe = fixtures.truth(spark, d)
    at = cache.scratch(spark, "results") + "/candidates.tsv"
    tsv.write_results(universe, edges, at, "candidate", single=True)
    return tsv.read_ids(spark, at)


@query
def validate_files(spark, d):
    """The report on two result files, the first with faults of every kind."""
    rows, universe, cands = _damaged_lists(spark, d)
    _, s2, s3 = fixtures.sources(spark, d)
    at = cache.scratch(spark, "faulty")
    for kind, lists in (("matching", rows), ("candidate", cands)):
        a, b = tsv.HEADERS[kind]
        lists.select(F.col("s1_id").alias(a), F.array_join("ids", ",").alias(b)).write.csv(f"{at}/{kind}", sep="\t", header=True, quote="\u0000", emptyValue="")
    return link.validate_outputs(spark, f"{at}/matching", f"{at}/candidate", universe, s2.unionByName(s3).select(F.col("entity_id").alias("other_id")))


@query
def train_oof_isotonic(spark, d):
    """Out-of-fold probabilities of a quick matcher, calibrated."""
    s1, s2, s3 = fixtures.normed(spark, d)
    cands = blocking.cap_ranked(block_union(spark, d), 20)
    labelled = sampling.label_pairs(link.features(cands, s1, [s2, s3]), fixtures.truth(spark, d)[0])
    labelled = sampling.subsample_negatives(labelled, LinkConfig().neg_per_pos_cap)
    oof, _ = matcher.train_oof(labelled, 3, matcher.logistic)
    return matcher.apply_calibration(oof, matcher.calibrate(oof)).select("s1_id", "other_id", "fold", "prob")


ORACLE_SQL = oracle.SQL
