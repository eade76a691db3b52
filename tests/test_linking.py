import warnings

import duckdb
import pytest
from pyspark.sql import functions as F

from kinweave.config import LinkConfig
from kinweave.operators import audit, blocking, matcher, metrics, sampling, topk, validate
from kinweave.plans import link
from kinweave.sources import cache, fixtures, tsv
from kinweave.streaming.incremental import link_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    s1, s2, s3 = (s.persist() for s in fixtures.normed(spark, SF))
    edges, universe = (x.persist() for x in fixtures.truth(spark, SF))
    return s1, s2, s3, edges, universe


def pairs_of(df):
    return {(r["s1_id"], r["other_id"]) for r in df.collect()}


def test_channels(spark, data):
    s1, s2, s3, edges, universe = data
    capped = blocking.by_tokens(s1, s2, max_df=20)
    free = blocking.by_rare_tokens(s1, s2)
    assert pairs_of(blocking.by_tokens(s1, s2, max_df=20, cap_s1=True)) <= pairs_of(capped) <= pairs_of(free)
    assert not pairs_of(blocking.by_rare_band(s1, s2, 4, 20, 50)) - pairs_of(free)
    both = blocking.union(capped, blocking.by_prefix(s1, s2))
    ranked = blocking.cap_ranked(both, 3)
    assert ranked.groupBy("s1_id").count().agg(F.max("count")).first()[0] <= 3
    assert blocking.cap_ranked(capped, 0) is capped
    recall = lambda c: metrics.candidate_recall(edges, c).first()["recall"]
    assert recall(ranked) <= recall(both) >= recall(capped) and recall(edges.limit(0)) == 0
    assert metrics.candidate_recall(edges.limit(0), free).first()["recall"] == 1


def test_prefix_caps_by_chunk(spark, data):
    s1, s2, *_ = data
    chunked = blocking.chunks(s1, 50)
    assert [r["count"] for r in chunked.groupBy("chunk_id").count().orderBy("chunk_id").collect()] == [50] * 4
    whole, by_chunk = (pairs_of(x) for x in (blocking.by_prefix(s1, s2, 4, 60), blocking.by_prefix(chunked, s2, 4, 60, chunk="chunk_id")))
    assert whole <= by_chunk


def test_one_and_many_partitions_agree(spark, data):
    s1, s2, *_ = data
    before = spark.conf.get("spark.sql.shuffle.partitions")
    a = pairs_of(blocking.cap_ranked(blocking.by_tokens(s1, s2), 5))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    b = pairs_of(blocking.cap_ranked(blocking.by_tokens(s1.repartition(5), s2.repartition(3)), 5))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert a == b


def test_f_beta(spark):
    universe = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "s1_id string")
    edges = spark.createDataFrame([("c", "x"), ("d", "x"), ("d", "y")], "s1_id string, other_id string")
    pred = spark.createDataFrame([("b", "x"), ("d", "x"), ("d", "x")], "s1_id string, other_id string")
    got = {r["s1_id"]: r["f"] for r in metrics.entity_scores(universe, edges, pred).collect()}
    assert got == {"a": 1, "b": 0, "c": 0, "d": pytest.approx(1.25 * 0.5 / 0.75)}
    assert metrics.macro_f(universe.limit(0), edges, pred).first()["macro_f"] == 0
    assert metrics.singleton_baseline(universe, edges).first()["macro_f"] == 0.5
    assert metrics.best_threshold(spark.createDataFrame([(0.1, 0.5), (0.2, 0.7), (0.3, 0.7)], "t double, macro_f double")) == (0.2, 0.7)
    assert metrics.best_threshold(spark.createDataFrame([], "t double, macro_f double")) == (0.5, -1.0)


def test_dense_cells_recall(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q, r = v.filter("id % 2 = 0"), v.filter("id % 2 = 1")
    exact, near = ({(x["query_id"], x["ref_id"]) for x in f(q, r, 10, None).collect()} for f in (topk.dense_topk, topk.dense_topk_cells))
    assert len(exact & near) >= 0.9 * len(exact)


def test_sampling(spark, data):
    s1, s2, s3, edges, _ = data
    a, b, _ = sampling.sample_sources(s1, s2, s3, edges, 10)
    assert a.count() == 10 and pairs_of(edges.join(a.select(F.col("entity_id").alias("s1_id")), "s1_id").filter("other_id like 'S2-%'").select("s1_id", "other_id")) and b.count() >= 30
    rows = [("a", f"n{k}", 0) for k in range(40)] + [("b", "p", 1), ("b", "q", 1)] + [("b", f"n{k}", 0) for k in range(40)]
    labelled = spark.createDataFrame(rows, "s1_id string, other_id string, label int")
    counts = {(r["s1_id"], r["label"]): r["count"] for r in sampling.subsample_negatives(labelled, 15).groupBy("s1_id", "label").count().collect()}
    assert counts == {("a", 0): 15, ("b", 0): 30, ("b", 1): 2}
    assert sampling.subsample_negatives(labelled, 0) is labelled
    assert sampling.folds(labelled, 3).groupBy("s1_id").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0


def test_consensus():
    with pytest.raises(ValueError):
        matcher.consensus(F.lit(1), F.lit(1), "none")


def write_tsv(path, header, rows):
    path.write_text("\n".join(["\t".join(header), *("\t".join(r) for r in rows)]) + "\n", encoding="utf-8")
    return str(path)


def test_sources(spark, tmp_path):
    head = ["entity_id", "business_name", "business_address", "country", "extra"]
    path = write_tsv(tmp_path / "a.tsv", head, [["S1-1", '"Foo ""Bar"" Ltd"', "NA", "NULL", "e"], ["S1-2", " x ", '"two\nlines"', "", ""], ["S1-3", "short"]])
    rows = {r["entity_id"]: r for r in tsv.load_source(spark, path, "S1-").collect()}
    assert rows["S1-1"]["business_name"] == 'Foo "Bar" Ltd' and rows["S1-1"]["business_address"] == "NA" and rows["S1-1"]["country"] == "NULL"
    assert rows["S1-2"]["business_name"] == "x" and rows["S1-2"]["business_address"] == "two\nlines" and rows["S1-2"]["country"] == ""
    assert rows["S1-3"]["country"] == "" and rows["S1-1"]["extra"] == "e"
    for header, body in ((head[:3], [["S1-1", "a", "b"]]), (head, [["S2-1", "a", "b", "c", ""]]), (head, [["S1-1", "a", "b", "c", ""]] * 2)):
        with pytest.raises(validate.ValidationError):
            tsv.load_source(spark, write_tsv(tmp_path / "bad.tsv", header, body), "S1-")


def test_ground_truth(spark, tmp_path):
    path = write_tsv(tmp_path / "gt.tsv", tsv.HEADERS["matching"], [["S1-1", " S2-1, S3-1 ,,S2-1"], ["S1-2", ""]])
    assert {r["s1_id"]: r["ids"] for r in tsv.load_ground_truth(spark, path).collect()} == {"S1-1": ["S2-1", "S3-1"], "S1-2": []}


OUTPUTS = {
    "matching:duplicate_entity": [["S1-1", ""], ["S1-1", ""], ["S1-2", ""]],
    "matching:duplicate_id_in_list": [["S1-1", "S2-1,S2-1"], ["S1-2", ""]],
    "matching:self_match": [["S1-1", "S1-2"], ["S1-2", ""]],
    "matching:wrong_prefix": [["S1-1", "x"], ["S1-2", ""]],
    "matching:unknown_id": [["S1-1", "S2-99"], ["S1-2", ""]],
    "matching:missing_entity": [["S1-1", ""]],
    "matching:unexpected_entity": [["S1-1", ""], ["S1-2", ""], ["S1-3", ""]],
    "format:row_without_tab": [["S1-1", ""], ["S1-2", ""], ["S1-1"]],
}


@pytest.mark.parametrize("rule", OUTPUTS)
def test_each_rule(spark, tmp_path, rule):
    required = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1_id string")
    known = spark.createDataFrame([("S2-1",)], "other_id string")
    path = write_tsv(tmp_path / "m.tsv", tsv.HEADERS["matching"], OUTPUTS[rule])
    assert [r["rule"] for r in link.validate_outputs(spark, path, None, required, known).collect()] == [rule]


def test_headers_and_subset(spark, tmp_path):
    required = spark.createDataFrame([("S1-1",)], "s1_id string")
    good = write_tsv(tmp_path / "m.tsv", tsv.HEADERS["matching"], [["S1-1", "S2-1"], ["  "]])
    none = write_tsv(tmp_path / "c.tsv", tsv.HEADERS["candidate"], [["S1-1", ""]])
    found = link.validate_outputs(spark, good, none, required, None).collect()
    assert [(r["severity"], r["rule"]) for r in found] == [("warning", "match_not_a_candidate")]
    comma = tmp_path / "x.tsv"
    comma.write_text("source1_entity_id,matched_entity_ids\nS1-1\tS2-1\n")
    assert [r["rule"] for r in link.validate_outputs(spark, str(comma), None, required, None).collect()] == ["format:commas_for_tabs"]
    wrong = write_tsv(tmp_path / "w.tsv", ("a", "b"), [["S1-1", "S2-1"]])
    assert [r["rule"] for r in link.validate_outputs(spark, wrong, None, required, None).collect()] == ["format:wrong_header"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Train and test files made of the fixture."""
    out = tmp_path_factory.mktemp("data")
    edges, universe = fixtures.truth(spark, SF)
    lists = {r["s1_id"]: r["ids"] for r in tsv.result_lists(universe, edges).collect()}
    for split in ("train", "test"):
        for k, s in enumerate(fixtures.sources(spark, SF), 1):
            rows = [[x.replace("\t", " ").replace("\n", " ").replace('"', "'") for x in r] for r in s.collect()]
            write_tsv(out / f"{split}_source{k}.tsv", tsv.REQUIRED, rows)
    write_tsv(out / "train_ground_truth.tsv", tsv.HEADERS["matching"], list(map(list, lists.items())))
    return str(out)


def test_whole_run(spark, folder, tmp_path):
    config = LinkConfig(n_splits=2, max_df=30, max_cands_per_entity=10, use_rare=True)
    done = link.run(spark, folder, str(tmp_path / "out"), config, str(tmp_path / "cache"), str(tmp_path / "model"), validate=True, estimator=matcher.logistic)
    assert done.recall > 0.9 and done.score > 0.7 and 0.05 <= done.threshold <= 0.95
    written = spark.read.csv(str(tmp_path / "out" / "matching_results"), sep="\t", header=True)
    assert written.columns == list(tsv.HEADERS["matching"]) and written.count() == 200
    again = link.run(spark, folder, str(tmp_path / "out2"), config, str(tmp_path / "cache"), load_dir=str(tmp_path / "model"), validate=True)
    assert again.threshold == done.threshold
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "out2" / "matching_results"), sep="\t", header=True).collect()), key=str) == sorted(map(tuple, written.collect()), key=str)


def test_second_scorer(spark, data):
    s1, s2, s3, edges, _ = data
    cands = blocking.cap_ranked(blocking.by_tokens(s1, s2, max_df=20), 2)
    pairs = blocking.pair_frame(cands, s1, s2)
    scored = cands.select("s1_id", "other_id", F.lit(0.9).alias("prob"))
    same = lambda a, b: F.when(a == b, 1.0).otherwise(0.0)
    both, either = (matcher.rerank(pairs, scored, same, m, 0.65, 0.92).count() for m in ("and", "or"))
    assert both <= either == cands.count()


def test_cache_follows_files(spark, tmp_path):
    path = tmp_path / "a.txt"
    path.write_text("x\n")
    built = []

    def build(name, p):
        built.append(name)
        return spark.read.text(p)

    for _ in range(2):
        frames = cache.load_or_build(spark, str(tmp_path / "c"), {"a": str(path)}, build)
    assert built == ["a"]
    path.write_text("x\ny\n")
    frames = cache.load_or_build(spark, str(tmp_path / "c"), {"a": str(path)}, build)
    assert built == ["a", "a"] and frames["a"].count() == 2


def test_audit(spark, data):
    *_, edges, universe = data
    assert audit.degree_histogram(universe, edges).agg(F.sum("n")).first()[0] == 200
    assert audit.multi_owned(edges).count() == 0
    assert audit.run_summary(universe, edges, edges, edges).filter("what = 'positives'").first()["n"] == edges.count()


def test_stream_like_batch(spark, data, tmp_path):
    s1, s2, *_ = data
    raw = s1.select(*tsv.REQUIRED)
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    link_stream(arriving, s2, lambda df, k: df.write.mode("overwrite").parquet(str(tmp_path / f"out/b={k}")), str(tmp_path / "ck"), max_df=20, most=5).awaitTermination()
    got = pairs_of(spark.read.parquet(str(tmp_path / "out")))
    assert got == pairs_of(blocking.cap_ranked(blocking.by_tokens(s1, s2, max_df=20), 5))


def test_missing_and_empty_files(spark, tmp_path):
    required = spark.createDataFrame([("S1-1",)], "s1_id string")
    assert [r["rule"] for r in link.validate_outputs(spark, str(tmp_path / "none.tsv"), None, required, None).collect()] == ["matching:no_such_file"]
    (tmp_path / "e.tsv").write_text("")
    assert "format:empty_file" in [r["rule"] for r in link.validate_outputs(spark, str(tmp_path / "e.tsv"), None, required, None).collect()]


def test_command_line(spark, folder, tmp_path, capsys):
    from kinweave.plans import cli

    assert cli.main(["audit", "--data-dir", folder]) == 0
    out = cli.bench(spark, "blocking", folder, 50, 30, 2, 42)
    assert out["pairs"] > 0 and 0 < out["recall"] <= 1
    ids = [r["entity_id"] for r in tsv.load_source(spark, f"{folder}/test_source1.tsv", "S1-").collect()]
    good = write_tsv(tmp_path / "m.tsv", tsv.HEADERS["matching"], [[i, ""] for i in ids])
    assert cli.main(["validate", "--matching", good, "--test-dir", folder, "--check-ids"]) == 0
    bad = write_tsv(tmp_path / "b.tsv", tsv.HEADERS["matching"], [[i, ""] for i in ids[1:]])
    assert cli.main(["validate", "--matching", bad, "--test-dir", folder]) == 1


def test_warns_of_low_recall(data, monkeypatch):
    s1, s2, s3, edges, universe = data

    class Stop(Exception):
        pass

    def stop(*_):
        raise Stop

    monkeypatch.setattr(sampling, "label_pairs", stop)
    with pytest.warns(UserWarning, match="recall"), pytest.raises(Stop):
        link.train(s1, [s2, s3], edges, universe, LinkConfig(min_recall=1.01))
    with warnings.catch_warnings(), pytest.raises(Stop):
        warnings.simplefilter("error", UserWarning)
        link.train(s1, [s2, s3], edges, universe, LinkConfig(min_recall=0.0))


def small_vectors(text):
    """A toy encoder: counts of letters, as a unit vector."""
    import numpy as np
    import pandas as pd

    @F.pandas_udf("array<double>")
    def encode(t: pd.Series) -> pd.Series:
        rows = [np.bincount([ord(c) % 32 for c in x] or [0], minlength=32).astype(float) for x in t]
        return pd.Series([list(r / max(1e-9, np.linalg.norm(r))) for r in rows])

    return encode(text)


def equal_texts(a, b):
    return F.when(F.levenshtein(a, b) <= 12, F.lit(1.0)).otherwise(0.0)


def test_run_with_boosting_encoder_and_tuned_scorer(spark, folder, tmp_path):
    seen = []

    def tune(frame):
        seen.append({r["kind"] for r in frame.select("text1", "text2", "label", "kind").collect()})
        return equal_texts

    config = LinkConfig(n_splits=2, max_df=30, max_cands_per_entity=10, use_dense=True, dense_top_k=5, max_iter=4, max_depth=3, consensus_mode="or")
    with pytest.raises(ValueError, match="encoder"):
        link.run(spark, folder, str(tmp_path / "out"), config)
    done = link.run(spark, folder, str(tmp_path / "out"), config, validate=True, encoder=small_vectors, tune=tune, single=True)
    assert done.score > 0.5 and done.recall > 0.9 and len(seen) == 1 and seen[0] <= {"false_positive", "false_negative"}
    lines = (tmp_path / "out" / "matching_results.tsv").read_text().split("\n")
    assert lines[0] == "\t".join(tsv.HEADERS["matching"]) and len(lines) == 202 and lines[-1] == "" and lines[1:-1] == sorted(lines[1:-1])
    # with the scorer as the other half of `or`, equal texts are matched whatever the matcher says
    alone = link.run(spark, folder, str(tmp_path / "alone"), config, encoder=small_vectors, single=True)
    count = lambda name: sum(x.count("S2-") + x.count("S3-") for x in (tmp_path / name / "matching_results.tsv").read_text().split("\n"))
    assert alone.threshold == done.threshold and count("out") >= count("alone")


def test_command_line_refuses_what_would_do_nothing(folder, tmp_path, capsys):
    from kinweave.plans import cli

    for more in (["--use-dense"], ["--consensus-mode", "or"], ["--cross-encoder-threshold", "0.5"], ["--encoder", "no.such:thing"]):
        with pytest.raises(SystemExit):
            cli.main(["link", "--data-dir", folder, "--out-dir", str(tmp_path), *more])


def test_files_are_split_unless_line_breaks_are_quoted(spark, tmp_path):
    head = list(tsv.REQUIRED)
    rows = [[f"S1-{k}", f'5" pipe "{k}"' if k == 3 else f"name {k}", "street", "us"] for k in range(4000)]
    plain = write_tsv(tmp_path / "p.tsv", head, [r for r in rows if '"' not in r[1]])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert tsv.load_source(spark, plain, "S1-").rdd.getNumPartitions() > 3
        broken = write_tsv(tmp_path / "b.tsv", head, [*rows[:2], ["S1-9", '"two\nlines"', "x", ""]])
        assert tsv.load_source(spark, broken, "S1-").count() == 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_bad_bytes_are_a_finding(spark, tmp_path):
    required = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1_id string")
    path = tmp_path / "m.tsv"
    path.write_bytes("\t".join(tsv.HEADERS["matching"]).encode() + b"\nS1-1\tS2-1\nS1-2\tS2-\xff\xfe\n")
    assert "format:not_utf8" in [r["rule"] for r in link.validate_outputs(spark, str(path), None, required, None).collect()]


def test_report_counts_and_examples(spark):
    bad = spark.createDataFrame([(f"x{k % 40:02}",) for k in range(200)] + [(None,)], "id string").repartition(5)
    assert [tuple(r) for r in validate.finding(bad, "id", "r").collect()] == [("error", "r", 201, "x00,x01,x02,x03,x04")]
    assert validate.finding(bad.limit(0), "id", "r").count() == 0


def test_cells_of_few_vectors(spark):
    one = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vector array<double>")
    none = one.limit(0)
    assert topk.dense_topk_cells(one, none).count() == 0 and topk.dense_topk_cells(none, one).count() == 0
    assert [tuple(r) for r in topk.dense_topk_cells(one, one).collect()] == [(1, 1, 1.0, 1)]
    same = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(9)], "id long, vector array<double>")
    assert [r["ref_id"] for r in topk.dense_topk_cells(one, same, 3).orderBy("rank").collect()] == [0, 1, 2]


def test_sparse_products_in_small_pieces(spark, data, monkeypatch):
    s1, s2, *_ = data
    run = lambda: sorted(map(tuple, topk.tfidf_topk(topk.word_grams(s1), topk.word_grams(s2), 4).collect()))
    whole = run()
    for name, value in (("SPARSE_QUERIES", 30), ("SPARSE_REFS", 17), ("SPARSE_CELLS", 50)):
        monkeypatch.setattr(topk, name, value)
    assert run() == whole
    assert topk.tfidf_topk(topk.word_grams(s1), topk.word_grams(s2.limit(0))).count() == 0


def test_seeded_negatives_follow_the_hash(spark):
    rows = [("a", f"n{k}", 0) for k in range(40)] + [("b", "p", 1)] + [("b", f"n{k}", 0) for k in range(40)]
    labelled = spark.createDataFrame(rows, "s1_id string, other_id string, label int")
    order = {r["other_id"]: r["h"] for r in labelled.select("other_id", sampling.place("other_id", seed=7).alias("h")).collect()}
    got = {}
    for r in sampling.subsample_negatives(labelled.repartition(3), 6, seed=7).filter("label = 0").collect():
        got.setdefault(r["s1_id"], set()).add(r["other_id"])
    first = sorted((f"n{k}" for k in range(40)), key=order.get)[:6]
    assert got == {"a": set(first), "b": set(first)}


def test_token_caps_by_chunk(spark, data):
    s1, s2, *_ = data
    chunked = blocking.chunks(s1, 50)
    slices = [pairs_of(blocking.by_tokens(chunked.filter(F.col("chunk_id") == k), s2, max_df=20, cap_s1=True)) for k in range(4)]
    assert pairs_of(blocking.by_tokens(chunked, s2, max_df=20, cap_s1=True, chunk="chunk_id")) == set().union(*slices)


def test_chunks_are_the_same_in_every_branch(spark):
    """More rows than a range exchange samples, and columns of which the counts need none."""
    s1 = spark.range(40_000).select(F.concat(F.lit("S1-"), F.col("id").cast("string")).alias("entity_id"), F.sha2(F.col("id").cast("string"), 256).alias("norm_name"), F.lit("x").alias("country"))
    rows = blocking.chunks(s1, 300).select("entity_id", "norm_name", "chunk_id").collect()
    want = {e: k // 300 for k, e in enumerate(sorted(f"S1-{k}" for k in range(40_000)))}
    assert {r["entity_id"]: r["chunk_id"] for r in rows} == want and len(rows) == 40_000


def test_prefix_pairs_by_chunk_of_many(spark):
    """Each key has one row of a chunk, so that every pair is below the cap only with right chunks."""
    s1 = spark.range(30_000).select(F.format_string("S1-%05d", "id").alias("entity_id"), F.format_string("%04d", F.col("id") % 300).alias("norm_name"), F.sha2(F.col("id").cast("string"), 256).alias("note"), F.lit("x").alias("country"))
    s2 = spark.range(300).select(F.format_string("S2-%05d", "id").alias("entity_id"), F.format_string("%04d", "id").alias("norm_name"), F.lit("x").alias("country"))
    assert blocking.by_prefix(blocking.chunks(s1, 300), s2, 4, 1, chunk="chunk_id").count() == 30_000


def test_token_pairs_by_chunk_of_many(spark):
    """Each token is in one row of a chunk, so that every pair is below the cap only with right chunks."""
    s1 = spark.range(30_000).select(F.format_string("S1-%05d", "id").alias("entity_id"), F.format_string("%04d", F.col("id") % 300).alias("norm_name"), F.lit("").alias("norm_addr"), F.lit("x").alias("country"))
    s2 = spark.range(300).select(F.format_string("S2-%05d", "id").alias("entity_id"), F.format_string("%04d", "id").alias("norm_name"), F.lit("").alias("norm_addr"))
    assert blocking.by_tokens(blocking.chunks(s1, 300), s2, max_df=1, cap_s1=True, chunk="chunk_id").count() == 30_000


def test_best_products_hold_against_brute_force(spark):
    """Dense and sparse parts, copies beyond k and ties, with few vectors in a block."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(f"{s}-{i:03d}", int(g), float(w)) for s in ("a", "b") for i in range(90) for g, w in zip(np.unique(np.r_[rng.integers(0, 6, 3), rng.integers(6, 500, 4)]), rng.random(7) + 0.1)]
    rows += [(f"b-9{i:02d}", g, 1.0) for i in range(40) for g in (1, 2, 7)]
    full = {}
    for e, g, w in rows:
        full.setdefault(e, np.zeros(500))[g] = w
    unit = {e: v / np.linalg.norm(v) for e, v in full.items()}
    refs = [e for e in unit if e[0] == "b"]
    want = {(q, r) for q in unit if q[0] == "a" for r in sorted((r for r in refs if round(unit[q] @ unit[r], 9) > 0), key=lambda r: (-round(unit[q] @ unit[r], 9), r))[:5]}
    df = spark.createDataFrame(rows, "id string, gram long, weight double")
    for size in (topk.SPARSE_QUERIES, 32):
        found = {}
        with pytest.MonkeyPatch.context() as m:
            m.setattr(topk, "SPARSE_QUERIES", size)
            m.setattr(topk, "SPARSE_REFS", size)
            for r in topk.best_products(df.filter("id < 'b'"), df.filter("id > 'b'"), (90, 130, 900), 5, 9, True).collect():
                found.setdefault(r["s1_id"], []).append((-r["sim"], r["other_id"]))
        assert {(q, r) for q, x in found.items() for _, r in sorted(x)[:5]} == want


def test_near_block_after_far_ones_is_bounded_by_its_own_best(monkeypatch):
    """Few pairs are scored in double precision, though all of the second block are nearer than any of the first."""
    import numpy as np

    def block(n, grams, seed):
        w = np.random.default_rng(seed).random((n, len(grams))) + 0.1
        w /= np.linalg.norm(w, axis=1, keepdims=True)
        return topk.Packed(np.array(grams), np.repeat(np.arange(n), len(grams)), np.tile(np.arange(len(grams)), n), w.ravel(), n), w

    (q, a), (far, b), (near, c) = block(30, range(9), 1), block(200, range(8, 17), 2), block(300, range(9), 3)
    asked, first = [], topk.exact
    monkeypatch.setattr(topk, "exact", lambda q, r, x, y: asked.append(len(x)) or first(q, r, x, y))
    best = topk.Best(q, 5, 9)
    best.meet(far, np.array([f"a{i:03d}" for i in range(200)], object))
    best.meet(near, np.array([f"b{i:03d}" for i in range(300)], object))
    x, ids, value = best.result()
    assert sum(asked) < 30 * 5 * 8 and np.allclose(value.reshape(30, 5), -np.sort(-np.round(a @ c.T, 9), 1)[:, :5])


def test_char_search_of_texts_is_that_of_grams(spark, data):
    """Copies beyond k, permuted words, ids of two rows, null ids, odd spaces, several kinds and blocks; no gram is shuffled."""
    s1, s2, *_ = (x.select("entity_id", "norm_name", "norm_addr") for x in data[:3])
    more = [(f"-c{i:02d}", "copied name", "of one street") for i in range(20)] + [(f"-p{i}", "name copied", "street one of") for i in range(4)] + [("-two", "first row", "x"), ("-two", "second row", "y"), ("-none", "", ""), ("-wide", "", "z  \U0001f600\u00e9 ")]
    s1, s2 = (x.unionByName(spark.createDataFrame([(p + i, n, a) for i, n, a in more], "entity_id string, norm_name string, norm_addr string")) for x, p in ((s1, "S1"), (s2, "S2")))
    rows = lambda df: sorted(map(tuple, df.select("s1_id", "other_id", "sim", "rank").collect()))
    want = rows(topk.tfidf_topk(topk.char_grams(s1), topk.char_grams(s2), 4))
    null = spark.createDataFrame([(None, "copied name", "z")], "entity_id string, norm_name string, norm_addr string")
    found = topk.char_topk(s1.unionByName(null), s2.unionByName(null), 4)
    assert rows(found) == want
    assert "gram#" not in "".join(x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x)
    with pytest.MonkeyPatch.context() as m:
        for name, value in (("SPARSE_QUERIES", 30), ("TEXT_REFS", 17), ("TEXT_BLOCKS", 2), ("TEXT_KINDS", 5)):
            m.setattr(topk, name, value)
        assert rows(topk.char_topk(s1, s2, 4)) == want
        m.setattr(topk, "HELD_GRAMS", 10)
        assert rows(topk.char_topk(s1, s2, 4)) == want
    assert topk.char_topk(s1, s2.limit(0), 4).count() == topk.char_topk(s1.limit(0), s2, 4).count() == 0


def test_all_pairs_by_blocks(spark, data):
    """Every pair with its number of shared tokens, also with few records in a block, and no pair goes through a shuffle."""
    s1, s2, *_ = data
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(blocking.match(blocking.postings(s1), blocking.postings(s2)))
    found = blocking.by_rare_tokens(s1, s2)
    assert rows(found) == want and found.columns == ["s1_id", "other_id", "shared"]
    assert "s1_id" not in "".join(x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x)
    with pytest.MonkeyPatch.context() as m:
        for name, size in (("SPARSE_QUERIES", 16), ("SPARSE_REFS", 16), ("PAIR_QUERIES", 50), ("PAIR_REFS", 50), ("PAIR_ROWS", 7)):
            m.setattr(topk, name, size)
        assert rows(blocking.by_rare_tokens(s1, s2)) == want
    assert blocking.by_rare_tokens(s1.limit(0), s2).count() == blocking.by_rare_tokens(s1, s2.limit(0)).count() == 0


def test_candidates_by_tfidf_are_the_channels_best(spark, data):
    """As by all pairs of all channels; TF-IDF is asked only for records with room for its pairs."""
    s1, s2, s3, *_ = data
    config = LinkConfig(use_tfidf=True, max_cands_per_entity=8)
    rows = lambda df: sorted(map(tuple, df.select("s1_id", "other_id", "shared").collect()))
    every = []
    for o in (s2, s3):
        every += [topk.tfidf_topk(g(s1), g(o)).select("s1_id", "other_id", F.lit(0).cast("long").alias("shared")) for g in (topk.char_grams, topk.word_grams)]
        every.append(blocking.match(blocking.postings(s1), blocking.postings(o)))
    want = rows(blocking.cap_ranked(blocking.union(*every), 8))
    asked, first = [], topk.tfidf_topk
    with pytest.MonkeyPatch.context() as m:
        for name in ("SPARSE_QUERIES", "SPARSE_REFS"):
            m.setattr(topk, name, 16)
        m.setattr(topk, "tfidf_topk", lambda q, *a: asked.append({r[0] for r in q.select("entity_id").collect()}) or first(q, *a))
        assert rows(link.candidates(s1, [s2, s3], config)) == want
    assert {0} < {x[2] for x in want} and max(map(len, asked)) < s1.count()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with null ids and with ids of several rows, whose words neighbours by id share."""
    texts = [(k, f"group{k // 17}x wide{k // 35}y tail{k % 90}z some words of document {k % 7}", "en") for k in range(2_000)]
    texts = [(None if k % 50 == 3 else k, t, x) for k, t, x in texts] + [(k, t, x) for k, t, x in texts if k % 20 == 5] + [(k, f"other{k % 40}q group{k // 30}x", "en") for k in range(2_000) if k % 20 == 6]
    at = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(5).write.parquet(f"{at}/documents.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["block_token_by_chunk", "block_token_both_caps", "block_token_other_cap", "chunk_slices"])
def test_odd_ids_like_sql(spark, odd, name):
    from kinweave.plans import queries

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{odd}/documents.parquet/*.parquet')")
    found = c.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    want = sorted(map(str, found.fetchall()))
    assert sorted(str(tuple(r)) for r in queries.QUERIES[name](spark, odd).select(*names).collect()) == want and want


def test_null_ids_come_last_in_chunks(spark):
    s1 = spark.range(100).select(F.when(F.col("id") % 4 > 0, F.format_string("S1-%03d", "id")).alias("entity_id"))
    got = [(r["entity_id"], r["chunk_id"]) for r in blocking.chunks(s1, 30).collect()]
    ids = sorted(e for e, _ in got if e)
    assert {e: c for e, c in got if e} == {e: k // 30 for k, e in enumerate(ids)} and sorted(c for e, c in got if not e) == [2] * 15 + [3] * 10
