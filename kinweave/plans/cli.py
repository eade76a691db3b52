"""python -m kinweave.plans.cli link|audit|validate|bench ..."""

from __future__ import annotations

import argparse
import importlib
import sys
import time
from dataclasses import fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import LinkConfig
from ..functions.normalize import add_norm_columns
from ..operators import audit, metrics, sampling
from ..operators import validate as rules
from ..sources import cache, tsv
from . import link


def _named(spec: str) -> object:
    """What MODULE:NAME stands for."""
    module, _, name = spec.partition(":")
    try:
        return getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError) as e:
        raise argparse.ArgumentTypeError(f"{spec}: {e}") from e


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kinweave")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("link", help="train, match and write results")
    for name in ("data-dir", "out-dir"):
        p.add_argument(f"--{name}", required=True)
    for name in ("cache-dir", "save-model-dir", "load-model-dir"):
        p.add_argument(f"--{name}")
    p.add_argument("--validate", action="store_true")
    p.add_argument("--single-file", action="store_true", help="one file with one header for each result")
    for name, what in (("encoder", "text -> vector, for --use-dense"), ("scorer", "two texts -> score, for the consensus"), ("tune", "frame of hard pairs -> scorer")):
        p.add_argument(f"--{name}", type=_named, metavar="MODULE:NAME", help=what)
    for f in fields(LinkConfig):
        flag = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            p.add_argument(flag, action="store_true")
        elif f.name == "consensus_mode":
            p.add_argument(flag, choices=("and", "or", "weighted"), default=f.default)
        else:
            p.add_argument(flag, type=type(f.default) if f.default is not None else int, default=f.default)
    p = sub.add_parser("audit", help="report on the training files")
    p.add_argument("--data-dir", required=True)
    p = sub.add_parser("validate", help="check result files")
    p.add_argument("--matching", required=True)
    p.add_argument("--candidate")
    p.add_argument("--test-dir", required=True)
    p.add_argument("--check-ids", action="store_true")
    p = sub.add_parser("bench", help="time blocking, or blocking and training, on a sample of the training files")
    p.add_argument("what", choices=("blocking", "train"))
    p.add_argument("--data-dir", required=True)
    for name, default in (("n", 5000), ("max-df", 300), ("n-splits", 3), ("seed", 42)):
        p.add_argument(f"--{name}", type=int, default=default)
    return top


def _train_files(spark: SparkSession, folder: str) -> tuple:
    """S1, S2, S3, lists and edges of the training files."""
    sources = (tsv.load_source(spark, f"{folder}/train_source{k}.tsv", f"S{k}-") for k in (1, 2, 3))
    lists = tsv.load_ground_truth(spark, f"{folder}/train_ground_truth.tsv")
    return (*sources, lists, tsv.truth_edges(lists))


def bench(spark: SparkSession, what: str, folder: str, n: int, max_df: int, n_splits: int, seed: int) -> dict:
    """Pairs, recall and seconds of blocking a sample; with `train`, positives, macro F0.5, threshold and floor too."""
    s1, s2, s3, _, edges = _train_files(spark, folder)
    s1, s2, s3 = (add_norm_columns(s) for s in sampling.sample_sources(s1, s2, s3, edges, n, seed))
    universe = s1.select(F.col("entity_id").alias("s1_id"))
    edges = edges.join(universe, "s1_id", "left_semi")
    config = LinkConfig(max_df=max_df, n_splits=n_splits, seed=seed)
    began = time.time()
    cands = link.candidates(s1, [s2, s3], config).persist()
    out = {"pairs": cands.count(), "recall": metrics.candidate_recall(edges, cands).first()["recall"], "seconds": round(time.time() - began, 1)}
    if what == "train":
        done = link.train(s1, [s2, s3], edges, universe, config)
        out |= {"positives": sampling.label_pairs(cands, edges).filter("label = 1").count(), "macro_f": done.score, "threshold": done.threshold, "floor": metrics.singleton_baseline(universe, edges).first()["macro_f"], "seconds": round(time.time() - began, 1)}
    return out


def main(argv: list[str] | None = None) -> int:
    parser = _parser()
    args = parser.parse_args(argv)
    if args.command == "link" and args.use_dense and args.encoder is None:
        parser.error("--use-dense needs --encoder")
    if args.command == "link" and (args.consensus_mode, args.cross_encoder_threshold) != (LinkConfig.consensus_mode, LinkConfig.cross_encoder_threshold) and not (args.scorer or args.tune):
        parser.error("--consensus-mode and --cross-encoder-threshold need --scorer or --tune")
    spark = SparkSession.builder.appName("kinweave").getOrCreate()
    if args.command == "link":
        config = LinkConfig(**{f.name: getattr(args, f.name) for f in fields(LinkConfig)})
        done = link.run(spark, args.data_dir, args.out_dir, config, args.cache_dir, args.save_model_dir, args.load_model_dir, args.validate, scorer=args.scorer, encoder=args.encoder, tune=args.tune, single=args.single_file)
        print(f"recall {done.recall:.4f}, threshold {done.threshold:.3f}, out-of-fold macro F0.5 {done.score:.4f}")
        return 0
    if args.command == "audit":
        s1, s2, s3, lists, edges = _train_files(spark, args.data_dir)
        every, universe = s1.unionByName(s2, allowMissingColumns=True).unionByName(s3, allowMissingColumns=True), lists.select("s1_id")
        for report in (rules.referential_report(lists, edges, s1, s2, s3), audit.source_sizes(every), audit.country_distribution(every), audit.missingness(every), audit.degree_histogram(universe, edges), audit.singleton_rate(universe, edges), audit.source_mix(edges), audit.multi_owned(edges)):
            report.show(50, False)
        return 0
    if args.command == "bench":
        print(bench(spark, args.what, args.data_dir, args.n, args.max_df, args.n_splits, args.seed))
        return 0
    required = tsv.read_ids(spark, f"{args.test_dir}/test_source1.tsv").select(F.col("id").alias("s1_id"))
    known = None
    files = [f"{args.test_dir}/test_source{k}.tsv" for k in (2, 3)]
    if args.check_ids and not all(cache.exists(spark, f) for f in files):
        print("warning: ids can't be checked, as a test source is missing")
    elif args.check_ids:
        known = tsv.read_ids(spark, files[0]).unionByName(tsv.read_ids(spark, files[1])).select(F.col("id").alias("other_id"))
    report = link.validate_outputs(spark, args.matching, args.candidate, required, known)
    report.show(50, False)
    return int(report.filter(F.col("severity") == rules.ERROR).count() > 0)


if __name__ == "__main__":
    sys.exit(main())
