"""Checks of sources, ground truth and output files, as semi-joins and anti-joins that give report frames.

A report has severity, rule, n and examples (up to five, in order, joined by commas).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXAMPLES = 5
ERROR, WARNING = "error", "warning"


class ValidationError(ValueError):
    """An input breaks a rule that must hold."""


def flagged(bad: DataFrame, column: str, rule: str, severity: str = ERROR) -> DataFrame:
    """Bad rows as severity, rule and example, for `report`."""
    return bad.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.col(column).cast("string").alias("example"))


def report(*flags: DataFrame) -> DataFrame:
    """One row for each rule that has bad rows: how many, and the first examples.

    Every frame is read once: partitions hand on counts and their smallest values, so that no task gathers all bad rows.
    """

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[tuple[str, str]] = Counter()
        few: dict[tuple[str, str], list[str]] = {}
        for frame in frames:
            for key, own in frame.groupby(["severity", "rule"])["example"]:
                n[key] += len(own)
                few[key] = sorted({*few.get(key, ()), *own.dropna()}, key=_utf8)[:EXAMPLES]
        yield pd.DataFrame([(*key, n[key], few[key]) for key in n], columns=["severity", "rule", "n", "few"])

    def whole(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        few = sorted({x for xs in frame["few"] for x in xs}, key=_utf8)[:EXAMPLES]
        return pd.DataFrame({"severity": [key[0]], "rule": [key[1]], "n": [int(frame["n"].sum())], "examples": [",".join(few)]})

    parts = reduce(DataFrame.unionByName, flags).mapInPandas(part, "severity string, rule string, n bigint, few array<string>")
    return parts.groupBy("severity", "rule").applyInPandas(whole, "severity string, rule string, n bigint, examples string")


def _utf8(x: str) -> bytes:
    return x.encode("utf-8", "surrogatepass")


def finding(bad: DataFrame, column: str, rule: str, severity: str = ERROR) -> DataFrame:
    """The report on one rule; no row if nothing is bad."""
    return report(flagged(bad, column, rule, severity))


def unknown_s1(gt: DataFrame, s1: DataFrame) -> DataFrame:
    """Ground truth of unknown S1 ids. gt: s1_id, ids (array)."""
    return gt.join(s1.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_anti").select("s1_id")


def unknown_targets(edges: DataFrame, *others: DataFrame) -> DataFrame:
    """Matched ids that no other source has."""
    known = reduce(DataFrame.unionByName, [o.select(F.col("entity_id").alias("other_id")) for o in others])
    return edges.join(known, "other_id", "left_anti").select("other_id").distinct()


def s1_without_truth(gt: DataFrame, s1: DataFrame) -> DataFrame:
    return s1.select(F.col("entity_id").alias("s1_id")).join(gt.select("s1_id"), "s1_id", "left_anti")


def referential_report(gt: DataFrame, edges: DataFrame, s1: DataFrame, s2: DataFrame, s3: DataFrame) -> DataFrame:
    """The three referential rules of a ground truth."""
    return report(flagged(unknown_s1(gt, s1), "s1_id", "truth_of_unknown_s1"), flagged(unknown_targets(edges, s2, s3), "other_id", "truth_of_unknown_target"), flagged(s1_without_truth(gt, s1), "s1_id", "s1_without_truth"))


def require(report: DataFrame) -> None:
    """Raise if a report has errors; a report holds a few rows."""
    bad = report.filter(F.col("severity") == ERROR).collect()
    if bad:
        raise ValidationError("; ".join(f"{r['rule']}: {r['n']} ({r['examples']})" for r in bad))


def list_report(lists: DataFrame, required: DataFrame, known: DataFrame | None = None, name: str = "matching") -> DataFrame:
    """Rules of an output file. lists: s1_id, ids (array, as written); required: s1_id; known: other_id, if to be checked."""
    # rules of a row and of its items: one scan of the lists
    self_match, proper = (lambda x: x.startswith("S1-")), (lambda x: x.startswith("S2-") | x.startswith("S3-"))
    rule = lambda name_, example: F.struct(F.lit(ERROR).alias("severity"), F.lit(f"{name}:{name_}").alias("rule"), example.alias("example"))
    given = F.filter("ids", lambda x: x != "")
    own = F.transform(F.filter(given, self_match), lambda _: rule("self_match", F.col("s1_id")))
    wrong = F.transform(F.filter(given, lambda x: ~proper(x) & ~self_match(x)), lambda x: rule("wrong_prefix", x))
    twice = F.when(F.size("ids") != F.size(F.array_distinct("ids")), F.array(rule("duplicate_id_in_list", F.col("s1_id")))).otherwise(F.array())
    of_rows = lists.select(F.explode(F.concat(own, wrong, twice)).alias("x")).select("x.*")
    # rules of entities: one meeting of those seen and those required
    seen = lists.groupBy("s1_id").agg(F.count("*").alias("n"))
    need = required.select("s1_id").distinct().withColumn("need", F.lit(True))
    met = seen.join(need, "s1_id", "full_outer")
    entity = F.col("s1_id")
    faults = F.filter(F.array(F.when(F.col("n") > 1, rule("duplicate_entity", entity)), F.when(F.col("n").isNull(), rule("missing_entity", entity)), F.when(F.col("need").isNull(), rule("unexpected_entity", entity))), lambda x: x.isNotNull())
    found = [of_rows, met.select(F.explode(faults).alias("x")).select("x.*")]
    if known is not None:
        items = lists.select(F.explode(F.filter(given, proper)).alias("other_id")).distinct()
        found.append(flagged(items.join(known.select("other_id"), "other_id", "left_anti"), "other_id", f"{name}:unknown_id"))
    return report(*found)


def matches_beyond_candidates(matching: DataFrame, candidates: DataFrame) -> DataFrame:
    """A warning: entities with a match that is no candidate."""
    pairs = lambda df: df.select("s1_id", F.explode("ids").alias("other_id")).filter("other_id <> ''")
    return finding(pairs(matching).join(pairs(candidates), ["s1_id", "other_id"], "left_anti").select("s1_id").distinct(), "s1_id", "match_not_a_candidate", WARNING)


def parse_lists(lines: DataFrame, header: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """Lists and format findings of an output file's lines. lines: value, and line (number from 0)."""
    first = F.lower(F.trim("value"))
    head = lines.filter("line = 0")
    body = lines.filter("line > 0 and trim(value) <> ''")
    cells = F.split("value", "\t")
    lists = body.filter(F.instr("value", "\t") > 0).select(cells[0].alias("s1_id"), F.filter(F.transform(F.split(F.coalesce(F.get(cells, 1), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "").alias("ids"))
    wrong = head.filter(F.array_join(F.transform(F.split(first, "\t"), lambda x: F.trim(x)), "\t") != "\t".join(header))
    empty = lines.agg(F.count("*").alias("lines")).filter("lines = 0").select(F.lit("").alias("value"))
    found = [
        flagged(empty, "value", "format:empty_file"),
        flagged(wrong.filter((F.instr("value", "\t") == 0) & (F.instr("value", ",") > 0)), "value", "format:commas_for_tabs"),
        flagged(wrong.filter((F.instr("value", "\t") > 0) | (F.instr("value", ",") == 0)), "value", "format:wrong_header"),
        flagged(body.filter(F.instr("value", "\t") == 0), "line", "format:row_without_tab"),
        flagged(lines.filter(~F.is_valid_utf8("value")), "line", "format:not_utf8"),
    ]
    return lists, report(*found)
