"""Source, ground truth and result files with tabs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import strip_any
from ..operators.validate import ValidationError

REQUIRED = ("entity_id", "business_name", "business_address", "country")
HEADERS = {"matching": ("source1_entity_id", "matched_entity_ids"), "candidate": ("source1_entity_id", "candidate_entity_ids")}


def _has_open_quotes(spark: SparkSession, path: str) -> bool:
    """Whether some line has an odd number of quotes, and so may hold a quoted line break."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).limit(1).isEmpty()


def _read(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, blanks as "", `NA` and `NULL` as they stand; quotes are doubled inside quotes.

    Files are split between tasks, unless a quoted line break may stand in them: only then is each read by one task.
    """
    df = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=_has_open_quotes(spark, path), inferSchema=False, nullValue="\u0000", emptyValue="")
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def _check_keys(df: DataFrame, column: str, twice: str, path: str, prefix: str | None = None) -> None:
    """One aggregate over a key column: no value twice, and all with the prefix."""
    key = F.col(column)
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    wrong = F.lit(False) if prefix is None else ~key.startswith(prefix)
    r = counts.agg(F.sum(F.when(wrong, F.col("n"))).alias("wrong"), F.min(F.when(wrong, key)).alias("a"), F.count(F.when(F.col("n") > 1, 1)).alias("twice"), F.min(F.when(F.col("n") > 1, key)).alias("b")).first()
    for n, example, what in ((r["wrong"], r["a"], f"ids without the prefix {prefix}"), (r["twice"], r["b"], twice)):
        if n:
            raise ValidationError(f"{path}: {what}: {n}, such as {example}")


def load_source(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """A source file, checked: required columns, ids with the prefix, no id twice (both before ids are trimmed)."""
    df = _read(spark, path)
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValidationError(f"{path}: missing columns {missing}")
    _check_keys(df, "entity_id", "ids that occur twice", path, prefix)
    return df.withColumns({c: strip_any(F.col(c)) for c in REQUIRED})


def truth_lists(raw: DataFrame) -> DataFrame:
    """s1_id and ids, the distinct trimmed ids of its list. raw: source1_entity_id, matched_entity_ids."""
    ids = F.array_distinct(F.filter(F.transform(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), strip_any), lambda x: x != ""))
    return raw.select(F.col("source1_entity_id").alias("s1_id"), ids.alias("ids"))


def truth_edges(lists: DataFrame) -> DataFrame:
    """s1_id, other_id."""
    return lists.select("s1_id", F.explode("ids").alias("other_id"))


def load_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """s1_id and ids of a ground truth file; entities without a match keep an empty list."""
    df = _read(spark, path)
    missing = [c for c in HEADERS["matching"] if c not in df.columns]
    if missing:
        raise ValidationError(f"{path}: missing columns {missing}")
    _check_keys(df, "source1_entity_id", "entities that occur twice", path)
    return truth_lists(df)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """First cell of each line but the first and blank ones; quotes mean nothing here."""
    lines = numbered_lines(spark, path)
    return lines.filter("line > 0 and trim(value) <> ''").select(F.split_part("value", F.lit("\t"), F.lit(1)).alias("id"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and line: 0 for a file's first line, more for all others (in file order within a partition)."""
    df = spark.read.text(path).select("value", F.expr("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    low = df.agg(F.min(F.struct("at", "id")).alias("m")).first()["m"]
    first = (F.col("id") == low["id"]) if low else F.lit(False)
    return df.select("value", F.when(first, F.lit(0)).otherwise(F.col("id") + 1).alias("line"))


def result_lists(universe: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every entity of the universe with its sorted, comma-joined ids; empty if it has none. universe: s1_id."""
    joined = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("other_id")), ",").alias("ids"))
    return universe.select("s1_id").distinct().join(joined, "s1_id", "left").fillna("", ["ids"])


def write_results(universe: DataFrame, pairs: DataFrame, path: str, kind: str = "matching", single: bool = False) -> None:
    """Write the lists in order of the entities, as files with tabs and one header; files sort like their rows.

    With `single`, the path is one file with one header: the parts are written by the tasks and then joined, byte by byte.
    """
    a, b = HEADERS[kind]
    lists = result_lists(universe, pairs).select(F.col("s1_id").alias(a), F.col("ids").alias(b)).orderBy(a)
    at = f"{path}.parts" if single else path
    lists.write.mode("overwrite").csv(at, sep="\t", header=not single, quote="\u0000", escapeQuotes=False, emptyValue="")
    if single:
        _join_parts(universe.sparkSession, at, path, "\t".join((a, b)) + "\n")


def _join_parts(spark: SparkSession, parts: str, path: str, header: str) -> None:
    """One file of a header and the part files in order, which are deleted."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    folder, target = hadoop.fs.Path(parts), hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    if fs.exists(target):
        fs.delete(target, True)
    out = fs.create(target, True)
    out.write(bytearray(header.encode()))
    for name in sorted(s.getPath().toString() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")):
        given = fs.open(hadoop.fs.Path(name))
        hadoop.io.IOUtils.copyBytes(given, out, 1 << 20, False)
        given.close()
    out.close()
    fs.delete(folder, True)
