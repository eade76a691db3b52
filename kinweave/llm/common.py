"""Shared helpers of the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches stay this small, so that a worker's memory doesn't depend on the size of a partition.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small; long texts then don't pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the input folder, only the named columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir")
    if not root:
        root = "file://" + os.path.join(tempfile.gettempdir(), "kinweave-shared")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/kinweave/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and survives lost executors."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that is no longer read."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes that a broadcast may hold, by its counted rows and their width in the hash table. Beyond, joins shuffle both sides.
BROADCAST_BYTES = 64 << 20


def small(table: DataFrame, row_bytes: int) -> DataFrame:
    """A materialized table, marked for broadcast if its counted rows of `row_bytes` each are few enough, else as it is."""
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


def few_ids(ids: DataFrame) -> DataFrame:
    """The same for a table of a few numbers a row."""
    return small(ids, 64)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Total UTF-8 bytes of a text column, for sizing shards."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column).cast("long")), F.lit(0)).alias("n")).first()["n"])


def parts_for(n_bytes: int, target: int, least: int = 8) -> int:
    """Number of partitions that keeps each at about `target` bytes."""
    return max(least, -(-n_bytes // target))


def _murmur3(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's hash of 32-bit integers."""
    turn = lambda v, n: v << np.uint32(n) | v >> np.uint32(32 - n)
    h = turn(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = turn(np.uint32(seed) ^ h, 13) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return h ^ h >> np.uint32(16)


def partition_keys(n: int) -> np.ndarray:
    """For each of n partitions an integer that Spark's partitioner by hash puts there, so that n groups fill them evenly.
    Only balance depends on it."""
    keys, at = np.full(n, -1, np.int64), 0
    while (keys < 0).any():
        some = np.arange(at, at + 4 * n + 64)
        to = _murmur3(some).view(np.int32).astype(np.int64) % n
        parts, first = np.unique(to, return_index=True)
        new = keys[parts] < 0
        keys[parts[new]] = some[first[new]]
        at += len(some)
    return keys


class Carried:
    """Columns that pass through a pandas function as they are. Whole numbers of 64 bits travel as text: where a column has
    nulls, pandas would make them floating-point numbers, which don't hold the large ones."""

    def __init__(self, df: DataFrame, names: Sequence[str]) -> None:
        self.fields = [df.schema[n] for n in names]
        self.names = [f"c{k}" for k in range(len(names))]

    def _travels(self, k: int) -> str:
        kind = self.fields[k].dataType.simpleString()
        return "string" if kind == "bigint" else kind

    def given(self) -> list[Column]:
        """The columns as the function gets and returns them: c0, c1 ..."""
        return [F.col(f"`{f.name}`").cast(self._travels(k)).alias(c) for k, (f, c) in enumerate(zip(self.fields, self.names, strict=True))]

    def kinds(self) -> list[str]:
        """Their part of the function's schema."""
        return [f"{c} {self._travels(k)}" for k, c in enumerate(self.names)]

    def restored(self) -> list[Column]:
        """The columns under their names and types again."""
        return [F.col(c).cast(f.dataType).alias(f.name) for f, c in zip(self.fields, self.names, strict=True)]


def batches(frames: Iterable, rows: int) -> Iterator:
    """Slices of at most `rows` rows of an iterator of pandas frames."""
    for frame in frames:
        for at in range(0, len(frame), rows):
            yield frame.iloc[at : at + rows]
