"""Link S1 records that arrive as a stream against sources that stand still."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.normalize import add_norm_columns
from ..operators import blocking


def link_stream(arriving: DataFrame, other: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, min_len: int = 4, max_df: int = 300, most: int = 300) -> StreamingQuery:
    """Candidates of each micro-batch of a stream of S1 records, by capped tokens of the other source.

    The capped postings don't depend on the stream, so they are written once, beside the checkpoint's own files, and read
    by every batch and after a restart. sink(candidates, batch_id) must be idempotent for a batch; the checkpoint then
    makes the whole exactly-once.
    """
    spark, at = other.sparkSession, f"{checkpoint.rstrip('/')}-postings"
    blocking.capped(blocking.postings(other, min_len), max_df).write.mode("ignore").parquet(at)
    index = spark.read.parquet(at)

    def batch(records: DataFrame, batch_id: int) -> None:
        found = blocking.match(blocking.postings(add_norm_columns(records), min_len), index)
        sink(blocking.cap_ranked(found, most), batch_id)

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
