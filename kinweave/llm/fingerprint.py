"""Document fingerprints by content-defined chunking.

A gear hash over the bytes of a text sets the boundaries of chunks, with a stricter mask before the normal chunk
size and a looser one after it, so that sizes stay near the normal one. The fingerprint is the set of chunk digests
with the chunks' lengths. Containment of one text in another is the length of its chunks that the other has too,
as a share of its own length; an insertion moves few boundaries and so changes few chunks.

Nulls count as the empty text, whose fingerprint is empty; two empty fingerprints are alike (1), an empty one and
another are not (0). Equal texts have equal fingerprints. Whole texts are chunked, in time linear in their length; the
gear hash goes over pieces of a very long text, and what is held of it besides its bytes are the ends of its chunks.
Repeated rows each get their fingerprint; in the report, rows of one id follow each other in the order of their texts, and
null ids come first. An empty table gives an empty result. Columns besides those named are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Carried, bounded_batches, partition_keys, parts_for, text_bytes

MIN_CHUNK, NORMAL_CHUNK, MAX_CHUNK = 8, 24, 128
STRICT_BITS, LOOSE_BITS = 6, 3
#: Bytes of a range of ids. Beyond PARTS ranges they grow, up to MAX_PART_BYTES; a range is read as a stream.
PART_BYTES, MAX_PART_BYTES, PARTS = 16 << 20, 128 << 20, 2_000
#: Bytes over which the gear hash goes at once.
PIECE = 1 << 20
WINDOW = 32


def gear_table(seed: int = 0) -> np.ndarray:
    """256 random 32-bit words, by splitmix64 from the seed."""
    z = np.uint64(seed) + np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


GEAR = gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the gear hash of the 32 bytes that end there: windows of 1, 2, 4 ... bytes are doubled."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        grown = h.copy()
        grown[k:] += h[:-k] << np.uint32(k)
        h = grown
    return h


def cut_points(data: bytes) -> tuple[list[int], list[int]]:
    """Where the strict and where the loose mask allow a boundary, piece by piece."""
    strict, loose = [], []
    for at in range(0, len(data), PIECE):
        back = min(at, WINDOW - 1)
        h = gear_hashes(np.frombuffer(data[at - back : at + PIECE], np.uint8))[back:]
        found = np.flatnonzero((h >> np.uint32(32 - LOOSE_BITS)) == 0)
        strict += (found[(h[found] >> np.uint32(32 - STRICT_BITS)) == 0] + (at + 1)).tolist()
        loose += (found + (at + 1)).tolist()
    return strict, loose


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks of a text."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n] if n else []
    strict, loose = cut_points(data)
    out, start, i, j = [], 0, 0, 0
    while n - start > MIN_CHUNK:
        end = min(n, start + MAX_CHUNK)
        i = bisect_left(strict, start + MIN_CHUNK, i)
        if i < len(strict) and strict[i] < start + NORMAL_CHUNK:
            end = strict[i]
        else:
            j = bisect_left(loose, start + NORMAL_CHUNK, j)
            if j < len(loose) and loose[j] < end:
                end = loose[j]
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def fingerprint(text: str | None) -> dict[int, int]:
    """Digest of each distinct chunk and its length in bytes."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out, start = {}, 0
    for end in boundaries(data):
        out[xxhash.xxh3_64_intdigest(data[start:end])] = end - start
        start = end
    return out


def written(print_: dict[int, int]) -> str:
    """A fingerprint as text: digest:length in hexadecimal, in order, joined by commas."""
    return ",".join([f"{d:016x}:{n:x}" for d, n in sorted(print_.items())])


def parsed(text: str) -> dict[int, int]:
    """The fingerprint that `written` has written."""
    return {int(d, 16): int(n, 16) for d, n in (x.split(":") for x in text.split(",") if x)}


def containment(own: dict[int, int], other: dict[int, int]) -> float:
    """Share of the length of own's chunks that other has too."""
    if not own or not other:
        return float(not own and not other)
    return sum(n for d, n in own.items() if d in other) / sum(own.values())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of every row. No shuffle."""
    bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"c0": frame["c0"], "fingerprint": [written(fingerprint(t if isinstance(t, str) else None)) for t in frame["text"]]})

    through = Carried(docs, (id_col,))
    given = docs.select(*through.given(), F.col(text_col).cast("string").alias("text"))
    return given.mapInPandas(run, ", ".join([*through.kinds(), "fingerprint string"])).select(*through.restored(), "fingerprint")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt to ranges of ascending id: place, id, text, sorted; a range ends with the next range's first row, whose
    place is odd, and the last with the very first. The texts are shuffled once. Null ids come first."""
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), order.alias("order"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = text_bytes(rows)
    n = parts_for(total, max(PART_BYTES, min(MAX_PART_BYTES, total // PARTS)))
    # the ids alone, in ranges of about as many rows: their first ids are the bounds
    ids = rows.select("order").repartitionByRange(n, "order").groupBy(F.spark_partition_id().alias("part")).agg(F.min("order").alias("first"))
    firsts = np.unique(np.array([r["first"] for r in ids.collect()], np.int64))  # a number for each range
    keys = partition_keys(max(1, len(firsts)))

    def places(ids: pd.Series) -> pd.Series:
        """The range of each row as an even number, and that of which it is the tail as an odd one; a key for each above."""
        x = ids.to_numpy(np.int64)
        own = np.searchsorted(firsts, x, side="right") - 1
        before = (own - 1) % len(firsts)
        here, tail = own * 2 | keys[own] << 32, before * 2 + 1 | keys[before] << 32
        return pd.Series([[h, t] if f else [h] for h, t, f in zip(here.tolist(), tail.tolist(), (firsts[own] == x).tolist(), strict=True)])

    places = F.pandas_udf(places, T.ArrayType(T.LongType()))
    dealt = rows.select("id", "order", "text", F.explode(places("order")).alias("at"))
    dealt = dealt.select("id", "order", "text", F.shiftright("at", 32).cast("int").alias("key"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).alias("place"))
    dealt = dealt.repartition(max(1, len(firsts)), "key").sortWithinPartitions(F.shiftright("place", 1), "place", "order", "text")
    return dealt.select(F.col("id").cast("string").alias("id"), "place", "text")


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text against its edited form and against the next text by id (after the last, the first).

    The edited form replaces the last floor(n/2) code points by the first as many of the next text, or all.
    """
    bounded_batches(docs.sparkSession)
    dealt = with_next(docs, id_col, text_col)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prior = None  # the row before: range, whether a tail, id, text, fingerprint
        for frame in frames:
            out = []
            for rid, place, text in zip(frame["id"], frame["place"], frame["text"], strict=True):
                own = fingerprint(text)
                if prior is not None and prior[0] == place >> 1 and not prior[1]:
                    _, _, pid, ptext, pprint = prior
                    half = len(ptext) // 2
                    edited = ptext[: len(ptext) - half] + text[:half]
                    eprint = fingerprint(edited)
                    out.append((pid, len(ptext), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written(pprint), written(eprint), containment(pprint, eprint), containment(pprint, own)))
                prior = (place >> 1, bool(place & 1), rid, text, own)
            yield pd.DataFrame(out, columns=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]).astype({"n_chars": "int64"})

    kinds = "id string, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInPandas(run, kinds).withColumn("id", F.col("id").cast("bigint")).withColumnRenamed("id", id_col)
