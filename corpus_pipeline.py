"""A corpus from raw documents to token ids, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept; between two stages the rows
are written as Parquet in the shared folder and read again. All but the last return the columns of `documents`.

Nulls: a null or wordless text is rejected by the first stage; null languages and sources stay null. Of near-duplicate
rows under one id, the second stage keeps one; rows whose id is null are not joined. Very long texts go through whole, each
operator working on them in pieces where it can. Ties: of equal documents the smallest id stays, and of equal rows under
one id one; the mix breaks ties by a hash of id and text. Empty tables pass through. Extra columns are left behind.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import bpe, jaccard, mixing, pii, quality
from kinweave.llm.common import discard, few_ids, materialize, read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on these documents' weak labels, does not reject."""
    docs = docs.select(*COLUMNS)
    return quality.score(docs, quality.fit(docs), carry=COLUMNS[1:]).filter("keep").select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class of near duplicates (5-word shingles, Jaccard >= 0.8)."""
    found = jaccard.join(docs, words=5, num=80, den=100)
    repeats = materialize(found.filter("component_id <> doc_id").select("doc_id"), "repeats")
    left = docs.select(*COLUMNS).join(few_ids(repeats), "doc_id", "left_anti").select(*COLUMNS)
    shared = materialize(left.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"), "shared-ids")
    if shared.isEmpty():
        return left
    # rows under one id are told apart by a hash of all they hold, and joined by themselves
    row = F.xxhash64(*COLUMNS).alias("row")
    own = materialize(left.join(few_ids(shared), "doc_id", "left_semi").select(row, *COLUMNS).dropDuplicates(["row"]), "shared-rows")
    classes = jaccard.join(own, words=5, num=80, den=100, id_col="row").select("row", "component_id")
    first = own.select("row", "doc_id").join(classes, "row").groupBy("doc_id", "component_id").agg(F.min("row").alias("row"))
    kept = own.join(first.select("row"), "row", "left_semi").select(*COLUMNS)
    return left.join(few_ids(shared), "doc_id", "left_anti").select(*COLUMNS).unionByName(kept)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets."""
    found = pii.detect(docs, carry=("lang", "source"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, each as many times as it is taken."""
    taken = mixing.mix(docs, carry=("text", "lang", "n_chars")).filter("copies > 0")
    return taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with digests of the ids and of their decoded text."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), carry=("lang", "source"), digests=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", dedup_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mix_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over `documents`. What a stage has written goes once the next one is written."""
    docs, before = read_table(spark, sf_dir, "documents", *COLUMNS), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
            if before is not None:
                discard(before)
            before = docs
    return docs
