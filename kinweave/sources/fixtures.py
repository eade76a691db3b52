"""Three sources and their ground truth, derived from a documents table (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import add_norm_columns


def sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S1, S2, S3: entity_id, business_name, business_address, country."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    name, addr = F.substring("text", 1, 40), F.substring("text", 41, 60)

    def frame(df: DataFrame, prefix: str, name: F.Column, addr: F.Column, country: F.Column) -> DataFrame:
        return df.select(F.concat(F.lit(prefix), F.col("doc_id").cast("string")).alias("entity_id"), name.alias("business_name"), addr.alias("business_address"), country.alias("country"))

    s1 = frame(docs, "S1-", name, addr, F.col("lang"))
    s2 = frame(docs.filter("doc_id % 4 <> 3"), "S2-", F.concat(name, F.lit(" Ltd")), addr, F.col("lang"))
    turned = F.array_join(F.reverse(F.split(name, " ")), " ")
    s3 = frame(docs.filter("doc_id % 5 < 2"), "S3-", turned, F.substring("text", 46, 55), F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("lang")))
    return s1, s2, s3


def normed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(map(add_norm_columns, sources(spark, sf_dir)))


def truth(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges (s1_id, other_id) and universe (s1_id)."""
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    key = lambda p: F.concat(F.lit(p), F.col("doc_id").cast("string"))
    s2 = ids.filter("doc_id % 4 <> 3").select(key("S1-").alias("s1_id"), key("S2-").alias("other_id"))
    s3 = ids.filter("doc_id % 5 < 2").select(key("S1-").alias("s1_id"), key("S3-").alias("other_id"))
    return s2.unionByName(s3), ids.select(key("S1-").alias("s1_id"))
