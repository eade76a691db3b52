"""Candidate pairs by shared tokens, rare tokens and name prefixes. A candidate frame is s1_id, other_id, shared.

Document frequencies and caps hold for each other source by itself; src is the source's prefix of an id. Postings are
distinct before they are joined, a cap is a semi-join with the tokens kept, and texts are attached only after the
ranked cap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import rare_tokens
from .topk import best_products, shared_counts, sizes_of


def src_of(column: str) -> F.Column:
    return F.substring(column, 1, 2)


def words_of(min_len: int = 4) -> F.Column:
    """The distinct tokens of name and address together."""
    return F.array_union(rare_tokens(F.col("norm_name"), min_len), rare_tokens(F.col("norm_addr"), min_len))


def postings(normed: DataFrame, min_len: int = 4, *more: str) -> DataFrame:
    """entity_id, src, token and `more`: the distinct tokens of each row's name and address together."""
    return normed.select("entity_id", src_of("entity_id").alias("src"), F.explode(words_of(min_len)).alias("token"), *more)


def postings_of_ids(normed: DataFrame, min_len: int = 4, chunk: str | None = None) -> DataFrame:
    """entity_id, src and token: an id's tokens once, however many rows it has. Rows without id take no part.

    With `chunk`, a column, the tokens are there once for each row of the id, in that row's chunk: rows of one id that a
    chunk's end parts are of both chunks, whichever text is in which.
    """
    rows = normed.filter(F.col("entity_id").isNotNull()).select("entity_id", words_of(min_len).alias("words"), *([chunk] if chunk else []))
    by_id = rows.groupBy("entity_id").agg(F.array_distinct(F.flatten(F.collect_set("words"))).alias("words"), *([F.collect_list(chunk).alias(chunk)] if chunk else []))
    out = by_id.select("entity_id", src_of("entity_id").alias("src"), F.explode("words").alias("token"), *([chunk] if chunk else []))
    return out.withColumn(chunk, F.explode(chunk)) if chunk else out


def token_grams(normed: DataFrame, min_len: int = 4) -> DataFrame:
    """id and gram: the postings with hashed tokens."""
    return postings(normed, min_len).select(F.col("entity_id").alias("id"), F.xxhash64("token").alias("gram"))


def document_frequency(post: DataFrame) -> DataFrame:
    """src, token, df."""
    return post.groupBy("src", "token").agg(F.count("*").alias("df"))


def capped(post: DataFrame, max_df: int, above: int = 0, chunk: str | None = None) -> DataFrame:
    """Postings of the tokens with above < df <= max_df; with `chunk`, a column of them, frequencies hold for each chunk."""
    by = ["src", "token", *([chunk] if chunk else [])]
    kept = post.groupBy(*by).agg(F.count("*").alias("df")).filter((F.col("df") <= max_df) & (F.col("df") > above)).select(*by)
    return post.join(kept, by, "left_semi")


def match(s1_post: DataFrame, other_post: DataFrame) -> DataFrame:
    """Pairs that share a token, and how many they share."""
    left = s1_post.select(F.col("entity_id").alias("s1_id"), "token")
    right = other_post.select(F.col("entity_id").alias("other_id"), "token")
    return left.join(right, "token").groupBy("s1_id", "other_id").agg(F.count("*").alias("shared"))


def by_rare_tokens(s1: DataFrame, other: DataFrame, min_len: int = 4) -> DataFrame:
    """Pairs that share any token of that length, however frequent.

    They are most of all pairs of large tables, so they come from products of blocks and not from a join on tokens. Tokens
    are told apart by a 64-bit hash.
    """
    return shared_counts(token_grams(s1, min_len), token_grams(other, min_len))


def best_by_rare_tokens(s1: DataFrame, other: DataFrame, min_len: int, most: int) -> DataFrame:
    """Of the pairs of `by_rare_tokens`, each entity's best by shared tokens, then id. No row is made for the others."""
    left, right = (token_grams(x, min_len) for x in (s1, other))
    sizes = sizes_of(*(x.withColumnRenamed("id", "entity_id") for x in (left, right)))
    best = best_products(*(x.withColumn("weight", F.lit(1.0)) for x in (left, right)), sizes, most, None, False)
    return cap_ranked(best.select("s1_id", "other_id", F.col("sim").cast("long").alias("shared")), most)


def by_tokens(s1: DataFrame, other: DataFrame, min_len: int = 4, max_df: int = 300, cap_s1: bool = False, chunk: str | None = None) -> DataFrame:
    """Pairs that share a token of df <= max_df in the other source, and in the first too with cap_s1.

    With cap_s1, the frame has a row for each pair and source only if the token is rare on both sides. chunk: a column of
    s1 by which its frequencies are taken, for results as of runs that take S1 in chunks.
    """
    left = postings_of_ids(s1, min_len, chunk)
    return match(capped(left, max_df, chunk=chunk) if cap_s1 else left, capped(postings_of_ids(other, min_len), max_df))


def by_rare_band(s1: DataFrame, other: DataFrame, min_len: int = 6, max_df: int = 300, max_df_long: int = 2000) -> DataFrame:
    """Pairs that share a long token of max_df < df <= max_df_long."""
    return match(postings(s1, min_len), capped(postings(other, min_len), max_df_long, above=max_df))


def prefix_key(prefix_len: int = 4) -> F.Column:
    """Country and the beginning of the name."""
    return F.concat(F.lower(F.coalesce("country", F.lit(""))), F.lit("|"), F.substring("norm_name", 1, prefix_len))


def by_prefix(s1: DataFrame, other: DataFrame, prefix_len: int = 4, max_pairs_per_key: int = 200_000, chunk: str | None = None) -> DataFrame:
    """Pairs with one prefix key, of keys with at most so many pairs. shared is 0: prefixes don't rank.

    chunk: a column of s1 by which its counts are taken, for results as of runs that take S1 in chunks.
    """
    by = ["key"] + ([chunk] if chunk else [])
    left = s1.select(F.col("entity_id").alias("s1_id"), prefix_key(prefix_len).alias("key"), *([chunk] if chunk else []))
    right = other.select(F.col("entity_id").alias("other_id"), src_of("entity_id").alias("src"), prefix_key(prefix_len).alias("key"))
    counts = left.groupBy(*by).agg(F.count("*").alias("n1")).join(right.groupBy("src", "key").agg(F.count("*").alias("n2")), "key")
    safe = counts.filter(F.col("n1") * F.col("n2") <= max_pairs_per_key).select(*by, "src")
    return left.join(safe, by).join(right, ["src", "key"]).select("s1_id", "other_id").distinct().withColumn("shared", F.lit(0).cast("long"))


def union(*candidates: DataFrame) -> DataFrame:
    """Pairs of any of them; shared counts add up."""
    out = candidates[0].select("s1_id", "other_id", "shared")
    for c in candidates[1:]:
        out = out.unionByName(c.select("s1_id", "other_id", "shared"))
    return out.groupBy("s1_id", "other_id").agg(F.sum("shared").alias("shared"))


def cap_ranked(candidates: DataFrame, most: int = 300) -> DataFrame:
    """Each entity's best candidates by shared tokens, then id; 0 or less lifts the cap."""
    if most <= 0:
        return candidates
    rank = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("shared"), "other_id"))
    return candidates.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def pair_frame(candidates: DataFrame, s1: DataFrame, other: DataFrame) -> DataFrame:
    """The pairs with names, addresses and countries of both sides; missing records leave nulls."""
    side = lambda df, own, k: df.select(F.col("entity_id").alias(own), F.col("norm_name").alias(f"name{k}"), F.col("norm_addr").alias(f"addr{k}"), F.col("country").alias(f"country{k}"))
    pairs = candidates.select("s1_id", "other_id")
    out = pairs.join(side(s1, "s1_id", 1), "s1_id", "left").join(side(other, "other_id", 2), "other_id", "left")
    return out.select("s1_id", "other_id", "name1", "addr1", "country1", "name2", "addr2", "country2")


def chunks(s1: DataFrame, size: int) -> DataFrame:
    """S1 with a chunk number by id order, null ids last: ranks within ranges come from counts of ranges, no task sorts all.

    The ranges' bounds are ids with the smallest hashes, so that every evaluation finds the same ones; those of
    repartitionByRange come from a sample that differs between two branches of one plan.
    """
    if size <= 0:
        return s1.withColumn("chunk_id", F.lit(0).cast("long"))
    n, each = int(s1.sparkSession.conf.get("spark.sql.shuffle.partitions")), 20
    step = int(n**0.5) + 1
    ids, null = s1.select("entity_id").filter(F.col("entity_id").isNotNull()), F.col("entity_id").isNull()
    drawn = ids.orderBy(F.xxhash64("entity_id"), "entity_id").limit(n * each).agg(F.sort_array(F.collect_list("entity_id")).alias("ids"))
    bounds = drawn.select(F.filter("ids", lambda _, i: i % each == each - 1).alias("fine"), F.filter("ids", lambda _, i: i % (each * step) == each - 1).alias("coarse"))
    below = lambda ids: F.size(F.filter(ids, lambda x: x <= F.col("entity_id")))
    parted = s1.crossJoin(F.broadcast(bounds)).withColumn("first", F.greatest(below("coarse") - 1, F.lit(0)) * step)
    part = F.col("first") + below(F.slice("fine", F.col("first") + 1, F.lit(step)))
    parted = parted.withColumn("part", F.when(null, n + 1).otherwise(part)).drop("first", "fine", "coarse")
    ranked = parted.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("entity_id")))
    before = parted.groupBy("part").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    return ranked.join(F.broadcast(before), "part").withColumn("chunk_id", F.floor((F.col("before") + F.col("at") - 1) / size)).drop("part", "at", "before")
