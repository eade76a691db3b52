"""The registered queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, fingerprint, jaccard, langid, licenses, mixing, pii, quality, substrings
from .common import read_table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False, digests=True)


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families found in every document."""
    return licenses.report(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings that an earlier one has."""
    left = substrings.remove_repeats(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return jaccard.join(read_table(spark, sf_dir, "documents", "doc_id", "text"), words=3, num=90, den=100)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.report(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    mixed = mixing.mix(read_table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every vector whose id is divisible by 20."""
    return ann.search(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("id") % 20 == 0)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those that aren't held out."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = langid.fit(docs, usable=~held_out)
    found = langid.predict(docs.select("doc_id", "text"), model, reject=False)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited form, and how near its own is to the edited and the next one's."""
    return fingerprint.edit_report(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, and whether it is kept."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.score(docs, quality.fit(docs))


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the base kinds of personal data in every document: the part of op7_pii that SQL can express."""
    return op7_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of the mix: the part of op8_mix that SQL can express."""
    return op8_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def edit_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the edited texts: the part of op9_fingerprint that SQL can express."""
    return op9_fingerprint(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


OPERATORS = (op1_bpe, op2_ann, op3_langid, op4_license, op5_substrings, op6_jaccard, op7_pii, op8_mix, op9_fingerprint, op10_quality)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (*OPERATORS, pii_counts, mix_targets, edit_digests)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op6_jaccard": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                             ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b USING (g) WHERE a.doc_id <> b.doc_id
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
        r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.c = l.x)
        SELECT s.doc_id, len(s) AS n_shingles, component_id FROM s JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1) USING (doc_id)""",
    "pii_counts": r"""
        WITH m AS (SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
                          regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
                          list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card,
                          list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone
                   FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
        SELECT doc_id, n_email,
               len(list_filter(ip, lambda x: list_max(list_transform(string_split(x, '.'), lambda p: coalesce(TRY_CAST(left(ltrim(p, '0'), 4) AS INTEGER), 0))) <= 255)) AS n_ip,
               len(list_filter(card, lambda x: length(x) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(x)), lambda k:
                   CASE WHEN k % 2 = 0 THEN substr(x, length(x) - k, 1)::INTEGER ELSE 2 * substr(x, length(x) - k, 1)::INTEGER - 9 * (substr(x, length(x) - k, 1) > '4')::INTEGER END)) % 10 = 0)) AS n_card,
               len(list_filter(phone, lambda x: length(x) BETWEEN 9 AND 15)) AS n_phone
        FROM m""",
    "mix_targets": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight FROM s),
        r AS (SELECT *, 2 * source_size / weight AS ratio FROM w),
        c AS (SELECT *, (1.5 * (SELECT sum(size) FROM d) - coalesce(sum(2 * source_size) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                        / sum(weight) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
        l AS (SELECT level FROM c WHERE level <= ratio AND source_size > 0 ORDER BY ratio, source LIMIT 1)
        SELECT doc_id, size, source_size, round(least(weight * (SELECT level FROM l), 2.0 * source_size)::DOUBLE, 3) AS target
        FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source""",
    "edit_digests": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS following FROM d)
        SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || substr(following, 1, length(t) // 2)) AS edited_sha256 FROM n""",
}
