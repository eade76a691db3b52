"""Cleaning and tokenizing of names and addresses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Legal forms that names lose, and abbreviations that addresses spell out.
LEGAL_FORMS = ("private limited", "incorporated", "private ltd", "corporation", "pvt ltd", "limited", "company", "corp", "sarl", "gmbh", "ltd", "llp", "llc", "inc", "sas", "plc", "co", "sa")
STREET_WORDS = {"rd": "road", "st": "street", "ave": "avenue", "blvd": "boulevard", "apt": "apartment", "fl": "floor", "ste": "suite", "dr": "drive", "ln": "lane", "hwy": "highway", "pvt": "private"}


def strip_any(c: Column) -> Column:
    """Without white space of any kind at the ends, no-break spaces too."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, " +", " "))


def base_clean(c: Column) -> Column:
    """Lower case, `&` as `and`, and single spaces for all that is no letter, number or underscore."""
    return squeeze(F.regexp_replace(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}_]", " "))


def _apart(c: Column) -> Column:
    """Words with two spaces between, so that neighbours don't share a delimiter."""
    return F.concat(F.lit(" "), F.replace(c, F.lit(" "), F.lit("  ")), F.lit(" "))


def normalize_name(c: Column) -> Column:
    """Cleaned, without legal forms anywhere; a name of nothing else stays."""
    clean = base_clean(c)
    forms = "|".join(x.replace(" ", "  ") for x in LEGAL_FORMS)
    return F.coalesce(F.nullif(squeeze(F.regexp_replace(_apart(clean), f" ({forms}) ", " ")), F.lit("")), clean)


def normalize_address(c: Column) -> Column:
    """Cleaned, with street words spelled out."""
    out = _apart(base_clean(c))
    for short, full in STREET_WORDS.items():
        out = F.replace(out, F.lit(f" {short} "), F.lit(f" {full} "))
    return squeeze(out)


def tokens(c: Column) -> Column:
    """Distinct words."""
    return F.array_distinct(F.filter(F.split(c, " "), lambda t: t != ""))


def rare_tokens(c: Column, min_len: int = 4) -> Column:
    """Distinct words of at least min_len characters."""
    return F.filter(tokens(c), lambda t: F.length(t) >= min_len)


def blocking_text(name: Column, address: Column) -> Column:
    """The name twice, then the address: names weigh double in text similarity."""
    return F.concat_ws(" ", name, name, address)


def char_bigrams(c: Column) -> Column:
    """Distinct pairs of neighbouring characters, spaces included."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substr(c, i, F.lit(2)))
    return F.when(F.length(c) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def add_norm_columns(source: DataFrame) -> DataFrame:
    """The source with norm_name and norm_addr."""
    return source.withColumns({"norm_name": normalize_name(F.col("business_name")), "norm_addr": normalize_address(F.col("business_address"))})
