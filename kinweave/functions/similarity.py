"""Fifteen features of a pair of records. All but the edit-based ones are column expressions; those run in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .normalize import char_bigrams, rare_tokens, tokens

FEATURES = (
    "name_levenshtein_ratio", "name_token_sort_ratio", "name_partial_ratio", "name_jaccard", "name_len_diff", "name_char_bigram_jaccard",
    "addr_levenshtein_ratio", "addr_token_sort_ratio", "addr_jaccard", "addr_len_diff",
    "country_match", "country_either_empty", "rare_token_overlap", "rare_token_union_size", "name_first_token_match",
)


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, bit-parallel: a zero bit of `row` marks a step of the length along a."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """2 LCS / (|a| + |b|); two empty strings are equal."""
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def _prefix_lcs(s: str, text: str) -> list[int]:
    """LCS of s with every prefix of text, in one pass."""
    masks: dict[str, int] = {}
    for k, c in enumerate(s):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(s)) - 1
    row, out = full, [0]
    for c in text:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
        out.append(len(s) - row.bit_count())
    return out


def _best_window(s: str, text: str) -> float:
    """Best ratio of s with a prefix, suffix or window of its length of the longer text."""
    m, n = len(s), len(text)
    best = 0.0
    for lcs in (_prefix_lcs(s, text[:m]), _prefix_lcs(s[::-1], text[::-1][:m])):
        best = max(best, max(2 * x / (m + k) for k, x in enumerate(lcs) if k))
    for at in range(1, n - m):
        if best >= 1.0:
            break
        best = max(best, lcs_length(s, text[at : at + m]) / m)
    return best


def partial_ratio(a: str, b: str) -> float:
    """Best Indel ratio of the shorter string with a part of the longer one."""
    s, text = (a, b) if len(a) <= len(b) else (b, a)
    if not s:
        return float(not text)
    if s in text:
        return 1.0
    best = _best_window(s, text)
    return max(best, _best_window(text, s)) if len(s) == len(text) else best


#: Characters of one machine word, and pairs of strings that are compared together.
LANE, LANES = 64, 4096


def _codes(texts: list[str], width: int, pad: int) -> np.ndarray:
    """Code points in rows of one width."""
    joined = "".join([t.ljust(width, "\0") for t in texts])
    out = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(texts), width).copy()
    out[np.arange(width) >= np.array([len(t) for t in texts])[:, None]] = pad
    return out


def lcs_steps(a: list[str], b: list[str]) -> np.ndarray:
    """LCS of each a (at most LANE characters) with every prefix of its b: a row for each pair, a column for each length.

    The recurrence of `lcs_length` on 64-bit words, one for each pair, for all pairs at once. Beyond the end of a b the
    value stays.
    """
    wide = max([1, *map(len, a)])
    x, y = _codes(a, wide, 0xFFFFFFFF), _codes(b, max([1, *map(len, b)]), 0xFFFFFFFE)
    bits = np.zeros((len(a), LANE), bool)
    size = np.array([len(t) for t in a])
    full = np.where(size == LANE, ~np.uint64(0), (np.uint64(1) << size.astype(np.uint64) % np.uint64(LANE)) - np.uint64(1))
    row, out = full.copy(), np.zeros((len(a), y.shape[1] + 1), np.int32)
    with np.errstate(over="ignore"):
        for j in range(y.shape[1]):
            np.equal(x, y[:, j, None], out=bits[:, :wide])
            hit = row & np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
            row = (row + hit | row - hit) & full
            out[:, j + 1] = size - np.bitwise_count(row)
    return out


def _in_lanes(pairs: list[tuple[str, str]], kernel: Callable[[list[tuple[str, str]]], np.ndarray], slow: Callable[[str, str], float]) -> np.ndarray:
    """A symmetric function of pairs: each distinct pair once, those of like lengths together, long ones one by one."""
    place: dict[tuple[str, str], int] = {}
    of = np.array([place.setdefault((x, y) if (len(x), x) <= (len(y), y) else (y, x), len(place)) for x, y in pairs], np.int64)
    distinct = list(place)
    found = np.empty(len(distinct))
    short = [k for k, (x, y) in enumerate(distinct) if 0 < len(x) and len(x) <= LANE]
    for k in set(range(len(distinct))) - set(short):
        found[k] = slow(*distinct[k])
    short.sort(key=lambda k: (len(distinct[k][1]), len(distinct[k][0])))
    for at in range(0, len(short), LANES):
        own = short[at : at + LANES]
        found[own] = kernel([distinct[k] for k in own])
    return found[of] if len(of) else np.zeros(0)


def indel_ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    """indel_ratio of many pairs."""

    def kernel(some: list[tuple[str, str]]) -> np.ndarray:
        a, b = zip(*some, strict=True)
        return 2 * lcs_steps(list(a), list(b))[:, -1] / np.array([len(x) + len(y) for x, y in some])

    return _in_lanes(pairs, kernel, indel_ratio)


def _best_windows(s: list[str], text: list[str]) -> np.ndarray:
    """_best_window of many pairs: prefixes and suffixes by one pass each, inner windows as pairs of their own."""
    m = np.array([len(x) for x in s])
    best = np.zeros(len(s))
    for own, whole in ((s, [t[: len(x)] for x, t in zip(s, text, strict=True)]), ([x[::-1] for x in s], [t[::-1][: len(x)] for x, t in zip(s, text, strict=True)])):
        steps = lcs_steps(own, whole)
        k = np.arange(steps.shape[1])
        ratio = np.where((k > 0) & (k <= m[:, None]), 2 * steps / (m[:, None] + k), 0.0)
        best = np.maximum(best, ratio.max(1))
    inner = [(i, x, t[at : at + len(x)]) for i, (x, t) in enumerate(zip(s, text, strict=True)) if best[i] < 1.0 for at in range(1, len(t) - len(x))]
    for at in range(0, len(inner), LANES):
        own, x, w = zip(*inner[at : at + LANES], strict=True)
        np.maximum.at(best, np.array(own), lcs_steps(list(x), list(w))[:, -1] / np.array([len(y) for y in x]))
    return best


def partial_ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    """partial_ratio of many pairs."""

    def kernel(some: list[tuple[str, str]]) -> np.ndarray:
        out = np.ones(len(some))
        left = [k for k, (x, y) in enumerate(some) if x not in y]
        if left:
            x, y = [some[k][0] for k in left], [some[k][1] for k in left]
            best = _best_windows(x, y)
            same = [k for k in range(len(left)) if len(x[k]) == len(y[k])]
            if same:
                best[same] = np.maximum(best[same], _best_windows([y[k] for k in same], [x[k] for k in same]))
            out[left] = best
        return out

    return _in_lanes(pairs, kernel, partial_ratio)


@F.pandas_udf(T.DoubleType())
def indel(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(indel_ratios([(x or "", y or "") for x, y in zip(a, b, strict=True)]), dtype=float)


@F.pandas_udf(T.DoubleType())
def partial(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(partial_ratios([(x or "", y or "") for x, y in zip(a, b, strict=True)]), dtype=float)


def sorted_words(c: Column) -> Column:
    """Words in order, joined; repeated ones stay."""
    return F.array_join(F.array_sort(F.filter(F.split(c, " "), lambda t: t != "")), " ")


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays of distinct values: two empty ones are equal, an empty and another have nothing in common."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def relational_features(pairs: DataFrame) -> DataFrame:
    """The features that are column expressions. pairs: s1_id, other_id, name1, addr1, country1, name2, addr2, country2."""
    p = pairs.fillna("", ["name1", "addr1", "country1", "name2", "addr2", "country2"])
    n1, n2, a1, a2, c1, c2 = (F.col(x) for x in ("name1", "name2", "addr1", "addr2", "country1", "country2"))
    rare1, rare2 = (F.array_union(rare_tokens(n), rare_tokens(a)) for n, a in ((n1, a1), (n2, a2)))
    first1, first2 = F.array_min(tokens(n1)), F.array_min(tokens(n2))
    return p.withColumns(
        {
            "name_jaccard": set_jaccard(tokens(n1), tokens(n2)),
            "name_len_diff": F.abs(F.length(n1) - F.length(n2)).cast("double"),
            "name_char_bigram_jaccard": set_jaccard(char_bigrams(n1), char_bigrams(n2)),
            "addr_jaccard": set_jaccard(tokens(a1), tokens(a2)),
            "addr_len_diff": F.abs(F.length(a1) - F.length(a2)).cast("double"),
            "country_match": ((c1 != "") & (c2 != "") & (F.lower(c1) == F.lower(c2))).cast("double"),
            "country_either_empty": ((c1 == "") | (c2 == "")).cast("double"),
            "rare_token_overlap": F.size(F.array_intersect(rare1, rare2)).cast("double"),
            "rare_token_union_size": F.size(F.array_union(rare1, rare2)).cast("double"),
            "name_first_token_match": F.coalesce(first1 == first2, F.lit(False)).cast("double"),
        }
    )


def edit_features(pairs: DataFrame) -> DataFrame:
    """The edit-based features, in Arrow batches."""
    p = pairs.fillna("", ["name1", "addr1", "name2", "addr2"])
    n1, n2, a1, a2 = (F.col(x) for x in ("name1", "name2", "addr1", "addr2"))
    return p.withColumns(
        {
            "name_levenshtein_ratio": indel(n1, n2),
            "name_token_sort_ratio": indel(sorted_words(n1), sorted_words(n2)),
            "name_partial_ratio": partial(n1, n2),
            "addr_levenshtein_ratio": indel(a1, a2),
            "addr_token_sort_ratio": indel(sorted_words(a1), sorted_words(a2)),
        }
    )


def feature_frame(pairs: DataFrame) -> DataFrame:
    """s1_id, other_id and the fifteen features in their order."""
    return edit_features(relational_features(pairs)).select("s1_id", "other_id", *FEATURES)
