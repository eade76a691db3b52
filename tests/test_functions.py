import random
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinweave.functions import normalize as N
from kinweave.functions import similarity as S


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("name", "want"),
    [("Pvt. Ltd.", "pvt ltd"), ("Acme & Sons Pvt. Ltd.", "acme and sons"), ("l.l.c Acme", "l l c acme"), ("Co Acme Company", "acme"), ("Foo_Ltd", "foo_ltd"), ("", ""), (None, ""), ("  Café  東京 ", "café 東京"), ("ltd ltd x", "x"), ("private limited co", "private limited co")],
)
def test_names(spark, name, want):
    assert one(spark, N.normalize_name, name) == want


def test_addresses(spark):
    assert one(spark, N.normalize_address, "12, Park St. Apt 3") == "12 park street apartment 3"
    assert one(spark, N.normalize_address, "st st Rd") == "street street road"
    assert one(spark, N.normalize_address, None) == ""


def test_strip_any(spark):
    assert one(spark, N.strip_any, "  x y\t") == "x y"


def test_tokens(spark):
    assert one(spark, N.tokens, "b a b") == ["b", "a"] and one(spark, N.tokens, "") == []
    assert one(spark, N.rare_tokens, "abc abcd 1234 abcd") == ["abcd", "1234"]
    assert one(spark, N.char_bigrams, "aab") == ["aa", "ab"] and one(spark, N.char_bigrams, "a") == [] and one(spark, N.char_bigrams, "") == []


def slow_lcs(a, b):
    @lru_cache(None)
    def f(i, j):
        return 0 if not i or not j else f(i - 1, j - 1) + 1 if a[i - 1] == b[j - 1] else max(f(i - 1, j), f(i, j - 1))

    return f(len(a), len(b))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc é", max_size=12), st.text(alphabet="abc é", max_size=12))
def test_lcs(a, b):
    assert S.lcs_length(a, b) == slow_lcs(a, b)
    assert 0 <= S.indel_ratio(a, b) <= 1 and S.indel_ratio(a, b) == S.indel_ratio(b, a)


def slow_partial(a, b):
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    if not s:
        return float(not t)

    def windows(s, t):
        m = len(s)
        return [t[:k] for k in range(1, m + 1)] + [t[k : k + m] for k in range(len(t) - m + 1)] + [t[len(t) - k :] for k in range(1, m + 1)]

    best = max(2 * slow_lcs(s, w) / (len(s) + len(w)) for w in windows(s, t))
    return max(best, max(2 * slow_lcs(t, w) / (len(t) + len(w)) for w in windows(t, s))) if len(s) == len(t) else best


def test_partial_ratio():
    rng = random.Random(3)
    for _ in range(600):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert S.partial_ratio(a, b) == pytest.approx(slow_partial(a, b))
    assert S.indel_ratio("kitten", "sitting") == pytest.approx(8 / 13) and S.indel_ratio("", "") == 1


def test_batches_like_single_pairs():
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcde é😀\0") for _ in range(n))
    pairs = [(text(rng.choice([0, 1, 5, 20, 63, 64, 65, 90])), text(rng.choice([0, 1, 7, 22, 64, 100, 150]))) for _ in range(700)]
    pairs += [(a, a) for a, _ in pairs[:30]] + [(a, "x" + a + "y") for a, _ in pairs[:30]] + [(b, a) for a, b in pairs[:50]]
    assert S.indel_ratios(pairs).tolist() == [S.indel_ratio(a, b) for a, b in pairs]
    assert S.partial_ratios(pairs).tolist() == [S.partial_ratio(a, b) for a, b in pairs]
    assert S.indel_ratios([]).tolist() == [] and S.partial_ratios([("", "")]).tolist() == [1.0]


PAIR = "s1_id string, other_id string, name1 string, addr1 string, country1 string, name2 string, addr2 string, country2 string"


def test_feature_frame(spark):
    rows = [
        ("S1-1", "S2-1", "b a", "x road", "US", "a c", "x road", "us"),
        ("S1-1", "S2-2", "", "", "", "", "", ""),
        ("S1-1", "S3-9", "acme", None, "us", None, None, None),
    ]
    got = {r["other_id"]: r for r in S.feature_frame(spark.createDataFrame(rows, PAIR)).collect()}
    a, b, c = got["S2-1"], got["S2-2"], got["S3-9"]
    assert list(a.asDict()) == ["s1_id", "other_id", *S.FEATURES]
    assert a["name_first_token_match"] == 1 and a["country_match"] == 1 and a["name_jaccard"] == pytest.approx(1 / 3) and a["addr_jaccard"] == 1
    assert a["rare_token_overlap"] == 1 and a["rare_token_union_size"] == 1
    assert b["name_jaccard"] == 1 and b["name_levenshtein_ratio"] == 1 and b["country_either_empty"] == 1 and b["name_first_token_match"] == 0
    assert c["name_jaccard"] == 0 and c["name_len_diff"] == 4 and c["addr_jaccard"] == 1
