"""DuckDB SQL with the results of the registered linkage queries."""

from __future__ import annotations

from ..config import LinkConfig
from ..functions.normalize import LEGAL_FORMS, STREET_WORDS

MAX_DF, PREFIX_CAP, MOST = 50, 2_000, 300


def _clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(lower(coalesce({x}, '')), '&', ' and '), '[^\\p{{L}}\\p{{N}}_]', ' ', 'g'), ' +', ' ', 'g'))"


def _apart(x: str) -> str:
    return f"(' ' || replace({x}, ' ', '  ') || ' ')"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, ' +', ' ', 'g'))"


def _address(x: str) -> str:
    out = _apart(x)
    for short, full in STREET_WORDS.items():
        out = f"replace({out}, ' {short} ', ' {full} ')"
    return _squeeze(out)


_FORMS = "|".join(x.replace(" ", "  ") for x in LEGAL_FORMS)
_NAME = f"coalesce(nullif({_squeeze(f"regexp_replace({_apart('n0')}, ' ({_FORMS}) ', ' ', 'g')")}, ''), n0)"

#: Named subqueries, in the order in which they may refer to one another.
PARTS: dict[str, str] = {
    "src1": "SELECT 'S1-' || doc_id AS entity_id, substr(text, 1, 40) AS business_name, substr(text, 41, 60) AS business_address, lang AS country FROM documents",
    "src2": "SELECT 'S2-' || doc_id AS entity_id, substr(text, 1, 40) || ' Ltd' AS business_name, substr(text, 41, 60) AS business_address, lang AS country FROM documents WHERE doc_id % 4 <> 3",
    "src3": "SELECT 'S3-' || doc_id AS entity_id, array_to_string(list_reverse(string_split(substr(text, 1, 40), ' ')), ' ') AS business_name, substr(text, 46, 55) AS business_address, CASE WHEN doc_id % 10 = 0 THEN '' ELSE lang END AS country FROM documents WHERE doc_id % 5 < 2",
    "src": "SELECT * FROM src1 UNION ALL SELECT * FROM src2 UNION ALL SELECT * FROM src3",
    "edges": "SELECT 'S1-' || doc_id AS s1_id, 'S2-' || doc_id AS other_id FROM documents WHERE doc_id % 4 <> 3 UNION ALL SELECT 'S1-' || doc_id, 'S3-' || doc_id FROM documents WHERE doc_id % 5 < 2",
    "universe": "SELECT 'S1-' || doc_id AS s1_id FROM documents",
    "n0": f"SELECT *, {_clean('business_name')} AS n0, {_clean('business_address')} AS a0 FROM src",
    "normed": f"SELECT entity_id, left(entity_id, 2) AS src, country, {_NAME} AS norm_name, {_address('a0')} AS norm_addr FROM n0",
    "tok0": "SELECT entity_id, src, unnest(string_split(norm_name || ' ' || norm_addr, ' ')) AS token FROM normed",
    "tok": "SELECT DISTINCT entity_id, src, token FROM tok0 WHERE token <> ''",
    "post": "SELECT * FROM tok WHERE length(token) >= 4",
    "df": "SELECT src, token, count(*) AS df FROM post GROUP BY ALL",
    "capped": f"SELECT p.* FROM post p JOIN df USING (src, token) WHERE df <= {MAX_DF}",
    "by_token": "SELECT a.entity_id AS s1_id, b.entity_id AS other_id, count(*) AS shared FROM post a JOIN capped b USING (token) WHERE a.src = 'S1' AND b.src <> 'S1' GROUP BY ALL",
    "keys": "SELECT entity_id, src, lower(country) || '|' || substr(norm_name, 1, 4) AS key FROM normed",
    "n_keys": "SELECT src, key, count(*) AS n FROM keys GROUP BY ALL",
    "safe": f"SELECT b.src, b.key FROM n_keys a JOIN n_keys b USING (key) WHERE a.src = 'S1' AND b.src <> 'S1' AND a.n * b.n <= {PREFIX_CAP}",
    "by_prefix": "SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS other_id FROM keys a JOIN safe s ON a.key = s.key JOIN keys b ON b.key = s.key AND b.src = s.src WHERE a.src = 'S1'",
    "merged": "SELECT s1_id, other_id, CAST(sum(shared) AS BIGINT) AS shared FROM (SELECT * FROM by_token UNION ALL SELECT *, 0 FROM by_prefix) GROUP BY ALL",
    "cands": f"SELECT s1_id, other_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY shared DESC, other_id) AS r FROM merged) WHERE r <= {MOST}",
    "pairs": "SELECT s1_id, other_id, a.norm_name AS name1, a.norm_addr AS addr1, a.country AS country1, b.norm_name AS name2, b.norm_addr AS addr2, b.country AS country2 FROM cands LEFT JOIN normed a ON a.entity_id = s1_id LEFT JOIN normed b ON b.entity_id = other_id",
    "sets": "SELECT *, list_distinct(list_filter(string_split(name1, ' '), lambda t: t <> '')) AS tn1, list_distinct(list_filter(string_split(name2, ' '), lambda t: t <> '')) AS tn2, list_distinct(list_filter(string_split(addr1, ' '), lambda t: t <> '')) AS ta1, list_distinct(list_filter(string_split(addr2, ' '), lambda t: t <> '')) AS ta2 FROM pairs",
    "overlap": "SELECT *, len(list_intersect(tn1, tn2)) AS i_n, len(list_intersect(ta1, ta2)) AS i_a FROM sets",
    "jac": "SELECT *, CASE WHEN len(tn1) + len(tn2) = 0 THEN 1e0 ELSE i_n / (len(tn1) + len(tn2) - i_n)::DOUBLE END AS jn, CASE WHEN len(ta1) + len(ta2) = 0 THEN 1e0 ELSE i_a / (len(ta1) + len(ta2) - i_a)::DOUBLE END AS ja FROM overlap",
    "scored": "SELECT s1_id, other_id, round((jn + ja) / 2, 9) AS prob, round(jn, 9) AS second FROM jac",
    "predicted": "SELECT s1_id, other_id FROM scored WHERE prob >= 0.6",
    "labelled": "SELECT c.*, CASE WHEN e.s1_id IS NULL THEN 0 ELSE 1 END AS label FROM cands c LEFT JOIN edges e USING (s1_id, other_id)",
    "degree": "SELECT u.s1_id, count(e.other_id) AS degree FROM universe u LEFT JOIN edges e USING (s1_id) GROUP BY ALL",
    "scores": "SELECT u.s1_id, coalesce(t.n, 0) AS n_true, coalesce(p.n, 0) AS n_pred, coalesce(h.n, 0) AS hits FROM universe u LEFT JOIN (SELECT s1_id, count(*) AS n FROM edges GROUP BY 1) t USING (s1_id) LEFT JOIN (SELECT s1_id, count(*) AS n FROM predicted GROUP BY 1) p USING (s1_id) LEFT JOIN (SELECT s1_id, count(*) AS n FROM predicted JOIN edges USING (s1_id, other_id) GROUP BY 1) h USING (s1_id)",
    "fscores": "SELECT *, CASE WHEN n_true = 0 AND n_pred = 0 THEN 1e0 WHEN hits = 0 THEN 0e0 ELSE 1.25e0 * hits / (0.25e0 * n_true + n_pred) END AS f FROM scores",
    "bad_edges": "SELECT * FROM edges UNION ALL SELECT 'S1-' || (CAST(split_part(s1_id, '-', 2) AS BIGINT) + 1), other_id FROM edges WHERE CAST(split_part(s1_id, '-', 2) AS BIGINT) % 50 = 0 UNION ALL SELECT s1_id || 'x', other_id || 'y' FROM edges WHERE CAST(split_part(s1_id, '-', 2) AS BIGINT) % 100 = 0",
    "own": "SELECT doc_id AS n, list_filter([CASE WHEN doc_id % 4 <> 3 THEN 'S2-' || doc_id END, CASE WHEN doc_id % 5 < 2 THEN 'S3-' || doc_id END], lambda x: x IS NOT NULL) AS ids FROM documents",
    "lists": "SELECT 'S1-' || n AS s1_id, CASE WHEN n % 97 = 1 THEN ids || ['S2-' || n, 'S2-' || n] WHEN n % 97 = 2 THEN ids || ['S1-' || n] WHEN n % 97 = 3 THEN ids || ['X-' || n] WHEN n % 97 = 4 THEN ids || ['S2-' || n || 'z'] ELSE ids END AS ids FROM own WHERE n % 97 <> 5 UNION ALL SELECT 'S1-' || n, ids FROM own WHERE n % 97 = 6 UNION ALL SELECT 'S1-' || n || 'q', ids FROM own WHERE n % 97 = 7",
    "items": "SELECT s1_id, unnest(ids) AS other_id FROM lists",
    "lines": "SELECT doc_id AS line, CASE WHEN doc_id = 0 THEN 'source1_entity_id,matched_entity_ids' WHEN doc_id % 50 = 1 THEN 'S1-' || doc_id WHEN doc_id % 50 = 2 THEN '  ' ELSE 'S1-' || doc_id || chr(9) || 'S2-' || doc_id END AS value FROM documents",
}


def _needs(sql: str) -> list[str]:
    """The parts that a query refers to, directly or not, in order."""
    import re

    needed: set[str] = set()
    queue = [sql]
    while queue:
        words = set(re.findall(r"\b[a-z_0-9]+\b", re.sub(r"'[^']*'", "", queue.pop())))
        for p in PARTS:
            if p in words and p not in needed:
                needed.add(p)
                queue.append(PARTS[p])
    return [p for p in PARTS if p in needed]


def _with(sql: str, more: dict[str, str] | None = None) -> str:
    more = more or {}
    named = [f"{p} AS ({PARTS[p]})" for p in _needs(" ".join([sql, *more.values()]))] + [f"{k} AS ({v})" for k, v in more.items()]
    return f"WITH {', '.join(named)} {sql}" if named else sql


def _finding(bad: str, column: str, rule: str, severity: str = "error") -> str:
    few = f"SELECT DISTINCT CAST({column} AS VARCHAR) AS x FROM ({bad}) ORDER BY x LIMIT 5"
    return f"SELECT '{severity}' AS severity, '{rule}' AS rule, (SELECT count(*) FROM ({bad})) AS n, (SELECT string_agg(x, ',' ORDER BY x) FROM ({few})) AS examples WHERE (SELECT count(*) FROM ({bad})) > 0"


def _tfidf(grams: str) -> str:
    """Top 15 by cosine in each other source. grams: a subquery of entity_id, src, gram, n."""
    parts = {
        "g": grams,
        "n_ref": "SELECT src AS ref, count(DISTINCT entity_id) AS n_ref FROM g WHERE src <> 'S1' GROUP BY 1",
        "idf": "SELECT ref, gram, ln((1e0 + any_value(n_ref)) / (1e0 + count(*))) + 1e0 AS idf FROM g JOIN n_ref ON src = ref GROUP BY ref, gram",
        "raw": "SELECT entity_id, src, ref, gram, (1e0 + ln(n)) * idf AS raw FROM g JOIN idf USING (gram) WHERE src = 'S1' OR src = ref",
        "norms": "SELECT entity_id, ref, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY 1, 2",
        "w": "SELECT entity_id, src, ref, gram, raw / norm AS w FROM raw JOIN norms USING (entity_id, ref)",
        "sims": "SELECT a.entity_id AS s1_id, b.entity_id AS other_id, ref, round(sum(a.w * b.w), 9) AS sim FROM w a JOIN w b USING (gram, ref) WHERE a.src = 'S1' AND b.src = ref GROUP BY ALL",
    }
    return _with("SELECT s1_id, other_id, sim, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, ref ORDER BY sim DESC, other_id) AS r FROM sims WHERE sim > 0) WHERE r <= 15", parts)


_TEXT = "norm_name || ' ' || norm_name || ' ' || norm_addr"
_WORD_GRAMS = (
    "SELECT entity_id, src, gram, count(*) AS n FROM (SELECT entity_id, src, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram "
    f"FROM (SELECT entity_id, src, list_filter(string_split({_TEXT}, ' '), lambda t: length(t) >= 2) AS w FROM normed)) GROUP BY ALL"
)
_CHAR_GRAMS = (
    "SELECT entity_id, src, gram, count(*) AS n FROM (SELECT entity_id, src, unnest(flatten(list_transform([2, 3, 4], lambda k: list_transform(range(1, length(t) - k + 2), lambda i: substr(t, i, k))))) AS gram "
    f"FROM (SELECT entity_id, src, ' ' || t || ' ' AS t FROM (SELECT entity_id, src, unnest(list_filter(string_split({_TEXT}, ' '), lambda t: t <> '')) AS t FROM normed))) GROUP BY ALL"
)


def _bigrams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({x}), 1)), lambda i: substr({x}, i, 2)))"


def _sorted_words(x: str) -> str:
    return f"coalesce(array_to_string(list_sort(list_filter(string_split({x}, ' '), lambda t: t <> '')), ' '), '')"


def _indel(a: str, b: str) -> str:
    """2 LCS / (|a| + |b|): bits of a whole number stand for the places of a, and fall where b makes the subsequence longer."""
    bit = "CASE WHEN substr(a, i + 1, 1) = c THEN (1::HUGEINT << i) ELSE 0::HUGEINT END"
    mask = f"list_reduce(list_transform(range(length(a)), lambda i: {bit}), lambda p, q: p | q, 0::HUGEINT)"
    step = "(((v + (v & m)) | (v - (v & m))) & ((1::HUGEINT << length(a)) - 1))"
    left = f"list_reduce(list_transform(range(length(b)), lambda j: list_extract(list_transform([substr(b, j + 1, 1)], lambda c: {mask}), 1)), lambda v, m: {step}, (1::HUGEINT << length(a)) - 1)"
    return f"(SELECT CASE WHEN a = '' AND b = '' THEN 1e0 WHEN a = '' OR b = '' THEN 0e0 ELSE round(2 * (length(a) - bit_count({left})) / (length(a) + length(b))::DOUBLE, 9) END FROM (SELECT {a} AS a, {b} AS b))"


def _rare(k: int) -> str:
    return f"list_distinct(list_filter(tn{k} || ta{k}, lambda t: length(t) >= 4))"


def _sorted_edges(pairs: str) -> str:
    return f"SELECT u.s1_id, coalesce(string_agg(p.other_id, ',' ORDER BY p.other_id), '') AS ids FROM universe u LEFT JOIN {pairs} p USING (s1_id) GROUP BY 1"


_PROPER = "(starts_with(other_id, 'S2-') OR starts_with(other_id, 'S3-'))"

_DENSE = (
    "WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS ref_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1) "
    "SELECT query_id, ref_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id) AS r FROM s) WHERE r <= 50 AND score > 0.3"
)

SQL: dict[str, str] = {
    "normalize_name": _with("SELECT entity_id, norm_name FROM normed"),
    "normalize_address": _with("SELECT entity_id, norm_addr FROM normed"),
    "source_tokens": _with(f"SELECT entity_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(string_split(norm_name, ' '), lambda t: t <> ''))), ' '), '') AS name_tokens, len({_bigrams('norm_name')}) AS n_bigrams FROM normed"),
    "token_document_frequency": _with("SELECT src, token, df FROM df"),
    "posting_capped": _with("SELECT entity_id, token FROM capped"),
    "block_rare_uncapped": _with("SELECT a.entity_id AS s1_id, b.entity_id AS other_id, count(*) AS shared FROM post a JOIN post b USING (token) WHERE a.src = 'S1' AND b.src <> 'S1' GROUP BY ALL"),
    "block_token_both_caps": _with("SELECT a.entity_id AS s1_id, b.entity_id AS other_id, count(*) AS shared FROM capped a JOIN capped b USING (token) WHERE a.src = 'S1' AND b.src <> 'S1' GROUP BY ALL"),
    "block_token_other_cap": _with("SELECT s1_id, other_id, shared FROM by_token"),
    "block_rare_band": _with(
        "SELECT a.entity_id AS s1_id, b.entity_id AS other_id, count(*) AS shared FROM post a JOIN post b USING (token) JOIN df d ON d.src = b.src AND d.token = b.token "
        f"WHERE a.src = 'S1' AND b.src <> 'S1' AND length(a.token) >= 6 AND d.df > 4 AND d.df <= {MAX_DF} GROUP BY ALL"
    ),
    "block_prefix": _with("SELECT s1_id, other_id FROM by_prefix"),
    "block_union": _with("SELECT s1_id, other_id, shared FROM merged"),
    "cap_ranked": _with("SELECT s1_id, other_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY shared DESC, other_id) AS r FROM merged) WHERE r <= 20"),
    "block_prefix_by_chunk": _with(
        "SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS other_id FROM ck a JOIN safe2 s ON a.key = s.key AND a.chunk_id = s.chunk_id JOIN keys b ON b.key = s.key AND b.src = s.src",
        {
            "ck": "SELECT k.*, CAST((row_number() OVER (ORDER BY entity_id) - 1) // 300 AS BIGINT) AS chunk_id FROM keys k WHERE src = 'S1'",
            "n1": "SELECT key, chunk_id, count(*) AS n FROM ck GROUP BY ALL",
            "safe2": "SELECT b.src, b.key, a.chunk_id FROM n1 a JOIN n_keys b USING (key) WHERE b.src <> 'S1' AND a.n * b.n <= 400",
        },
    ),
    "block_token_by_chunk": _with(
        "SELECT a.entity_id AS s1_id, b.entity_id AS other_id, count(*) AS shared FROM kept1 a JOIN kept2 b USING (token) GROUP BY ALL",
        {
            "slices": "SELECT entity_id, (row_number() OVER (ORDER BY entity_id) - 1) // 300 AS chunk_id FROM src1",
            "p1": "SELECT p.entity_id, token, chunk_id, count(*) OVER (PARTITION BY token, chunk_id) AS n FROM post p JOIN slices USING (entity_id)",
            "kept1": "SELECT * FROM p1 WHERE n <= 20",
            "kept2": "SELECT p.* FROM post p JOIN df USING (src, token) WHERE df <= 20 AND src <> 'S1'",
        },
    ),
    "candidates_tfidf": _with(
        "SELECT s1_id, other_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY shared DESC, other_id) AS r FROM every) WHERE r <= 20",
        {
            "rare": "SELECT a.entity_id AS s1_id, b.entity_id AS other_id, count(*) AS shared FROM post a JOIN post b USING (token) WHERE a.src = 'S1' AND b.src <> 'S1' GROUP BY ALL",
            "every": f"SELECT s1_id, other_id, CAST(sum(shared) AS BIGINT) AS shared FROM (SELECT * FROM rare UNION ALL SELECT s1_id, other_id, 0 FROM ({_tfidf(_WORD_GRAMS)}) UNION ALL SELECT s1_id, other_id, 0 FROM ({_tfidf(_CHAR_GRAMS)})) GROUP BY ALL",
        },
    ),
    "source_files": _with("SELECT entity_id, " + ", ".join(f"regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g') AS {c}" for c in ("business_name", "business_address", "country")) + " FROM src"),
    "source_cache": _with("SELECT entity_id, norm_name, norm_addr FROM normed"),
    "truth_file": _with("SELECT s1_id, other_id FROM edges"),
    "result_file_ids": _with("SELECT s1_id AS id FROM universe"),
    "chunk_slices": _with("SELECT chunk_id, count(*) AS n, min(entity_id) AS first_id FROM (SELECT entity_id, CAST((row_number() OVER (ORDER BY entity_id) - 1) // 300 AS BIGINT) AS chunk_id FROM src1) GROUP BY 1"),
    "pair_frame": _with("SELECT * FROM pairs"),
    "topk_word_tfidf": _tfidf(_WORD_GRAMS),
    "topk_char_tfidf": _tfidf(_CHAR_GRAMS),
    "dense_topk": _DENSE,
    "dense_topk_every_cell": _DENSE,
    "feat_indel_names": _with(f"SELECT s1_id, other_id, {_indel('name1', 'name2')} AS name_levenshtein_ratio, {_indel(_sorted_words('name1'), _sorted_words('name2'))} AS name_token_sort_ratio FROM pairs"),
    "feat_jaccard": _with("SELECT s1_id, other_id, round(jn, 9) AS name_jaccard, round(ja, 9) AS addr_jaccard FROM jac"),
    "feat_bigram": _with(
        "SELECT s1_id, other_id, round(CASE WHEN len(x) + len(y) = 0 THEN 1e0 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y)))::DOUBLE END, 9) AS name_char_bigram_jaccard "
        f"FROM (SELECT s1_id, other_id, {_bigrams('name1')} AS x, {_bigrams('name2')} AS y FROM pairs)"
    ),
    "feat_len": _with("SELECT s1_id, other_id, abs(length(name1) - length(name2))::DOUBLE AS name_len_diff, abs(length(addr1) - length(addr2))::DOUBLE AS addr_len_diff FROM pairs"),
    "feat_country": _with("SELECT s1_id, other_id, CASE WHEN country1 <> '' AND country2 <> '' AND lower(country1) = lower(country2) THEN 1e0 ELSE 0e0 END AS country_match, CASE WHEN country1 = '' OR country2 = '' THEN 1e0 ELSE 0e0 END AS country_either_empty FROM pairs"),
    "feat_rare": _with(f"SELECT s1_id, other_id, len(list_intersect({_rare(1)}, {_rare(2)}))::DOUBLE AS rare_token_overlap, len(list_distinct({_rare(1)} || {_rare(2)}))::DOUBLE AS rare_token_union_size FROM sets"),
    "feat_first_token": _with("SELECT s1_id, other_id, CASE WHEN list_min(tn1) = list_min(tn2) THEN 1e0 ELSE 0e0 END AS name_first_token_match FROM sets"),
    "candidate_recall": _with("SELECT count(*) AS n_true, count(c.s1_id) AS n_kept, round(count(c.s1_id) / count(*)::DOUBLE, 9) AS recall FROM edges e LEFT JOIN cands c USING (s1_id, other_id)"),
    "entity_fbeta": _with("SELECT s1_id, n_true, n_pred, hits, round(f, 9) AS f FROM fscores"),
    "macro_f05": _with("SELECT count(*) AS n_entities, round(avg(f), 9) AS macro_f FROM fscores"),
    "singleton_baseline": _with("SELECT count(*) AS n_entities, round(avg(CASE WHEN degree = 0 THEN 1e0 ELSE 0e0 END), 9) AS macro_f FROM degree"),
    "audit_source_sizes": _with("SELECT left(entity_id, 2) AS src, count(*) AS n FROM src GROUP BY 1"),
    "audit_country": _with("SELECT left(entity_id, 2) AS src, country, count(*) AS n FROM src GROUP BY 1, 2"),
    "audit_missingness": _with(
        "SELECT src, c AS column, n_missing, round(n_missing / total::DOUBLE, 9) AS ratio FROM ("
        + " UNION ALL ".join(f"SELECT left(entity_id, 2) AS src, '{c}' AS c, count(*) AS total, count(*) FILTER (coalesce({c}, '') = '') AS n_missing FROM src GROUP BY 1" for c in ("entity_id", "business_name", "business_address", "country"))
        + ") WHERE n_missing > 0"
    ),
    "audit_degree": _with("SELECT degree, count(*) AS n, round(count(*) / (SELECT count(*) FROM degree)::DOUBLE, 9) AS share FROM degree GROUP BY 1"),
    "audit_singleton_rate": _with("SELECT round(avg(CASE WHEN degree = 0 THEN 1e0 ELSE 0e0 END), 9) AS singleton_rate FROM degree"),
    "audit_source_mix": _with(
        "SELECT count(*) FILTER (a AND NOT b) AS s2_only, count(*) FILTER (b AND NOT a) AS s3_only, count(*) FILTER (a AND b) AS s2_and_s3 FROM (SELECT s1_id, bool_or(starts_with(other_id, 'S2-')) AS a, bool_or(starts_with(other_id, 'S3-')) AS b FROM edges GROUP BY 1)"
    ),
    "audit_multi_owned": _with("SELECT other_id, count(DISTINCT s1_id) AS owners FROM bad_edges GROUP BY 1 HAVING count(DISTINCT s1_id) > 1"),
    "run_summary": _with(
        "SELECT 'entities' AS what, (SELECT count(*) FROM universe) AS n UNION ALL SELECT 'true_pairs', (SELECT count(*) FROM edges) UNION ALL SELECT 'candidates', (SELECT count(*) FROM cands) "
        "UNION ALL SELECT 'positives', (SELECT count(*) FROM cands JOIN edges USING (s1_id, other_id)) UNION ALL SELECT 'predicted_pairs', (SELECT count(*) FROM predicted) UNION ALL SELECT 'predicted_non_singletons', (SELECT count(DISTINCT s1_id) FROM predicted)"
    ),
    "validate_ground_truth": _with(
        " UNION ALL ".join(
            (
                _finding("SELECT DISTINCT s1_id FROM bad_edges WHERE s1_id NOT IN (SELECT entity_id FROM src1)", "s1_id", "truth_of_unknown_s1"),
                _finding("SELECT DISTINCT other_id FROM bad_edges WHERE other_id NOT IN (SELECT entity_id FROM src2 UNION ALL SELECT entity_id FROM src3)", "other_id", "truth_of_unknown_target"),
                _finding("SELECT entity_id AS s1_id FROM src1 WHERE entity_id NOT IN (SELECT s1_id FROM bad_edges)", "s1_id", "s1_without_truth"),
            )
        )
    ),
    "validate_lists": _with(
        " UNION ALL ".join(
            (
                _finding("SELECT s1_id FROM lists GROUP BY 1 HAVING count(*) > 1", "s1_id", "matching:duplicate_entity"),
                _finding("SELECT s1_id FROM lists WHERE len(ids) <> len(list_distinct(ids))", "s1_id", "matching:duplicate_id_in_list"),
                _finding("SELECT s1_id FROM items WHERE starts_with(other_id, 'S1-')", "s1_id", "matching:self_match"),
                _finding(f"SELECT other_id FROM items WHERE NOT {_PROPER} AND NOT starts_with(other_id, 'S1-')", "other_id", "matching:wrong_prefix"),
                _finding("SELECT s1_id FROM universe WHERE s1_id NOT IN (SELECT s1_id FROM lists)", "s1_id", "matching:missing_entity"),
                _finding("SELECT DISTINCT s1_id FROM lists WHERE s1_id NOT IN (SELECT s1_id FROM universe)", "s1_id", "matching:unexpected_entity"),
                _finding(f"SELECT DISTINCT other_id FROM items WHERE {_PROPER} AND other_id NOT IN (SELECT entity_id FROM src2 UNION ALL SELECT entity_id FROM src3)", "other_id", "matching:unknown_id"),
            )
        )
    ),
    "validate_subset": _with(_finding("SELECT DISTINCT s1_id FROM items WHERE (s1_id, other_id) NOT IN (SELECT s1_id, other_id FROM edges)", "s1_id", "match_not_a_candidate", "warning")),
    "validate_format": _with(
        " UNION ALL ".join(
            (
                _finding("SELECT value FROM lines WHERE line = 0 AND value LIKE '%,%' AND NOT contains(value, chr(9))", "value", "format:commas_for_tabs"),
                _finding("SELECT line FROM lines WHERE line > 0 AND trim(value) <> '' AND NOT contains(value, chr(9))", "line", "format:row_without_tab"),
            )
        )
    ),
    "pair_labels": _with("SELECT s1_id, other_id, label FROM labelled"),
    "sample_weights": _with("SELECT s1_id, other_id, round(1e0 / count(*) OVER (PARTITION BY s1_id), 9) AS weight FROM cands"),
    "subsample_negatives": _with(
        "SELECT s1_id, other_id, label FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, label ORDER BY other_id) AS r, sum(label) OVER (PARTITION BY s1_id) AS np FROM labelled) WHERE label = 1 OR r <= greatest(3 * greatest(np, 1), 5)"
    ),
    "sample_sources_by_id": _with(
        "SELECT entity_id FROM few UNION ALL " + " UNION ALL ".join(f"SELECT entity_id FROM src{k} WHERE entity_id IN (SELECT * FROM mine) UNION ALL SELECT entity_id FROM (SELECT entity_id FROM src{k} WHERE entity_id NOT IN (SELECT * FROM mine) ORDER BY 1 LIMIT 150)" for k in (2, 3)),
        {"few": "SELECT entity_id FROM src1 ORDER BY 1 LIMIT 50", "mine": "SELECT other_id FROM edges WHERE s1_id IN (SELECT entity_id FROM few)"},
    ),
    "grouped_folds": _with("SELECT DISTINCT s1_id, CAST(1 AS BIGINT) AS n_folds FROM cands"),
    "threshold_sweep": _with(
        "SELECT round(t, 9) AS t, round(avg(CASE WHEN n_true = 0 AND n_pred = 0 THEN 1e0 WHEN hits = 0 THEN 0e0 ELSE 1.25e0 * hits / (0.25e0 * n_true + n_pred) END), 9) AS macro_f FROM counted GROUP BY t",
        {
            "grid": "SELECT (2 + i) / 40e0 AS t FROM range(37) r(i)",
            "hit": "SELECT s.s1_id, s.prob, CASE WHEN e.s1_id IS NULL THEN 0 ELSE 1 END AS h FROM scored s LEFT JOIN edges e USING (s1_id, other_id)",
            "reached": "SELECT s1_id, t, count(*) AS n_pred, sum(h) AS hits FROM hit JOIN grid ON prob >= t GROUP BY ALL",
            "counted": "SELECT g.t, d.s1_id, d.degree AS n_true, coalesce(a.n_pred, 0) AS n_pred, coalesce(a.hits, 0) AS hits FROM degree d CROSS JOIN grid g LEFT JOIN reached a ON a.s1_id = d.s1_id AND a.t = g.t",
        },
    ),
    "consensus_and": _with("SELECT s1_id, other_id FROM scored WHERE prob >= 0.6 AND second >= 0.7"),
    "consensus_or": _with("SELECT s1_id, other_id FROM scored WHERE prob >= 0.6 OR second >= 0.7"),
    "consensus_weighted": _with("SELECT s1_id, other_id FROM scored WHERE 0.6e0 * second + 0.4e0 * prob >= 0.5e0"),
    "hard_negatives": _with(
        "(SELECT s1_id, other_id, label, prob, 'false_positive' AS kind FROM s WHERE label = 0 AND prob >= 0.5 ORDER BY prob DESC, s1_id, other_id LIMIT 100) UNION ALL "
        "(SELECT s1_id, other_id, label, prob, 'false_negative' AS kind FROM s WHERE label = 1 AND prob < 0.5 ORDER BY prob, s1_id, other_id LIMIT 100)",
        {"s": "SELECT x.s1_id, x.other_id, x.prob, CASE WHEN e.s1_id IS NULL THEN 0 ELSE 1 END AS label FROM scored x LEFT JOIN edges e USING (s1_id, other_id)"},
    ),
    "matching_results": _with(_sorted_edges("predicted")),
    "candidate_pairs": _with(_sorted_edges("cands")),
}

SQL["validate_files"] = f"SELECT * FROM ({SQL['validate_lists']}) UNION ALL SELECT * FROM ({SQL['validate_subset']})"
_DEFAULTS = LinkConfig()
SQL["candidate_recall_defaults"] = SQL["candidate_recall"].replace(f"df <= {MAX_DF}", f"df <= {_DEFAULTS.max_df}").replace(f"a.n * b.n <= {PREFIX_CAP}", f"a.n * b.n <= {_DEFAULTS.max_pairs_per_prefix_key}")
