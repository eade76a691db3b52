import os

import duckdb
import pytest

from kinweave.llm import bpe, fingerprint, jaccard, langid, licenses, mixing, pii, quality, queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_bpe": ("doc_id bigint", "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"),
    "op2_ann": ("query_id bigint", "rank int", "vec_id bigint", "score double"),
    "op3_langid": ("doc_id bigint", "held_out boolean", "lang_pred string", "score double"),
    "op4_license": ("doc_id bigint", "families string"),
    "op5_substrings": ("doc_id bigint", "n_bytes bigint", "n_removed bigint", "n_spans bigint", "kept_sha256 string"),
    "op6_jaccard": ("doc_id bigint", "n_shingles bigint", "component_id bigint"),
    "op7_pii": ("doc_id bigint", "n_email bigint", "n_ip bigint", "n_card bigint", "n_phone bigint", "base_sha256 string", "spans string"),
    "op8_mix": ("doc_id bigint", "size bigint", "source_size bigint", "target double", "taken bigint"),
    "op9_fingerprint": ("doc_id bigint", "n_chars bigint", "edited_sha256 string", "fingerprint string", "edited_fingerprint string", "near_edited double", "near_next double"),
    "pii_counts": ("doc_id bigint", "n_email bigint", "n_ip bigint", "n_card bigint", "n_phone bigint"),
    "mix_targets": ("doc_id bigint", "size bigint", "source_size bigint", "target double"),
    "edit_digests": ("doc_id bigint", "n_chars bigint", "edited_sha256 string"),
    "op10_quality": ("doc_id bigint", "score double", "keep boolean"),
}


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_rows(spark, sql, name):
    df = queries.QUERIES[name](spark, SF)
    assert set(COLUMNS[name]) <= {f"{c} {t}" for c, t in df.dtypes}
    rows = df.count()
    if name == "op2_ann":
        assert rows == 20 * sql.execute("SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0").fetchone()[0]
    else:
        assert rows == sql.execute("SELECT count(*) FROM documents").fetchone()[0]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_like_sql(spark, sql, name):
    df = queries.QUERIES[name](spark, SF)
    found = sql.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(found.fetchall())


def test_large_ids_beside_nulls(docs):
    """Ids that floating-point numbers don't hold come out as they went in, in a batch that has a null id as well."""
    big = (1 << 62) + 1
    table = docs([(None, "Some words of a text.", None, None), (big, "Some words of a text.", None, "a"), (big + 1, None, "en", None), (-big, "The end of it all.", "en", "a")])
    want = sorted([None, big, big + 1, -big], key=str)
    model = langid.fit(table)
    for out in (
        bpe.encode(table, queries.public_tokenizers.path("byte_bpe_50k.json")),
        langid.predict(table, model),
        licenses.scan(table, licenses.train([["some", "plain", "words"]], copies=1, rounds=3)),
        pii.detect(table),
        quality.score(table, quality.fit(table), carry=("lang",)),
        fingerprint.fingerprints(table),
        fingerprint.edit_report(table),
        jaccard.join(table),
        mixing.mix(table),
    ):
        assert sorted((r["doc_id"] for r in out.collect()), key=str) == want
        assert dict(out.dtypes)["doc_id"] == "bigint"
