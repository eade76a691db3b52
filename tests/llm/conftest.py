import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table of (doc_id, text) or (doc_id, text, lang, source) rows, with columns that clash."""

    def make(rows):
        full = [(*r, *("en", "src0")[len(r) - 2 :])[:4] if len(r) < 4 else r for r in rows]
        return spark.createDataFrame([(*r, len(r[1] or ""), "x", 1, 2.0) for r in full], DOCS + ", id string, n int, score double")

    return make
