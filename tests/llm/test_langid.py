import math
import random

import numpy as np
from pyspark.sql import functions as F

from kinweave.llm import langid

WORDS = {"xx": "lorem ipsum dolor sit amet consectetur".split(), "yy": "quick brown foxes jumped over lazy dogs".split(), "zz": "привет мир как дела сегодня".split()}


def corpus():
    rng = random.Random(1)
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 40))), lang, "s") for i in range(300) for lang in [list(WORDS)[i % 3]]]


def test_held_out_accuracy(docs):
    table = docs(corpus())
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    out = langid.predict(table, langid.fit(table, ~held), reject=False).join(table.filter(held).select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in out) >= 0.98 * len(out)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_document_frequencies_count_every_text(docs, monkeypatch):
    table = docs(corpus()).repartition(5)
    whole = langid.fit(table)
    assert np.allclose(langid.fit(table, sample=10).idf, whole.idf, rtol=1e-12)
    monkeypatch.setattr(langid, "HELD_LANGS", 1)
    monkeypatch.setattr(langid, "ADDED", 2)
    assert np.allclose(langid.fit(table, sample=10).idf, whole.idf, rtol=1e-12)
    texts = {lang: [set(langid.gram_counts(t)[0].tolist()) for _, t, own, _ in corpus() if own == lang] for lang in WORDS}
    feature = int(langid.gram_counts("lorem")[0][0])
    share = sum(sum(feature in x for x in own) / len(own) for own in texts.values()) / len(texts)
    assert abs(whole.idf[feature] - math.log1p(1 / (share + 1e-3))) < 1e-9


def test_corner_cases(docs):
    model = langid.fit(docs(corpus()))
    rows = [(1, None, None, None), (2, "", "xx", None), (3, "12 !!", "xx", ""), (4, "lorem ipsum " * 100_000, None, "s"), (5, "漢字仮名交じり文", "xx", "s")]
    out = {r["doc_id"]: r for r in langid.predict(docs(rows), model).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and out[1]["score"] == 0
    assert out[4]["lang_pred"] == "xx" and not out[4]["rejected"]
    assert out[5]["rejected"] and out[5]["lang_pred"] == "und"


def test_nothing_to_learn_from(docs):
    empty = docs([])
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert langid.predict(docs([(1, "some text")]), langid.fit(empty)).first()["lang_pred"] == "und"
    assert langid.fit(docs([(1, "!!", "xx", "s"), (2, None, "yy", "s")])).part(0).langs == []


def test_pieces_count_alike(monkeypatch):
    text = "ab cd " * 500
    whole = langid.gram_counts(text)[1].sum()
    monkeypatch.setattr(langid, "PIECE", 100)
    assert abs(int(langid.gram_counts(text)[1].sum()) - int(whole)) < 0.15 * whole


def test_many_languages(docs, monkeypatch):
    table = docs(corpus() + [(1000 + k, f"only word{k}x here", f"l{k}", "s") for k in range(12)])
    whole = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(table, langid.fit(table), reject=False).collect()}
    monkeypatch.setattr(langid, "PART_LANGS", 4)
    models = langid.fit(table)
    assert models.parts == 4
    for r in langid.predict(table, models, reject=False).collect():
        assert r["lang_pred"] == whole[r["doc_id"]][0] and abs(r["score"] - whole[r["doc_id"]][1]) < 1e-5


def test_one_id_on_every_row(docs):
    # the sample is drawn by id and text, and never exceeds its bound
    rows = [(1, t, lang, s) for _, t, lang, s in corpus()] + [(1, "lorem ipsum", "xx", "s")] * 300 + [(None, t, lang, s) for _, t, lang, s in corpus()]
    table = docs(rows)
    out = langid.predict(table, langid.fit(table, sample=20), reject=False).collect()
    assert len(out) == len(rows) and {r["lang_pred"] for r in out} == {"xx", "yy", "zz"}


def brute(texts, idf, centroids):
    """Cosines of TF-IDF vectors with every centroid, in plain Python."""
    out = []
    for t in texts:
        grams = {}
        x = "".join(c if c.isalpha() else " " for c in t.lower())
        x = " " + " ".join(x.split()) + " " if x.strip() else ""
        for k, c in enumerate(x):
            for n in (1, 2, 3):
                g = x[k : k + n]
                if len(g) == n and g != " ":
                    key = ord(g) if n == 1 else ord(g[0]) << 21 | ord(g[1]) if n == 2 else (ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2])) | 1 << 63
                    f = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 50
                    grams[f] = grams.get(f, 0) + 1
        w = {f: (1 + math.log(n)) * idf[f] for f, n in grams.items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        cos = [(-sum(v * c[f] for f, v in w.items()) / norm, lang) for lang, c in centroids] if norm else []
        out.append((min(cos)[1], -min(cos)[0]) if cos else ("und", 0.0))
    return out


def test_like_brute_force(docs):
    table = docs(corpus()[:60])
    models = langid.fit(table)
    texts = [t for _, t, _, _ in corpus()[60:110]] + ["", "12 3", "Lorem  ipsum-quick привет", "x"]
    want = brute(texts, models.idf, [(r["lang"], r["centroid"]) for r in models.table.collect()])
    got = sorted(langid.predict(docs(list(enumerate(texts))), models, reject=False).collect(), key=lambda r: r["doc_id"])
    for r, (lang, score) in zip(got, want, strict=True):
        assert r["lang_pred"] == lang and abs(r["score"] - max(0.0, min(1.0, score))) < 1e-4
