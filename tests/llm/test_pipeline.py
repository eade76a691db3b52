import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from kinweave.llm import jaccard, mixing, pii, quality  # noqa: E402
from kinweave.llm.bpe import ByteBPE  # noqa: E402


@pytest.fixture
def folder(docs, tmp_path):
    rng = random.Random(6)
    words = "the house of the man is in a small town and it was there with all of us for this year".split()
    rows = []
    for i in range(240):
        text = " ".join(rng.choice(words) + rng.choice(["", "s", "x", "ed"]) for _ in range(rng.randint(30, 120)))
        if i % 12 == 5:
            text = "$$$ ".join(text.split()).upper() + "###"
        if i % 10 == 7:
            text += " write to a.b@mail.example.com"
        rows.append((i, text, "en", f"s{i % 4}"))
    rows += [(1000 + i, rows[i][1] + " again", "en", "s1") for i in range(20)] + [(2000, None, None, None), (2001, "", "en", None)]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), rows


def first_of_near_copies(texts):
    """Ids that remain if one document of each class of near copies stays, by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    label = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if v == old else v for k, v in label.items()}
    return set(label.values())


def targets(sizes):
    """Targets of sources by plain rounds. sizes: (source, words)."""
    total = {}
    for source, n in sizes:
        total[source] = total.get(source, 0) + n
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    out, left, open_ = {}, 1.5 * sum(total.values()), set(total)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > 2 * total[s]}
        for s in full or open_:
            out[s] = 2 * total[s] if full else unit * weight[s]
        left -= sum(out[s] for s in full)
        open_ = open_ - full if full else set()
    return out


def test_stages_like_their_operators(spark, folder):
    path, rows = folder
    now = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, path)
        after.write.parquet(f"{path}/{len(seen)}")
        after = spark.read.parquet(f"{path}/{len(seen)}")
        seen.append((now, after))
        now = after
    good, unique, clean, mixed, tokens = (b for _, b in seen)
    for df in (good, unique, clean, mixed):
        assert df.columns == list(corpus_pipeline.COLUMNS)
    source = seen[0][0]
    kept = {r["doc_id"] for r in quality.score(source, quality.fit(source)).collect() if r["keep"]}
    assert {r["doc_id"] for r in good.collect()} == kept
    assert not any(i % 12 == 5 for i in kept if i < 1000) and sum(i < 1000 for i in kept) >= 215
    classes = {r["doc_id"]: r["component_id"] for r in jaccard.join(good, 5, 80, 100).collect()}
    assert {r["doc_id"] for r in unique.collect()} == {i for i, c in classes.items() if i == c}
    assert {r["doc_id"] for r in unique.collect()} == first_of_near_copies({r["doc_id"]: r["text"] for r in good.collect()})
    before = {r["doc_id"]: r["text"] for r in unique.collect()}
    for r in clean.collect():
        assert r["text"] == pii.redact(before[r["doc_id"]], pii.scan(before[r["doc_id"]])) and r["n_chars"] == len(r["text"]) and "@mail" not in r["text"]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect()}
    count = {}
    for r in mixed.collect():
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    assert count == {i: c for i, c in copies.items() if c}
    size = {r["doc_id"]: (r["source"], len(r["text"].split())) for r in clean.collect()}
    for source, target in targets(size.values()).items():
        assert abs(sum(c * size[i][1] for i, c in count.items() if size[i][0] == source) - target) <= 0.01 * target
    encoder = ByteBPE(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    text = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert tokens.count() == sum(count.values())
    for r in tokens.collect():
        assert r["ids"] == encoder.encode_batch([text[r["doc_id"]]])[0].tolist() and encoder.decode(encoder.encode_batch([text[r["doc_id"]]])[0]) == text[r["doc_id"]]


def test_rows_under_one_id(spark, docs):
    rng = random.Random(7)
    words = [f"{a}{b}" for a in "bcdfghklm" for b in ("an", "el", "ir", "os")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long, short = text(90), text(40)
    rows = [(i, text(50), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, long, "en", "s1")] * 3 + [(100, long + " more", "en", "s2"), (100, short, "en", "s1"), (200, long, "en", "s1")]
    left = corpus_pipeline.dedup_stage(spark, docs(rows), "").collect()
    assert sorted(r["doc_id"] for r in left) == [*range(60), 100, 100]
    texts = {r["text"] for r in left if r["doc_id"] == 100}
    assert short in texts and texts <= {short, long, long + " more"}
    # every row is taken as often as the mix says, at most twice, also where ids are shared
    many = docs([(i % 20, f"w{i} " * (1 + 7 * i % 50), "en", f"s{i % 6}") for i in range(240)] + [(3, " ", "en", "s3")])
    mixed = [tuple(r) for r in corpus_pipeline.mix_stage(spark, many, "").collect()]
    assert max(mixed.count(r) for r in mixed) <= 2 and not any(r[1] == " " for r in mixed)
    assert len(mixed) == sum(r["copies"] for r in mixing.mix(many).collect())


def test_run_and_empty_input(spark, folder, docs, tmp_path):
    assert corpus_pipeline.run(spark, folder[0]).count() > 0
    docs([]).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
