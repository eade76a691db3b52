import random

import numpy as np

from kinweave.llm import quality

GOOD = "the house of the man is in a small town and it was there with all of us for this year".split()


def good(rng):
    return " ".join(rng.choice(GOOD) for _ in range(rng.randint(20, 200))).capitalize() + "."


def bad(rng, kind):
    words = [rng.choice(GOOD) for _ in range(rng.randint(30, 100))]
    return ["$$$ ".join(words) + "###", "!! ".join(words).upper(), " | ".join(words), " ".join(w for w in words[:8] for _ in range(12))][kind]


def corpus():
    rng = random.Random(3)
    return [(i, bad(rng, i % 4) if i % 10 == 0 else good(rng)) for i in range(800)]


def test_separates(docs):
    table = docs(corpus())
    scorer = quality.fit(table)
    kept = {r["doc_id"]: r["keep"] for r in quality.score(table, scorer).collect()}
    assert sum(kept[i] for i in range(800) if i % 10) >= 0.99 * 720
    assert sum(kept[i] for i in range(0, 800, 10)) <= 0.1 * 80
    assert scorer.accuracies.shape == (2, len(quality.LABELLERS)) and 0 < scorer.prior < 1


def test_em_learns_who_is_right():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.8
    caught = np.array([0.9, 0.6, 0.3])
    votes = np.stack([-(rng.random(20_000) < np.where(good, 0.01, c)).astype(int) for c in caught], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, accuracies, prior = quality.em(patterns, counts.astype(float))
    assert (np.diff(accuracies[0]) < -0.1).all() and (accuracies[1] > 0.97).all() and abs(prior - 0.8) < 0.05
    assert post[(patterns == -1).all(1)][0] < 0.01 < 0.9 < post[(patterns == 0).all(1)][0]


def test_corner_cases(docs):
    scorer = quality.fit(docs(corpus()))
    rows = [(1, None), (2, ""), (3, " \n "), (4, "The house of the man is in a small town and it was there. " * 8000), (5, "The house of the man."), (5, "The house of the man.")]
    out = {r["doc_id"]: r for r in quality.score(docs(rows), scorer, carry=("lang", "n_chars")).collect()}
    assert not any(out[i]["keep"] for i in (1, 2, 3)) and out[1]["score"] == 0
    assert out[5]["lang"] == "en"


def test_empty(docs):
    assert quality.score(docs([]), quality.fit(docs([]))).count() == 0
    assert quality.score(docs([(1, None)]), quality.fit(docs([(1, None)]))).first()["keep"] is False


def test_sample_is_bounded(docs):
    # one id on every row, and one row many times: the sample stays small, and the split right
    rows = [(7 if i % 2 else None, t) for i, t in corpus()] + [(7, "$$$ ### !!! " * 30)] * 500
    scorer = quality.fit(docs(rows), sample=40)
    kept = [r["keep"] for r in quality.score(docs([(k, t) for k, (_, t) in enumerate(corpus())]), scorer).orderBy("doc_id").collect()]
    assert sum(kept[i] for i in range(800) if i % 10) >= 0.9 * 720 and sum(kept[i] for i in range(0, 800, 10)) <= 0.2 * 80


def test_like_plain_python(docs):
    """The whole of fit in one process: votes, EM over their patterns, and a dense logistic regression."""
    rows = corpus()[:300]
    found = [quality.votes(t) for _, t in rows]
    patterns, inverse, counts = np.unique(np.array(found), axis=0, return_inverse=True, return_counts=True)
    post, accuracies, prior = quality.em(patterns, counts.astype(float))
    x = np.zeros((len(rows), quality.DIM))
    for row, (_, t) in zip(x, rows, strict=True):
        idx, val = quality.features(t)
        row[idx] = val
    y = post[inverse.ravel()]
    weight = (y / y.sum() + (1 - y) / (1 - y).sum()) / 2
    w, step = np.zeros(quality.DIM), np.zeros(quality.DIM)
    for _ in range(300):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = 0.9 * step - 4.0 * (x.T @ (weight * (p - y)) + 1e-4 * w)
        w = w + step
    scorer = quality.fit(docs(rows))
    assert abs(scorer.prior - prior) < 1e-3 and np.abs(scorer.accuracies - accuracies).max() < 1e-3
    got = [r["score"] for r in quality.score(docs(rows), scorer).orderBy("doc_id").collect()]
    assert np.abs(np.array(got) - 1 / (1 + np.exp(-(x @ w)))).max() < 0.02
