"""Quality classifier trained on weak labels.

1. Overlapping heuristic labellers vote good, bad or abstain on every text.
2. Expectation-maximisation over the counts of all vote patterns estimates each labeller's accuracy on good and on
   bad texts and the share of good texts. The driver holds the distinct patterns only (3 to the power of LABELLERS
   at most), which cover all documents.
3. Posterior labels of a bounded sample (FIT_ROWS rows, chosen by a hash of id and text; equal rows count once) train a
   linear scorer over hashed features, by logistic regression.
4. The scorer is applied to every text. Texts that score below the threshold are rejected.

Nulls and texts without a word get score 0 and are rejected, as there is nothing to keep; so are null ids treated like
any others. Texts are read whole. Repeated rows get the same score, and so do equal texts; a score at the threshold is
kept. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Carried, bounded_batches, discard, materialize

DIM = 1 << 12
#: Rows that train the scorer, half of each side; the hash gives about so many, and never more.
FIT_ROWS = 6000
THRESHOLD = 0.35
ANCHOR = 0.1

# Frequent function words of the languages served.
FUNCTION_WORDS = frozenset(
    "the of and to in is that it for was on with as be by at this are from or an a not "
    "de la le les et des en un une du que est pour dans par sur au "
    "der die das und zu den von mit ist nicht ein eine auf dem sich "
    "el los las y del se por con una su para al es lo".split()
)

LOWER, UPPER, DIGIT, SPACE, LINE, STOP, PIPE, SYMBOL, BANG, QUOTE, HIGH = range(11)


@functools.cache
def byte_classes() -> np.ndarray:
    """A class for each byte: letters by case, digits, white space, and kinds of punctuation."""
    table = np.full(256, SYMBOL, np.uint8)
    for cls, chars in ((LOWER, "abcdefghijklmnopqrstuvwxyz"), (UPPER, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (DIGIT, "0123456789"), (SPACE, " \t\r\f\v"), (LINE, "\n"), (STOP, ".,;:?-()"), (PIPE, "|"), (BANG, "!"), (QUOTE, "'\"`")):
        for c in chars:
            table[ord(c)] = cls
    table[128:] = HIGH
    return table


class Facts:
    """What the labellers look at, gathered in one pass."""

    def __init__(self, text: str) -> None:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        self.classes = byte_classes()[data]
        n = np.bincount(self.classes, minlength=11)
        self.size = max(1, len(data) - int(n[SPACE] + n[LINE]))
        letters = max(1, int(n[LOWER] + n[UPPER] + n[HIGH]))
        self.symbols = int(n[SYMBOL] + n[PIPE] + n[BANG]) / self.size
        self.upper = int(n[UPPER]) / letters
        self.letters = int(n[LOWER] + n[UPPER] + n[HIGH]) / self.size
        words = text.split()
        self.n_words = len(words)
        self.mean_word = self.size / max(1, self.n_words)
        self.function = sum(map(FUNCTION_WORDS.__contains__, words)) / max(1, self.n_words)
        lines = [x for x in text.split("\n") if x.strip()]
        self.repeated = 1 - len(set(lines)) / len(lines) if lines else 0.0
        self.bare = sum(1 for x in words if not any(map(str.isalnum, x))) / max(1, self.n_words)
        self.distinct = len(set(words)) / max(1, self.n_words)
        same = np.fromiter(map(str.__eq__, words, words[1:]), bool, max(0, self.n_words - 1))
        self.stutter = float(same.sum()) / max(1, self.n_words)
        self.run = 1 + int(np.diff(np.flatnonzero(np.concatenate(([True], ~same, [True])))).max(initial=1)) - 1
        self.dominant = Counter(words).most_common(1)[0][1] / self.n_words if words else 0.0
        self.sentences = sum(1 for x in words if x[-1] in ".?!:;") / max(1, self.n_words)


def _band(value: float, good: bool, bad: bool) -> int:
    return 1 if good else -1 if bad else 0


# Each votes 1 (good), -1 (bad) or 0 (abstains). Several only ever object, so abstaining counts as an outcome too.
# Shares of few words say little, so some abstain on short texts. Variety abstains on long ones too: the share of distinct
# words falls with the length of any text, so that its bounds hold between 30 and 3000 words only.
LABELLERS = {
    "symbols": lambda f: _band(f.symbols, False, f.symbols > 0.08),
    "upper": lambda f: _band(f.upper, False, f.upper > 0.3) if f.n_words >= 5 else 0,
    "letters": lambda f: _band(f.letters, False, f.letters < 0.6) if f.n_words >= 20 else 0,
    "word_length": lambda f: _band(f.mean_word, False, f.mean_word > 14),
    "function_words": lambda f: _band(f.function, f.function > 0.12, f.function < 0.01) if f.n_words >= 40 else 0,
    "bare_tokens": lambda f: _band(f.bare, False, f.bare > 0.15),
    "repeated_lines": lambda f: _band(f.repeated, False, f.repeated > 0.5),
    "stutter": lambda f: _band(f.stutter, False, f.stutter > 0.2) if f.n_words >= 10 else 0,
    "runs": lambda f: _band(f.run, False, f.run >= 5),
    "variety": lambda f: _band(f.distinct, f.distinct > 0.4, f.distinct < 0.2) if 30 <= f.n_words <= 3000 else 0,
    "dominant_word": lambda f: _band(f.dominant, False, f.dominant > 0.3) if f.n_words >= 10 else 0,
}


def votes(text: str | None) -> list[int] | None:
    """The labellers' votes; None where there is no word to judge."""
    if not text or not text.strip():
        return None
    facts = Facts(text)
    return [v(facts) for v in LABELLERS.values()]


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each vote pattern, the labellers' accuracies and the share of good.

    An accuracy is the share of bad texts to which a labeller objects, and of good ones to which it doesn't.

    Labellers vote independently within a class; each has its own rates of voting bad, abstaining and voting good in
    each class. A prior worth ANCHOR of all texts holds that objections are rare among good texts and common among bad
    ones; it fixes which class is which, and keeps EM from explaining some other split, such as short and long texts.
    """
    weight = counts / counts.sum()
    post = np.where((patterns < 0).any(1), 0.1, 0.9)
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)  # pattern, labeller, vote
    votes_both = (patterns > 0).any(0)
    prior, rates = 0.5, np.zeros((2, patterns.shape[1], 3))
    for _ in range(rounds):
        old = post
        for c, p in ((0, 1 - post), (1, post)):
            mass = ((weight * p) @ onehot.reshape(len(patterns), -1)).reshape(-1, 3)
            expected = np.array([[0.4, 0.5, 0.1], [0.002, 0.6, 0.398]][c])
            expected = np.where(votes_both[:, None], expected, expected * [1, 1, 0] / expected[:2].sum())
            rates[c] = (mass + ANCHOR * expected + 1e-6) / (mass.sum(1, keepdims=True) + ANCHOR + 3e-6)
        prior = float(np.clip(weight @ post, 1e-3, 1 - 1e-3))
        log = np.einsum("pkv,ckv->pc", onehot, np.log(rates))
        odds = log[:, 1] + np.log(prior) - log[:, 0] - np.log(1 - prior)
        post = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        if np.abs(post - old).max() < 1e-9:
            break
    return post, np.stack([rates[0, :, 0], 1 - rates[1, :, 0]]), prior


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: trigrams of byte classes with runs collapsed, class shares in steps, function words."""
    if not text or not text.strip():
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    f = Facts(text)
    c = f.classes.astype(np.int64)
    c = c[np.concatenate(([True], c[1:] != c[:-1]))]
    c = np.concatenate(([LINE], c, [LINE]))
    grams = np.bincount((c[:-2] * 121 + c[1:-1] * 11 + c[2:]) * 2654435761 % (1 << 32) >> 21, minlength=2048).astype(np.float64)
    share = np.sqrt(grams / grams.sum())
    steps = [(f.symbols, 0.01), (f.upper, 0.03), (f.letters, 0.02), (f.mean_word, 0.5), (f.function, 0.03), (f.bare, 0.02), (f.repeated, 0.1), (f.sentences, 0.03), (f.stutter, 0.05), (f.run, 1.0), (f.dominant, 0.04), (f.distinct, 0.05)]
    flags = sorted({2048 + (k * 7919 + min(63, int(v / s)) * 104729) % 2047 for k, (v, s) in enumerate(steps)})
    at = np.flatnonzero(share)
    idx = np.concatenate((at, flags, [DIM - 1])).astype(np.int32)
    return idx, np.concatenate((share[at], np.full(len(flags), 0.3), [1.0])).astype(np.float32)


def fit_linear(idx: list[np.ndarray], val: list[np.ndarray], target: np.ndarray, rounds: int = 300, l2: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels: full gradient steps with momentum, both classes weighing alike."""
    x = np.zeros((len(idx), DIM), np.float32)
    for row, i, v in zip(x, idx, val, strict=True):
        row[i] = v
    good = max(float(target.sum()), 1e-6)
    bad = max(float((1 - target).sum()), 1e-6)
    weight = (target / good + (1 - target) / bad) / 2
    w, step = np.zeros(DIM, np.float32), np.zeros(DIM, np.float32)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = 0.9 * step - 4.0 * (x.T @ (weight * (p - target)).astype(np.float32) + l2 * w)
        w = w + step
    return w


class Scorer:
    """Linear weights over hashed features, and what EM has found."""

    def __init__(self, weights: np.ndarray, accuracies: np.ndarray, prior: float) -> None:
        self.weights, self.accuracies, self.prior = weights, accuracies, prior

    def score(self, text: str | None) -> float:
        idx, val = features(text)
        return float(1 / (1 + np.exp(-np.clip(self.weights[idx] @ val, -30, 30)))) if len(idx) else 0.0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = FIT_ROWS) -> Scorer:
    """Learn from the texts alone; no given label is used."""
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.col(text_col).cast("string")
    place = F.xxhash64(F.col(id_col).cast("string"), text, F.lit("quality"))
    given = docs.select(place.alias("place"), text.alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [votes(t if isinstance(t, str) else None) for t in frame["text"]]
            keep = [k for k, v in enumerate(found) if v is not None]
            if keep:
                yield pd.DataFrame({"place": frame["place"].iloc[keep], "votes": ["".join("-0+"[x + 1] for x in found[k]) for k in keep]})

    voted = materialize(given.mapInPandas(run, "place bigint, votes string"), "quality-votes")
    seen = voted.groupBy("votes").count().orderBy("votes").collect()
    if not seen:
        discard(voted)
        return Scorer(np.zeros(DIM, np.float32), np.zeros((2, len(LABELLERS))), 0.5)
    patterns = np.array([["-0+".index(c) - 1 for c in r["votes"]] for r in seen])
    counts = np.array([r["count"] for r in seen], float)
    post, accuracies, prior = em(patterns, counts)

    # both classes get up to half of the sample, by the posterior's side; equal rows share a place and count once
    sides = {g: float(sum(c for c, p in zip(counts, post, strict=True) if (p >= 0.5) == g)) for g in (True, False)}
    rows = [(r["votes"], float(p), bool(p >= 0.5), min(1.0, sample / 2 / max(1.0, sides[p >= 0.5]))) for r, p in zip(seen, post, strict=True)]
    table = spark.createDataFrame(rows, "votes string, target double, side boolean, rate double")
    share = F.shiftrightunsigned("place", 34) / F.lit(float(1 << 30))
    some = voted.join(F.broadcast(table), "votes").filter(share < F.col("rate")).select("place", "target", "side").distinct()
    first = Window.partitionBy("side").orderBy(F.shiftrightunsigned("place", 34), "place")
    some = some.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= sample // 2 + sample // 8)
    chosen = materialize(some.select("place", "target"), "quality-sample")

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [features(t if isinstance(t, str) else None) for t in frame["text"]]
            yield pd.DataFrame({"place": frame["place"], "target": frame["target"], "idx": [x[0] for x in found], "val": [x[1] for x in found]})

    # the chosen places number about `sample` whatever the input's size; of equal rows one goes on
    texts = given.join(F.broadcast(chosen), "place").groupBy("place").agg(F.first("target").alias("target"), F.first("text").alias("text"))
    training = texts.mapInPandas(vectors, "place bigint, target double, idx array<int>, val array<float>").toPandas().sort_values("place")
    discard(voted)
    discard(chosen)
    weights = fit_linear([np.asarray(x) for x in training["idx"]], [np.asarray(x) for x in training["val"]], training["target"].to_numpy(float))
    return Scorer(weights, accuracies, prior)


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, `carry`, score (0 to 1) and keep (score at the threshold or above). No shuffle."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(scorer)  # DIM weights
    through = Carried(docs, (id_col, *carry))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame[through.names].copy()
            out["score"] = [shared.value.score(t if isinstance(t, str) else None) for t in frame["given"]]
            out["keep"] = out["score"] >= threshold
            yield out

    given = docs.select(*through.given(), F.col(f"`{text_col}`").cast("string").alias("given"))
    scored = given.mapInPandas(run, ", ".join([*through.kinds(), "score double", "keep boolean"]))
    return scored.select(*through.restored(), "score", "keep")
