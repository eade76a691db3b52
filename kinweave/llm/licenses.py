"""License scans: a trained paragraph classifier proposes, templates confirm.

Paragraphs (lines, and runs of lines between blank ones) are described by hashed word 1- to 3-grams. A sparse
multinomial logistic regression assigns licence families; its classes are the families and `unknown`. Families are
trained on their templates and on damaged copies of them, `unknown` on ordinary paragraphs of the corpus (a bounded
sample), on licence-like prose of no family, and on templates whose telling words are taken away. A calibration is
fitted on templates and paragraphs that a first model has never seen in any form, so that the probability of `unknown` is
calibrated; windows that are likely to be ordinary are left out.

The classifier judges every window of every paragraph. A window that it gives to a family is compared with the templates
of all families: of those that are found in it (containment of word grams) and that it doesn't contradict, the most
wholly found one is confirmed; of equal ones the more probable, then the first by name. A window contradicts a family if
it names another licence, a version that the family hasn't, or none where one is needed, or says that something is not licensed so.
A proposal that no template confirms is reported as such.

Nulls and empty texts have no paragraphs. Texts are read whole; long paragraphs are read in windows that overlap, long
and short ones, as a sentence in the middle of a long window is too small a part of it to be told; families are trained
inside short windows too. A text is held with its words. Repeated rows get the same answer; an empty table gives an empty
result. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Carried, bounded_batches

DIM = 1 << 14
#: Documents whose paragraphs train `unknown`, chosen by a hash of id and text; never more than twice as many.
FIT_DOCS = 400
#: Words that are judged together, and words whose hashes a worker keeps.
BATCH_WORDS, KEPT_WORDS = 50_000, 500_000
#: Probability of any family from which a window is proposed. Calibration takes licences to be as frequent as ordinary
#: prose; as they are rarer, more than one half is asked for.
MIN_PROBABILITY = 0.7
MIN_CONTAINMENT = 0.6
#: Words and step of the windows. Those of 40 words overlap by 30, which holds nearly every template, those
#: of 14 by 7, which holds the short ones (SPDX lines are two words).
WINDOWS = ((200, 100), (40, 10), (14, 7))

# Telling phrases of well-known licences.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "License: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "License: MIT",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "License: GPL-3.0",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "License: GPL-2.0",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "License: LGPL-2.1",
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "License: AGPL-3.0",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
        "License: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "License: MPL-2.0",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
        "License: ISC",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC0": (
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
}
# Sentences about licensing that name no family.
NEAR_MISSES = (
    "The driver was asked for a license at the border.",
    "All rights reserved. No part may be reproduced without permission.",
    "You need a license version that is valid to work here.",
    "This license is subject to the terms of the agreement between the parties.",
    "The software is provided to the public under a free trial.",
    "Copyright belongs to the authors of the work.",
    "Licensed under a private agreement, version 5.",
    "Released under the terms of a commercial license.",
)
UNKNOWN = "unknown"


class Identity(NamedTuple):
    """How a family is named: the words of a name (all of one of them), versions, and words of other licences' names."""

    names: tuple[tuple[str, ...], ...]
    versions: tuple[str, ...] = ()
    others: tuple[str, ...] = ()


# Names and versions of the families. Families without versions go with any, or none.
IDENTITIES = {
    "Apache-2.0": Identity((("apache",), ("apache-2.0",)), ("2", "2.0")),
    "MIT": Identity((("mit",),)),
    "GPL-3.0": Identity((("general", "public"), ("gpl-3.0",), ("gpl-3.0-or-later",), ("gpl-3.0-only",)), ("3", "3.0"), ("lesser", "library", "affero")),
    "GPL-2.0": Identity((("general", "public"), ("gpl-2.0",), ("gpl-2.0-or-later",), ("gpl-2.0-only",)), ("2", "2.0"), ("lesser", "library", "affero")),
    "LGPL": Identity((("lesser",), ("library",), ("lgpl-2.1",), ("lgpl-2.1-or-later",), ("lgpl-2.1-only",), ("lgpl-3.0",), ("lgpl-3.0-or-later",), ("lgpl-3.0-only",))),
    "AGPL-3.0": Identity((("affero",), ("agpl-3.0",), ("agpl-3.0-or-later",), ("agpl-3.0-only",)), ("3", "3.0")),
    "BSD": Identity((("bsd",), ("bsd-3-clause",), ("bsd-2-clause",))),
    "MPL-2.0": Identity((("mozilla",), ("mpl-2.0",)), ("2", "2.0")),
    "ISC": Identity((("isc",),)),
    "CC-BY-NC": Identity((("by-nc",), ("attribution-noncommercial",)), (), ("sharealike", "noderivatives", "noderivs", "sa", "nd")),
    "CC-BY-SA": Identity((("by-sa",), ("attribution-sharealike",)), (), ("noncommercial", "noderivatives", "noderivs", "nc", "nd")),
    "CC-BY": Identity((("by", "cc"), ("attribution",)), (), ("noncommercial", "sharealike", "noderivatives", "noderivs", "nc", "sa", "nd")),
    "CC0": Identity((("cc0",), ("cc0-1.0",))),
}
NEGATIONS = frozenset("not never nor neither isn aren wasn longer cannot".split())
GRANTS = frozenset("licensed released distributed available covered published provided".split())
_VERSION = re.compile(r"v?(\d+(?:\.\d+)*)$")
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def words_of(text: str) -> list[str]:
    """Lower-cased words; numbers keep their points, names their hyphens."""
    return _WORD.findall(text.lower())


def grams(words: list[str]) -> list[str]:
    """Word 1- to 3-grams."""
    return [*words, *map(" ".join, zip(words, words[1:], strict=False)), *map(" ".join, zip(words, words[1:], words[2:], strict=False))]


class _Hashes(dict):
    """Hashes of words seen lately."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HELD = _Hashes()


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, with two empty ones behind them."""
    if len(_HELD) > KEPT_WORDS:
        _HELD.clear()
    out = np.zeros(len(words) + 2, np.uint64)
    out[: len(words)] = np.fromiter(map(_HELD.__getitem__, words), np.uint64, len(words))
    return out


def gram_indices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of the 1-, 2- and 3-grams that begin at each word."""
    h = word_hashes(words)
    one = h[:-2] * np.uint64(0x9E3779B97F4A7C15)
    two = one * np.uint64(3) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two * np.uint64(5) + h[2:] * np.uint64(0x165667B19E3779F9)
    return tuple(((x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(50)).astype(np.int32) for x in (one, two, three))


def vector(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed grams with their counts, divided by the root of the number of grams."""
    grams_ = np.concatenate([g[: max(0, len(words) - k)] for k, g in enumerate(gram_indices(words))])
    idx, n = np.unique(grams_, return_counts=True)
    return idx, (n / np.sqrt(max(1, len(grams_)))).astype(np.float32)


def _windows(words: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Place and words of overlapping windows of each length; words that fit the longest are a window of their own."""
    for k, (size, step) in enumerate(WINDOWS):
        if k == 0 or size < len(words):
            yield from ((a, words[a : a + size]) for a in range(0, max(1, len(words) - size + step), step))


def paragraphs(text: str | None) -> Iterator[tuple[int, int, list[str]]]:
    """Number of the first line, place of the first word in the text, and the words of each window of each paragraph, and
    of each line of paragraphs with several."""
    block: list[str] = []
    first = lines = start = 0
    for k, line in enumerate([*(text or "").split("\n"), ""]):
        words = words_of(line)
        if words:
            first = first if block else k
            yield from ((k, start + len(block) + a, w) for a, w in _windows(words))
            block += words
            lines += 1
        else:
            if lines > 1:
                yield from ((first, start + a, w) for a, w in _windows(block))
            start += len(block)
            block, lines = [], 0


_TEMPLATE_WORDS = {family: [words_of(t) for t in ts] for family, ts in TEMPLATES.items()}
_TEMPLATE_GRAMS = {family: [frozenset(grams(t)) for t in ts] for family, ts in _TEMPLATE_WORDS.items()}


def containment(words: list[str], family: str) -> float:
    """Largest share of a template's grams that the paragraph has."""
    found = set(grams(words))
    return max(len(t & found) / len(t) for t in _TEMPLATE_GRAMS[family])


def places(words: list[str], template: frozenset[str]) -> frozenset[int]:
    """Places of the words that the longest grams of a template cover."""
    n = min(3, max(g.count(" ") for g in template) + 1)
    return frozenset(i for a in range(len(words) - n + 1) if " ".join(words[a : a + n]) in template for i in range(a, a + n))


def _named(words: list[str], name: tuple[str, ...]) -> bool:
    return all(w in words for w in name)


def contradicts(words: list[str], covered: frozenset[int], family: str, template: list[str]) -> bool:
    """Whether the words at and near the covered places name another licence or version, or deny the licence."""
    if not covered:
        return True
    low, high = min(covered), max(covered) + 1
    if any(w in GRANTS and NEGATIONS & set(words[max(0, k - 2) : k]) for k, w in enumerate(words) if low - 8 <= k < high):
        return True
    identity = IDENTITIES[family]
    if not any(_named(template, n) for n in identity.names):
        return False  # a text that names no licence
    own = words[low:high]
    names = [n for n in identity.names if _named(own, n)]
    if not names or set(identity.others) & set(words[max(0, low - 2) : high + 2]):
        return True
    if not identity.versions or any(c.isdigit() for n in names for c in "".join(n)):
        return False
    # the first number that follows a word for it, or the licence's name
    at = low + own.index(names[0][0])
    for k in range(at + 1, min(len(words), high + 6)):
        m = _VERSION.match(words[k])
        if m and (words[k][0] == "v" or words[k - 1] in ("version", "v", "license", *names[0])):
            return m.group(1) not in identity.versions
    return True


class Found(NamedTuple):
    """A family that a window is given to; confirmed if `covered`, the places of the template's words, isn't empty."""

    family: str
    probability: float
    containment: float
    covered: frozenset[int]


def compared(words: list[str], probabilities: np.ndarray, classes: list[str]) -> Found:
    """A window that the classifier gives to some family, held against the templates of all families."""
    found = set(grams(words))
    best = Found(classes[int(np.argmax(probabilities[:-1]))], float(probabilities[:-1].max()), 0.0, frozenset())
    best = best._replace(containment=containment(words, best.family))
    ranked = []
    for p, family in zip(probabilities[:-1].tolist(), classes[:-1], strict=True):
        for template, t in zip(_TEMPLATE_WORDS[family], _TEMPLATE_GRAMS[family], strict=True):
            c = len(t & found) / len(t)
            if c >= MIN_CONTAINMENT:
                ranked.append((-c, -p, family, t, template))
    for c, p, family, t, template in sorted(ranked, key=lambda x: x[:3]):
        covered = places(words, t)
        if not contradicts(words, covered, family, template):
            return Found(family, -p, -c, covered)
    return best


class Classifier:
    """Multinomial logistic regression over hashed grams. The last class is `unknown`; how probable any of the others is
    comes from a calibrated line over the margin by which they lead it."""

    def __init__(self, classes: list[str], weights: np.ndarray, bias: np.ndarray, line: tuple[float, float]) -> None:
        self.classes, self.weights, self.bias, self.line = classes, weights, bias, line

    def scores(self, words: list[str]) -> np.ndarray:
        """Of each class, for one paragraph."""
        idx, val = vector(words)
        return (val @ self.weights[idx] + self.bias).astype(np.float64)[None]

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        """Probabilities of each class from rows of scores."""
        known = 1 / (1 + np.exp(-np.clip(self.line[0] * margin(z) + self.line[1], -40, 40)))[:, None]
        return np.hstack((known * _softmax(z[:, :-1]), 1 - known))

    def probabilities(self, words: list[str]) -> np.ndarray:
        """Of each class, for one paragraph."""
        return self.calibrated(self.scores(words))[0]

    def of_windows(self, words: list[str], start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Of each class, for windows of the words: sums over grams as differences of running sums, less the grams that
        reach beyond a window's end."""
        one, two, three = gram_indices(words)
        w = self.weights
        total = np.zeros((len(words) + 1, w.shape[1]))
        np.cumsum(w[one] + w[two] + w[three], axis=0, out=total[1:], dtype=np.float64)
        end = start + length
        z = total[end] - total[start] - w[two[end - 1]] - w[three[end - 1]]
        several = length > 1
        z[several] -= w[three[end[several] - 2]]
        n = length + np.maximum(0, length - 1) + np.maximum(0, length - 2)
        return self.calibrated(z / np.sqrt(n)[:, None] + self.bias)


def margin(z: np.ndarray) -> np.ndarray:
    """By how much the families, taken together, lead `unknown`: the log odds of the plain model."""
    top = z[:, :-1].max(1)
    return top + np.log(np.exp(z[:, :-1] - top[:, None]).sum(1)) - z[:, -1]


def _line(x: np.ndarray, known: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic regression of `known` on x, by Newton's steps; both sides weigh alike."""
    weight = np.where(known, 1 / max(1, known.sum()), 1 / max(1, (~known).sum()))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = weight * (p - known), weight * np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        da, db = np.linalg.solve(hess, [(g * x).sum() + 1e-3 * (a - 1), g.sum() + 1e-3 * b])
        a, b = a - float(np.clip(da, -1, 1)), b - float(np.clip(db, -1, 1))
    return max(a, 0.05), b


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _damaged(words: list[str], filler: list[str], rng: np.random.Generator) -> list[str]:
    """A copy with words dropped here and there and other words around it."""
    kept = [w for w in words if rng.random() > 0.06] or words
    pad = lambda: [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 8))] if filler else []
    return [*pad(), *kept, *pad()]


def _inside(words: list[str], size: int, ordinary: list[list[str]], rng: np.random.Generator) -> list[str]:
    """The words somewhere in a window of running words of `ordinary`."""
    spare = max(0, size - len(words))
    around: list[str] = []
    while ordinary and len(around) < spare:
        around += ordinary[rng.integers(0, len(ordinary))]
    at, cut = int(rng.integers(0, max(0, len(around) - spare) + 1)), int(rng.integers(0, spare + 1))
    around = around[at : at + spare]
    return [*around[:cut], *words, *around[cut:]]


class Example(NamedTuple):
    """Words, their class, and whether they are of a held-out template or paragraph."""

    words: list[str]
    label: int
    held: bool


def _examples(ordinary: list[list[str]], copies: int, seed: int) -> list[Example]:
    """Templates and ordinary prose; of every family one template, with all that is made of it, is marked as held out, and
    so are every third near miss and every fourth ordinary paragraph."""
    rng = np.random.default_rng(seed)
    filler = [w for p in ordinary[:200] for w in p[:20]]
    unknown = len(TEMPLATES)
    out: list[Example] = []
    for c, ts in enumerate(_TEMPLATE_WORDS.values()):
        for k, t in enumerate(ts):
            held = k == (c + 1) % len(ts)
            out.append(Example(t, c, held))
            out += [Example(_damaged(t, filler, rng), c, held) for _ in range(copies)]
            out += [Example(_inside(_damaged(t, [], rng), size, ordinary, rng), c, held) for size, _ in WINDOWS[1:] for _ in range(copies)]
    common = {w for ts in _TEMPLATE_WORDS.values() for t in ts for w in t}
    telling = {w for w in common if sum(any(w in t for t in ts) for ts in _TEMPLATE_WORDS.values()) == 1}
    for c, ts in enumerate(_TEMPLATE_WORDS.values()):
        for k, t in enumerate(ts):
            plain = [w for w in t if w not in telling]
            if plain and len(t) - len(plain) > 1:  # else it is told by the run of its words, and remains a licence
                out += [Example(w, unknown, k == (c + 1) % len(ts)) for w in (plain, *(_inside(plain, size, ordinary, rng) for size, _ in WINDOWS[1:]))]
    for k, t in enumerate(map(words_of, NEAR_MISSES)):
        out += [Example(_damaged(t, filler, rng), unknown, k % 3 == 2) for _ in range(copies)]
        out += [Example(_inside(_damaged(t, [], rng), size, ordinary, rng), unknown, k % 3 == 2) for size, _ in WINDOWS[1:] for _ in range(copies)]
    return out + [Example(p, unknown, k % 4 == 3) for k, p in enumerate(ordinary)]


def _descend(examples: list[Example], n_classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by gradient descent with momentum, over sparse rows; all families weigh alike, and
    `unknown` as much as all of them."""
    rows = [vector(e.words) for e in examples]
    of = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    col, val = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows])[:, None]
    starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    by = np.argsort(col, kind="stable")
    heads = np.flatnonzero(np.concatenate(([True], col[by][1:] != col[by][:-1])))
    used, of_by, val_by = col[by][heads], of[by], val[by]
    place = np.searchsorted(used, col)
    y = np.eye(n_classes, dtype=np.float32)[[e.label for e in examples]]
    weight = (1 / np.maximum(1, y.sum(0)))[y.argmax(1)]
    weight[y[:, -1] > 0] *= n_classes - 1
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    w, step = np.zeros((len(used), n_classes), np.float32), np.zeros((len(used), n_classes), np.float32)
    bias, push = np.zeros(n_classes, np.float32), np.zeros(n_classes, np.float32)
    for _ in range(rounds):
        error = (_softmax(np.add.reduceat(w[place] * val, starts) + bias) - y) * weight
        step = 0.9 * step - 20.0 * (np.add.reduceat(error[of_by] * val_by, heads) + 1e-5 * w)
        push = 0.9 * push - 5.0 * error.sum(0)
        w, bias = w + step, bias + push
    weights = np.zeros((DIM, n_classes), np.float32)
    weights[used] = w
    return weights, bias


def train(ordinary: list[list[str]], copies: int = 12, rounds: int = 250, seed: int = 0) -> Classifier:
    """Fit on the templates and on `ordinary` paragraphs. The calibration comes from a first model and the examples that
    it was not given, whole templates among them; the classifier is then fitted on all."""
    classes = [*TEMPLATES, UNKNOWN]
    examples = [e for e in _examples(ordinary, copies, seed) if e.words]
    first = Classifier(classes, *_descend([e for e in examples if not e.held], len(classes), rounds // 2), (1.0, 0.0))
    x = np.array([margin(first.scores(e.words))[0] for e in examples if e.held])
    line = _line(x, np.array([e.label < len(TEMPLATES) for e in examples if e.held]))
    return Classifier(classes, *_descend(examples, len(classes), rounds), line)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = FIT_DOCS) -> Classifier:
    """Train with paragraphs of about `sample` documents, chosen by a hash of id and text, as ordinary ones.

    Paragraphs that hold most of a template are left out.
    """
    text = F.col(text_col).cast("string")
    place = F.xxhash64(F.col(id_col).cast("string"), text, F.lit("license"))
    given = docs.select(place.alias("place"), text.alias("text"))
    n = given.count()
    share = F.shiftrightunsigned("place", 34) / F.lit(float(1 << 30))
    chosen = given.filter(share < min(1.0, sample / max(1, n))).groupBy("place").agg(F.first("text").alias("text")).orderBy("place").limit(2 * sample)

    def first_paragraphs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, " ".join(p)) for i, t in zip(frame["place"], frame["text"], strict=True) if isinstance(t, str) for p in _spread([w for _, _, w in paragraphs(t)])]
            yield pd.DataFrame(rows, columns=["place", "words"])

    rows = chosen.mapInPandas(first_paragraphs, "place bigint, words string").toPandas().sort_values(["place", "words"])
    ordinary = [w.split(" ") for w in rows["words"]]
    return train([p for p in ordinary if max(containment(p, f) for f in TEMPLATES) < 0.3])


def _spread(found: list[list[str]], most: int = 4) -> list[list[str]]:
    """At most four paragraphs of a document, evenly spread: training examples, not what is scanned."""
    step = max(1, len(found) // most)
    return found[::step][:most]


def _outdone(best: dict[tuple[int, str], tuple[float, float, frozenset[int]]], family: str, c: float, p: float, own: frozenset[int]) -> bool:
    """Whether most of a finding's words belong to a template of another family that is found more wholly: a window that
    ends inside a licence sentence may look like a related family. Of equal ones, the more probable stays, then the first by
    name."""
    return any(f != family and (-more, -q, f) < (-c, -p, family) and 2 * len(own & theirs) > len(own) for (_, f), (more, q, theirs) in best.items())


class _Text:
    """What has been found in a text."""

    def __init__(self) -> None:
        self.best: dict[tuple[int, str], tuple[float, float, frozenset[int]]] = {}

    def add(self, line: int, start: int, found: Found) -> None:
        key, rank = (line, found.family), (bool(found.covered), found.containment, found.probability)
        held = self.best.get(key)
        if held is None or rank > (bool(held[2]), *held[:2]):
            self.best[key] = found.containment, found.probability, frozenset(start + i for i in found.covered)

    def findings(self) -> list[dict]:
        sure = {k: v for k, v in self.best.items() if v[2]}
        return [{"line": at, "family": f, "probability": p, "containment": c, "confirmed": bool(own) and not _outdone(sure, f, c, p, own)} for (at, f), (c, p, own) in sorted(self.best.items())]


class _Batch:
    """Words of several texts, and the segments (lines and blocks of lines) in which windows lie."""

    def __init__(self) -> None:
        self.words: list[str] = []
        self.segments: list[tuple[int, int, int, int]] = []  # first word, words, line, text

    def read(self, number: int, text: str) -> None:
        block = first = lines = 0
        for k, line in enumerate([*text.lower().split("\n"), ""]):
            words = _WORD.findall(line)
            if words:
                if not lines:
                    first, block = k, len(self.words)
                self.segments.append((len(self.words), len(words), k, number))
                self.words += words
                lines += 1
            else:
                if lines > 1:
                    self.segments.append((block, len(self.words) - block, first, number))
                lines = 0

    def judge(self, model: Classifier, found: list[_Text]) -> None:
        """All windows at once; those given to a family go on one by one."""
        if not self.segments:
            return
        segment = np.array(self.segments, np.int64)
        starts, lengths, owners = [], [], []
        for k, (size, step) in enumerate(WINDOWS):
            own = np.arange(len(segment)) if k == 0 else np.flatnonzero(segment[:, 1] > size)
            n = -(-np.maximum(1, segment[own, 1] - size + step) // step)
            at = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * step
            own = np.repeat(own, n)
            starts.append(segment[own, 0] + at)
            lengths.append(np.minimum(size, segment[own, 1] - at))
            owners.append(own)
        start, length, owner = map(np.concatenate, (starts, lengths, owners))
        p = model.of_windows(self.words, start, length)
        for k in np.flatnonzero(p[:, -1] <= 1 - MIN_PROBABILITY).tolist():
            a, (_, _, line, text) = int(start[k]), self.segments[owner[k]]
            found[text].add(line, a, compared(self.words[a : a + int(length[k])], p[k], model.classes))


def scan_texts(texts: list[str | None], model: Classifier) -> list[list[dict]]:
    """Findings of each text."""
    found, batch = [_Text() for _ in texts], _Batch()
    for number, text in enumerate(texts):
        if text:
            batch.read(number, text)
        if len(batch.words) >= BATCH_WORDS:
            batch.judge(model, found)
            batch = _Batch()
    batch.judge(model, found)
    return [x.findings() for x in found]


def scan(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and findings, an array of (line, family, probability, containment, confirmed) over all paragraphs
    that the classifier gives to a family. No shuffle."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # DIM times the number of families

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"c0": frame["c0"], "findings": scan_texts([t if isinstance(t, str) else None for t in frame["text"]], shared.value)})

    through = Carried(docs, (id_col,))
    given = docs.select(*through.given(), F.col(text_col).cast("string").alias("text"))
    out = given.mapInPandas(run, ", ".join([*through.kinds(), "findings array<struct<line:int,family:string,probability:double,containment:double,confirmed:boolean>>"]))
    return out.select(*through.restored(), "findings")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, families (confirmed, sorted, joined by commas), n_confirmed, n_proposed and the largest probability."""
    found = scan(docs, fit(docs, id_col, text_col), id_col, text_col)
    sure = F.filter("findings", lambda x: x["confirmed"])
    return found.select(
        id_col,
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.size(sure).cast("long").alias("n_confirmed"),
        F.size("findings").cast("long").alias("n_proposed"),
        F.coalesce(F.array_max(F.transform("findings", lambda x: x["probability"])), F.lit(0.0)).alias("probability"),
    )
