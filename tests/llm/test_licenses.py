import numpy as np

from kinweave.llm import licenses


def test_families(docs):
    filler = [(i, f"an ordinary paragraph number {i} about towns and rivers\nwith another line of words {i * 7}") for i in range(60)]
    texts = {
        100: "some text\nLicensed under the Apache License, Version 2.0.\nmore text",
        101: "Released under the MIT License.",
        102: "words before. This work is licensed under the GNU General Public License, version 3. words after",
        103: "Licensed under CC BY-NC 4.0.",
        104: "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and\nassociated documentation files",
        105: "The driver asked for a license at the border.",
        106: None,
        107: "",
        108: "plain words " * 30_000 + "\nReleased under the MIT License.\n" + "plain words " * 30_000,
    }
    rows = filler + list(texts.items()) + [(101, texts[101])]
    out = {r["doc_id"]: r for r in licenses.report(docs(rows)).collect()}
    assert {i: out[i]["families"] for i in texts} == {100: "Apache-2.0", 101: "MIT", 102: "GPL-3.0", 103: "CC-BY-NC", 104: "MIT", 105: "", 106: "", 107: "", 108: "MIT"}
    assert not any(out[i]["families"] for i, _ in filler)


def test_probabilities_sum_to_one():
    model = licenses.train([["plain", "words", str(i)] for i in range(50)])
    p = model.probabilities(licenses.words_of("Released under the MIT License."))
    assert abs(p.sum() - 1) < 1e-5 and model.classes[p.argmax()] == "MIT"


def test_sentences_inside_long_lines(docs):
    filler = [(i, f"an ordinary paragraph number {i} about towns and rivers\nwith another line of words {i * 7}") for i in range(60)]
    words = "people walk along the river to a small town where many houses are old and children play with their dogs".split()
    around = [words[(i * i + 3 * i) % len(words)] for i in range(200)]
    longest = {f: max(ts, key=len) for f, ts in licenses.TEMPLATES.items()}
    shortest = {f: min(ts, key=lambda t: len(licenses.words_of(t))) for f, ts in licenses.TEMPLATES.items()}
    rows, expected = list(filler), {}
    for k, (family, sentence) in enumerate([*longest.items(), *shortest.items()]):
        at = 60 + 5 * k % 80
        expected[100 + k] = family
        rows.append((100 + k, " ".join([*around[:at], sentence, *around[at:]])))
        wrapped = rows[-1][1].split(" ")
        expected[200 + k] = family
        rows.append((200 + k, "\n".join(" ".join(wrapped[a : a + 9]) for a in range(0, len(wrapped), 9))))
    expected[300] = "Apache-2.0,MIT"
    rows.append((300, " ".join([*around, *(t[0] for f, t in licenses.TEMPLATES.items() if f in ("Apache-2.0", "MIT")), *around])))
    out = {r["doc_id"]: r["families"] for r in licenses.report(docs(rows)).collect()}
    assert {i: out[i] for i in expected} == expected
    assert not any(out[i] for i, _ in filler)


def test_empty(docs):
    assert licenses.report(docs([])).count() == 0


FSF = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
CASES = {
    FSF.format("Affero General Public License", 3): "AGPL-3.0",
    FSF.format("General Public License", 3): "GPL-3.0",
    FSF.format("General Public License", 2): "GPL-2.0",
    FSF.format("Lesser General Public License", "2.1"): "LGPL",
    "This work is licensed under the GNU General Public License, version 1.": "",
    "This work is licensed under the GNU General Public License.": "",
    "Licensed under the Mozilla Public License, version 1.1.": "",
    "Licensed under the Mozilla Public License, version 2.0.": "MPL-2.0",
    "Licensed under the Apache License, Version 1.1.": "",
    "Licensed under CC BY-ND 4.0.": "",
    "Licensed under CC BY-NC-SA 4.0.": "",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": "",
    "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.": "",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY",
    "This file is not licensed under the MIT License.": "",
    "The code is not released under the BSD 3-Clause License.": "",
    "It is no longer distributed under the terms of the MIT license.": "",
    "License: MIT": "MIT",
    "SPDX-License-Identifier: AGPL-3.0-only": "AGPL-3.0",
    "Released under the MIT License.": "MIT",
}


def test_names_versions_and_denials(docs):
    filler = [(i, f"an ordinary paragraph number {i} about towns and rivers\nwith another line of words {i * 7}") for i in range(120)]
    out = {r["doc_id"]: r["families"] for r in licenses.report(docs(filler + [(1000 + k, t) for k, t in enumerate(CASES)])).collect()}
    assert {t: out[1000 + k] for k, t in enumerate(CASES)} == CASES


def by_hand(text, model):
    """Findings by plain loops: every window of every line and block, its grams counted one by one."""
    best = {}
    for line, start, words in licenses.paragraphs(text):
        grams = [words[k : k + n] for n in (1, 2, 3) for k in range(len(words) - n + 1)]
        z = model.bias.astype(float).copy()
        for g in grams:
            z += model.weights[licenses.gram_indices(g)[len(g) - 1][0]] / len(grams) ** 0.5
        known = np.exp(z[:-1] - z[:-1].max())
        odds = model.line[0] * (np.log(known.sum()) + z[:-1].max() - z[-1]) + model.line[1]
        p = 1 / (1 + np.exp(-odds))
        if p < licenses.MIN_PROBABILITY:
            continue
        found = licenses.compared(words, np.array([*(p * known / known.sum()), 1 - p]), model.classes)
        rank = (bool(found.covered), found.containment, found.probability)
        if (line, found.family) not in best or rank > best[line, found.family][0]:
            best[line, found.family] = rank, {start + k for k in found.covered}
    out = []
    for (line, family), ((sure, c, p), own) in sorted(best.items()):
        better = [f for (_, f), ((s, d, q), theirs) in best.items() if s and f != family and (-d, -q, f) < (-c, -p, family) and 2 * len(own & theirs) > len(own)]
        out.append((line, family, round(p, 4), round(c, 6), sure and not better))
    return out


def test_like_plain_loops(monkeypatch):
    monkeypatch.setattr(licenses, "BATCH_WORDS", 60)
    rng = np.random.default_rng(3)
    words = "people walk along the river to a small town where many houses are old and children play with their dogs".split()
    prose = lambda n: [words[k] for k in rng.integers(0, len(words), n)]
    model = licenses.train([prose(int(rng.integers(5, 80))) for _ in range(80)], copies=4, rounds=120)
    texts = [None, "", "\n\n", "MIT", "Released"]
    for t in [*CASES, *[t for ts in licenses.TEMPLATES.values() for t in ts]]:
        around = prose(int(rng.integers(0, 260)))
        cut = int(rng.integers(0, len(around) + 1))
        line = [*around[:cut], *t.split(), *around[cut:]]
        texts.append("".join(w + str(rng.choice([" ", " ", " ", "\n", " \n\n"], p=[0.5, 0.3, 0.1, 0.07, 0.03])) for w in line))
    got = licenses.scan_texts(texts, model)
    for t, found in zip(texts, got, strict=True):
        assert [(x["line"], x["family"], round(x["probability"], 4), round(x["containment"], 6), x["confirmed"]) for x in found] == by_hand(t, model)
    assert sum(x["confirmed"] for found in got for x in found) > 40


def test_sample_is_bounded(docs):
    rows = [(1, f"an ordinary paragraph number {i} about towns and rivers") for i in range(300)] + [(None, "one and the same paragraph of words")] * 300 + [(2, "Released under the MIT License.")]
    out = licenses.scan(docs(rows), licenses.fit(docs(rows), sample=20)).collect()
    assert [x["family"] for r in out for x in r["findings"] if x["confirmed"]] == ["MIT"]
