import random

import numpy as np
import pytest

from wavemill.llm import licences

PROSE = ("the words of a plain text and what follows them", "das ist mit der und von dem nicht zu machen", "it was open to the public under the old bridge", "les mots de la ville et du port", "a version of the story or another one by the author")


@pytest.fixture(scope="module")
def scanner():
    rng = random.Random(3)
    words = " ".join(PROSE).split()
    return licences.Scanner(licences.train([licences.features(licences.word_hashes(" ".join(rng.choices(words, k=licences.WINDOW)))[0]) for _ in range(600)]))


def names(scanner, text):
    return sorted({x["family"] for x in scanner.text(text)[1]})


def test_unseen_phrases(scanner):
    m = scanner.model
    assert m["unseen_accuracy"] > 0.9 and m["unseen_families"] > 0.88 and m["unseen_unknown"] > 0.88 and m["accuracy"] > 0.97


@pytest.mark.parametrize(
    ("text", "families"),
    [
        ("SPDX-License-Identifier: MIT", ["MIT"]),
        ("// SPDX-License-Identifier: GPL-3.0-or-later", ["GPL"]),
        ("# SPDX-License-Identifier: BSD-3-Clause", ["BSD"]),
        ("covered by the GPLv2", ["GPL"]),
        ("Apache-2.0 licence", ["Apache-2.0"]),
        ("Licensed under either of Apache License, Version 2.0 or MIT license at your option", ["Apache-2.0", "MIT"]),
        ("Licensed under the MIT license or Apache License, Version 2.0", ["Apache-2.0", "MIT"]),
        ("This work is not licensed under the MIT license", []),
        ("This work is not licensed under the MIT license but under the Apache License, Version 2.0.", ["Apache-2.0"]),
        ("He went to MIT in 1990 and flew an Apache helicopter.", []),
        ("Das ist mit der Hand gemacht.", []),
    ],
)
def test_references(scanner, text, families):
    assert names(scanner, text) == families
    assert names(scanner, f"{PROSE[0]}\n\n{text}\n\n{PROSE[2]}") == families


@pytest.mark.parametrize("family", licences.FAMILIES)
def test_identifiers_of_every_family(scanner, family):
    for i in licences.IDENTIFIERS[family]:
        assert names(scanner, f"SPDX-License-Identifier: {i}") == [family]


def test_the_classifier_decides_and_templates_confirm(scanner):
    """Weights of nothing find nothing; names alone would take a denial; a prediction without a template is unknown."""
    idle = licences.Scanner({**scanner.model, "w": np.zeros_like(scanner.model["w"])})
    denied = "This work is not licensed under the MIT license"
    w = licences.word_hashes(denied)[0]
    assert scanner._confirmed(w, licences.FAMILIES.index("MIT")) and names(scanner, denied) == []
    for notices in licences.NOTICES.values():
        assert names(idle, notices[0]) == []
    bare = licences.Scanner(scanner.model)
    bare.names, bare.notices = [[] for _ in bare.names], [[] for _ in bare.notices]
    assert names(bare, "Released under the MIT License") == []


def test_windows_equal_brute_force(scanner):
    """The bound drops no window: all windows of all paragraphs, scored one by one, name the same families."""
    rng = random.Random(7)
    every = [n for ns in licences.NOTICES.values() for n in ns]
    parts = [rng.choice(PROSE) + " " + (rng.choice(every) if k % 3 else "") + " " + rng.choice(PROSE) for k in range(60)]
    w, _, _, cuts = licences.paragraphs("\n\n".join([*parts, "one", "two words"]))
    brute = []
    for k in range(len(cuts) - 1):
        for a, b in licences.windows(int(cuts[k + 1] - cuts[k])):
            a, b = a + int(cuts[k]), b + int(cuts[k])
            rows = licences.Rows([licences.features(w[a:b])], scanner.vocabulary)
            p = licences.softmax((rows.scores(scanner.model["w"]) + scanner.model["b"]) * scanner.model["sharp"])[0]
            if p[licences.UNKNOWN] < 0.5:
                q = p[: licences.UNKNOWN]
                brute.append((k, a, b, np.flatnonzero(q >= licences.LEAST_SHARE * q.sum()).tolist()))
    assert brute and scanner.predicted(w, cuts) == brute


def test_long_paragraph(scanner):
    found = scanner.text("word " * 200_000 + "released under the BSD license " + "word " * 200_000)[1]
    assert [x["family"] for x in found] == ["BSD"] and found[0]["a"] == 5 * 200_000
