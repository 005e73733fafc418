"""Licence scan of paragraphs: sparse word n-gram logistic regression over licence families, with an unknown class.

The classifier reads every paragraph in windows of a few words. It learns from references to licences (names and identifiers
in carrying phrases), windows of the notices below and pairs of them, each among words of the corpus, against windows of the
corpus, near misses and references that deny a licence. A temperature, fitted on phrases that the fit hasn't seen, calibrates
its probabilities. What it takes for a family is then compared with that family's templates (its names and notices): they say
where the reference stands, and the classifier judges that place among its neighbours, the names of other families left out.
Neither counts alone: a name without the classifier ("students at MIT", "not under the MIT license") is unknown, and so is a
prediction that no template confirms. A paragraph is a run of lines with words, whatever signs of comments stand before them;
it may name several families.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, small_batches, texts
from .rolling import U, mix, range_hashes

#: Windows of the corpus that the fit takes as examples of the unknown class (in expectation).
FIT_WINDOWS = 6_000
#: Words of a window and from one window to the next.
WINDOW, STEP = 8, 2
#: Windows that are scored at once.
BLOCK = 1 << 13
#: Words before and after a reference that the classifier judges it by.
BEFORE, AFTER = 6, 3
#: Of a judged reference; of a family among those that a window may name; of a notice's three-word runs.
LEAST_PROBABILITY, LEAST_SHARE, LEAST_COVERAGE = 0.6, 0.01, 0.6
# Sentences by which works refer to public licences, and of their usual notices.
NOTICES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("licensed under the GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004", "you may not use this file except in compliance with the License", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS", "See the License for the specific language governing permissions and limitations under the License"),
    "Artistic-2.0": ("licensed under the Artistic License 2.0", "under the terms of the Artistic License version 2.0"),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted", "Licensed under the BSD 3-Clause License", "released under the BSD license", "use of this source code is governed by a BSD-style license", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0",),
    "CC-BY": ("Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0": ("CC0 1.0 Universal public domain dedication", "released under CC0 1.0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    "EPL-2.0": ("made available under the terms of the Eclipse Public License 2.0", "Eclipse Public License, version 2.0"),
    "GPL": ("This work is licensed under the GNU General Public License, version 3", "either version 2 of the License, or (at your option) any later version", "under the terms of the GNU General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU General Public License along with this program"),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "released under the ISC License", "the author disclaims all warranties with regard to this software including all implied warranties"),
    "LGPL": ("licensed under the GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v3", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    "MIT": ("Released under the MIT License", "Licensed under the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    "MPL-2.0": ("subject to the terms of the Mozilla Public License, v. 2.0", "licensed under the Mozilla Public License, version 2.0"),
    "OFL-1.1": ("This Font Software is licensed under the SIL Open Font License, Version 1.1",),
    "Unlicense": ("This is free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary"),
    "WTFPL": ("Do What The Fuck You Want To Public License",),
    "Zlib": ("This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"),
}
for _family, _more in {
    "AGPL-3.0": ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by",),
    "BSL-1.0": ("any person or organization obtaining a copy of the software and accompanying documentation covered by this license",),
    "GPL": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by",),
    "LGPL": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by",),
    "MPL-2.0": ("If a copy of the MPL was not distributed with this file, You can obtain one at",),
    "Zlib": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",),
}.items():
    NOTICES[_family] += _more
# Names of the licences, and their public identifiers.
NAMES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("GNU Affero General Public License", "Affero General Public License", "GNU AGPL", "AGPL", "AGPLv3"),
    "Apache-2.0": ("Apache License", "Apache License, Version 2.0", "Apache 2.0", "Apache 2 license", "Apache licence", "ASL 2.0", "Apache Software License"),
    "Artistic-2.0": ("Artistic License", "Artistic License 2.0", "Perl Artistic License"),
    "BSD": ("BSD license", "BSD licence", "BSD-style license", "3-clause BSD", "2-clause BSD", "new BSD license", "simplified BSD license", "BSD"),
    "BSL-1.0": ("Boost Software License", "Boost license"),
    "CC-BY": ("Creative Commons Attribution 4.0", "Creative Commons Attribution International License", "Creative Commons Attribution License", "CC BY 4.0", "CC BY 3.0"),
    "CC-BY-NC": ("Creative Commons Attribution-NonCommercial", "CC BY-NC", "CC BY-NC 4.0"),
    "CC-BY-SA": ("Creative Commons Attribution-ShareAlike", "CC BY-SA", "CC BY-SA 4.0"),
    "CC0": ("CC0", "CC0 1.0", "Creative Commons Zero"),
    "EPL-2.0": ("Eclipse Public License", "EPL 2.0", "EPL"),
    "GPL": ("GNU General Public License", "GNU GPL", "GPL", "GPLv2", "GPLv3", "GPL version 2", "GPL version 3"),
    "ISC": ("ISC License", "ISC licence", "ISC"),
    "LGPL": ("GNU Lesser General Public License", "Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL", "LGPLv2", "LGPLv3"),
    "MIT": ("MIT license", "MIT licence", "MIT-style license", "Expat license", "MIT"),
    "MPL-2.0": ("Mozilla Public License", "MPL 2.0", "MPL"),
    "OFL-1.1": ("SIL Open Font License", "Open Font License", "OFL"),
    "Unlicense": ("Unlicense", "The Unlicense"),
    "WTFPL": ("WTFPL", "Do What The Fuck You Want To Public License"),
    "Zlib": ("zlib license", "zlib licence", "zlib/libpng license", "zlib"),
}
IDENTIFIERS: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("AGPL-3.0-only", "AGPL-3.0-or-later", "AGPL-3.0"),
    "BSD": ("BSD-2-Clause", "BSD-3-Clause"),
    "CC-BY": ("CC-BY-3.0", "CC-BY-4.0"),
    "CC-BY-NC": ("CC-BY-NC-4.0",),
    "CC-BY-SA": ("CC-BY-SA-3.0", "CC-BY-SA-4.0"),
    "CC0": ("CC0-1.0",),
    "GPL": ("GPL-2.0", "GPL-3.0", "GPL-2.0-only", "GPL-3.0-only", "GPL-2.0-or-later", "GPL-3.0-or-later"),
    "LGPL": ("LGPL-2.1", "LGPL-3.0", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later"),
}
for _family in NOTICES:
    IDENTIFIERS.setdefault(_family, (_family,))
    NOTICES[_family] += (f"SPDX-License-Identifier: {IDENTIFIERS[_family][-1]}",)
#: Phrases that carry a name or identifier: those of the fit, and those that only the temperature and the accuracy see.
CARRIERS = ("{}", "licensed under {}", "licensed under the {}", "released under the {}", "released under {}", "distributed under the {}", "available under the {}", "this work is licensed under the {}", "this file is licensed under {}", "under the terms of the {}", "covered by the {}", "see the {} for details", "published under the {}", "you may use it under the {}", "license: {}", "licence: {}", "license = {}", "SPDX-License-Identifier: {}", "{} licensed", "{} applies", "dual licensed under {}", "or the {} at your option", "dedicated under {}")
HELD_CARRIERS = ("the code is made available under the {}", "governed by the {}", "may be redistributed under {}", "provided under the {}", "project license: {}", "all files here are licensed under {}")
DENIALS = ("incompatible with the {}", "unlike the {}", "this is not {}", "neither under the {} nor any other", "without the {}")
#: Denials by rule: each of the first with each of the second but for those held out.
DENIED = (("not", "is not", "was never", "never", "no longer", "are not", "cannot be"), ("licensed", "released", "available", "distributed", "covered", "published", "offered"))
HELD_DENIALS = ("this code is not available under the {}", "no longer distributed under the {}", "was never licensed under the {}", "are not covered by the {}")
PAIRS = ("either of {} or {}", "licensed under either {} or {}", "the {} or the {}", "under the {} and {}", "license: {} or {}")
#: Phrases that mention a name of one word without granting anything.
MENTIONS = ("students at {}", "he went to {} in spring", "the {} library", "the {} conference", "a user of {}", "the {} was written", "papers about {}", "{} and others", "with {} and", "a talk on {}")
NEAR_MISSES = ("All rights reserved", "used under license from the owner", "a driving licence is required", "this work is licensed under a proprietary license", "licensed to the customer for internal use only", "released under embargo", "the general public is invited", "permission is hereby denied", "the public version was released", "Licensed premises, open at noon", "students at MIT", "she studied at MIT and later taught there", "a professor of MIT", "mit der und von dem", "das ist mit einer und die mit", "an Apache helicopter", "the Apache web server", "a user of the BSD operating system", "compressed with zlib", "the zlib library", "the terms of the public offer", "an artistic version of the text", "the boost in public software", "an eclipse of the sun", "creative commons of the city", "the GPL was written long ago", "papers about the GPL", "the ISC conference")
FAMILIES = tuple(NOTICES)
UNKNOWN = len(FAMILIES)
_LEAD = ("", "this file is ", "the code is ", "unless noted, ", "copyright 2020 the authors. ", "note: ")
_KEEP = np.array([32 if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and last bytes (exclusive) of the words of a text: runs of letters, digits and non-ASCII."""
    data = _KEEP[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    edge = np.diff(np.concatenate(([True], data == 32, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, dtype=np.uint64), start, end
    return range_hashes(data, start, end), start, end


def grams(w: np.ndarray, n: int) -> np.ndarray:
    if len(w) < n:
        return np.zeros(0, dtype=np.uint64)
    h = w[: len(w) - n + 1] + U(n)
    for k in range(1, n):
        h = mix(h * U(0x9DDFEA08EB382D69) + w[k : len(w) - n + 1 + k])
    return h


def features(w: np.ndarray) -> np.ndarray:
    """Hashes of the 1- to 3-word runs."""
    return np.concatenate([grams(w, n) for n in (1, 2, 3)])


def template_runs() -> np.ndarray:
    """Three-word runs of the notices."""
    return np.unique(np.concatenate([grams(word_hashes(n)[0], 3) for f in FAMILIES for n in NOTICES[f]]))


def windows(words: int) -> list[tuple[int, int]]:
    return [(a, min(words, a + WINDOW)) for a in range(0, words, STEP) if a == 0 or a + WINDOW < words + STEP]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Rows:
    """Examples as sparse rows over a vocabulary of runs; a run that isn't in it only counts in the length."""

    def __init__(self, rows: list[np.ndarray], vocabulary: np.ndarray):
        size = np.array([max(1, len(r)) for r in rows])
        all_, at = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        place = np.minimum(np.searchsorted(vocabulary, all_), len(vocabulary) - 1)
        known = vocabulary[place] == all_
        self.n, self.at, self.col, self.root = len(rows), at[known], place[known], (1 / np.sqrt(size)).astype(np.float32)
        self.order = np.argsort(self.col, kind="stable")
        self.cols, self.first = np.unique(self.col[self.order], return_index=True)
        self.filled, self.begin = np.unique(self.at, return_index=True)

    def scores(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, w.shape[1]), dtype=w.dtype)
        if len(self.at):
            out[self.filled] = np.add.reduceat(w[self.col], self.begin)
        return out * self.root[:, None]

    def gradient(self, g: np.ndarray, like: np.ndarray) -> np.ndarray:
        out = np.zeros_like(like)
        if len(self.at):
            out[self.cols] = np.add.reduceat((g * self.root[:, None])[self.at[self.order]], self.first)
        return out


def _descended(x: Rows, y: np.ndarray, width: int, steps: int, decay: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by descent with a step of its own for each weight; families count alike, the unknown class as half of all."""
    w, b, y = np.zeros((width, UNKNOWN + 1), dtype=np.float32), np.zeros(UNKNOWN + 1, dtype=np.float32), y.astype(np.float32)
    share = (y / np.maximum(1e-9, y.sum(axis=0)) * np.where(np.arange(UNKNOWN + 1) == UNKNOWN, UNKNOWN / 2, 1)).sum(axis=1).astype(np.float32) / UNKNOWN
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for k in range(1, steps + 1):
        g = (softmax(x.scores(w) + b) - y) * share[:, None]
        gw, gb = x.gradient(g, w) + decay * w, g.sum(axis=0)
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        one, two = 1 - 0.9**k, 1 - 0.99**k
        w -= 0.3 * (m / one) / (np.sqrt(v / two) + 1e-8)
        b -= 0.1 * (mb / one) / (np.sqrt(vb / two) + 1e-8)
    return w, b


def _examples(unknown: list[np.ndarray], rng: np.random.Generator) -> tuple[list[np.ndarray], list[tuple[int, ...]], list[bool], np.ndarray]:
    """(runs, families (none: unknown), held out) of references, denials and windows of notices, by turns alone and among other
    words, and the runs of those that are not held out: the vocabulary. What stands around them is no part of it."""
    x: list[np.ndarray] = []
    y: list[tuple[int, ...]] = []
    held: list[bool] = []
    known: list[np.ndarray] = []
    around = [features(word_hashes(t)[0]) for t in (*_LEAD, "all rights reserved", "and other files of the work") if t] + unknown[:2_000]

    def add(text: str, families: tuple[int, ...], out: bool) -> None:
        own = features(word_hashes(text)[0])
        if not out:
            known.append(own)
        for alone in (rng.random() < 0.5, False):  # by itself or among other words, and among others
            row = own
            if not alone:
                more = around[rng.integers(len(around))]
                more = more[rng.random(len(more)) < rng.random()][: 3 * (BEFORE + AFTER)]
                row = np.concatenate([own, more, np.zeros(rng.integers(0, 3 * (BEFORE + AFTER) + 1 - len(more)), dtype=np.uint64)])
            x.append(row), y.append(families), held.append(out)

    denials = [d for no in DENIED[0] for verb in DENIED[1] for d in (f"{no} {verb} {'by' if verb == 'covered' else 'under'} the {{}}", f"{no} {verb} {'by' if verb == 'covered' else 'under'} {{}}") if not any(d.removesuffix("{}").strip() in h for h in HELD_DENIALS)]
    for k, f in enumerate(FAMILIES):
        for name in (*NAMES[f], *IDENTIFIERS[f]):
            some = tuple(denials[i] for i in rng.choice(len(denials), 24, replace=False))
            for carriers, families, out in ((CARRIERS, (k,), False), (HELD_CARRIERS, (k,), True), (DENIALS + some, (), False), (HELD_DENIALS, (), True)):
                for c in carriers:
                    if not (c in ("{}", "{} applies", "see the {} for details") and len(name) < 5):  # too little to tell
                        add(c.format(name), families, out)
        for name in NAMES[f]:
            for m in MENTIONS if " " not in name and len(name) < 6 else ():
                add(m.format(name), (), False)
        for n in NOTICES[f]:
            words = n.split()
            for a, b in windows(len(words)):
                if b - a >= min(len(words), 5):
                    add(" ".join(words[a:b]), (k,), False), add(" ".join(words[a:b]), (k,), False)
            for _ in range(8):
                add(n, (k,), False)
        for c in PAIRS:
            for _ in range(4):
                j = int(rng.integers(len(FAMILIES)))
                one, two = rng.choice(NAMES[f]), rng.choice(NAMES[FAMILIES[j]])
                add(c.format(one, two), (k, j) if j != k else (k,), False)
                add(c.format(one, ""), (k,), False), add(c.format("", one), (k,), False)
    for n in NEAR_MISSES:
        for lead in _LEAD:
            add(lead + n, (), False)
    for k, r in enumerate(unknown):  # runs of the corpus alone tell nothing
        x.append(r), y.append(()), held.append(k % 5 == 0)
    return x, y, held, np.setdiff1d(np.concatenate(known), [0])


def train(unknown: list[np.ndarray], seed: int = 5, steps: int = 100) -> dict:
    """Weights over the vocabulary of runs, biases and temperature, from references and windows of the corpus (as `features`).

    One fit. The temperature and `unseen_accuracy` come from references in phrases that the fit has not seen (denials among
    them) and from every fifth window of the corpus; `accuracy` is over what it has seen.
    """
    x, y, held, vocabulary = _examples(unknown, np.random.default_rng(seed))
    target = np.zeros((len(x), UNKNOWN + 1))
    for k, families in enumerate(y):
        target[k, list(families) or [UNKNOWN]] = 1 / max(1, len(families))
    fitted, unseen = np.flatnonzero(~np.array(held)), np.flatnonzero(held)
    rows = Rows([x[i] for i in fitted], vocabulary)
    w, b = _descended(rows, target[fitted], len(vocabulary), steps)
    right = lambda z, t: float((t[np.arange(len(t)), z.argmax(axis=1)] > 0).mean())
    z, t = Rows([x[i] for i in unseen], vocabulary).scores(w) + b, target[unseen]
    loss = {s: -(t * np.log(np.maximum(softmax(z * s), 1e-12))).sum(axis=1).mean() for s in (0.25, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)}
    some = t[:, UNKNOWN] == 0
    return {"vocabulary": vocabulary, "w": w.astype(np.float32), "b": b, "sharp": min(loss, key=loss.get), "unseen_accuracy": right(z, t), "unseen_families": right(z[some], t[some]), "unseen_unknown": right(z[~some], t[~some]), "accuracy": right(rows.scores(w) + b, target[fitted])}


def paragraphs(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a text with their byte offsets, and where the words of its paragraphs begin and end (one more than
    paragraphs). Lines without words part paragraphs."""
    w, start, end = word_hashes(text)
    lines = np.flatnonzero(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8) == 10)
    cuts = np.flatnonzero(np.diff(np.searchsorted(lines, start), prepend=-2) > 1)
    return w, start, end, np.append(cuts, len(w))


def sampled(share: float):
    runs = template_runs()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 4 << 20):
            out = []
            for t in texts(batch):
                w, _, _, cuts = paragraphs(t)
                if len(w):
                    part = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
                    first = np.flatnonzero((np.arange(len(w)) - cuts[part]) % WINDOW == 0)
                    key = mix(np.add.reduceat(w, first))
                    for k in np.flatnonzero((key >> U(40)) < int(share * (1 << 24))).tolist():
                        own = w[first[k] : min(first[k] + WINDOW, cuts[part[first[k]] + 1])]
                        if not np.isin(grams(own, 3), runs).any():
                            out.append(features(own).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["x"])

    return run


def fit(docs: DataFrame, most: int = FIT_WINDOWS) -> dict:
    """Trains against about `most` windows of the corpus, chosen by a hash of their words so that copies count once at most each.

    How many windows there are is estimated from the length of all texts, at seven characters a word."""
    small_batches(docs.sparkSession)
    chars = docs.select(F.sum(F.length("text"))).first()[0] or 0
    share = min(1.0, most * 7 * WINDOW / max(1, chars))
    part = docs.select("text").where(F.col("text").isNotNull())
    rows = part.mapInArrow(sampled(share), "x binary").distinct().orderBy(F.xxhash64("x"), "x").limit(4 * most).collect()  # bounded by `most`
    return train([np.frombuffer(r["x"], dtype=np.uint64) for r in sorted(rows, key=lambda r: r["x"])])


class Scanner:
    def __init__(self, model: dict):
        self.model = model
        self.vocabulary, self.w = model["vocabulary"], model["w"] * np.float32(model["sharp"])
        self.b = model["b"] * model["sharp"]
        #: What a run can add, at most, to a family's score above the unknown class's.
        self.most = (self.w[:, :UNKNOWN] - self.w[:, UNKNOWN:]).max(axis=1)
        self.top = float((self.b[:UNKNOWN] - self.b[UNKNOWN]).max())
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.vocabulary >> U(44)).astype(np.int64)] = True
        self.names = [sorted({tuple(word_hashes(n)[0].tolist()) for n in (*NAMES[f], *IDENTIFIERS[f])}, key=len) for f in FAMILIES]
        self.notices = [[np.unique(grams(word_hashes(n)[0], 3)) for n in NOTICES[f]] for f in FAMILIES]

    def _places(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the runs are in the vocabulary: (number of the run, place)."""
        at = np.flatnonzero(self.maybe[(runs >> U(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocabulary, runs[at]), len(self.vocabulary) - 1)
        same = self.vocabulary[place] == runs[at]
        return at[same], place[same]

    def _probability(self, w: np.ndarray) -> np.ndarray:
        runs = features(w)
        z = self.w[self._places(runs)[1]].sum(axis=0, dtype=np.float64) / np.sqrt(max(1, len(runs))) + self.b
        return softmax(z[None])[0]

    def predicted(self, w: np.ndarray, cuts: np.ndarray) -> list[tuple[int, int, int, list[int]]]:
        """(paragraph, first word, end word, families) of the windows that name a licence, of all windows of all paragraphs.

        A window is scored only if the sum of what its runs can add at most lets the unknown class fall below one half."""
        part = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        word, first, last = np.arange(len(w)), cuts[part], cuts[part + 1]
        keep = ((word - first) % STEP == 0) & ((word == first) | (word + WINDOW < last + STEP))
        a, part = word[keep], part[keep]
        b = np.minimum(a + WINDOW, last[keep])
        total, size, runs = np.zeros(len(a)), np.zeros(len(a), dtype=np.int64), []
        for n in (1, 2, 3):
            at, place = self._places(grams(w, n))
            add = np.zeros(len(w) + 1)
            add[at + 1] = self.most[place]
            add = np.cumsum(add)
            end = np.maximum(b - n + 1, a)
            total += add[end] - add[a]
            size += end - a
            runs.append((at, place, end))
        near = np.flatnonzero(total / np.sqrt(np.maximum(size, 1)) + self.top > -np.log(UNKNOWN) - 1e-3)
        out = []
        for k in np.split(near, range(BLOCK, len(near), BLOCK)) if len(near) else ():
            z = np.zeros((len(k), UNKNOWN + 1))
            for at, place, end in runs:
                lo, hi = np.searchsorted(at, a[k]), np.searchsorted(at, end[k])
                rows = np.repeat(np.arange(len(k)), hi - lo)
                own = place[np.arange(len(rows)) - np.repeat(np.cumsum(hi - lo) - hi, hi - lo)]
                some = hi > lo
                if some.any():
                    z[some] += np.add.reduceat(self.w[own], np.flatnonzero(np.diff(rows, prepend=-1)), dtype=np.float64)
            p = softmax(z / np.sqrt(np.maximum(size[k], 1))[:, None] + self.b)
            for i in np.flatnonzero(p[:, UNKNOWN] < 0.5).tolist():
                q = p[i, :UNKNOWN]
                out.append((int(part[k[i]]), int(a[k[i]]), int(b[k[i]]), np.flatnonzero(q >= LEAST_SHARE * q.sum()).tolist()))
        return out

    def _confirmed(self, w: np.ndarray, f: int) -> list[tuple[int, int]]:
        """Spans of words that are a name of the family, or hold most three-word runs of one of its notices."""
        names = []
        for name in self.names[f]:
            at = np.flatnonzero(w[: max(0, len(w) - len(name) + 1)] == U(name[0]))
            for k, v in enumerate(name[1:], 1):
                at = at[w[at + k] == U(v)]
            names += [(x, x + len(name)) for x in at.tolist()]
        spans, three = list(names), grams(w, 3)
        for t in self.notices[f]:
            at = np.flatnonzero(np.isin(three, t))
            for run in np.split(at, np.flatnonzero(np.diff(at) > WINDOW) + 1) if len(at) else ():
                if len(np.unique(three[run])) >= LEAST_COVERAGE * len(t):
                    parts = [(int(r[0]), int(r[-1]) + 3) for r in np.split(run, np.flatnonzero(np.diff(run) > 3) + 1)]
                    named = [(x, y) for x, y in parts if any(x < d and c < y for c, d in names)]
                    # What lies between the parts may name another family: the parts with a name are enough then.
                    spans += named or [(parts[0][0], parts[-1][1])]
        out: list[tuple[int, int]] = []
        for x, y in sorted(spans):
            if out and x <= out[-1][1]:
                out[-1] = (out[-1][0], max(y, out[-1][1]))
            else:
                out.append((x, y))
        return out

    def paragraph(self, w: np.ndarray, regions: list[tuple[int, int, list[int]]]) -> list[tuple[int, int, int, float]]:
        """(family, first word, end word, probability) of confirmed references of a paragraph's predicted windows."""
        merged: list[tuple[int, int, set[int]]] = []
        for a, b, families in regions:
            if merged and a - WINDOW <= merged[-1][1] + WINDOW:
                merged[-1] = (merged[-1][0], b, merged[-1][2] | set(families))
            else:
                merged.append((a, b, set(families)))
        found: list[tuple[int, int, int, float]] = []
        for a, b, families in merged:
            a, b = max(0, a - WINDOW), min(len(w), b + WINDOW)
            spans, rest = [], w[a:b].copy()
            for _ in FAMILIES:  # what is found may hide another family from a window: look again without it
                more = [(f, a + x, a + y) for f in sorted(families) for x, y in self._confirmed(w[a:b], f)]
                if not more:
                    break
                spans += more
                for _, x, y in more:
                    rest[x - a : y - a] = 0
                seen = {f for f, _, _ in spans} | families
                families = {f for *_, fs in self.predicted(rest, np.array([0, len(rest)])) for f in fs} - seen
            found += self._judged(w, spans)
        return found

    def _judged(self, w: np.ndarray, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """The spans that the classifier takes for their family; of overlapping ones only the likeliest."""
        owner, free = np.zeros(len(w), dtype=np.int32), np.zeros(len(w), dtype=np.int32)
        for f, x, y in spans:
            owner[x:y] += 1
        out = []
        for f, x, y in spans:
            lo, hi = max(0, x - BEFORE), min(len(w), y + AFTER)
            view = np.where(owner[lo:hi] > 0, U(0), w[lo:hi])
            view[x - lo : y - lo] = w[x:y]
            p = float(self._probability(view)[f])
            if p >= LEAST_PROBABILITY:
                out.append((f, x, y, p))
        kept = []
        for f, x, y, p in sorted(out, key=lambda o: (-(o[2] - o[1]) if o[3] > 0.9 else 0, -o[3], o[1], o[0])):
            if not free[x:y].any():
                free[x:y] = 1
                kept.append((f, x, y, p))
        return sorted(kept, key=lambda o: (o[1], o[0]))

    def text(self, text: str) -> tuple[int, list[dict]]:
        w, start, end, cuts = paragraphs(text)
        by: dict[int, list[tuple[int, int, list[int]]]] = {}
        for k, a, b, families in self.predicted(w, cuts) if len(w) else ():
            by.setdefault(k, []).append((a - int(cuts[k]), b - int(cuts[k]), families))
        found = []
        for k, regions in by.items():
            first = int(cuts[k])
            for f, a, b, q in self.paragraph(w[first : cuts[k + 1]], regions):
                found.append({"family": FAMILIES[f], "a": int(start[first + a]), "b": int(end[first + b - 1]), "probability": q})
        return len(cuts) - 1, found


def scanned(model: dict):
    spans = pa.list_(pa.struct([("family", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model)
        for batch in by_bytes(batches):
            x = [scanner.text(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in x], pa.int64()), pa.array([f for _, f in x], spans)], ["doc_id", "n_paragraphs", "found"])

    return run


def scan(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_paragraphs (runs of lines with words), found (family, byte span, probability), licences (sorted, comma-joined).

    Null and empty texts have no paragraphs. Every row gives one row; other columns are ignored; nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_paragraphs long, found array<struct<family:string,a:long,b:long,probability:double>>"
    out = docs.select("doc_id", "text").mapInArrow(scanned(model), schema)
    return out.withColumn("licences", F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"])))))
