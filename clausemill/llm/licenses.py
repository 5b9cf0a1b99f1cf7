"""License scans: a paragraph classifier on sparse word n-grams, confirmed against templates.

A multinomial logistic regression over word 1- to 3-grams is trained on the families' notices, with variants, and on sentences that
only sound alike, also mixed with each other, as the class unknown. A paragraph is a line with a word of the trained vocabulary that isn't a stop word, or a window of
words, within a line or across lines, that holds enough of a template's word pairs. The accepted probability is calibrated on
variants and look-alikes that a first fit doesn't see, and a prediction stands if enough of a template's word pairs are in the paragraph. Of paragraphs that overlap in these
pairs, the one that holds most of them counts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

UNKNOWN = "unknown"
#: Least probability of a family before calibration, share of a template's word pairs that must occur, words of a window for each word pair of its template.
LEAST, CONFIRM, REACH = 0.5, 0.6, 2

# Notices by family.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GPLv3 license."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "SPDX-License-Identifier: GPL-2.0-only", "Released under the GPLv2 license."],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 3.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD": ["Released under the BSD License.", "Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released into the public domain."],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced or transmitted in any form without prior written permission of the publisher.", "Confidential and proprietary. All rights reserved."],
}
LOOK_ALIKES = [
    "Renew your driver license online before the end of the month.", "The driving license office is open on weekdays.", "A group at MIT released new results on batteries.", "Apache helicopters were seen over the city.", "Version 2.0 of the game adds new maps.",
    "The general public may visit the museum free of charge.", "Commons debate the new public transport act.", "Please use the software to copy files to the new computer.", "The foundation published a report on source code quality.", "GNU is an animal of the plains.",
    "Permission to enter the building is granted by the office.", "Terms and conditions of sale.", "The creative team works in version control.", "The license fee for the channel rose again.", "Copyright law was the subject of the lecture.", "Attribution of the painting is disputed.",
    "They were licensed to sell wine.", "The work was released last year in public cinemas.", "No part of the plan was published.", "Public domain names can be registered.", "Mozilla and Apache are projects with many users.", "International trade is subject to the terms of the agreement.", "Redistribution of income is a public issue.", "All rights of way are reserved for walkers.",
    "This work is difficult.", "The license.", "under the terms", "version 3", "released under", "Licensed", "public license", "permission is granted", "free software", "source code", "the software",
]
STOP = set("a an and any are as at be by for from has have if in into is it its may no not of on or so such than that the their this to under was were which with you your we our will".split())

_TO_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def grams(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """Distinct 1- to 3-grams with a word that isn't a stop word."""
    out = set()
    for n in (1, 2, 3):
        for k in range(len(words) - n + 1):
            g = tuple(words[k : k + n])
            if any(w not in _STOP for w in g):
                out.add(g)
    return out


_STOP = {w.encode() for w in STOP}


@dataclass
class LicenseModel:
    families: list[str]  # the last is UNKNOWN
    index: dict[tuple[bytes, ...], int]
    weights: np.ndarray  # (features, families)
    bias: np.ndarray
    threshold: float
    pairs: dict[str, list[set[tuple[bytes, bytes]]]]  # word pairs of each template

    def anchors(self) -> set[bytes]:
        return {g[0] for g in self.index if len(g) == 1}

    def probabilities(self, words: list[bytes]) -> np.ndarray:
        found = [self.index[g] for g in grams(words) if g in self.index]
        z = self.bias + self.weights[found].sum(axis=0) / max(1.0, len(found) ** 0.5)
        e = np.exp(z - z.max())
        return e / e.sum()

    def classify(self, words: list[bytes]) -> tuple[str, float]:
        """(family or UNKNOWN, its probability); a family must pass the calibrated threshold and be confirmed by a template."""
        p = self.probabilities(words)
        best = int(p.argmax())
        family = self.families[best]
        if family != UNKNOWN and p[best] >= self.threshold:
            own = set(zip(words, words[1:], strict=False))
            if max(len(t & own) / len(t) for t in self.pairs[family]) >= CONFIRM:
                return family, float(p[best])
        return UNKNOWN, float(p[-1])


def variants(words: list[bytes]) -> list[list[bytes]]:
    """A notice as it stands, after a copyright line, cut short at either end, before other words, and with every seventh word missing."""
    cut = max(4, len(words) * 3 // 4)
    return [words, [b"copyright", b"2020", *words], words[:cut], [*words, b"see", b"the", b"file", b"for", b"details"], words[-cut:], [w for k, w in enumerate(words) if k % 7 != 5 or len(words) < 8]]


def fit(texts: list[tuple[list[bytes], int]], families: list[str], turns: int) -> tuple[dict[tuple[bytes, ...], int], np.ndarray, np.ndarray]:
    """(features, weights, bias) of a multinomial logistic regression on (words, class), by full gradient steps."""
    index: dict[tuple[bytes, ...], int] = {}
    for words, _ in texts:
        for g in sorted(grams(words)):
            index.setdefault(g, len(index))
    x = np.zeros((len(texts), len(index)))
    for row, (words, _) in enumerate(texts):
        found = [index[g] for g in grams(words)]
        x[row, found] = 1 / max(1.0, len(found) ** 0.5)
    y = np.eye(len(families))[[k for _, k in texts]]
    weights, bias = np.zeros((len(index), len(families))), np.zeros(len(families))
    for _ in range(turns):
        z = x @ weights + bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        gap = e / e.sum(axis=1, keepdims=True) - y
        weights -= 8.0 * (x.T @ gap / len(texts) + 1e-5 * weights)
        bias -= 2.0 * gap.mean(axis=0)
    return index, weights, bias


def threshold_of(true: list[float], false: list[float]) -> float:
    """The cut with the least sum of both error rates over rows of families and others; in the middle of the best cuts."""
    cuts = sorted({0.0, 1.0, *true, *false})
    middles = [(a + b) / 2 for a, b in zip(cuts, cuts[1:], strict=False)]
    errors = [sum(t < c for t in true) / max(1, len(true)) + sum(f >= c for f in false) / max(1, len(false)) for c in middles]
    best = [c for c, e in zip(middles, errors, strict=True) if e == min(errors)]
    return (best[0] + best[-1]) / 2


def train(notices: dict[str, list[str]] = NOTICES, look_alikes: list[str] = LOOK_ALIKES, turns: int = 400) -> LicenseModel:
    """Fits the regression; the training set is the given lists, so the model has a fixed size.

    A first fit leaves out every fourth variant and look-alike; on these, the least probability of a family is calibrated.
    """
    families = [*sorted(notices), UNKNOWN]
    texts = [(v, k) for k, family in enumerate(families[:-1]) for notice in notices[family] for v in variants(words_of(notice.encode()))]
    others = [words_of(x.encode()) for x in look_alikes]
    others += [[*a[: len(a) // 2], *b[len(b) // 2 :]] for a, b in zip(others, [*others[5:], *others[:5]], strict=True)]  # halves of two
    texts += [(words, len(families) - 1) for words in [*others, []]]
    seen = [t for k, t in enumerate(texts) if k % 4 != 3]
    pairs = {f: [set(zip(w, w[1:], strict=False)) for w in map(words_of, (n.encode() for n in notices[f]))] for f in families[:-1]}
    first = LicenseModel(families, *fit(seen, families, turns), LEAST, pairs)
    true, false = [], []
    for words, k in texts[3::4]:
        p = first.probabilities(words)
        if k == len(families) - 1:
            false.append(float(p[:-1].max()))
        else:
            true.append(float(p[k]))
    return LicenseModel(families, *fit(texts, families, turns), threshold_of(true, false), pairs)


class Scanner:
    """Finds the notices of texts, each once."""

    def __init__(self, model: LicenseModel):
        self.model, self.anchors = model, model.anchors()
        self.templates = [(family, pairs) for family in model.families[:-1] for pairs in model.pairs[family]]
        self.owners: dict[tuple[bytes, bytes], list[int]] = defaultdict(list)
        for t, (_, pairs) in enumerate(self.templates):
            for pair in pairs:
                self.owners[pair].append(t)

    def windows(self, hits: list[tuple[int, tuple[bytes, bytes]]], size: int) -> Iterator[tuple[int, int]]:
        """(first, end) in words of the windows with at least CONFIRM of a template's `size` pairs; of those that overlap, the one with most."""
        inside: Counter[tuple[bytes, bytes]] = Counter()
        end, best, reach = 0, (0, 0, 0), REACH * size
        for first, (at, pair) in enumerate(hits):
            while end < len(hits) and hits[end][0] < at + reach:
                inside[hits[end][1]] += 1
                end += 1
            if best[0] and at >= best[2]:
                yield best[1:]
                best = (0, 0, 0)
            if len(inside) >= CONFIRM * size and len(inside) > best[0]:
                best = (len(inside), at, hits[end - 1][0] + 2)
            inside[pair] -= 1
            if not inside[pair]:
                del inside[pair]
        if best[0]:
            yield best[1:]

    def notices(self, text: bytes) -> list[tuple[str, float]]:
        """(family, probability) of each notice."""
        lines = [words_of(line) for line in text.split(b"\n")]
        words = [w for line in lines for w in line]
        starts = np.r_[0, np.cumsum([len(line) for line in lines])]
        hits: dict[int, list[tuple[int, tuple[bytes, bytes]]]] = defaultdict(list)
        for at, pair in enumerate(zip(words, words[1:], strict=False)):
            for t in self.owners.get(pair, ()):
                hits[t].append((at, pair))
        if not hits:
            return []
        found = {(int(starts[k]), int(starts[k + 1])) for k, line in enumerate(lines) if not self.anchors.isdisjoint(line)}
        for t, own in hits.items():
            size = len(self.templates[t][1])
            if len(own) >= CONFIRM * size:
                for first, end in self.windows(own, size):
                    a, b = np.searchsorted(starts, first, "right") - 1, np.searchsorted(starts, end)
                    found |= {(first, end), (int(starts[a]), int(starts[b]))}
        accepted = []
        for first, end in found:
            family, p = self.model.classify(words[first:end])
            if family != UNKNOWN:
                pairs = max(self.model.pairs[family], key=lambda t: len(t.intersection(zip(words[first:end], words[first + 1 : end], strict=False))))
                met: dict[tuple[bytes, bytes], int] = {}
                for at in range(first, end - 1):
                    if (words[at], words[at + 1]) in pairs:
                        met.setdefault((words[at], words[at + 1]), at)
                accepted.append((-len(met), end - first, first, family, p, met.values()))
        out, taken = [], set()
        for _, _, _, family, p, places in sorted(accepted, key=lambda x: x[:4]):
            if 2 * sum(at in taken for at in places) < len(places):
                out.append((family, p))
                taken.update(places)
        return out


def scan(docs: DataFrame, model: LicenseModel) -> DataFrame:
    """doc_id, families (sorted, comma-joined, empty if none), n_paragraphs (accepted, each notice once), score (highest probability of an accepted one, else 0) for each row of `docs` (doc_id, text).

    Null or empty text: none. Null ids and repeated rows pass through. No rows: no rows. Whole texts are scanned.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.families, model.index, model.weights, model.bias, model.threshold, model.pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(LicenseModel(*shared.value))
        for batch in batches:
            families, counts, scores = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                accepted = scanner.notices(text or b"")
                families.append(",".join(sorted({f for f, _ in accepted})))
                counts.append(len(accepted))
                scores.append(max((p for _, p in accepted), default=0.0))
            yield pa.record_batch([batch.column(0), pa.array(families, pa.string()), pa.array(counts, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "families", "n_paragraphs", "score"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, families string, n_paragraphs long, score double")
