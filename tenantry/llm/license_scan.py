"""Licence scans: a trained paragraph classifier whose predictions are confirmed by template comparison.

A paragraph's features are its distinct words and word pairs. A multinomial logistic regression with a sparsity
penalty, trained on notices of each family, on notices and sentences of other licences and, as rows of class none, on a bounded sample of
the corpus's own paragraphs, gives the probability of each family, of ``unknown`` and of ``none``; a temperature
fitted on whole notices held back calibrates them. A predicted family stands if it is likely enough and if the paragraph
holds most of the word pairs of one of the family's notices; otherwise the paragraph is an unknown licence.
A notice may wrap over lines: a line that is not confirmed by itself is judged again with the words around it.

Scoring is DataFrame expressions within a row: no shuffle, no Python. As features are present or absent, the most
that a paragraph without certain anchor words can score is known; anchors are chosen so that this is below ``none``.
So texts without an anchor are settled by one pattern match, with the same result as full scoring.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, whole_row

# Notices by which licences are declared, per family.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL-3.0": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC0-1.0": [
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ],
}
# Licences of no family above, with their versions and short names, and forms in which licences are declared.
OTHER_LICENCES = [
    ("Academic Free License", "3.0", "AFL-3.0"),
    ("Apple Public Source License", "2.0", "APSL-2.0"),
    ("Common Public License", "1.0", "CPL-1.0"),
    ("Elastic License", "2.0", "Elastic-2.0"),
    ("Example Community License", "1.1", "LicenseRef-Example"),
    ("GNU Free Documentation License", "1.3", "GFDL-1.3-only"),
    ("GNU General Public License", "1", "GPL-1.0-only"),
    ("Microsoft Public License", "1.0", "MS-PL"),
    ("Open Database License", "1.0", "ODbL-1.0"),
    ("Open Font License", "1.1", "OFL-1.1"),
    ("Open Software License", "3.0", "OSL-3.0"),
    ("OpenSSL License", "1.0", "OpenSSL"),
    ("PHP License", "3.01", "PHP-3.01"),
    ("Prosperity Public License", "3.0.0", "Prosperity-3.0.0"),
    ("Python Software Foundation License", "2", "PSF-2.0"),
    ("Q Public License", "1.0", "QPL-1.0"),
    ("University of Illinois Open Source License", "1", "NCSA"),
    ("W3C Software Notice and License", "2015", "W3C"),
    ("Zope Public License", "2.1", "ZPL-2.1"),
]
FORMS = [
    "Licensed under the {0}.",
    "Released under the {0}, version {1}.",
    "This program is distributed under the terms of the {0} {1}.",
    "This file is subject to the terms of the {0}; you may obtain a copy of it from the authors.",
    "Made available under the {0}, Version {1}; see the file LICENSE.",
    "This program is free software; you can redistribute it under the terms of the {0}.",
    "{0}, version {1}",
    "SPDX-License-Identifier: {2}",
]
# Licence-like sentences of no family, and sentences that only share words with notices.
UNKNOWN = [
    "Released under the Acme Research License.",
    "This work is licensed under the terms of our vendor agreement.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 3.0 License.",
    "All rights reserved. No part may be reproduced without written permission.",
    "Copyright 2019 Acme Corporation. All rights reserved. Confidential information of Acme; do not copy or disclose.",
    "Use of this material is governed by the license agreement that accompanies it.",
    "Unless you have a signed agreement with the vendor, you may not copy, modify or distribute this software.",
    "You are granted a non-exclusive, non-transferable license to use the software for internal purposes.",
    "Distributed under a custom license; see the file LICENSE for the terms.",
    "This dataset is licensed for evaluation only.",
    "This software is provided as is, without warranty of any kind, express or implied, including fitness for a particular purpose.",
    "The authors disclaim all warranties and shall not be liable for any damages that arise from this software.",
    "Anyone is free to copy, modify, publish, use, sell or distribute this software, commercially or not.",
    "The author has placed this code in the public domain and claims no copyright.",
    "Copying and distribution of this file, with or without modification, are permitted in any medium without royalty.",
    "Permission to copy and distribute this document is granted provided that this notice is kept.",
    "Altered source versions must be plainly marked as such and may not misrepresent the original software.",
]
NOT_LICENCES = [
    "The driver's license was renewed under the new law.",
    "She lost her fishing license and paid for a new one.",
    "The station's license to broadcast ends in May.",
    "An apache helicopter flew over the city.",
    "Researchers at MIT released a study of the river.",
    "The general public was free to use this road.",
    "A public hearing on the terms of the contract was held by the foundation.",
    "Version 2.0 of the program is faster than version 1.0.",
    "The software was released in March and distributed on disks.",
    "The foundation published a copy of the report, free of charge.",
    "The restaurant is licensed to sell wine.",
    "They gave permission to use the hall for any purpose.",
    "Permission to cross the field was granted by the owner.",
    "The warranty of the car ends after three years.",
    "The source of the river is open to the public.",
    "The shop's rights and conditions are printed on the ticket.",
    "He was granted a patent for the machine in 1901.",
    "The new edition is available from the library.",
]
# What often stands before and after a notice.
BEFORE = ["", "Copyright (c) 2021 The Authors.", "License:", "Note:", "The code of this page is free."]
AFTER = ["", "See the LICENSE file for details.", "Some rights reserved.", "Thank you for reading."]

# Words too usual to tell a notice.
STOP_WORDS = set("a an and any are as at be been but by can do for from had has have he her his how if in into is it its may more no not of on one or our part see shall she should so some such than that the their them then there these they this those to two was we were what when which who will with without would you your 1 2 3 c all also following file code copy work use used note page reading thank new made make time person people only under must any mit".split())

NONE, UNKNOWN_CLASS = "none", "unknown"
#: Words are runs of letters and digits, with single marks inside as in 2.0 or by-nc.
GAP = r"(?:[^a-z0-9.\-]|[.\-](?![a-z0-9])|(?<![a-z0-9])[.\-])+"


def tokens(text: str) -> list[str]:
    return [t for t in re.split(GAP, text.translate({c: c + 32 for c in range(65, 91)})) if t]


def grams(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


@dataclass(frozen=True)
class LicenceModel:
    classes: tuple[str, ...]
    bias: tuple[float, ...]
    weights: dict[str, tuple[float, ...]]
    anchors: tuple[str, ...]
    temperature: float
    least: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _notices() -> list[tuple[str, str, str]]:
    """(class, licence, notice) of every notice, sentence and form filled in; a sentence of no named licence stands for itself."""
    forms = [(UNKNOWN_CLASS, names[0], f.format(*names)) for i, names in enumerate(OTHER_LICENCES) for k, f in enumerate(FORMS) if (i + k) % 2 == 0]
    named = [(name, name, n) for name, notices in NOTICES.items() for n in notices]
    return named + forms + [(UNKNOWN_CLASS, n, n) for n in UNKNOWN] + [(NONE, n, n) for n in NOT_LICENCES]


def vocabulary() -> list[str]:
    """The words and word pairs that can be features: those of licence notices, unless all their words are stop words."""
    return sorted({g for name, _, n in _notices() if name != NONE for b in BEFORE for a in AFTER for g in grams(tokens(f"{b} {n} {a}")) if not STOP_WORDS.issuperset(g.split(" "))})


class _Sets:
    """Rows as sets of feature numbers: products with weights and sums by feature, in time of the features held."""

    def __init__(self, rows: list[list[int]], width: int):
        self.width, self.n = width, len(rows)
        # feature ``width`` stands in every row and weighs nothing, so that no row is empty; each feature has a last row of zeros
        self.at = np.array([i for r in rows for i in (*r, width)], np.int64)
        self.starts = np.cumsum([0, *(len(r) + 1 for r in rows[:-1])])
        row = np.concatenate([np.repeat(np.arange(self.n), [len(r) + 1 for r in rows]), np.full(width + 1, self.n)])
        feature = np.concatenate([self.at, np.arange(width + 1)])
        order = np.argsort(feature, kind="stable")
        self.row, self.by_feature = row[order], np.searchsorted(feature[order], np.arange(width + 1))
        self.size = np.array([len(r) for r in rows], float)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.vstack([w, np.zeros(w.shape[1])])[self.at], self.starts)

    def sums(self, g: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.vstack([g, np.zeros(g.shape[1])])[self.row], self.by_feature)[: self.width]


def _fitted(x: _Sets, y: np.ndarray, weight: np.ndarray, classes: int, penalty: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by proximal gradient steps with momentum: the penalty sets small weights to zero."""
    target, share = np.eye(classes)[y], (weight / weight.sum())[:, None]
    w, b = np.zeros((x.width, classes)), np.zeros(classes)
    rate = 2.0 / max(float((share[:, 0] * x.size).sum()), 1e-9)
    at_w, at_b, t = w, b, 1.0
    for _ in range(steps):
        g = share * (_softmax(x.times(at_w) + at_b) - target)
        new = at_w - rate * x.sums(g)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b, t_next = at_b - rate * g.sum(0), (1 + (1 + 4 * t * t) ** 0.5) / 2
        at_w, at_b = new + (t - 1) / t_next * (new - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new, new_b, t_next
    return w, b


def fit_licences(plain: list[list[str]], penalty: float = 3e-4, steps: int = 300, open_weight: float = 3.0, folds: int = 3) -> LicenceModel:
    """Train on the notices above and on ``plain``: the vocabulary's grams in each of some paragraphs that speak of no licence.

    Calibration holds rows back: each fold is scored by a model that has seen none of them. A family is the set of
    its notices, so its folds are surroundings; unknown and none are open, so theirs are whole licences and sentences.
    The temperature has the least loss over all folds, and a family must be surer than any that was wrong.
    """
    classes = (*NOTICES, UNKNOWN_CLASS, NONE)
    rows: Counter[tuple[frozenset[str], int, int]] = Counter()
    words = vocabulary()
    at = {g: i for i, g in enumerate(words)}
    around = [(b, a) for b in BEFORE for a in AFTER]
    for i, (name, licence, n) in enumerate(_notices()):
        kept = list(enumerate(around)) if name in NOTICES else [(0, around[(i + 7 * k) % len(around)]) for k in range(3)]
        for k, (b, a) in kept:
            fold = k if name in NOTICES else zlib.crc32(licence.encode())
            rows[frozenset(g for g in grams(tokens(f"{b} {n} {a}")) if g in at), classes.index(name), fold % folds] += 1
    for i, own in enumerate([*(grams(tokens(x)) for x in (*BEFORE[3:], AFTER[3])), *plain]):
        rows[frozenset(g for g in own if g in at), len(classes) - 1, i % folds] += 1
    sets = [sorted(at[g] for g in own) for own, _, _ in rows]
    y, fold, count = np.array([c for _, c, _ in rows]), np.array([f for _, _, f in rows]), np.array([*rows.values()], float)
    share = count / np.bincount(y, count, len(classes))[y]  # each family weighs the same, none and unknown as some of them
    share *= np.where(y >= len(classes) - 2, open_weight, 1)
    z, own = np.zeros((len(rows), len(classes))), y
    for f in range(folds):
        back, train = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
        w, b = _fitted(_Sets([sets[i] for i in train], len(words)), y[train], share[train], len(classes), penalty, steps)
        z[back] = _Sets([sets[i] for i in back], len(words)).times(w) + b
    w, b = _fitted(_Sets(sets, len(words)), y, share, len(classes), penalty, steps)
    each = share / share.sum()
    loss = {t: -(each * np.log(_softmax(z / t)[np.arange(len(own)), own] + 1e-12)).sum() for t in (0.1, 0.15, 0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0)}
    temperature = min(loss, key=lambda t: (loss[t], t))
    p = _softmax(z / temperature)
    top = p.argmax(1)
    wrong = p.max(1)[(top != own) & (top < len(classes) - 2)]
    least = min(0.9, max(0.5, float(wrong.max()) if len(wrong) else 0.5))
    used = np.abs(w).max(1) > 1e-6
    weights = {g: tuple(np.round(w[i], 6).tolist()) for g, i in at.items() if used[i]}
    bias = np.round(b, 6)
    # anchors: without them all other classes together stay below none
    over = {g: np.maximum(np.array(v[:-1]) - v[-1], 0) for g, v in weights.items()}
    gap, anchors = bias[-1] - bias[:-1], []
    while over and np.exp(np.minimum((left := sum(over.values()) - gap) / temperature, 50)).sum() >= 1:
        c = int(left.argmax())
        gain: dict[str, float] = {}
        for g, v in over.items():
            for word in g.split(" "):
                if word not in STOP_WORDS:
                    gain[word] = gain.get(word, 0.0) + v[c]
        best = max(gain, key=lambda k: (gain[k], k))
        if gain[best] <= 0:
            break
        anchors.append(best)
        over = {g: v for g, v in over.items() if best not in g.split(" ")}
    return LicenceModel(classes, tuple(bias.tolist()), weights, tuple(sorted(anchors)), temperature, least)


def notice_templates() -> dict[str, list[dict[str, list[str]]]]:
    """Per family and notice: its word pairs, those that no other family's notice has, and its version numbers."""
    split = {name: [tokens(t) for t in notices] for name, notices in {**NOTICES, UNKNOWN_CLASS: UNKNOWN}.items()}
    pairs = {name: [{g for g in grams(w) if " " in g} for w in each] for name, each in split.items()}
    found: dict[str, list[dict[str, list[str]]]] = {}
    for name in NOTICES:
        elsewhere = set().union(*(p for other, each in pairs.items() if other != name for p in each))
        found[name] = [
            {"pairs": sorted(p), "own": sorted(p - elsewhere), "versions": sorted({t for t in w if re.fullmatch(r"[0-9]+(\.[0-9]+)*", t)})} for p, w in zip(pairs[name], split[name], strict=True)
        ]
    return found


def _constant(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), F.lit(kind))


def scan_licences(docs: DataFrame, model: LicenceModel, text_col: str = "text", separator: str = "\n", contained: float = 0.6) -> DataFrame:
    """docs with ``licences``: array<struct<position, label, confidence, confirmed>>, one for each paragraph that is
    not none, in order. Positions count paragraphs from 0; a column of that name is replaced.

    A paragraph with an anchor that is not confirmed by itself is joined with those before and after it, up to one
    without words or one that is confirmed, as many words each way as the longest notice has. It gets a family
    if these together hold one of the family's notices and it holds two word pairs of that notice itself.

    Null and empty texts have an empty array. Repeated rows get equal results. Other columns pass through whatever
    their names. Whole texts are read, however long.
    """
    n = len(model.classes)
    families = n - 2
    by_letter = {a[0]: [x[1:] for x in model.anchors if x[0] == a[0]] for a in model.anchors}
    anchor = "(?<![a-z0-9])(?:" + "|".join(f"{k}(?:{'|'.join(map(re.escape, v))})" for k, v in by_letter.items()) + ")(?![a-z0-9])" if by_letter else ""
    weights = _constant({g: list(v) for g, v in model.weights.items()}, "map<string,array<double>>")
    zero = F.array(*[F.lit(0.0)] * n)
    templates = _constant(notice_templates(), "map<string,array<struct<pairs:array<string>,own:array<string>,versions:array<string>>>>")
    lowered, text = ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), F.col("__text")
    reach = max(len(tokens(t)) for v in NOTICES.values() for t in v)

    def word_array(p: Column) -> Column:
        return F.filter(F.split(p, GAP), lambda t: t != "")

    def gram_array(words: Column) -> Column:
        return F.array_distinct(F.concat(words, F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))))

    def scored(s: Column) -> Column:
        """struct(position, grams) to struct(position, grams, z)."""
        z = F.aggregate(s["grams"], F.array(*[F.lit(x) for x in model.bias]), lambda acc, g: F.zip_with(acc, F.coalesce(F.try_element_at(weights, g), zero), lambda a, b: a + b))
        return F.struct(s["position"].alias("position"), s["grams"].alias("grams"), z.alias("z"))

    def softened(s: Column) -> Column:
        e = F.transform(s["z"], lambda v: F.exp((v - F.array_max(s["z"])) / model.temperature))
        return F.struct(s["position"].alias("position"), s["grams"].alias("grams"), F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)).alias("p"))

    def share_held(template: Column, grams: Column, own: Column | None) -> Column:
        """The share of a notice's pairs that are held: 0 if one of its versions or most of the pairs that only its family has are missing."""
        share = F.size(F.array_intersect(template["pairs"], grams)) / F.size(template["pairs"])
        fits = (F.size(F.array_except(template["versions"], grams)) == 0) & (2 * F.size(F.array_intersect(template["own"], grams)) >= F.size(template["own"]))
        if own is not None:
            fits &= F.size(F.array_intersect(template["pairs"], own)) >= 2
        return F.when(fits, share).otherwise(0.0)

    def judged(s: Column, own: Column | None = None) -> Column:
        """struct(position, grams, p) to the verdict; with grams of its own, a template counts if two of its pairs are among them."""
        families_p = F.slice(s["p"], 1, families)
        best = F.array_max(families_p)
        name = F.get(F.array(*[F.lit(c) for c in model.classes[:families]]), F.array_position(families_p, best).cast("int") - 1)
        held = F.array_max(F.transform(F.try_element_at(templates, name), lambda t: share_held(t, s["grams"], own)))
        none, unknown = F.get(s["p"], n - 1), F.get(s["p"], n - 2)
        known = (best >= model.least) & (best > none) & (best >= unknown) & (held >= contained)
        label = F.when(known, name).when(none >= 0.5, NONE).otherwise(UNKNOWN_CLASS)
        return F.struct(s["position"].alias("position"), label.alias("label"), F.when(known, best).otherwise(1.0 - none).alias("confidence"), known.alias("confirmed"))

    paragraphs = F.transform(F.split(text, re.escape(separator), -1), lambda p, i: F.struct(i.alias("position"), p.alias("p")))
    open_ = F.filter(paragraphs, lambda s: s["p"].rlike(anchor) if anchor else F.lit(True))
    steps = F.transform(open_, lambda s: F.struct(s["position"].alias("position"), gram_array(word_array(s["p"])).alias("grams")))
    steps = F.transform(F.transform(F.transform(steps, scored), softened), lambda s: judged(s))
    empty = F.array().cast("array<struct<position:int,label:string,confidence:double,confirmed:boolean>>")
    gate = text.rlike(anchor) if anchor else F.lit(True)

    def around(lines: Column, before: bool) -> Column:
        """The words of lines up to the first that ends a notice, at most ``reach``; read backwards for those before."""
        start = F.struct(F.array().cast("array<string>").alias("words"), F.lit(True).alias("open"))

        def step(acc: Column, line: Column) -> Column:
            words = word_array(line["p"])
            joined = F.concat(words, acc["words"]) if before else F.concat(acc["words"], words)
            more = acc["open"] & (F.size(acc["words"]) < reach) & line["p"].rlike("[a-z0-9]") & ~F.array_contains("__sure", line["position"])
            return F.when(more, F.struct(joined.alias("words"), F.lit(True).alias("open"))).otherwise(F.struct(acc["words"].alias("words"), F.lit(False).alias("open")))

        words = F.aggregate(F.reverse(lines) if before else lines, start, step)["words"]
        return F.slice(words, F.greatest(F.size(words) - (reach - 1), F.lit(1)) if before else F.lit(1), F.lit(reach))

    def widened(s: Column) -> Column:
        """A verdict to struct(position: the verdict and the grams of its line, grams: those of the line and around it)."""
        at, line = s["position"], word_array(F.get("__lines", s["position"])["p"])
        before = around(F.slice("__lines", F.greatest(at - (reach - 1), F.lit(1)), F.least(at, F.lit(reach))), True)
        after = around(F.slice("__lines", at + 2, F.lit(reach)), False)
        return F.struct(F.struct(s.alias("verdict"), gram_array(line).alias("own")).alias("position"), gram_array(F.concat(before, line, after)).alias("grams"))

    def rejudged(s: Column) -> Column:
        wide, alone = judged(s, s["position"]["own"]), s["position"]["verdict"]
        renewed = F.struct(alone["position"].alias("position"), wide["label"].alias("label"), wide["confidence"].alias("confidence"), wide["confirmed"].alias("confirmed"))
        return F.when(wide["confirmed"], renewed).otherwise(alone)

    out = docs.select(whole_row(docs), lowered.alias("__text")).withColumn("__found", F.when(gate, steps))
    doubtful = F.filter("__found", lambda s: ~s["confirmed"])
    out = out.withColumn("__lines", F.when(F.size(doubtful) > 0, paragraphs)).withColumn("__sure", F.transform(F.filter("__found", lambda s: s["confirmed"]), lambda s: s["position"]))
    again = F.transform(F.transform(F.transform(F.transform(doubtful, widened), scored), softened), rejudged)
    every = F.when(F.size(doubtful) > 0, F.array_sort(F.concat(F.filter("__found", lambda s: s["confirmed"]), again))).otherwise(F.col("__found"))
    found = F.filter(every, lambda s: s["label"] != NONE)
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c != "licences"]
    return out.select(*kept, F.coalesce(found, empty).alias("licences"))


def fit_on(docs: DataFrame, max_paragraphs: int = 1500, text_col: str = "text") -> LicenceModel:
    """Train with the ``max_paragraphs`` distinct paragraphs with the smallest hash among all of whole texts, as rows of class none.

    Paragraphs of any length are drawn, and those that speak of licences are then left out. The driver gets the
    vocabulary's grams that each holds and no text. The sample serves as labelled rows only: the vocabulary does not
    depend on the corpus.
    """
    lowered = ascii_lower(F.col(text_col))
    paragraphs = docs.filter(F.col(text_col).isNotNull()).select(F.explode(F.split(lowered, "\n", -1)).alias("t")).filter(F.btrim("t") != "")
    hashed = paragraphs.select(F.xxhash64("t").alias("h"), "t")
    last = hashed.select("h").distinct().orderBy("h").limit(max_paragraphs).agg(F.max("h")).first()[0]
    if last is None:
        return fit_licences([])
    words = F.filter(F.split("t", GAP), lambda t: t != "")
    drawn = hashed.filter((F.col("h") <= last) & ~F.col("t").rlike("licen[sc]e|copyright|spdx|creative commons|public domain")).select("h", words.alias("w"))
    pairs = F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.concat_ws(" ", a, F.coalesce(b, F.lit(""))))
    held = F.array_sort(F.array_intersect(F.concat("w", pairs), _constant(vocabulary(), "array<string>")))
    return fit_licences([r["g"] for r in drawn.groupBy("h").agg(F.min(held).alias("g")).orderBy("h").collect()])


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its licence (the surest confirmed family, else unknown, else null), confidence and counts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_licences(docs, fit_on(docs)).drop("text")
    sure = F.filter("licences", lambda s: s["confirmed"])
    best = F.array_max(F.transform(sure, lambda s: F.struct(s["confidence"].alias("c"), s["label"].alias("l"))))
    return found.select(
        "doc_id",
        F.when(F.size(sure) > 0, best["l"]).when(F.size("licences") > 0, UNKNOWN_CLASS).alias("license"),
        F.when(F.size(sure) > 0, best["c"]).otherwise(F.array_max(F.transform("licences", lambda s: s["confidence"]))).alias("confidence"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda s: s["label"]))), ",").alias("families"),
        F.size("licences").cast("long").alias("n_paragraphs"),
    )
