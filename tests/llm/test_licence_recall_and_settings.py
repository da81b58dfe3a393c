"""Licences that nobody trained on, calibration, a plain reading of licence scores; recall of the hash settings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenantry.llm import embedding_dedup, license_scan, quality_rules

D = "/root/testdata/sf0.001"

# Declarations of twelve licences of which no notice and no name is in the training data.
HELD_OUT = [
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
    "This is free and unencumbered software released into the public domain.",
    "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE, Version 2, December 2004",
    "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "Distributed under the Boost Software License, Version 1.0.",
    "Licensed under the EUPL, Version 1.2",
    "This package is free software; you may redistribute it under the terms of the Artistic License 2.0.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License (the License).",
    "Use of this software is governed by the Business Source License included in the file.",
    "This program is licensed under the Server Side Public License, version 1.",
]
ORDINARY = [
    "The committee released its findings to the public under protest.",
    "He drove without a license for two years.",
    "The software team had lunch.",
    "This version of events is disputed.",
    "The terms of the peace were harsh.",
    "You may copy the recipe for your friends.",
    "Free entry; permission of the owner is required.",
    "The Mozilla office in Berlin closed.",
    "Creative people work in commons rooms.",
    "The author signed copies of the book at the fair.",
    "A source close to the foundation denied the report.",
    "The museum distributed a free map to its visitors.",
]


@pytest.fixture(scope="module")
def model(spark):
    return license_scan.fit_on(spark.read.parquet(f"{D}/documents.parquet"))


def probabilities(model, text):
    z = np.array(model.bias)
    for g in license_scan.grams(license_scan.tokens(text)):
        if g in model.weights:
            z = z + np.array(model.weights[g])
    e = np.exp((z - z.max()) / model.temperature)
    return dict(zip(model.classes, e / e.sum(), strict=True))


def scanned(spark, model, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r["licences"] for r in license_scan.scan_licences(df, model).orderBy("i").collect()]


def test_licences_not_trained_on_are_unknown(spark, model):
    trained = {n for _, _, n in license_scan._notices()}
    assert not trained & set(HELD_OUT)
    found = scanned(spark, model, HELD_OUT)
    assert np.mean([[x["label"] for x in f] == ["unknown"] for f in found]) >= 0.8
    assert not any(x["confirmed"] for f in found for x in f)
    assert np.mean([f == [] for f in scanned(spark, model, ORDINARY)]) >= 0.9


def test_licence_probabilities_are_calibrated(model):
    """Over bins of confidence, the share that is right is near the confidence; the temperature is inside its grid."""
    cases = [(t, "unknown") for t in HELD_OUT] + [(t, "none") for t in ORDINARY]
    cases += [(f"As the readme says: {n} More below.", name) for name, notices in license_scan.NOTICES.items() for n in notices]
    said = [max(probabilities(model, t).items(), key=lambda x: x[1]) + (want,) for t, want in cases]
    sure, right = np.array([p for _, p, _ in said]), np.array([got == want for got, _, want in said])
    bins = np.minimum((sure * 5).astype(int), 4)
    error = sum((bins == b).mean() * abs(sure[bins == b].mean() - right[bins == b].mean()) for b in set(bins))
    assert error <= 0.12 and right.mean() >= 0.9
    assert 0.1 < model.temperature < 3.0 and 0.5 <= model.least <= 0.9


def test_licence_labels_by_a_plain_reading(spark, model):
    """Texts of one line: no line around them can change a verdict, so it follows from the score and the templates."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    lines = [r["t"] for r in docs.select(F.explode(F.split("text", "\n")).alias("t")).filter("t rlike '(?i)licen[sc]e|copyright|software|granted'").distinct().collect()]
    texts = lines + HELD_OUT + ORDINARY + [n for v in license_scan.NOTICES.values() for n in v] + ["", "plain words", "MIT licensed, see LICENSE."]
    templates = license_scan.notice_templates()

    def label(text):
        grams, p = license_scan.grams(license_scan.tokens(text)), probabilities(model, text)
        name = max(list(license_scan.NOTICES), key=lambda n: p[n])
        held = max(len(grams & set(t["pairs"])) / len(t["pairs"]) if set(t["versions"]) <= grams and 2 * len(grams & set(t["own"])) >= len(t["own"]) else 0 for t in templates[name])
        if p[name] >= model.least and p[name] > p["none"] and p[name] >= p["unknown"] and held >= 0.6:
            return [name]
        return [] if p["none"] >= 0.5 else ["unknown"]

    assert [[x["label"] for x in f] for f in scanned(spark, model, texts)] == [label(t) for t in texts]


def test_licence_sample_draws_long_paragraphs_and_no_text(spark):
    """A paragraph is drawn by its hash whatever its length; an empty table and one without other text still give a model."""
    long = spark.createDataFrame([(1, "apache helicopter words " * 5000), (2, None), (3, "")], "doc_id long, text string")
    for docs in (long, long.limit(0)):
        m = license_scan.fit_on(docs)
        assert scanned(spark, m, ["Released under the MIT License.", "apache helicopter"])[0][0]["label"] == "MIT"


@pytest.mark.parametrize("d", [64, 256])
@pytest.mark.parametrize("functions", [2, 3, 4])
def test_vectors_meet_at_the_threshold(d, functions):
    """Pairs at a cosine of exactly 0.9, the hardest that count, under the settings of ever larger inputs."""
    vertices = 2 * d
    n = int(8 * vertices ** (functions - 0.5))
    chosen = embedding_dedup.settings(n, d)
    assert chosen[0] == functions
    rng = np.random.default_rng(d + functions)
    a = rng.normal(size=(400, d))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1)[:, None] * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1)[:, None]
    ca, cb = embedding_dedup.bucket_codes(a, *chosen), embedding_dedup.bucket_codes(b, *chosen)
    met = ((ca[:, :, :1] == cb) | (cb[:, :, :1] == ca)).any(2).any(1)
    assert met.mean() >= 0.995


def test_quality_rules_use_all_starts():
    assert quality_rules.STARTS >= 12 and quality_rules.TRIAL == 2 and quality_rules.GO_ON >= 3
