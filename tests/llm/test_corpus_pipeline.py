"""The pipeline's stages, each against what a plain reading of its contract gives on the stage's own input."""

import base64
import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tests.llm.test_llm_operators import brute_components, words_of

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    docs, found = spark.read.parquet(f"{D}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, D).write.parquet(path)
        docs = spark.read.parquet(path)
        found.append(docs)
    return found


def test_columns(spark, outputs):
    columns = spark.read.parquet(f"{D}/documents.parquet").columns
    assert [o.columns == columns for o in outputs] == [True] * 4 + [False]


def test_quality_stage(spark, outputs):
    kept = {r["doc_id"] for r in outputs[0].collect()}
    labels = spark.read.parquet(f"{D}/labels.parquet").collect()
    assert np.mean([(r["doc_id"] in kept) == (r["quality"] == 1) for r in labels]) >= 0.95


def test_line_stage(outputs):
    before, after = ({r["doc_id"]: r for r in o.collect()} for o in outputs[:2])
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = collections.Counter(k for r in before.values() for k in {key(x) for x in (r["text"] or "").split("\n")})
    for d, r in before.items():
        want = "\n".join(x for x in (r["text"] or "").split("\n") if not key(x) or held[key(x)] < 10)
        assert after[d]["text"] == want and after[d]["n_chars"] == len(want)


def test_near_duplicate_stage(outputs):
    rows = [(r["doc_id"], r["text"]) for r in outputs[1].collect()]
    want = {d for d, (_, c) in brute_components(rows, 5).items() if d == c}
    assert {r["doc_id"] for r in outputs[2].collect()} == want


def test_mixing_stage(outputs):
    before = {r["doc_id"]: r for r in outputs[2].collect()}
    copies = collections.Counter(r["doc_id"] for r in outputs[3].collect())
    assert set(copies) <= set(before) and max(copies.values()) <= 2
    words, total = collections.Counter(), sum(len(words_of(r["text"])) for r in before.values())
    for d, n in copies.items():
        words[before[d]["source"]] += n * len(words_of(before[d]["text"]))
    assert abs(sum(words.values()) - 1.5 * total) <= 0.3 * total


def test_encoding_stage(outputs):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in outputs[3].collect()}
    out = outputs[4].collect()
    assert len(out) == outputs[3].count()
    for r in out:
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_run_agrees_with_stages(spark, outputs):
    assert sorted(map(tuple, corpus_pipeline.run(spark, D).collect())) == sorted(map(tuple, outputs[4].collect()))


ODD = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, __text string, row string, id long, rows long, kept_id string"


def test_stages_on_odd_rows(spark):
    """Nulls everywhere, repeated rows, ids with several texts, a very long text and columns with clashing names, through all stages."""
    good = [r["text"] for r in spark.read.parquet(f"{D}/documents.parquet").join(spark.read.parquet(f"{D}/labels.parquet").filter("quality = 1"), "doc_id").orderBy("doc_id").limit(12).collect()]
    long = "\n".join(f"{t} {i}" for i, t in enumerate(good * 40))
    rows = [(i, t, "en", f"s{i % 2}", 1) for i, t in enumerate(good)] + [(0, good[0], "en", "s0", 1), (0, good[0], None, None, None), (0, good[1], "en", "s0", 1), (None, good[2], "en", "s1", 1), (None, good[2], "en", "s1", 1), (50, None, None, None, None), (51, "", "en", "s1", 0), (52, long, "en", "s1", 1)]
    docs = spark.createDataFrame([(*r, f"p{i}", f"q{i}", f"r{i}", i, i, f"k{i}") for i, r in enumerate(rows)], ODD)
    assert corpus_pipeline.quality(spark, docs, D).columns == docs.columns
    held = corpus_pipeline.lines(spark, docs, D)
    assert held.columns == docs.columns and held.count() == len(rows)
    once = corpus_pipeline.near_duplicates(spark, docs, D)
    kept = [(r["doc_id"], r["text"]) for r in once.collect()]
    assert once.columns == docs.columns and kept.count((0, good[0])) == 1 and kept.count((0, good[1])) == 1 and kept.count((None, good[2])) == 2 and (1, good[1]) not in kept and (52, long) in kept and (50, None) in kept
    mixed = corpus_pipeline.mixture(spark, once, D)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        i = r["id"]
        assert (r["a.b"], r["__text"], r["row"], r["rows"], r["kept_id"]) == (f"p{i}", f"q{i}", f"r{i}", i, f"k{i}") and (r["doc_id"], r["text"]) == rows[i][:2]
    encoded = corpus_pipeline.encoding(spark, docs, D)
    assert encoded.count() == len(rows) and encoded.filter("doc_id = 50").first()["n_tokens"] == 0


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], ODD)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, D)
        assert out.isEmpty()
