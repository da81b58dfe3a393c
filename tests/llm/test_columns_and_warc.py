"""Columns of any name through the operators that run Python, and WARC files read in a stream."""

import gzip
import hashlib
import os
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tenantry.llm import byte_bpe, token_counts, warc

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def odd_columns(spark):
    """Names with dots, names that the operators use themselves, and numbers that a float cannot hold beside nulls."""
    rows = [((1 << 60) + i if i % 3 else None, t, f"d{i}", f"u{i}", f"h{i}", i, (i, f"s{i}"), {"k": f"{i}"}) for i, t in enumerate(["one two\nthree", None, "", "é日本", "x y z\n" * 50_000])]
    return spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, __text string, held_text string, c0 int, `x.y` struct<n:int,s:string>, m map<string,string>").withColumn("when", F.lit("2024-01-02 03:04:05").cast("timestamp"))


OWN = ["doc_id", "a.b", "__text", "held_text", "c0", "x.y", "m", "when"]


def same(before, after):
    pick = lambda df: sorted((tuple(r[c] for c in OWN) for r in df.collect()), key=repr)
    return pick(before) == pick(after)


def test_token_counts_pass_columns_through(odd_columns):
    out = token_counts.count_tokens(odd_columns, *BPE)
    assert out.columns == [*OWN, "n_tokens", "n_crossing", "outside", "sections"] and same(odd_columns, out)
    spans = odd_columns.withColumn("my.spans", F.array(F.struct(F.lit("all").alias("name"), F.lit(0).alias("start"), F.lit(None).cast("int").alias("end"))))
    given = token_counts.count_tokens(spans, *BPE, sections="my.spans")
    assert same(odd_columns, given) and all(r["sections"][0]["tokens"] == r["n_tokens"] for r in given.collect())


def test_bpe_passes_columns_through(odd_columns):
    out = byte_bpe.encode_documents(odd_columns, *BPE, with_ids=True)
    assert out.columns == [*OWN, "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and same(odd_columns, out)
    assert {r["c0"]: r["decoded_sha256"] for r in out.collect()} == {r["c0"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in odd_columns.collect()}
    other = byte_bpe.encode_documents(odd_columns.withColumnRenamed("text", "t.x"), *BPE, text_col="t.x")
    assert other.count() == 5 and "t.x" not in other.columns
    assert byte_bpe.encode_documents(odd_columns.limit(0), *BPE).isEmpty() and token_counts.count_tokens(odd_columns.limit(0), *BPE).isEmpty()


def test_warc_passes_columns_through(odd_columns):
    responses = odd_columns.select("*", F.when(F.col("c0") != 1, F.col("held_text")).alias("record_id"), F.lit("u").alias("target_uri"), F.lit(None).cast("string").alias("date"), F.encode("text", "UTF-8").alias("block"))
    out = warc.derivatives(responses)
    assert out.count() == 10 and same(odd_columns.unionByName(odd_columns), out)
    by = {(r["c0"], r["warc_type"]): r for r in out.collect()}
    assert bytes(by[4, "conversion"]["block"]) == b"x y z\n" * 49_999 + b"x y z" and bytes(by[1, "conversion"]["block"]) == b"" and by[0, "metadata"]["headers"] == {}
    assert all(by[i, "metadata"]["refers_to"] == by[i, "conversion"]["refers_to"] for i in range(5)) and warc.derivatives(responses.limit(0)).isEmpty()


def record(i, block, kind="response"):
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <r{i}>\r\nWARC-Target-URI: http://x/{i}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_warc_reader_is_linear():
    piece = [gzip.compress(record(i, os.urandom(4000))) for i in range(50)]

    def took(mb):
        n = mb * 1_000_000 // len(piece[0])
        raw, began = b"".join(piece[i % 50] for i in range(n)), time.perf_counter()
        assert sum(len(b) == 4000 for _, b in warc.parse_records(raw)) == n
        return time.perf_counter() - began

    took(2)
    assert took(64) < 20 * max(took(8), 0.05)


def test_warc_reader_holds_no_file():
    def blocks():
        for i in range(400):
            yield record(i, b"WARC/ in a text\r\n\r\n" * 20_000)

    assert sum(1 for _ in warc.parse_records(blocks())) == 400
    cut = b"".join(record(i, b"z" * 100) for i in range(3))[:-50]
    assert [len(b) for _, b in warc.parse_records([cut[i : i + 7] for i in range(0, len(cut), 7)])] == [100, 100, 54]
    assert list(warc.parse_records(b"")) == [] and list(warc.parse_records(b"no record")) == []


@pytest.mark.parametrize("stream", [True, False])
def test_warc_files_through_spark(spark, tmp_path, stream):
    blocks = [b"", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>hi</p>", os.urandom(1 << 20), b"WARC/1.0\r\n\r\n"]
    (tmp_path / "plain.warc").write_bytes(b"".join(record(i, b) for i, b in enumerate(blocks)) + record(9, b"no", "request"))
    (tmp_path / "each.warc.gz").write_bytes(b"".join(gzip.compress(record(i + 10, b)) for i, b in enumerate(blocks)) + b"\0" * 100)
    (tmp_path / "empty.warc").write_bytes(b"")
    got = {r["record_id"]: (r["target_uri"], bytes(r["block"])) for r in warc.read_responses(spark, str(tmp_path), stream).collect()}
    assert got == {f"<r{k + i}>": (f"http://x/{k + i}", b) for k in (0, 10) for i, b in enumerate(blocks)}


def test_pages_with_signs_in_values_and_bodies_cut_off():
    assert warc.plain_text("<p title=\"x>y\">b</p><a href='a>b'>c</a>") == "b\nc"
    assert warc.plain_text("<p class=it's>d</p> it's <b x=\"open>e</b>") == "d\nit's e"
    text = bytes(range(256)) * 400
    for kind, body in (("gzip", gzip.compress(text)), ("deflate", __import__("zlib").compress(text))):
        cut = warc.decoded_body({"content-encoding": kind}, body[: len(body) // 2])
        assert len(cut) > 1000 and text.startswith(cut) and warc.decoded_body({"content-encoding": kind}, body) == text
