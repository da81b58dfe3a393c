"""The operators against brute force, round trips and odd inputs."""

import base64
import collections
import gzip
import hashlib
import re
import textwrap
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tenantry.llm import byte_bpe, common, components, embedding_dedup, license_scan, line_dedup, minhash_dedup, mixing, quality_ranker, quality_rules, token_counts, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
ODD = [
    (1, "", "en", "a"),
    (2, None, None, None),
    (3, "   \n\t \n", "en", "a"),
    (4, "one", "en", "b"),
    (4, "one", "en", "b"),
    (5, "a b c d e f g h " * 40, "de", "b"),
    (6, "Ärger über Öl \U0001f600 x퟿ <|endoftext|>\n\nname: value\n", "de", None),
    (7, "z" * 5000, "en", "a"),
    (8, "a b c d e f g h " * 40, "de", "b"),
    (None, "no id", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in ODD], SCHEMA + ", id string, n long")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def words_of(text):
    return WORD.findall(text or "")


# 1 licences


@pytest.fixture(scope="module")
def licence_model(docs):
    return license_scan.fit_on(docs)


def test_licences_find_every_notice(spark, licence_model):
    rows = [(name, f"Some text before.\n{n}\nSome text after.") for name, notices in license_scan.NOTICES.items() for n in notices]
    found = license_scan.scan_licences(spark.createDataFrame(rows, "name string, text string"), licence_model).collect()
    right = [any(x["label"] == r["name"] and x["position"] == 1 for x in r["licences"]) for r in found]
    assert np.mean(right) >= 0.95
    plain = spark.createDataFrame([(n,) for n in license_scan.NOT_LICENCES], "text string")
    assert license_scan.scan_licences(plain, licence_model).filter(F.exists("licences", lambda x: x["confirmed"])).isEmpty()


def test_licences_find_wrapped_notices(spark, licence_model):
    rows = [(name, "Some text before.\n" + textwrap.fill(license_scan.NOTICES[name][1], width) + "\nSome text after.") for name in ("MIT", "GPL-3.0", "LGPL", "BSD", "ISC") for width in (40, 60, 77)]
    rows += [(name, "/*\n * " + t.replace("\n", "\n * ") + "\n */") for name, t in rows]
    df = spark.createDataFrame(rows, "name string, text string")
    for r in license_scan.scan_licences(df, licence_model).collect():
        assert {x["label"] for x in r["licences"] if x["confirmed"]} == {r["name"]}, r
    apart = "Licensed under the Apache License, Version 2.0.\nLicensed under the Example Community License, version 1.1."
    found = license_scan.scan_licences(spark.createDataFrame([(apart,)], "text string"), licence_model).first()["licences"]
    assert [(x["position"], x["label"]) for x in found] == [(0, "Apache-2.0"), (1, "unknown")]


def test_licences_tell_versions_and_names_apart(spark, licence_model):
    """Near notices of other licences are confirmed as none of the families; other wordings of the families' are."""
    near = ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the Eclipse Public License, version 2.0.", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."]
    found = license_scan.scan_licences(spark.createDataFrame([(n,) for n in near], "text string"), licence_model).collect()
    assert not [r for r in found if any(x["confirmed"] for x in r["licences"])]
    right = {"GPL-3.0": "This project is licensed under the GNU General Public License, version 3, by its authors.", "MPL-2.0": "All of it is licensed under the Mozilla Public License, version 2.0, as before.", "Apache-2.0": "The tool is licensed under the Apache License, Version 2.0 since May."}
    found = license_scan.scan_licences(spark.createDataFrame(list(right.items()), "name string, text string"), licence_model).collect()
    assert all([x["label"] for x in r["licences"] if x["confirmed"]] == [r["name"]] for r in found)


def test_licences_anchor_gate_changes_nothing(spark, docs, licence_model):
    from dataclasses import replace

    some = docs.limit(60).select("doc_id", "text")
    open_model = replace(licence_model, anchors=())
    a, b = (sorted((r["doc_id"], str(r["licences"])) for r in license_scan.scan_licences(some, m).collect()) for m in (licence_model, open_model))
    assert a == b


def test_licences_odd(odd, empty, licence_model):
    assert license_scan.scan_licences(odd, licence_model).filter(F.size("licences") != 0).isEmpty()
    assert license_scan.scan_licences(empty, licence_model).isEmpty()


# 2 embeddings


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 16)) * 0.1, np.repeat(base[:1], 30, 0) + rng.normal(size=(30, 16)) * 0.2, base[5:6], 2 * base[6:7]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    out = {r["vec_id"]: r for r in embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    link = (y @ y.T >= 0.9) & ~np.eye(len(y), dtype=bool)
    comp = list(range(len(y)))
    for _ in comp:
        comp = [min([comp[i], *(comp[j] for j in np.flatnonzero(link[i]))]) for i in range(len(y))]
    assert sum(r["n_links"] for r in out.values()) >= 0.97 * link.sum()
    assert all(out[i]["n_links"] <= link[i].sum() for i in out)
    assert np.mean([out[i]["component_id"] == comp[i] for i in out]) >= 0.97


def test_embeddings_hot_bucket_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(6)
    rows = [(i, (np.ones(8) + rng.normal(size=8) * 0.01).tolist()) for i in range(100)]
    out = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r["n_links"], r["component_id"]) for r in out} == {(99, 0)}


def test_embeddings_odd(spark):
    nan = float("nan")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [1.0, 2.0, 3.0]), (7, [2.0, 4.0]), (None, [1.0, 2.0]), (8, [])]
    out = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in out) == sorted(
        [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 2, 5, True), (5, 2, 5, True), (6, 0, 6, True), (7, 2, 5, False), (0, 0, 0, True), (8, 0, 8, True)]
    )
    assert embedding_dedup.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).isEmpty()


# 3 token counts

BPE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def plain_encoding(name="byte_bpe_50k.tiktoken"):
    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_against_loops(spark, docs, rule):
    enc, rows = plain_encoding(), []
    for r in docs.limit(25).collect():
        n = len(r["text"])
        rows.append((r["doc_id"], r["text"], [("b", n // 3, n // 2), ("a", 0, n // 3), ("c", n // 2 + 3, n)]))
    df = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<name:string,start:int,end:int>>")
    for r in token_counts.count_tokens(df, *BPE, sections="parts", rule=rule).collect():
        text = next(t for d, t, _ in rows if d == r["doc_id"])
        at, want, outside, ids = 0, collections.Counter(), 0.0, enc.encode_ordinary(text)
        spans = [(s["name"], len(text[: s["start"]].encode()), len(text[: s["end"]].encode())) for s in r["sections"]]
        for i in ids:
            end = at + len(enc.decode_single_token_bytes(i))
            held = {k: max(0, min(b, end) - max(a, at)) for k, a, b in spans}
            if rule == "share":
                for k, v in held.items():
                    want[k] += v / (end - at)
                outside += 1 - sum(held.values()) / (end - at)
            else:
                first = next((k for k, a, b in spans if a <= at < b), None)
                best = max(("a", "b", "c"), key=lambda k: held[k])
                k = first if rule == "start" else best if held[best] else None
                if k is None:
                    outside += 1
                else:
                    want[k] += 1
            at = end
        assert r["n_tokens"] == len(ids)
        assert r["outside"] == pytest.approx(outside, abs=1e-6)
        assert {s["name"]: s["tokens"] for s in r["sections"]} == pytest.approx({k: want[k] for k in "abc"}, abs=1e-6)


def test_token_counts_long_text_in_parts(monkeypatch):
    text = "ab cd.\nnext  line\n\n third \n x\ny" * 50
    whole = token_counts.token_ends(text, *BPE)
    monkeypatch.setattr(token_counts, "PART", 40)
    assert (token_counts.token_ends(text, *BPE) == whole).all()


def test_token_counts_of_overlapping_sections():
    text = "one two three four five six seven"
    ends = token_counts.token_ends(text, *BPE)
    for spans in ([(0, 20), (10, 33)], [(10, 33), (0, 20)], [(0, 33), (3, 9), (5, 40)]):
        counts, _, outside = token_counts.attribute(ends, text, np.array(spans), "most")
        first = min(range(len(spans)), key=lambda i: spans[i][0])
        assert counts.sum() + outside == len(ends) and outside == 0
        alone, _, rest = token_counts.attribute(ends, text, np.array([spans[first]]), "start")
        assert abs(counts[first] - alone[0]) <= 1 and abs(counts.sum() - counts[first] - rest) <= 1


def test_token_counts_odd(odd, empty):
    out = token_counts.count_tokens(odd, *BPE).collect()
    assert len(out) == len(ODD) and "id" in out[0].asDict()
    assert all(sum(s["tokens"] for s in r["sections"]) == r["n_tokens"] for r in out)
    assert token_counts.count_tokens(empty, *BPE).isEmpty()


# 4 WARC


def parse(raw):
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines)
    n = int(headers["Content-Length"])
    assert version == "WARC/1.1" and rest[n:] == b"\r\n\r\n"
    return headers, rest[:n]


def test_warc_round_trip(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    responses = warc.responses_of_pages(pages)
    source = {r["record_id"]: r for r in responses.collect()}
    records = warc.serialise(warc.derivatives(responses)).collect()
    assert len(records) == 2 * len(source)
    for r in records:
        headers, block = parse(bytes(r["warc"]))
        origin = source[headers["WARC-Refers-To"]]
        payload = bytes(origin["block"]).partition(b"\r\n\r\n")[2]
        assert headers["WARC-Target-URI"] == origin["target_uri"] and headers["WARC-Payload-Digest"] == warc.digest(payload)
        assert headers["WARC-Block-Digest"] == warc.digest(block) and block == bytes(r["block"])
        assert r["headers"]["source-content-type"] == "text/html; charset=utf-8"
        if r["warc_type"] == "metadata":
            about = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if x)
            conversion = next(x for x in records if x["record_id"] == about["conversion"])
            assert conversion["refers_to"] == r["refers_to"] and about["text-digest"] == conversion["block_digest"]


def test_warc_plain_text_and_odd(spark):
    assert warc.plain_text("<title>T &amp; U</title><script>if (a<b) x='</p>'</script><p>a<b>b</b>\n c<br>d<!-- <p>no --> &lt;tag&gt;<td>1</td><td>2</td><style>p{}") == "T & U\nab\nc\nd <tag> 1 2"
    rows = [(1, None, None, None, None), (2, "r", "u", "d", bytearray(b"bare \xff payload")), (3, "s", "u", "d", bytearray(b""))]
    out = warc.derivatives(spark.createDataFrame(rows, "block_digest int, record_id string, target_uri string, date string, block binary"))
    assert out.count() == 6 and out.columns.count("block_digest") == 1
    assert warc.derivatives(spark.createDataFrame([], "record_id string, target_uri string, date string, block binary")).isEmpty()


@pytest.mark.parametrize(
    "between, shown",
    [
        ("<svg-icon></svg-icon>", ""), ('<svg width="1"/>', ""), ("<template-card>in</template-card>", "in\n"), ("<svg/><p>mid</p><svg><text>no</text></svg>", "mid\n"),
        ('<svg data-x="a>b" /><p>mid</p><svg></svg>', "mid\n"), ("<svg><p>mid</p><noscript>", "mid\n"), ("<SVG>no</svg><template>no</template><noscript >no</noscript >", ""),
    ],
)
def test_warc_plain_text_goes_on_after_tags_without_end(between, shown):
    assert warc.plain_text(f"<p>one</p>{between}<p>two</p>") == f"one\n{shown}two"
    assert warc.plain_text(f"<p>one</p>{between}<p><script-x>two</script-x><script>no") == f"one\n{shown}two"


def test_warc_keeps_all_source_headers():
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nLocation: /x\r\nLink: <a>\r\nX-Robots-Tag: noindex,\r\n nofollow\r\nLINK: <b>\r\nDate: d\r\n\r\n"
    want = {"source-content-type": "text/html; charset=utf-8", "source-location": "/x", "source-link": "<a>, <b>", "source-x-robots-tag": "noindex, nofollow", "source-date": "d"}
    metadata, conversion = warc.derive("r", None, None, head + b"<p>one</p>")
    assert metadata["headers"] == conversion["headers"] == want
    assert want.items() <= dict(x.split(": ", 1) for x in metadata["block"].decode().split("\r\n") if x).items()


def test_warc_encoded_bodies_and_hostile_pages():
    page = "<html lang='en'><title>T</title><p>a</p><p>b <a href=x>l</a></p>".encode()
    chunked = b"".join(b"%x;ext\r\n%s\r\n" % (len(page[i : i + 7]), page[i : i + 7]) for i in range(0, len(page), 7)) + b"0\r\n\r\n"
    for head, body in ((b"Transfer-Encoding: chunked", chunked), (b"Content-Encoding: gzip", gzip.compress(page)), (b"Content-Encoding: deflate", zlib.compress(page)), (b"Content-Encoding: gzip", page)):
        metadata, conversion = warc.derive("r", None, None, b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body)
        assert conversion["block"] == b"T\na\nb l" and conversion["payload_digest"] == warc.digest(body)
        about = dict(x.split(": ", 1) for x in metadata["block"].decode().split("\r\n") if x)
        assert (about["title"], about["language"], about["outlinks"]) == ("T", "en", "1")
    for mark in ("<a ", "<title>", "<![CDATA[", "<p ", "<svg ", "<td <", "<svg '", "<!", "<html "):
        for end in ("", ">"):
            began = time.time()
            warc.derive("r", None, None, (mark * (1_000_000 // len(mark)) + end).encode())
            assert time.time() - began < 2, mark


def test_warc_reader(spark, tmp_path):
    records = warc.serialise(warc.derivatives(spark.createDataFrame([("<r>", "u", "d", bytearray(b"HTTP/1.1 200 OK\r\n\r\n<p>x"))], "record_id string, target_uri string, date string, block binary"))).collect()
    response = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r>\r\nWARC-Target-URI: u\r\nWARC-Date: d\r\nContent-Length: 9\r\n\r\n<p>WARC/x\r\n\r\n"
    plain = response + b"".join(bytes(r["warc"]) for r in records) + response
    (tmp_path / "a.warc").write_bytes(plain)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(response) + gzip.compress(bytes(records[0]["warc"])))
    got = sorted((r["record_id"], r["target_uri"], r["date"], bytes(r["block"])) for r in warc.read_responses(spark, str(tmp_path)).collect())
    assert got == [("<r>", "u", "d", b"<p>WARC/x")] * 3


# 5 quality rules


def base_statistics(text):
    w = words_of(text)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    at = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(at)


def test_quality_rules_statistics(spark, docs, odd, empty):
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for df in (docs, odd.select("doc_id", "text", "lang", "source")):
        got = collections.Counter((r["doc_id"], *(r[c] for c in cols)) for r in quality_rules.quality_verdicts(df).collect())
        assert got == collections.Counter((r["doc_id"], *base_statistics(r["text"])) for r in df.collect())
    assert quality_rules.quality_verdicts(empty).isEmpty()


def brute_mcd(x, rng):
    """Mean and scaled covariance of the half of x with the least determinant, over many starts, as numpy has them."""
    ridge, half, best = quality_rules.RIDGE * np.eye(4), (len(x) + 1) // 2, None
    for _ in range(40):
        at = rng.permutation(len(x))[: min(len(x), 6)]
        for _ in range(30):
            m, c = x[at].mean(0), np.cov(x[at].T, bias=True).reshape(4, 4) + ridge
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            at = np.argsort(d, kind="stable")[:half]
        if best is None or np.linalg.det(c) < best[0]:
            best = np.linalg.det(c), m, c * max(np.sort(d)[half - 1] / quality_rules.CHI2_MEDIAN, 1.0)
    return best[1], best[2], best[0]


def test_quality_rules_against_brute_force_mcd(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    stats = quality_rules.text_statistics(docs.select("doc_id", "lang", "source", "text"))
    rows = stats.select("doc_id", "lang", "source", *[c.alias(x) for c, x in zip(quality_rules.statistic_vector(), quality_rules.X, strict=True)]).collect()
    got, rng, groups = {r["doc_id"]: r for r in quality_rules.quality_verdicts(docs).collect()}, np.random.default_rng(2), collections.defaultdict(set)
    for r in rows:
        for g in ((r["lang"], r["source"]), (r["lang"],), ()):
            groups[g].add(tuple(r[x] for x in quality_rules.X))
    own = {g: brute_mcd(np.array(sorted(v)), rng) for g, v in groups.items()}

    def shrunk(g):
        m, c, _ = own[g]
        if g:
            w, (wide, cov) = len(groups[g]) / (len(groups[g]) + quality_rules.PRIOR), shrunk(g[:-1])
            d = m - wide
            m, c = w * m + (1 - w) * wide, w * c + (1 - w) * cov + w * w * (1 - w) * np.outer(d, d)
        return m, c

    final, agree, close = {g: shrunk(g) for g in own}, [], []
    for r in rows:
        m, c = final[r["lang"], r["source"]]
        d = np.array([r[x] for x in quality_rules.X]) - m
        want = d @ np.linalg.inv(c) @ d
        agree.append((got[r["doc_id"]]["distance"] <= quality_rules.chi2_bound(quality_rules.TAIL)) == (want <= quality_rules.chi2_bound(quality_rules.TAIL)))
        close.append(got[r["doc_id"]]["distance"] / want)
    assert np.mean(agree) >= 0.99 and 0.8 < np.median(close) < 1.25


def test_chi2_bound():
    assert quality_rules.chi2_bound(0.001) == pytest.approx(18.4668, abs=1e-3) and quality_rules.chi2_bound(0.5) == pytest.approx(quality_rules.CHI2_MEDIAN, abs=1e-3)


def test_quality_rules_copies_count_once(spark):
    good = [(i, " ".join(f"word{(i * 7 + j * j) % 997}" for j in range(100 + i % 50)) + ".", "en", "s") for i in range(200)]
    bad = [(1000 + i, " ".join(f"{'#$%' * 30}{j}" for j in range(60)), "en", "s") for i in range(300)]  # more than half
    out = quality_rules.quality_verdicts(spark.createDataFrame(good + bad, SCHEMA)).collect()
    assert all(r["kept"] == (r["doc_id"] < 1000) for r in out)


def test_quality_rules_estimates_without_broadcast(spark, docs, monkeypatch):
    plain = sorted((r["doc_id"], r["kept"]) for r in quality_rules.quality_verdicts(docs).collect())
    monkeypatch.setattr(quality_rules, "MOST_GROUPS", 0)
    assert sorted((r["doc_id"], r["kept"]) for r in quality_rules.quality_verdicts(docs).collect()) == plain


def test_quality_rules_reject_outliers(spark, docs):
    good = [(i, " ".join(f"word{(i * 7 + j * j) % 997}" for j in range(100 + i % 50)) + ".", "en", "s") for i in range(300)]
    bad = [(1000 + i, " ".join(f"{'#$%' * 30}{j}" for j in range(60)), "en", "s") for i in range(5)]
    out = quality_rules.quality_verdicts(spark.createDataFrame(good + bad, SCHEMA)).collect()
    assert all(r["kept"] == (r["doc_id"] < 1000) for r in out)


def test_quality_rules_reject_copies_of_one_outlier(spark):
    good = [(i, " ".join(f"word{(i * 7 + j * j) % 997}" for j in range(100 + i % 50)) + ".", "en", "s") for i in range(390)]
    bad = [(1000 + i, " ".join(f"{'#$%' * 30}{j}" for j in range(60)), "en", "s") for i in range(210)]  # 35% of the group
    out = quality_rules.quality_verdicts(spark.createDataFrame(good + bad, SCHEMA)).collect()
    assert not any(r["base_failed"] for r in out) and all(r["kept"] == (r["doc_id"] < 1000) for r in out)


def test_quality_rules_small_groups_have_estimates_of_their_own(spark):
    text = lambda i, mark: " ".join(f"word{(i * 7 + j * j) % 997}{mark}" for j in range(100 + i % 50))
    rows = [(i, text(i, ""), "en", "a") for i in range(100)] + [(100 + i, text(i, "#$%" * 9), "en", "b") for i in range(60)]
    assert all(r["kept"] for r in quality_rules.quality_verdicts(spark.createDataFrame(rows, SCHEMA)).collect())


# 6 quality ranker


def test_ranker_held_out_accuracy(spark):
    from tenantry.llm.queries import QUERIES

    d = "/root/testdata/sf0.01"
    out = QUERIES["op6_quality_ranker"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in out]) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    assert quality_ranker.held_out(F.lit(1)) is not None and zlib.crc32(b"1") % 4 != 2


def test_ranker_never_reads_held_out_labels(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    spoiled = labels.withColumn("quality", F.when(quality_ranker.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality_ranker.fit_ranker(docs, labels) == quality_ranker.fit_ranker(docs, spoiled)


def test_ranker_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, None), (5, 1), (99, 1)], "doc_id long, quality int")
    ranker = quality_ranker.fit_ranker(odd, labels)
    out = quality_ranker.score_documents(odd, ranker).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    nothing = quality_ranker.fit_ranker(empty, labels.limit(0))
    assert quality_ranker.score_documents(empty, nothing).isEmpty()


def test_ranker_score_brute_force(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 4000, 7)], "doc_id long, quality int")
    ranker = quality_ranker.fit_ranker(docs, labels)
    assert any(ranker.weights) and any(ranker.grams)
    some = docs.select("doc_id", "text").orderBy("doc_id").limit(20)
    features = {r["row"]["doc_id"]: r["x"] for r in quality_ranker.with_features(some, "text", "x").collect()}
    for r in quality_ranker.score_documents(some, ranker).collect():
        w = words_of(r["text"] or "")
        hashed = [xxhash.xxh64_intdigest(a.encode(), 42) for a in w]
        # the hash of a pair is that of its second word, seeded with that of the first
        hashed += [xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42)) for a, b in zip(w, w[1:])]
        signed = [h - (1 << 64) if h >> 63 else h for h in hashed]
        z = [max(-quality_ranker.CLIP, min(quality_ranker.CLIP, (x - m) / c)) for x, m, c in zip(features[r["doc_id"]], ranker.mean, ranker.scale)]
        raw = ranker.offset + np.dot(z, ranker.weights) + sum(ranker.grams[h % quality_ranker.BUCKETS] for h in signed) / (len(hashed) + quality_ranker.PRIOR)
        assert abs(r["score"] - 1 / (1 + np.exp(-raw))) < 1e-9


def test_ranker_learns_words():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 1500)
    # labels that no statistic tells, only how often the words of some buckets come
    counts = rng.poisson(np.where(y[:, None] == 1, 2.0, 1.0) * np.where(np.arange(quality_ranker.BUCKETS) < 16, 1.0, 0.8))
    shares = counts / (counts.sum(1, keepdims=True) + quality_ranker.PRIOR)
    x = rng.normal(size=(1500, len(quality_ranker.NAMES)))
    r = quality_ranker.fit_pairs(x[:1000], y[:1000], shares[:1000])
    raw = ((x - r.mean) / r.scale) @ r.weights + shares @ np.array(r.grams) + r.offset
    assert ((raw >= np.log(0.7 / 0.3)) == y)[1000:].mean() > 0.9


# 7 near-duplicates


def shingles(text, size):
    w = words_of((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_components(rows, size):
    sets = {d: shingles(t, size) for d, t in rows}
    comp = {d: d for d in sets}

    def root(d):
        while comp[d] != d:
            d = comp[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                k = len(x & y)
                if 100 * k >= 80 * (len(x) + len(y) - k):
                    p, q = sorted((root(a), root(b)))
                    comp[q] = p
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_against_all_pairs(spark, docs, size):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    text = " ".join(f"w{i * i % 301}" for i in range(200)).split()
    rng = np.random.default_rng(3)
    for k in range(60):  # chains and a large group of near copies
        own = list(text)
        for j in rng.choice(200, int(rng.integers(0, 9)), replace=False):
            own[j] = f"x{k}_{j}"
        rows.append((10_000 + k, " ".join(own)))
    rows += [(20_000 + k, " ".join(f"c{i}" for i in range(k, k + 40))) for k in range(25)]
    rows += [(30_000 + k, t) for k, t in enumerate(["one", "ONE", "one two", "", None, " "])]
    out = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=size).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out}
    assert got == brute_components(rows, size)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


@pytest.mark.parametrize("finish", [0, 1000])
def test_near_duplicates_in_a_group_of_near_misses(spark, monkeypatch, finish):
    monkeypatch.setattr(minhash_dedup, "FINISH", finish)  # with 0 all is left to deep sketches and rounds of pivots
    monkeypatch.setattr(minhash_dedup, "PART", 50)  # lists in many parts
    monkeypatch.setattr(minhash_dedup, "LONG", 30)
    rng, rows = np.random.default_rng(5), []
    text = [f"w{i}" for i in range(150)]
    for k in range(90):  # up to 24 words from a small vocabulary: similarities to the original from 0.55 up
        own = list(text)
        for j in rng.choice(150, int(rng.integers(0, 25)), replace=False):
            own[j] = f"x{rng.integers(0, 6)}"
        rows.append((k, " ".join(own)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()}
    assert got == brute_components(rows, 2)
    assert len({c for _, c in got.values()}) > 10


def test_near_duplicates_of_repeated_ids_with_other_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (2, a + " x"), (2, b), (3, b + " y"), (3, b + " y"), (4, c), (9, c), (9, c), (None, a)]
    for order in (rows, rows[::-1]):
        got = minhash_dedup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [
            (0, 0, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (3, 1, False), (4, 4, True), (9, 4, False), (9, 4, False),
        ]


def test_parities_hide_no_pair():
    rng = np.random.default_rng(7)
    for n in (1, 20, 200, 3000):
        x, y = (np.unique(rng.integers(-(1 << 62), 1 << 62, n)) for _ in range(2))
        y = np.unique(np.concatenate([y[: n // 3], x[: n // 2]]))
        apart = sum(int(v).bit_count() for v in (minhash_dedup.parities(x) ^ minhash_dedup.parities(y)).view(np.uint64))
        assert apart <= len(np.setxor1d(x, y))


def test_near_duplicates_odd(odd, empty):
    out = minhash_dedup.near_duplicates(odd).collect()
    assert len(out) == len(ODD)
    assert {r["doc_id"]: r["component_id"] for r in out if r["doc_id"]} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 5}
    assert [r["kept"] for r in out if r["doc_id"] is None] == [True]
    assert minhash_dedup.near_duplicates(empty).isEmpty()


def test_components_of_a_long_chain(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5), (None, 3)], "a long, b long")
    got = {r["id"]: r["comp"] for r in components.components(links, common.Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


# 8 line dedup


def test_line_dedup_against_sql(spark):
    d = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{d}/documents.parquet'")
    got = {tuple(r) for r in line_dedup.op8_line_dedup(spark, d).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()}
    assert got == set(c.sql(line_dedup.SQL).fetchall())


def test_line_dedup_odd(spark, odd, empty):
    shared = [(100 + i, f"own {i}\n  SHARED\t\nlast", "en", "a", "x", 1) for i in range(10)]
    df = odd.unionByName(spark.createDataFrame(shared, odd.schema))
    out = line_dedup.drop_shared_lines(df)
    assert out.count() == df.count() and out.filter("doc_id >= 100 and (text not like '%last%') and __n_dropped = 2").count() == 10
    assert {r["text"] for r in out.filter("doc_id = 2 or doc_id = 1").collect()} == {""}
    assert line_dedup.drop_shared_lines(empty).isEmpty()


def test_line_dedup_join_beyond_the_broadcast(spark, docs, monkeypatch):
    plain = sorted(map(tuple, line_dedup.drop_shared_lines(docs).collect()))
    monkeypatch.setattr(line_dedup, "MOST_SHARED", 0)
    assert sorted(map(tuple, line_dedup.drop_shared_lines(docs).collect())) == plain


def test_clashing_columns_and_long_texts_pass_through(spark):
    names = ["row", "id", "own", "rows", "copies", "size", "s", "n", "x", "words", "lines", "keep", "__id", "__x", "__s", "__drop", "a.b"]
    long = "word another\n" * 100_000
    docs = spark.createDataFrame([(i, t, "en", "s", *[f"{c}{i}" for c in names]) for i, t in enumerate([long, "short text", "", None] * 3)], ["doc_id", "text", "lang", "source", *names])
    ranker = quality_ranker.fit_ranker(docs, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int"))
    outs = line_dedup.drop_shared_lines(docs), mixing.mix(docs), quality_ranker.score_documents(docs, ranker), license_scan.scan_licences(docs.withColumn("__found", F.concat(F.lit("f"), "doc_id")), license_scan.fit_on(docs))
    assert outs[3].columns == [*docs.columns, "__found", "licences"] and all(r["__found"] == f"f{r['doc_id']}" for r in outs[3].collect())
    assert outs[0].columns == [*docs.columns, "__n_lines", "__n_dropped"] and outs[1].columns == docs.columns and outs[2].columns == [*docs.columns, "score", "predicted"]
    for out in outs:
        assert all(r[c] == f"{c}{r['doc_id']}" for r in out.collect() for c in names)
    assert outs[0].filter("doc_id = 0").first()["__n_lines"] == 100_001
    assert {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs).collect()} == {i: i % 4 if i % 4 < 2 else i for i in range(12)}
    assert quality_rules.quality_verdicts(docs).filter("doc_id = 0").first()["n_words"] == 200_000
    assert byte_bpe.encode_documents(docs, *MULTI).filter("doc_id = 0").first()["decoded_sha256"] == hashlib.sha256(long.encode()).hexdigest()


# 9 byte-level BPE

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def test_bpe_is_tiktoken(spark, docs, odd, empty):
    enc = plain_encoding("byte_bpe_multi_50k.tiktoken")
    df = docs.limit(60).select((F.col("doc_id") + 1000).alias("doc_id"), "text").unionByName(odd.select("doc_id", "text"))
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    out = byte_bpe.encode_documents(df, *MULTI, with_ids=True).collect()
    assert len(out) == df.count()
    for r in out:
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert byte_bpe.encode_documents(empty, *MULTI).isEmpty()


@pytest.mark.parametrize("seed", range(3))
def test_bpe_random_pieces(seed):
    rng, enc, bpe = np.random.default_rng(seed), plain_encoding("byte_bpe_multi_50k.tiktoken"), byte_bpe.ByteBpe(*MULTI)
    for alphabet in ("ab", "aeiou nt", "äöüß é\n", "0123456789.", "  \n\t x"):
        for n in (1, 2, 7, 64, 300):
            text = "".join(rng.choice(list(alphabet), n))
            assert bpe.encode(text).tolist() == enc.encode_ordinary(text)
            assert bpe.decode(bpe.encode(text)) == text.encode()


# 10 mixing


def test_mixing_hits_targets(spark):
    d = "/root/testdata/sf0.01"
    a, b = (sorted(map(tuple, mixing.op10_mixing(spark, d).collect())) for _ in range(2))
    assert a == b
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    sizes = {r["doc_id"]: (r["source"], len(words_of(r["text"]))) for r in docs}
    totals = collections.Counter()
    for source, n in sizes.values():
        totals[source] += n
    names = sorted(totals)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(totals.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * totals[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * totals[s] for s in full}
        left -= sum(2.0 * totals[s] for s in full)
        open_ -= full
    taken, largest = collections.Counter(), collections.Counter()
    for doc, size, source_size, goal, took in a:
        source, n = sizes[doc]
        assert (size, source_size) == (n, totals[source]) and goal == pytest.approx(target[source])
        assert took <= 2 * size and (size == 0 or took % size == 0)
        taken[source] += took
        largest[source] = max(largest[source], size)
    assert len(a) == len(docs) and all(abs(taken[s] - target[s]) <= largest[s] for s in names)


def test_mixing_copies_and_odd(odd, empty):
    out = mixing.mix(odd)
    assert out.columns == odd.columns and all(r["n"] == 1 for r in out.collect())
    assert mixing.mix(empty).isEmpty()


def test_mixing_hot_repeated_row(spark):
    rows = [(1, "a b c", "en", "s")] * 500 + [(i, "w " * (i % 17 + 1), "en", "s") for i in range(2, 300)] + [(i, "q r", "en", "t") for i in range(300, 340)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).groupBy("source").agg(F.sum(F.size(F.split(F.btrim("text"), " "))).alias("n")).collect()
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    want = {"s": min(2 * sizes["s"], 1.5 * sum(sizes.values()) - min(2 * sizes["t"], 1.5 * sum(sizes.values()) / 4))}
    got = {r["source"]: r["n"] for r in out}
    assert abs(got["s"] - want["s"]) <= 20 and got["t"] <= 2 * sizes["t"]


def test_mix_of_many_equal_rows(spark):
    rows = [(None, "same words here", "en", "a", "u", 1)] * 5_000 + [(None, f"own {i} word", "en", "a", "u", 1) for i in range(200)] + [(i, "other text", "en", "b", "u", 1) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, url string, n long").repartition(5)
    whole, parts = (mixing.mix(docs, part=n).groupBy("source", "text").count().collect() for n in (1_000_000, 10))
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts))
    sizes = {"a": 5_200 * 3, "b": 100}
    for source, target in (("a", 1.5 * sum(sizes.values()) - 200), ("b", 200)):
        taken = {r["text"]: r["count"] for r in parts if r["source"] == source}
        assert abs(sum(n * len(t.split()) for t, n in taken.items()) - target) <= 3
        assert all(n <= 2 for t, n in taken.items() if t.startswith("own"))


def test_mix_passes_maps(spark):
    docs = spark.sql("select id as doc_id, 'one two' as text, 'a' as source, map('k', id) as m from range(6)")
    out = mixing.mix(docs)
    assert out.columns == docs.columns and {r["m"]["k"] for r in out.collect()} <= set(range(6)) and out.count() == 9


def test_pivotal_rounding_is_unbiased(spark):
    sizes = spark.createDataFrame([(f"s{i}", d, 10 * (d + 1)) for i in range(400) for d in range(4)], "source string, doc_id long, size long")
    targets = spark.createDataFrame([(f"s{i}", 100, 4, 37.0) for i in range(400)], "source string, source_size long, n_docs long, target double")
    out = mixing.mix_copies(sizes, targets)
    for r in out.groupBy("doc_id").agg(F.avg("copies").alias("p")).collect():
        assert abs(r["p"] - 0.37) < 0.1
    assert out.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("n")).filter(F.abs(F.col("n") - 37) >= 40).isEmpty()
