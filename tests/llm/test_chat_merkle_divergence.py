"""Chat formatting, the Merkle manifest and the source divergence audit against brute force and the registered SQL."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tenantry.llm import chat_format, divergence, merkle
from tenantry.llm.queries import QUERIES, SQL

D = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["op11_chat_format", "op12_merkle_manifest", "op13_source_divergence"])
def test_query_against_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(D):
        duck.sql(f"create view {f[:-8]} as select * from '{D}/{f}{'/*.parquet' if os.path.isdir(f'{D}/{f}') else ''}'")
    got, want = QUERIES[name](spark, D), duck.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows_of(got, *columns) == sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=repr)


def odd_documents(spark, n=90):
    """Null, empty and long values, repeated rows, equal ids with different texts, languages of one document."""
    rng = random.Random(5)
    words = ["the", "Über", "x1y", "a-b", "日本", "ON", "é"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(9))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None]), i) for i in range(n)]
    rows += [(None, None, None, None, None), (3, "", "fr", "s1", 0), (4, "the on " * 40_000, "en", "s9", None), rows[0], rows[0], (7, "Other text", "en", "s1", 1), (8, "...", "empty", "s1", 1)]
    return rows, spark.createDataFrame(rows, DOCS)


# chat formatting


def test_chat_reads_back_every_turn(spark):
    hard = ["\\### Assistant: </turn> ok", "", None, "\\", "\\b\\l<image>#:", "### user: x</turn>\n### assistant: y", "a" * 300_000 + "#", "\n", "日本:é🎉"]
    rng = random.Random(3)
    said = [(c, t, rng.choice(["user", "assistant", "system", None, "odd: role\n<#\\"]), rng.choice(hard)) for c in (1, 2, None) for t in [None, *range(-3, 200)]]
    said += [(4, 1, "assistant", "twice")] * 2
    said += [(5, 0, "assistant", "b"), (5, 0, "assistant", "a")]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumns({"a.b": F.lit(1), "segment": F.lit("x"), "formatted": F.lit("y")})
    segments = chat_format.format_conversations(df)
    got = {r["conv_id"]: r for r in chat_format.digests(segments).collect()}
    convs = defaultdict(list)
    for c, t, role, text in said:
        convs[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(convs)
    code = lambda s: s.replace("\\", "\\b").replace("<", "\\l").replace("#", "\\h").replace(":", "\\c")
    for c, turns in convs.items():
        turns.sort(key=lambda x: (*x[:3], code(x[3])))
        learnt = "".join(x[3] for x in turns if x[2] == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    for r in segments.collect():
        for s in r["loss"]:
            assert r["formatted"][: s["start"]].endswith("### assistant: ") and r["formatted"][s["start"] + s["length"] :].startswith("</turn>\n")


def test_chat_visits_parts(spark):
    part = "struct<kind:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>"
    none = (None,) * 4
    parts = [("text", "see <image> ", None, *none), ("image", None, "i.png", 28, 15, None, None), ("audio", None, "a.wav", None, None, 1.5, None), ("text", None, None, *none), ("document", None, "d.pdf", None, None, None, 2), ("hologram", None, "h", *none), None, ("image", None, "no size", *none)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "done", None, *none), ("image", None, "out.png", 1, 1, None, None)]), (1, 2, "user", None), (1, 3, "user", [])], f"conv_id long, turn long, role string, parts array<{part}>")
    r = chat_format.format_conversations(df).first()
    assert r["formatted"] == "### user: see \\limage> <image><audio><document><other><image></turn>\n### assistant: done<image></turn>\n### user: </turn>\n### user: </turn>\n"
    assert [(a["turn"], a["part"], a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(0, 1, "image", "i.png", 4), (0, 2, "audio", "a.wav", 38), (0, 4, "document", "d.pdf", 1024), (0, 5, "other", "h", 0), (0, 7, "image", "no size", 0), (1, 1, "image", "out.png", 1)]
    assert all(r["formatted"][a["start"] :].startswith(f"<{a['kind']}>") for a in r["attachments"])
    assert [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss"]] == ["done<image>"]


def test_chat_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.format_conversations(empty)).isEmpty()


# manifest


def tree_of(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([hashlib.sha256("".join(levels[-1][i : i + fanout]).encode()).hexdigest() for i in range(0, len(levels[-1]), fanout)])
    return levels


def path_of(levels, at, fanout):
    before, after = [], []
    for nodes in levels[:-1]:
        first = at - at % fanout
        before.append("".join(nodes[first:at]))
        after.append("".join(nodes[at + 1 : first + fanout]))
        at //= fanout
    return before, after


@pytest.mark.parametrize(("fanout", "levels"), [(8, 3), (3, 1), (2, 4)])
def test_manifest_against_brute_force(spark, fanout, levels):
    rows, df = odd_documents(spark)
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    groups = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        groups[lang].append((doc_id is not None, doc_id or 0, sha("".join(map(value, (doc_id, source, lang, n, text))))))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: tree_of([x[2] for x in sorted(groups[lang])], fanout) for lang in langs}
    top = tree_of([trees[lang][-1][0] for lang in langs], fanout)
    want = []
    for at, lang in enumerate(langs):
        above = path_of(top, at, fanout)
        for i, (known, doc_id, digest) in enumerate(sorted(groups[lang])):
            own = path_of(trees[lang], i, fanout)
            want.append((lang, doc_id if known else None, digest, trees[lang][-1][0], own[0] + above[0], own[1] + above[1]))
    leaves = df.select("doc_id", "lang", merkle.leaf(*[F.col(c) for c in merkle.FIELDS]).alias("leaf"), F.lit(1).alias("a.b"), F.lit("x").alias("node"), F.lit(0).alias("index")).repartition(7)
    proofs, root = merkle.manifest(leaves, "lang", "doc_id", fanout=fanout, levels=levels)
    assert root == top[-1][0] and rows_of(proofs) == sorted(want, key=repr)
    folded = proofs.select(merkle.fold(F.col("leaf"), F.col("before"), F.col("after")).alias("r")).distinct()
    assert [r["r"] for r in folded.collect()] == [root]
    wrong = proofs.select((merkle.fold(F.sha2("leaf", 256), F.col("before"), F.col("after")) == root).alias("ok")).distinct()
    assert [r["ok"] for r in wrong.collect()] == [False]


def test_manifest_of_nothing_and_of_one_leaf(spark):
    kind = "doc_id long, lang string, leaf string"
    proofs, root = merkle.manifest(spark.createDataFrame([], kind), "lang", "doc_id")
    assert proofs.isEmpty() and root is None
    proofs, root = merkle.manifest(spark.createDataFrame([(1, None, "ab")], kind), "lang", "doc_id")
    assert root == "ab" and rows_of(proofs) == [(None, 1, "ab", "ab", [], [])]


def test_manifest_of_a_hot_group_over_many_partitions(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("lang"), F.sha2(F.col("id").cast("string"), 256).alias("leaf")).repartition(40)
    proofs, root = merkle.manifest(df, "lang", "doc_id", levels=1)
    sides = [tree_of([hashlib.sha256(str(i).encode()).hexdigest() for i in range(3000) if (i % 10 == 0) == b], 8)[-1][0] for b in (False, True)]
    assert root == hashlib.sha256("".join(sides).encode()).hexdigest() and proofs.count() == 3000
    assert [r[0] for r in proofs.select(merkle.fold(F.col("leaf"), F.col("before"), F.col("after"))).distinct().collect()] == [root]


def test_tampered_documents_fail(spark):
    for r in QUERIES["op12_merkle_manifest"](spark, D).join(spark.read.parquet(f"{D}/documents.parquet"), "doc_id").collect():
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and bool(re.search("[A-Z]", r["text"] or ""))
        assert r["verified"] == (not changed) == (r["folded_root"] == r["root"])


# divergence


def audit_of(rows, min_docs, k):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source, _ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t in df if df[t] >= min_docs]
        count = {s: Counter(t for d in mine if d[1] == s for t in d[2] if df[t] >= min_docs) for s in {d[1] for d in mine}}
        every = sum(count.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (c.total() + 5 * len(kept))  # noqa: B023, E731
        for s, own in count.items():
            pair = [(o, sum(abs(share(own, t) - share(other, t)) for t in kept)) for o, other in count.items() if o != s]
            term = [(t, share(own, t) - share(every, t)) for t in kept if own[t] and share(own, t) > share(every, t)]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, k)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("min_docs", "k"), [(30, 50), (1, 2), (10_000, 50)])
def test_audit_against_brute_force(spark, min_docs, k):
    rows, df = odd_documents(spark, 200)
    df = df.withColumns({"a.b": F.lit(1), "term": F.lit(2), "at": F.lit(3), "found": F.lit("x"), "shares": F.lit("y")}).repartition(6)
    assert rows_of(divergence.divergence_audit(df, min_docs, k)) == audit_of(rows, min_docs, k)


def test_audit_of_nothing_and_beyond_broadcast(spark, monkeypatch):
    assert divergence.divergence_audit(spark.createDataFrame([], DOCS)).isEmpty()
    monkeypatch.setattr(divergence, "MOST_GROUPS", 1)
    rows, df = odd_documents(spark, 120)
    assert rows_of(divergence.divergence_audit(df, 5, 3)) == audit_of(rows, 5, 3)


def test_shares_are_exact_for_large_counts(spark):
    n, total, terms = 9_000_000_000_000_007, 9_200_000_000_000_000, 3
    got = spark.range(1).select(F.lit(n).alias("n"), F.lit(total).alias("total"), F.lit(terms).alias("terms")).select(F.expr(divergence._share("n", "total"))).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * terms)
