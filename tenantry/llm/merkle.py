"""Merkle manifest of a dataset: one hash tree for each group of rows, and one tree over the groups' roots.

Leaves are numbered by a range sort and the counts of its partitions, so a group that holds most rows is spread over
many tasks. ``fanout ** levels`` consecutive leaves are a block. One grouped call collapses all levels of a block to
its root; the block roots are the leaves of the next round, until each tree has one node. The way back down, again
one grouped call for each block, makes the proofs: the siblings inside the block, then those that the block's root
has above. A proof costs no join, as all leaves of a block share its upper part, and no task holds more than a block.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, table

FANOUT, LEVELS = 8, 3
#: The fields of a leaf of the registered query, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value as hashed: ``-`` for null, else the number of its UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The lowercase hex sha256 of the values, each of them with its length."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(nodes: list[str], size: int, fanout: int, levels: int) -> list[list[str]]:
    """The nodes of a block, level by level up to its root. A tree that has one node left is done."""
    out = [nodes]
    while len(out) <= levels and size > 1:
        last = out[-1]
        out.append([_hash(last[i : i + fanout]) for i in range(0, len(last), fanout)])
        size = -(-size // fanout)
    return out


def _siblings(levels: list[list[str]], fanout: int) -> list[tuple[list[str], list[str]]]:
    """For each node of the lowest level: what stands before and after it in its run, level by level."""
    before, after = [[] for _ in levels[0]], [[] for _ in levels[0]]
    for height, nodes in enumerate(levels[:-1]):
        step = fanout**height
        for at in range(len(nodes)):
            first = at - at % fanout
            left, right = "".join(nodes[first:at]), "".join(nodes[at + 1 : first + fanout])
            for i in range(at * step, min((at + 1) * step, len(before))):
                before[i].append(left)
                after[i].append(right)
    return list(zip(before, after, strict=True))


def number(rows: DataFrame, group: str, order: list[str], scratch: Scratch) -> DataFrame:
    """rows with ``index``, their place in their group from 0 by ``order``, and ``size``, the group's rows.

    The table is dealt out and sorted by range; places are the place in the partition and the counts of the group's
    earlier partitions, a table of one row for each partition and group that meet. Rows equal in group and order are
    numbered one after another. Nulls come first and a null group is a group.
    """
    placed = scratch.write(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("at", 33))
    runs = placed.groupBy(F.col(group).alias("run_group"), F.col("part").alias("run_part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("run_group")
    before = whole.orderBy("run_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("size", F.sum("n").over(whole))
    joined = placed.join(runs, F.col(group).eqNullSafe(F.col("run_group")) & (F.col("part") == F.col("run_part")))
    return joined.select(*[c for c in placed.columns if c not in ("at", "part")], (F.col("at") - F.col("first") + F.col("before")).alias("index"), "size")


class Tree:
    """The trees over ``nodes`` (tree, index, size, node, carried columns): the written levels of blocks and the roots."""

    def __init__(self, nodes: DataFrame, scratch: Scratch, fanout: int = FANOUT, levels: int = LEVELS):
        self.scratch, self.fanout, self.levels, self.block = scratch, fanout, levels, fanout**levels
        self.rounds = [nodes.withColumn("block", F.floor(F.col("index") / self.block).cast("long"))]
        left = nodes.agg(F.max("size")).first()[0] or 0
        while left > 1:
            left = -(-left // self.block)
            up = scratch.write(self._collapse(self.rounds[-1]))
            self.rounds.append(up.withColumn("block", F.floor(F.col("index") / self.block).cast("long")))
        #: (tree, node): one row for each tree.
        self.roots = self.rounds[-1].select("tree", "node")

    def _collapse(self, nodes: DataFrame) -> DataFrame:
        fanout, levels, block = self.fanout, self.levels, self.block

        def collapse(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("index")
            size = int(rows["size"].iloc[0])
            root = _levels(rows["node"].tolist(), size, fanout, levels)[-1][0]
            return pd.DataFrame({"tree": [rows["tree"].iloc[0]], "index": [int(rows["block"].iloc[0])], "size": [-(-size // block)], "node": [root]})

        kind = nodes.schema["tree"].dataType.simpleString()
        return nodes.select("tree", "index", "size", "node", "block").groupBy("tree", "block").applyInPandas(collapse, f"tree {kind}, index long, size long, node string")

    def _prover(self, carried: tuple[str, ...]):
        fanout, levels = self.fanout, self.levels

        def prove(rows: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("index")
            up = upper.iloc[0]
            own = _siblings(_levels(rows["node"].tolist(), int(rows["size"].iloc[0]), fanout, levels), fanout)
            before, after = list(up["before"]), list(up["after"])
            same = {c: rows[c].tolist() for c in ("tree", "index", "node", *carried)}
            return pd.DataFrame(same | {"subroot": up["subroot"], "before": [b + before for b, _ in own], "after": [a + after for _, a in own]})

        return prove

    def proofs(self, top: DataFrame, carried: dict[str, str]) -> DataFrame:
        """(tree, index, node, carried columns, subroot, before, after): before and after hold, level by level, the siblings.

        ``top`` has (tree, subroot, before, after) with what each root has above. carried maps columns of the nodes
        to their types, which pandas must keep: strings.
        """
        kind = self.roots.schema["tree"].dataType.simpleString()
        above = top.select("tree", F.lit(0).cast("long").alias("index"), "subroot", "before", "after")
        for k, nodes in reversed(list(enumerate(self.rounds))):
            if k == len(self.rounds) - 1 and len(self.rounds) > 1:
                continue  # one node for each tree: nothing beside it
            extra = carried if k == 0 else {}
            lower = nodes.select("tree", "index", "size", "node", *extra, "block").groupBy("tree", "block")
            upper = above.select("tree", F.col("index").alias("block"), "subroot", "before", "after").groupBy("tree", "block")
            columns = ", ".join([f"tree {kind}", "index long", "node string", *[f"`{c}` {t}" for c, t in extra.items()], "subroot string", "before array<string>", "after array<string>"])
            above = lower.cogroup(upper).applyInPandas(self._prover(tuple(extra)), columns)
            if k:
                above = self.scratch.write(above)
        return above


def manifest(leaves: DataFrame, group: str, key: str, extra: tuple[str, ...] = (), fanout: int = FANOUT, levels: int = LEVELS) -> tuple[DataFrame, str | None]:
    """(proofs, root) of ``leaves`` (group, key, ``leaf``, string columns ``extra``).

    Within a group leaves stand by key, then by digest; while several nodes remain, every ``fanout`` consecutive ones
    become their hash, the last run with fewer, even one. A lone leaf is its own root. The groups' roots, by group,
    null first, are put together in the same way; of an empty table nothing remains and the root is None.

    proofs has one row for each leaf: group, key, leaf, extra, subroot, and the arrays before and after, which hold
    for each level from the leaf to the root the siblings on its left and right as one text. Null groups and keys
    are values like others, repeated rows are leaves of their own. Digests are short, whatever the rows' length, so
    long texts only cost their hash. Other columns of leaves are left out.
    """
    scratch = Scratch(leaves.sparkSession)
    kind = leaves.schema[key].dataType.simpleString()
    rows = leaves.select(F.col(f"`{group}`").alias("tree"), F.col(f"`{key}`").alias("key"), F.col("leaf").alias("node"), *extra)
    nodes = scratch.write(number(rows, "tree", ["key", "node"], scratch).withColumn("key", F.col("key").cast("string")))
    low = Tree(nodes, scratch, fanout, levels)
    subroots = low.roots.withColumn("all", F.lit(0))
    high_nodes = number(subroots.withColumnRenamed("tree", "name"), "all", ["name"], scratch).withColumnRenamed("all", "tree")
    high = Tree(scratch.write(high_nodes), scratch, fanout, levels)
    found = high.roots.select("node").first()
    none = F.array().cast("array<string>")
    over = high.roots.select("tree", F.col("node").alias("subroot"), none.alias("before"), none.alias("after"))
    tree_kind = rows.schema["tree"].dataType.simpleString()
    top = high.proofs(over, {"name": tree_kind}).select(F.col("name").alias("tree"), F.col("node").alias("subroot"), "before", "after")
    out = low.proofs(scratch.write(top), {"key": "string", **{c: "string" for c in extra}})
    return out.select(F.col("tree").alias(group), F.col("key").cast(kind).alias(key), F.col("node").alias("leaf"), *extra, "subroot", "before", "after"), found and found[0]


def fold(leaf_digest: Column, before: Column, after: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(F.arrays_zip(before.alias("before"), after.alias("after")), leaf_digest, lambda node, at: F.sha2(F.concat(at["before"], node, at["after"]), 256))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    changed = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    own = leaf(*[F.col(c) for c in FIELDS])
    other = F.when(changed, leaf(*[ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in FIELDS]))
    leaves = Scratch(spark).write(docs.select("doc_id", "lang", own.alias("leaf"), other.alias("tampered")))
    proofs, root = manifest(leaves, "lang", "doc_id", ("tampered",))
    siblings = F.array_join(F.flatten(F.zip_with("before", "after", lambda b, a: F.array(b, a))), "")
    out = proofs.withColumn("root", F.lit(root).cast("string")).withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("before"), F.col("after")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, lang,
         sha256(enc1 || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
         sha256(enc1 || coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS lower_leaf,
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                     lambda crc, c: list_reduce([xor(crc, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))) AS crc
  FROM (SELECT *, coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
             || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') AS enc1 FROM documents)
), leaves AS (
  SELECT doc_id, lang, leaf, CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN lower_leaf ELSE leaf END AS start,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM docs
), nodes(height, lang, i, n, node) AS (
  SELECT 0, lang, i, n, leaf FROM leaves
  UNION ALL
  SELECT height + 1, lang, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(node, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY height, lang, i // 8
), subroots AS (
  SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops(height, i, n, node) AS (
  SELECT 0, i, n, subroot FROM subroots
  UNION ALL
  SELECT height + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(node, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY height, i // 8
), runs AS (
  SELECT 'low' AS tree, height, lang, i // 8 AS run, list(node ORDER BY i) AS members FROM nodes WHERE n > 1 GROUP BY height, lang, i // 8
  UNION ALL
  SELECT 'top', height, NULL, i // 8, list(node ORDER BY i) FROM tops WHERE n > 1 GROUP BY height, i // 8
), walk(doc_id, leaf, start, lang, tree, height, i, node, siblings, leaf_at) AS (
  SELECT doc_id, leaf, start, lang, 'low', 0, i, start, '', i FROM leaves
  UNION ALL
  SELECT * FROM (
    SELECT w.doc_id, w.leaf, w.start, w.lang, w.tree, w.height + 1, w.i // 8,
           sha256(array_to_string(r.members[1:w.i % 8], '') || w.node || array_to_string(r.members[w.i % 8 + 2:], '')),
           w.siblings || array_to_string(r.members[1:w.i % 8], '') || array_to_string(r.members[w.i % 8 + 2:], ''), w.leaf_at
    FROM walk w JOIN runs r ON r.tree = w.tree AND r.height = w.height AND r.run = w.i // 8 AND (w.tree = 'top' OR r.lang IS NOT DISTINCT FROM w.lang)
    UNION ALL
    SELECT w.doc_id, w.leaf, w.start, w.lang, 'top', 0, s.i, w.node, w.siblings, w.leaf_at
    FROM walk w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang
    WHERE w.tree = 'low' AND w.height = (SELECT max(k.height) FROM nodes k WHERE k.n = 1 AND k.lang IS NOT DISTINCT FROM w.lang)
  )
), ends AS (
  SELECT w.*, t.node AS root FROM walk w, tops t WHERE t.n = 1 AND w.tree = 'top' AND w.height = t.height
)
SELECT e.doc_id, e.leaf, s.subroot, e.root, sha256(e.siblings) AS proof_sha256, e.node AS folded_root, e.node = e.root AS verified
FROM ends e JOIN subroots s ON s.lang IS NOT DISTINCT FROM e.lang
"""
