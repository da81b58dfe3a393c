"""Constraints that travel with files, and the discovery of those that nobody declared.

Declared keys, unique sets, references and value domains are written into the schema metadata of Parquet files and are
read back from any of them. Undeclared ones are found in two steps: mergeable distinct-count sketches, one pass over
each table, rule out nearly all columns, and one exact pass over the values of the rest confirms or refutes them.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TABLES, Table

CONSTRAINTS = "tenantry.constraints"
FOUND = "kind string, tab string, col string, parent string, parent_col string, rule string"
#: Size of the sketches (2^14 slots, standard error 0.8 %) and the error that a candidate may have.
SLOTS, SLACK = 14, 0.04
#: Columns that one number has bits for.
BITS = 62


def annotated(df: DataFrame, name: str, table: Table | None = None) -> DataFrame:
    """df with the table's constraints in the metadata of their columns, which Parquet files keep."""
    table = table or TABLES[name]
    held: dict[str, list] = {c: [] for c in df.columns}
    for c in table.key:
        held[c].append(["key", name, c, None, None, ",".join(table.key)])
    for u in table.unique:
        for c in u:
            held[c].append(["unique", name, c, None, None, ",".join(u)])
    for r in table.references:
        held[r.column].append(["reference", name, r.column, r.parent, r.parent_key, r.on_delete])
    for c, values in table.domains.items():
        held[c].append(["domain", name, c, None, None, ",".join(values)])
    return df.select(*[F.col(f"`{c}`").alias(c, metadata={**df.schema[c].metadata, CONSTRAINTS: json.dumps(rules)}) if rules else F.col(f"`{c}`") for c, rules in held.items()])


def constraints(*tables: DataFrame) -> DataFrame:
    """(kind, tab, col, parent, parent_col, rule) as the tables' schemas carry them; no row is read."""
    rows = [tuple(r) for df in tables for f in df.schema for r in json.loads(f.metadata.get(CONSTRAINTS, "[]"))]
    return tables[0].sparkSession.createDataFrame(rows, FOUND)


def columns(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(tab, col, kind, at): the columns of the tables by place."""
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([(t, f.name, f.dataType.simpleString(), i) for t, df in tables.items() for i, f in enumerate(df.schema)], "tab string, col string, kind string, at int")


def _family(kind: str) -> str | None:
    """Columns of one family can refer to each other; other types are no keys."""
    return {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "string": "text"}.get(kind)


def _value(c: str, family: str) -> Column:
    return F.col(f"`{c}`").cast("bigint" if family == "int" else "string")


class Profile:
    """Rows of a table and for each column of a key's type: family, sketch, estimate of distinct values, known values, least and greatest."""

    def __init__(self, name: str, df: DataFrame):
        self.name, self.df = name, df
        self.family = {f.name: k for f in df.schema if (k := _family(f.dataType.simpleString()))}
        wanted = [F.count(F.lit(1)).alias("rows")]
        for i, (c, kind) in enumerate(self.family.items()):
            sketch = F.hll_sketch_agg(_value(c, kind), SLOTS)
            wanted += [sketch.alias(f"s{i}"), F.hll_sketch_estimate(sketch).alias(f"d{i}"), F.count(F.col(f"`{c}`")).alias(f"n{i}"), F.min(_value(c, kind)).alias(f"a{i}"), F.max(_value(c, kind)).alias(f"z{i}")]
        one = df.agg(*wanted).first()  # one row of sketches of 16 KB
        self.rows = one["rows"]
        self.found = {c: {"sketch": one[f"s{i}"], "distinct": one[f"d{i}"], "known": one[f"n{i}"], "least": one[f"a{i}"], "greatest": one[f"z{i}"]} for i, c in enumerate(self.family)}

    def key_candidates(self) -> list[str]:
        """Columns without nulls whose estimate is near the number of rows."""
        return [c for c, p in self.found.items() if self.rows and p["known"] == self.rows and p["distinct"] >= self.rows * (1 - SLACK)]


def _held(columns: list[tuple[Profile, str]]) -> dict[tuple[str, str], tuple[int, set[tuple[str, str]]]]:
    """For columns of one family: the exact number of each one's distinct values, and the columns that have them all.

    A value is one row with a bit for each column that has it, whatever the number of candidates; the bits that all
    values of a column share are the columns that hold it. Values with equal bits are counted before bits are taken apart.
    """
    names = [(p.name, c) for p, c in columns]
    words = [f"w{i}" for i in range(-(-len(names) // BITS))]
    bit = lambda i, w: F.lit(1 << i % BITS if w == f"w{i // BITS}" else 0).cast("long")
    tagged = [p.df.select(_value(c, p.family[c]).alias("v"), *[bit(i, w).alias(w) for w in words]).filter("v is not null") for i, (p, c) in enumerate(columns)]
    values = functools.reduce(DataFrame.unionByName, tagged).groupBy("v").agg(*[F.bit_or(w).alias(w) for w in words])
    alike = values.groupBy(*words).agg(F.count(F.lit(1)).alias("n"))
    owners = F.array(*[F.when(F.col(f"w{i // BITS}").bitwiseAND(bit(i, f"w{i // BITS}")) != 0, i) for i in range(len(names))])
    each = alike.select(F.explode(owners).alias("i"), "n", *words).filter("i is not null")
    rows = each.groupBy("i").agg(F.sum("n").alias("n"), *[F.bit_and(w).alias(w) for w in words]).collect()  # one of each column
    return {names[r["i"]]: (r["n"], {x for k, x in enumerate(names) if r[f"w{k // BITS}"] >> k % BITS & 1}) for r in rows}


def _contained(spark: SparkSession, child: dict, parent: dict) -> bool:
    """Whether a child's values may all be the parent's: by bounds, number and the estimate of both together."""
    if not child["known"] or not parent["known"]:
        return False
    if child["least"] < parent["least"] or child["greatest"] > parent["greatest"] or child["distinct"] > parent["distinct"] * (1 + SLACK):
        return False
    return child["both"] <= parent["distinct"] * (1 + SLACK)


def _unions(spark: SparkSession, pairs: list[tuple[dict, dict]]) -> list[int]:
    """The estimates of the distinct values of both columns of each pair, from their sketches."""
    rows = [(i, a["sketch"], b["sketch"]) for i, (a, b) in enumerate(pairs)]
    both = spark.createDataFrame(rows, "i int, a binary, b binary").select("i", F.hll_sketch_estimate(F.hll_union("a", "b")).alias("e"))
    return [r["e"] for r in sorted(both.collect(), key=lambda r: r["i"])]


def discover(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(kind, tab, col, parent, parent_col, rule) of the tables, found in their rows.

    kind ``key``: a column without nulls and without repeated values. kind ``reference``: a column with at least one
    value, each of which, if not null, is a value of another table's key of the same family (whole numbers or texts);
    rule is ``named`` if the two names agree after their tables' prefixes, else ``values``. Empty tables have neither.
    Columns of other types are left out. Every row counts; sketches only rule out what their error cannot explain.
    """
    spark = next(iter(tables.values())).sparkSession
    profiles = [Profile(n, df) for n, df in tables.items()]
    asked = []
    for parent in profiles:
        for key in parent.key_candidates():
            for child in profiles:
                if child.name != parent.name:
                    asked += [(child, c, parent, key) for c, kind in child.family.items() if kind == parent.family[key] and child.found[c]["known"]]
    pairs = [(child.found[c], parent.found[key]) for child, c, parent, key in asked]
    if pairs:
        estimates = _unions(spark, pairs)
        asked = [a for a, (child, parent), both in zip(asked, pairs, estimates, strict=True) if _contained(spark, child | {"both": both}, parent)]
    columns = dict.fromkeys([(p, c) for p in profiles for c in p.key_candidates()] + [(child, c) for child, c, _, _ in asked])
    held = {}
    for family in dict.fromkeys(p.family[c] for p, c in columns):
        held |= _held([(p, c) for p, c in columns if p.family[c] == family])
    keys = [(p.name, c) for p in profiles for c in p.key_candidates() if held[p.name, c][0] == p.rows]
    found: list[tuple] = [("key", t, c, None, None, None) for t, c in keys]
    found += [("reference", child.name, c, parent.name, key, "named" if _bare(c) == _bare(key) else "values") for child, c, parent, key in asked if (parent.name, key) in keys and (parent.name, key) in held[child.name, c][1]]
    return spark.createDataFrame(found, FOUND)


def _bare(column: str) -> str:
    return column.split("_", 1)[-1]
