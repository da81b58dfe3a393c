"""Near-duplicate embeddings by cross-polytope hashing after fast Hadamard rotations.

1. Equal vectors form a class; its smallest id stands for it, with the class's size as weight.
2. A hash function rotates a vector by three rounds of random signs and a fast Hadamard transform and takes the
   nearest of the cross-polytope's 2 d vertices: the largest coordinate and its sign. ``functions`` of them make a
   bucket, and there are several tables. Besides its own bucket a vector probes the next likely ones: those with the
   least loss when a function's largest coordinate is replaced by its second or third.
3. Members of a bucket are dealt into blocks of bounded size, and each pair of blocks is one unit of work: one
   matrix product gives the cosines in double precision. So a bucket of any size is many bounded tasks, and nothing
   is capped.
4. A link is counted in the first table and bucket where its two vectors meet, which both vectors' hashes tell
   without a shuffle. Units return counts per vector and the roots of the components that they see, never pairs.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .components import components

THRESHOLD = 0.9
#: Tables and probes for two functions; every further function doubles the tables and adds as many probes, to hold the recall.
TABLES, PROBES, RANKS = 8, 6, 3
#: Vectors in a block, rows that a unit of work aims at, and links that are held at once.
BLOCK, UNIT, HELD = 2048, 8192, 2_000_000


@functools.lru_cache(maxsize=8)
def _signs(width: int, n: int) -> np.ndarray:
    return np.random.default_rng(20240611 + width).choice(np.array([-1.0, 1.0]), (n, 3, width))


def hadamard(y: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row; the width is a power of two."""
    n, width = y.shape
    step = 1
    while step < width:
        v = y.reshape(n, width // (2 * step), 2, step)
        y = np.stack((v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]), 2).reshape(n, width)
        step *= 2
    return y


def bucket_codes(x: np.ndarray, functions: int, tables: int, probes: int) -> np.ndarray:
    """(rows, tables, probes) of bucket numbers for rows of unit length; probe 0 is the own bucket, -1 is none."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    signs = _signs(width, functions * tables)
    padded = np.zeros((n, width))
    padded[:, :d] = x
    ranks = min(RANKS, width)
    combos = np.array(list(itertools.product(range(ranks), repeat=functions)))
    out = np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        codes, losses = [], []
        for s in signs[t * functions : (t + 1) * functions]:
            y = padded
            for r in range(3):
                y = hadamard(y * s[r])
            y = y / width**1.5
            size = np.abs(y)
            top = np.argsort(-size, 1, kind="stable")[:, :ranks]
            best = np.take_along_axis(size, top, 1)
            codes.append(2 * top + (np.take_along_axis(y, top, 1) < 0))
            losses.append((best[:, :1] - best) ** 2)
        loss = sum(losses[f][:, combos[:, f]] for f in range(functions))
        code = functools.reduce(lambda a, f: a * (2 * width) + codes[f][:, combos[:, f]], range(functions), np.zeros((n, len(combos)), np.int64))
        order = np.argsort(loss, 1, kind="stable")[:, :probes]
        picked = np.take_along_axis(code, order, 1)
        if picked.shape[1] < probes:
            picked = np.concatenate([picked, np.full((n, probes - picked.shape[1]), -1)], 1)
        out[:, t] = picked
    return out


def unit_rows(vectors: list[np.ndarray]) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    return x / np.sqrt((x * x).sum(1))[:, None]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that links reach from each of n nodes."""
    label = np.arange(n)
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    starts = np.flatnonzero(np.diff(src, prepend=-1))
    nodes = src[starts]
    while True:
        new = label.copy()
        new[nodes] = np.minimum(label[nodes], np.minimum.reduceat(label[dst], starts))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _first_meetings(codes: np.ndarray, a: np.ndarray, b: np.ndarray, t: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows (a before b in id) found in bucket ``code`` of table ``t`` are counted there."""
    keep = np.ones(len(a), bool)
    for before in range(codes.shape[1] - 1):
        at = np.flatnonzero(keep & (t > before))
        if not len(at):
            break
        ca, cb = codes[a[at], before], codes[b[at], before]
        keep[at[(ca == cb[:, :1]).any(1) | (cb == ca[:, :1]).any(1)]] = False
    at = np.flatnonzero(keep)
    own_a, all_b = codes[a[at], t[at], 0], codes[b[at], t[at]]
    keep[at] = (own_a == code[at]) | ~(all_b == own_a[:, None]).any(1)
    return keep


def _links_in_unit(rows: pd.DataFrame, functions: int, tables: int, probes: int, threshold: float) -> Iterator[pd.DataFrame]:
    """rows of one vector length, sorted by bucket, block pair and id."""
    x = unit_rows(rows["embedding"].tolist())
    ids, weight, own, block = (rows[c].to_numpy() for c in ("id", "w", "own", "block"))
    t, code, i, j = (rows[c].to_numpy() for c in ("t", "code", "i", "j"))
    edge = np.flatnonzero((np.diff(t) != 0) | (np.diff(code) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def counted() -> pd.DataFrame:
        a, b = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        swap = ids[a] > ids[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        codes = bucket_codes(x[used], functions, tables, probes)
        keep = _first_meetings(codes, at[: len(a)], at[len(a) :], t[a], code[a])
        a, b = a[keep], b[keep]
        if not len(a):
            return pd.DataFrame({"id": [], "n": [], "root": []})
        known, at = np.unique(np.concatenate([ids[a], ids[b]]), return_inverse=True)
        left, right = at[: len(a)], at[len(a) :]
        n = np.bincount(left, weight[b], len(known)) + np.bincount(right, weight[a], len(known))
        return pd.DataFrame({"id": known, "n": n.astype(np.int64), "root": known[_roots(len(known), left, right)]})

    size = 0
    for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(rows)], strict=True):
        if hi - lo < 2 or not own[lo:hi].any():
            continue
        if i[lo] == j[lo]:
            hit = np.triu(x[lo:hi] @ x[lo:hi].T >= threshold, 1)
            hit &= own[lo:hi, None] | own[None, lo:hi]
            a, b = np.nonzero(hit)
            a, b = a + lo, b + lo
        else:
            p, q = lo + np.flatnonzero(block[lo:hi] == i[lo]), lo + np.flatnonzero(block[lo:hi] == j[lo])
            a, b = np.nonzero((x[p] @ x[q].T >= threshold) & (own[p, None] | own[None, q]))
            a, b = p[a], q[b]
        different = ids[a] != ids[b]
        if different.any():
            held.append((a[different], b[different]))
            size += int(different.sum())
        if size > HELD:
            yield counted()
            held, size = [], 0
    if held:
        yield counted()


def settings(n: int, d: int) -> tuple[int, int, int]:
    """(functions, tables, probes) for n distinct vectors of up to d components: some eight vectors in a bucket, whatever n.

    Two vectors at a cosine of exactly 0.9 meet with a probability of 0.998 at least in each setting up to four
    functions, at 64 as at 256 components; with closer ones the rest goes to nothing.
    """
    vertices = 2 * (1 << max(1, (d - 1).bit_length()))
    functions = max(2, math.ceil(math.log(max(n, 8) / 8, vertices)))
    return functions, TABLES << (functions - 2), PROBES * (functions - 1)


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for each row of vectors.

    n_links counts the other rows whose cosine with the row's is at least ``threshold`` and that the hash tables
    bring together; component_id is the smallest id that links reach; kept is true where that is the row's own id.
    Vectors that are null, zero or hold null or non-finite components, and rows with a null id, link with nothing.
    Vectors of different lengths are not compared. Repeated rows are other vectors with equal values and link with
    each other. Other columns are not looked at. An empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession)
    v = F.col("embedding").cast("array<float>") if dict(vectors.dtypes)[vector_col] == "array<float>" else F.col("embedding").cast("array<double>")
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding")).withColumn("embedding", v)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = F.col("id").isNotNull() & F.coalesce(finite, F.lit(False))
    source = source.withColumn("f1", F.when(usable, F.xxhash64("embedding"))).withColumn("f2", F.when(usable, F.xxhash64(F.lit(9), "embedding")))
    classes = scratch.write(
        source.filter(F.col("f1").isNotNull()).groupBy("f1", "f2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w"), F.first("embedding").alias("embedding"))
    )
    n, d = classes.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    functions, tables, probes = settings(n, d or 1)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["embedding"].map(len).to_numpy()
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                for start in range(0, len(at), 2048):
                    part = batch.iloc[at[start : start + 2048]]
                    codes = bucket_codes(unit_rows(part["embedding"].tolist()), functions, tables, probes)
                    rows = len(part) * tables * probes
                    made = pd.DataFrame({
                        "length": np.full(rows, length, np.int32),
                        "t": np.tile(np.repeat(np.arange(tables, dtype=np.int32), probes), len(part)),
                        "code": codes.ravel(),
                        "own": np.tile(np.arange(probes) == 0, len(part) * tables),
                        "id": np.repeat(part["id"].to_numpy(), tables * probes),
                    })
                    yield made[made["code"] >= 0]

    index = scratch.write(classes.select("id", "embedding").mapInPandas(hashed, "length int, t int, code long, own boolean, id long"))
    bucket = ["length", "t", "code"]
    sizes = index.groupBy(*bucket).agg(F.count(F.lit(1)).alias("c"), F.max("own").alias("owned")).filter((F.col("c") > 1) & F.col("owned"))
    sizes = scratch.write(sizes.select(*bucket, F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"), "c"))
    total = sizes.agg(F.sum(F.col("c") * F.col("blocks"))).first()[0] or 0
    units = max(1, -(-total // UNIT))
    placed = index.join(sizes.drop("c"), bucket).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(*bucket, "own", "id", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    placed = placed.withColumn("unit", F.pmod(F.xxhash64(*bucket, "i", "j"), F.lit(units)))
    work = placed.join(classes.select("id", "w", "embedding"), "id")

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*bucket, "i", "j", "id"], kind="stable")
        found = [out for _, part in rows.groupby("length", sort=True) for out in _links_in_unit(part, functions, tables, probes, threshold)]
        return pd.concat(found) if found else pd.DataFrame({"id": [], "n": [], "root": []})

    found = scratch.write(work.groupBy("unit").applyInPandas(linked, "id long, n long, root long"))
    scratch.drop(index, sizes)
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    comp = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)
    known = classes.select("f1", "f2", "id", "w").join(counts, "id", "left").join(comp, "id", "left")
    known = known.select("f1", "f2", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("comp", "id").alias("comp"))
    out = source.select("id", "f1", "f2").join(known, ["f1", "f2"], "left")
    component = F.coalesce("comp", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
