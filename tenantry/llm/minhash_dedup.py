"""Near-duplicates by bottom-k sketches.

One hash function orders all shingles; a document's sketch is the k smallest values of its set. Of two sets with
Jaccard similarity t, each of the k smallest values of the union lies in both with probability t, so their sketches
share far more than a bound m of 0.5 k values when t >= 0.8 (at t = 0.8 and k = 48 fewer than 24 shared values have
a probability of about 1e-6). The steps:

1. Documents with equal sets form a class, which has a key of its own from here on. Classes with an id in common
   are linked from the start.
2. Inverted lists of retained values: values are counted, and a document enters only the lists of its rarest
   values, as many as leave fewer than m others. Two documents that share m values meet in such a list, and values
   that very many documents retain bring nobody together. Lists are split by pairs of bands of set size, as m is
   larger the closer two sizes are.
3. Each list compares its members with one pivot, the member whose values are the most common. Lists whose members
   are then in one component are done.
4. Where the pairs between different components are few for each document, all of them are compared. Else there are
   large groups with members that are almost but not quite similar. The documents of the lists that are left then
   get deep sketches, most of them whole sets, and lists of their own, in which values are counted within the groups
   that lists connect; with these m leaves few documents without a link in a list. Lists with too many pairs still are
   compared with further pivots outside their largest components, twice as many each round, until the rest are few.
   So a group of thousands of near copies costs a few tests per member, not all pairs, and no pair between different
   components is left out.
5. List entries carry the parity of the number of values in each of BITS buckets. Two sets differ in at least as
   many values as their parities differ in bits, so pairs that differ too much are never made, and none is lost.
6. A test estimates the similarity from the k smallest values of the two sketches' union, and pairs that could
   reach the threshold are confirmed by the intersection of their full sets.

The bound m: of two sets A and B with i common values let A's sketch end first. Then the sketches share k less the
values of A's sketch outside B, a hypergeometric number with mean k (|A| - i) / |A|. m allows Z standard deviations
and two more, which is exceeded with a probability of about 1e-6, and none where the sketch is the whole set.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import packs
from .common import Scratch, table
from .components import components

K = 48
#: Values of a deep sketch.
DEEP = 1024
#: Standard deviations that bounds on sketches allow.
Z = 5.0
#: Bands of set size within the largest ratio of two similar sets' sizes, at first and for deep sketches.
BANDS, DEEP_BANDS = 2, 8
#: Buckets of values whose parities list entries carry; at most one difference in four values is hidden up to BITS / 4.
BITS = 512
SEGMENT = 1 << 20
#: Pairs to compare for each document, below which what is left is compared in one round.
FINISH = 1000
#: Pairs of one list that are compared in one part of it, and from which on it is long: a pair is made in one long list only.
PART, LONG = 4_000_000, 1000
#: Rows (id, hash of the text, key) that are broadcast at most: 24 MB.
MOST_IDS = 1_000_000

_rng = np.random.default_rng(20240607)
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, for at least n positions."""
    size = 1 << max(16, n.bit_length())
    if size not in _tables:
        _tables[size] = _powers(int(BASE), size), _powers(pow(int(BASE), -1, 1 << 64), size)
    return _tables[size]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of UTF-8 bytes with A-Z lower-cased, and where each starts."""
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    inside = np.concatenate(([False], ~((raw == 32) | ((raw >= 9) & (raw <= 13))), [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _power_tables(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE_VALUE[raw] * power[: len(raw)], dtype=np.uint64)))
    return mixed((sums[ends] - sums[starts]) * inverse[starts]), starts


def _segments(raw: bytes) -> Iterator[bytes]:
    """A long text in parts that end at white space."""
    start = 0
    while len(raw) - start > SEGMENT:
        end = max(raw.rfind(b" ", start, start + SEGMENT), raw.rfind(b"\n", start, start + SEGMENT))
        if end <= start:
            nexts = [x for x in (raw.find(b" ", start + SEGMENT), raw.find(b"\n", start + SEGMENT)) if x >= 0]
            end = min(nexts) if nexts else len(raw)
        yield raw[start : end + 1]
        start = end + 1
    yield raw[start:]


def shingles_of(words: np.ndarray, size: int) -> np.ndarray:
    """The sorted set of hashes of the ``size``-word shingles; fewer words are one shingle, none are the empty set."""
    if not len(words):
        return np.zeros(0, np.int64)
    n = max(1, len(words) - size + 1)
    out = np.full(n, len(words) if len(words) < size else size, np.uint64)
    for i in range(min(size, len(words))):
        out = mixed(out * BASE + words[i : i + n])
    return np.unique(out.view(np.int64))


def shingle_sets(texts: list[str], size: int) -> Iterator[np.ndarray]:
    """The shingle set of each text."""
    for start, end in packs(texts):
        if end - start == 1 and len(texts[start]) > SEGMENT // 4:
            parts = [word_hashes(np.frombuffer(s, np.uint8))[0] for s in _segments(texts[start].encode("utf-8", "surrogatepass")) if s]
            yield shingles_of(np.concatenate(parts) if parts else np.zeros(0, np.uint64), size)
            continue
        raw = [t.encode("utf-8", "surrogatepass") for t in texts[start:end]]
        hashes, at = word_hashes(np.frombuffer(b"\n".join(raw) + b"\n", np.uint8))
        ends = np.cumsum([len(r) + 1 for r in raw])
        for words in np.split(hashes, np.searchsorted(at, ends[:-1])):
            yield shingles_of(words, size)


def parities(values: np.ndarray) -> np.ndarray:
    """The parity of the number of values in each of BITS buckets, as longs; values' low bits do not depend on their order."""
    return np.packbits((np.bincount(values & (BITS - 1), minlength=BITS) & 1).astype(bool)).view(np.int64)


def _sketches(docs: DataFrame, size: int, k: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            rows = []
            for found in shingle_sets(texts, size):
                print_ = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64)
                rows.append((len(found), print_[0], print_[1], found[:k], parities(found)))
            yield pd.concat([batch[["id", "h"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n", "f1", "f2", "sketch", "odd"])], axis=1)

    return docs.mapInPandas(run, "id long, h long, n long, f1 long, f2 long, sketch array<long>, odd array<long>")


def _full_sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for start in range(0, len(texts), 64):  # full sets of few texts at a time
                yield pd.DataFrame({"key": batch["key"].iloc[start : start + 64].to_numpy(), "set": list(shingle_sets(texts[start : start + 64], size))})

    return docs.mapInPandas(run, "key long, set array<long>")


def _most_outside(drawn: Column, share: Column, n: Column) -> Column:
    """The most values outside a subset among ``drawn`` of n, of which the share lies outside."""
    sampled = F.greatest(n - drawn, F.lit(0.0)) / F.greatest(n - 1, F.lit(1.0))
    return drawn * share + F.when(sampled > 0, Z * F.sqrt(drawn * share * (1 - share) * sampled) + 2).otherwise(0.0)


def _lists(reps: DataFrame, threshold: float, k: int, bands: int) -> DataFrame:
    """(v, key, tag): the inverted lists in which any two similar documents of ``reps`` (key, n, sketch) meet.

    A tag is 4 times how common the document's values are (by logarithms, so that no single one decides), plus its side: in a list for two bands members are on
    sides 0 and 1, in one for a single band all are on side 2.
    """
    t, step = threshold, math.log(1.000001 / threshold) / bands
    postings = reps.select("key", "n", F.explode("sketch").alias("v"))
    counts = postings.groupBy("v").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > 1)
    shared = postings.join(counts, "v").groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("vs"), F.floor(F.sum(F.log2("c")) * 16).alias("common"))
    n = F.col("n").cast("double")
    own = F.floor(F.log(n) / step)
    low, high = F.greatest(F.exp(F.col("other") * step) * 0.999999, t * n), F.least(F.exp((F.col("other") + 1) * step) * 1.000001, n / t)
    # a partner of the least size leaves the most of this sketch outside, one of the largest size the most of its own
    drawn = F.least(n, F.lit(float(k)))
    here = drawn - _most_outside(drawn, F.greatest((n - t * low) / ((1 + t) * n), F.lit(0.0)), n)
    there = k - _most_outside(F.lit(float(k)), F.greatest((high - t * n) / ((1 + t) * high), F.lit(0.0)), high)
    least = F.greatest(F.ceil(F.when(high > k, F.least(here, there)).otherwise(here) - 1e-6), F.lit(1))
    banded = shared.select("key", "n", "vs", "common", own.alias("own"), F.explode(F.sequence(own - bands, own + bands)).alias("other")).filter(low <= high)
    banded = banded.withColumn("m", least).filter(F.size("vs") >= F.col("m"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    entries = banded.select("key", (F.col("common") * 4 + side).alias("tag"), F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), F.explode(F.slice("vs", F.lit(1), (F.size("vs") - F.col("m") + 1).cast("int"))).alias("x"))
    return entries.select(F.xxhash64("x.v", "b1", "b2").alias("v"), "key", "tag")


def _distinct_lists(lists: DataFrame) -> DataFrame:
    """The lists with members to compare; of lists with equal members one."""
    side = F.col("tag") % 4
    on = [F.count(F.when(side == i, 1)).alias(f"c{i}") for i in range(3)]
    sums = [F.sum(F.shiftright(F.xxhash64(F.lit(i), "key", side), 20)).alias(f"s{i}") for i in range(2)]
    members = lists.groupBy("v").agg(*on, *sums).filter("c2 > 1 or (c0 > 0 and c1 > 0)")
    distinct = members.groupBy("c0", "c1", "c2", "s0", "s1").agg(F.min("v").alias("v"))
    return lists.join(distinct.select("v"), "v", "left_semi")


def _outside_largest(labelled: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(v, largest, parts) of the lists with pairs to test: the largest component and the parts that the members are dealt
    into; and the number of pairs of members outside the largest components with those across."""
    parts = labelled.groupBy("v", "comp").agg(*[F.count(F.when(F.col("side") == i, 1)).alias(f"c{i}") for i in range(3)])
    parts = parts.withColumn("c", F.col("c0") + F.col("c1") + F.col("c2"))
    lists = parts.groupBy("v").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(3)], F.max(F.struct("c", "comp", "c0", "c1", "c2")).alias("p"))
    work = sum((F.col(f"c{i}") - F.col(f"p.c{i}")) * F.col(f"c{j}") for i, j in ((2, 2), (0, 1), (1, 0)))
    out = scratch.write(lists.select("v", F.col("p.comp").alias("largest"), work.alias("work"), F.ceil(work / PART).alias("parts")).filter("work > 0"))
    return out, out.agg(F.sum("work")).first()[0] or 0


def _open(labelled: DataFrame) -> DataFrame:
    """The lists (v, comp, ...) that have members in several components."""
    several = labelled.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter(F.col("lo") < F.col("hi"))
    return labelled.join(several.select("v"), "v", "left_semi")


def _entries(lists: DataFrame, reps: DataFrame, threshold: float) -> tuple[DataFrame, Column]:
    """lists (v, key, side, common) with the size and parities of their members, and the condition on x. and y. entries that they may be links."""
    out = lists.select("v", "key", (F.col("tag") % 4).alias("side"), F.floor(F.col("tag") / 4).alias("common")).join(reps.select("key", "n", "odd"), "key")
    apart = functools.reduce(lambda a, b: a + b, [F.bit_count(F.get("x.odd", i).bitwiseXOR(F.get("y.odd", i))) for i in range(BITS // 64)])
    sizes = F.col("x.n") + F.col("y.n")
    return out, (apart <= sizes * ((1 - threshold) / (1 + threshold)) + 1e-6) & (F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n"))


def _first_meeting() -> Column:
    """Whether the long lists s0..s2 of x. and y. entries, by side, have the two meet in no long list before this one."""
    shared = F.concat(*[F.array_intersect(f"x.s{i}", f"y.s{j}") for i, j in ((2, 2), (0, 1), (1, 0))])
    return F.coalesce(F.array_min(shared), F.col("x.v")) == F.col("x.v")


def _close(pairs: DataFrame, reps: DataFrame, threshold: float, k: int) -> DataFrame:
    """The pairs (a, b) whose sketches leave it possible that they are links."""
    a = reps.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = reps.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    sized = pairs.join(a, "a").join(b, "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    common = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    outside = _most_outside(F.size(union), F.lit(1 - threshold), (F.col("na") + F.col("nb")) / (1 + threshold))
    return sized.filter(common >= F.size(union) - outside - 1e-6).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that are links by their full sets."""
    def side(name: str) -> DataFrame:
        """The sets of one end only, so that no others are shuffled."""
        return sets.select(F.col("key").alias(name), F.col("set").alias(f"x{name}")).join(pairs.select(name).distinct(), name, "left_semi")

    exact = pairs.join(side("a"), "a").join(side("b"), "b")
    inter = F.size(F.array_intersect("xa", "xb"))
    return exact.filter(100 * inter >= F.lit(round(threshold * 100)) * (F.size("xa") + F.size("xb") - inter)).select("a", "b")


class _Sets:
    """Full sets of the classes that have come up in a close pair or need deep sketches, made as they come up."""

    def __init__(self, source: DataFrame, reps: DataFrame, size: int, scratch: Scratch, repeated: bool):
        self.source, self.reps, self.size, self.scratch, self.repeated, self.made = source, reps, size, scratch, repeated, None

    def of_pairs(self, pairs: DataFrame) -> DataFrame | None:
        return self.of(pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct())

    def of(self, keys: DataFrame) -> DataFrame | None:
        if self.made is not None:
            keys = keys.join(self.made.select("key"), "key", "left_anti")
        rows = self.scratch.write(keys.join(self.reps.select("key", "id", "h"), "key"))
        if n := rows.count():
            # up to MOST_IDS rows of 24 bytes go to every executor; more are joined by a shuffle of the texts
            wanted = self.source.join(F.broadcast(rows) if n <= MOST_IDS else rows, ["id", "h"])
            if self.repeated:
                wanted = wanted.dropDuplicates(["key"])
            new = self.scratch.write(_full_sets(wanted.select("key", "text"), self.size))
            self.made = new if self.made is None else self.made.unionByName(new)
        self.scratch.drop(rows)
        return self.made


def _same_ids(keyed: DataFrame, repeated: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows that share an id but not their set; repeated: (id, lo, hi), the least and greatest prints."""
    classes = classes.select("f1", "f2", "key")
    several = repeated.filter("lo <> hi").select("id", F.col("lo.f1").alias("f1"), F.col("lo.f2").alias("f2"))
    first = several.join(classes, ["f1", "f2"]).select("id", F.col("key").alias("b"))
    return keyed.select("id", "f1", "f2").distinct().join(first, "id").join(classes, ["f1", "f2"]).select(F.col("key").alias("a"), "b")


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs; other columns are not looked at.

    Links join documents whose sets of ``size``-word shingles have a Jaccard similarity of at least ``threshold``;
    component_id is the smallest id that links reach, and kept is true on the row with that id. Words are runs
    without white space, A-Z lower-cased. Null and empty texts have the empty set and no links. Rows that share an
    id are one document, which has the links of all its texts; each row has the size of its own text's set. A row
    with a null id is compared with nothing, has a null component_id and is kept. Whole texts are read, however long.
    """
    scratch = Scratch(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    sketches = scratch.write(_sketches(source, size, k))

    keyed = sketches.filter((F.col("n") > 0) & F.col("id").isNotNull())
    first = [F.first(c).alias(c) for c in ("n", "sketch", "odd")]  # equal for all rows of a class
    classes = keyed.groupBy("f1", "f2").agg(F.min(F.struct("id", "h")).alias("rep"), *first)
    reps = scratch.write(classes.select("f1", "f2", "rep.id", "rep.h", "n", "sketch", "odd", F.monotonically_increasing_id().alias("key")))
    prints = F.struct("f1", "f2")
    repeated = scratch.write(keyed.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.min(prints).alias("lo"), F.max(prints).alias("hi")).filter("rows > 1"))
    some_repeated = not repeated.isEmpty()

    lists = scratch.write(_lists(reps, threshold, k, BANDS))
    entries, may_link = _entries(_distinct_lists(lists), reps, threshold)
    active = scratch.write(entries.withColumn("part", F.lit(0).cast("long")))
    scratch.drop(lists)
    sets = _Sets(source, reps, size, scratch, some_repeated)
    comp, n_reps = None, reps.count()
    pivots = active.groupBy("v").agg(F.max(F.struct("common", "key", "n", "odd")).alias("p")).select("v", "p.*", F.lit(1).cast("long").alias("parts"))
    most, deep = 1, False
    while True:
        # the members of a long list are dealt into parts, and its pivots meet each part
        dealt = pivots.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        met = active.alias("x").join(dealt.alias("y"), (F.col("x.v") == F.col("y.v")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.key") != F.col("y.key")) & may_link)
        if comp is not None:  # those of one component need no test
            met = met.filter(F.col("x.comp") != F.col("y.comp"))
        if not most:
            met = met.filter((F.col("x.side") == 2) | (F.col("x.side") != F.col("y.side"))).filter(_first_meeting())
        pairs = met.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()
        close = scratch.write(_close(pairs, reps, threshold, k))
        full = sets.of_pairs(close)
        links = scratch.write(_confirmed(close, full, threshold) if full is not None else close)
        if comp is None:
            found = components(links.unionByName(_same_ids(keyed, repeated, reps)) if some_repeated else links, scratch)
            comp = scratch.write(found.withColumnRenamed("id", "key"))
        else:  # as links between components
            ends = links.join(comp.select(F.col("key").alias("a"), F.col("comp").alias("ca")), "a", "left").join(comp.select(F.col("key").alias("b"), F.col("comp").alias("cb")), "b", "left")
            found = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), scratch)
            new = found.select(F.col("id").alias("comp"), F.col("comp").alias("top"))
            grown = comp.join(new, "comp", "left").select("key", F.coalesce("top", "comp").alias("comp"))
            comp = scratch.write(grown.unionByName(found.withColumnRenamed("id", "key").join(comp, "key", "left_anti")))
        scratch.drop(close, links)
        if not most:
            break
        # what is left: lists with members in several components, less the pivots that have met all others
        left = active.select("v", "key", "side", "common", "n", "odd").join(pivots.select("v", "key"), ["v", "key"], "left_anti").join(comp, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        labelled = scratch.write(_open(left))
        scratch.drop(active)
        if labelled.isEmpty():
            break
        largest, work = _outside_largest(labelled, scratch)
        if work > FINISH * n_reps and not deep:  # new lists of what is left; both ends of every untested pair are
            deep, keys = True, scratch.write(labelled.select("key", "comp").distinct())
            # values are counted within groups of components that lists connect, where those that only one member has are no common ones
            ends = labelled.select("v", F.col("comp").alias("a")).join(labelled.groupBy("v").agg(F.min("comp").alias("b")), "v")
            groups = keys.join(components(ends.select("a", "b"), scratch).select(F.col("id").alias("comp"), F.col("comp").alias("g")), "comp")
            whole = sets.of(keys.select("key")).join(groups, "key")
            depth = whole.select("key", F.size("set").cast("long").alias("n"), F.transform(F.slice("set", 1, DEEP), lambda v: F.xxhash64("g", v)).alias("sketch"))
            lists = scratch.write(_lists(depth, threshold, DEEP, DEEP_BANDS))
            scratch.drop(labelled, largest)
            labelled = scratch.write(_open(_entries(_distinct_lists(lists), reps, threshold)[0].join(keys, "key")))
            scratch.drop(lists)
            largest, work = _outside_largest(labelled, scratch)
        if not work:
            break
        entries = labelled.join(largest.select("v", "largest", "parts", (F.col("work") >= LONG).alias("long")), "v")
        own = entries.filter("long").groupBy("key").agg(*[F.collect_list(F.when(F.col("side") == i, F.col("v"))).alias(f"s{i}") for i in range(3)])
        active = scratch.write(entries.join(own, "key", "left").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts"))))
        rest = active.filter(F.col("comp") != F.col("largest")).drop("part")
        if work <= FINISH * n_reps:
            most = 0
        else:
            order = Window.partitionBy("v").orderBy(F.desc("common"), F.desc("key"))
            rest = rest.drop("s0", "s1", "s2").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).drop("r")
            most *= 2
        pivots = scratch.write(rest)
        scratch.drop(labelled, largest)

    tops = comp.join(reps.select("key", "id"), "key").groupBy("comp").agg(F.min("id").alias("top"))
    rows = sketches.select("id", "n", "f1", "f2").join(reps.select("f1", "f2", "key", F.col("id").alias("rep")), ["f1", "f2"], "left")
    joined = rows.join(comp.join(tops, "comp").select("key", "top"), "key", "left")
    own = F.coalesce("top", "rep", "id")
    return joined.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), own).alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == own)).alias("kept"),
    )


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)
