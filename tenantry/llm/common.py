"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: White space of the word and line contracts: space and the controls 09 to 0D.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode a temporary one where it is unset."""
    global _own_dir
    if set_dir := spark.conf.get("spark.checkpoint.dir", None):
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="tenantry-")
    return _own_dir


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor loses none of them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tenantry-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame) -> DataFrame:
        """df as a written table. Its path is in ``df.scratch_path`` of the result for drop()."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def whole_row(df: DataFrame, name: str = "row") -> Column:
    """All columns in one struct, so that an operator's own columns clash with none of them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def map_beside(df: DataFrame, others: list[str], held: dict[str, Column], added: str, work: Callable[[dict[str, list]], Iterator[tuple[int, tuple]]]) -> DataFrame:
    """The columns ``others`` of df, untouched, and those of ``added`` (DDL) that Python makes of the expressions ``held``.

    ``work`` takes the values of held of one batch and gives (place of the row, new values), rows in any number and order. Other
    columns pass as Arrow arrays under names of their place, so any name and type will do and nulls change no type.
    """
    new = StructType.fromDDL(added)
    numbered = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], *[e.alias(f"held_{n}") for n, e in held.items()])
    kept, given = [f"c{i}" for i in range(len(others))], list(held)
    schema = StructType([*numbered.select(*kept).schema, *[StructField(f"new_{f.name}", f.dataType) for f in new]])
    arrow = to_arrow_schema(StructType(list(schema)[len(kept) :]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(work({n: batch.column(f"held_{n}").to_pylist() for n in given}))
            at = pa.array([i for i, _ in made], pa.int64())
            columns = [batch.column(c).take(at) for c in kept]
            values = list(zip(*[v for _, v in made], strict=True)) or [()] * len(arrow)
            columns += [pa.array(list(v), f.type) for v, f in zip(values, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *arrow.names])

    out = numbered.mapInArrow(run, schema)
    return out.select(*[F.col(k).alias(c) for k, c in zip(kept, others, strict=True)], *[F.col(f"new_{f.name}").alias(f.name) for f in new])


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; an empty array where there are none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\x09-\\x0D]+"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ASCII-only values take the faster built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def uniform(*cols: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the values and the seed alone, so that reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") / F.lit(float(1 << 53))
