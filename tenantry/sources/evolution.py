"""Schema changes over files that stay as they are: columns are known by Parquet field ids, not by names.

A change makes a new version of the schema and touches no file. Files of any earlier version are then read under the
new names: renamed columns keep their values, dropped ones are not read, added ones are null, widened ones are cast by
the reader. Ids are never given twice, so a new column of an old name does not bring back the old values.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..operators import rules

ID = "parquet.field.id"


def _parsed(kind: str) -> DataType:
    return StructType.fromDDL(f"c {kind}")["c"].dataType


@dataclass(frozen=True)
class TableVersion:
    """A table's name, its columns with their ids, the next free id, the value domains and every (column, id) there has been."""

    name: str
    struct: StructType
    next_id: int
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    named: frozenset[tuple[str, int]] = frozenset()

    @classmethod
    def first(cls, name: str, ddl: str, domains: dict[str, tuple[str, ...]] | None = None) -> TableVersion:
        fields = StructType.fromDDL(ddl).fields
        return cls(name, StructType([_with_id(f, i + 1) for i, f in enumerate(fields)]), len(fields) + 1, domains or {}, frozenset((f.name, i + 1) for i, f in enumerate(fields)))

    def scan_name(self, f: StructField) -> str:
        """The name under which a column is scanned: its own, so that filters reach the files, unless another column bore it once."""
        return f.name if {i for c, i in self.named if c == f.name} == {f.metadata[ID]} else f"__id{f.metadata[ID]}"

    def _field(self, column: str) -> StructField:
        if column not in self.struct.names:
            raise LookupError(f"{self.name} has no column {column}")
        return self.struct[column]

    def _swap(self, column: str, new: StructField | None) -> StructType:
        found = [new if f.name == column else f for f in self.struct]
        return StructType([f for f in found if f is not None])

    def rename_table(self, name: str) -> TableVersion:
        return replace(self, name=name)

    def rename(self, column: str, to: str) -> TableVersion:
        """The column under another name; a name that is taken is an error."""
        old = self._field(column)
        if to in self.struct.names:
            raise ValueError(f"{self.name} has a column {to}")
        return replace(self, struct=self._swap(column, StructField(to, old.dataType, True, old.metadata)), domains={to if c == column else c: v for c, v in self.domains.items()}, named=self.named | {(to, old.metadata[ID])})

    def drop(self, column: str) -> TableVersion:
        self._field(column)
        return replace(self, struct=self._swap(column, None), domains={c: v for c, v in self.domains.items() if c != column})

    def add(self, column: str, kind: str) -> TableVersion:
        """A new column, null in all rows that are there."""
        if column in self.struct.names:
            raise ValueError(f"{self.name} has a column {column}")
        return replace(self, struct=StructType([*self.struct.fields, _with_id(StructField(column, _parsed(kind)), self.next_id)]), next_id=self.next_id + 1, named=self.named | {(column, self.next_id)})

    def widen(self, column: str, kind: str) -> TableVersion:
        """A type that holds every value of the old one: int to long, float to double, decimals of more digits."""
        old = self._field(column)
        if (old.dataType.simpleString(), _parsed(kind).simpleString()) not in _WIDER and not _more_digits(old.dataType, _parsed(kind)):
            raise ValueError(f"{old.dataType.simpleString()} to {kind} may lose values")
        return replace(self, struct=self._swap(column, StructField(column, _parsed(kind), True, old.metadata)))

    def allow(self, column: str, *values: str) -> TableVersion:
        """More allowed values of a column; those that are allowed stay so."""
        self._field(column)
        return replace(self, domains=self.domains | {column: tuple(dict.fromkeys((*self.domains.get(column, ()), *values)))})


_WIDER = {("tinyint", "smallint"), ("tinyint", "int"), ("tinyint", "bigint"), ("smallint", "int"), ("smallint", "bigint"), ("int", "bigint"), ("float", "double"), ("int", "double")}


def _more_digits(old: DataType, new: DataType) -> bool:
    if old.typeName() != "decimal" or new.typeName() != "decimal":
        return False
    return new.scale >= old.scale and new.precision - new.scale >= old.precision - old.scale


def _with_id(f: StructField, number: int) -> StructField:
    return StructField(f.name, f.dataType, True, {**(f.metadata or {}), ID: number})


def write(df: DataFrame, version: TableVersion, path: str, mode: str = "append") -> None:
    """Write rows under a version: its columns in order, with their ids. A column that df lacks, or another one, is an error."""
    if sorted(df.columns) != sorted(version.struct.names):
        raise ValueError(f"columns {sorted(df.columns)} are not {sorted(version.struct.names)}")
    cast = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name, metadata=f.metadata) for f in version.struct]
    df.select(*cast).write.mode(mode).parquet(path)


def read(spark: SparkSession, version: TableVersion, path: str) -> DataFrame:
    """All files under path, of whatever version, with this version's columns.

    The session's reader is set to match by field id; it does so for schemas that carry ids and no others. Filters
    are pushed down by name, to files that have it. A column whose name another one bore once is scanned under a name
    made from its id, so that no filter reaches the wrong column.
    """
    spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
    spark.conf.set("spark.sql.parquet.fieldId.read.ignoreMissing", "true")
    inner = StructType([StructField(version.scan_name(f), f.dataType, True, f.metadata) for f in version.struct])
    df = spark.read.schema(inner).parquet(path)
    return df.select(*[F.col(i.name).alias(f.name, metadata=f.metadata) for i, f in zip(inner, version.struct, strict=True)])


def outside_domains(df: DataFrame, version: TableVersion, entity: str = "id") -> list[DataFrame]:
    """Violations of the version's value domains, one table for each column that has one."""
    return [rules.outside_domain(df, c, values, entity, f"{version.name}.{c}.in") for c, values in version.domains.items()]
