"""Order, equality and uniqueness of names without regard to case, accents and trailing spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: the collation that names and keys are compared by.
COLLATION = "UNICODE_CI_AI_RTRIM"


def collated(c: Column) -> Column:
    """The same text, compared under COLLATION by whatever reads it: order, joins, grouping and windows."""
    return F.collate(c, COLLATION)


def plain(c: Column) -> Column:
    """The same text, compared by bytes again."""
    return F.collate(c, "UTF8_BINARY")


def collated_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with its text columns among ``columns`` collated."""
    return df.withColumns({c: collated(F.col(c)) for c in columns if isinstance(df.schema[c].dataType, StringType)})


def by_name(df: DataFrame, name: str = "name", tie: str = "id") -> DataFrame:
    """df in the order of names as users see them; equal names by ``tie``."""
    return df.orderBy(collated(F.col(name)), tie)
