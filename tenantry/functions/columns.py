"""Derived columns and validation predicates as column expressions; a predicate is true where the value is valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def logo_url(path: Column, base: str) -> Column:
    """The public address of a stored logo; null for null, empty and "0"."""
    return F.when(path.isNull() | path.isin("", "0"), None).otherwise(F.concat(F.lit(f"{base}/storage/"), F.ltrim(path, F.lit("/"))))


def patched(present: Column, new: Column, old: Column) -> Column:
    """Patch semantics: a member that is present replaces the old value, null included; an absent one does not."""
    return F.when(F.coalesce(present, F.lit(False)), new).otherwise(old)


def size_kb(n_bytes: Column) -> Column:
    return F.format_number(n_bytes / 1024, 2)


def required(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))


def required_if(c: Column, condition: Column) -> Column:
    return ~F.coalesce(condition, F.lit(False)) | required(c)


def optional(c: Column, rule: Column) -> Column:
    return c.isNull() | F.coalesce(rule, F.lit(False))


def max_length(c: Column, n: int) -> Column:
    return optional(c, F.length(c) <= n)


def is_integer(c: Column) -> Column:
    return optional(c, c.cast("string").rlike(r"^\s*[+-]?\d+\s*$"))


def is_boolean(c: Column) -> Column:
    return optional(c, F.lower(c.cast("string")).isin("true", "false", "1", "0"))


def one_of(c: Column, *values: str) -> Column:
    return optional(c, c.isin(*values))


def distinct_items(c: Column, at_least: int = 0) -> Column:
    return optional(c, (F.size(F.array_distinct(c)) == F.size(c)) & (F.size(c) >= at_least))


def different(c: Column, other: Column) -> Column:
    return c.isNull() | other.isNull() | (c != other)


def alpha_dash(c: Column) -> Column:
    return optional(c, c.rlike(r"^[\p{L}\p{M}\p{N}_-]+$"))


def email(c: Column) -> Column:
    return optional(c, c.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"))


def failures(rules: dict[str, Column]) -> Column:
    """The sorted names of the rules that a row breaks."""
    return F.array_sort(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])))
