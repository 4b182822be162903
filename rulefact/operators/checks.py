"""Declarative row checks: one pass, names of the failed checks per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_range(c: str, low: float, high: float) -> Column:
    return F.col(c).isNull() | F.col(c).between(low, high)


def exactly_one(a: str, b: str) -> Column:
    return F.col(a).isNull() != F.col(b).isNull()


def together(a: str, b: str) -> Column:
    return F.col(a).isNull() == F.col(b).isNull()


def not_empty(c: str) -> Column:
    return F.length(F.coalesce(F.col(c), F.lit(""))) > 0


def one_of(c: str, values: list[str]) -> Column:
    return F.col(c).isin(values)


def all_different(c: str, least: int = 0) -> Column:
    return (F.size(F.array_distinct(c)) == F.size(c)) & (F.size(c) >= least)


def size_is(c: str, n: str) -> Column:
    return F.size(c) == F.col(n)


def validate(df: DataFrame, tests: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass all tests, rows that do not with the names of the failed tests in `failed`)."""
    failed = F.array_compact(F.array(*(F.when(F.coalesce(~test, F.lit(True)), F.lit(name)) for name, test in sorted(tests.items()))))
    marked = df.withColumn("failed", failed)
    return marked.where(F.size("failed") == 0).drop("failed"), marked.where(F.size("failed") > 0)
