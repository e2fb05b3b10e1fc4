"""Aggregate expressions with the null rules of the original scripts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def _strict(value: Column, result: Column) -> Column:
    return F.when(F.count(value) == F.count(F.lit(1)), result)


def strict_max(value: Column) -> Column:
    """Maximum that is null as soon as one value is null."""
    return _strict(value, F.max(value))


def strict_min(value: Column) -> Column:
    return _strict(value, F.min(value))


def strict_avg(value: Column) -> Column:
    return _strict(value, F.avg(value))


def strict_sum(value: Column) -> Column:
    return _strict(value, F.sum(value))


def all_true(flag: Column) -> Column:
    """Logical AND over rows: one false decides, otherwise one null makes it null."""
    return F.when(F.count_if(~flag) > 0, F.lit(False)).when(F.count(flag) == F.count(F.lit(1)), True)


def counts(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    """Rows per key; null is a key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def ratio_of_counts(numerator: Column, denominator: Column) -> Column:
    """Share of two filtered counts in one pass; null on an empty denominator."""
    return F.try_divide(F.count_if(numerator), F.count_if(denominator))


def null_percent_of_table(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Nulls per group in percent of the whole table (not of the group)."""
    total = df.agg(F.count(F.lit(1))).scalar()
    nulls = df.groupBy(by).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return nulls.select(by, *[(F.col(c) / total * 100).alias(c) for c in columns])


def null_percent_of_subset(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls in percent of the rows given."""
    n = F.count(F.lit(1))
    return df.agg(*[F.try_divide(F.count_if(F.col(c).isNull()), n).alias(c) for c in columns]).select(
        *[(F.col(c) * 100).alias(c) for c in columns]
    )


def any_null(columns: Sequence[str]) -> Column:
    """1 when any named column is null in the row."""
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]).cast("int")


def share_of_total(counted: DataFrame, n: str, out: str, *, scale: float = 100.0) -> DataFrame:
    """Share of the grand total. The total is a scalar subquery over the counted table,
    so nothing is windowed into a single partition."""
    total = counted.agg(F.sum(n)).scalar()
    return counted.withColumn(out, F.col(n) / total * scale)


def share_within(
    counted: DataFrame, by: Sequence[str], n: str, out: str, *, scale: float = 100.0
) -> DataFrame:
    """Share of the total of its ``by`` group, by joining the totals back.

    A group with very many categories then stays spread over tasks, which a
    window over the group would not allow.
    """
    totals = counted.groupBy(*[F.col(k).alias(f"__t_{k}") for k in by]).agg(F.sum(n).alias("__total"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__t_{k}")) for k in by])
    return (
        counted.join(totals, on)
        .withColumn(out, F.col(n) / F.col("__total") * scale)
        .drop("__total", *[f"__t_{k}" for k in by])
    )
