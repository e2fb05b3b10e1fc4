"""Joins with explicit keys.

No hint is given for a side derived from data: Catalyst and AQE broadcast it when
its measured size allows and shuffle otherwise, and AQE splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def nullsafe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join where a null key matches a null key; keys appear once, coalesced on a full join."""
    shared = (set(left.columns) & set(right.columns)) - set(keys)
    if shared:
        raise ValueError(f"columns on both sides besides the keys: {sorted(shared)}")
    renamed = {k: f"__r_{k}" for k in keys}
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(renamed[k])) for k in keys])
    joined = left.join(right.withColumnsRenamed(renamed), on, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("full", "outer", "full_outer", "fullouter"):
        key_cols = [F.coalesce(k, renamed[k]).alias(k) for k in keys]
    else:
        key_cols = [F.col(k) for k in keys]
    rest = [F.col(f"`{c}`") for c in (*left.columns, *right.columns) if c not in keys]
    return joined.select(*key_cols, *rest)


def members_only(df: DataFrame, column: str, names: DataFrame, name: str) -> DataFrame:
    """Rows whose value is in another table's column. Left duplicates are kept."""
    wanted = names.select(F.col(name).alias("__name"))
    return df.join(wanted, F.col(column) == F.col("__name"), "left_semi")


def membership_flag(
    df: DataFrame, column: str, names: DataFrame, name: str, *, yes, no, out: str
) -> DataFrame:
    """Label rows by membership in a name table; never null, also for a null value."""
    wanted = names.select(F.col(name).alias("__name")).distinct().withColumn("__hit", F.lit(True))
    joined = df.join(wanted, F.col(column).eqNullSafe(F.col("__name")), "left")
    flag = F.when(F.col("__hit"), yes).otherwise(no)
    return joined.withColumn(out, flag).drop("__name", "__hit")


def count_by_name(
    names: DataFrame, name: str, rows: DataFrame, row_name: str, out: str = "occurrences"
) -> DataFrame:
    """Occurrences per listed name, zero when there is none.

    The count collapses before the join, so a name holding a third of all rows
    reaches the shuffle as one row per map task.
    """
    counted = rows.groupBy(row_name).agg(F.count(F.lit(1)).alias("n"))
    return attach_counts(names, name, counted, row_name, out)


def attach_counts(
    names: DataFrame, name: str, counted: DataFrame, counted_name: str, out: str = "occurrences"
) -> DataFrame:
    """Left join of ready counts ``n``; an unlisted name has zero."""
    sized = counted.select(F.col(counted_name).alias("__name"), F.col("n").alias("__n"))
    joined = names.join(sized, F.col(name) == F.col("__name"), "left")
    return joined.withColumn(out, F.coalesce("__n", F.lit(0).cast("long"))).drop("__name", "__n")


def spread_left_join(
    left: DataFrame, right: DataFrame, key: str, *, null_safe: bool = True, how: str = "left"
) -> DataFrame:
    """Left (or left semi, left anti) join of raw rows with a table that may be too big to broadcast.

    The right side is never repeated: a copy per salt would not show in the size that decides on a broadcast, and every
    task would hold all of them. What is too big to broadcast is shuffled, and adaptive execution splits the left rows
    of a hot key.
    """
    r = right.withColumnRenamed(key, "__key")
    same = F.col(key).eqNullSafe(F.col("__key")) if null_safe else F.col(key) == F.col("__key")
    return left.join(r, same, how).drop("__key")


def expand_levels(df: DataFrame, column: str, levels: Sequence) -> DataFrame:
    """Every row once per declared level: a narrow explode instead of a cross join."""
    return df.withColumn(column, F.explode(F.array(*map(F.lit, levels))))


def interval_join(
    df: DataFrame,
    value: str,
    intervals: DataFrame,
    low: str,
    high: str,
    *,
    width: float,
    include_lowest: bool = False,
) -> DataFrame:
    """Right-closed interval lookup for an interval table too long for a comparison tree.

    Intervals are listed under every ``width``-wide cell they touch and values
    under theirs, which turns the range condition into an equi join plus a filter.
    """

    def cell(c: Column) -> Column:
        return F.floor(c / F.lit(float(width)))

    listed = intervals.withColumn("__cell", F.explode(F.sequence(cell(F.col(low)), cell(F.col(high)))))
    inside = (F.col(value) > F.col(low)) & (F.col(value) <= F.col(high))
    if include_lowest:
        lowest = intervals.agg(F.min(low)).scalar()
        inside = inside | ((F.col(value) == F.col(low)) & (F.col(low) == F.lit(lowest)))
    keyed = df.withColumn("__vcell", cell(F.col(value)))
    joined = keyed.join(listed, (F.col("__vcell") == F.col("__cell")) & inside, "left")
    return joined.drop("__cell", "__vcell")
