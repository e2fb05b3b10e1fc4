"""Pivots, unpivots, completion and range expansion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from strataframe.operators.joins import nullsafe_join


def stack(*tables: DataFrame) -> DataFrame:
    """Union all by column name; columns missing from a table become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def pivot_counts(
    df: DataFrame, keys: Sequence[str], names_from: str, names: Sequence[str],
    *, zero_fill: Sequence[str] = (),
) -> DataFrame:
    """Row counts per cell; an absent cell is null except in the ``zero_fill`` columns."""
    wide = df.groupBy(*keys).pivot(names_from, list(names)).agg(F.count(F.lit(1)))
    return wide.fillna(0, subset=list(zero_fill)) if zero_fill else wide


def pivot_values(
    df: DataFrame, keys: Sequence[str], names_from: str, names: Sequence[str],
    values: Mapping[str, Column],
) -> DataFrame:
    """Several value columns per name, called ``<value>_<name>``; ``values`` maps to aggregates."""
    wide = df.groupBy(*keys).pivot(names_from, list(names)).agg(*[v.alias(k) for k, v in values.items()])
    if len(values) == 1:
        (only,) = values
        return wide.withColumnsRenamed({n: f"{only}_{n}" for n in names})
    return wide.withColumnsRenamed({f"{n}_{k}": f"{k}_{n}" for n in names for k in values})


def pivot_lists(
    df: DataFrame, keys: Sequence[str], names_from: str, names: Sequence[str], value: str,
    order: str, *, max_cell: int = 100_000,
) -> DataFrame:
    """List-valued cells in ``order``. Meant for draws, whose number per cell is fixed.

    The biggest cell is measured first and an oversized one refused; the long form
    (``operators.draws``) has no such limit.
    """
    biggest = df.groupBy(*keys, names_from).count().agg(F.max("count")).first()[0] or 0
    if biggest > max_cell:
        raise ValueError(f"a list cell would hold {biggest} values; keep the draws in long form")
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value)))), lambda s: s[value]
    )
    wide = df.groupBy(*keys).pivot(names_from, list(names)).agg(listed)
    # Cells without rows come out as empty lists.
    return wide


def presence_matrix(
    df: DataFrame, keys: Sequence[str], bin_col: str, bins: Sequence[int], prefix: str = "bin_"
) -> DataFrame:
    """0/1 column per bin, straight from the sparse table (no dense taxa x bins product)."""
    flags = [
        F.max((F.col(bin_col) == b).cast("int")).alias(f"{prefix}{b}") for b in bins
    ]
    return df.groupBy(*keys).agg(*flags)


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide to long; nulls stay as rows."""
    return df.unpivot(list(ids), list(columns), name, value)


def complete(
    df: DataFrame, key: str, level_col: str, levels: Sequence[str], fill: Mapping[str, object]
) -> DataFrame:
    """Add the missing key x level rows. Every declared level counts, used or not."""
    keys = df.select(key).distinct()
    grid = keys.withColumn(level_col, F.explode(F.array(*map(F.lit, levels))))
    return nullsafe_join(grid, df, [key, level_col], "full").fillna(dict(fill))


def expand_range(df: DataFrame, low: str, high: str, out: str, levels: Sequence[int] | None = None) -> DataFrame:
    """One row per integer from ``low`` to ``high``, or per one of ``levels`` in between; a reversed range raises on
    execution, null bounds give no row."""
    steps = F.when(
        F.col(low) > F.col(high),
        F.raise_error(F.format_string("reversed range %s..%s", F.col(low), F.col(high))).cast("array<int>"),
    ).otherwise(
        F.sequence(F.col(low).cast("int"), F.col(high).cast("int"), F.lit(1)) if levels is None
        else F.filter(F.array(*map(F.lit, levels)), lambda v: v.between(F.col(low), F.col(high))))
    return df.withColumn(out, F.explode(steps))


def flatten(df: DataFrame, list_col: str, out: str | None = None) -> DataFrame:
    """One row per list element; rows with an empty or null list disappear."""
    out = out or list_col
    return df.withColumn(out, F.explode(list_col))


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def strings_of(df: DataFrame) -> list[str]:
    """Names of the string columns, for functions applied by column type."""
    return [c for c, t in df.dtypes if t == "string"]


def blank_repeats(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Blank a repeated group label after its first row (vertical merge of a printed table).

    For aggregated report tables: the window holds the report rows of one group.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(column).orderBy(*order)
    first = F.row_number().over(w) == 1
    return df.withColumn("__first", first).withColumn(
        column, F.when(F.col("__first"), F.col(column)).otherwise(F.lit(""))
    ).drop("__first")
