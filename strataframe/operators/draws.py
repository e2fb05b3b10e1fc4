"""Summaries and contrasts of posterior draws kept as long tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from strataframe.operators.quantiles import exact_quantiles
from strataframe.operators.reshape import pivot_values

MEDIAN_QI = {"lower": 0.025, "median": 0.5, "upper": 0.975}
HALF_EYE = {"lower_95": 0.025, "lower_66": 0.17, "median": 0.5, "upper_66": 0.83, "upper_95": 0.975}


def summarise_draws(
    draws: DataFrame, value: str, by: Sequence[str], probs: Mapping[str, float] = MEDIAN_QI
) -> DataFrame:
    """Median and interval bounds per key."""
    return exact_quantiles(draws, value, list(probs.values()), by=by, names=list(probs))


def back_transform(draws: DataFrame, value: str) -> DataFrame:
    return draws.withColumn(value, F.exp(value))


def contrast_draws(
    draws: DataFrame, value: str, by: Sequence[str], side: str, first: str, second: str,
    *, draw: str = "draw", out: str = "contrast",
) -> DataFrame:
    """first - second per draw, where both sides exist.

    One aggregation on (key, draw) puts both sides on one row, so the draws are
    shuffled once and never joined with themselves.
    """
    wide = draws.groupBy(*by, draw).agg(
        F.max(F.when(F.col(side) == first, F.col(value))).alias("__a"),
        F.max(F.when(F.col(side) == second, F.col(value))).alias("__b"),
    )
    both = wide.where(F.col("__a").isNotNull() & F.col("__b").isNotNull())
    return both.select(*by, draw, (F.col("__a") - F.col("__b")).alias(out))


def with_group_mean(df: DataFrame, value: str, by: Sequence[str], out: str) -> DataFrame:
    """Group mean on every row. Rows stay where they are while the means are few enough to broadcast."""
    means = df.groupBy(*[F.col(k).alias(f"__k_{k}") for k in by]).agg(F.avg(value).alias(out))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in by])
    return df.join(means, on).drop(*[f"__k_{k}" for k in by])


def contrast_lists(first: Column, second: Column) -> Column:
    """Element-wise difference of two list cells."""
    return F.zip_with(first, second, lambda a, b: a - b)


def bound_contrast(
    summary: DataFrame, by: Sequence[str], side: str, first: str, second: str,
    values: Mapping[str, str],
) -> DataFrame:
    """Differences of point estimates and of interval ends between two sides.

    ``values`` maps a summary column to its output name. Differences of interval
    ends are not an interval of the difference; use ``contrast_draws`` for that.
    """
    wide = pivot_values(summary, by, side, [first, second], {v: F.first(v) for v in values})
    diffs = [(F.col(f"{v}_{first}") - F.col(f"{v}_{second}")).alias(out) for v, out in values.items()]
    sides = [f"{v}_{s}" for v in values for s in (first, second)]
    return wide.select(*by, *diffs, *sides)
