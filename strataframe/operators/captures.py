"""Capture-history statistics of taxa over time bins.

They stand in for the sampled capture-recapture model: observed counts, no priors
and no posterior.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def recapture_array(seen: DataFrame, taxon: str, bin_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Taxa released per bin by the bin of their next sighting; null when never seen again.

    ``seen`` is made distinct first, so a window holds at most one row per bin.
    """
    once = seen.select(*by, taxon, bin_col).distinct()
    w = Window.partitionBy(*by, taxon).orderBy(bin_col)
    steps = once.withColumn("next_bin", F.lead(bin_col).over(w))
    return steps.groupBy(*by, bin_col, "next_bin").agg(F.count(F.lit(1)).alias("n"))


def sampling_rate(seen: DataFrame, taxon: str, bin_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Per bin: taxa seen, taxa ranging through it, and their ratio."""
    once = seen.select(*by, taxon, bin_col).distinct()
    ranges = once.groupBy(*by, taxon).agg(
        F.collect_set(bin_col).alias("__seen"), F.min(bin_col).alias("__lo"), F.max(bin_col).alias("__hi")
    )
    each = ranges.select(*by, "__seen", F.explode(F.sequence("__lo", "__hi")).alias(bin_col))
    return (
        each.groupBy(*by, bin_col)
        .agg(
            F.count_if(F.array_contains("__seen", F.col(bin_col))).alias("seen"),
            F.count(F.lit(1)).alias("ranging"),
        )
        .withColumn("rate", F.col("seen") / F.col("ranging"))
    )
