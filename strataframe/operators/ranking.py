"""Ordering without a single-task window: global and keyed row numbers, leaders with ties, top-k."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from strataframe.operators.aggregates import strict_max
from strataframe.sources.tables import scratch_dir

#: ``monotonically_increasing_id`` holds the partition above these bits and the place within it below.
PLACE_BITS = 33


def sorted_layout(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` range-sorted on ``order`` and written once, with ``__part`` and ``__at`` (place within the part).

    Spark samples the range bounds, so two runs of one plan may cut differently; the written rows carry their part and
    place, and whatever reads them, in any order, agrees on both. Nulls sort first.
    """
    spark = df.sparkSession
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    path = scratch_dir(spark)
    laid.write.parquet(path)
    written = spark.read.schema(laid.schema).parquet(path)
    place = F.col("__id").bitwiseAND((1 << PLACE_BITS) - 1)
    return written.withColumns({"__part": F.shiftright("__id", PLACE_BITS), "__at": place}).drop("__id")


def keyed_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """1-based position within each key in the order of ``order`` (which should be unique there).

    Rows are numbered inside range partitions, so a key holding a third of all rows is numbered by many tasks. The
    counts by partition and key, about as many rows as partitions and keys together, give each its offset.
    """
    laid = sorted_layout(df, [*keys, *order])
    sizes = laid.groupBy("__part", *keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("__part").alias("__p"), *[F.col(k).alias(f"__k_{k}") for k in keys],
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__offset"),
    )
    same = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], F.col("__part") == F.col("__p"))
    return (
        laid.join(offsets, same)
        .withColumn(out, (F.col("__offset") + F.col("__at")).cast("long"))
        .drop("__part", "__at", "__p", "__offset", *[f"__k_{k}" for k in keys])
    )


def global_row_number(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """1-based position in the total order of ``order``."""
    return keyed_row_number(df, [], order, out)


def leaders(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows at their group's maximum, ties kept; a group holding a null value gives none.

    While the maxima are few adaptive execution filters the rows in place;
    beyond that the join hashes on key and value, which keeps a hot group apart.
    """
    top = df.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(
        strict_max(F.col(value)).alias("__top")
    )
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    wanted = top.where(F.col("__top").isNotNull())
    return df.join(wanted, on & (F.col(value) == F.col("__top")), "left_semi")


def top_k(df: DataFrame, k: int, value: str, tie_key: Sequence[str]) -> DataFrame:
    """The k rows with the largest value, nulls last; equal values are cut by the tie key."""
    return df.orderBy(F.col(value).desc_nulls_last(), *tie_key).limit(k)
