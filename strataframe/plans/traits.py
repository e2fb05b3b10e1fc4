"""Curating the trait table and attaching ages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from strataframe.functions import categories as cat
from strataframe.functions.binning import size_class
from strataframe.functions.text import genus_and_species
from strataframe.operators.aggregates import any_null
from strataframe.operators.reshape import flatten, lower_names
from strataframe.sources.dimensions import Intervals, mapping_table


def curate_traits(raw: DataFrame, *, min_size: float = 1.0) -> DataFrame:
    """One narrow projection: flatten the sizes, normalise labels, filter, classify, split names.

    Text that is no number becomes null and, like an empty size list, drops out.
    """
    df = flatten(lower_names(raw), "max_size_m")
    df = df.withColumn("max_size_m", F.col("max_size_m").try_cast("double"))
    df = df.where(F.col("max_size_m") >= min_size)
    genus, species = genus_and_species(F.col("taxa"))
    group = cat.recode(F.col("group"), cat.GROUP_RECODE)
    return df.withColumns({
        "group": group,
        "group_clps": cat.collapse(group, "Fishes", cat.FISHES),
        "size_cat": size_class(F.col("max_size_m")),
        "genus": genus,
        "species": species,
    })


def unmatched_epochs(traits: DataFrame, column: str, intervals: Intervals) -> DataFrame:
    """Epoch names of the trait table that the interval table does not know."""
    known = intervals.dimension(traits.sparkSession, F.col("series").alias(column)).distinct()
    names = traits.select(column).where(F.col(column).isNotNull()).distinct()
    return names.join(F.broadcast(known), column, "left_anti")


def correct_epochs(
    traits: DataFrame, corrections: Mapping[str, Mapping[str, str]]
) -> DataFrame:
    """Replace epoch names by an explicit {column: {bad: good}} map; keeps ``corrected_*``."""
    for column, mapping in corrections.items():
        lookup = mapping_table(traits.sparkSession, mapping, column, f"corrected_{column}")
        traits = traits.join(F.broadcast(lookup), column, "left").withColumn(
            column, F.coalesce(f"corrected_{column}", column)
        )
    return traits


def attach_ages(traits: DataFrame, intervals: Intervals) -> DataFrame:
    """Youngest bound of the late epoch and oldest bound of the early epoch."""
    epochs = intervals.epochs(traits.sparkSession)
    late = epochs.select(F.col("series").alias("late_epoch"), F.col("top").alias("age_late_epoch"))
    early = epochs.select(F.col("series").alias("early_epoch"), F.col("bottom").alias("age_early_epoch"))
    return traits.join(F.broadcast(late), "late_epoch", "left").join(
        F.broadcast(early), "early_epoch", "left"
    )


def attach_epoch_values(
    df: DataFrame, intervals: Intervals, spec: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """Add columns looked up by epoch name: {output: (epoch column, epoch attribute)}."""
    epochs = intervals.epochs(df.sparkSession)
    for out, (column, attribute) in spec.items():
        lookup = epochs.select(F.col("series").alias(column), F.col(attribute).alias(out))
        df = df.join(F.broadcast(lookup), column, "left")
    return df


def prepare_traits(
    raw: DataFrame, intervals: Intervals, corrections: Mapping[str, Mapping[str, str]]
) -> DataFrame:
    return attach_ages(correct_epochs(curate_traits(raw), corrections), intervals)


def missing_flag(traits: DataFrame, columns=("guild", "vertical", "habitat")) -> DataFrame:
    return traits.withColumn("missing", any_null(columns))
