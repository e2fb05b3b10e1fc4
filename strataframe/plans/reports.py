"""Composition, size and missing-data reports on the trait table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from strataframe.functions import categories as cat
from strataframe.functions.numeric import age_midpoint, forward_time
from strataframe.functions.text import title_case
from strataframe.operators.aggregates import (
    all_true, any_null, counts, null_percent_of_subset, null_percent_of_table, share_within,
    strict_max,
)
from strataframe.operators.density import kernel_density
from strataframe.operators.draws import HALF_EYE, summarise_draws
from strataframe.operators.joins import nullsafe_join, spread_left_join
from strataframe.operators.ranking import leaders, top_k
from strataframe.operators.regression import logistic_fit, treatment_terms, trend_table
from strataframe.operators.reshape import complete, unpivot
from strataframe.functions.binning import era_of_age
from strataframe.plans.stages import genus_groups
from strataframe.plans.traits import attach_epoch_values
from strataframe.sources.dimensions import Intervals, small_table

TRAITS = ("vertical", "habitat", "guild")
TRAIT_LEVELS = (*reversed(cat.GUILDS), *cat.VERTICALS, *cat.HABITATS)


def composition(traits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Taxa per label of each key in percent of the table, all keys from one scan."""
    long = unpivot(traits.select(*keys), [], keys, "key", "label")
    return share_within(counts(long, ["key", "label"]), ["key"], "n", "prop")


def counts_by_group_and_era(traits: DataFrame) -> DataFrame:
    return counts(traits, ["group", "late_era"])


def trait_counts_by_era(traits: DataFrame) -> DataFrame:
    """Taxa per era, trait value and group, missing values as a label of their own."""
    named = traits.withColumns({t: cat.null_to_label(F.col(t)) for t in TRAITS})
    long = unpivot(named, ["early_era", "group"], TRAITS, "trait", "value")
    levels = cat.with_missing_last(TRAIT_LEVELS)
    return counts(long.withColumn("value", cat.restrict_levels(F.col("value"), levels)),
                  ["trait", "early_era", "value", "group"])


def trait_points(traits: DataFrame) -> DataFrame:
    """One point per taxon and known trait value: age midpoint and log size."""
    long = unpivot(
        traits.select("group", "max_size_m", "age_early_epoch", "age_late_epoch", *TRAITS),
        ["group", "max_size_m", "age_early_epoch", "age_late_epoch"], TRAITS, "eco_trait", "eco_val",
    )
    known = long.withColumn("eco_val", cat.restrict_levels(F.col("eco_val"), TRAIT_LEVELS))
    return known.dropna(subset=["eco_val"]).select(
        "eco_trait", "eco_val",
        age_midpoint(F.col("age_early_epoch"), F.col("age_late_epoch")).alias("age_mid"),
        F.log("max_size_m").alias("log_size"), "group",
    )


def trait_shares(traits: DataFrame) -> DataFrame:
    """Share of each trait value and group within its trait."""
    long = unpivot(traits.select("group", *TRAITS), ["group"], TRAITS, "eco_trait", "eco_val")
    counted = counts(long.dropna(subset=["eco_val"]), ["eco_trait", "eco_val", "group"])
    shared = share_within(counted, ["eco_trait"], "n", "n_perc")
    return shared.withColumn("eco_val", cat.restrict_levels(F.col("eco_val"), TRAIT_LEVELS))


def trait_combinations(traits: DataFrame) -> DataFrame:
    counted = counts(traits, ["early_era", *TRAITS])
    return counted.withColumns({t: cat.null_to_label(F.col(t)) for t in TRAITS})


def clade_summary(traits: DataFrame) -> DataFrame:
    """Largest size, taxon count, group and era of the largest taxa of each clade.

    Ties in different eras, and clades spanning groups, give several rows.
    """
    per_clade = traits.groupBy("clade").agg(
        strict_max(F.col("max_size_m")).alias("max_size"), F.count(F.lit(1)).alias("n")
    )
    groups = traits.select("clade", "group").distinct()
    eras = leaders(traits, ["clade"], "max_size_m").select("clade", "late_era").distinct()
    return nullsafe_join(nullsafe_join(per_clade, groups, ["clade"]), eras, ["clade"])


def clade_sizes_by_era(traits: DataFrame, eras: Sequence[str] = cat.ERAS) -> DataFrame:
    """Largest size per clade and era, 0 where a clade is absent."""
    sizes = traits.groupBy("clade", "early_era").agg(strict_max(F.col("max_size_m")).alias("max_size"))
    full = complete(sizes, "clade", "early_era", eras, {"max_size": 0.0})
    return nullsafe_join(full, traits.select("clade", "group").distinct(), ["clade"])


def missing_report(traits: DataFrame) -> DataFrame:
    return null_percent_of_table(traits, "group", ("guild", "vertical", "habitat"))


def missing_report_of_group(traits: DataFrame, group: str) -> DataFrame:
    return null_percent_of_subset(traits.where(F.col("group") == group), ("guild", "vertical", "habitat"))


def missing_at_random(
    traits: DataFrame, predictors: Sequence[str], traits_checked: Sequence[str] = TRAITS
) -> DataFrame:
    """Wald tests of the missing-value flag on other covariates.

    Rows lacking a predictor are left out. Testing the flag on the very columns it
    is made of leaves a constant response, which is refused.
    """
    flagged = traits.withColumn("missing", any_null(traits_checked)).dropna(subset=list(predictors))
    cells = small_table(counts(flagged, [*predictors, "missing"]))
    terms = [t for p in predictors for t in treatment_terms(cells, p)]
    return logistic_fit(cells, "missing", "n", terms)


def all_above(tests: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    return tests.agg(all_true(F.col(p) > alpha).alias("is_mar"))


def longest_lived(traits: DataFrame, intervals: Intervals, k: int = 17) -> DataFrame:
    """The k taxa with the largest age range, nulls last, ties cut by name."""
    aged = attach_epoch_values(
        traits.select("taxa", "group", "early_epoch", "late_epoch"), intervals,
        {"age_fad": ("early_epoch", "mean_mid"), "age_lad": ("late_epoch", "mean_mid")},
    )
    ranged = aged.select("taxa", "group", (F.col("age_fad") - F.col("age_lad")).alias("age_range"))
    return top_k(ranged, k, "age_range", ["taxa"])


def groups_of_longest_lived(traits: DataFrame, intervals: Intervals, k: int = 17) -> DataFrame:
    return counts(longest_lived(traits, intervals, k), ["group"])


def size_trend(traits: DataFrame, *, as_published: bool = False) -> DataFrame:
    points = traits.select(
        "group", F.log("max_size_m").alias("log_max"),
        forward_time(F.col("age_early_epoch"), F.col("age_late_epoch")).alias("age_mid"),
    )
    return trend_table(points, "log_max", "age_mid", "group", as_published=as_published)


def sampling_distribution(draws: DataFrame, value: str = "samp_inx", *, limits=None) -> DataFrame:
    """Median with 66 % and 95 % bounds per side. ``limits`` drops values first, like axis limits."""
    kept = draws.where(F.col(value).between(*limits)) if limits else draws
    titled = kept.withColumn("group_id", title_case(F.col("group_id")))
    return summarise_draws(titled, value, ["group_id"], HALF_EYE)


def spatial_by_era(
    occurrences: DataFrame, traits: DataFrame, *, breaks=None, labels=None, limits=None
) -> DataFrame:
    """Located occurrences lying in one era, with the group of their genus."""
    args = (breaks, labels) if breaks else ()
    era_max, era_min = era_of_age(F.col("max_ma"), *args), era_of_age(F.col("min_ma"), *args)
    kept = occurrences.withColumn("era", era_min).where(era_max == era_min)
    if limits:
        lng, lat = limits
        kept = kept.where(F.col("lng").between(*lng) & F.col("lat").between(*lat))
    placed = kept.select("lng", "lat", "era", "genus")
    groups = genus_groups(traits, species_only=False)
    return spread_left_join(placed, groups, "genus").dropna(subset=["group"]).select(
        "lng", "lat", "era", "group"
    )


def coordinate_density(located: DataFrame, axis: str, **options) -> DataFrame:
    return kernel_density(located, axis, ["era"], **options)
