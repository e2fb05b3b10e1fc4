"""Binning occurrences to stages, range-through tables, richness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strataframe.functions.binning import (
    has_older_stage, has_younger_stage, single_stage, stage_of_older_bound, stage_of_younger_bound,
)
from strataframe.functions.numeric import age_midpoint
from strataframe.functions.text import first_word
from strataframe.operators.aggregates import counts, strict_max, strict_min
from strataframe.operators.joins import membership_flag, spread_left_join
from strataframe.operators.reshape import expand_range, presence_matrix
from strataframe.plans.traits import attach_epoch_values
from strataframe.sources.dimensions import Intervals

# The two sides a taxon can be on.
LARGE, BASELINE = "megafauna", "baseline"


def bin_bounds(
    occurrences: DataFrame, intervals: Intervals, *, older: str = "bin_max", younger: str = "bin_min",
    closed: str = "right",
) -> DataFrame:
    """Stage ordinals of both age bounds; rows without either are dropped.

    The drop is written on the ages, where it is a range filter the scan can use.
    """
    max_ma, min_ma = F.col("max_ma"), F.col("min_ma")
    staged = has_older_stage(max_ma, intervals.bottoms) & has_younger_stage(min_ma, intervals.tops, closed=closed)
    return occurrences.where(staged).withColumns({
        older: stage_of_older_bound(max_ma, intervals.bottoms, intervals.numbers),
        younger: stage_of_younger_bound(min_ma, intervals.tops, intervals.numbers, closed=closed),
    })


def species_names(traits: DataFrame) -> DataFrame:
    return traits.where(F.col("taxonomic_rank") == "species").select("taxa")


def genus_groups(traits: DataFrame, *, species_only: bool = True) -> DataFrame:
    kept = traits.where(F.col("taxonomic_rank") == "species") if species_only else traits
    return kept.select("group", "genus").distinct()


def label_taxa(
    df: DataFrame, traits: DataFrame, *, name: str = "accepted_name"
) -> DataFrame:
    """Add ``group_id``, ``genus`` and ``group``; rows without a group are dropped. A genus
    listed under two groups gives two rows."""
    flagged = membership_flag(
        df, name, species_names(traits), "taxa", yes=LARGE, no=BASELINE, out="group_id"
    )
    named = flagged.withColumn("genus", first_word(F.col(name)))
    # One genus may hold a third of the taxa, so the join is spread.
    return spread_left_join(named, genus_groups(traits), "genus").dropna(subset=["group"])


def single_stage_occurrences(
    occurrences: DataFrame, traits: DataFrame, intervals: Intervals, *, closed: str = "right"
) -> DataFrame:
    """Distinct taxon x stage sightings confined to one stage, labelled.

    The stages of a taxon are gathered as bit sets, so the shuffle carries one
    fixed-width row per taxon and map task and the labels are joined at taxon grain.
    """
    words = [f"__word{i}" for i in range((len(intervals) + 61) // 62)]
    sets = occurrences.groupBy("accepted_name").agg(
        *[F.bit_or(_stage_bit(intervals, i, closed)).alias(w) for i, w in enumerate(words)]
    )
    seen = sets.where(F.coalesce(*words).isNotNull())

    def is_member(_: Column, position: Column) -> Column:
        word = F.get(F.array(*words), F.floor(position / 62).cast("int"))
        return F.bit_get(word, position % 62) == 1

    every = F.array(*map(F.lit, intervals.numbers))
    return label_taxa(seen, traits).select(
        "accepted_name", F.explode(F.filter(every, is_member)).alias("bin"), "group_id", "group"
    )


def _stage_bit(intervals: Intervals, word: int, closed: str) -> Column:
    """The bit of a row's single stage within one 62-bit word of the set, else null."""

    def leaf(position: int) -> Column:
        at = position - 1 - 62 * word
        return F.lit(1 << at if 0 <= at < 62 else None).cast("long")

    return single_stage(
        F.col("max_ma"), F.col("min_ma"), intervals.bottoms, intervals.tops, closed=closed, leaf=leaf
    )


def observed_bins(sightings: DataFrame, intervals: Intervals) -> list[int]:
    """The stages from the first to the last one sighted, as ``Intervals.durations`` gives them."""
    span = sightings.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).first()
    return intervals.between(span.lo, span.hi)


def presence_absence(sightings: DataFrame, bins: Sequence[int] | Intervals) -> DataFrame:
    """Taxa by stages, 0 or 1. Given the interval table, the columns run over the stages observed, found by a pass over the
    sightings; given ``bins``, over those.
    """
    if isinstance(bins, Intervals):
        bins = observed_bins(sightings, bins)
    return presence_matrix(sightings, ["accepted_name", "group_id"], "bin", bins)


def range_through(occurrences: DataFrame, traits: DataFrame, intervals: Intervals) -> DataFrame:
    """One row per taxon and stage it ranges through, marked at its last stage.

    Ranges are aggregated map-side and labelled at taxon grain; expanding comes
    last because it is what multiplies the rows.
    """
    ranges = (
        bin_bounds(occurrences, intervals, older="bin_ori", younger="bin_ext")
        .groupBy("accepted_name")
        .agg(F.min("bin_ori").alias("bin_ori"), F.max("bin_ext").alias("bin_ext"))
    )
    expanded = expand_range(label_taxa(ranges, traits), "bin_ori", "bin_ext", "bin_occ", intervals.numbers)
    return expanded.select(
        "accepted_name", "bin_occ", "bin_ext",
        (F.col("bin_occ") == F.col("bin_ext")).cast("int").alias("ext_signal"),
        "group_id", "genus", "group",
    )


def standing_richness(traits: DataFrame, intervals: Intervals) -> DataFrame:
    """Taxa per group and stage, counting a taxon in every stage between its epochs.

    Traits collapse to (group, first, last) counts before the expansion.
    """
    staged = attach_epoch_values(
        traits.select("group", "early_epoch", "late_epoch"), intervals,
        {"early_stg": ("early_epoch", "first_stg"), "late_stg": ("late_epoch", "last_stg")},
    )
    spans = counts(staged, ["group", "early_stg", "late_stg"], "__n")
    per_stage = (
        expand_range(spans, "early_stg", "late_stg", "stg_occ", intervals.numbers)
        .groupBy("group", "stg_occ").agg(F.sum("__n").alias("n"))
    )
    mids = intervals.dimension(traits.sparkSession, F.col("stg").alias("stg_occ"), "mid")
    return per_stage.join(mids, "stg_occ", "left").select("group", "stg_occ", "n", "mid")


def group_ranges(traits: DataFrame) -> DataFrame:
    """Total age range per group; null as soon as one member has no age."""
    spans = traits.groupBy("group").agg(
        strict_max(F.col("age_early_epoch")).alias("age_early_epoch"),
        strict_min(F.col("age_late_epoch")).alias("age_late_epoch"),
    )
    return spans.withColumn("age_mid", age_midpoint(F.col("age_early_epoch"), F.col("age_late_epoch")))
