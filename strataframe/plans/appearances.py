"""First and last appearances: from occurrences, from traits, and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strataframe.functions.categories import restrict_levels
from strataframe.functions.text import clean_name
from strataframe.operators.aggregates import counts, share_of_total, strict_max, strict_min
from strataframe.operators.joins import members_only, nullsafe_join
from strataframe.operators.reshape import blank_repeats, unpivot
from strataframe.plans.traits import attach_epoch_values
from strataframe.sources.dimensions import Intervals


def appearances_from_occurrences(
    occurrences: DataFrame, resolved: DataFrame, keys: DataFrame, intervals: Intervals,
    *, as_published: bool = False,
) -> DataFrame:
    """Oldest and youngest interval midpoint per taxon.

    Rows first collapse to the bounds of each spelling, map-side, so neither name cleaning nor the semi join see
    a hot taxon.
    A name lacking a bin on any row has no range. ``as_published`` takes the
    first appearance from the late bin and the last one from the early bin.
    """
    spark = occurrences.sparkSession
    dated = occurrences.select(
        "accepted_name", "early_interval", F.coalesce("late_interval", "early_interval").alias("late_interval"))
    mids = intervals.dimension(spark, F.col("stg").alias("bin"), "mid", "stg")
    lookup = F.broadcast(keys.join(mids, "bin").select("interval_name", "mid", "stg"))
    for side in ("early", "late"):
        renamed = lookup.select(
            F.col("interval_name").alias(f"{side}_interval"),
            F.col("mid").alias(f"{side}_age"),
            F.col("stg").alias(f"{side}_bin"),
        )
        dated = dated.join(F.broadcast(renamed), f"{side}_interval", "left")
    first, last = ("late", "early") if as_published else ("early", "late")
    spans = dated.groupBy("accepted_name").agg(
        F.count(F.lit(1)).alias("n"),
        strict_max(F.col(f"{first}_age")).alias("fad_pbdb"),
        strict_min(F.col(f"{last}_age")).alias("lad_pbdb"),
        strict_min(F.col(f"{first}_bin")).alias("fad_stg"),
        strict_max(F.col(f"{last}_bin")).alias("lad_stg"),
    )
    # A spelling is cleaned once; the count keeps the expression above the aggregate.
    named = spans.withColumn("taxon", F.when(F.col("n") > 0, clean_name(F.col("accepted_name"))))
    return (
        members_only(named, "taxon", resolved, "taxon_clean")
        .groupBy("taxon")
        .agg(
            strict_max(F.col("fad_pbdb")).alias("fad_pbdb"),
            strict_min(F.col("lad_pbdb")).alias("lad_pbdb"),
            strict_min(F.col("fad_stg")).alias("fad_stg"),
            strict_max(F.col("lad_stg")).alias("lad_stg"),
        )
        .dropna(subset=["lad_pbdb", "fad_pbdb"])
    )


def _with_clean_names(traits: DataFrame, resolved: DataFrame) -> DataFrame:
    names = resolved.select(F.col("taxon").alias("taxa"), "taxon_clean")
    return nullsafe_join(traits, names, ["taxa"], "full")


def appearances_from_traits(traits: DataFrame, resolved: DataFrame) -> DataFrame:
    joined = _with_clean_names(traits.select("taxa", "age_late_epoch", "age_early_epoch"), resolved)
    return joined.select(
        F.col("taxon_clean").alias("taxon"),
        F.col("age_late_epoch").alias("lad"),
        F.col("age_early_epoch").alias("fad"),
    ).dropna(subset=["fad", "lad"])


def age_differences(from_occurrences: DataFrame, from_traits: DataFrame) -> DataFrame:
    left = from_occurrences.select("taxon", "fad_pbdb", "lad_pbdb")
    joined = nullsafe_join(left, from_traits, ["taxon"], "full")
    return joined.select(
        "taxon",
        (F.col("lad_pbdb") - F.col("lad")).alias("LAD"),
        (F.col("fad_pbdb") - F.col("fad")).alias("FAD"),
    )


def same_ages(differences: DataFrame) -> DataFrame:
    return differences.where((F.col("LAD") == 0) & (F.col("FAD") == 0))


def older_first(differences: DataFrame) -> DataFrame:
    return differences.where(F.col("FAD") > 0)


def younger_last(differences: DataFrame) -> DataFrame:
    return differences.where(F.col("LAD") < 0)


def epochs_compared(
    from_occurrences: DataFrame, traits: DataFrame, resolved: DataFrame, intervals: Intervals
) -> DataFrame:
    """Epoch of first and last appearance in both tables, side by side.

    The stage ordinal travels along, so no midpoint is compared as a double.
    """
    spark = from_occurrences.sparkSession
    occ = from_occurrences.select("taxon", "fad_stg", "lad_stg")
    for stg, name in (("fad_stg", "early_epoch_pbdb"), ("lad_stg", "late_epoch_pbdb")):
        dim = intervals.dimension(spark, F.col("stg").alias(stg), F.col("series").alias(name))
        occ = occ.join(dim, stg, "left")
    occ = occ.select("taxon", "early_epoch_pbdb", "late_epoch_pbdb")
    own = _with_clean_names(traits.select("taxa", "early_epoch", "late_epoch"), resolved).select(
        F.col("taxon_clean").alias("taxon"), "early_epoch", "late_epoch"
    )
    return nullsafe_join(occ, own, ["taxon"], "full")


def with_epoch_order(compared: DataFrame, side: str, intervals: Intervals) -> DataFrame:
    """Rows whose epochs differ, with both integer positions (``pbdb_bin``, ``bin``)."""
    a, b = f"{side}_epoch_pbdb", f"{side}_epoch"
    differing = compared.where(F.col(a) != F.col(b)).select("taxon", a, b)
    return attach_epoch_values(differing, intervals, {"pbdb_bin": (a, "ord"), "bin": (b, "ord")})


def older_epochs(compared: DataFrame, intervals: Intervals) -> DataFrame:
    return with_epoch_order(compared, "early", intervals).where(F.col("pbdb_bin") < F.col("bin"))


def younger_epochs(compared: DataFrame, intervals: Intervals) -> DataFrame:
    return with_epoch_order(compared, "late", intervals).where(F.col("pbdb_bin") > F.col("bin"))


def appearance_counts(
    traits: DataFrame, keys: list[str], early: str, late: str, levels, *, names=("FAD", "LAD"),
    shares=("FAD_prop", "LAD_prop"), out: str | None = None,
) -> DataFrame:
    """First- and last-appearance counts per key and interval, with shares.

    The first share divides by all first appearances, the second only by the last
    appearances left after incomplete rows are dropped.
    """
    out = out or early
    first_n, last_n = names
    firsts = counts(traits.withColumn(out, restrict_levels(F.col(early), levels)), [*keys, out], first_n)
    firsts = share_of_total(firsts, first_n, shares[0])
    lasts = counts(traits.withColumn(out, restrict_levels(F.col(late), levels)), [*keys, out], last_n)
    both = nullsafe_join(firsts, lasts, [*keys, out], "full").dropna(how="any")
    return share_of_total(both, last_n, shares[1])


def appearances_per_period(traits: DataFrame, intervals: Intervals) -> DataFrame:
    return appearance_counts(
        traits, ["group"], "early_period", "late_period", intervals.systems, names=("nr_FAD", "nr_LAD")
    )


def appearances_per_epoch_long(traits: DataFrame, intervals: Intervals) -> DataFrame:
    table = appearance_counts(
        traits, [], "early_epoch", "late_epoch", intervals.series, names=("__f", "__l"),
        shares=("FAD", "LAD"), out="epoch",
    ).drop("__f", "__l")
    aged = attach_epoch_values(table, intervals, {"mid_age": ("epoch", "mean_mid")})
    return unpivot(aged, ["epoch", "mid_age"], ["LAD", "FAD"], "name", "value")


def publication_table(per_period: DataFrame, intervals: Intervals) -> DataFrame:
    """Four printed columns; a repeated group label is blank."""
    order = F.array_position(F.array(*map(F.lit, intervals.systems)), F.col("early_period"))
    ordered = per_period.select("group", "early_period", "nr_FAD", "nr_LAD", order.alias("__o"))
    printed = blank_repeats(ordered, "group", ["__o"]).drop("__o")
    return printed.toDF("Taxon", "Period", "#FADs", "#LADs")
