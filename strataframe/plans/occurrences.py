"""Occurrence cleaning, synonyms, coverage and per-taxon counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from strataframe.functions.text import clean_name, cleaned_once, first_word, strip_open_suffix, token_count
from strataframe.operators.aggregates import counts, ratio_of_counts
from strataframe.operators.joins import attach_counts, membership_flag, nullsafe_join
from strataframe.operators.reshape import pivot_counts
from strataframe.sources.landing import drop_repeated_occurrences


def clean_occurrences(
    occurrences: DataFrame, *, ranks: Sequence[str] = ("genus", "species"), dedupe: bool = True
) -> DataFrame:
    """Keep the wanted ranks and clean the accepted name. ``dedupe=False`` counts an
    occurrence once per response that returned it."""
    kept = occurrences.where(F.col("accepted_rank").isin(*ranks))
    if dedupe:
        kept = drop_repeated_occurrences(kept)
    return kept.withColumn("accepted_name_clean", clean_name(F.col("accepted_name")))


def synonym_table(occurrences: DataFrame, reasons: Sequence[str]) -> DataFrame:
    """Pairs of accepted and formerly used names, for the given reasons of renaming.

    Pairs that only moved a name to its genus are left out. The regular expressions
    run on the distinct pairs, not on the occurrences.
    """
    pairs = cleaned_once(
        occurrences.where(F.col("difference").isin(*reasons)),
        {"accepted_name": "accepted_name_clean", "identified_name": "identified_name_clean"},
    ).select("accepted_name_clean", "identified_name_clean").distinct()
    return pairs.where(F.col("accepted_name_clean") != first_word(F.col("identified_name_clean")))


def taxon_names(traits: DataFrame, *, as_published: bool = False) -> DataFrame:
    """Distinct trait names without the open-nomenclature suffix; the distinct precedes the
    stripping, so two rows may end up with the same name."""
    return traits.select("taxa").distinct().select(
        strip_open_suffix(F.col("taxa"), as_published=as_published).alias("taxa")
    )


def _accepted(occurrences: DataFrame) -> DataFrame:
    return cleaned_once(occurrences, {"accepted_name": "name"})


def name_counts(occurrences: DataFrame) -> DataFrame:
    """Occurrences per cleaned name: counted per raw name first, so that each distinct
    spelling is cleaned once."""
    return _accepted(occurrences).groupBy("name").agg(F.sum("n").alias("n"))


def known_names(occurrences: DataFrame, synonyms: DataFrame) -> DataFrame:
    accepted = _accepted(occurrences).select("name").distinct()
    return accepted.unionByName(synonyms.select(F.col("identified_name_clean").alias("name")))


def coverage(names: DataFrame, known: DataFrame, *, name: str = "taxa", known_name: str = "name") -> DataFrame:
    """Share of names found, by genus, for genus-only names and for species names.

    The name list is flagged against both lookups and then read in one aggregate.
    """
    flagged = membership_flag(names, name, known, known_name, yes=True, no=False, out="__full")
    genera = known.select(first_word(F.col(known_name)).alias("__g"))
    flagged = flagged.withColumn("__genus", first_word(F.col(name)))
    flagged = membership_flag(flagged, "__genus", genera, "__g", yes=True, no=False, out="__by_genus")
    words = token_count(F.col(name))
    tally = flagged.agg(
        F.count_if(F.col("__by_genus")).alias("m0"), F.count(F.lit(1)).alias("t0"),
        F.count_if(F.col("__full") & (words == 1)).alias("m1"), F.count_if(words == 1).alias("t1"),
        F.count_if(F.col("__full") & (words == 2)).alias("m2"), F.count_if(words == 2).alias("t2"),
    )
    lines = F.inline(F.array(*[
        F.struct(F.lit(level).alias("level"), F.col(f"m{i}").alias("matched"), F.col(f"t{i}").alias("total"))
        for i, level in enumerate(("genus", "genus_only", "species"))
    ]))
    return tally.select(lines).withColumn("share", F.try_divide("matched", "total"))


def resolve_names(names: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Accepted name of each trait name; ``identified_name_clean`` is null unless it is a synonym.

    A name with two accepted names gives two rows.
    """
    listed = names.select(F.col("taxa").alias("taxon"))
    # Synonyms are never null, so a plain key is enough and one join does it.
    joined = listed.join(synonyms, F.col("taxon") == F.col("identified_name_clean"), "left").distinct()
    return joined.select(
        "taxon", "identified_name_clean", "accepted_name_clean",
        F.coalesce("accepted_name_clean", "taxon").alias("taxon_clean"),
    )


def occurrences_per_taxon(
    resolved: DataFrame, occurrences: DataFrame, traits: DataFrame, *, as_published: bool = False
) -> DataFrame:
    """Occurrence count of each resolved name with the traits of the listed name."""
    counted = attach_counts(resolved, "taxon_clean", name_counts(occurrences), "name")
    base = counted.select(
        F.col("taxon_clean").alias("taxon"), "occurrences",
        F.col("identified_name_clean").alias("synonym"),
        F.coalesce("identified_name_clean", "taxon_clean").alias("taxa"),
    )
    info = traits.select(
        strip_open_suffix(F.col("taxa"), as_published=as_published).alias("taxa"), "group", "clade", "late_era"
    )
    return nullsafe_join(base, info, ["taxa"], "left").select(
        "taxon", "occurrences", "synonym", "taxa", "group", "clade", "late_era",
        F.log1p("occurrences").alias("log_occ"),
    )


def overview(per_taxon: DataFrame) -> DataFrame:
    """Per group: share of taxa with occurrences, their number, and singletons.

    One pass. A group without any absent (or singleton) taxon counts 0 there; a group
    without any present (or any repeated) taxon has a null share.
    """
    occ = F.col("occurrences")
    tally = per_taxon.groupBy("group").agg(
        F.count_if(occ > 0).alias("yes"),
        F.count_if(occ <= 0).alias("no"),
        F.count_if(occ == 1).alias("single"),
        F.count_if(occ > 1).alias("many"),
    )
    yes, many = F.nullif("yes", F.lit(0).cast("long")), F.nullif("many", F.lit(0).cast("long"))
    single = F.when(F.col("yes") > 0, F.col("single"))
    return tally.select(
        "group",
        (yes / (F.col("no") + yes)).alias("prop_has_occ"),
        yes.alias("number_of_taxa_with_occ"),
        single.alias("number_of_singletons"),
        (single / (many + single)).alias("prop_singletons"),
    )


def presence_percent(per_taxon: DataFrame) -> DataFrame:
    flagged = per_taxon.withColumn("is_pres", F.when(F.col("occurrences") == 0, "abs").otherwise("pres"))
    wide = pivot_counts(flagged, ["group"], "is_pres", ["abs", "pres"], zero_fill=["abs"])
    return wide.withColumn("pres_perc", F.col("pres") / (F.col("abs") + F.col("pres")) * 100)


def share_with_several(per_taxon: DataFrame) -> DataFrame:
    """Share of species and of genus-only names with more than one occurrence."""
    words, many = token_count(F.col("taxon")), F.col("occurrences") > 1
    tally = per_taxon.agg(*[
        ratio_of_counts((words == n) & many, words == n).alias(level)
        for level, n in (("species", 2), ("genus", 1))
    ])
    return tally.unpivot([], ["species", "genus"], "level", "share")


def ranked_list(per_taxon: DataFrame) -> DataFrame:
    """Taxa with occurrences in ascending order; globally sorted by range partitioning."""
    return per_taxon.where(F.col("occurrences") >= 1).distinct().orderBy("log_occ", "taxa")


def total_occurrences(per_taxon: DataFrame, group: str, taxon: str) -> DataFrame:
    chosen = per_taxon.where((F.col("group") == group) & (F.col("taxon") == taxon))
    return chosen.agg(F.sum("occurrences").alias("occurrences"))


def reasons_used(occurrences: DataFrame) -> DataFrame:
    return counts(occurrences, ["difference"])
