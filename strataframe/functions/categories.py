"""Ordered label sets. Spark has no factor type: a label stays a string and its
position comes from a declared, driver-side tuple of labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# Label orders of the trait table and of its reports.
GROUPS = ("Invertebrates", "Bony fishes", "Jawless fishes", "Placoderms",
          "Chondrichthyans", "Non-avian reptiles", "Birds", "Mammals")
ERAS = ("Paleozoic", "Mesozoic", "Cenozoic")
GUILDS = ("Herbivore", "Micropredator", "Macropredator")
VERTICALS = ("Benthic", "Benthopelagic", "Pelagic")
HABITATS = ("Coastal", "Coastal/Oceanic", "Oceanic")
GROUP_RECODE = {"Bony_fishes": "Bony fishes", "Jawless_fishes": "Jawless fishes"}
FISHES = ("Bony fishes", "Jawless fishes", "Placoderms")
MISSING = "Missing"


def level_position(label: Column, levels: Sequence[str]) -> Column:
    """1-based position in the declared order; null when undeclared."""
    return F.nullif(
        F.array_position(F.array(*map(F.lit, levels)), label), F.lit(0).cast("long")
    )


def restrict_levels(label: Column, levels: Sequence[str]) -> Column:
    """Null out labels that are not declared."""
    return F.when(label.isin(*levels), label)


def recode(label: Column, mapping: Mapping[str, str]) -> Column:
    """Rename some labels, keep the others (and null)."""
    if not mapping:
        return label
    (first, new), *rest = mapping.items()
    chain = reduce(
        lambda acc, kv: acc.when(label == kv[0], kv[1]), rest, F.when(label == first, new)
    )
    return chain.otherwise(label)


def collapse(label: Column, into: str, members: Sequence[str]) -> Column:
    return F.when(label.isin(*members), into).otherwise(label)


def null_to_label(label: Column, name: str = MISSING) -> Column:
    return F.coalesce(label, F.lit(name))


def with_missing_last(levels: Sequence[str], name: str = MISSING) -> tuple[str, ...]:
    return (*[lv for lv in levels if lv != name], name)
