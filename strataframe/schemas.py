"""Declared input schemas; every reader uses one instead of inferring."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols.items()])


_S, _D, _I = T.StringType(), T.DoubleType(), T.IntegerType()

#: One row per taxon as it leaves the spreadsheet parts. Sizes arrive as text.
RAW_TRAITS = _struct(
    Taxa=_S, Taxonomic_rank=_S, Group=_S, Clade=_S, Max_size_m=T.ArrayType(_S),
    Guild=_S, Vertical=_S, Habitat=_S,
    Early_era=_S, Late_era=_S, Early_period=_S, Late_period=_S,
    Early_epoch=_S, Late_epoch=_S,
)

#: The interval dimension, oldest stage first.
STAGES = _struct(stg=_I, series=_S, system=_S, bottom=_D, top=_D, mid=_D, dur=_D)

INTERVAL_KEYS = _struct(interval_name=_S, bin=_I)

#: Occurrence responses after harmonising the column types.
OCCURRENCES = _struct(
    occurrence_no=_S, reid_no=_S, flags=_S, collection_no=_S,
    identified_name=_S, identified_no=_S, difference=_S,
    accepted_name=_S, accepted_rank=_S, accepted_no=_S,
    early_interval=_S, late_interval=_S, max_ma=_D, min_ma=_D, reference_no=_S,
    phylum_no=_S, class_no=_D, order_no=_D, family_no=_D,
    genus=_S, genus_no=_S, subgenus_no=_S,
    primary_reso=_S, subgenus_name=_S, subgenus_reso=_S, species_reso=_S,
    lng=_D, lat=_D,
)
