"""Request manifests: which response belongs to which taxon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from strataframe.functions.text import replace_first

# Request parameters of the two download jobs.
NAME_REQUEST = ("extant=no", "show=classext,ident,coords")
GENUS_REQUEST = ("idreso=species", "extant=no", "show=classext,ident", "idqual=certain")


def request_manifest(
    names: DataFrame,
    name: str,
    *,
    endpoint: str = "",
    params: Sequence[str] = NAME_REQUEST,
    escape_blank: bool = True,
    key: str = "request_key",
) -> DataFrame:
    """One request key per distinct name.

    With ``escape_blank`` the first blank is written ``%20`` and the next one, if
    any, removed.
    """
    distinct = names.select(F.col(name).alias("taxon")).where(F.col(name).isNotNull()).distinct()
    base = F.col("taxon")
    if escape_blank:
        base = replace_first(replace_first(base, " ", "%20"), " ", "")
    query = F.concat_ws("&", F.concat(F.lit("base_name="), base), *map(F.lit, params))
    return distinct.withColumn(key, F.concat(F.lit(endpoint), query))
