"""Landing-directory readers for spreadsheet parts and occurrence responses."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from strataframe.operators.joins import spread_left_join
from strataframe.schemas import OCCURRENCES, RAW_TRAITS
from strataframe.sources.tables import scratch_dir

NO_RECORDS = "THIS REQUEST RETURNED NO RECORDS"


def read_delimited(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType,
    *,
    sep: str = ",",
    quoting: bool = True,
    null_value: str = "",
    source_key: str | None = "source_key",
) -> DataFrame:
    """Read same-shaped delimited files as one table with a declared schema.

    The file each row came from stays available as ``source_key``; that replaces
    keeping one table per file.
    """
    reader = (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", sep)
        .option("nullValue", null_value)
    )
    if not quoting:
        reader = reader.option("quote", "")
    df = reader.csv(paths if isinstance(paths, str) else list(paths))
    if source_key:
        df = df.select("*", F.col("_metadata.file_path").alias(source_key))
    return df


def read_trait_parts(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType = RAW_TRAITS, *, list_sep: str = ";", **options
) -> DataFrame:
    """Same-shaped trait sheets stacked; the values of a list column are parted by ``list_sep``, a blank cell has none."""
    lists = [f.name for f in schema if isinstance(f.dataType, T.ArrayType)]
    flat = T.StructType([T.StructField(f.name, T.StringType() if f.name in lists else f.dataType) for f in schema])
    df = read_delimited(spark, paths, flat, **options)
    parted = {c: F.coalesce(F.split(c, f"\\Q{list_sep}\\E"), F.array()).cast(schema[c].dataType) for c in lists}
    return df.withColumns(parted)


def read_by_header(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, *, sep: str = "\t",
    quoting: bool = True, source_key: str = "source_key", message: str = NO_RECORDS, spare_columns: int = 8,
) -> DataFrame:
    """Delimited responses of many files, columns by each file's own header line.

    A file whose header has at most two columns, or with a row that is the "no records" message, is left out as a
    whole; rows of other files stay however sparse. The header is the row whose first cell is a declared name.
    Columns may come in any order; a missing one is null, one not declared is not read, and text that does not fit the
    type is null. Rows of more than two cells in a file without a header raise an error, as does a header
    with over ``spare_columns`` more columns than declared.
    """
    width = len(schema) + spare_columns + 1
    paths = paths if isinstance(paths, str) else list(paths)
    options = {"sep": sep, "nullValue": ""} | ({} if quoting else {"quote": ""})
    parts = ", ".join(f"_c{i} string" for i in range(width))
    file = F.col("_metadata.file_path").alias(source_key)
    first = F.col("_c0")
    is_header = F.coalesce(first.isin(schema.names), F.lit(False))
    is_message = F.coalesce(first == message, F.lit(False))
    cells = F.array(*[F.col(f"_c{i}") for i in range(width)])
    # Only lines that begin like a header or the message are parted into cells; a quoted first cell may hide either.
    begins = reduce(lambda a, b: a | b, [F.startswith("value", F.lit(n)) for n in (*schema.names, message, *['"'] * quoting)])
    likely = spark.read.text(paths).where(begins).select(F.from_csv("value", parts, options).alias("__line"), file).select("__line.*", source_key)
    marks = likely.where(is_header | is_message).groupBy(source_key).agg(
        F.max(F.when(is_header, cells)).alias("__header"), F.max(is_message).alias("__empty"))
    places = F.transform(F.array(*map(F.lit, schema.names)), lambda n: F.array_position("__header", n).cast("int") - 1)
    files = marks.select(
        source_key, "__empty", F.size(F.array_compact("__header")).alias("__columns"), places.alias("__at"),
        F.get("__header", width - 1).isNotNull().alias("__wide"))
    # One row per file, written so that its size is known when it meets the lines: they are shuffled only if it is big.
    path = scratch_dir(spark)
    files.write.parquet(path)
    known = spark.read.schema(files.schema).parquet(path)
    # One declared column is not read: where all are read, each row of another length counts as malformed, which is slow.
    lines = spark.read.schema(f"{parts}, _c{width} string").options(**options).csv(paths).select(*[f"_c{i}" for i in range(width)], file)
    # A plain coalesce: a function over the array would be interpreted for every row.
    payload = F.coalesce(*[F.col(f"_c{i}") for i in range(2, width)]).isNotNull()
    rows = lines.where(~is_header & ~is_message).withColumn("__payload", payload)
    met = spread_left_join(rows, known, source_key, null_safe=False)
    lost = F.col("__at").isNull() & ~F.coalesce("__empty", F.lit(False)) & F.col("__payload")
    found = met.where(
        F.when(lost, F.raise_error(F.concat(F.lit("no header in "), source_key)).cast("boolean"))
        .when(F.col("__wide"), F.raise_error(F.concat(F.lit("too many columns in "), source_key)).cast("boolean"))
        .otherwise(~F.col("__empty") & (F.col("__columns") > 2))
    )
    picked = found.select(cells.alias("__cells"), "__at", source_key)
    return picked.select(
        *[F.get("__cells", F.get("__at", i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema)], source_key)


def read_occurrences(
    spark: SparkSession, paths: str | Sequence[str], *, quoting: bool = True,
    schema: T.StructType = OCCURRENCES,
) -> DataFrame:
    """Tab-separated occurrence responses, empty ones dropped file by file."""
    return read_by_header(spark, paths, schema, quoting=quoting)


def drop_empty_responses(
    df: DataFrame, *, payload: Sequence[str], message: str = NO_RECORDS
) -> DataFrame:
    """Drop what an empty response turns into under the declared schema.

    That is a row whose first column is the "no records" message, or a row of a
    file with at most two columns: every later column is then null.
    """
    first, rest = payload[0], payload[2:]
    is_message = F.coalesce(F.col(first) == message, F.lit(False))
    has_payload = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in rest])
    return df.where(~is_message & has_payload)


def drop_empty_sources(
    df: DataFrame, *, payload: Sequence[str], source_key: str = "source_key", message: str = NO_RECORDS
) -> DataFrame:
    """Same at file level: one message row discards everything from its source."""
    empty = df.where(F.col(payload[0]) == message).select(source_key).distinct()
    kept = drop_empty_responses(df, payload=payload, message=message)
    return spread_left_join(kept, empty, source_key, null_safe=False, how="left_anti")


def drop_repeated_occurrences(df: DataFrame, key: str = "occurrence_no") -> DataFrame:
    """One row per occurrence: overlapping requests return the same one again.

    Of rows that differ otherwise the least by all other columns stays, so that runs agree.
    Rows without a key cannot be told apart and all stay.
    """
    rest = [c for c in df.columns if c != key]
    least = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("row"))
    keyed = least.select(*[F.col(key) if c == key else F.col(f"row.`{c}`").alias(c) for c in df.columns])
    return keyed.unionByName(df.where(F.col(key).isNull()))
