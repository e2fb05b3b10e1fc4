"""Small reference dimensions held on the driver: intervals and interval names.

Their row count is checked when they are built, which is what allows the
explicit broadcasts further on.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strataframe.schemas import INTERVAL_KEYS, STAGES

MAX_DIMENSION_ROWS = 10_000


def literal_table(spark: SparkSession, rows: Iterable[Sequence], schema: T.StructType) -> DataFrame:
    """An inline table. Arrow makes it a local relation of known size."""
    rows = list(rows)
    columns = [[r[i] for r in rows] for i in range(len(schema))]
    table = pa.Table.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, to_arrow_schema(schema))],
        names=schema.names,
    )
    return spark.createDataFrame(table, schema=schema)


def mapping_table(spark: SparkSession, mapping: Mapping[str, str], key: str, value: str) -> DataFrame:
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField(value, T.StringType())])
    return literal_table(spark, mapping.items(), schema)


def take_dimension(df: DataFrame, max_rows: int = MAX_DIMENSION_ROWS) -> list:
    """Rows of a table that must be small; refuses a bigger one instead of truncating it."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"expected a dimension of at most {max_rows} rows")
    return rows


def small_table(df: DataFrame, max_rows: int = MAX_DIMENSION_ROWS) -> DataFrame:
    """The counts that a fit iterates over, computed once and held inline; more than ``max_rows`` rows are refused."""
    return literal_table(df.sparkSession, take_dimension(df, max_rows), df.schema)


@dataclass(frozen=True)
class Intervals:
    """Ordered interval table: ordinals grow towards the present."""

    rows: tuple[tuple, ...]

    @classmethod
    def from_rows(cls, rows: Iterable[Sequence]) -> "Intervals":
        ordered = tuple(sorted((tuple(r) for r in rows), key=lambda r: r[0]))
        if len(ordered) > MAX_DIMENSION_ROWS:
            raise ValueError(f"interval table has more than {MAX_DIMENSION_ROWS} rows")
        # Any whole numbers will do, as long as they tell the stages apart and grow towards the present.
        if len({r[0] for r in ordered}) != len(ordered):
            raise ValueError("interval ordinals must be distinct")
        at = STAGES.names.index("bottom"), STAGES.names.index("top")
        if any([r[i] for r in ordered] != sorted((r[i] for r in ordered), reverse=True) for i in at):
            raise ValueError("interval ages must fall as ordinals grow")
        return cls(ordered)

    @classmethod
    def from_dataframe(cls, df: DataFrame) -> "Intervals":
        return cls.from_rows(take_dimension(df.select(*STAGES.names)))

    def _column(self, name: str) -> list:
        at = STAGES.names.index(name)
        return [r[at] for r in self.rows]

    @cached_property
    def numbers(self) -> list[int]:
        """The stages' ordinals, oldest first."""
        return self._column("stg")

    def between(self, low: int | None, high: int | None) -> list[int]:
        """Ordinals of the stages from ``low`` to ``high``; none without bounds."""
        return [] if low is None else [i for i in self.numbers if low <= i <= high]

    @cached_property
    def bottoms(self) -> list[float]:
        return self._column("bottom")

    @cached_property
    def tops(self) -> list[float]:
        return self._column("top")

    @cached_property
    def systems(self) -> list[str]:
        return list(dict.fromkeys(self._column("system")))

    @cached_property
    def series(self) -> list[str]:
        return list(dict.fromkeys(self._column("series")))

    def __len__(self) -> int:
        return len(self.rows)

    def to_df(self, spark: SparkSession) -> DataFrame:
        return literal_table(spark, self.rows, STAGES)

    def dimension(self, spark: SparkSession, *columns) -> DataFrame:
        """Broadcastable projection of the interval table."""
        return F.broadcast(self.to_df(spark).select(*columns))

    def epochs(self, spark: SparkSession) -> DataFrame:
        """One row per series: bounds, mean midpoint, stage range and integer order."""
        position = F.array_position(F.array(*map(F.lit, self.series)), F.col("series"))
        per_series = (
            self.to_df(spark)
            .groupBy("series")
            .agg(
                F.min("top").alias("top"),
                F.max("bottom").alias("bottom"),
                F.avg("mid").alias("mean_mid"),
                F.min("stg").alias("first_stg"),
                F.max("stg").alias("last_stg"),
            )
            .withColumn("ord", position.cast("int"))
        )
        return F.broadcast(per_series)

    def durations(self, spark: SparkSession, bins: DataFrame, bin_col: str = "bin") -> DataFrame:
        """Durations of the stages from the first to the last bin in use."""
        span = bins.agg(F.min(bin_col).alias("lo"), F.max(bin_col).alias("hi"))
        return (
            self.to_df(spark)
            .where(F.col("stg").between(span.select("lo").scalar(), span.select("hi").scalar()))
            .select("stg", "dur")
            .orderBy("stg")
        )


def interval_keys(spark: SparkSession, pairs: Mapping[str, int]) -> DataFrame:
    if len(pairs) > MAX_DIMENSION_ROWS:
        raise ValueError(f"interval key table has more than {MAX_DIMENSION_ROWS} rows")
    return F.broadcast(literal_table(spark, pairs.items(), INTERVAL_KEYS))
