"""What the operators of this package share: scratch tables, clean-up of shuffle files, flat text buffers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strataframe.sources.tables import scratch_dir

#: Bytes of text that one numpy pass handles.
CHUNK_BYTES = 1 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written in one folder that every executor can reach (see ``scratch_dir``).

    A written table cuts lineage: a lost executor costs the tasks that were running,
    not the steps before. The folder stays, because results are read from it lazily.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.written = spark, scratch_dir(spark), 0

    def path(self, name: str) -> str:
        self.written += 1
        return f"{self.folder}/{self.written:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        with dropped_shuffles(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


@contextmanager
def dropped_shuffles(spark: SparkSession):
    """Shuffle files of the queries run inside are deleted when each query ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; a null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4))
    offsets = offsets.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def gathered(batches: Iterator[pa.RecordBatch], schema: pa.Schema | None = None) -> pa.Table | None:
    """All rows of a partition as one table, or None."""
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def released(function: Callable) -> Callable:
    """A function for ``mapInArrow`` that gives free memory back at its end.

    Workers are reused, and what numpy and Arrow freed would stay with them: the next stage of a long job then starts
    from the largest footprint of all stages before.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            # Only the C library of Linux has it.
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)
    return run


def column(tbl: pa.Table, name: str) -> np.ndarray:
    return tbl.column(name).to_numpy(zero_copy_only=False)
