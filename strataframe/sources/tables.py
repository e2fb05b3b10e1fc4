"""Saved tables in and out."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, *, gzip: bool = False, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if gzip:
        writer = writer.option("compression", "gzip")
    writer.parquet(path)


def write_csv(
    df: DataFrame, path: str, *, sep: str = ",", null_value: str = "NA", mode: str = "overwrite", quoting: bool = True
) -> None:
    """CSV with a header; a null is written as ``NA``. Without quoting, text keeps its quotes and outer blanks as they are."""
    writer = df.write.mode(mode).option("header", True).option("sep", sep).option("nullValue", null_value)
    if not quoting:
        writer = writer.option("quote", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.csv(path)


@lru_cache(maxsize=1)
def _own_folder() -> str:
    """One folder of this machine for a local process, gone when it ends."""
    folder = tempfile.mkdtemp(prefix="strataframe-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch_dir(spark: SparkSession) -> str:
    """A new folder every executor can reach: under the session's checkpoint folder.

    Only a local session without that setting gets a folder of this machine, for as long as the process lives.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        shared = _own_folder()
    return f"{shared.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written into a new shared folder and read back: what is read several times is worked out once."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
