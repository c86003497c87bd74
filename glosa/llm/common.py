"""Helpers the operators share: written intermediate tables, size-checked broadcasts, word runs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosa.session import ensure_checkpoint_dir

#: Words everywhere: maximal runs of characters other than these six (UTF-8 bytes below 0x80,
#: which is what ``bytes.split()`` splits on).
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a table that may be broadcast; counted before each broadcast.
BROADCAST_ROWS = 100_000


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for one intermediate table below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, read by any
    executor, and still there when executors are lost.  The folder goes with
    ``spark.checkpoint.dir``; readers may outlive the call, so it is not removed here."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a (written, narrow) table only if its row count is within the
    bound; beyond it Spark joins by shuffle and splits skewed partitions."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def blank(text: str | Column) -> Column:
    """A text column with null as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
