"""Written intermediate tables and size-checked broadcasts, shared by the operators of this folder."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.session import work_folder

#: An id set of at most so many rows may be broadcast (16 MB of longs); larger ones are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it is computed once, and a lost executor costs a reread."""
    folder = work_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished jobs now: it acts when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def only_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``ids``: a broadcast while the counted set is small, else a shuffled semi-join."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, on, "left_semi")


def pieces(rows: int, rows_each: int, least: int = 1) -> int:
    """How many pieces of about ``rows_each`` rows there are; it grows with the data."""
    return max(least, -(-rows // rows_each))


def default_parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written, and marked for a broadcast if its counted rows allow; else joins with it shuffle."""
    df = written(df, purpose)
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def without_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` is null or not in ``ids``; joined as in ``only_ids``."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, on, "left_anti")
