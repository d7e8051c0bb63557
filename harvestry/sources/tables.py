"""Table and page scans."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_jdbc(
    spark: SparkSession, options: Mapping[str, str], table: str, split_on: str,
    low: int, high: int, parts: int,
) -> DataFrame:
    """Database scan in ``parts`` ranges of a numeric column, one task and connection each."""
    return (
        spark.read.format("jdbc").options(**options)
        .option("dbtable", table).option("partitionColumn", split_on)
        .option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
        .load()
    )


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Stored raw pages: page_id, url, html."""
    return load(spark, folder, "pages").select("page_id", "url", "html")


def page_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages kept as one file each: url is the file's path."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("url"), F.col("value").alias("html")
    )
