"""Ids of created rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestry.operators.scans import CHUNK, ROWS_PER_CHUNK, TIE, cut_pieces


def top_id(table: DataFrame, id_col: str = "id") -> Column:
    """The highest id of ``table``, at least 0."""
    return table.agg(F.greatest(F.coalesce(F.max(id_col), F.lit(0)), F.lit(0)).cast("long").alias("top")).scalar()


def with_new_ids(
    rows: DataFrame, table: DataFrame, is_new: Column, order: Sequence[str], id_col: str = "id", rows_per_chunk: int = ROWS_PER_CHUNK,
    top: int | None = None,
) -> DataFrame:
    """``rows`` where those that are new get the ids behind the highest one of ``table``, or behind ``top``, without gaps, in ``order``.

    The rows are ranged by the order and written once; counts per range give each range its first id. The numbering does not depend
    on the partitions: rows equal in ``order`` go by a hash of the row, and only rows equal in every column are interchangeable.
    """
    ranged = cut_pieces(rows.withColumn("_new", F.coalesce(is_new, F.lit(False))), ["_new"], order, rows_per_chunk)
    counts = ranged.filter("_new").groupBy(CHUNK).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1))  # a row per range
    starts = counts.select(CHUNK, F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(CHUNK, "_new").orderBy(*order, TIE))
    numbered = ranged.withColumn("_place", place).join(starts, CHUNK, "left").withColumn(
        "_top", top_id(table) if top is None else F.lit(top).cast("long"))
    new_id = F.col("_top") + F.col("_before") + F.col("_place")
    return numbered.withColumn(id_col, F.when(F.col("_new"), new_id).otherwise(F.col(id_col))).select(*rows.columns)
