"""Order-dependent operators that stay parallel when one key holds much of the table.

A plain ``Window.partitionBy(key)`` sends a key to a single task. Here the rows are ranged by key and the
full order (ties by a hash of the row), with bounds taken from quantiles, and written once; the
window runs per key and range, and what crosses a bound (the last row, a running sum, a running peak) is carried over
from a summary with one row per key and range. That is done at every size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestry.session import cut_lineage

ROWS_PER_CHUNK = 1_000_000

CHUNK = "_chunk"
TIE = "_tie"


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on ``keys`` (Spark still plans it as an equi-join)."""
    cond = F.lit(True)
    for key in keys:
        cond = cond & left[key].eqNullSafe(right[key])
    return cond


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe join that keeps the left side's key columns once."""
    renamed = right.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    cond = F.lit(True)
    for key in keys:
        cond = cond & left[key].eqNullSafe(renamed[f"_k_{key}"])
    return left.join(renamed, cond, how).drop(*[f"_k_{k}" for k in keys])


def cut_pieces(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Add ``_chunk``, which rises with (keys, order) and holds about ``rows_per_chunk`` rows at most, and ``_tie``.

    Written once, as bounds are drawn anew each time; a lost executor costs a reread. Only rows equal in every
    column can't be told apart.
    """
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = max(least, -(-df.count() // rows_per_chunk))
    ranged = df.withColumn(TIE, F.xxhash64(*plain)).repartitionByRange(pieces, *keys, *order, TIE)
    return cut_lineage(ranged.withColumn(CHUNK, F.spark_partition_id()))


def _carried(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summary rows of keys that lie in several ranges; there are fewer than twice as many as ranges."""
    first, last = F.min(CHUNK), F.max(CHUNK)
    spans = summary.groupBy(*keys).agg(first.alias("_from"), last.alias("_to")).filter("_from < _to").drop("_from", "_to")
    return join_on(summary, spans.withColumn("_spans", F.lit(True)), keys).filter("_spans").drop("_spans")


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    out: str = "previous",
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Add ``out``: a struct of ``cols`` taken from the key's previous row (NULL on the first)."""
    rows = cut_pieces(df, keys, order, rows_per_chunk)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order, TIE)
    last = rows.groupBy(*keys, CHUNK).agg(F.max_by(F.struct(*cols), F.struct(*order, TIE)).alias("_last"))
    carry = _carried(last, keys).select(
        *keys, CHUNK, F.lag("_last").over(Window.partitionBy(*keys).orderBy(CHUNK)).alias("_carry")
    )
    local = rows.withColumn(out, F.lag(F.struct(*cols)).over(inside))
    return (
        join_on(local, carry, [*keys, CHUNK])
        .withColumn(out, F.coalesce(F.col(out), F.col("_carry")))
        .drop("_carry", CHUNK, TIE)
    )


@dataclass(frozen=True)
class Peak:
    """Running maximum of ``sign * running sum`` over the rows where ``when`` holds."""

    of: str
    sign: int = 1
    when: Column | None = None


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    peaks: Mapping[str, Peak] | None = None,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Add inclusive running sums and running peaks per key."""
    peaks = dict(peaks or {})
    rows = cut_pieces(df, keys, order, rows_per_chunk)
    for name, step in sums.items():
        rows = rows.withColumn(f"_step_{name}", step)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order, TIE).rowsBetween(Window.unboundedPreceding, 0)
    local = rows
    for name in sums:
        local = local.withColumn(name, F.sum(f"_step_{name}").over(inside))
    for name, peak in peaks.items():
        value = F.col(peak.of) * peak.sign
        if peak.when is not None:
            value = F.when(peak.when, value)
        local = local.withColumn(f"_at_{name}", value)
    for name in peaks:
        local = local.withColumn(name, F.max(f"_at_{name}").over(inside))

    totals = local.groupBy(*keys, CHUNK).agg(
        *[F.sum(f"_step_{n}").alias(f"_sum_{n}") for n in sums],
        *[F.max(f"_at_{n}").alias(f"_peak_{n}") for n in peaks],
    )
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = _carried(totals, keys)
    for name in sums:
        carry = carry.withColumn(f"_off_{name}", F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)))
    for name, peak in peaks.items():
        shifted = F.col(f"_peak_{name}") + F.col(f"_off_{peak.of}") * peak.sign
        carry = carry.withColumn(f"_shifted_{name}", shifted)
        carry = carry.withColumn(f"_before_{name}", F.max(f"_shifted_{name}").over(before))
    carry = carry.select(
        *keys, CHUNK, *[f"_off_{n}" for n in sums], *[f"_before_{n}" for n in peaks]
    )
    result = join_on(local, carry, [*keys, CHUNK])
    for name in sums:
        result = result.withColumn(f"_off_{name}", F.coalesce(F.col(f"_off_{name}"), F.lit(0)))
    for name, peak in peaks.items():
        here = F.col(name) + F.col(f"_off_{peak.of}") * peak.sign
        result = result.withColumn(name, F.greatest(here, F.col(f"_before_{name}")))
    for name in sums:
        result = result.withColumn(name, F.col(name) + F.col(f"_off_{name}"))
    return result.select(*df.columns, *sums, *peaks)
