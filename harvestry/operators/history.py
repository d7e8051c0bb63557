"""Metric snapshots and field-level change history."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry import rules
from harvestry.functions.documents import canonical_json, doc_field, record_hash
from harvestry.functions.text import metric_text
from harvestry.operators.dedupe import first_per_key
from harvestry.operators.scans import ROWS_PER_CHUNK, join_on, with_previous

SCORES = ("impact_factor", "impact_factor_realtime")


def observations(entities: DataFrame, keep: Sequence[str], doc: str = "detail_data") -> DataFrame:
    """The metric fields of entity rows: columns, NULL where an entity has none, and the child counters of the document."""
    def field(name: str):
        if name in rules.METRIC_COUNTERS:
            return doc_field(doc, name)
        return F.col(name) if name in entities.columns else F.lit(None).cast("string")

    return entities.select(*keep, *[field(f).alias(f) for f in rules.METRIC_FIELDS])


def metric_records(
    obs: DataFrame, keys: Sequence[str], order: Sequence[str],
    fields: Sequence[str] = rules.METRIC_FIELDS, decimals: Sequence[str] = SCORES,
) -> DataFrame:
    """Observations with every metric as text, the canonical record and its hash."""
    texts = {f: metric_text(F.col(f), f in decimals) for f in fields}
    record = canonical_json({f: F.col(f) for f in fields})
    rows = obs.select(*keys, *order, *[c.alias(f) for f, c in texts.items()])
    return rows.withColumn("metrics", record).withColumn("metric_hash", record_hash(F.col("metrics")))


def snapshots(
    obs: DataFrame, keys: Sequence[str] = ("journal_id", "source"), order: Sequence[str] = ("at", "seq"),
    fields: Sequence[str] = rules.METRIC_FIELDS, decimals: Sequence[str] = SCORES,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Observations that are the first of their key or differ from the one before.

    Comparing with the previous observation equals comparing with the previous stored
    snapshot, because an observation that was not stored equals the stored one.
    """
    records = metric_records(obs, keys, order, fields, decimals).select(
        *keys, *order, "metrics", "metric_hash"
    )
    seen = with_previous(records, keys, order, ["metric_hash"], "_before", rows_per_chunk)
    is_new = F.col("_before").isNull() | (F.col("_before.metric_hash") != F.col("metric_hash"))
    return seen.filter(is_new).drop("_before")


def changes(
    obs: DataFrame, keys: Sequence[str] = ("journal_id", "source"), order: Sequence[str] = ("at", "seq"),
    fields: Sequence[str] = rules.METRIC_FIELDS, decimals: Sequence[str] = SCORES,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """One row per field that differs (null-safe) from the key's previous observation."""
    texts = obs.select(
        *keys, *order, *[metric_text(F.col(f), f in decimals).alias(f) for f in fields]
    )
    return field_changes(with_previous(texts, keys, order, list(fields), "_before", rows_per_chunk),
                         keys, order, fields)


def field_changes(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str]
) -> DataFrame:
    """Long rows for the differing fields; ``_before`` holds the previous values."""
    pairs = [
        F.struct(
            F.lit(f).alias("field_name"),
            F.col(f"_before.{f}").alias("old_value"),
            F.col(f).alias("new_value"),
        )
        for f in fields
    ]
    differing = F.filter(F.array(*pairs), lambda p: ~p["old_value"].eqNullSafe(p["new_value"]))
    return (
        rows.filter(F.col("_before").isNotNull())
        .select(*keys, *order, F.explode(differing).alias("_c"))
        .select(*keys, *order, "_c.*")
    )


class Advanced(NamedTuple):
    state: DataFrame
    snapshots: DataFrame
    changes: DataFrame
    late: DataFrame


def advance_history(
    state: DataFrame | None, obs: DataFrame, keys: Sequence[str], order: Sequence[str],
    fields: Sequence[str] = rules.METRIC_FIELDS, decimals: Sequence[str] = SCORES,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> Advanced:
    """One step of an incremental history: the state holds the last record of every key.

    Observations not after the last one of their key come out as ``late`` and change nothing.
    """
    records = metric_records(obs, keys, order, fields, decimals).withColumn("_new", F.lit(True))
    late = records.limit(0)
    if state is not None:
        last = state.select(*keys, F.struct(*order).alias("_last"))
        marked = join_on(records, last, keys)
        in_time = F.col("_last").isNull() | (F.struct(*order) > F.col("_last"))
        late = marked.filter(~in_time).drop("_last")
        records = marked.filter(in_time).drop("_last").unionByName(state.withColumn("_new", F.lit(False)))
    seen = with_previous(records, keys, order, [*fields, "metric_hash"], "_before", rows_per_chunk)
    fresh = seen.filter("_new")
    is_new = F.col("_before").isNull() | (F.col("_before.metric_hash") != F.col("metric_hash"))
    return Advanced(
        first_per_key(records.drop("_new"), list(keys), list(order), last=True),
        fresh.filter(is_new).select(*keys, *order, "metrics", "metric_hash"),
        field_changes(fresh, keys, order, fields),
        late.select(*keys, *order, "metrics"),
    )


def change_feed(
    changed: DataFrame, keys: Sequence[str] = ("journal_id",), at: str = "at",
    ties: Sequence[str] = ("seq", "field_name"),
) -> DataFrame:
    """Changes by entity, latest first."""
    return changed.orderBy(*keys, F.col(at).desc(), *ties)
