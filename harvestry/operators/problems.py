"""Problem table: open, resolve, purge, dispatch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry import rules
from harvestry.operators.ids import with_new_ids
from harvestry.operators.scans import ROWS_PER_CHUNK, join_on, running

UPDATED = ("message", "expected_value", "actual_value")


def record_problems(table: DataFrame, new: DataFrame, now: Column, order: Sequence[str] = ()) -> DataFrame:
    """Upsert on the open (journal_id, problem_code); resolved rows stay as they are.

    Within the batch the last report gives the values and the first one the type; an
    already open problem keeps its type.  ``order`` ranks the reports of the batch. New problems are
    numbered by entity and code, behind the highest id.
    """
    rank = F.struct(*order) if order else F.struct(F.lit(0))
    reports = new.groupBy("journal_id", "problem_code").agg(
        F.max_by(F.struct(*UPDATED), rank).alias("_report"),
        F.min_by("problem_type", rank).alias("_type"),
    )
    left = table.withColumn("_open", F.col("resolved") == 0)
    right = reports.select(
        F.col("journal_id").alias("_jid"), F.col("problem_code").alias("_code"), "_report", "_type"
    )
    both = left.join(
        right,
        (F.col("journal_id") == F.col("_jid")) & (F.col("problem_code") == F.col("_code")) & F.col("_open"),
        "full",
    )
    is_new = F.col("_open").isNull()
    reported = F.col("_report").isNotNull()
    values: dict[str, Column] = {
        "journal_id": F.coalesce("journal_id", "_jid"),
        "problem_code": F.coalesce("problem_code", "_code"),
        "problem_type": F.coalesce("problem_type", "_type"),
        "resolved": F.coalesce("resolved", F.lit(0)),
        "created_at": F.when(is_new, now).otherwise(F.col("created_at")),
        "updated_at": F.when(reported, now).otherwise(F.col("updated_at")),
        **{c: F.when(reported, F.col(f"_report.{c}")).otherwise(F.col(c)) for c in UPDATED},
    }
    merged = both.select(*[values.get(c, F.col(c)).alias(c) for c in table.columns])
    return with_new_ids(merged, table, F.col("id").isNull(), ["journal_id", "problem_code"])


def apply_problem_events(
    table: DataFrame, events: DataFrame, order: Sequence[str], at: str, rows_per_chunk: int = ROWS_PER_CHUNK,
    top: int | None = None,
) -> DataFrame:
    """Report and resolve events applied in order.

    ``events`` holds ``kind`` (report or resolve), journal_id, problem_code, problem_type,
    the reported values and the event time.  The resolves cut the events of an (entity,
    code) into rounds: the first round continues the open row, if there is one, and every
    later round with a report is a row of its own.  Where ``table`` is a part of a larger one, ``top`` is the
    highest id of the whole.
    """
    keys = ["journal_id", "problem_code"]
    resolve = F.col("kind") == "resolve"
    counted = running(events, keys, order, {"_n": F.when(resolve, 1).otherwise(0)}, rows_per_chunk=rows_per_chunk)
    rank = F.struct(*order)
    reported = F.when(~resolve, rank)
    rounds = counted.withColumn("_round", F.col("_n") - resolve.cast("int")).groupBy(*keys, "_round").agg(
        F.count_if(~resolve).alias("_reports"),
        F.max_by(F.struct(*UPDATED), reported).alias("_report"),
        F.min_by("problem_type", reported).alias("_type"),
        F.min(F.when(~resolve, F.col(at))).alias("_from"),
        F.max(F.when(~resolve, F.col(at))).alias("_to"),
        F.max(F.when(resolve, F.col(at))).alias("_closed"),
    )
    left = table.withColumn("_slot", F.when(F.col("resolved") == 0, F.lit(0)))
    right = rounds.select(F.col("journal_id").alias("_jid"), F.col("problem_code").alias("_code"),
                          *[c for c in rounds.columns if c not in keys])
    both = left.join(
        right,
        (F.col("journal_id") == F.col("_jid")) & (F.col("problem_code") == F.col("_code"))
        & (F.col("_slot") == F.col("_round")),
        "full",
    )
    is_new = F.col("resolved").isNull()
    has_report = F.coalesce(F.col("_reports") > 0, F.lit(False))
    closed = F.col("_closed").isNotNull()
    values: dict[str, Column] = {
        "journal_id": F.coalesce("journal_id", "_jid"),
        "problem_code": F.coalesce("problem_code", "_code"),
        "problem_type": F.coalesce("problem_type", "_type"),
        "resolved": F.when(closed, 1).otherwise(F.coalesce("resolved", F.lit(0))),
        "resolved_at": F.coalesce("_closed", "resolved_at"),
        "created_at": F.coalesce("created_at", "_from"),
        "updated_at": F.when(has_report, F.col("_to")).otherwise(F.col("updated_at")),
        **{c: F.when(has_report, F.col(f"_report.{c}")).otherwise(F.col(c)) for c in UPDATED},
    }
    merged = both.filter(~is_new | has_report).select(*[values.get(c, F.col(c)).alias(c) for c in table.columns])
    return with_new_ids(merged, table, F.col("id").isNull(), [*keys, "created_at"], top=top)


def _stamp(table: DataFrame, hit: Column, now: Column) -> DataFrame:
    done = (F.col("resolved") == 0) & hit
    return table.withColumns({
        "resolved_at": F.when(done, now).otherwise(F.col("resolved_at")),
        "resolved": F.when(done, F.lit(1)).otherwise(F.col("resolved")),
    })


def resolve_problems(table: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """Resolve by journal_id and problem_code; a NULL code resolves all codes of the entity."""
    exact = keys.filter(F.col("problem_code").isNotNull()).select("journal_id", "problem_code").distinct()
    every = keys.filter(F.col("problem_code").isNull()).select("journal_id").distinct()
    marked = join_on(table, exact.withColumn("_hit", F.lit(True)), ["journal_id", "problem_code"])
    marked = join_on(marked, every.withColumn("_all", F.lit(True)), ["journal_id"])
    hit = F.coalesce("_hit", "_all", F.lit(False))
    return _stamp(marked, hit, now).select(*table.columns)


def resolve_by_id(table: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    marked = table.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return _stamp(marked, F.coalesce("_hit", F.lit(False)), now).select(*table.columns)


def count_resolved(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many rows a resolve step closed."""
    return after.filter(F.col("resolved") == 1).join(
        before.filter(F.col("resolved") == 0).select("id"), "id", "left_semi"
    ).agg(F.count(F.lit(1)).alias("resolved_count"))


def purge_resolved(table: DataFrame) -> DataFrame:
    return table.filter(F.col("resolved") != 1)


def problem_actions(table: DataFrame, resolutions: DataFrame | None = None) -> DataFrame:
    """Action per open (entity, code): refresh_comments, resolve_detail_id or reset.

    A reset closes the problem at once, an id resolution only if ``resolutions``
    (journal_id, status) says ``updated``, a refresh not at all.
    """
    action = (
        F.when(F.col("problem_code") == rules.COMMENT_MISMATCH, "refresh_comments")
        .when(F.col("problem_code").isin(*rules.RERESOLVE_CODES), "resolve_detail_id")
        .otherwise("reset")
    )
    rows = (
        table.filter((F.col("resolved") == 0) & (F.coalesce("problem_code", F.lit("")) != ""))
        .select("journal_id", "problem_code").distinct().withColumn("action", action)
    )
    if resolutions is None:
        updated = F.lit(False)
    else:
        fixed = resolutions.filter(F.col("status") == "updated").select("journal_id").distinct()
        rows = rows.join(fixed.withColumn("_fixed", F.lit(True)), "journal_id", "left")
        updated = F.coalesce("_fixed", F.lit(False))
    resolves = (F.col("action") == "reset") | ((F.col("action") == "resolve_detail_id") & updated)
    return rows.withColumn("resolves", resolves).select("journal_id", "problem_code", "action", "resolves")
