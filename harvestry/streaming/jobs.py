"""Streaming forms of the incremental operators; the batch operators are their definition."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from harvestry import rules
from harvestry.operators import children as C
from harvestry.operators import history as H
from harvestry.operators import problems as P
from harvestry.operators import resources as R
from harvestry.operators.dedupe import first_per_key
from harvestry.streaming.batches import start_batches


def stream_history(
    obs: DataFrame, folder: str, keys: Sequence[str] = ("journal_id", "source"),
    order: Sequence[str] = ("at", "seq"), fields: Sequence[str] = rules.METRIC_FIELDS,
    decimals: Sequence[str] = H.SCORES,
) -> StreamingQuery:
    """Outputs ``snapshots``, ``changes`` and ``late`` (not after the last one of their key)."""

    def step(state: DataFrame | None, batch: DataFrame):
        new = H.advance_history(state, batch, keys, order, fields, decimals)
        return new.state, {"snapshots": new.snapshots, "changes": new.changes, "late": new.late}

    return start_batches(obs, folder, step, keys)


def stream_counters(
    events: DataFrame, folder: str, key: str, order: Sequence[str], success: Column,
    limit: int = R.MAX_FAILS, exempt: Column | None = None,
) -> StreamingQuery:
    """Output ``counters`` after every outcome; the state holds the latest ones per endpoint."""
    counters = ("success_count", "fail_count", "total_fail_count", "is_valid")

    def step(state: DataFrame | None, batch: DataFrame):
        counted = R.clamped_counters(batch, key, order, success, state, limit, exempt)
        latest = first_per_key(counted.select(key, *order, *counters), [key], order, last=True)
        latest = latest.select(key, *counters)
        if state is not None:
            latest = latest.unionByName(state.join(latest.select(key), key, "left_anti"))
        return latest, {"counters": counted}

    return start_batches(events, folder, step, [key])


def live_sessions(beats: DataFrame, key: str = "worker_id", at: str = "ts", timeout: int = 120) -> DataFrame:
    """Periods in which a reporter was online: heartbeats at most ``timeout`` seconds apart.

    Beats in the same slot of ``timeout`` seconds always belong together, so they are
    aggregated first, on the map side too.  What the window then sees of a reporter is
    bounded by the time span, not by how often it reports.
    """
    span = F.make_dt_interval(secs=F.lit(timeout))
    second = F.unix_date(F.col(at).cast("date")).cast("long") * 86400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    slots = beats.groupBy(key, F.floor(second / timeout).alias("_slot")).agg(
        F.min(at).alias("_lo"), F.max(at).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    in_order = Window.partitionBy(key).orderBy("_slot")
    gap = F.col("_lo") > F.lag("_hi").over(in_order) + span
    numbered = slots.withColumn("_gap", F.coalesce(gap, F.lit(True)).cast("int"))
    numbered = numbered.withColumn("_period", F.sum("_gap").over(in_order))
    return numbered.groupBy(key, "_period").agg(
        F.min("_lo").alias("online_at"), F.max("_hi").alias("last_heartbeat"), F.sum("_n").alias("beats")
    ).select(key, "online_at", "last_heartbeat", (F.col("last_heartbeat") + span).alias("offline_at"), "beats")


def period_events(periods: DataFrame, now: Column | None = None, key: str = "worker_id") -> DataFrame:
    """``online`` and ``offline`` events of periods (batch or stream); with ``now`` only what has happened by then."""
    happened = F.array(
        F.struct(F.lit("online").alias("event"), F.col("online_at").alias("at")), F.struct(F.lit("offline").alias("event"), F.col("offline_at").alias("at")))
    events = periods.select(key, F.explode(happened).alias("e")).select(key, "e.event", "e.at")
    return events if now is None else events.filter(F.col("at") <= now)


def stream_liveness(
    beats: DataFrame, folder: str, key: str = "worker_id", at: str = "ts", timeout: int = 120,
    late_by: str = "1 minute",
) -> StreamingQuery:
    """Append the periods of ``live_sessions`` to ``folder``/periods once the watermark passed their end.

    What is missing there is still online.  On a cluster with very chatty reporters set
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` to true, which
    merges beats before the shuffle.
    """
    # watermarks need instants, so local times are read in the session's zone
    timed = beats.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late_by)
    period = F.session_window(at, f"{timeout} seconds 1 microseconds")
    periods = timed.groupBy(period.alias("period"), key).agg(
        F.count(F.lit(1)).alias("beats"), F.max(at).alias("last_heartbeat")
    ).select(
        key, F.col("period.start").alias("online_at"), "last_heartbeat",
        (F.col("last_heartbeat") + F.make_dt_interval(secs=F.lit(timeout))).alias("offline_at"), "beats",
    )
    writer = periods.writeStream.format("parquet").outputMode("append")
    return writer.option("checkpointLocation", f"{folder}/checkpoint").option(
        "path", f"{folder}/periods").trigger(availableNow=True).start()


def stream_problems(
    events: DataFrame, folder: str, table: DataFrame, order: Sequence[str], at: str
) -> StreamingQuery:
    """Problem table kept up to date from report and resolve events; the state is the table."""
    step = partial(_problem_step, order=order, at=at)
    return start_batches(events, folder, step, ["journal_id"], first_state=table, id_col="id")


def _problem_step(state: DataFrame, batch: DataFrame, order: Sequence[str], at: str, top: int):
    return P.apply_problem_events(state, batch, order, at, top=top), {}


def stream_children(
    harvests: DataFrame, folder: str, children: DataFrame, key: str = "journal_id", **columns
) -> StreamingQuery:
    """Child sets replaced by complete harvests; the state is the child table."""

    def step(state: DataFrame, batch: DataFrame):
        result = C.apply_harvests(state, batch, key, **columns)
        return result.children, {"reports": result.report}

    return start_batches(harvests, folder, step, [key], first_state=children)
