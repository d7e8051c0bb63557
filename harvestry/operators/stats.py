"""Counts and rates over entities, work items, reporters, problems and endpoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry import rules
from harvestry.operators.resources import MANAGED, is_available
from harvestry.operators.scans import join_on


def catalog_totals(
    groups: DataFrame, entities: DataFrame, children: DataFrame, detail_done: str = "detail_crawled"
) -> DataFrame:
    n = F.count(F.lit(1)).alias("n")
    return entities.agg(
        F.count(F.lit(1)).alias("entities"), F.count_if(F.col(detail_done)).alias("entities_with_detail")
    ).select(
        groups.agg(n).scalar().alias("groups"), "entities", "entities_with_detail",
        children.agg(n).scalar().alias("children"),
    )


def _filled(counted: DataFrame, dimension: str, values: Sequence[str]) -> DataFrame:
    """Counts per allowed value, zero where none occurred."""
    allowed = counted.sparkSession.createDataFrame([(v,) for v in values], "value string")
    return allowed.join(counted, "value", "left").select(
        F.lit(dimension).alias("dimension"), "value", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def work_stats(
    items: DataFrame, statuses: Sequence[str] = rules.TASK_STATUSES, types: Sequence[str] = rules.TASK_TYPES
) -> DataFrame:
    """Long rows (dimension, value, n): by_status, by_type, by_worker (running only), total."""
    # one pass: status, type and running worker counted together, then rolled up three ways
    worker = F.when(F.col("status") == "running", F.coalesce("worker_id", F.lit("unknown")))
    base = items.groupBy("status", "task_type", worker.alias("worker")).agg(F.count(F.lit(1)).alias("n"))

    def by(column: str) -> DataFrame:
        return base.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.sum("n").alias("n"))

    by_status = _filled(by("status"), "by_status", statuses)
    total = by_status.agg(F.sum("n").alias("n")).select(
        F.lit("total").alias("dimension"), F.lit("total").alias("value"), "n")
    workers = by("worker").select(F.lit("by_worker").alias("dimension"), "value", "n")
    return (
        by_status.unionByName(_filled(by("task_type"), "by_type", types)).unionByName(workers).unionByName(total)
    )


def active_reporters(items: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    since = now - F.make_dt_interval(mins=F.lit(minutes))
    recent = items.filter(F.col("worker_id").isNotNull() & (F.col("locked_at") >= since))
    return recent.groupBy("worker_id").agg(
        F.count(F.lit(1)).alias("task_count"), F.max("locked_at").alias("last_active")
    )


def reporters_by_liveness(reporters: DataFrame, now: Column, timeout: int = 120) -> DataFrame:
    """Add is_online and busy; overdue reporters are shown offline with nothing running."""
    since = now - F.make_dt_interval(secs=F.lit(timeout))
    online = F.coalesce(F.col("last_heartbeat") >= since, F.lit(False))
    stale = (F.col("status") != "offline") & ~F.col("is_online")
    rows = reporters.withColumn("is_online", online)
    rows = rows.withColumns({
        "status": F.when(stale, "offline").otherwise(F.col("status")),
        "current_task_count": F.when(stale, 0).otherwise(F.coalesce("current_task_count", F.lit(0))).cast("long"),
    })
    return rows.withColumn("busy", F.col("is_online") & (F.col("current_task_count") > 0))


def workers_by_status(reporters: DataFrame, now: Column, status: str | None = None, timeout: int = 120) -> DataFrame:
    rows = reporters_by_liveness(reporters, now, timeout)
    wanted = {"online": F.col("is_online"), "offline": ~F.col("is_online"), "busy": F.col("busy")}
    if status in wanted:
        rows = rows.filter(wanted[status])
    return rows.orderBy(F.col("last_heartbeat").desc_nulls_last(), "worker_id")


def reporter_summary(reporters: DataFrame, now: Column, timeout: int = 120) -> DataFrame:
    rows = reporters_by_liveness(reporters, now, timeout)
    return rows.agg(
        F.count(F.lit(1)).alias("total_workers"),
        F.count_if("is_online").alias("online_workers"),
        F.count_if(~F.col("is_online")).alias("offline_workers"),
        F.count_if("busy").alias("busy_workers"),
        F.coalesce(F.sum("total_completed"), F.lit(0)).alias("total_completed"),
        F.coalesce(F.sum("total_failed"), F.lit(0)).alias("total_failed"),
    )


def reporter_detail(items: DataFrame, now: Column, hours: int = 1) -> DataFrame:
    """Per reporter: running items and what it completed and failed in the last hours."""
    recent = F.col("completed_at") >= now - F.make_dt_interval(hours=F.lit(hours))
    return items.filter(F.col("worker_id").isNotNull()).groupBy("worker_id").agg(
        F.count_if(F.col("status") == "running").alias("running"),
        F.count_if((F.col("status") == "completed") & recent).alias("recent_completed"),
        F.count_if((F.col("status") == "failed") & recent).alias("recent_failed"),
    )


def running_by_reporter(items: DataFrame) -> DataFrame:
    running = items.filter((F.col("status") == "running") & F.col("worker_id").isNotNull())
    return running.groupBy("worker_id").agg(F.count(F.lit(1)).alias("running"))


def reporters_with_running(reporters: DataFrame, items: DataFrame) -> DataFrame:
    return join_on(reporters, running_by_reporter(items), ["worker_id"]).withColumn(
        "running", F.coalesce("running", F.lit(0)).cast("long")
    )


def problem_stats(problems: DataFrame) -> DataFrame:
    """Long rows: total, unresolved, resolved, open by_type (zero-filled) and open by_code."""
    base = problems.groupBy("resolved", "problem_type", "problem_code").agg(F.count(F.lit(1)).alias("n"))
    is_open = F.col("resolved") == 0
    zero = F.lit(0)
    overall = base.agg(
        F.coalesce(F.sum("n"), zero).alias("total"),
        F.coalesce(F.sum(F.when(is_open, F.col("n"))), zero).alias("unresolved"),
        F.coalesce(F.sum(F.when(~is_open, F.col("n"))), zero).alias("resolved"),
    ).select(F.explode(F.array(*[
        F.struct(F.lit("overall").alias("dimension"), F.lit(c).alias("value"), F.col(c).cast("long").alias("n"))
        for c in ("total", "unresolved", "resolved")
    ])).alias("r")).select("r.*")
    opened = base.filter(is_open)
    by_type = opened.groupBy(F.col("problem_type").alias("value")).agg(F.sum("n").alias("n"))
    by_code = opened.groupBy(F.col("problem_code").alias("value")).agg(F.sum("n").alias("n")).select(
        F.lit("by_code").alias("dimension"), "value", "n")
    return overall.unionByName(_filled(by_type, "by_type", rules.PROBLEM_TYPES)).unionByName(by_code)


def endpoint_stats(endpoints: DataFrame, managed_source: str = MANAGED, base_port: int = 60000) -> DataFrame:
    """Pool counts, totals, success rate (percent, one decimal) and mean response time."""
    active, valid = F.col("is_active"), F.col("is_valid")
    zero = F.lit(0)
    rows = endpoints.agg(
        F.count(zero).alias("total"),
        F.count_if(active).alias("active"),
        F.count_if(active & valid).alias("valid"),
        F.count_if(is_available(managed_source, base_port)).alias("assignable"),
        F.count_if(~active).alias("inactive"),
        F.count_if(active & ~valid).alias("active_invalid"),
        F.count_if(active & (F.col("proxy_type") == "tunnel")).alias("tunnel"),
        F.count_if(active & (F.col("proxy_type") == "private")).alias("private"),
        F.coalesce(F.sum("success_count"), zero).alias("total_success"),
        F.coalesce(F.sum("total_fail_count"), zero).alias("total_fail"),
        F.avg("response_time").alias("_avg"),
    )
    requests = F.col("total_success") + F.col("total_fail")
    return rows.withColumns({
        "total_requests": requests,
        "success_rate": F.when(requests > 0, F.round(F.col("total_success") / requests * 100, 1)).otherwise(0.0),
        "avg_response_time": F.coalesce(F.bround("_avg", 0), F.lit(0.0)),
    }).drop("_avg")


def named_order(df: DataFrame, kind: str) -> DataFrame:
    """Groups by name, endpoints by id, reporters by latest heartbeat."""
    orders = {
        "groups": [F.col("name"), F.col("id")],
        "endpoints": [F.col("id")],
        "reporters": [F.col("last_heartbeat").desc_nulls_last(), F.col("worker_id")],
    }
    return df.orderBy(*orders[kind])
