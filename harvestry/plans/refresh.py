"""Refresh plans: which targets need work and what to do with their latest work item."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestry import rules
from harvestry.operators.ids import with_new_ids
from harvestry.operators.scans import join_on

CLEARED = ("error_message", "worker_id", "locked_at", "started_at", "completed_at")


def latest_items(
    items: DataFrame, keys: Sequence[str] = ("task_type", "target_id"), order: str = "id"
) -> DataFrame:
    """The newest work item per target."""
    rest = [c for c in items.columns if c not in keys]
    rows = items.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return rows.select(*keys, "_row.*").select(*items.columns)


def expand_pages(groups: DataFrame, pages_col: str = "total_pages", tag_col: str = "field_tag") -> DataFrame:
    """One row per page of each group with target ``tag:page``; groups without pages give none."""
    numbered = groups.filter(F.col(pages_col) >= 1).withColumn(
        "page_no", F.explode(F.sequence(F.lit(1), F.col(pages_col).cast("int")))
    )
    return numbered.withColumns({
        "page_no": F.col("page_no").cast("long"),
        "target_id": F.concat_ws(":", F.col(tag_col).cast("string"), F.col("page_no").cast("string")),
    })


def plan(
    requests: DataFrame, items: DataFrame, policy: str, task_type: str, refresh: bool = False,
    done: str | None = None,
) -> DataFrame:
    """Action per requested target: create, keep, reset, skip or omit.

    ``done`` names a boolean column of ``requests`` saying the entity's detail (policy
    detail) or children (policy children) are already complete.
    """
    table = rules.PLAN_POLICIES[policy]
    latest = latest_items(items.filter(F.col("task_type") == task_type).select("task_type", "target_id", "id", "status"))
    rows = join_on(
        requests, latest.select("target_id", F.col("id").alias("item_id"), F.col("status").alias("item_status")),
        ["target_id"],
    )
    if policy == "group_scan":  # any open item keeps it, not only the latest
        busy = items.filter((F.col("task_type") == task_type) & F.col("status").isin("pending", "running"))
        busy = busy.groupBy("target_id").agg(F.max("id").alias("_open_id"), F.max_by("status", "id").alias("_open_status"))
        rows = join_on(rows, busy, ["target_id"]).withColumns({
            "item_id": F.coalesce("_open_id", "item_id"), "item_status": F.coalesce("_open_status", "item_status")}).drop("_open_id", "_open_status")
    finished = F.lit(False) if done is None else F.coalesce(F.col(done), F.lit(False))
    redo = F.lit(refresh)
    if policy == "children":
        redo = redo | ~finished
    state = F.coalesce("item_status", F.lit("none"))
    action = F.when((state == "completed") & redo, table["completed_refresh"])
    for name in ("none", "pending", "running", "failed", "completed"):
        action = action.when(state == name, table[name])
    if policy == "detail":
        action = F.when(finished, "skip").otherwise(action)
    elif policy == "children":
        action = F.when(finished & ~F.lit(refresh), "skip").otherwise(action)
    return rows.withColumn("action", action)


# --- targets -----------------------------------------------------------------------------------

def targets_drifted(states: DataFrame, statuses: Sequence[str] = ("changed", "missing_index")) -> DataFrame:
    """Every page of the groups whose index drifted."""
    drifted = states.filter(F.col("status").isin(*statuses) & (F.col("total_pages") > 0))
    return expand_pages(drifted)


def oldest_first(entities: DataFrame, n: int | None = None, updated: str = "updated_at", key: str = "journal_id") -> DataFrame:
    ordered = entities.orderBy(F.col(updated).asc_nulls_first(), key)
    return ordered.limit(n) if n else ordered


def _as_targets(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("target_id", F.col(key).cast("string"))


def targets_full(entities: DataFrame, n: int | None = None, updated: str = "updated_at", key: str = "journal_id") -> DataFrame:
    """All entities, or the ``n`` least recently updated; without ``n`` nothing is sorted."""
    return _as_targets(oldest_first(entities, n, updated, key) if n else entities, key)


def targets_missing(flagged: DataFrame, key: str = "journal_id") -> DataFrame:
    """Entities without an expected child count (input: the staleness flags)."""
    return _as_targets(flagged.filter("missing_info"), key)


def targets_shortfall(flagged: DataFrame, key: str = "journal_id") -> DataFrame:
    return _as_targets(flagged.filter("comment_mismatch"), key)


def targets_outdated(flagged: DataFrame, key: str = "journal_id") -> DataFrame:
    return _as_targets(flagged.filter("outdated"), key)


def targets_ids(entities: DataFrame, ids: DataFrame, key: str = "journal_id") -> DataFrame:
    return _as_targets(entities.join(ids.select(key).distinct(), key, "left_semi"), key)


def targets_all(entities: DataFrame, key: str = "journal_id") -> DataFrame:
    return _as_targets(entities, key)


def targets_bad(audited: DataFrame, key: str = "journal_id") -> DataFrame:
    """Entities whose audit is bad, with the rebuild reason and the codes for the work item."""
    extra = F.to_json(F.struct(
        F.lit("detail_quality").alias("rebuild_reason"), F.col("reason_codes").alias("quality_reasons")
    ))
    return _as_targets(audited.filter(F.col("status") == "bad"), key).withColumn("extra_data", extra)


def rebuild_report(planned: DataFrame, requested: DataFrame, key: str = "journal_id") -> DataFrame:
    """Counts of a rebuild: requested, reset or created, running ones left alone, unknown ids."""
    known = planned.select(key).distinct()
    missing = requested.join(known, key, "left_anti").agg(F.count(F.lit(1)).alias("n")).scalar()
    return planned.agg(
        F.count_if(F.col("action").isin("reset", "create")).alias("reset_count"),
        F.count_if(F.col("action") == "keep").alias("skipped_running"),
    ).select(
        requested.agg(F.count(F.lit(1)).alias("n")).scalar().alias("requested"),
        "reset_count", "skipped_running", missing.alias("not_found"),
    )


# --- rewrites ------------------------------------------------------------------------------------

def _reset(items: DataFrame, hit: Column, zero_retries: bool) -> DataFrame:
    hit = F.coalesce(hit, F.lit(False))
    values = {"status": F.lit("pending"), **{c: F.lit(None) for c in CLEARED}}
    if zero_retries:
        values["retry_count"] = F.lit(0).cast("long")
    else:
        # a plain retry forgets the error and the lease only
        values = {k: v for k, v in values.items() if k not in ("started_at", "completed_at")}
    flagged = items.withColumn("_hit", hit)
    return flagged.select(*[
        F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
        for c in items.columns
    ])


def reset_items(
    items: DataFrame, how: str, ids: DataFrame | None = None, limit: int | None = None
) -> DataFrame:
    """Work items after a bulk reset.

    ``retry`` (of ``ids``) and ``retry_oldest`` (the ``limit`` oldest) send failed items
    with retries left back to pending; ``exhausted`` does so for those without any left and
    zeroes the counter; ``force`` resets all of ``ids`` whatever their state.
    """
    failed = F.col("status") == "failed"
    can_retry = failed & (F.col("retry_count") < F.col("max_retry"))
    if how == "exhausted":
        return _reset(items, failed & (F.col("retry_count") >= F.col("max_retry")), zero_retries=True)
    if how == "retry_oldest":
        if limit is None:
            raise ValueError("retry_oldest needs a limit")
        chosen = items.filter(can_retry).orderBy("created_at", "id").limit(limit).select("id")
        chosen = F.broadcast(chosen)  # at most ``limit`` ids
    else:
        chosen = ids.select("id").distinct()
    marked = items.join(chosen.withColumn("_chosen", F.lit(True)), "id", "left")
    hit = F.coalesce("_chosen", F.lit(False))
    if how != "force":
        hit = hit & can_retry
    return _reset(marked, hit, zero_retries=how == "force").select(*items.columns)


def apply_plan(items: DataFrame, planned: DataFrame, task_type: str, now: Column) -> DataFrame:
    """Work items after a plan: reset ones pending again, created ones appended as pending.

    ``planned`` comes from ``plan``; optional columns target_url and extra_data of the
    targets go into created items, and into kept and reset ones as well. Created items are numbered by target_id,
    behind the highest id.
    """
    fresh = {c: F.col(c) for c in ("target_url", "extra_data") if c in planned.columns}
    known = planned.filter(F.col("action").isin("keep", "reset")).select(
        F.col("item_id").alias("id"), (F.col("action") == "reset").alias("_reset"),
        *[col.alias(f"_{c}") for c, col in fresh.items()],
    )
    marked = items.join(known, "id", "left")
    for c in fresh:
        marked = marked.withColumn(c, F.coalesce(f"_{c}", c))
    rewritten = _reset(marked, F.col("_reset"), zero_retries=True).select(*items.columns)
    zero = F.lit(0).cast("long")
    values = {
        "id": F.lit(None), "task_type": F.lit(task_type),
        "target_id": F.col("target_id"), "status": F.lit("pending"), "retry_count": zero,
        "max_retry": F.lit(3).cast("long"), "created_at": now, **fresh,
    }
    created = planned.filter(F.col("action") == "create").select(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in items.schema
    ])
    return rewritten.unionByName(with_new_ids(created, items, F.lit(True), ["target_id"]))


def clear_done(
    entities: DataFrame, targets: DataFrame, key: str = "journal_id",
    flags: Sequence[str] = ("detail_crawled", "comments_crawled"),
) -> DataFrame:
    """Entities with the given done flags cleared where they are planned for another harvest."""
    chosen = targets.select(key).distinct().withColumn("_again", F.lit(True))
    marked = entities.join(chosen, key, "left")
    again = F.coalesce("_again", F.lit(False))
    return marked.select(*[
        (F.col(c) & ~again).alias(c) if c in flags else F.col(c) for c in entities.columns
    ])


def purge_completed(items: DataFrame) -> DataFrame:
    return items.filter(F.col("status") != "completed")


def next_work(items: DataFrame, n: int, task_type: str | None = None, per_type: bool = False) -> DataFrame:
    """Pending items by age, then failed ones with retries left; overall or ``n`` per type."""
    can_retry = (F.col("status") == "failed") & (F.col("retry_count") < F.col("max_retry"))
    rows = items.filter((F.col("status") == "pending") | can_retry)
    if task_type:
        rows = rows.filter(F.col("task_type") == task_type)
    order = [(F.col("status") != "pending"), F.col("created_at"), F.col("id")]
    if not per_type:
        return rows.orderBy(*order).limit(n)
    rank = F.row_number().over(Window.partitionBy("task_type").orderBy(*order))
    return rows.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= n)
