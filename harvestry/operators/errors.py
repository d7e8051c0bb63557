"""Failure classification and its effect on work items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestry import rules
from harvestry.functions.documents import merge_docs
from harvestry.operators.scans import join_on

# families a failure report may carry: endpoint_unavailable, validation, count_mismatch,
# http, parse; any other word means unknown


def classify(
    errors: DataFrame, family: str = "family", message: str = "message", task_type: str = "task_type"
) -> DataFrame:
    """Add code, action, retryable and counts_against_resource."""
    kind, text = F.col(family), F.coalesce(F.col(message), F.lit(""))
    quality = F.lit(False)
    for marker in rules.QUALITY_ERROR_MARKERS:
        quality = quality | F.contains(text, F.lit(marker))
    validation = kind == "validation"
    code = (
        F.when(kind == "endpoint_unavailable", "proxy_unavailable")
        .when((F.col(task_type) == "detail") & validation & quality, "detail_quality_failed")
        .when(validation, "data_validation_failed")
        .when(kind == "count_mismatch", "comment_mismatch")
        .when((kind == "http") | F.contains(text, F.lit(rules.HTTP_FAILURE_MARKER)), "http_request_failed")
        .when(kind == "parse", "parse_error")
        .otherwise("unknown_error")
    )
    coded = errors.withColumn("code", code)
    spark = errors.sparkSession
    # seven fixed rows
    policies = spark.createDataFrame(
        rules.ERROR_POLICIES, "code string, action string, retryable boolean, counts_against_resource boolean"
    )
    return coded.join(F.broadcast(policies), "code").select(
        *errors.columns, "code", "action", "retryable", "counts_against_resource"
    )


def error_history(
    errors: DataFrame, key: str, order: Sequence[str], keep: int = 10,
    fields: Sequence[str] = ("code", "action", "message"),
) -> DataFrame:
    """Last error per item and the ``keep`` errors before it, oldest first.

    Only ``keep`` + 1 rows per item survive each map task.
    """
    recent = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    top = errors.withColumn("_back", F.row_number().over(recent)).filter(F.col("_back") <= keep + 1)
    entry = F.struct((-F.col("_back")).alias("o"), F.struct(*fields).alias("e"))
    rows = top.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    before = F.slice("_all", F.lit(1), F.size("_all") - 1)
    return rows.select(
        key,
        F.element_at("_all", -1)["e"].alias("last_error"),
        F.transform(before, lambda x: x["e"]).alias("error_history"),
    )


def _recorded(errors: DataFrame, order: Sequence[str], now: Column, keep: int = rules.KEPT_ERRORS) -> DataFrame:
    """Last error and the ones before it per item, as JSON texts."""
    stamped = errors.withColumn("recorded_at", now.cast("string"))
    told = error_history(stamped, "id", order, keep, ("code", "action", "message", "recorded_at"))
    return told.select(
        "id", F.to_json("last_error").alias("_error"), F.transform("error_history", lambda e: F.to_json(e)).alias("_errors"))


def _with_errors(extra: Column, keep: int = rules.KEPT_ERRORS) -> Column:
    """The item's document with ``last_error``, and what was last before at the end of ``error_history``."""
    none = F.array().cast("array<string>")
    old = F.coalesce(F.from_json(F.get_json_object(extra, "$.error_history"), "array<string>"), none)
    told = F.array_compact(F.concat(old, F.array(F.get_json_object(extra, "$.last_error")), F.col("_errors")))
    last = F.slice(told, F.greatest(F.size(told) - (keep - 1), F.lit(1)), F.lit(keep))
    patch = F.concat(F.lit('{"last_error":'), F.col("_error"), F.lit(',"error_history":['), F.array_join(last, ","), F.lit("]}"))
    return merge_docs(F.coalesce(extra, F.lit("{}")), patch)


def apply_failures(
    items: DataFrame, errors: DataFrame, now: Column, order: Sequence[str], resolved_ids: DataFrame | None = None
) -> DataFrame:
    """Work items after classified failures (id, message and the columns of ``classify``).

    The last report of an item decides its state: a release puts it back to pending with
    its retries unchanged, anything else fails it.  Retryable failures add one retry each,
    a non-retryable one sets the maximum.  ``counted`` tells whether the item counts as
    failed: not when released, nor when its id (``resolved_ids``) was re-resolved.
    """
    rank = F.struct(*order)
    failing = F.col("action") != "release"
    effect = errors.groupBy("id").agg(
        F.max_by(F.struct("action", "message"), rank).alias("_last"),
        F.count_if(failing & F.col("retryable")).alias("_retries"),
        F.coalesce(F.bool_or(failing & ~F.col("retryable")), F.lit(False)).alias("_stop"),
    )
    rows = join_on(items, effect, ["id"])
    hit = F.col("_last").isNotNull()
    if "extra_data" in items.columns:
        rows = join_on(rows, _recorded(errors, order, now), ["id"])
    released = F.col("_last.action") == "release"
    solved = F.lit(False)
    if resolved_ids is not None:
        rows = join_on(rows, resolved_ids.select("id").distinct().withColumn("_solved", F.lit(True)), ["id"])
        solved = F.coalesce("_solved", F.lit(False)) & (F.col("_last.action") == "resolve_detail_id")
    gone = F.lit(None)
    values = {
        "status": F.when(released, "pending").otherwise("failed"),
        "retry_count": F.when(F.col("_stop"), F.col("max_retry")).otherwise(
            F.col("retry_count") + F.col("_retries")),
        "error_message": F.col("_last.message"),
        "worker_id": F.when(released, gone).otherwise(F.col("worker_id")),
        "started_at": F.when(released, gone).otherwise(F.col("started_at")),
        "locked_at": gone,
        "completed_at": F.when(released, F.col("completed_at")).otherwise(now),
    }
    if "extra_data" in items.columns:
        values["extra_data"] = _with_errors(F.col("extra_data"))
    return rows.select(
        *[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
          for c in items.columns],
        (hit & ~F.coalesce(released, F.lit(False)) & ~solved).alias("counted"),
    )
