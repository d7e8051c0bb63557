"""Re-resolution of stale ids by name, without ever pairing up all equal names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestry import rules
from harvestry.functions.documents import merge_docs
from harvestry.functions.names import name_key
from harvestry.operators.dedupe import first_per_key
from harvestry.operators.scans import join_on

MAX_KEPT = 5
MAX_SAMPLE = 20


def flag_known(
    candidates: DataFrame, entities: DataFrame, key: str = "journal_id", out: str = "exists_in_db"
) -> DataFrame:
    known = entities.select(key).distinct().withColumn("_known", F.lit(True))
    return candidates.join(known, key, "left").withColumn(
        out, F.coalesce("_known", F.lit(False))
    ).drop("_known")


def split_found(requested: DataFrame, entities: DataFrame, key: str = "journal_id") -> tuple[DataFrame, DataFrame]:
    known = entities.select(key).distinct()
    return requested.join(known, key, "left_semi"), requested.join(known, key, "left_anti")


def is_quality_failure(extra: str = "extra_data", error: str = "error_message") -> Column:
    """Failed detail item whose failure is about record quality."""
    by_reason = F.get_json_object(extra, "$.rebuild_reason") == "detail_quality"
    reasons = F.from_json(F.get_json_object(extra, "$.quality_reasons"), "array<string>")
    by_code = F.exists(reasons, lambda r: F.startswith(r, F.lit("detail_")))
    by_text = F.lit(False)
    for marker in rules.QUALITY_ITEM_MARKERS:
        by_text = by_text | F.contains(F.coalesce(F.col(error), F.lit("")), F.lit(marker))
    reason = F.coalesce(by_reason, F.lit(False)) | F.coalesce(by_code, F.lit(False)) | by_text
    return (F.col("task_type") == "detail") & (F.col("status") == "failed") & reason


def _two_best(candidates: DataFrame, within: Sequence[str], id_col: str, order: Sequence[str]) -> DataFrame:
    """Per group the first two different candidate ids in listing order.

    Two are enough: whatever id a stale row must avoid, one of them differs from it.  The
    rank filter is applied before the shuffle, so a name shared by a third of the rows
    sends two rows per task.
    """
    single = first_per_key(candidates.select(*within, id_col, *order), [*within, id_col], order)
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(*order, id_col))
    return (
        single.withColumn("_rank", rank).filter(F.col("_rank") <= 2)
        .groupBy(*within)
        .agg(
            F.max(F.when(F.col("_rank") == 1, F.col(id_col))).alias("_first"),
            F.max(F.when(F.col("_rank") == 2, F.col(id_col))).alias("_second"),
        )
    )


def resolve_by_name(
    stale: DataFrame, candidates: DataFrame, id_col: str = "journal_id", name_col: str = "name",
    candidate_id: str = "candidate_id", candidate_name: str = "candidate_name",
    order: Sequence[str] = ("ord",), within: Sequence[str] = (), out: str = "new_id", ascii_only: bool = False,
) -> DataFrame:
    """Add ``out``: the first candidate with the same normalised name and another id.

    ``within`` are further columns (e.g. the group) that must be equal.  A blank
    normalised name never matches.
    """
    named = candidates.withColumn("_key", name_key(candidate_name, ascii_only))
    keyed = stale.withColumn("_key", name_key(name_col, ascii_only))
    best = _two_best(named.filter(F.col("_key") != ""), ["_key", *within], candidate_id, order)
    return _pick(keyed, best, ["_key", *within], id_col, out).drop("_key")


def _pick(keyed: DataFrame, best: DataFrame, on: Sequence[str], id_col: str, out: str) -> DataFrame:
    other = F.when(F.col("_first") != F.col(id_col), F.col("_first")).otherwise(F.col("_second"))
    return keyed.join(best, list(on), "left").withColumn(out, other).select(*keyed.columns, out)


def _samples(candidates: DataFrame, within: Sequence[str], order: Sequence[str], n: int, out: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(*order, "candidate_id"))
    top = candidates.withColumn("_rank", rank).filter(F.col("_rank") <= n)
    listed = F.array_sort(F.collect_list(F.struct("_rank", "candidate_id")))
    return top.groupBy(*within).agg(F.transform(listed, lambda r: r["candidate_id"]).alias(out))


def resolve_cascade(
    requested: DataFrame, entities: DataFrame, items: DataFrame, search_candidates: DataFrame,
    group_candidates: DataFrame, order: Sequence[str] = ("ord",), ascii_only: bool = False,
) -> DataFrame:
    """Outcome per requested journal_id.

    Name-search candidates (candidate_id, candidate_name, ord) come first; the listing of
    the entity's own group (category_id as well) is used only when they give nothing.
    Status: not_found, not_detail_quality_failure, updated or unresolved.
    """
    failed = items.filter(is_quality_failure()).select(
        F.col("target_id").try_cast("long").alias("journal_id")
    ).distinct().withColumn("_failed", F.lit(True))
    own = entities.select("journal_id", "name", "category_id", F.lit(True).alias("_known"))
    base = join_on(join_on(requested.select("journal_id").distinct(), own, ["journal_id"]), failed, ["journal_id"])
    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("_key", name_key(name, ascii_only))

    searched = keyed(search_candidates, "candidate_name").filter(F.col("_key") != "")
    listing = keyed(group_candidates, "candidate_name").filter(F.col("_key") != "")
    in_group = ["_key", "category_id"]
    rows = keyed(base, "name")
    rows = _pick(rows, _two_best(searched, ["_key"], "candidate_id", order), ["_key"], "journal_id", "_by_name")
    rows = _pick(rows, _two_best(listing, in_group, "candidate_id", order), in_group, "journal_id", "_by_group")

    single = first_per_key(searched.select("_key", "candidate_id", *order), ["_key", "candidate_id"], order)
    kept = _samples(single, ["_key"], order, MAX_KEPT, "candidates")
    listed = group_candidates.groupBy("category_id").agg(F.count(F.lit(1)).alias("_n"))
    sample = _samples(group_candidates, ["category_id"], order, MAX_SAMPLE, "_sample")
    rows = join_on(join_on(rows.join(kept, "_key", "left"), listed, ["category_id"]), sample, ["category_id"])

    chosen = F.coalesce("_by_name", "_by_group")
    eligible = F.col("_known").isNotNull() & F.col("_failed").isNotNull()
    scanned = eligible & F.col("_by_name").isNull() & F.col("category_id").isNotNull()
    status = (
        F.when(F.col("_known").isNull(), "not_found")
        .when(F.col("_failed").isNull(), "not_detail_quality_failure")
        .when(chosen.isNotNull(), "updated").otherwise("unresolved")
    )
    method = F.when(F.col("_by_name").isNotNull(), "name_search").when(
        F.col("_by_group").isNotNull(), "group_full_scan")
    none = F.array().cast("array<long>")
    return rows.select(
        "journal_id", "name", "category_id", status.alias("status"),
        F.when(eligible, chosen).alias("new_id"),
        F.when(eligible, method).alias("method"),
        F.when(eligible, F.coalesce("candidates", none)).otherwise(none).alias("candidates"),
        F.when(scanned, F.coalesce("_n", F.lit(0))).otherwise(0).cast("long").alias("group_candidate_count"),
        F.when(scanned, F.coalesce("_sample", none)).otherwise(none).alias("group_sample"),
    )


def resolve_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def apply_resolutions(items: DataFrame, results: DataFrame, now: Column | None = None, url_format: str | None = None) -> DataFrame:
    """Quality-failed detail items of updated ids back to pending, fetching the new id.

    The document gets the ids, the group and a record of the resolution with its method and the first candidates;
    the target URL is ``url_format`` with the new id, if given. Running items are left alone.
    """
    moved = results.filter(F.col("status") == "updated").select(
        F.col("journal_id").cast("string").alias("target_id"), "new_id", "journal_id", "category_id",
        F.to_json(F.struct(
            F.col("journal_id").alias("old_journal_id"), F.col("new_id").alias("new_journal_id"), F.col("name").alias("journal_name"), "method",
            (F.lit(None) if now is None else now).cast("string").alias("resolved_at"), F.slice("candidates", 1, MAX_KEPT).alias("candidates"))).alias("_record"))
    rows = join_on(items, moved, ["target_id"])
    hit = F.col("new_id").isNotNull() & F.coalesce(is_quality_failure(), F.lit(False))
    ids = F.to_json(F.struct(
        "journal_id", "category_id", F.col("new_id").alias("fetch_journal_id"), F.col("new_id").alias("resolved_journal_id")
    ))
    patch = F.concat(F.rtrim(ids, F.lit("}")), F.lit(',"journal_id_resolution":'), F.col("_record"), F.lit("}"))
    rows = rows.withColumn("_hit", hit)
    values = {} if url_format is None else {"target_url": F.format_string(url_format, F.col("new_id"))}
    values |= {
        "extra_data": merge_docs("extra_data", patch), "status": F.lit("pending"),
        "retry_count": F.lit(0).cast("long"), "error_message": F.lit(None), "worker_id": F.lit(None),
        "locked_at": F.lit(None), "started_at": F.lit(None), "completed_at": F.lit(None),
    }
    return rows.select(*[
        F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
        for c in items.columns
    ])


def clear_resolved(entities: DataFrame, results: DataFrame, key: str = "journal_id", done: str = "detail_crawled") -> DataFrame:
    """Entities whose id was re-resolved have their detail to fetch again."""
    moved = results.filter(F.col("status") == "updated").select(key).distinct().withColumn("_moved", F.lit(True))
    return join_on(entities, moved, [key]).withColumn(done, F.col(done) & F.col("_moved").isNull()).drop("_moved")
