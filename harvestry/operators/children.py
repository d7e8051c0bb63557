"""Child sets: complete-or-keep replacement, shortfalls, staleness, ratings."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestry import rules
from harvestry.functions.documents import doc_field, merge_docs
from harvestry.functions.text import first_integer, lenient_int
from harvestry.operators.dedupe import first_per_key
from harvestry.operators.scans import join_on
from harvestry.session import cut_lineage


class Replacement(NamedTuple):
    children: DataFrame
    report: DataFrame
    problems: DataFrame
    resolves: DataFrame


def _complete(protect_empty: bool) -> Column:
    """Whether as many children are there as expected; a count of zero or less asks for none."""
    enough = F.col("crawled_count") >= F.col("total_count")
    return enough & (F.col("total_count") > 0) if protect_empty else enough


def replace_if_complete(
    old: DataFrame, incoming: DataFrame, expected: DataFrame, key: str = "journal_id",
    child: str = "comment_id", order: Sequence[str] = ("position_no",), protect_empty: bool = False,
) -> Replacement:
    """Replace an entity's children only when the incoming set is complete.

    ``expected`` holds key, total_count, total_pages per harvested entity.  Incoming rows
    without a child id are dropped and the first of equal ids is kept.  Complete means
    nothing expected or at least as many kept as expected; ``protect_empty`` keeps the old
    set when nothing is expected.  Entities outside ``expected`` stay untouched.
    """
    named = incoming.filter(F.coalesce(F.col(child).cast("string"), F.lit("")) != "")
    kept = first_per_key(named, [key, child], order)
    counts = kept.groupBy(key).agg(F.count(F.lit(1)).alias("crawled_count"))
    total, pages = lenient_int("total_count"), lenient_int("total_pages")
    report = join_on(expected.select(key, "total_count", "total_pages"), counts, [key]).select(
        key, total.alias("total_count"), pages.alias("total_pages"),
        F.coalesce("crawled_count", F.lit(0)).cast("long").alias("crawled_count"),
    )
    report = report.withColumn("complete", _complete(protect_empty))
    complete = report.filter("complete").select(key)
    children = old.join(complete, key, "left_anti").unionByName(
        kept.join(complete, key, "left_semi").select(*old.columns)
    )
    short = report.filter(~F.col("complete") & (F.col("total_count") > 0))
    message = F.format_string(
        rules.MISMATCH_MESSAGE, "total_count", "crawled_count", "total_pages",
    )
    problems = short.select(
        key, F.lit("warning").alias("problem_type"), F.lit(rules.COMMENT_MISMATCH).alias("problem_code"),
        message.alias("message"), F.col("total_count").alias("expected_value"),
        F.col("crawled_count").alias("actual_value"),
    )
    resolves = complete.select(key, F.lit(rules.COMMENT_MISMATCH).alias("problem_code"))
    return Replacement(children, report, problems, resolves)


class Harvested(NamedTuple):
    children: DataFrame
    report: DataFrame


def apply_harvests(
    old: DataFrame, rows: DataFrame, key: str = "journal_id", harvest: str = "harvest",
    child: str = "comment_id", order: Sequence[str] = ("position_no",), protect_empty: bool = False,
) -> Harvested:
    """Replacement for rows of several harvests (numbered upwards) of the same entities.

    Every row repeats its harvest's total_count and total_pages; a harvest without
    children is one row without a child id.  The last complete harvest of an entity is
    what stays, as if they had been applied one after the other.
    """
    unit = [key, harvest]
    named = rows.filter(F.coalesce(F.col(child).cast("string"), F.lit("")) != "")
    kept = first_per_key(named, [*unit, child], order)
    counts = kept.groupBy(*unit).agg(F.count(F.lit(1)).alias("crawled_count"))
    expected = rows.groupBy(*unit).agg(
        F.max(lenient_int("total_count")).alias("total_count"), F.max(lenient_int("total_pages")).alias("total_pages"))
    report = join_on(expected, counts, unit).withColumn(
        "crawled_count", F.coalesce("crawled_count", F.lit(0)).cast("long"))
    report = report.withColumn("complete", _complete(protect_empty))
    latest = report.filter("complete").groupBy(key).agg(F.max(harvest).alias(harvest))
    children = old.join(latest, key, "left_anti").unionByName(
        kept.join(latest, unit, "left_semi").select(*old.columns))
    return Harvested(children, report)


def update_child_counters(
    entities: DataFrame, report: DataFrame, key: str = "journal_id", doc: str = "detail_data",
    done: str = "comments_crawled",
) -> DataFrame:
    """Write the counters of a replacement report into the documents and set the done flag."""
    counters = F.to_json(F.struct(
        F.col("total_count").alias("comment_count"), F.col("total_pages").alias("comment_pages"),
        F.col("crawled_count").alias("crawled_comment_count"),
    ))
    patch = report.select(key, counters.alias("_patch"), F.col("complete").alias("_complete"))
    merged = F.when(F.col("_patch").isNotNull(), merge_docs(F.col(doc), F.col("_patch")))
    return join_on(entities, patch, [key]).withColumns({
        doc: F.coalesce(merged, F.col(doc)), done: F.coalesce("_complete", F.col(done)),
    }).select(*entities.columns)


def page_shortfall(report: DataFrame, key: str = "journal_id") -> DataFrame:
    """Mismatch problems for harvests with fewer children than all pages but the last hold."""
    least = (F.col("total_pages") - 1) * rules.PAGE_SIZE
    short = report.filter((F.col("total_pages") > 1) & (F.col("crawled_count") < least))
    return short.select(
        key, F.lit("warning").alias("problem_type"), F.lit(rules.COMMENT_MISMATCH).alias("problem_code"),
        F.col("total_count").alias("expected_value"), F.col("crawled_count").alias("actual_value"),
        least.cast("long").alias("least_expected"),
    )


def stale_flags(
    entities: DataFrame, children: DataFrame, now: Column, days: int = 90, key: str = "journal_id",
    doc: str = "detail_data", done: str = "detail_crawled", updated: str = "updated_at",
) -> DataFrame:
    """Finished entities with stored and expected child counts and the three staleness flags."""
    counts = children.groupBy(key).agg(F.count(F.lit(1)).alias("stored"))
    rows = join_on(entities.filter(F.col(done)), counts, [key]).withColumns({
        "stored": F.coalesce("stored", F.lit(0)).cast("long"),
        "expected": doc_field(doc, "comment_count").try_cast("long"),
    })
    oldest = now - F.make_dt_interval(days=F.lit(days))
    return rows.withColumns({
        "missing_info": F.col("expected").isNull(),
        "comment_mismatch": F.coalesce(F.col("stored") < F.col("expected"), F.lit(False)),
        "outdated": F.coalesce(F.col(updated) < oldest, F.lit(False)),
        "diff": F.col("expected") - F.col("stored"),
        "days_ago": F.timestamp_diff("DAY", F.col(updated), now),
    })


def staleness(
    entities: DataFrame, children: DataFrame, now: Column, days: int = 90, cap: int | None = None,
    key: str = "journal_id", name: str = "name", **columns: str,
) -> DataFrame:
    """Report of three lists with the count of each; with ``cap`` its first rows in key order, ranked.

    Without a cap nothing is ranked, so no list passes through one task.
    """
    # the flags are worked out once, for the lists and their counts
    flagged = cut_lineage(stale_flags(entities, children, now, days, key, **columns))
    kinds = ("missing_info", "comment_mismatch", "outdated")
    reasons = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in kinds]))
    rows = flagged.select(
        key, name, "stored", "expected", "diff", "days_ago", F.explode(reasons).alias("reason")
    )
    totals = rows.groupBy("reason").agg(F.count(F.lit(1)).alias("reason_count"))
    if cap is None:
        listed = rows.withColumn("rank", F.lit(None).cast("int"))
    else:
        rank = F.row_number().over(Window.partitionBy("reason").orderBy(key))
        listed = rows.withColumn("rank", rank).filter(F.col("rank") <= cap)
    mismatch, old = F.col("reason") == "comment_mismatch", F.col("reason") == "outdated"
    return listed.join(F.broadcast(totals), "reason").withColumns({
        "expected": F.when(mismatch, F.col("expected")),
        "diff": F.when(mismatch, F.col("diff")),
        "days_ago": F.when(old, F.col("days_ago")),
        "rank": F.col("rank").cast("long"),
    })


def rating_stats(
    children: DataFrame, key: str = "journal_id", rating: str = "rating", at: str = "comment_time"
) -> DataFrame:
    """Count, average of the first integer in the rating (one decimal) and latest time per entity."""
    score = first_integer(rating)
    return children.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_children"),
        F.count(score).alias("n_rated"),
        F.round(F.avg(score), 1).alias("avg_rating"),
        F.max(at).alias("latest_at"),
    )
