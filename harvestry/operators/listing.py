"""Listing index: drift, page fingerprints, links, groups and entities seen on pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.functions.text import ids_hash, page_math
from harvestry.operators.dedupe import first_per_key
from harvestry.operators.scans import join_on


def _active_counts(links: DataFrame, key: str) -> DataFrame:
    return links.filter("active").groupBy(key).agg(F.count(F.lit(1)).alias("local_index_count"))


def group_state(groups: DataFrame, links: DataFrame, now: Column, key: str = "category_id") -> DataFrame:
    """Remote against local counts per group; ``groups`` has key, field_tag, remote_total_count."""
    rows = join_on(groups, _active_counts(links, key), [key]).withColumn(
        "local_index_count", F.coalesce("local_index_count", F.lit(0)).cast("long")
    )
    remote, local = F.col("remote_total_count"), F.col("local_index_count")
    math = page_math("remote_total_count")
    return rows.withColumns({
        "total_pages": math["total_pages"],
        "last_page_count": math["last_page_count"],
        "estimated_new_count": F.greatest(remote - local, F.lit(0)),
        "status": F.when((local == 0) & (remote > 0), "missing_index")
        .when(remote != local, "changed").otherwise("in_sync"),
        "last_checked_at": now,
    })


def group_state_after_scan(states: DataFrame, links: DataFrame, now: Column, key: str = "category_id") -> DataFrame:
    """States after a page scan: in sync as soon as nothing new is estimated."""
    rows = join_on(states.drop("local_index_count"), _active_counts(links, key), [key]).withColumn(
        "local_index_count", F.coalesce("local_index_count", F.lit(0)).cast("long")
    )
    new = F.greatest(F.coalesce("remote_total_count", F.lit(0)) - F.col("local_index_count"), F.lit(0))
    rows = rows.withColumn("estimated_new_count", new)
    synced = F.col("estimated_new_count") == 0
    return rows.withColumns({
        "status": F.when(synced, "in_sync").otherwise("changed"),
        "last_full_scanned_at": F.when(synced, now).otherwise(F.col("last_full_scanned_at")),
    }).select(*states.columns)


def page_bounds(
    items: DataFrame, keys: Sequence[str] = ("category_id", "page_no"), position: str = "position_no",
    id_col: str = "journal_id",
) -> DataFrame:
    """Number of items and first and last id of each page."""
    return items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("item_count"),
        F.min_by(id_col, position).alias("first_id"),
        F.max_by(id_col, position).alias("last_id"),
    )


def page_fingerprints(
    items: DataFrame, keys: Sequence[str] = ("category_id", "page_no"), position: str = "position_no",
    id_col: str = "journal_id",
) -> DataFrame:
    """Count, first and last id and the hash of the ordered ids of each listing page.

    A listing page holds ten rows, so the collected list is bounded by the page size.
    """
    listed = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(id_col).alias("id"))))
    ids = F.transform("_rows", lambda r: r["id"])
    return items.groupBy(*keys).agg(listed.alias("_rows")).select(
        *keys,
        F.size("_rows").cast("long").alias("item_count"),
        F.get(ids, F.lit(0)).alias("first_id"),
        F.element_at(ids, -1).alias("last_id"),
        ids_hash(ids).alias("ids_hash"),
    )


def changed_pages(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("category_id", "page_no")) -> DataFrame:
    """Pages that are new, gone or whose fingerprint differs."""
    left = old.select(*keys, F.col("ids_hash").alias("old_hash"))
    right = new.select(*keys, F.col("ids_hash").alias("new_hash"))
    both = left.join(right, list(keys), "full").filter(~F.col("old_hash").eqNullSafe(F.col("new_hash")))
    kind = F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "gone").otherwise("changed")
    return both.withColumn("change", kind)


def upsert_links(
    links: DataFrame, items: DataFrame, now: Column, expire_missing: bool = False,
    keys: Sequence[str] = ("category_id", "journal_id"),
) -> DataFrame:
    """Links with the scanned items merged in and ``is_new`` marking the added ones.

    ``expire_missing`` is for a full scan: links of scanned groups that were not seen
    become inactive.
    """
    seen = first_per_key(items, list(keys), ["page_no", "position_no"], last=True).select(
        *keys, F.struct("page_no", "position_no").alias("_seen")
    )
    both = links.withColumn("_had", F.lit(True)).join(seen, list(keys), "full")
    was_seen = F.col("_seen").isNotNull()
    gone = F.lit(False)
    if expire_missing:
        scanned = items.select(keys[0]).distinct().withColumn("_scanned", F.lit(True))
        both = both.join(scanned, keys[0], "left")
        gone = ~was_seen & F.coalesce("_scanned", F.lit(False))
    values = {
        "page_no": F.coalesce("_seen.page_no", "page_no"),
        "position_no": F.coalesce("_seen.position_no", "position_no"),
        "active": F.when(was_seen, True).when(gone, False).otherwise(F.col("active")),
        "first_seen_at": F.coalesce("first_seen_at", now),
        "last_seen_at": F.when(was_seen, now).otherwise(F.col("last_seen_at")),
    }
    return both.select(
        *[values.get(c, F.col(c)).alias(c) for c in links.columns], F.col("_had").isNull().alias("is_new")
    )


def new_only(
    items: DataFrame, entities: DataFrame, key: str = "journal_id",
    order: Sequence[str] = ("page_no", "position_no"), name: str = "name",
) -> DataFrame:
    """Listing items whose entity is unknown, first occurrence per id, named by id if nameless."""
    first = first_per_key(items, [key], order)
    unknown = first.join(entities.select(key).distinct(), key, "left_anti")
    label = F.coalesce(F.nullif(F.col(name), F.lit("")), F.col(key).cast("string"))
    return unknown.withColumn(name, label)


def upsert_groups(groups: DataFrame, found: DataFrame, key: str = "field_tag") -> DataFrame:
    """Groups with name and total taken from ``found``; ``outcome`` new, updated, unchanged or unseen."""
    right = found.select(key, F.struct("name", "total_count").alias("_found"))
    both = groups.withColumn("_had", F.lit(True)).join(right, key, "full")
    differs = (F.col("name") != F.col("_found.name")) | (
        F.coalesce("total_count", F.lit(0)) != F.col("_found.total_count")
    )
    values = {
        "name": F.coalesce("_found.name", "name"),
        "total_count": F.coalesce("_found.total_count", "total_count"),
    }
    outcome = (
        F.when(F.col("_had").isNull(), "new").when(F.col("_found").isNull(), "unseen")
        .when(differs, "updated").otherwise("unchanged")
    )
    return both.select(*[values.get(c, F.col(c)).alias(c) for c in groups.columns], outcome.alias("outcome"))


def upsert_entities(
    entities: DataFrame, items: DataFrame, key: str = "journal_id", group: str = "category_id",
    order: Sequence[str] = ("page_no", "position_no"),
) -> DataFrame:
    """Entities with listing items merged in: insert, rename, and fill the group if it is null."""
    rank = F.struct(*order)
    seen = items.groupBy(key).agg(
        F.max_by("name", rank).alias("_name"),
        F.min_by(group, F.when(F.col(group).isNotNull(), rank)).alias("_group"),
    )
    both = entities.withColumn("_had", F.lit(True)).join(seen, key, "full")
    renamed = F.col("_name").isNotNull() & ~F.col("_name").eqNullSafe(F.col("name"))
    grouped = F.col(group).isNull() & F.col("_group").isNotNull()
    outcome = (
        F.when(F.col("_had").isNull(), "new").when(F.col("_name").isNull(), "unseen")
        .when(renamed | grouped, "updated").otherwise("unchanged")
    )
    values = {"name": F.coalesce("_name", "name"), group: F.coalesce(F.col(group), F.col("_group"))}
    return both.select(*[values.get(c, F.col(c)).alias(c) for c in entities.columns], outcome.alias("outcome"))


def outcome_counts(results: DataFrame, status: str = "outcome") -> DataFrame:
    return results.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
