"""Re-resolution of part ids by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestry.catalog.registry import query
from harvestry.operators import resolve as V
from harvestry.sources.tables import load


def _tables(spark, sf):
    part = load(spark, sf, "part")
    key = F.col("p_partkey")
    entities = part.select(key.alias("journal_id"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("category_id"))
    # unknown ids are asked for as well
    asked = entities.select("journal_id").unionByName(
        part.filter("p_type = 'LARGE'").select((key + 10**9).alias("journal_id")))
    error = F.when(F.col("p_type").isin("ECONOMY", "PROMO"), "detail_empty").when(F.col("p_type") == "SMALL", "timeout")
    items = part.select(
        key.alias("id"), F.lit("detail").alias("task_type"), key.cast("string").alias("target_id"),
        F.when(error.isNull(), "completed").otherwise("failed").alias("status"), error.alias("error_message"),
        F.when(F.col("p_type") == "MEDIUM", F.lit('{"quality_reasons": ["detail_empty"]}')).alias("extra_data"),
        F.lit(3).cast("long").alias("retry_count"))
    searched = part.filter("p_type = 'STANDARD'").select(
        key.alias("candidate_id"), F.initcap("p_name").alias("candidate_name"), key.alias("ord"))
    listed = part.select(
        F.col("p_size").cast("long").alias("category_id"), key.alias("candidate_id"),
        F.concat(F.lit(" "), F.upper(F.replace("p_name", F.lit(" "), F.lit("-")))).alias("candidate_name"), key.alias("ord"))
    return asked, entities, items, searched, listed


RESOLVED = """stale AS (SELECT p_partkey AS id, p_name AS name, p_size AS g, p_type FROM part),
c AS (SELECT p_partkey AS cid, p_name AS cname FROM part WHERE p_type = 'STANDARD'),
tried AS (SELECT *, p_type IN ('ECONOMY', 'PROMO') AS failed,
  (SELECT min(cid) FROM c WHERE cname = name AND cid <> id) AS by_name,
  (SELECT min(p.p_partkey) FROM part p WHERE p.p_name = name AND p.p_size = g AND p.p_partkey <> id) AS by_group,
  (SELECT count(*) FROM part p WHERE p.p_size = g) AS in_group FROM stale),
results AS (
  SELECT id AS journal_id, CASE WHEN NOT failed THEN 'not_detail_quality_failure' WHEN coalesce(by_name, by_group) IS NULL THEN 'unresolved' ELSE 'updated' END AS status,
    CASE WHEN failed THEN coalesce(by_name, by_group) END AS new_id,
    CASE WHEN failed AND by_name IS NOT NULL THEN 'name_search' WHEN failed AND by_group IS NOT NULL THEN 'group_full_scan' END AS method,
    CASE WHEN failed AND by_name IS NULL THEN in_group ELSE 0 END AS group_candidate_count,
    CASE WHEN failed THEN coalesce((SELECT string_agg(CAST(cid AS VARCHAR), ',' ORDER BY cid) FROM
      (SELECT cid FROM c WHERE cname = name ORDER BY cid LIMIT 5)), '') ELSE '' END AS candidates FROM tried
  UNION ALL SELECT p_partkey + 1000000000, 'not_found', NULL, NULL, 0, '' FROM part WHERE p_type = 'LARGE')"""


@query("resolve_cascade", f"WITH {RESOLVED} SELECT * FROM results")
def resolve_cascade(spark, sf):
    rows = V.resolve_cascade(*_tables(spark, sf))
    return rows.select("journal_id", "status", "new_id", "method", "group_candidate_count",
                       F.array_join("candidates", ",").alias("candidates"))


@query("resolve_summary", f"WITH {RESOLVED} SELECT status, count(*) AS n FROM results GROUP BY status")
def resolve_summary(spark, sf):
    return V.resolve_summary(V.resolve_cascade(*_tables(spark, sf), ascii_only=True))


@query("resolve_by_name", """
SELECT p_partkey AS journal_id, (SELECT min(c.p_partkey) FROM part c WHERE c.p_name = p.p_name AND c.p_partkey <> p.p_partkey) AS new_id FROM part p""")
def resolve_by_name(spark, sf):
    _, entities, _, _, listed = _tables(spark, sf)
    return V.resolve_by_name(entities, listed).select("journal_id", "new_id")


@query("quality_failures", """
SELECT p_partkey AS id, p_type IN ('ECONOMY', 'PROMO') AS quality_failure FROM part""")
def quality_failures(spark, sf):
    items = _tables(spark, sf)[2]
    return items.select("id", V.is_quality_failure().alias("quality_failure"))


@query("apply_resolutions", f"""
WITH {RESOLVED} SELECT p_partkey AS id, CASE WHEN r.status = 'updated' THEN 'pending' WHEN p_type IN ('ECONOMY', 'PROMO', 'SMALL') THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN r.status = 'updated' AND new_id <> 0 THEN new_id ELSE p_partkey END AS fetch_id,
  CASE WHEN r.status = 'updated' THEN '/detail/' || new_id ELSE 'old' END AS target_url, CASE WHEN r.status = 'updated' THEN method END AS method,
  CASE WHEN r.status = 'updated' THEN CAST(p_size AS BIGINT) END AS category_id, CASE WHEN r.status = 'updated' THEN p_name END AS journal_name FROM part LEFT JOIN results r ON journal_id = p_partkey""")
def apply_resolutions(spark, sf):
    from harvestry.functions.documents import effective_id

    tables = _tables(spark, sf)
    none = F.lit(None).cast("timestamp_ntz")
    items = tables[2].withColumns({
        "worker_id": F.lit("w"), "target_url": F.lit("old"), "locked_at": none, "started_at": none, "completed_at": none})
    rows = V.apply_resolutions(items, V.resolve_cascade(*tables, ascii_only=True), url_format="/detail/%d")
    told = {n: F.get_json_object("extra_data", f"$.{p}") for n, p in (
        ("method", "journal_id_resolution.method"), ("category_id", "category_id"), ("journal_name", "journal_id_resolution.journal_name"))}
    return rows.select("id", "status", effective_id("extra_data", "target_id").alias("fetch_id"), "target_url", told["method"].alias("method"),
                       told["category_id"].cast("long").alias("category_id"), told["journal_name"].alias("journal_name"))


@query("resolved_flags", f"""
WITH {RESOLVED} SELECT p_partkey AS journal_id, r.status <> 'updated' AS detail_crawled FROM part JOIN results r ON journal_id = p_partkey""")
def resolved_flags(spark, sf):
    tables = _tables(spark, sf)
    entities = tables[1].select("journal_id", F.lit(True).alias("detail_crawled"))
    return V.clear_resolved(entities, V.resolve_cascade(*tables, ascii_only=True))
