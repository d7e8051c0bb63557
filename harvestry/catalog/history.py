"""Metric history over the orders of each customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestry.catalog import bindings as B
from harvestry.catalog.registry import query
from harvestry.operators import history as H
from harvestry.operators.scans import with_previous
from harvestry.sources.tables import load

KEYS, ORDER = ["journal_id", "source"], ["seen_at", "seq"]
FIELDS = ["status", "priority", "score", "clerk"]


def observations(spark, sf):
    return load(spark, sf, "orders").select(
        F.col("o_custkey").alias("journal_id"), F.lit("detail").alias("source"),
        F.col("o_orderdate").alias("seen_at"), F.col("o_orderkey").alias("seq"),
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderpriority") > "3", F.col("o_orderpriority")).alias("priority"),
        F.floor(F.col("o_totalprice") / 250000).alias("score"),
        F.lit(None).cast("string").alias("clerk"),
    )


OBS = """obs AS (
  SELECT o_custkey AS journal_id, 'detail' AS source, o_orderdate AS seen_at, o_orderkey AS seq, o_orderstatus AS status,
    CASE WHEN o_orderpriority > '3' THEN o_orderpriority END AS priority,
    CAST(CAST(floor(o_totalprice / 250000) AS DECIMAL(10, 4)) AS VARCHAR) AS score FROM orders),
rec AS (SELECT *, '{"clerk": null, "priority": ' || coalesce('"' || priority || '"', 'null') || ', "score": "' || score
  || '", "status": "' || status || '"}' AS metrics FROM obs),
prev AS (SELECT *, lag(metrics) OVER w AS p_metrics, lag(status) OVER w AS p_status, lag(priority) OVER w AS p_priority,
  lag(score) OVER w AS p_score FROM rec WINDOW w AS (PARTITION BY journal_id, source ORDER BY seen_at, seq))"""


@query("metric_snapshots", f"""
WITH {OBS} SELECT journal_id, source, seen_at, seq, metrics, sha256(metrics) AS metric_hash FROM prev
WHERE p_metrics IS NULL OR p_metrics <> metrics""")
def metric_snapshots(spark, sf):
    return H.snapshots(observations(spark, sf), KEYS, ORDER, FIELDS, ["score"])


CHANGES = """diffs AS (
  SELECT journal_id, source, seen_at, seq, 'status' AS field_name, p_status AS old_value, status AS new_value FROM prev WHERE p_metrics IS NOT NULL
  UNION ALL SELECT journal_id, source, seen_at, seq, 'priority', p_priority, priority FROM prev WHERE p_metrics IS NOT NULL
  UNION ALL SELECT journal_id, source, seen_at, seq, 'score', p_score, score FROM prev WHERE p_metrics IS NOT NULL)"""


@query("metric_changes", f"WITH {OBS}, {CHANGES} SELECT * FROM diffs WHERE old_value IS DISTINCT FROM new_value")
def metric_changes(spark, sf):
    return H.changes(observations(spark, sf), KEYS, ORDER, FIELDS, ["score"])


@query("change_feed", f"""
WITH {OBS}, {CHANGES} SELECT journal_id, seen_at, seq, field_name, new_value FROM diffs
WHERE old_value IS DISTINCT FROM new_value AND field_name = 'priority'""")
def change_feed(spark, sf):
    changed = H.changes(observations(spark, sf), KEYS, ORDER, ["priority"], [])
    return H.change_feed(changed, at="seen_at").select("journal_id", "seen_at", "seq", "field_name", "new_value")


@query("previous_events", """
SELECT event_id, lag(event_id) OVER w AS previous_id, lag(value) OVER w AS previous_value FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def previous_events(spark, sf):
    rows = with_previous(load(spark, sf, "events"), ["user_id"], ["ts", "event_id"], ["event_id", "value"])
    return rows.select(
        "event_id", F.col("previous.event_id").alias("previous_id"), F.col("previous.value").alias("previous_value"))


@query("entity_metrics", """
WITH m AS (SELECT c_custkey AS journal_id, '{"acceptance_rate": null, "cas_partition": "' || c_nationkey || '", "cas_warning": null, "citescore": null, "comment_count": '
  || CASE WHEN c_acctbal >= 500 THEN '"' || CAST(floor(c_acctbal / 500) AS BIGINT) || '"' ELSE 'null' END
  || ', "comment_pages": null, "crawled_comment_count": null, "eissn": null, "impact_factor": "' || CAST(CAST(c_acctbal AS DECIMAL(10, 4)) AS VARCHAR)
  || '", "impact_factor_realtime": null, "issn": "' || c_name || '", "jcr_partition": "' || c_mktsegment || '", "review_speed": null, "self_citation_rate": null}' AS metrics FROM customer)
SELECT journal_id, metrics, sha256(metrics) AS metric_hash FROM m""")
def entity_metrics(spark, sf):
    """All fourteen fields, from the columns an entity has and from its document."""
    more = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("journal_id"), F.col("c_name").alias("issn"), F.col("c_acctbal").alias("impact_factor"),
        F.lit(None).cast("decimal(10,4)").alias("impact_factor_realtime"),
        F.col("c_mktsegment").alias("jcr_partition"), F.col("c_nationkey").alias("cas_partition"))
    seen = H.observations(B.entities(spark, sf).join(more, "journal_id"), ["journal_id"])
    return H.metric_records(seen, ["journal_id"], []).select("journal_id", "metrics", "metric_hash")
