"""Child sets of customers: replacement, shortfall, staleness, ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestry.catalog import bindings as B
from harvestry.catalog.registry import query
from harvestry.catalog.work import STALE
from harvestry.functions.documents import doc_field
from harvestry.functions.text import rating_band
from harvestry.operators import children as C
from harvestry.operators.dedupe import first_per_key
from harvestry.sources.tables import load

CUT = "1998-01-01"


def _replacement(spark, sf):
    kids = B.children(spark, sf)
    old = kids.filter(F.col("comment_time") < CUT).select("journal_id", "comment_id", "content")
    # every fresh child arrives twice, once more with another text, and a third of them without an id
    fresh = kids.filter(F.col("comment_time") >= CUT)
    again = fresh.withColumn("content", F.lit("repeated")).withColumn("id", F.col("id") + 1_000_000_000)
    incoming = fresh.unionByName(again).select(
        "journal_id", F.when(F.col("submit_experience") != "P", F.col("comment_id")).alias("comment_id"), "content",
        F.col("id").alias("position_no"),
    )
    expected = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("journal_id"),
        F.greatest(F.floor(F.col("c_acctbal") / 1000), F.lit(0)).alias("total_count"),
        F.ceil(F.greatest(F.floor(F.col("c_acctbal") / 1000), F.lit(0)) / 5).alias("total_pages"),
    )
    return C.replace_if_complete(old, incoming, expected)


REPLACED = f"""{B.CHILDREN}, kept AS (
  SELECT journal_id, comment_id, content FROM children WHERE comment_time >= TIMESTAMP '{CUT}' AND submit_experience <> 'P'),
report AS (
  SELECT c_custkey AS journal_id, CAST(greatest(floor(c_acctbal / 1000), 0) AS BIGINT) AS total_count,
    CAST(ceil(greatest(floor(c_acctbal / 1000), 0) / 5) AS BIGINT) AS total_pages,
    (SELECT count(*) FROM kept WHERE journal_id = c_custkey) AS crawled_count FROM customer),
judged AS (SELECT *, total_count = 0 OR crawled_count >= total_count AS complete FROM report)"""


@query("replace_children", f"""
WITH {REPLACED} SELECT journal_id, comment_id, content FROM children WHERE comment_time < TIMESTAMP '{CUT}'
  AND journal_id NOT IN (SELECT journal_id FROM judged WHERE complete)
UNION ALL SELECT * FROM kept WHERE journal_id IN (SELECT journal_id FROM judged WHERE complete)""")
def replace_children(spark, sf):
    return _replacement(spark, sf).children


@query("replace_report", f"WITH {REPLACED} SELECT * FROM judged")
def replace_report(spark, sf):
    return _replacement(spark, sf).report


@query("replace_problems", f"""
WITH {REPLACED} SELECT journal_id, 'warning' AS problem_type, 'comment_mismatch' AS problem_code,
  '评论集合不完整，保留旧评论数据: expected=' || total_count || ', actual=' || crawled_count || ', pages=' || total_pages AS message,
  total_count AS expected_value, crawled_count AS actual_value FROM judged WHERE NOT complete""")
def replace_problems(spark, sf):
    return _replacement(spark, sf).problems


@query("child_counters", f"""
WITH {REPLACED} SELECT journal_id, complete AS comments_crawled, CAST(total_count AS VARCHAR) AS comment_count,
  CAST(crawled_count AS VARCHAR) AS crawled_comment_count, CASE WHEN c_acctbal >= 500 THEN c_mktsegment END AS segment
FROM judged JOIN customer ON c_custkey = journal_id""")
def child_counters(spark, sf):
    rows = C.update_child_counters(B.entities(spark, sf), _replacement(spark, sf).report)
    return rows.select("journal_id", "comments_crawled", *[
        doc_field("detail_data", f).alias(f) for f in ("comment_count", "crawled_comment_count", "segment")])


@query("page_shortfall", f"""
WITH {REPLACED} SELECT journal_id, total_count AS expected_value, crawled_count AS actual_value,
  (total_pages - 1) * 10 AS least_expected FROM judged WHERE total_pages > 1 AND crawled_count < (total_pages - 1) * 10""")
def page_shortfall(spark, sf):
    rows = C.page_shortfall(_replacement(spark, sf).report)
    return rows.select("journal_id", "expected_value", "actual_value", "least_expected")


@query("staleness", f"""
WITH {STALE}, listed AS (
  SELECT 'missing_info' AS reason, * FROM flagged WHERE missing_info
  UNION ALL SELECT 'comment_mismatch', * FROM flagged WHERE comment_mismatch
  UNION ALL SELECT 'outdated', * FROM flagged WHERE outdated),
ranked AS (SELECT *, count(*) OVER (PARTITION BY reason) AS reason_count FROM listed)
SELECT reason, journal_id, name, stored, reason_count,
  CASE WHEN reason = 'comment_mismatch' THEN expected END AS expected,
  CASE WHEN reason = 'comment_mismatch' THEN expected - stored END AS diff,
  CASE WHEN reason = 'outdated' THEN date_sub('day', updated_at, {B.NOW}) END AS days_ago
FROM ranked""")
def staleness(spark, sf):
    rows = C.staleness(B.entities(spark, sf), B.children(spark, sf), B.latest_order(spark, sf))
    return rows.select("reason", "journal_id", "name", "stored", "reason_count", "expected", "diff", "days_ago")


@query("rating_stats", f"""
WITH {B.CHILDREN} SELECT journal_id, count(*) AS n_children, count(CAST(substr(rating, 1, 1) AS INTEGER)) AS n_rated,
  round(CAST(sum(CAST(substr(rating, 1, 1) AS INTEGER)) AS DOUBLE) / count(*), 1) AS avg_rating, max(comment_time) AS latest_at
FROM children GROUP BY journal_id""")
def rating_stats(spark, sf):
    return C.rating_stats(B.children(spark, sf))


@query("rating_bands", """
SELECT CASE WHEN o_totalprice < 100000 THEN '' WHEN substr(o_orderpriority, 1, 1) >= '4' THEN 'high'
  WHEN substr(o_orderpriority, 1, 1) >= '2' THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM orders GROUP BY 1""")
def rating_bands(spark, sf):
    rating = F.when(F.col("o_totalprice") >= 100000, F.col("o_orderpriority"))
    return load(spark, sf, "orders").groupBy(rating_band(rating).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("first_turns", """
SELECT conv_id, arg_min(turn, turn) AS turn, arg_min(role, turn) AS role, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id""")
def first_turns(spark, sf):
    return first_per_key(load(spark, sf, "conversations"), ["conv_id"], ["turn"])
