"""The given tables seen as the library's tables, as DataFrames and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.schemas import EntityColumns
from harvestry.sources.tables import load

# parts play the entities of the search queries
PART = EntityColumns(
    id="p_partkey", name="p_name", code="p_brand", alt_code="p_type", score="p_retailprice",
    score2="p_retailprice", group="p_size", detail_done="detail_done", children_done="children_done",
    doc="doc", created="p_partkey", updated="p_partkey", texts=("p_type", "p_brand"),
)


def latest_order(spark: SparkSession, sf: str) -> Column:
    """"Now": the date of the newest order."""
    return load(spark, sf, "orders").agg(F.max("o_orderdate").alias("now")).scalar()


NOW = "(SELECT max(o_orderdate) FROM orders)"


def latest_event(spark: SparkSession, sf: str) -> Column:
    return load(spark, sf, "events").agg(F.max("ts").alias("now")).scalar()


# --- work items from orders ------------------------------------------------------------------

def work_items(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    price, code = F.col("o_totalprice"), F.substring("o_orderpriority", 1, 1)
    status = (
        F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "running")
        .when(price < 100000, "completed").otherwise("pending")
    )
    task = (
        F.when(code == "1", "category").when(code == "2", "list").when(code == "4", "comment")
        .otherwise("detail")
    )
    error = (
        F.when(code == "1", "proxy timeout").when(code == "2", "HTTP 请求失败: 503")
        .when(code == "3", "detail_empty").when(code == "4", "no reason given").otherwise("数据校验失败")
    )
    extra = (
        F.when(price > 450000, F.lit('{"rebuild_reason": "detail_quality"}'))
        .when(price < 50000, F.concat(F.lit('{"fetch_journal_id": '), F.col("o_custkey") + 1, F.lit("}")))
        .when(price < 100000, F.lit("not json"))
    )
    none = F.lit(None).cast("timestamp_ntz")
    rows = o.select(
        F.col("o_orderkey").alias("id"), task.alias("task_type"),
        F.col("o_custkey").cast("string").alias("target_id"),
        F.concat(F.lit("/detail/"), F.col("o_custkey")).alias("target_url"),
        status.alias("status"), F.floor(price / 100000).alias("retry_count"),
        F.lit(3).cast("long").alias("max_retry"), error.alias("_error"),
        F.concat(F.lit("w"), F.month("o_orderdate")).alias("_worker"),
        F.col("o_orderdate").alias("created_at"), none.alias("started_at"), extra.alias("extra_data"),
    )
    ended = F.col("status").isin("failed", "completed")
    return rows.select(
        "id", "task_type", "target_id", "target_url", "status", "retry_count", "max_retry",
        F.when(F.col("status") == "failed", F.col("_error")).alias("error_message"),
        F.when(F.col("status") != "pending", F.col("_worker")).alias("worker_id"),
        F.when(F.col("status") == "running", F.col("created_at")).alias("locked_at"),
        "created_at", "started_at",
        F.when(ended, F.col("created_at") + F.expr("interval 1 day")).alias("completed_at"),
        "extra_data",
    )


ITEMS = """items AS (
  SELECT id, task_type, target_id, target_url, status, retry_count, max_retry,
         CASE WHEN status = 'failed' THEN err END AS error_message,
         CASE WHEN status <> 'pending' THEN wkr END AS worker_id,
         CASE WHEN status = 'running' THEN created_at END AS locked_at, created_at,
         CAST(NULL AS TIMESTAMP) AS started_at,
         CASE WHEN status IN ('failed', 'completed') THEN created_at + INTERVAL 1 DAY END AS completed_at,
         extra_data
  FROM (SELECT o_orderkey AS id,
      CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'category' WHEN '2' THEN 'list' WHEN '4' THEN 'comment'
        ELSE 'detail' END AS task_type,
      CAST(o_custkey AS VARCHAR) AS target_id, '/detail/' || o_custkey AS target_url,
      CASE WHEN o_orderstatus = 'F' THEN 'failed' WHEN o_orderstatus = 'P' THEN 'running'
        WHEN o_totalprice < 100000 THEN 'completed' ELSE 'pending' END AS status,
      CAST(floor(o_totalprice / 100000) AS BIGINT) AS retry_count, CAST(3 AS BIGINT) AS max_retry,
      CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'proxy timeout' WHEN '2' THEN 'HTTP 请求失败: 503'
        WHEN '3' THEN 'detail_empty' WHEN '4' THEN 'no reason given' ELSE '数据校验失败' END AS err,
      'w' || month(o_orderdate) AS wkr, o_orderdate AS created_at,
      CASE WHEN o_totalprice > 450000 THEN '{"rebuild_reason": "detail_quality"}'
        WHEN o_totalprice < 50000 THEN '{"fetch_journal_id": ' || (o_custkey + 1) || '}'
        WHEN o_totalprice < 100000 THEN 'not json' END AS extra_data
    FROM orders))"""


# --- reporters from events -----------------------------------------------------------------------

def reporters(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return load(spark, sf, "events").groupBy("user_id").agg(
        F.count_if(kind == "click").alias("clicks"), F.count_if(kind == "purchase").alias("total_completed"),
        F.count_if(kind == "error").alias("total_failed"), F.max("ts").alias("last_heartbeat"),
    ).select(
        F.concat(F.lit("u"), F.col("user_id")).alias("worker_id"),
        F.when(F.col("clicks") > 10, "busy").otherwise("online").alias("status"),
        F.greatest(F.col("clicks") - 10, F.lit(0)).alias("current_task_count"),
        "total_completed", "total_failed", "last_heartbeat",
    )


REPORTERS = """reporters AS (
  SELECT 'u' || user_id AS worker_id, CASE WHEN clicks > 10 THEN 'busy' ELSE 'online' END AS status,
         greatest(clicks - 10, 0) AS current_task_count, total_completed, total_failed, last_heartbeat
  FROM (SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks,
               count(*) FILTER (event_type = 'purchase') AS total_completed,
               count(*) FILTER (event_type = 'error') AS total_failed, max(ts) AS last_heartbeat
        FROM events GROUP BY user_id))"""

# reporters count as offline after a day without an event (heartbeats here are sparse)
LIVE_SECONDS = 86400
SEEN = f"""{REPORTERS}, seen AS (
  SELECT *, last_heartbeat >= (SELECT max(ts) FROM events) - INTERVAL {LIVE_SECONDS} SECOND AS is_online
  FROM reporters)"""


# --- entities and children from customers and orders -----------------------------------------------

def entities(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer")
    bal = F.col("c_acctbal")
    doc = F.concat(
        F.lit('{"comment_count": '), F.floor(bal / 500), F.lit(', "segment": "'), F.col("c_mktsegment"), F.lit('"}')
    )
    updated = F.lit("2001-08-01").cast("timestamp_ntz") - F.make_dt_interval(
        days=F.floor(F.abs(bal) / 20).cast("int"))
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_custkey").alias("journal_id"), F.col("c_name").alias("name"),
        F.col("c_nationkey").cast("long").alias("category_id"), (bal > 0).alias("detail_crawled"),
        (F.col("c_mktsegment") == "BUILDING").alias("comments_crawled"),
        F.when(bal >= 500, doc).alias("detail_data"), updated.alias("updated_at"),
    )


ENTITIES = """entities AS (
  SELECT c_custkey AS id, c_custkey AS journal_id, c_name AS name, CAST(c_nationkey AS BIGINT) AS category_id,
         c_acctbal > 0 AS detail_crawled, c_mktsegment = 'BUILDING' AS comments_crawled,
         CASE WHEN c_acctbal >= 500 THEN '{"comment_count": ' || CAST(floor(c_acctbal / 500) AS BIGINT)
           || ', "segment": "' || c_mktsegment || '"}' END AS detail_data,
         CASE WHEN c_acctbal >= 500 THEN CAST(floor(c_acctbal / 500) AS BIGINT) END AS expected,
         TIMESTAMP '2001-08-01' - to_days(CAST(floor(abs(c_acctbal) / 20) AS INTEGER)) AS updated_at
  FROM customer)"""


def children(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("journal_id"),
        F.col("o_orderkey").cast("string").alias("comment_id"),
        F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("content"),
        F.concat(F.lit("clerk "), F.month("o_orderdate")).alias("author"),
        F.col("o_orderpriority").alias("rating"), F.col("o_orderstatus").alias("submit_experience"),
        F.col("o_orderdate").alias("comment_time"),
        (F.col("o_orderdate") + F.expr("interval 2 days")).alias("crawled_at"),
    )


CHILDREN = """children AS (
  SELECT o_orderkey AS id, o_custkey AS journal_id, CAST(o_orderkey AS VARCHAR) AS comment_id,
         o_orderpriority || ' ' || o_orderstatus AS content, 'clerk ' || month(o_orderdate) AS author,
         o_orderpriority AS rating, o_orderstatus AS submit_experience, o_orderdate AS comment_time,
         o_orderdate + INTERVAL 2 DAY AS crawled_at
  FROM orders)"""


# --- endpoints from suppliers and their line items ---------------------------------------------------

def endpoints(spark: SparkSession, sf: str) -> DataFrame:
    s = load(spark, sf, "supplier")
    bal = F.col("s_acctbal")
    source = F.when(bal > 7000, "managed").when(bal > 1000, F.concat(F.lit("src"), F.col("s_nationkey")))
    return s.select(
        F.col("s_suppkey").alias("id"), F.concat(F.lit("10.0."), F.col("s_nationkey"), F.lit(".1")).alias("ip"),
        (F.lit(59500) + F.col("s_suppkey")).cast("int").alias("port"), F.lit("http").alias("protocol"),
        F.when(bal > 0, F.col("s_name")).alias("username"),
        F.when(bal > 2000, F.concat(F.lit("p"), F.col("s_suppkey"))).alias("secret"),
        F.when(F.col("s_nationkey") < 8, "tunnel").when(F.col("s_nationkey") < 16, "private")
        .otherwise("direct").alias("proxy_type"),
        source.alias("source"), (bal > -500).alias("is_active"), (bal < 9000).alias("is_valid"),
        F.floor(F.abs(bal) / 100).alias("success_count"), F.floor(F.abs(bal) / 2500).alias("fail_count"),
        F.floor(F.abs(bal) / 300).alias("total_fail_count"),
        F.when(bal > 0, F.round(bal / 10, 1)).alias("response_time"),
        F.when(bal > 3000, F.lit("2001-01-01").cast("timestamp_ntz") + F.make_dt_interval(
            hours=F.col("s_nationkey"))).alias("last_used_at"),
        F.lit("2000-01-01").cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("string").alias("remark"),
    )


ENDPOINTS = """endpoints AS (
  SELECT s_suppkey AS id, '10.0.' || s_nationkey || '.1' AS ip, CAST(59500 + s_suppkey AS INTEGER) AS port,
         'http' AS protocol, CASE WHEN s_acctbal > 0 THEN s_name END AS username,
         CASE WHEN s_acctbal > 2000 THEN 'p' || s_suppkey END AS secret,
         CASE WHEN s_nationkey < 8 THEN 'tunnel' WHEN s_nationkey < 16 THEN 'private' ELSE 'direct' END AS proxy_type,
         CASE WHEN s_acctbal > 7000 THEN 'managed' WHEN s_acctbal > 1000 THEN 'src' || s_nationkey END AS source,
         s_acctbal > -500 AS is_active, s_acctbal < 9000 AS is_valid,
         CAST(floor(abs(s_acctbal) / 100) AS BIGINT) AS success_count,
         CAST(floor(abs(s_acctbal) / 2500) AS BIGINT) AS fail_count,
         CAST(floor(abs(s_acctbal) / 300) AS BIGINT) AS total_fail_count,
         CASE WHEN s_acctbal > 0 THEN round(s_acctbal / 10, 1) END AS response_time,
         CASE WHEN s_acctbal > 3000 THEN TIMESTAMP '2001-01-01' + to_hours(s_nationkey) END AS last_used_at
  FROM supplier)"""

AVAILABLE = """(is_active AND is_valid AND ((source IS NOT DISTINCT FROM 'managed' AND port >= 59550)
  OR (source IS DISTINCT FROM 'managed' AND fail_count < 3)))"""
