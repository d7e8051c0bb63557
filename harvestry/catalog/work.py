"""Work items: lists, statistics, failures, plans and rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestry.catalog import bindings as B
from harvestry.catalog.registry import query
from harvestry.session import cut_lineage
from harvestry.operators import children as C
from harvestry.operators import errors as E
from harvestry.operators import listing as L
from harvestry.operators import search as S
from harvestry.operators import stats
from harvestry.plans import refresh as R
from harvestry.sources.tables import load


@query("work_search", f"""
WITH {B.ITEMS} SELECT id, task_type, status, target_id FROM items WHERE status = 'failed'
  AND (contains(lower(target_id), '12') OR contains(lower(target_url), '12') OR contains(lower(coalesce(worker_id, '')), '12')
    OR contains(lower(coalesce(error_message, '')), '12') OR id = 12)""")
def work_search(spark, sf):
    rows = S.search_work(B.work_items(spark, sf), status="failed", term=" 12 ")
    return rows.select("id", "task_type", "status", "target_id")


@query("work_exhausted", f"""
WITH {B.ITEMS} SELECT id, retry_count, completed_at FROM items WHERE status = 'failed' AND retry_count >= max_retry""")
def work_exhausted(spark, sf):
    return S.exhausted(B.work_items(spark, sf)).select("id", "retry_count", "completed_at")


@query("work_retryable", f"""
WITH {B.ITEMS} SELECT id, created_at FROM items WHERE status = 'failed' AND retry_count < max_retry AND task_type = 'detail'
ORDER BY created_at, id LIMIT 100""")
def work_retryable(spark, sf):
    return S.retryable(B.work_items(spark, sf), "detail", 100).select("id", "created_at")


@query("work_stale_leases", f"""
WITH {B.ITEMS} SELECT id, locked_at FROM items WHERE status = 'running' AND locked_at < {B.NOW} - INTERVAL 600 SECOND""")
def work_stale_leases(spark, sf):
    return S.stale_leases(B.work_items(spark, sf), B.latest_order(spark, sf)).select("id", "locked_at")


@query("work_next", f"""
WITH {B.ITEMS} SELECT id, status FROM items WHERE task_type = 'detail'
  AND (status = 'pending' OR (status = 'failed' AND retry_count < max_retry))
ORDER BY status <> 'pending', created_at, id LIMIT 200""")
def work_next(spark, sf):
    return R.next_work(B.work_items(spark, sf), 200, "detail").select("id", "status")


@query("work_next_per_type", f"""
WITH {B.ITEMS}, r AS (SELECT id, task_type, row_number() OVER (PARTITION BY task_type ORDER BY status <> 'pending', created_at, id) AS rank
  FROM items WHERE status = 'pending' OR (status = 'failed' AND retry_count < max_retry))
SELECT * FROM r WHERE rank <= 50""")
def work_next_per_type(spark, sf):
    return R.next_work(B.work_items(spark, sf), 50, per_type=True).select("id", "task_type", "rank")


@query("work_stats", f"""
WITH {B.ITEMS}, s(value) AS (VALUES ('pending'), ('running'), ('completed'), ('failed')),
t(value) AS (VALUES ('category'), ('list'), ('detail'), ('comment'))
SELECT 'by_status' AS dimension, value, count(id) AS n FROM s LEFT JOIN items ON status = value GROUP BY value
UNION ALL SELECT 'by_type', value, count(id) FROM t LEFT JOIN items ON task_type = value GROUP BY value
UNION ALL SELECT 'by_worker', coalesce(worker_id, 'unknown'), count(*) FROM items WHERE status = 'running' GROUP BY 2
UNION ALL SELECT 'total', 'total', count(*) FROM items""")
def work_stats(spark, sf):
    return stats.work_stats(B.work_items(spark, sf))


@query("active_reporters", f"""
WITH {B.ITEMS} SELECT worker_id, count(*) AS task_count, max(locked_at) AS last_active FROM items
WHERE worker_id IS NOT NULL AND locked_at >= {B.NOW} - INTERVAL 500000 MINUTE GROUP BY worker_id""")
def active_reporters(spark, sf):
    return stats.active_reporters(B.work_items(spark, sf), B.latest_order(spark, sf), minutes=500000)


@query("reporter_summary", f"""
WITH {B.SEEN} SELECT count(*) AS total_workers, count(*) FILTER (is_online) AS online_workers,
  count(*) FILTER (NOT is_online) AS offline_workers, count(*) FILTER (is_online AND current_task_count > 0) AS busy_workers,
  CAST(sum(total_completed) AS BIGINT) AS total_completed, CAST(sum(total_failed) AS BIGINT) AS total_failed FROM seen""")
def reporter_summary(spark, sf):
    return stats.reporter_summary(B.reporters(spark, sf), B.latest_event(spark, sf), B.LIVE_SECONDS)


@query("reporters_busy", f"""
WITH {B.SEEN} SELECT worker_id, status, current_task_count, last_heartbeat FROM seen WHERE is_online AND current_task_count > 0""")
def reporters_busy(spark, sf):
    rows = stats.workers_by_status(B.reporters(spark, sf), B.latest_event(spark, sf), "busy", B.LIVE_SECONDS)
    return rows.select("worker_id", "status", "current_task_count", "last_heartbeat")


@query("reporters_offline", f"""
WITH {B.SEEN} SELECT worker_id, 'offline' AS status, CAST(0 AS BIGINT) AS current_task_count FROM seen WHERE NOT is_online""")
def reporters_offline(spark, sf):
    rows = stats.workers_by_status(B.reporters(spark, sf), B.latest_event(spark, sf), "offline", B.LIVE_SECONDS)
    return rows.select("worker_id", "status", "current_task_count")


@query("reporter_detail", f"""
WITH {B.ITEMS} SELECT worker_id, count(*) FILTER (status = 'running') AS running,
  count(*) FILTER (status = 'completed' AND completed_at >= {B.NOW} - INTERVAL 5000 HOUR) AS recent_completed,
  count(*) FILTER (status = 'failed' AND completed_at >= {B.NOW} - INTERVAL 5000 HOUR) AS recent_failed
FROM items WHERE worker_id IS NOT NULL GROUP BY worker_id""")
def reporter_detail(spark, sf):
    return stats.reporter_detail(B.work_items(spark, sf), B.latest_order(spark, sf), hours=5000)


@query("running_by_reporter", f"""
WITH {B.ITEMS} SELECT worker_id, count(*) AS running FROM items WHERE status = 'running' AND worker_id IS NOT NULL GROUP BY 1""")
def running_by_reporter(spark, sf):
    return stats.running_by_reporter(B.work_items(spark, sf))


@query("reporters_with_running", f"""
WITH {B.ITEMS}, w AS (SELECT DISTINCT 'w' || (n_nationkey + 1) AS worker_id FROM nation)
SELECT w.worker_id, count(id) AS running FROM w LEFT JOIN items i ON i.worker_id = w.worker_id AND status = 'running' GROUP BY 1""")
def reporters_with_running(spark, sf):
    known = load(spark, sf, "nation").select(F.concat(F.lit("w"), F.col("n_nationkey") + 1).alias("worker_id"))
    return stats.reporters_with_running(known, B.work_items(spark, sf))


@query("latest_items", f"""
WITH {B.ITEMS} SELECT task_type, target_id, max(id) AS id, arg_max(status, id) AS status FROM items GROUP BY 1, 2""")
def latest_items(spark, sf):
    items = B.work_items(spark, sf).select("task_type", "target_id", "id", "status")
    return R.latest_items(items)


# --- failures -----------------------------------------------------------------------------------

def _failures(spark, sf):
    kind = F.col("event_type")
    family = (
        F.when(kind == "click", "endpoint_unavailable").when(kind == "error", "validation")
        .when(kind == "purchase", "count_mismatch").when(kind == "signup", "http").otherwise("other")
    )
    message = F.when(F.col("value") > 100, "detail_empty: nothing found").when(
        F.col("value") > 50, "HTTP 请求失败: 502").otherwise("plain failure")
    task = F.when(F.col("value") < 10, "list").otherwise("detail")
    return load(spark, sf, "events").select(
        "event_id", "ts", F.col("user_id").alias("id"), family.alias("family"), message.alias("message"),
        task.alias("task_type"),
    )


FAILURES = """failures AS (
  SELECT event_id, ts, user_id AS id,
    CASE event_type WHEN 'click' THEN 'endpoint_unavailable' WHEN 'error' THEN 'validation'
      WHEN 'purchase' THEN 'count_mismatch' WHEN 'signup' THEN 'http' ELSE 'other' END AS family,
    CASE WHEN value > 100 THEN 'detail_empty: nothing found' WHEN value > 50 THEN 'HTTP 请求失败: 502' ELSE 'plain failure' END AS message,
    CASE WHEN value < 10 THEN 'list' ELSE 'detail' END AS task_type FROM events),
coded AS (
  SELECT *, CASE WHEN family = 'endpoint_unavailable' THEN 'proxy_unavailable'
      WHEN family = 'validation' AND task_type = 'detail' AND contains(message, 'detail_empty') THEN 'detail_quality_failed'
      WHEN family = 'validation' THEN 'data_validation_failed' WHEN family = 'count_mismatch' THEN 'comment_mismatch'
      WHEN family = 'http' OR contains(message, 'HTTP 请求失败') THEN 'http_request_failed' ELSE 'unknown_error' END AS code
  FROM failures),
policies(code, action, retryable, counts_against_resource) AS (VALUES
  ('proxy_unavailable', 'release', false, false), ('detail_quality_failed', 'resolve_detail_id', false, false),
  ('data_validation_failed', 'fail_retry', true, false), ('comment_mismatch', 'fail_retry', true, false),
  ('http_request_failed', 'fail_retry', true, true), ('parse_error', 'fail_retry', true, false),
  ('unknown_error', 'fail_retry', true, true)),
classified AS (SELECT coded.*, action, retryable, counts_against_resource FROM coded JOIN policies USING (code))"""


@query("error_classes", f"""
WITH {FAILURES} SELECT event_id, code, action, retryable, counts_against_resource FROM classified""")
def error_classes(spark, sf):
    return E.classify(_failures(spark, sf)).select("event_id", "code", "action", "retryable", "counts_against_resource")


@query("error_history", f"""
WITH {FAILURES}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) AS back FROM classified)
SELECT id, max(CASE WHEN back = 1 THEN code || '|' || message END) AS last_error,
  coalesce(string_agg(CASE WHEN back BETWEEN 2 AND 11 THEN code END, ',' ORDER BY back DESC), '') AS history
FROM r GROUP BY id""")
def error_history(spark, sf):
    rows = E.error_history(E.classify(_failures(spark, sf)), "id", ["ts", "event_id"])
    codes = F.array_join(F.transform("error_history", lambda e: e["code"]), ",")
    return rows.select(
        "id", F.concat_ws("|", "last_error.code", "last_error.message").alias("last_error"), codes.alias("history"))


@query("apply_failures", f"""
WITH {B.ITEMS}, {FAILURES}, eff AS (
  SELECT id, arg_max(action, (ts, event_id)) AS action, arg_max(message, (ts, event_id)) AS message,
    count(*) AS n, list(message ORDER BY ts DESC, event_id DESC)[2] AS before,
    count(*) FILTER (action <> 'release' AND retryable) AS retries, bool_or(action <> 'release' AND NOT retryable) AS stop
  FROM classified GROUP BY id)
SELECT i.id,
  CASE WHEN e.id IS NULL THEN i.status WHEN action = 'release' THEN 'pending' ELSE 'failed' END AS status,
  CASE WHEN e.id IS NULL THEN retry_count WHEN stop THEN max_retry ELSE retry_count + retries END AS retry_count,
  CASE WHEN e.id IS NULL THEN error_message ELSE message END AS error_message,
  CASE WHEN e.id IS NULL THEN completed_at WHEN action = 'release' THEN completed_at ELSE {B.NOW} END AS completed_at,
  e.id IS NOT NULL AND action <> 'release' AND NOT (action = 'resolve_detail_id' AND i.status = 'running') AS counted,
  CASE WHEN e.id IS NOT NULL THEN message WHEN json_valid(i.extra_data) THEN json_extract_string(i.extra_data, '$.last_error.message') END AS last_message,
  CASE WHEN e.id IS NULL THEN 0 ELSE least(n - 1, 10) END AS n_before,
  CASE WHEN n > 1 THEN before END AS before_message
FROM items i LEFT JOIN eff e USING (id)""")
def apply_failures(spark, sf):
    items = B.work_items(spark, sf)
    solved = items.filter("status = 'running'").select("id")
    rows = E.apply_failures(
        items, E.classify(_failures(spark, sf)), B.latest_order(spark, sf), ["ts", "event_id"], solved)
    history = F.from_json(F.get_json_object("extra_data", "$.error_history"), "array<struct<message: string>>")
    return rows.select(
        "id", "status", "retry_count", "error_message", "completed_at", "counted", F.get_json_object("extra_data", "$.last_error.message").alias("last_message"),
        F.coalesce(F.size(history), F.lit(0)).cast("long").alias("n_before"), F.element_at(history, -1)["message"].alias("before_message"))


# --- plans ------------------------------------------------------------------------------------------

@query("expand_pages", """
SELECT CAST(n_nationkey AS VARCHAR) || ':' || p AS target_id, CAST(p AS BIGINT) AS page_no
FROM (SELECT n_nationkey, unnest(range(1, CAST(ceil(count(c_custkey) / 10) AS BIGINT) + 1)) AS p
      FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey)""")
def expand_pages(spark, sf):
    totals = load(spark, sf, "customer").groupBy("c_nationkey").count()
    groups = load(spark, sf, "nation").join(totals, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
        F.col("n_nationkey").alias("field_tag"), F.ceil(F.coalesce("count", F.lit(0)) / 10).alias("total_pages"))
    return R.expand_pages(groups).select("target_id", "page_no")


def _plan_sql(task: str, cases: str, pre: str = "", first: str = "true") -> str:
    """``first``: where it holds for an item of a target, later ones without it don't count."""
    return f"""
WITH {B.ENTITIES}, {B.ITEMS}, latest AS (
  SELECT target_id, arg_max(id, ({first}, id)) AS item_id, arg_max(status, ({first}, id)) AS item_status FROM items WHERE task_type = '{task}' GROUP BY 1)
SELECT CAST(journal_id AS VARCHAR) AS target_id, item_id,
  CASE {pre} WHEN item_status IS NULL THEN 'create' {cases} END AS action
FROM entities LEFT JOIN latest ON target_id = CAST(journal_id AS VARCHAR)"""


def _planned(spark, sf, policy, task, **kw):
    rows = R.plan(R.targets_all(B.entities(spark, sf)), B.work_items(spark, sf), policy, task, **kw)
    return rows.select("target_id", "item_id", "action")


@query("plan_list", _plan_sql("list", """WHEN item_status IN ('pending', 'running') THEN 'keep'
  WHEN item_status = 'failed' THEN 'reset' ELSE 'omit'"""))
def plan_list(spark, sf):
    return _planned(spark, sf, "list", "list")


@query("plan_detail", _plan_sql("detail", """WHEN item_status IN ('pending', 'running') THEN 'keep' ELSE 'reset'""",
                                "WHEN detail_crawled THEN 'skip'"))
def plan_detail(spark, sf):
    return _planned(spark, sf, "detail", "detail", done="detail_crawled")


@query("plan_children", _plan_sql("comment", """WHEN item_status IN ('pending', 'running') THEN 'keep' ELSE 'reset'""",
                                  "WHEN comments_crawled THEN 'skip'"))
def plan_children(spark, sf):
    return _planned(spark, sf, "children", "comment", done="comments_crawled")


@query("plan_children_refresh", _plan_sql("comment", """WHEN item_status IN ('pending', 'running') THEN 'keep' ELSE 'reset'"""))
def plan_children_refresh(spark, sf):
    return _planned(spark, sf, "children", "comment", refresh=True, done="comments_crawled")


@query("plan_detail_force", _plan_sql("detail", "WHEN item_status = 'running' THEN 'keep' ELSE 'reset'"))
def plan_detail_force(spark, sf):
    return _planned(spark, sf, "detail_force", "detail")


@query("plan_group_scan", _plan_sql(
    "category", "WHEN item_status IN ('pending', 'running') THEN 'keep' ELSE 'create'", first="status IN ('pending', 'running')"))
def plan_group_scan(spark, sf):
    return _planned(spark, sf, "group_scan", "category")


@query("plan_drifted", """
WITH g AS (SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS remote,
  (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 0) AS here FROM nation)
SELECT n_nationkey || ':' || p AS target_id FROM (
  SELECT n_nationkey, unnest(range(1, CAST(ceil(remote / 10) AS BIGINT) + 1)) AS p FROM g WHERE remote <> here AND remote > 0)""")
def plan_drifted(spark, sf):
    c = load(spark, sf, "customer").withColumn("category_id", F.col("c_nationkey"))
    groups = c.groupBy("category_id").agg(F.count(F.lit(1)).alias("remote_total_count")).withColumn(
        "field_tag", F.col("category_id").cast("string"))
    links = c.select("category_id", (F.col("c_acctbal") > 0).alias("active"))
    states = L.group_state(groups, links, B.latest_order(spark, sf))
    return R.targets_drifted(states).select("target_id")


@query("plan_full", f"""
WITH {B.ENTITIES} SELECT CAST(journal_id AS VARCHAR) AS target_id, updated_at FROM entities
ORDER BY updated_at NULLS FIRST, journal_id LIMIT 300""")
def plan_full(spark, sf):
    return R.targets_full(B.entities(spark, sf), 300).select("target_id", "updated_at")


STALE = f"""{B.ENTITIES}, {B.CHILDREN}, counted AS (
  SELECT e.journal_id, e.name, e.expected, e.updated_at, count(c.id) AS stored FROM entities e
  LEFT JOIN children c ON c.journal_id = e.journal_id WHERE e.detail_crawled GROUP BY ALL),
flagged AS (SELECT *, expected IS NULL AS missing_info, coalesce(stored < expected, false) AS comment_mismatch,
  updated_at < {B.NOW} - INTERVAL 90 DAY AS outdated FROM counted)"""


def _flags(spark, sf):
    return C.stale_flags(B.entities(spark, sf), B.children(spark, sf), B.latest_order(spark, sf))


@query("plan_missing", f"WITH {STALE} SELECT CAST(journal_id AS VARCHAR) AS target_id FROM flagged WHERE missing_info")
def plan_missing(spark, sf):
    return R.targets_missing(_flags(spark, sf)).select("target_id")


@query("plan_shortfall", f"""
WITH {STALE} SELECT CAST(journal_id AS VARCHAR) AS target_id, expected - stored AS diff FROM flagged WHERE comment_mismatch""")
def plan_shortfall(spark, sf):
    return R.targets_shortfall(_flags(spark, sf)).select("target_id", "diff")


@query("plan_outdated", f"""
WITH {STALE} SELECT CAST(journal_id AS VARCHAR) AS target_id, date_sub('day', updated_at, {B.NOW}) AS days_ago FROM flagged WHERE outdated""")
def plan_outdated(spark, sf):
    return R.targets_outdated(_flags(spark, sf)).select("target_id", "days_ago")


@query("plan_ids", f"""
WITH {B.ENTITIES} SELECT CAST(journal_id AS VARCHAR) AS target_id FROM entities
WHERE journal_id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)""")
def plan_ids(spark, sf):
    wanted = load(spark, sf, "orders").filter("o_totalprice > 480000").select(F.col("o_custkey").alias("journal_id"))
    return R.targets_ids(B.entities(spark, sf), wanted).select("target_id")


@query("plan_applied", f"""
WITH {B.ENTITIES}, {B.ITEMS}, latest AS (
  SELECT target_id, max(id) AS item_id, arg_max(status, id) AS s FROM items WHERE task_type = 'detail' GROUP BY 1),
p AS (SELECT CAST(journal_id AS VARCHAR) AS target_id, item_id, s FROM entities LEFT JOIN latest ON target_id = CAST(journal_id AS VARCHAR)),
n AS (SELECT i.*, i.id IN (SELECT item_id FROM p WHERE s <> 'running') AS hit, i.id IN (SELECT item_id FROM p) AS known FROM items i)
SELECT task_type, target_id, CASE WHEN hit THEN 'pending' ELSE status END AS status, CASE WHEN hit THEN 0 ELSE retry_count END AS retry_count,
  CASE WHEN NOT hit THEN error_message END AS error_message, CASE WHEN known THEN '{{}}' ELSE extra_data END AS extra_data, created_at FROM n
UNION ALL SELECT 'detail', target_id, 'pending', 0, NULL, '{{}}', {B.NOW} FROM p WHERE item_id IS NULL""")
def plan_applied(spark, sf):
    items = B.work_items(spark, sf)
    targets = R.targets_all(B.entities(spark, sf)).withColumn("extra_data", F.lit("{}"))
    planned = R.plan(targets, items, "detail_force", "detail")
    rows = R.apply_plan(items, planned, "detail", B.latest_order(spark, sf))
    return rows.select("task_type", "target_id", "status", "retry_count", "error_message", "extra_data", "created_at")


@query("plan_twice", f"""
WITH {B.ENTITIES}, {B.ITEMS}, latest AS (SELECT target_id, arg_max(status, id) AS s, max(id) AS old_id FROM items WHERE task_type = 'detail' GROUP BY 1)
SELECT 'detail' AS task_type, CAST(journal_id AS VARCHAR) AS target_id, CASE WHEN s = 'running' THEN 'running' ELSE 'pending' END AS item_status,
  CASE WHEN s = 'running' THEN 'keep' ELSE 'reset' END AS action,
  coalesce(old_id, (SELECT max(id) FROM items) + row_number() OVER (PARTITION BY old_id IS NULL ORDER BY CAST(journal_id AS VARCHAR))) AS item_id
FROM entities LEFT JOIN latest ON target_id = CAST(journal_id AS VARCHAR)""")
def plan_twice(spark, sf):
    """Plan, apply, and plan again: created items are known the second time, and ids are above all before."""
    items = B.work_items(spark, sf)
    targets = R.targets_all(B.entities(spark, sf))
    once = R.apply_plan(items, R.plan(targets, items, "detail_force", "detail"), "detail", B.latest_order(spark, sf))
    again = R.plan(targets, cut_lineage(once), "detail_force", "detail")
    return again.select(F.lit("detail").alias("task_type"), "target_id", "item_status", "action", "item_id")


@query("plan_clears_flags", f"""
WITH {STALE} SELECT journal_id, detail_crawled AND journal_id NOT IN (SELECT journal_id FROM flagged WHERE outdated) AS detail_crawled,
  comments_crawled AND journal_id NOT IN (SELECT journal_id FROM flagged WHERE outdated) AS comments_crawled FROM entities""")
def plan_clears_flags(spark, sf):
    rows = R.clear_done(B.entities(spark, sf), R.targets_outdated(_flags(spark, sf)))
    return rows.select("journal_id", "detail_crawled", "comments_crawled")


# --- rewrites ----------------------------------------------------------------------------------------

@query("reset_exhausted", f"""
WITH {B.ITEMS}, h AS (SELECT *, status = 'failed' AND retry_count >= max_retry AS hit FROM items)
SELECT id, CASE WHEN hit THEN 'pending' ELSE status END AS status, CASE WHEN hit THEN 0 ELSE retry_count END AS retry_count,
  CASE WHEN NOT hit THEN error_message END AS error_message, CASE WHEN NOT hit THEN completed_at END AS completed_at FROM h""")
def reset_exhausted(spark, sf):
    rows = R.reset_items(B.work_items(spark, sf), "exhausted")
    return rows.select("id", "status", "retry_count", "error_message", "completed_at")


@query("reset_retry", f"""
WITH {B.ITEMS}, h AS (SELECT *, status = 'failed' AND retry_count < max_retry
  AND id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS hit FROM items)
SELECT id, CASE WHEN hit THEN 'pending' ELSE status END AS status, retry_count,
  CASE WHEN NOT hit THEN error_message END AS error_message, completed_at FROM h""")
def reset_retry(spark, sf):
    ids = load(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    rows = R.reset_items(B.work_items(spark, sf), "retry", ids)
    return rows.select("id", "status", "retry_count", "error_message", "completed_at")


@query("reset_retry_oldest", f"""
WITH {B.ITEMS}, o AS (SELECT id FROM items WHERE status = 'failed' AND retry_count < max_retry ORDER BY created_at, id LIMIT 100)
SELECT id, CASE WHEN id IN (SELECT id FROM o) THEN 'pending' ELSE status END AS status FROM items""")
def reset_retry_oldest(spark, sf):
    return R.reset_items(B.work_items(spark, sf), "retry_oldest", limit=100).select("id", "status")


@query("reset_force", f"""
WITH {B.ITEMS}, h AS (SELECT *, id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS hit FROM items)
SELECT id, CASE WHEN hit THEN 'pending' ELSE status END AS status, CASE WHEN hit THEN 0 ELSE retry_count END AS retry_count,
  CASE WHEN NOT hit THEN locked_at END AS locked_at FROM h""")
def reset_force(spark, sf):
    ids = load(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return R.reset_items(B.work_items(spark, sf), "force", ids).select("id", "status", "retry_count", "locked_at")


@query("purge_completed", f"WITH {B.ITEMS} SELECT id, status FROM items WHERE status <> 'completed'")
def purge_completed(spark, sf):
    return R.purge_completed(B.work_items(spark, sf)).select("id", "status")
