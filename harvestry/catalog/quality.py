"""Record audits over per-customer documents, and the problems they open."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestry.catalog import bindings as B
from harvestry.catalog.registry import query
from harvestry.operators import problems as P
from harvestry.operators import quality as Q
from harvestry.operators import search as S
from harvestry.operators import stats
from harvestry.plans import refresh as R
from harvestry.sources.tables import load

RULES = Q.AuditRules(
    min_fields=3, warn_fields=5, markers=("locked:F",),
    identity={"urgent": ("1-urgent",)}, important={"low": ("5-LOW",), "high": ("x", "2-HIGH")},
)


def documents(spark, sf):
    """Customers with a document {priority: latest status of their big orders of it}."""
    top = load(spark, sf, "orders").filter("o_totalprice > 200000").groupBy("o_custkey", "o_orderpriority").agg(
        F.max("o_orderstatus").alias("s"))
    # at most five entries per customer
    doc = F.to_json(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", F.concat(F.lit("locked:"), "s")))))
    docs = top.groupBy("o_custkey").agg(doc.alias("detail_data"))
    base = B.entities(spark, sf).drop("detail_data")
    joined = base.join(docs, F.col("journal_id") == F.col("o_custkey"), "left").drop("o_custkey")
    # what the builders have is a list, where their nation has a low key, or nothing
    listed = F.when(F.col("category_id") < 12, F.lit("[1]"))
    return joined.withColumn("detail_data", F.when(F.col("comments_crawled"), listed).otherwise(F.col("detail_data")))


AUDIT = f"""{B.ENTITIES}, top AS (
  SELECT o_custkey, o_orderpriority AS p, max(o_orderstatus) AS s FROM orders WHERE o_totalprice > 200000 GROUP BY 1, 2),
d AS (SELECT o_custkey, count(*) AS n, bool_or(s = 'F') AS locked, bool_or(p = '1-URGENT') AS ident,
  bool_or(p = '5-LOW') AS low, bool_or(p = '2-HIGH') AS high FROM top GROUP BY 1),
e AS (SELECT journal_id, name, category_id, updated_at, detail_crawled,
  CASE WHEN comments_crawled THEN CASE WHEN category_id < 12 THEN 'list' ELSE 'none' END WHEN n IS NULL THEN 'none' ELSE 'doc' END AS kind,
  n, locked, ident, low, high FROM entities LEFT JOIN d ON o_custkey = journal_id),
reasons AS (SELECT *,
  CASE kind WHEN 'none' THEN 'detail_empty' WHEN 'list' THEN 'detail_not_object' ELSE
    concat_ws(',', CASE WHEN locked THEN 'detail_login_placeholder' END, CASE WHEN n < 3 THEN 'detail_low_field_count' END,
      CASE WHEN NOT ident THEN 'detail_missing_identity' END) END AS hard FROM e),
audited AS (SELECT *,
  CASE WHEN kind <> 'doc' THEN '' ELSE concat_ws(',', CASE WHEN hard = '' AND n < 5 THEN 'detail_warn_field_count' END,
    CASE WHEN NOT low OR NOT high THEN 'detail_missing_important' END) END AS warns,
  CASE WHEN kind = 'doc' THEN n ELSE 0 END AS field_count FROM reasons),
result AS (SELECT *, CASE WHEN hard <> '' THEN 'bad' WHEN warns <> '' THEN 'warning' ELSE 'ok' END AS status,
  concat_ws(',', CASE WHEN hard <> '' THEN hard END, CASE WHEN warns <> '' THEN warns END) AS codes FROM audited)"""


def _audited(spark, sf, **kw):
    return Q.audit_job(documents(spark, sf), include_ok=True, audit_rules=RULES, **kw)


@query("record_audit", f"""
WITH {AUDIT} SELECT journal_id, status, field_count, hard AS hard_reasons, warns AS warnings, codes AS reason_codes,
  CASE WHEN kind = 'none' THEN 'detail_data' WHEN kind = 'doc' AND NOT ident THEN 'urgent' ELSE '' END AS missing_required,
  CASE WHEN kind = 'doc' THEN concat_ws(',', CASE WHEN NOT low THEN 'low' END, CASE WHEN NOT high THEN 'high' END) ELSE '' END AS missing_important
FROM result""")
def record_audit(spark, sf):
    rows = Q.audit(documents(spark, sf), audit_rules=RULES)
    lists = ("hard_reasons", "warnings", "reason_codes", "missing_required", "missing_important")
    return rows.select("journal_id", "status", "field_count", *[F.array_join(c, ",").alias(c) for c in lists])


@query("audit_job", f"""
WITH {AUDIT}, oldest AS (SELECT journal_id FROM entities WHERE detail_crawled ORDER BY updated_at, id LIMIT 400)
SELECT journal_id, name, status FROM result WHERE journal_id IN (SELECT journal_id FROM oldest) AND status <> 'ok'""")
def audit_job(spark, sf):
    return Q.audit_job(documents(spark, sf), limit=400, audit_rules=RULES).select("journal_id", "name", "status")


@query("audit_stats", f"""
WITH {AUDIT} SELECT count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'warning') AS warning,
  count(*) FILTER (status = 'bad') AS bad, count(*) AS total_checked FROM result WHERE detail_crawled""")
def audit_stats(spark, sf):
    return Q.audit_stats(_audited(spark, sf))


FOUND = f"""{AUDIT}, found AS (
  SELECT journal_id, CASE WHEN hard <> '' THEN 'error' ELSE 'warning' END AS problem_type,
    split_part(codes, ',', 1) AS problem_code,
    '详情质量检查: status=' || status || ', field_count=' || field_count || ', reasons=' || codes AS message,
    CAST(CASE WHEN split_part(codes, ',', 1) = 'detail_low_field_count' THEN 3 END AS BIGINT) AS expected_value,
    field_count AS actual_value FROM result WHERE detail_crawled AND status <> 'ok')"""


@query("audit_problems", f"WITH {FOUND} SELECT * FROM found")
def audit_problems(spark, sf):
    problems, _ = Q.audit_to_problems(_audited(spark, sf), min_fields=3)
    return problems


@query("audit_resolves", f"""
WITH {AUDIT} SELECT journal_id, unnest(['detail_empty', 'detail_not_object', 'detail_login_placeholder', 'detail_low_field_count',
  'detail_missing_identity', 'detail_warn_field_count', 'detail_missing_important']) AS problem_code
FROM result WHERE detail_crawled AND status = 'ok'""")
def audit_resolves(spark, sf):
    return Q.audit_to_problems(_audited(spark, sf), min_fields=3)[1]


# --- problem table -------------------------------------------------------------------------------

CODES = ("detail_empty", "detail_low_field_count", "detail_missing_identity", "comment_mismatch", "parse_error")


def problem_table(spark, sf):
    """One problem per (customer, code) from the customers' orders; some resolved."""
    o = load(spark, sf, "orders")
    code = F.element_at(F.array(*[F.lit(c) for c in CODES]), F.substring("o_orderpriority", 1, 1).cast("int"))
    rows = o.groupBy(F.col("o_custkey").alias("journal_id"), code.alias("problem_code")).agg(
        F.min("o_orderkey").alias("id"), F.min("o_orderdate").alias("created_at"),
        F.max("o_orderdate").alias("updated_at"), F.count(F.lit(1)).alias("n"))
    done = F.col("n") > 2
    return rows.select(
        "id", "journal_id", F.when(F.col("n") > 1, "warning").otherwise("error").alias("problem_type"), "problem_code",
        F.lit("seen before").alias("message"), F.lit(None).cast("long").alias("expected_value"),
        F.col("n").alias("actual_value"), F.when(done, 1).otherwise(0).alias("resolved"),
        F.when(done, F.col("updated_at")).alias("resolved_at"), "created_at", "updated_at",
    )


PROBLEMS = """problems AS (
  SELECT id, journal_id, CASE WHEN n > 1 THEN 'warning' ELSE 'error' END AS problem_type, problem_code,
    'seen before' AS message, CAST(NULL AS BIGINT) AS expected_value, n AS actual_value,
    CASE WHEN n > 2 THEN 1 ELSE 0 END AS resolved, CASE WHEN n > 2 THEN updated_at END AS resolved_at, created_at, updated_at
  FROM (SELECT o_custkey AS journal_id, ['detail_empty', 'detail_low_field_count', 'detail_missing_identity',
      'comment_mismatch', 'parse_error'][CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS problem_code,
      min(o_orderkey) AS id, min(o_orderdate) AS created_at, max(o_orderdate) AS updated_at, count(*) AS n
    FROM orders GROUP BY 1, 2))"""


@query("problems_recorded", f"""
WITH {FOUND}, {PROBLEMS}, j AS (
  SELECT p.id, coalesce(p.journal_id, f.journal_id) AS journal_id, coalesce(p.problem_code, f.problem_code) AS problem_code,
    coalesce(p.problem_type, f.problem_type) AS problem_type, f.journal_id IS NOT NULL AS hit, f.message AS fm, p.message AS pm,
    f.actual_value AS fa, p.actual_value AS pa, coalesce(p.resolved, 0) AS resolved, p.created_at, p.updated_at
  FROM problems p FULL JOIN found f ON p.journal_id = f.journal_id AND p.problem_code = f.problem_code AND p.resolved = 0)
SELECT coalesce(id, (SELECT greatest(max(id), 0) FROM problems) + row_number() OVER (PARTITION BY id IS NULL ORDER BY journal_id, problem_code)) AS id,
  journal_id, problem_code, problem_type, CASE WHEN hit THEN fm ELSE pm END AS message,
  CASE WHEN hit THEN fa ELSE pa END AS actual_value, resolved,
  coalesce(created_at, {B.NOW}) AS created_at, CASE WHEN hit THEN {B.NOW} ELSE updated_at END AS updated_at, id IS NULL AS added FROM j""")
def problems_recorded(spark, sf):
    found, _ = Q.audit_to_problems(_audited(spark, sf), min_fields=3)
    table = problem_table(spark, sf)
    rows = P.record_problems(table, found, B.latest_order(spark, sf))
    known = table.select("id", F.lit(True).alias("_k"))
    return rows.join(known, "id", "left").select(
        "id", "journal_id", "problem_code", "problem_type", "message", "actual_value", "resolved", "created_at", "updated_at",
        F.col("_k").isNull().alias("added"))


@query("problems_resolved", f"""
WITH {AUDIT}, {PROBLEMS}, h AS (SELECT p.*, resolved = 0 AND (
    (starts_with(problem_code, 'detail_') AND journal_id IN (SELECT journal_id FROM result WHERE detail_crawled AND status = 'ok'))
    OR journal_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)) AS hit FROM problems p)
SELECT id, journal_id, problem_code, CASE WHEN hit THEN 1 ELSE resolved END AS resolved,
  CASE WHEN hit THEN {B.NOW} ELSE resolved_at END AS resolved_at FROM h""")
def problems_resolved(spark, sf):
    _, ok = Q.audit_to_problems(_audited(spark, sf), min_fields=3)
    rich = load(spark, sf, "customer").filter("c_acctbal > 9000").select(
        F.col("c_custkey").alias("journal_id"), F.lit(None).cast("string").alias("problem_code"))
    rows = P.resolve_problems(problem_table(spark, sf), ok.unionByName(rich), B.latest_order(spark, sf))
    return rows.select("id", "journal_id", "problem_code", "resolved", "resolved_at")


@query("problems_resolved_count", f"""
WITH {PROBLEMS} SELECT count(*) AS resolved_count FROM problems WHERE resolved = 0
  AND id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def problems_resolved_count(spark, sf):
    table = problem_table(spark, sf)
    ids = load(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return P.count_resolved(table, P.resolve_by_id(table, ids, B.latest_order(spark, sf)))


@query("problem_list", f"""
WITH {PROBLEMS} SELECT id, journal_id, problem_type, problem_code, created_at FROM problems
WHERE resolved = 0 AND problem_type = 'error' AND problem_code = 'parse_error'""")
def problem_list(spark, sf):
    rows = S.list_problems(problem_table(spark, sf), problem_type="error", code="parse_error")
    return rows.select("id", "journal_id", "problem_type", "problem_code", "created_at")


@query("problem_list_closed", f"WITH {PROBLEMS} SELECT id, resolved_at FROM problems WHERE resolved = 1")
def problem_list_closed(spark, sf):
    return S.list_problems(problem_table(spark, sf), resolved=True).select("id", "resolved_at")


@query("open_problem_ids", f"""
WITH {PROBLEMS} SELECT DISTINCT journal_id FROM problems WHERE resolved = 0 AND problem_code = 'detail_empty'""")
def open_problem_ids(spark, sf):
    return S.open_problem_ids(problem_table(spark, sf), "detail_empty")


@query("problem_stats", f"""
WITH {PROBLEMS}, t(v) AS (VALUES ('warning'), ('error'))
SELECT 'overall' AS dimension, 'total' AS value, count(*) AS n FROM problems
UNION ALL SELECT 'overall', 'unresolved', count(*) FROM problems WHERE resolved = 0
UNION ALL SELECT 'overall', 'resolved', count(*) FROM problems WHERE resolved = 1
UNION ALL SELECT 'by_type', v, count(id) FROM t LEFT JOIN problems ON problem_type = v AND resolved = 0 GROUP BY v
UNION ALL SELECT 'by_code', problem_code, count(*) FROM problems WHERE resolved = 0 GROUP BY problem_code""")
def problem_stats(spark, sf):
    return stats.problem_stats(problem_table(spark, sf))


@query("purge_resolved", f"WITH {PROBLEMS} SELECT id, journal_id, problem_code FROM problems WHERE resolved = 0")
def purge_resolved(spark, sf):
    return P.purge_resolved(problem_table(spark, sf)).select("id", "journal_id", "problem_code")


@query("problem_actions", f"""
WITH {PROBLEMS}, fixed AS (SELECT c_custkey FROM customer WHERE c_acctbal > 5000), a AS (
  SELECT journal_id, problem_code, CASE WHEN problem_code = 'comment_mismatch' THEN 'refresh_comments'
    WHEN starts_with(problem_code, 'detail_') THEN 'resolve_detail_id' ELSE 'reset' END AS action FROM problems WHERE resolved = 0)
SELECT *, action = 'reset' OR (action = 'resolve_detail_id' AND journal_id IN (SELECT c_custkey FROM fixed)) AS resolves FROM a""")
def problem_actions(spark, sf):
    outcome = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("journal_id"),
        F.when(F.col("c_acctbal") > 5000, "updated").otherwise("unresolved").alias("status"))
    return P.problem_actions(problem_table(spark, sf), outcome)


# --- rebuild plan, page flags ------------------------------------------------------------------------

@query("plan_bad", f"""
WITH {AUDIT} SELECT CAST(journal_id AS VARCHAR) AS target_id, codes AS reasons FROM result WHERE detail_crawled AND status = 'bad'""")
def plan_bad(spark, sf):
    rows = R.targets_bad(_audited(spark, sf))
    reasons = F.from_json(F.get_json_object("extra_data", "$.quality_reasons"), "array<string>")
    return rows.select("target_id", F.array_join(reasons, ",").alias("reasons"))


@query("rebuild_report", f"""
WITH {AUDIT}, {B.ITEMS}, latest AS (
  SELECT target_id, arg_max(status, id) AS s FROM items WHERE task_type = 'detail' GROUP BY 1),
req AS (SELECT DISTINCT o_custkey + 1 AS journal_id FROM orders),
planned AS (SELECT journal_id, CASE WHEN s = 'running' THEN 'keep' ELSE 'go' END AS action FROM req JOIN entities USING (journal_id)
  LEFT JOIN latest ON target_id = CAST(journal_id AS VARCHAR))
SELECT (SELECT count(*) FROM req) AS requested, count(*) FILTER (action = 'go') AS reset_count,
  count(*) FILTER (action = 'keep') AS skipped_running, (SELECT count(*) FROM req) - count(*) AS not_found FROM planned""")
def rebuild_report(spark, sf):
    wanted = load(spark, sf, "orders").select((F.col("o_custkey") + 1).alias("journal_id")).distinct()
    targets = R.targets_ids(B.entities(spark, sf), wanted)
    planned = R.plan(targets, B.work_items(spark, sf), "detail_force", "detail")
    return R.rebuild_report(planned, wanted)


@query("page_flags", """
SELECT page_id, contains(html, '您请求页面的速度过快') AS rate_limited, contains(html, 'force_download_install') AS overlay,
  contains(html, '注册 或 登录 后') OR contains(html, '注册或登录后') OR contains(html, '登录 后，查看') AS login_placeholder
FROM (SELECT page_id, html || CASE WHEN url LIKE 'https://m.%' THEN '您请求页面的速度过快' WHEN url LIKE 'https:%' THEN '请注册或登录后' ELSE '' END AS html FROM pages)""")
def page_flags(spark, sf):
    url = F.col("url")
    tail = F.when(F.startswith(url, F.lit("https://m.")), "您请求页面的速度过快").when(
        F.startswith(url, F.lit("https:")), "请注册或登录后").otherwise("")
    pages = load(spark, sf, "pages").select("page_id", F.concat("html", tail).alias("html"))
    return Q.page_flags(pages).drop("html")


@query("extraction_check", """
WITH d AS (SELECT o_custkey AS journal_id, list(DISTINCT o_orderpriority) AS ks FROM orders GROUP BY 1)
SELECT journal_id, len(ks) AS n_fields, len(ks) >= 5 AS accepted, true AS warns,
  CASE WHEN len(ks) < 5 THEN 'issn,期刊ISSN,impact_factor,最新影响因子,jcr_partition,JCR分区,cas_partition' ELSE '' END AS missing FROM d""")
def extraction_check(spark, sf):
    keys = load(spark, sf, "orders").select("o_custkey", "o_orderpriority").distinct()
    # at most five entries per customer
    fields = F.map_from_entries(F.collect_list(F.struct("o_orderpriority", F.lit("x"))))
    rows = Q.validate_extracted(keys.groupBy(F.col("o_custkey").alias("journal_id")).agg(fields.alias("fields")))
    return rows.select("journal_id", "n_fields", "accepted", "warns", F.array_join("missing", ",").alias("missing"))
