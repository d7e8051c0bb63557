"""Listing index: customers listed by nation in pages of ten."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestry.catalog import bindings as B
from harvestry.catalog.registry import query
from harvestry.operators import entities as N
from harvestry.operators import listing as L
from harvestry.operators import stats
from harvestry.session import work_folder
from harvestry.sources import buckets as K
from harvestry.sources.sinks import replace_keys, upsert
from harvestry.sources.tables import load


def items(spark, sf):
    """Customer keys in tens are listing pages; the place on the page is the last digit."""
    return load(spark, sf, "customer").select(
        F.col("c_nationkey").cast("long").alias("category_id"),
        F.floor(F.col("c_custkey") / 10).alias("page_no"), (F.col("c_custkey") % 10 + 1).alias("position_no"),
        F.col("c_custkey").alias("journal_id"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("name"),
    )


ITEMS = """items AS (
  SELECT CAST(c_nationkey AS BIGINT) AS category_id, c_custkey // 10 AS page_no, c_custkey % 10 + 1 AS position_no,
    c_custkey AS journal_id, CASE WHEN c_acctbal > 0 THEN c_name END AS name, c_acctbal FROM customer)"""

PRINT_SQL = """count(*) AS item_count, arg_min(journal_id, position_no) AS first_id, arg_max(journal_id, position_no) AS last_id,
  sha256(string_agg(CAST(journal_id AS VARCHAR), ',' ORDER BY position_no)) AS ids_hash"""


@query("page_bounds", f"""
WITH {ITEMS} SELECT category_id, page_no, count(*) AS item_count, arg_min(journal_id, position_no) AS first_id,
  arg_max(journal_id, position_no) AS last_id FROM items GROUP BY 1, 2""")
def page_bounds(spark, sf):
    return L.page_bounds(items(spark, sf))


@query("page_fingerprints", f"WITH {ITEMS} SELECT category_id, page_no, {PRINT_SQL} FROM items GROUP BY 1, 2")
def page_fingerprints(spark, sf):
    return L.page_fingerprints(items(spark, sf))


@query("changed_pages", f"""
WITH {ITEMS}, o AS (SELECT category_id, page_no, {PRINT_SQL} FROM items WHERE c_acctbal < 9000 GROUP BY 1, 2),
n AS (SELECT category_id, page_no, {PRINT_SQL} FROM items WHERE c_acctbal > 0 GROUP BY 1, 2)
SELECT coalesce(o.category_id, n.category_id) AS category_id, coalesce(o.page_no, n.page_no) AS page_no,
  o.ids_hash AS old_hash, n.ids_hash AS new_hash,
  CASE WHEN o.ids_hash IS NULL THEN 'new' WHEN n.ids_hash IS NULL THEN 'gone' ELSE 'changed' END AS change
FROM o FULL JOIN n ON o.category_id = n.category_id AND o.page_no = n.page_no WHERE o.ids_hash IS DISTINCT FROM n.ids_hash""")
def changed_pages(spark, sf):
    rows = items(spark, sf).join(load(spark, sf, "customer").select(
        F.col("c_custkey").alias("journal_id"), "c_acctbal"), "journal_id")
    return L.changed_pages(
        L.page_fingerprints(rows.filter("c_acctbal < 9000")), L.page_fingerprints(rows.filter("c_acctbal > 0")))


def _groups(spark, sf):
    remote = load(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    nation = load(spark, sf, "nation")
    total = F.when(F.col("n_regionkey") == 2, 0).otherwise(F.coalesce("n", F.lit(0)))
    return nation.join(remote, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
        F.col("n_nationkey").cast("long").alias("category_id"), F.col("n_name").alias("field_tag"),
        total.cast("long").alias("remote_total_count"))


def links(spark, sf):
    """Links of the customers with a big finished order; the nations of region 4 are not indexed yet."""
    seen = load(spark, sf, "orders").filter("o_orderstatus = 'F' AND o_totalprice > 100000").groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("first_seen_at"), F.max("o_orderdate").alias("last_seen_at"))
    c = load(spark, sf, "customer")
    indexed = load(spark, sf, "nation").filter("n_regionkey <> 4").select(F.col("n_nationkey").alias("c_nationkey"))
    return c.join(indexed, "c_nationkey", "left_semi").join(seen, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_nationkey").cast("long").alias("category_id"), F.col("c_custkey").alias("journal_id"),
        F.lit(1).cast("long").alias("page_no"), F.lit(1).cast("long").alias("position_no"),
        (F.col("c_acctbal") > -900).alias("active"), "first_seen_at", "last_seen_at")


LINKS = """links AS (
  SELECT CAST(c_nationkey AS BIGINT) AS category_id, c_custkey AS journal_id, CAST(1 AS BIGINT) AS page_no,
    CAST(1 AS BIGINT) AS position_no, c_acctbal > -900 AS active, f AS first_seen_at, l AS last_seen_at
  FROM customer JOIN (SELECT o_custkey, min(o_orderdate) AS f, max(o_orderdate) AS l FROM orders
    WHERE o_orderstatus = 'F' AND o_totalprice > 100000 GROUP BY 1) ON o_custkey = c_custkey WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 4))"""
STATES = f"""{LINKS}, g AS (
  SELECT CAST(n_nationkey AS BIGINT) AS category_id, n_name AS field_tag,
    CASE WHEN n_regionkey = 2 THEN 0 ELSE (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) END AS remote_total_count,
    (SELECT count(*) FROM links WHERE category_id = n_nationkey AND active) AS local_index_count FROM nation),
states AS (SELECT *, CASE WHEN remote_total_count > 0 THEN (remote_total_count + 9) // 10 ELSE 0 END AS total_pages,
    CASE WHEN remote_total_count > 0 THEN (remote_total_count - 1) % 10 + 1 ELSE 0 END AS last_page_count,
    greatest(remote_total_count - local_index_count, 0) AS estimated_new_count,
    CASE WHEN local_index_count = 0 AND remote_total_count > 0 THEN 'missing_index'
      WHEN remote_total_count <> local_index_count THEN 'changed' ELSE 'in_sync' END AS status FROM g)"""


def _states(spark, sf):
    return L.group_state(_groups(spark, sf), links(spark, sf), B.latest_order(spark, sf))


@query("group_state", f"WITH {STATES} SELECT * FROM states")
def group_state(spark, sf):
    return _states(spark, sf).drop("last_checked_at")


@query("group_state_after_scan", f"""
WITH {STATES} SELECT category_id, local_index_count, estimated_new_count, CASE WHEN estimated_new_count = 0 THEN 'in_sync' ELSE 'changed' END AS status,
  CASE WHEN estimated_new_count = 0 THEN {B.NOW} END AS last_full_scanned_at FROM states""")
def group_state_after_scan(spark, sf):
    states = _states(spark, sf).withColumn("last_full_scanned_at", F.lit(None).cast("timestamp_ntz"))
    rows = L.group_state_after_scan(states, links(spark, sf), B.latest_order(spark, sf))
    return rows.select("category_id", "local_index_count", "estimated_new_count", "status", "last_full_scanned_at")


@query("upsert_links", f"""
WITH {ITEMS}, {LINKS}, s AS (SELECT * FROM items WHERE c_acctbal > 4000)
SELECT coalesce(l.category_id, s.category_id) AS category_id, coalesce(l.journal_id, s.journal_id) AS journal_id,
  coalesce(s.page_no, l.page_no) AS page_no, coalesce(s.position_no, l.position_no) AS position_no,
  CASE WHEN s.journal_id IS NOT NULL THEN true ELSE false END AS active,
  coalesce(first_seen_at, {B.NOW}) AS first_seen_at,
  CASE WHEN s.journal_id IS NOT NULL THEN {B.NOW} ELSE last_seen_at END AS last_seen_at, l.journal_id IS NULL AS is_new
FROM links l FULL JOIN s ON l.category_id = s.category_id AND l.journal_id = s.journal_id""")
def upsert_links(spark, sf):
    rich = load(spark, sf, "customer").filter("c_acctbal > 4000").select(F.col("c_custkey").alias("journal_id"))
    seen = items(spark, sf).join(rich, "journal_id", "left_semi")
    return L.upsert_links(links(spark, sf), seen, B.latest_order(spark, sf), expire_missing=True)


@query("new_only", f"""
WITH {ITEMS}, twice AS (SELECT *, 1 AS copy FROM items UNION ALL SELECT * REPLACE ('again' AS name, page_no + 1000000 AS page_no), 2 FROM items)
SELECT journal_id, coalesce(arg_min(struct_pack(n := name), page_no).n, CAST(journal_id AS VARCHAR)) AS name, min(page_no) AS page_no
FROM twice WHERE journal_id NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) GROUP BY journal_id""")
def new_only(spark, sf):
    listed = items(spark, sf)
    again = listed.withColumns({"name": F.lit("again"), "page_no": F.col("page_no") + 1000000})
    known = load(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("journal_id"))
    return L.new_only(listed.unionByName(again), known).select("journal_id", "name", "page_no")


@query("upsert_groups", """
WITH old AS (SELECT CAST(n_nationkey AS VARCHAR) AS field_tag, n_name AS name, CAST(n_regionkey AS BIGINT) AS total_count FROM nation),
new AS (SELECT CAST(c_nationkey + 2 AS VARCHAR) AS field_tag, 'NATION_' || (c_nationkey + 2) AS name, count(*) % 5 AS total_count FROM customer GROUP BY c_nationkey)
SELECT coalesce(o.field_tag, n.field_tag) AS field_tag, coalesce(n.name, o.name) AS name, coalesce(n.total_count, o.total_count) AS total_count,
  CASE WHEN o.field_tag IS NULL THEN 'new' WHEN n.field_tag IS NULL THEN 'unseen'
    WHEN o.name <> n.name OR o.total_count <> n.total_count THEN 'updated' ELSE 'unchanged' END AS outcome
FROM old o FULL JOIN new n ON o.field_tag = n.field_tag""")
def upsert_groups(spark, sf):
    old = load(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("field_tag"), F.col("n_name").alias("name"),
        F.col("n_regionkey").cast("long").alias("total_count"))
    found = load(spark, sf, "customer").groupBy("c_nationkey").agg((F.count(F.lit(1)) % 5).alias("total_count")).select(
        (F.col("c_nationkey") + 2).cast("string").alias("field_tag"),
        F.concat(F.lit("NATION_"), F.col("c_nationkey") + 2).alias("name"), "total_count")
    return L.upsert_groups(old, found)


@query("upsert_entities", f"""
WITH {ITEMS}, old AS (SELECT o_custkey AS journal_id, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS name,
    CASE WHEN max(o_totalprice) > 450000 THEN CAST(0 AS BIGINT) END AS category_id FROM orders GROUP BY o_custkey),
new AS (SELECT journal_id, coalesce(name, 'unnamed') AS name, category_id FROM items WHERE c_acctbal > -500)
SELECT coalesce(o.journal_id, n.journal_id) AS journal_id, coalesce(n.name, o.name) AS name, coalesce(o.category_id, n.category_id) AS category_id,
  CASE WHEN o.journal_id IS NULL THEN 'new' WHEN n.journal_id IS NULL THEN 'unseen'
    WHEN o.name <> n.name OR o.category_id IS NULL THEN 'updated' ELSE 'unchanged' END AS outcome
FROM old o FULL JOIN new n ON o.journal_id = n.journal_id""")
def upsert_entities(spark, sf):
    old = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("journal_id")).agg(F.max("o_totalprice").alias("p")).select(
        "journal_id", F.concat(F.lit("Customer#"), F.lpad(F.col("journal_id").cast("string"), 9, "0")).alias("name"),
        F.when(F.col("p") > 450000, F.lit(0).cast("long")).alias("category_id"))
    seen = items(spark, sf).join(load(spark, sf, "customer").filter("c_acctbal > -500").select(
        F.col("c_custkey").alias("journal_id")), "journal_id", "left_semi")
    return L.upsert_entities(old, seen.withColumn("name", F.coalesce("name", F.lit("unnamed"))))


@query("listing_outcomes", """
WITH n AS (SELECT c_custkey, c_acctbal > 4000 AS seen, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS had FROM customer)
SELECT CASE WHEN NOT had THEN 'new' WHEN NOT seen THEN 'unseen' ELSE 'updated' END AS outcome, count(*) AS n FROM n WHERE seen OR had GROUP BY 1""")
def listing_outcomes(spark, sf):
    old = load(spark, sf, "orders").filter("o_totalprice > 400000").select(
        F.col("o_custkey").alias("journal_id"), F.lit("old").alias("name"), F.lit(None).cast("long").alias("category_id")).distinct()
    rich = load(spark, sf, "customer").filter("c_acctbal > 4000").select(F.col("c_custkey").alias("journal_id"))
    return L.outcome_counts(L.upsert_entities(old, items(spark, sf).join(rich, "journal_id", "left_semi")))


@query("entity_merge", """
WITH d AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS mx, max(o_orderpriority) AS pr,
    max(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS fp FROM orders WHERE o_totalprice > 300000 GROUP BY 1)
SELECT c_custkey AS journal_id, CASE WHEN n IS NOT NULL AND fp IS NOT NULL THEN fp WHEN n IS NOT NULL AND c_acctbal > 2000 THEN 'doc-' || c_custkey ELSE c_name END AS issn,
  CASE WHEN n IS NOT NULL THEN pr ELSE 'old' END AS jcr_partition,
  CASE WHEN n IS NULL THEN 7.5 WHEN mx > 450000 THEN CAST(n AS DOUBLE) ELSE 7.5 END AS impact_factor,
  CASE WHEN n IS NOT NULL THEN NULL ELSE 'old' END AS citescore,
  CASE WHEN n IS NOT NULL THEN true ELSE c_acctbal > 0 END AS detail_crawled
FROM customer LEFT JOIN d ON o_custkey = c_custkey""")
def entity_merge(spark, sf):
    base = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("journal_id"), F.col("c_name").alias("issn"), F.lit("e").alias("eissn"),
        F.lit(7.5).cast("decimal(10,4)").alias("impact_factor"), F.lit(1).cast("decimal(10,4)").alias("impact_factor_realtime"),
        *[F.lit("old").alias(c) for c in N.OVERWRITTEN if c != "eissn"], (F.col("c_acctbal") > 0).alias("detail_crawled"),
        F.when(F.col("c_acctbal") > 2000, F.concat(F.lit('{"issn": "doc-'), F.col("c_custkey"), F.lit('"}'))).alias("detail_data"))
    fresh = load(spark, sf, "orders").filter("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("journal_id")).agg(
        F.to_json(F.struct(
            F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("issn"),
            F.max("o_orderpriority").alias("jcr_partition"),
            F.when(F.max("o_totalprice") > 450000, F.concat(F.lit("IF "), F.count(F.lit(1)))).otherwise(F.lit("-")).alias("impact_factor"),
        )).alias("fresh_doc"))
    rows = N.merge_detail(base, fresh)
    return rows.select("journal_id", "issn", "jcr_partition", F.col("impact_factor").cast("double").alias("impact_factor"),
                       "citescore", "detail_crawled")


@query("catalog_totals", """
SELECT (SELECT count(*) FROM nation) AS groups, count(*) AS entities, count(*) FILTER (c_acctbal > 0) AS entities_with_detail,
  (SELECT count(*) FROM orders) AS children FROM customer""")
def catalog_totals(spark, sf):
    return stats.catalog_totals(load(spark, sf, "nation"), B.entities(spark, sf), load(spark, sf, "orders"))


@query("keyed_upsert", """
WITH new AS (SELECT o_custkey AS c_custkey, max(o_orderpriority) AS seg, CASE WHEN max(o_totalprice) > 450000 THEN max(o_totalprice) END AS bal
  FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT coalesce(c.c_custkey, n.c_custkey + 1000000000) AS c_custkey, CASE WHEN c.c_custkey IS NOT NULL THEN c_mktsegment ELSE seg END AS c_mktsegment,
  coalesce(bal, c_acctbal) AS c_acctbal, CASE WHEN n.c_custkey IS NOT NULL THEN 'new' ELSE 'old' END AS origin
FROM customer c LEFT JOIN new n ON n.c_custkey = c.c_custkey""")
def keyed_upsert(spark, sf):
    old = load(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", F.lit("old").alias("origin"))
    new = load(spark, sf, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_orderpriority").alias("c_mktsegment"), F.max("o_totalprice").alias("p")).select(
        "c_custkey", "c_mktsegment", F.when(F.col("p") > 450000, F.col("p")).alias("c_acctbal"), F.lit("new").alias("origin"))
    return upsert(old, new, ["c_custkey"], {"c_mktsegment": "keep", "c_acctbal": "fill"})


@query("replace_keys", """
SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000)
UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000""")
def replaced(spark, sf):
    rows = load(spark, sf, "orders")
    old = rows.filter("o_orderstatus <> 'F'").select("o_custkey", "o_orderkey")
    new = rows.filter("o_orderstatus = 'F' AND o_totalprice > 400000").select("o_custkey", "o_orderkey")
    return replace_keys(old, new, ["o_custkey"])


@query("upsert_version", """
WITH a AS (SELECT o_custkey AS k, max(o_totalprice) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
b AS (SELECT o_custkey AS k, max(o_totalprice) AS p FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT coalesce(c_custkey, a.k, b.k) AS c_custkey, coalesce(b.p, a.p, c_acctbal) AS c_acctbal,
  CASE WHEN b.k IS NOT NULL THEN 'second' WHEN a.k IS NOT NULL THEN 'first' ELSE 'old' END AS origin
FROM customer LEFT JOIN a ON a.k = c_custkey LEFT JOIN b ON b.k = c_custkey""")
def upsert_version(spark, sf):
    """A table in buckets, changed twice and read back from its last manifest."""
    folder = work_folder(spark, "bucketed")
    old = load(spark, sf, "customer").select("c_custkey", "c_acctbal", F.lit("old").alias("origin"))
    K.write_buckets(old, folder, -1, ["c_custkey"])
    for status, origin in (("F", "first"), ("P", "second")):
        new = load(spark, sf, "orders").filter(F.col("o_orderstatus") == status)
        new = new.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
        K.upsert_version(new.withColumn("origin", F.lit(origin)), folder)
    return K.read_version(spark, folder, K.open_version(spark, folder))
