"""Search, filters, listings and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestry.catalog import bindings as B
from harvestry.catalog.registry import query
from harvestry.functions.text import trigram_similarity
from harvestry.operators import resources, search as S
from harvestry.operators.fuzzy import fuzzy_pairs
from harvestry.plans import refresh
from harvestry.session import work_folder
from harvestry.sources import sinks
from harvestry.sources.tables import load


@query("search_page", """
WITH hits AS (
  SELECT * FROM part WHERE p_retailprice >= 905 AND p_retailprice <= 40000
    AND (contains(lower(p_name), 'widget') OR contains(lower(p_brand), 'widget') OR contains(lower(p_type), 'widget'))
  ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 5 OFFSET 5)
SELECT p_partkey, p_name, p_brand, p_retailprice,
  (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS n_children
FROM hits""")
def search_page(spark, sf):
    part = load(spark, sf, "part")
    found = S.search_entities(part, q="WIDGET ", score_min=905.0, score_max=40000.0, cols=B.PART)
    rows = S.page(S.sort_entities(found, "p_retailprice", "desc", B.PART), 2, 5)
    rows = rows.select("p_partkey", "p_name", "p_brand", "p_retailprice")
    return S.with_child_counts(rows, load(spark, sf, "lineitem"), "p_partkey", child_key="l_partkey", is_page=True)


@query("search_filters", """
SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part
WHERE p_size = 11 AND contains(lower(p_name), 'e') AND (contains(lower(p_brand), 'brand#1') OR contains(lower(p_type), 'brand#1'))
  AND contains(lower(p_type), 'm')""")
def search_filters(spark, sf):
    found = S.search_entities(
        load(spark, sf, "part"), name="E", code=" brand#1", group_id=11, texts={"p_type": "M", "p_brand": " "},
        cols=B.PART,
    )
    return found.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


@query("search_flags", """
SELECT c_custkey AS journal_id, c_name AS name FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING'""")
def search_flags(spark, sf):
    return S.search_entities(B.entities(spark, sf), detail_done=True, children_done=False).select("journal_id", "name")


_TRIGRAMS = """list_distinct(flatten(list_transform(
  list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''),
  lambda w: list_transform(range(1, len(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"""


@query("search_fuzzy", f"""
WITH t AS (SELECT p_partkey, p_name, {_TRIGRAMS.format('p_name')} AS a, {_TRIGRAMS.format("'red wdget'")} AS b FROM part),
s AS (SELECT *, len(list_intersect(a, b)) AS n FROM t),
r AS (SELECT p_partkey, p_name, n / (len(a) + len(b) - n) AS similarity FROM s)
SELECT p_partkey, p_name, round(similarity, 6) AS similarity FROM r
WHERE similarity >= 0.4 OR contains(lower(p_name), 'red wdget')""")
def search_fuzzy(spark, sf):
    found = S.search_entities(load(spark, sf, "part"), name="red wdget", typo_fuzzy=True, threshold=0.4, cols=B.PART)
    similarity = F.round(trigram_similarity("p_name", F.lit("red wdget")), 6)
    return found.select("p_partkey", "p_name", similarity.alias("similarity"))


_LABEL = "p_name || ' ' || p_brand || ' ' || p_size"
_MISSPELT = "replace(replace(p_name, 'i', ''), 'ea', 'ae')"


@query("fuzzy_terms", f"""
WITH n AS (SELECT DISTINCT {_LABEL} AS name FROM part), m AS (SELECT DISTINCT {_MISSPELT} AS term FROM part),
a AS (SELECT name, {_TRIGRAMS.format('name')} AS x FROM n), b AS (SELECT term, {_TRIGRAMS.format('term')} AS y FROM m),
p AS (SELECT term, name, len(x) AS nx, len(y) AS ny, len(list_intersect(x, y)) AS c FROM a, b)
SELECT term, name, round(c / (nx + ny - c), 6) AS similarity FROM p WHERE c / (nx + ny - c) >= 0.3""")
def fuzzy_terms(spark, sf):
    parts = load(spark, sf, "part")
    names, terms = parts.select(F.expr(_LABEL).alias("name")), parts.select(F.expr(_MISSPELT).alias("term"))
    return fuzzy_pairs(names, terms, threshold=0.3).withColumn("similarity", F.round("similarity", 6))


@query("search_doc_field", """
SELECT event_id, props FROM events WHERE json_extract_string(props, '$.k') = '42'""")
def search_doc_field(spark, sf):
    cols = B.EntityColumns(doc="props")
    found = S.search_entities(load(spark, sf, "events"), doc_field="k", doc_value="42", doc_op="equals", cols=cols)
    return found.select("event_id", "props")


@query("search_doc_contains", """
SELECT event_id FROM events WHERE contains(json_extract_string(props, '$.k'), '7') AND json_exists(props, '$.k')""")
def search_doc_contains(spark, sf):
    cols = B.EntityColumns(doc="props")
    found = S.search_entities(load(spark, sf, "events"), doc_field="k", doc_value="7", doc_op="like", cols=cols)
    return S.search_entities(found, doc_field="k", doc_op="exists", cols=cols).select("event_id")


@query("search_doc_text", """
SELECT c_custkey AS journal_id FROM customer
WHERE c_acctbal >= 500 AND (contains(lower(c_mktsegment), 'build') OR contains(CAST(CAST(floor(c_acctbal / 500) AS BIGINT) AS VARCHAR), 'build'))""")
def search_doc_text(spark, sf):
    return S.search_entities(B.entities(spark, sf), doc_text="Build").select("journal_id")


@query("simple_search", """
SELECT p_partkey, p_name, p_brand FROM part
WHERE contains(lower(p_name), 'bolt') OR contains(lower(p_brand), 'bolt') OR contains(lower(p_type), 'bolt')
UNION ALL SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey = 12""")
def simple_search(spark, sf):
    part = load(spark, sf, "part")
    by_text = S.simple_search(part, "BOLT", cols=B.PART)
    by_id = S.simple_search(part, " 12 ", cols=B.PART)
    return by_text.unionByName(by_id).select("p_partkey", "p_name", "p_brand")


@query("default_listing", """
SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 500""")
def default_listing(spark, sf):
    return S.page(S.default_listing(load(spark, sf, "part"), B.PART), 1, 500).select("p_partkey", "p_name", "p_retailprice")


@query("children_pages", f"""
WITH {B.CHILDREN}, ranked AS (
  SELECT 'crawled' AS listing, journal_id, comment_id, row_number() OVER (PARTITION BY journal_id ORDER BY crawled_at DESC NULLS LAST, comment_id) AS p FROM children
  UNION ALL SELECT 'time', journal_id, comment_id, row_number() OVER (PARTITION BY journal_id ORDER BY comment_time DESC NULLS LAST, comment_id) FROM children
  UNION ALL SELECT 'rating', journal_id, comment_id, row_number() OVER (PARTITION BY journal_id ORDER BY CAST(substr(rating, 1, 1) AS BIGINT) DESC, comment_id) FROM children)
SELECT listing, journal_id, comment_id, CAST(p AS INTEGER) AS place FROM ranked WHERE p <= 5""")
def children_pages(spark, sf):
    kids = B.children(spark, sf)
    out = None
    for by in ("crawled", "time", "rating"):
        rows = S.first_children(kids, 5, by).select(F.lit(by).alias("listing"), "journal_id", "comment_id", "place")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("entities_with_counts", f"""
WITH {B.ENTITIES}, {B.CHILDREN}
SELECT e.journal_id, e.name, count(c.id) AS n_children FROM entities e
LEFT JOIN children c ON c.journal_id = e.journal_id AND c.submit_experience = 'F' GROUP BY ALL""")
def entities_with_counts(spark, sf):
    finished = B.children(spark, sf).filter("submit_experience = 'F'")
    return S.with_child_counts(B.entities(spark, sf).select("journal_id", "name"), finished)


@query("child_counts", "SELECT l_partkey, count(*) AS n_children FROM lineitem GROUP BY l_partkey")
def child_counts(spark, sf):
    return S.child_counts(load(spark, sf, "lineitem"), "l_partkey")


def _summary_docs(spark, sf):
    c = load(spark, sf, "customer")
    row = F.struct(
        F.col("c_mktsegment").alias("JIF分区"), F.col("c_nationkey").alias("JIF排名"),
        F.struct(F.col("c_name").alias("name")).alias("按JIF指标学科分区"),
    )
    part = F.struct(F.col("c_mktsegment").alias("大类学科"), F.lit("").alias("分区"), F.col("c_name").alias("大类"))
    score = F.struct(
        F.col("c_nationkey").cast("string").alias("CiteScore"),
        F.array(F.struct(F.lit("Q1").alias("分区"), F.col("c_mktsegment").alias("学科"), F.lit("1/9").alias("排名")))
        .alias("CiteScore排名"),
    )
    empty = F.lit(None).cast("string")
    return c.select(
        F.col("c_custkey").alias("journal_id"),
        F.when(F.col("c_acctbal") > 5000, F.to_json(F.struct(
            F.col("c_name").alias("text"), F.array(F.array(row)).alias("tables")))).alias("jcr_partition"),
        empty.alias("cas_partition"),
        F.to_json(F.struct(F.array(score).alias("tables"))).alias("citescore"),
        F.to_json(F.struct(
            F.concat(F.lit(" plain "), F.col("c_mktsegment")).alias("jcr_partition"),
            F.struct(F.col("c_mktsegment").alias("text"), F.array(part).alias("tables")).alias("cas_partition"),
        )).alias("detail_data"),
    )


@query("entity_summaries", """
SELECT c_custkey AS journal_id,
  CASE WHEN c_acctbal > 5000 THEN c_name || ' / ' || c_mktsegment || ' / ' || c_nationkey || ' / name: ' || c_name
    ELSE 'plain ' || c_mktsegment END AS jcr_partition_summary,
  c_mktsegment || ' / ' || c_name AS cas_partition_summary,
  'CiteScore ' || c_nationkey || ' / Q1 / ' || c_mktsegment || ' / 1/9' AS citescore_summary,
  (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_children
FROM customer""")
def entity_summaries(spark, sf):
    counts = S.child_counts(B.children(spark, sf))
    rows = S.entity_rows(_summary_docs(spark, sf), counts)
    return rows.select("journal_id", "jcr_partition_summary", "cas_partition_summary", "citescore_summary", "n_children")


@query("group_order", "SELECT n_nationkey, n_name FROM nation")
def group_order(spark, sf):
    nation = load(spark, sf, "nation")
    named = nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    from harvestry.operators.stats import named_order

    return named_order(named, "groups").select(F.col("id").alias("n_nationkey"), F.col("name").alias("n_name"))


@query("oldest_first", f"""
WITH {B.ENTITIES} SELECT journal_id, updated_at FROM entities ORDER BY updated_at NULLS FIRST, journal_id LIMIT 50""")
def oldest_first(spark, sf):
    return refresh.oldest_first(B.entities(spark, sf), 50).select("journal_id", "updated_at")


@query("known_flags", """
SELECT o_orderkey, o_custkey AS journal_id, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS exists_in_db
FROM orders""")
def known_flags(spark, sf):
    from harvestry.operators.resolve import flag_known

    known = load(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("journal_id"))
    return flag_known(load(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("journal_id")), known)


@query("found_and_missing", """
WITH wanted AS (SELECT DISTINCT o_custkey AS journal_id FROM orders),
known AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
SELECT journal_id, 'found' AS side FROM wanted WHERE journal_id IN (SELECT c_custkey FROM known)
UNION ALL SELECT journal_id, 'missing' FROM wanted WHERE journal_id NOT IN (SELECT c_custkey FROM known)""")
def found_and_missing(spark, sf):
    from harvestry.operators.resolve import split_found

    known = load(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("journal_id"))
    wanted = load(spark, sf, "orders").select(F.col("o_custkey").alias("journal_id")).distinct()
    found, missing = split_found(wanted, known)
    return found.withColumn("side", F.lit("found")).unionByName(missing.withColumn("side", F.lit("missing")))


@query("endpoint_list", f"""
WITH {B.ENDPOINTS} SELECT id, ip, port, username, source, secret IS NOT NULL AND secret <> '' AS has_secret
FROM endpoints WHERE is_active AND NOT is_valid""")
def endpoint_list(spark, sf):
    rows = S.list_endpoints(B.endpoints(spark, sf), active=True, valid=False)
    return rows.select("id", "ip", "port", "username", "source", "has_secret")


@query("available_endpoints", f"""
WITH {B.ENDPOINTS} SELECT id, source, port, fail_count FROM endpoints
WHERE {B.AVAILABLE} AND id NOT IN (SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING count(*) > 615)""")
def available_endpoints(spark, sf):
    busy = load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).count().filter("count > 615")
    rows = resources.available(B.endpoints(spark, sf), base_port=59550, excluded=busy)
    return rows.select("id", "source", "port", "fail_count")


@query("due_sources", """
WITH s AS (SELECT s_suppkey AS id, s_acctbal > 0 AS is_active, CAST(86400 * (1 + s_nationkey) AS BIGINT) AS fetch_interval,
  CASE WHEN s_acctbal < 8000 THEN (SELECT max(o_orderdate) FROM orders) - to_hours(CAST(floor(abs(s_acctbal) / 10) AS INTEGER)) END AS last_fetch_at
  FROM supplier)
SELECT id, last_fetch_at FROM s WHERE is_active
  AND (last_fetch_at IS NULL OR date_diff('second', last_fetch_at, (SELECT max(o_orderdate) FROM orders)) >= fetch_interval)""")
def due_sources(spark, sf):
    now = B.latest_order(spark, sf)
    back = F.make_dt_interval(hours=F.floor(F.abs("s_acctbal") / 10).cast("int"))
    sources = load(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), (F.col("s_acctbal") > 0).alias("is_active"),
        (F.lit(86400) * (1 + F.col("s_nationkey"))).cast("long").alias("fetch_interval"),
        F.when(F.col("s_acctbal") < 8000, now - back).alias("last_fetch_at"),
    )
    return S.due_sources(sources, now).select("id", "last_fetch_at")


@query("export_nested", f"""
WITH {B.CHILDREN}, k AS (
  SELECT journal_id, count(*) AS n_children, string_agg(comment_id || '@' || strftime(comment_time, '%Y-%m-%d %H:%M'), ',' ORDER BY comment_id) AS listed
  FROM children WHERE submit_experience = 'F' GROUP BY journal_id)
SELECT c_custkey AS journal_id, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, coalesce(listed, '') AS listed
FROM customer LEFT JOIN k ON journal_id = c_custkey""")
def export_nested(spark, sf):
    kids = B.children(spark, sf).filter("submit_experience = 'F'")
    rows = sinks.nest_children(B.entities(spark, sf).select("journal_id"), kids)
    # one part each here: no customer has 10 000 children
    items = F.from_json("children", "array<struct<comment_id: string, comment_time: string>>")
    listed = F.array_join(F.transform(items, lambda i: F.concat(i["comment_id"], F.lit("@"), i["comment_time"])), ",")
    return rows.select("journal_id", "n_children", F.coalesce(listed, F.lit("")).alias("listed"))


@query("export_entities", """
SELECT p_partkey AS "\ufeffID", p_name AS "名称", p_retailprice AS "影响因子" FROM part""")
def export_entities(spark, sf):
    header = {"p_partkey": "ID", "p_name": "名称", "p_retailprice": "影响因子"}
    return sinks.export_rows(load(spark, sf, "part"), header)


@query("export_json", """
SELECT p_partkey, p_name, CASE WHEN p_size > 25 THEN p_retailprice END AS p_retailprice FROM part""")
def export_json(spark, sf):
    """Written and read back; nulls are written."""
    rows = load(spark, sf, "part").select("p_partkey", "p_name", F.when(F.col("p_size") > 25, F.col("p_retailprice")).alias("p_retailprice"))
    folder = work_folder(spark, "json")
    sinks.export_json(rows, folder)
    return spark.read.schema(rows.schema).json(folder)


@query("export_endpoint_files", f"""
WITH {B.ENDPOINTS} SELECT ip || ':' || port || CASE WHEN username <> '' AND secret <> '' THEN ':' || username || ':' || secret ELSE '' END AS value
FROM endpoints WHERE is_active""")
def export_endpoint_files(spark, sf):
    """Written and read back."""
    folder = work_folder(spark, "endpoints")
    sinks.export_endpoints(B.endpoints(spark, sf), folder)
    return spark.read.text(folder)


@query("export_children", f"""
WITH {B.CHILDREN} SELECT comment_id, journal_id, content, author, rating, submit_experience,
  strftime(comment_time, '%Y-%m-%d %H:%M') AS comment_time, strftime(crawled_at, '%Y-%m-%d %H:%M') AS crawled_at FROM children""")
def export_children(spark, sf):
    return sinks.child_rows(B.children(spark, sf))


@query("export_endpoints", f"""
WITH {B.ENDPOINTS} SELECT id, 'url' AS fmt, 'http://' || CASE WHEN username <> '' AND secret <> '' THEN username || ':' || secret || '@' ELSE '' END || ip || ':' || port AS line
FROM endpoints WHERE is_active AND is_valid
UNION ALL SELECT id, 'hostport_auth', ip || ':' || port || CASE WHEN username <> '' AND secret <> '' THEN ':' || username || ':' || secret ELSE '' END
FROM endpoints WHERE is_active""")
def export_endpoints(spark, sf):
    pool = B.endpoints(spark, sf)
    urls = sinks.endpoint_lines(pool, "url", only_valid=True).withColumn("fmt", F.lit("url"))
    return urls.unionByName(sinks.endpoint_lines(pool).withColumn("fmt", F.lit("hostport_auth")))
