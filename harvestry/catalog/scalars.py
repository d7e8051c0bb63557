"""Scalar and document functions over columns derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestry.catalog import bindings as B
from harvestry.catalog.registry import query
from harvestry.functions import documents as D
from harvestry.functions import text as X
from harvestry.functions.names import name_key
from harvestry.sources.tables import load


@query("numbers_in_text", """
SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS in_text,
  CASE WHEN o_orderstatus = 'F' THEN NULL ELSE floor(o_totalprice) END AS cleaned,
  CASE WHEN o_totalprice > 100000 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS lenient,
  CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS first_digits
FROM orders""")
def numbers_in_text(spark, sf):
    price = F.col("o_totalprice")
    rows = load(spark, sf, "orders")
    text = F.when(price > 100000, F.concat(F.lit("IF "), price.cast("decimal(12,2)"), F.lit(" (2025)"))).otherwise(
        F.concat(F.floor(price), F.lit(" points")))
    mark = F.when(F.col("o_orderstatus") == "F", F.lit(" -- ")).otherwise(F.concat(F.lit("about "), F.floor(price), F.lit("%")))
    whole = F.when(price > 100000, F.lit("n/a")).otherwise(F.floor(price).cast("string"))
    return rows.select(
        "o_orderkey", X.decimal_in_text(text).alias("in_text"), X.clean_number(mark).alias("cleaned"),
        X.lenient_int(whole).alias("lenient"), X.first_integer("o_orderpriority").alias("first_digits"))


@query("labels_and_times", """
SELECT o_orderkey, replace(o_orderpriority, ' ', '_') AS label,
  CASE WHEN o_orderstatus <> 'F' THEN o_orderdate + INTERVAL 90 MINUTE END AS told_at FROM orders""")
def labels_and_times(spark, sf):
    text = F.when(F.col("o_orderstatus") != "F", F.date_format("o_orderdate", "： yyyy-MM-dd 01:30:00 ")).otherwise(
        F.date_format("o_orderdate", "：yyyy/MM/dd"))
    label = F.concat(F.lit("  "), "o_orderpriority", F.lit(" ：: "))
    return load(spark, sf, "orders").select(
        "o_orderkey", X.field_label(label).alias("label"), X.time_after_label(text).alias("told_at"))


@query("page_math", """
SELECT l_orderkey, n, CAST(ceil(n / 10) AS BIGINT) AS total_pages, CASE WHEN n % 10 = 0 THEN 10 ELSE n % 10 END AS last_page_count
FROM (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1)""")
def page_math(spark, sf):
    rows = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("n"))
    return rows.select("l_orderkey", "n", X.page_math("n")["total_pages"].alias("total_pages"),
                       X.page_math("n")["last_page_count"].alias("last_page_count"))


@query("metric_text", """
SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(10, 4)) AS VARCHAR) AS score, CAST(o_custkey AS VARCHAR) AS plain FROM orders""")
def metric_text(spark, sf):
    return load(spark, sf, "orders").select(
        "o_orderkey", X.metric_text("o_totalprice", decimal=True).alias("score"), X.metric_text("o_custkey").alias("plain"))


@query("canonical_records", """
SELECT doc_id, sha256('{"lang": "' || lang || '", "n_chars": "' || n_chars || '", "source": null, "text": ' || CAST(to_json(text) AS VARCHAR) || '}') AS record_hash FROM documents""")
def canonical_records(spark, sf):
    record = D.canonical_json({
        "text": F.col("text"), "lang": F.col("lang"), "source": F.lit(None), "n_chars": F.col("n_chars")})
    return load(spark, sf, "documents").select("doc_id", D.record_hash(record).alias("record_hash"))


@query("name_keys", """
SELECT doc_id, regexp_replace(lower(source || ' ' || lang), '[^a-z0-9]', '', 'g') AS source_key,
  lower(replace(replace(source, 's', 'S'), '-', '')) AS wide_key FROM documents""")
def name_keys(spark, sf):
    rows = load(spark, sf, "documents")
    plain = F.concat_ws(" ", "source", "lang")
    # full-width letters fold to the plain ones
    wide = F.translate("source", "src", "ＳＲＣ")
    return rows.select("doc_id", name_key(plain, ascii_only=True).alias("source_key"), name_key(wide).alias("wide_key"))


@query("summary_texts", """
SELECT event_id, 'k: ' || json_extract_string(props, '$.k') AS summary,
  'kind: ' || event_type || ' / tags: ' || user_id || ' / name: ' || event_type AS nested FROM events""")
def summary_texts(spark, sf):
    nested = F.to_json(F.struct(
        F.col("event_type").alias("kind"),
        F.array(F.col("user_id").cast("string"), F.to_json(F.struct(F.col("event_type").alias("name")))).alias("tags")))
    # make the list item an object instead of text
    nested = F.regexp_replace(F.regexp_replace(nested, r'"\{\\"', '{"'), r'\\"', '"')
    nested = F.regexp_replace(nested, r'\}"\]', "}]")
    return load(spark, sf, "events").select(
        "event_id", D.summary_text("props").alias("summary"), D.summary_text(nested).alias("nested"))


@query("parsed_values", """
SELECT event_id, CASE WHEN event_type = 'click' THEN props WHEN event_type = 'view' THEN '[' || user_id || ']' END AS as_json,
  CASE WHEN event_type = 'error' THEN '{' || user_id WHEN event_type = 'signup' THEN event_type END AS as_text FROM events""")
def parsed_values(spark, sf):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    raw = (
        F.when(kind == "click", F.col("props")).when(kind == "view", F.concat(F.lit(" ["), user, F.lit("] ")))
        .when(kind == "error", F.concat(F.lit("{"), user)).when(kind == "signup", kind).otherwise(F.lit("  "))
    )
    parsed = load(spark, sf, "events").select("event_id", D.parse_maybe_json(raw).alias("p"))
    return parsed.select("event_id", F.col("p.json").alias("as_json"), F.col("p.text").alias("as_text"))


@query("joined_parts", """
SELECT o_orderkey, CASE WHEN o_orderstatus = o_clip THEN o_orderstatus ELSE o_orderstatus || ' / ' || o_clip END AS joined FROM (
  SELECT o_orderkey, o_orderstatus, CASE WHEN o_totalprice > 300000 THEN o_orderstatus ELSE repeat('x', 20) || '...' END AS o_clip FROM orders)""")
def joined_parts(spark, sf):
    clip = F.when(F.col("o_totalprice") > 300000, F.col("o_orderstatus")).otherwise(F.repeat(F.lit("x"), F.lit(20)))
    long = F.when(F.col("o_totalprice") > 300000, clip).otherwise(F.concat(clip, F.lit("...")))
    return load(spark, sf, "orders").select(
        "o_orderkey", X.join_distinct([F.col("o_orderstatus"), F.lit(" "), long, F.lit(None).cast("string")]).alias("joined"))


@query("clipped_texts", """
SELECT doc_id, CASE WHEN t = '' THEN NULL WHEN length(t) > 90 THEN substr(t, 1, 90) || '...' ELSE t END AS clipped
FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents)""")
def clipped_texts(spark, sf):
    return load(spark, sf, "documents").select("doc_id", X.compact_text("text").alias("clipped"))


@query("canonical_fields", """
SELECT o_orderkey, o_orderpriority AS issn, o_orderstatus AS eissn, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS impact_factor,
  o_orderstatus AS publisher FROM orders""")
def canonical_fields(spark, sf):
    price = F.col("o_totalprice")
    score = F.when(price > 100000, F.concat(F.lit("IF "), price.cast("decimal(12,2)"))).otherwise(F.lit("none"))
    labels = F.create_map(
        F.lit("2025最新IF"), score, F.lit("期刊ISSN"), F.col("o_orderpriority"), F.lit("E-ISSN"), F.col("o_orderstatus"),
        F.lit("出版商名称"), F.col("o_orderstatus"))
    rows = load(spark, sf, "orders").select("o_orderkey", D.canonical_fields(labels).alias("c"))
    return rows.select("o_orderkey", F.col("c")["issn"].alias("issn"), F.col("c")["eissn"].alias("eissn"),
                       F.col("c")["impact_factor"].cast("double").alias("impact_factor"), F.col("c")["publisher"].alias("publisher"))


@query("effective_ids", """
SELECT o_orderkey AS id, CASE WHEN o_totalprice < 50000 THEN o_custkey + 1 ELSE o_custkey END AS fetch_id FROM orders""")
def effective_ids(spark, sf):
    return B.work_items(spark, sf).select("id", D.effective_id("extra_data", "target_id").alias("fetch_id"))


@query("merged_documents", """
SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS kind, CAST(user_id AS VARCHAR) AS who, CAST(3 AS BIGINT) AS n_keys FROM events""")
def merged_documents(spark, sf):
    old = F.to_json(F.struct(F.lit("old").alias("kind"), F.col("user_id").alias("who")))
    new = F.concat(F.rtrim("props", F.lit("}")), F.lit(', "kind": "'), "event_type", F.lit('"}'))
    merged = load(spark, sf, "events").select("event_id", D.merge_docs(old, new).alias("d"))
    return merged.select("event_id", *[D.doc_field("d", f).alias(f) for f in ("k", "kind", "who")],
                         F.size(D.doc_keys("d")).cast("long").alias("n_keys"))


@query("uuids", """
SELECT o_orderkey, """ + """(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
  substr('89ab', ((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)) AS uuid
FROM (SELECT o_orderkey, sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(o_custkey || '_' || o_orderkey)) AS h FROM orders)""")
def uuids(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", X.uuid5(F.concat_ws("_", "o_custkey", "o_orderkey")).alias("uuid"))


@query("marked_documents", """
SELECT doc_id, contains(text, 'the') AS has_marker FROM documents""")
def marked_documents(spark, sf):
    doc = F.to_json(F.struct(F.array(F.struct(F.col("text").alias("the"))).alias("body"), F.col("lang").alias("note the")))
    return load(spark, sf, "documents").select("doc_id", D.has_marker(doc, ["the"]).alias("has_marker"))
