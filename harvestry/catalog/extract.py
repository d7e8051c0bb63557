"""Extraction over the stored pages, and over pages rendered from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestry.catalog.registry import query
from harvestry.functions.documents import canonical_fields
from harvestry.operators import extract as X
from harvestry.operators.records import kv_records as kv
from harvestry.sources.payloads import api_items, payload_pages, payload_rejects
from harvestry.sources.tables import load, pages


@query("page_links", r"""
SELECT page_id, CAST(i AS BIGINT) AS position_no, replace(hrefs[i], '&amp;', '&') AS href FROM (
  SELECT page_id, hrefs, unnest(range(1, len(hrefs) + 1)) AS i FROM (
    SELECT page_id, regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1) AS hrefs FROM pages))""")
def page_links(spark, sf):
    """The stored pages, every third one with its links written in another way."""
    stored = pages(spark, sf).select("page_id", "html")
    other = F.regexp_replace("html", r'<a(\s[^>]*?)href="([^"\']*)"', "<A$1rel=next HREF = '$2'")
    return X.flat_links(stored.withColumn("html", F.when(F.col("page_id") % 3 == 0, other).otherwise(F.col("html"))))


def listing_pages(spark, sf):
    """Suppliers' and customers' ids in tens as listing pages: a list of rows, some without a usable link, then the pager."""
    named = F.format_string(
        "<TR data-n='%d'><TD class=no>no.&nbsp;%d<TD><A class=\"t\" HREF='/show?lang=zh&amp;journalid=%d&amp;tab=1'><i>%s</i>&nbsp;</A></TR>",
        F.col("c_custkey") % 10, F.col("c_custkey") % 7, F.col("c_custkey"), F.col("c_name"))
    empty = F.lit('<tr><td colspan=2><a href="/show?journalid=77">&nbsp; </a><a href="/help">help</a></td></tr>')
    cell = F.when(F.col("c_custkey") % 5 == 0, F.concat(empty, named)).otherwise(named)
    # ten rows per page by construction
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", cell.alias("h")))), lambda r: r["h"]), "")
    body = load(spark, sf, "customer").groupBy(F.floor(F.col("c_custkey") / 10).alias("page_id")).agg(rows.alias("rows"))
    stated = F.concat(F.lit("<em>共&nbsp;<span>"), "page_id", F.lit("</span>\u3000页</em>"))
    numbered = F.concat(F.lit("<a href='?x=1&amp;currentpage="), "page_id", F.lit("'>last</a><A HREF=?currentpage=2>2</A>"))
    more = F.when(F.col("page_id") % 2 == 0, stated).otherwise(numbered)
    return body.select("page_id", F.concat(F.lit("<main><table class=l>"), "rows", F.lit("</table><nav>"), more, F.lit("</nav></main>")).alias("html"))


@query("listing_rows", """
SELECT c_custkey // 10 AS page_id, c_custkey AS journal_id, c_name AS name,
  row_number() OVER (PARTITION BY c_custkey // 10 ORDER BY c_custkey) AS position_no FROM customer""")
def listing_rows(spark, sf):
    return X.listing_rows(listing_pages(spark, sf))


@query("page_count", """
SELECT p AS page_id, CASE WHEN p % 2 = 0 THEN p ELSE greatest(p, 2) END AS total_pages FROM (SELECT DISTINCT c_custkey // 10 AS p FROM customer)""")
def page_count(spark, sf):
    return X.page_count(listing_pages(spark, sf)).select("page_id", "total_pages")


@query("group_links", """
SELECT CAST(n_nationkey AS VARCHAR) AS field_tag, n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS total_count FROM nation""")
def group_links(spark, sf):
    """Nations as entry pages: the count stands in the link, behind it or in a tag of its own; a later link repeats the tag."""
    totals = load(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    nation = load(spark, sf, "nation").join(totals, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    key, name, n = F.col("n_nationkey"), F.col("n_name"), F.coalesce("n", F.lit(0))
    link = (
        F.when(key % 3 == 0, F.format_string("<dd><A HREF='/g?s=0&amp;fieldtag=%d'>%s (%d)</A></dd>", key, name, n))
        .when(key % 3 == 1, F.format_string('<dd><a class="g" href="/g?fieldtag=%d"><b>%s</b></a>&nbsp;（%d）</dd>', key, name, n))
        .otherwise(F.format_string("<dd><a href=/g?fieldtag=%d >%s</a><small>(%d)</small></dd>", key, name, n)))
    html = F.concat(
        F.lit('<dl><dt>groups (999)</dt><dd><a href="/g?fieldtag=any">any</a> (5)</dd>'), link,
        F.format_string('<dd><a href="/g?fieldtag=%d">once more</a> (1)</dd></dl>', key))
    return X.group_links(nation.select(F.col("n_nationkey").alias("page_id"), html.alias("html")))


def detail_pages(spark, sf):
    """Customers as detail pages; those with a debt have no record."""
    html = F.format_string("""<section><table class="ad"><tr><td>期刊名字</td></tr></table></section>
<section ID='yxyz_content' class="body"><table><tbody>
<tr><th colspan=2>记录</th></tr>
<tr><td>出版商\u3000：</td><td><button>%s</button></td></tr>
<tr><td>期刊ISSN</td><td title="a>b"><!-- <td>1</td> -->%08d&nbsp;<div style="color:red; display : none">(old)<div>er</div>st</div></td></tr>
<tr><td>JCR</td><td>by year<table><tr><td>year</td><td>2024</td></tr><tr><td>group:</td><td>%s</td></tr></table><div><table><tr><td>not</td><td>direct</td></tr></table></div></td><td>more</td></tr>
<tr><td>2025最新IF</td><td>IF&nbsp;%.2f</td></tr>
<tr><td>期刊名字 :</td><td>%s<script>var t = "<td>";</script></td></tr><tr><td>note</td></tr>
</tbody></table></section><table><tr><td>期刊名字</td><td>期刊ISSN 基本信息 出版商 出版国家 JCR</td></tr><tr><td>behind</td><td>the scope</td></tr></table>""",
        "c_mktsegment", "c_custkey", "c_nationkey", F.abs("c_acctbal"), "c_name")
    plain = F.concat(F.lit("<table><tr><td>期刊名字</td><td>"), "c_name", F.lit("</td></tr></table>"))
    return load(spark, sf, "customer").select(
        F.col("c_custkey").alias("page_id"), F.when(F.col("c_acctbal") < 0, plain).otherwise(html).alias("html"))


@query("kv_records", """
SELECT c_custkey AS page_id, CASE WHEN c_acctbal < 0 THEN 0 ELSE 5 END AS n_fields,
  CASE WHEN c_acctbal >= 0 THEN c_name END AS name, CASE WHEN c_acctbal >= 0 THEN lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS issn,
  CASE WHEN c_acctbal >= 0 THEN round(c_acctbal, 2) END AS impact_factor, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS publisher,
  CASE WHEN c_acctbal >= 0 THEN '[{"year": "2024", "group": "' || c_nationkey || '"}]' END AS tables
FROM customer""")
def kv_records(spark, sf):
    rows = kv(detail_pages(spark, sf)).withColumn("c", canonical_fields("fields"))
    tables = F.regexp_extract(F.col("c")["JCR"], r'"tables": (.*)\}$', 1)
    return rows.select(
        "page_id", F.col("n_fields").cast("int").alias("n_fields"), F.col("c")["期刊名字"].alias("name"),
        F.col("c")["issn"].alias("issn"), F.col("c")["impact_factor"].cast("double").alias("impact_factor"),
        F.col("c")["publisher"].alias("publisher"), tables.alias("tables"))


def payloads(spark, sf):
    """Orders in tens as API payload pages of HTML fragments; odd hundreds are error pages, every eleventh item is blank."""
    fragment = F.format_string(
        "<section class=c><DIV>期刊评分\u3000</DIV>\n<div></div><div class='s'>&nbsp;%s</div><blockquote CLASS='q layui-elem-quote'>投稿经验：paid&nbsp;%.2f"
        "<br>其他用户回复：thanks</blockquote><footer><a class='me' title='去查看Ta的个人主页' href='/u'>clerk <b>%d</b></a> <span>at</span><span class=f> #%d楼 </span>"
        "<ul><li><strong>发表时间</strong>：\u3000%s 10:00:00</li><li><strong>投稿结果</strong>：%s</li></ul></footer></section>",
        "o_orderpriority", "o_totalprice", F.month("o_orderdate"), F.col("o_orderkey") % 10,
        F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderstatus")
    fragment = F.when(F.col("o_orderkey") % 11 == 0, "<p>&nbsp;</p>").otherwise(fragment)
    # ten fragments per payload by construction
    items = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", fragment.alias("f")))), lambda r: F.struct(r["f"].alias("content")))
    page = F.floor(F.col("o_orderkey") / 10).alias("journal_id")
    body = load(spark, sf, "orders").groupBy(page).agg(items.alias("data"))
    code = F.when(F.floor(F.col("journal_id") / 100) % 2 == 0, 0).otherwise(1)
    whole = F.to_json(F.struct(code.alias("code"), (F.size("data") + 10).cast("string").alias("count"), F.lit(0).alias("pages"), "data"))
    return body.select("journal_id", F.when(F.col("journal_id") % 100 == 1, F.concat(F.lit("{"), whole)).otherwise(whole).alias("body"))


_GOOD_PAGE = "(o_orderkey // 1000) % 2 = 0 AND (o_orderkey // 10) % 100 <> 1"


@query("payload_pages", f"""
SELECT o_orderkey // 10 AS journal_id, count(*) + 10 AS total_count, CAST(ceil((count(*) + 10) / 10) AS BIGINT) AS total_pages, false AS has_overlay
FROM orders WHERE {_GOOD_PAGE} GROUP BY 1""")
def read_payload_pages(spark, sf):
    return payload_pages(payloads(spark, sf)).select("journal_id", "total_count", "total_pages", "has_overlay")


@query("payload_rejects", f"""
SELECT o_orderkey // 10 AS journal_id, CASE WHEN (o_orderkey // 10) % 100 = 1 THEN NULL ELSE CAST(1 AS BIGINT) END AS code,
  CASE WHEN (o_orderkey // 10) % 100 = 1 THEN 'not a payload' ELSE 'refused' END AS reason
FROM orders WHERE NOT ({_GOOD_PAGE}) GROUP BY 1""")
def read_payload_rejects(spark, sf):
    return payload_rejects(payloads(spark, sf)).select("journal_id", "code", "reason")


_UUID = """(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
  substr('89ab', ((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12))"""


@query("child_fragments", f"""
WITH f AS (SELECT o_orderkey // 10 AS journal_id, o_orderkey, o_orderkey % 10 + 1 AS position_no, '#' || (o_orderkey % 10) || '楼' AS floor,
    'clerk ' || month(o_orderdate) AS author, o_orderpriority AS rating, '投稿结果 ：' || o_orderstatus AS submission_result,
    'paid ' || printf('%.2f', o_totalprice) AS content, o_orderdate + INTERVAL 10 HOUR AS comment_time FROM orders WHERE {_GOOD_PAGE} AND o_orderkey % 11 <> 0),
d AS (SELECT *, sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(journal_id || '_' || floor || '_' || author)) AS h FROM f)
SELECT journal_id, position_no, floor, author, rating, submission_result, content, comment_time, {_UUID} AS comment_id FROM d""")
def child_fragments(spark, sf):
    rows = X.child_fragments(api_items(payloads(spark, sf)))
    return rows.select("journal_id", "position_no", "floor", "author", "rating", "submission_result", "content",
                       "comment_time", "comment_id")


@query("fragment_rejects", f"""
SELECT o_orderkey // 10 AS journal_id, o_orderkey % 10 + 1 AS position_no, 'no text' AS reason FROM orders WHERE {_GOOD_PAGE} AND o_orderkey % 11 = 0""")
def fragment_rejects(spark, sf):
    return X.fragment_rejects(api_items(payloads(spark, sf))).select("journal_id", "position_no", "reason")
