import datetime as dt
import json
import uuid

import pytest

from harvestry.functions.documents import canonical_fields
from harvestry.functions.markup import attribute, plain_text
from harvestry.functions.text import compact_text, field_label, lenient_int
from harvestry.operators import extract as E
from harvestry.operators import records
from harvestry.operators.records import kv_records
from harvestry.sources.payloads import api_items, payload_rejects
from pyspark.sql import functions as F


def pages(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls, 1)), "page_id long, html string")


def values(spark, column, *texts):
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r.v for r in frame.select(column.alias("v")).collect()]


def test_attributes_in_any_spelling(spark):
    got = values(spark, attribute(F.col("t"), "href"), ' href="a&amp;b"', " HREF = 'x y' id=1", " data-href=no href=z>", " title='href=1'", "", ' href=""')
    assert got == ["a&b", "x y", "z", None, None, ""]


def test_blanks_are_those_of_unicode(spark):
    odd = "　  two　 words： "
    assert values(spark, plain_text(F.col("t")), f"<p>{odd}&nbsp;</p><!-- <b>no</b> -->") == ["two words："]
    assert values(spark, field_label("t"), odd, None) == ["two_words", None]
    assert values(spark, compact_text("t"), odd, "　") == ["two　 words：", None]


@pytest.mark.parametrize("kind, value, want", [
    ("double", 5.0, 5), ("double", 5.9, 5), ("double", 1.5e7, 15_000_000), ("double", float("nan"), 0), ("long", 7, 7), ("string", "8", 8),
    ("string", "　9 ", 9), ("string", "5.0", 0), ("string", "", 0), ("string", None, 0), ("string", "x", 0)])
def test_lenient_whole_numbers(spark, kind, value, want):
    frame = spark.createDataFrame([(value,)], f"n {kind}")
    assert frame.select(lenient_int("n")).first()[0] == want
    if kind == "double" and value == value:
        assert frame.select(lenient_int(F.col("n").cast("decimal(12,2)"))).first()[0] == want


RECORD = """<body><table><tr><td>menu</td></tr></table><article id=main>
<table border=1><tbody><tr><td>A</td><td>first</td></tr><tr><td>B</td><td>second</td></tr><tr><td>&nbsp;</td><td>lost</td></tr></tbody></table>
<TABLE><TR><TH>caption</TH></TR>
<TR><TD>A：</TD><TD>plain <em>text</em>&nbsp;here<style>td{}</style></TD></TR>
<TR><TD>B  b</TD><TD><button>only</button> <a href="/x">links</a></TD><TD>third</TD></TR>
<TR><TD>both</TD><TD>seen <span onclick="f()">not</span></TD></TR>
<TR><TD>wide</TD><TD><table><tr><td>x</td><td></td><td>z</td></tr><tr><td>1</td><td>2</td><td>3</td><td>4</td></tr><tr></tr></table></TD></TR>
<TR><TD>pairs</TD><TD>see<table><tr><td>head</td></tr><tr><td>k :</td><td><table><tr><td>in</td><td>ner</td></tr></table></td></tr><tr><td>tail "q"</td></tr></table>
<table><tr><th>n</th></tr><tr><td>5</td></tr></table></TD></TR>
<TR><TD>empty</TD><TD> </TD></TR><TR><TD>A</TD><TD>again</TD></TR><TR><TD>option</TD><TD>o</TD></TR>
</TABLE></article>"""


def test_records_of_a_main_table(spark):
    rows = kv_records(pages(spark, RECORD, "<p>A B</p>", None, RECORD), required=("A", "B"), optional=("option",), scope_id="main").collect()
    by_id = {r.page_id: r for r in rows}
    doc = json.loads(by_id[1].doc)
    assert doc == {
        "B_b": "only links", "both": "seen", "A": "again", "option": "o",
        "wide": {"text": "", "tables": [[{"x": "1", "col_1": "2", "z": "3", "col_3": "4"}]]},
        "pairs": {"text": "see", "tables": [{"_title": "head", "k": {"in": "ner"}, "_row_2": 'tail "q"'}, [{"n": "5"}]]},
    }
    assert by_id[1].n_fields == 6 and json.loads(by_id[1].fields["wide"]) == doc["wide"] and by_id[1].fields["A"] == "again"
    assert (by_id[2].n_fields, by_id[2].doc, by_id[2].fields) == (0, "{}", {}) and by_id[3].n_fields == 0
    assert by_id[4].doc == by_id[1].doc and len(rows) == 4


def test_the_table_with_more_markers_wins(spark):
    few = "<table>" + "<tr><td>A</td><td>B</td></tr>" * 9 + "</table>"
    many = "<table><tr><td>A</td><td>right</td></tr><tr><td>B</td><td>opt</td></tr></table>"
    row = kv_records(pages(spark, few + many + many.replace("right", "late")), required=("A", "B"), optional=("opt",), scope_id="none").first()
    assert dict(row.fields) == {"A": "right", "B": "opt"}


def test_records_at_any_depth(spark):
    inner, want = "<table><tr><td>k</td><td>last</td></tr></table>", {"k": "last"}
    for i in range(5):
        inner, want = f"<table><tr><td>k{i}</td><td>{inner}</td></tr></table>", {f"k{i}": want}
    main = f"<table><tr><td>A</td><td>a</td></tr><tr><td>B</td><td>b</td></tr><tr><td>deep</td><td>{inner}</td></tr></table>"
    page = "<table><tr><td>" * 5 + main + "</td></tr></table>" * 5
    row = kv_records(pages(spark, page), required=("A", "B"), optional=(), scope_id="none").first()
    assert json.loads(row.doc) == {"A": "a", "B": "b", "deep": {"text": "", "tables": [want]}} and row.n_fields == 3


def test_elements_are_intervals(spark):
    def one(html, **kw):
        return json.loads(kv_records(pages(spark, html), **({"required": ("A", "B"), "optional": ("opt",), "scope_id": "s"} | kw)).first().doc)

    rows = "<tr><td>A</td><td>{}</td></tr><tr><td>B</td><td>b</td></tr>"
    table = "<table>" + rows + "</table>"
    # a hidden element ends with its own end tag; void elements and stray ends open and close nothing
    assert one(table.format('x<div style="display:none">h1<div>h2</div>h3<br></div>y</i>')) == {"A": "x y", "B": "b"}
    assert one(table.format('<p style="visibility: hidden">no</p>z')) == {"A": "z", "B": "b"}
    # a richer table behind the scope doesn't count; without the scope it does
    rich = "<table>" + "<tr><td>A</td><td>far</td></tr>" * 3 + "<tr><td>B</td><td>opt</td></tr></table>"
    assert one(f"<div id=s><div></div>{table.format('near')}</div>{rich}") == {"A": "near", "B": "b"}
    assert one(f"<div><div></div>{table.format('near')}</div>{rich}") == {"A": "far", "B": "opt"}
    # quoted attributes and comments hold what they like; a lone bracket is text
    assert one("<TABLE class='>'>" + rows.format("""<b title="a>b" data-x='</td>'>t</b><!-- <td>no</td> > -->1 < 2""") + "</TABLE>") == {"A": "t 1 < 2", "B": "b"}
    # only tables that stand directly in the cell are its values; the text of others is no text of the cell
    assert one(table.format("<div><table><tr><td>k</td><td>v</td></tr></table></div>seen")) == {"A": "seen", "B": "b"}
    assert one(table.format("<div></div><table><tr><td>k</td><td>v</td></tr></table>")) == {"A": {"text": "", "tables": [{"k": "v"}]}, "B": "b"}
    # what is clickable ends with its own element
    assert one(table.format("<span onclick='f()'>no <span>no</span> no</span>yes")) == {"A": "yes", "B": "b"}
    assert one("<a href=/x>" + table.format("in a link") + "</a>") == {"A": "in a link", "B": "b"}
    # cells and rows without end tags
    assert one("<table><tr><td>A<td>a<tr><td>B<td>b</table>") == {"A": "a", "B": "b"}


def test_more_pages_are_dealt_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(records, "TASK_PAGES", 2)
    table = "<table><tr><td>A</td><td>%d</td></tr><tr><td>B</td><td>b<table><tr><td>k</td><td>v</td></tr></table></td></tr></table>"
    made = kv_records(pages(spark, *(table % i for i in range(1, 23))), required=("A", "B"), optional=(), scope_id="none")
    assert "REPARTITION_BY_NUM" in (plan := made._jdf.queryExecution().executedPlan().toString()) and ", 11), REPARTITION_BY_NUM" in plan
    assert {r.page_id: r.fields["A"] for r in made.collect()} == {i: str(i) for i in range(1, 23)}


def test_canonical_names_of_a_record(spark):
    html = "<table><tr><td>期刊名字</td><td>N</td></tr><tr><td>期刊ISSN</td><td>0000-0001</td></tr><tr><td>最新影响因子</td><td>up to 7.25!</td></tr></table>"
    fields = kv_records(pages(spark, html)).select(canonical_fields("fields").alias("f")).first().f
    assert fields["issn"] == "0000-0001" and fields["impact_factor"] == "7.25"


def fragment(floor="#12楼", quote="told", extra=""):
    return (f"<article><blockquote class=\"layui-elem-quote grey\">投稿经验：{quote}</blockquote><span>{floor}</span>"
            f"<aside><div>期刊评分：</div> <div>x</div>\n<div>&nbsp;5 / <b>5</b></div></aside>{extra}</article>")


def test_child_fragments(spark):
    full = fragment(quote="slow&nbsp;but &lt;fair&gt;<p>其他用户回复：no</p>", extra=(
        "<A TITLE='去查看Ta的个人主页 (2)' href=#>　Li <i>W</i></A><dl><dd><strong>研究方向</strong>：<em>Optics</em> &amp; more</dd>"
        "<dd><strong>投稿周期</strong>: 3 months</dd></dl><strong>最后更新</strong>：2020-7-9 8:05:00<strong>发表时间</strong>：soon"))
    bodies = [(4, json.dumps({"code": 0, "count": "31", "data": [{"content": c} for c in (full, "", None, fragment("no floor"), "<i> &nbsp;</i>")]})),
              (5, json.dumps({"code": 7, "data": []})), (6, "{broken"), (7, None)]
    payloads = spark.createDataFrame(bodies, "journal_id long, body string")
    items = api_items(payloads)
    rows = {r.position_no: r for r in E.child_fragments(items).collect()}
    assert set(rows) == {1, 4}
    r = rows[1]
    assert (r.floor, r.author, r.rating, r.content) == ("#12楼", "Li W", "5 / 5", "slow but <fair>")
    assert (r.research_fields, r.submission_period, r.submission_result) == ("研究方向 ： Optics & more", "投稿周期 : 3 months", None)
    assert (r.publish_time, r.update_time, r.comment_time) == (None, dt.datetime(2020, 7, 9, 8, 5), dt.datetime(2020, 7, 9, 8, 5))
    assert r.comment_id == str(uuid.uuid5(uuid.NAMESPACE_DNS, "4_#12楼_Li W"))
    assert (rows[4].floor, rows[4].author) == (None, "匿名")
    assert [(x.position_no, x.reason) for x in E.fragment_rejects(items).orderBy("position_no").collect()] == [(2, "no text"), (3, "no content"), (5, "no text")]
    assert [(x.journal_id, x.code, x.reason) for x in payload_rejects(payloads).orderBy("journal_id").collect()] == [
        (5, 7, "refused"), (6, None, "not a payload"), (7, None, "not a payload")]


def test_groups(spark):
    html = """<nav><A HREF='/f?fieldtag=8&amp;o=1'>Maths</A>&nbsp;<b>（40）</b></nav><p>(9)</p><a href="/f?fieldtag=x">none (1)</a>
    <li><a href=/f?fieldtag=9>Arts <i>(3)</i></a></li><li><a href="?fieldtag=8">Maths again (1)</a></li><a href="?fieldtag=11"> </a><a>no</a>"""
    got = {tuple(r) for r in E.group_links(pages(spark, html, None)).collect()}
    assert got == {("8", "Maths", 40), ("9", "Arts", 3)}


def test_listing_and_page_count(spark):
    html = """<table><thead><TR><TH>t</TH></TR></thead><tr><td><a href="/j?journalid=">x</a><A HREF='/j?journalid=31'>Thirty<br>one</A><a href="/j?journalid=32">no</a>
    <tr><td><a href="/other">o</a></tr><tr><td><a href=/j?journalid=40>Forty</a></td></tr></table><i>共&#160;<u>1</u>7 页</i><a href='?currentpage=99'>99</a>"""
    odd = "<a rel=next href='?a=1&amp;currentpage=4'>4</a> currentpage=70"
    got = [(r.page_id, r.journal_id, r.name, r.position_no) for r in E.listing_rows(pages(spark, html, odd)).orderBy("position_no").collect()]
    assert got == [(1, 31, "Thirtyone", 1), (1, 40, "Forty", 2)]
    counts = {r.page_id: r.total_pages for r in E.page_count(pages(spark, html, odd, None, "")).collect()}
    assert counts == {1: 17, 2: 4, 3: 1, 4: 1}
    links = [(r.position_no, r.href) for r in E.flat_links(pages(spark, odd + "<A\nHREF=q>")).collect()]
    assert links == [(1, "?a=1&currentpage=4"), (2, "q")]


def test_extraction_runs_in_the_jvm(spark):
    frame = pages(spark, RECORD)
    for made in (E.group_links(frame), E.listing_rows(frame), E.page_count(frame), E.flat_links(frame), kv_records(frame),
                 E.child_fragments(frame.select(F.col("page_id").alias("journal_id"), F.col("html").alias("content")))):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
