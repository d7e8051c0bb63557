"""Label/value records from the tables of detail pages, by intervals of elements.

A page becomes its tags and texts in order; quoted attributes and comments are single tokens. Each start tag is
paired with the end tag of its level among the tags of its name, which gives an interval per element. Running
sums over the starts and ends of hidden, clickable and all elements tell what stands around a token, so that
whether a text is hidden within its cell, clickable, or a table stands directly in its cell are comparisons of two sums.

All that is done in partitions of whole pages after one shuffle: texts are gathered per cell, cells per row, rows per table
and tables per page, and a fold over the tables of a page, the innermost first, puts them into their cells. None of the
groups grows with the number of pages.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestry import rules
from harvestry.functions.markup import inline_text, unescape
from harvestry.functions.text import field_label, let, squeeze

_UNSEEN = r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>"
_TOKEN = r"""(?s)</?[A-Za-z](?:"[^"]*+"|'[^']*+'|[^'">]++)*+>|<[^<>]*>|<|[^<]+"""
_ATTRIBUTES = r"""(?is)\s%s\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_CLICKABLE = r"""(?is)\s(?:href|onclick|onmousedown|onmouseup)\s*=\s*["']?[^\s"'>]"""
#: Elements without an end tag.
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: Pages whose tokens are sorted in one task, at most about.
TASK_PAGES = 4000


def _json(text: Column) -> Column:
    """A text as a JSON string."""
    return let(F.to_json(F.array(text)), lambda listed: F.substring(listed, F.lit(2), F.length(listed) - 2))


def _last(entries: Column) -> Column:
    """Of entries of equal names the last one."""

    def of(entries: Column) -> Column:
        names = F.transform(entries, lambda e: e["name"])
        return let(names, lambda names: F.filter(entries, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.greatest(F.size(names), F.lit(1))), e["name"])))

    return let(entries, of)


def _object(entries: Column) -> Column:
    """(name, value as JSON) entries as a JSON object; of equal names the last one counts."""
    return F.concat(F.lit("{"), F.array_join(F.transform(_last(entries), lambda e: F.concat(_json(e["name"]), F.lit(": "), e["value"])), ", "), F.lit("}"))


def _list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]"))


def _entry(name: Column, value: Column) -> Column:
    return F.struct(name.alias("name"), value.alias("value"))


def _attribute(token: Column, name: str) -> Column:
    """Value of an attribute in a start tag, NULL without it."""
    # most tags have none, and a plain search costs less than the pattern
    held = F.length(token) > len(name) + 3
    return F.when(held & F.contains(F.lower(token), F.lit(name)), F.concat(*(F.regexp_extract(token, _ATTRIBUTES % name, i) for i in (1, 2, 3))))


def _tokens(pages: DataFrame, key: list[str], html: str, scope_id: str) -> DataFrame:
    """Tags and texts of each page; the rows are sorted several times, so they hold numbers and flags, and only texts keep their characters."""
    text = F.regexp_replace(html, _UNSEEN, "")
    tokens = pages.select(*key, F.posexplode(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))).alias("pos", "token"))
    name = F.when(F.startswith(F.col("token"), F.lit("<")), F.lower(F.regexp_extract("token", r"^</?\s*([A-Za-z][\w:-]*)", 1))).otherwise("")
    ends = F.startswith(F.col("token"), F.lit("</"))
    tokens = tokens.withColumn("tag", name)
    tokens = tokens.withColumn("kind", F.when((F.col("tag") == "") | F.col("tag").isin(*_VOID), 0).when(ends, -1).otherwise(1))
    is_text = (F.col("kind") == 0) & (F.col("tag") == "") & (~F.startswith(F.col("token"), F.lit("<")) | (F.col("token") == "<"))
    # comments and elements without an end tag open, close and show nothing
    tokens = tokens.filter((F.col("kind") != 0) | is_text)
    starts = F.col("kind") == 1
    tokens = tokens.withColumn("style", F.when(starts, F.lower(F.replace(_attribute(F.col("token"), "style"), F.lit(" "), F.lit("")))))

    def styled(part: str) -> Column:
        return F.coalesce(F.contains("style", F.lit(part)), F.lit(False))

    return tokens.select(
        *key, "pos", "kind", F.when(F.col("kind") != 0, F.col("tag")).alias("named"),
        (styled("display:none") | styled("visibility:hidden")).alias("hidden"),
        F.when(starts, F.col("tag").isin("a", "button") | F.when(F.contains("token", F.lit("=")), F.col("token").rlike(_CLICKABLE)).otherwise(False) | styled("cursor:pointer")).otherwise(False).alias("clickable"),
        F.coalesce(starts & (_attribute(F.col("token"), "id") == scope_id), F.lit(False)).alias("scoped"), F.when(F.col("kind") == 0, F.col("token")).alias("text"))


def _intervals(tokens: DataFrame, key: list[str]) -> DataFrame:
    """Tokens with the end of each element and the sums of what is open around them."""
    starts = F.col("kind") == 1
    by_name = Window.partitionBy(*key, "named").orderBy("pos")
    tokens = tokens.withColumn("level", F.sum("kind").over(by_name.rowsBetween(Window.unboundedPreceding, 0)) + (F.col("kind") == -1).cast("int"))
    # at one level of one name starts and ends alternate, but for tags that were never closed
    pair = Window.partitionBy(*key, "named", "level").orderBy("pos")
    after, before = F.lead(F.struct("pos", "kind")).over(pair), F.lag(F.struct("kind", "hidden", "clickable")).over(pair)
    tokens = tokens.withColumns({"_after": after, "_before": before})
    closed, closes = starts & (F.col("_after.kind") == -1), (F.col("kind") == -1) & (F.col("_before.kind") == 1)
    step = F.when(closed, 1).when(closes, -1).otherwise(0)
    tokens = tokens.select(
        *key, "pos", "kind", F.col("named").alias("tag"), "scoped", "text", F.when(closed, F.col("_after.pos")).alias("close"), step.alias("step"),
        F.when(closed & F.col("hidden"), 1).when(closes & F.col("_before.hidden"), -1).otherwise(0).alias("hides"),
        F.when(closed & F.col("clickable"), 1).when(closes & F.col("_before.clickable"), -1).otherwise(0).alias("clicks"))
    page = Window.partitionBy(*key).orderBy("pos")
    run = page.rowsBetween(Window.unboundedPreceding, 0)
    is_table = F.coalesce(F.col("tag") == "table", F.lit(False))
    tables = F.when(is_table, F.col("step")).otherwise(0)
    next_table = F.lead(F.when(is_table & starts & F.col("close").isNotNull(), F.col("pos"))).over(page)
    return tokens.withColumns({
        "open": F.sum("step").over(run), "hiding": F.sum("hides").over(run), "clicking": F.sum("clicks").over(run),
        "depth": F.sum(tables).over(run), "next_table": next_table}).drop("step", "hides", "clicks")


def _placed(tokens: DataFrame, key: list[str]) -> DataFrame:
    """Tokens in tables with their table, row and cell, and the elements of the scope's name."""
    run = Window.partitionBy(*key, "depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    starts, ends = F.col("kind") == 1, F.col("kind") == -1
    table = starts & (F.col("tag") == "table") & F.col("close").isNotNull()
    cell = F.struct("pos", "open", "hiding", "clicking", (F.col("tag") == "th").alias("head"))
    tokens = tokens.filter("depth > 0 or scoped").withColumns({
        "table": F.last(F.when(table, F.struct("pos", "close")), True).over(run),
        "r": F.last(F.when(starts & (F.col("tag") == "tr"), F.col("pos")), True).over(run),
        "cell": F.last(F.when(starts & F.col("tag").isin("td", "th"), cell), True).over(run),
        "ended": F.last(F.when(ends & F.col("tag").isin("td", "th", "tr"), F.col("pos")), True).over(run)})
    in_row = F.col("r") > F.col("table.pos")
    in_cell = in_row & (F.col("cell.pos") > F.col("r")) & (F.coalesce(F.col("ended"), F.lit(-1)) < F.col("cell.pos"))
    tokens = tokens.withColumns({"r": F.when(in_row, F.col("r")), "cell": F.when(in_cell, F.col("cell"))})
    scope = F.when(F.col("scoped"), F.struct("pos", F.coalesce("close", F.lit(2**31 - 1)).alias("close")))
    return tokens.withColumns({
        "scope": scope, "holds": F.when(F.col("open") == F.col("cell.open"), F.col("next_table"))})


def _tables(tokens: DataFrame, key: list[str]) -> DataFrame:
    """One row per page: its tables with their rows and cells (``tables``) and all texts in them (``raw``)."""
    is_text = F.col("text").isNotNull()
    shown = is_text & F.col("cell").isNotNull() & (F.col("hiding") == F.col("cell.hiding"))
    part = F.when(shown, F.struct("pos", (F.col("clicking") > F.col("cell.clicking")).alias("linked"), squeeze(unescape(F.col("text"))).alias("text")))
    cells = tokens.groupBy(*key, F.col("table.pos").alias("t"), "r", F.col("cell.pos").alias("c")).agg(
        F.max("depth").alias("depth"), F.max("table.close").alias("close"), F.min("scope").alias("scope"),
        F.max("cell.head").alias("head"), F.sort_array(F.collect_list(part)).alias("parts"), F.collect_list(F.when(is_text, F.struct("pos", F.col("text").alias("token")))).alias("raw"),
        F.collect_list("holds").alias("holds"))

    def joined(linked: bool) -> Column:
        chosen = F.filter("parts", lambda p: (p["linked"] == linked) & (p["text"] != ""))
        return F.array_join(F.transform(chosen, lambda p: p["text"]), " ")

    # the text outside of links, or else that of the links
    cells = cells.withColumn("text", F.coalesce(F.nullif(joined(False), F.lit("")), joined(True)))
    cells = cells.withColumn("holds", F.transform("holds", lambda t: F.struct(t.alias("t"), F.col("c").alias("c"))))
    about = [F.max("depth").alias("depth"), F.max("close").alias("close"), F.min("scope").alias("scope"), F.flatten(F.collect_list("holds")).alias("holds")]
    raw = F.flatten(F.collect_list("raw")).alias("raw")
    rows = cells.groupBy(*key, "t", "r").agg(*about, raw, F.sort_array(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("c", "head", "text")))).alias("cells"))
    tables = rows.groupBy(*key, "t").agg(*about, raw, F.sort_array(F.collect_list(F.when(F.col("r").isNotNull(), F.struct("r", "cells")))).alias("rows"))
    found = F.when(F.col("t").isNotNull(), F.struct((-F.col("depth")).alias("rank"), "t", "close", "rows"))
    found = tables.groupBy(*key).agg(F.sort_array(F.collect_list(found)).alias("tables"), F.sort_array(raw).alias("raw"), F.min("scope").alias("scope"),
                                     F.map_from_entries(F.flatten(F.collect_list("holds"))).alias("outer"))
    return found.withColumn("tables", F.transform("tables", lambda t: F.struct(
        t["rank"].alias("rank"), t["t"].alias("t"), t["close"].alias("close"), F.try_element_at("outer", t["t"]).alias("outer"),
        (F.col("scope").isNull() | t["t"].between(F.col("scope.pos"), F.col("scope.close"))).alias("in_scope"), t["rows"].alias("rows"))))


def _inner(inner: Column, cell: Column) -> Column:
    """Values of the tables that stand directly in a cell."""
    return F.coalesce(F.try_element_at(inner, cell["c"]), F.array().cast("array<string>"))


def _table_value(table: Column, inner: Column) -> Column:
    """A table as JSON; ``inner`` has those of its cells."""

    def value(cell: Column) -> Column:
        return let(_inner(inner, cell), lambda held: F.when(F.size(held) == 1, F.get(held, F.lit(0))).when(
            F.size(held) > 1, _list(held)).otherwise(_json(cell["text"])))

    def listed(rows: Column) -> Column:
        names = F.transform(F.get(rows, F.lit(0))["cells"], lambda c, i: F.when(c["text"] == "", F.concat(F.lit("col_"), i)).otherwise(c["text"]))
        objects = let(names, lambda names: F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows), F.lit(1))), lambda row: _object(F.transform(
            row["cells"], lambda c, i: _entry(F.coalesce(F.get(names, i), F.concat(F.lit("col_"), i)), value(c))))))
        return _list(F.filter(objects, lambda o: o != "{}"))

    def pair(row: Column, i: Column) -> Column:
        first, second = F.get(row["cells"], F.lit(0)), F.get(row["cells"], F.lit(1))
        alone = F.when(i == 0, "_title").otherwise(F.concat(F.lit("_row_"), i))
        labelled = let(field_label(first["text"]), lambda label: F.when(label != "", _entry(label, value(second))))
        return F.when(second.isNotNull(), labelled).when(first["text"] != "", _entry(alone, _json(first["text"])))

    def of(rows: Column) -> Column:
        head = F.get(rows, F.lit(0))["cells"]
        wide = (F.size(head) > 2) | F.exists(head, lambda c: c["head"])
        return F.when(F.size(rows) == 0, "{}").when(wide, listed(rows)).otherwise(_object(F.filter(F.transform(rows, pair), lambda e: e.isNotNull())))

    return let(table["rows"], of)


def _put(inner: Column, table: Column) -> Column:
    """Adds the value of a table to those of the cell around it."""
    outer = table["outer"]
    held = F.coalesce(F.try_element_at(inner, outer), F.array().cast("array<string>"))
    more = F.map_from_entries(F.array(F.struct(outer, F.array_append(held, _table_value(table, inner)))))
    return F.when(outer.isNull(), inner).otherwise(F.map_concat(F.map_filter(inner, lambda k, v: k != outer), more))


def kv_records(
    pages: DataFrame, html: str = "html", required: Sequence[str] = rules.DETAIL_REQUIRED,
    optional: Sequence[str] = rules.DETAIL_OPTIONAL, scope_id: str = rules.DETAIL_SCOPE_ID,
) -> DataFrame:
    """Label/value records of detail pages, one row per page.

    The main table holds all ``required`` texts; of several the one with most rows, an ``optional`` text counting
    as ten. ``doc`` is the record as JSON, ``fields`` the same as map<string,string> (inner tables as JSON
    text) ready for ``canonical_fields``; ``n_fields`` is 0 when the page has no main table. Equal rows are read once.
    """
    keep = [c for c in pages.columns if c != html]
    key = ["_page", "_more"]
    digest = F.sha2(F.coalesce(html, F.lit("")), 256)
    # 120 bits of the digest as two numbers, as these are sorted and compared often
    marked = pages.withColumns({c: F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for c, at in zip(key, (1, 16))})
    # only pages with all the texts can have a main table
    maybe = let(inline_text(F.col(html)), lambda text: reduce(lambda a, b: a & b, (F.contains(text, F.lit(m)) for m in required), F.lit(True)))
    # the one shuffle; a number of its own, as a page is a lot of work for its bytes, and its tokens many rows to sort
    tasks = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pages.count() // TASK_PAGES))
    wanted = marked.filter(maybe).select(*key, html).repartition(tasks, *key).dropDuplicates(key)
    found = _tables(_placed(_intervals(_tokens(wanted, key, html, scope_id), key), key), key)

    def score(table: Column) -> Column:
        """Order of the tables that may be the main one; NULL for others. A table's text is all that lies between its tags."""
        inside = F.filter("raw", lambda p: (p["pos"] > table["t"]) & (p["pos"] < table["close"]))
        text = squeeze(unescape(F.array_join(F.transform(inside, lambda p: p["token"]), "")))

        def of(text: Column) -> Column:
            fits, points = table["in_scope"], F.size(table["rows"])
            for marker in required:
                fits = fits & F.contains(text, F.lit(marker))
            for marker in optional:
                points = points + F.contains(text, F.lit(marker)).cast("int") * 10
            return F.when(fits, F.struct(points.alias("points"), (-table["t"]).alias("place")))

        return let(text, of)

    def record(row: Column, inner: Column) -> Column:
        cells = F.filter(row["cells"], lambda c: ~c["head"])

        def of(cell: Column, held: Column, label: Column) -> Column:
            nested = _object(F.array(_entry(F.lit("text"), _json(cell["text"])), _entry(F.lit("tables"), _list(held))))
            return F.struct(label.alias("name"), F.when(F.size(held) > 0, nested).otherwise(cell["text"]).alias("text"), (F.size(held) > 0).alias("nested"))

        return let(cells, lambda cells: F.when(F.size(cells) > 1, let(
            F.struct(F.get(cells, F.lit(1)).alias("cell"), _inner(inner, F.get(cells, F.lit(1))).alias("held"), field_label(F.get(cells, F.lit(0))["text"]).alias("label")),
            lambda x: of(x["cell"], x["held"], x["label"]))))

    def entries(main: Column, inner: Column) -> Column:
        rows = F.get(F.filter("tables", lambda t: t["t"] == main), F.lit(0))["rows"]
        return _last(F.filter(F.transform(rows, lambda row: record(row, inner)), lambda e: e.isNotNull() & (e["name"] != "") & (e["text"] != "")))

    # in `let`, as the optimizer would put columns of their own into the lambdas, to be made again for each row
    main = F.array_max(F.filter(F.transform("tables", score), lambda x: x.isNotNull()))["place"]
    values = F.aggregate("tables", F.create_map().cast("map<int,array<string>>"), _put)
    read = let(main, lambda place: F.when(place.isNotNull(), let(values, lambda inner: entries(-place, inner))))
    records = found.select(*key, read.alias("e")).select(
        *key, _object(F.transform("e", lambda x: _entry(x["name"], F.when(x["nested"], x["text"]).otherwise(_json(x["text"]))))).alias("doc"),
        F.map_from_entries(F.transform("e", lambda x: F.struct(x["name"], x["text"]))).alias("fields"))
    return marked.join(records, key, "left").select(
        *keep, F.coalesce("doc", F.lit("{}")).alias("doc"), F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("fields"),
        F.coalesce(F.size(F.map_keys("fields")), F.lit(0)).cast("long").alias("n_fields"))
