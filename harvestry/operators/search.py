"""Faceted search, listings, paging and row summaries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestry import rules
from harvestry.functions import documents as docs
from harvestry.functions.text import contains_ci, blank_to_null, trigram_similarity, first_integer
from harvestry.schemas import EntityColumns

DEFAULT = EntityColumns()


def clean_text(value: str | None) -> str | None:
    """Trimmed filter value; blank means no filter."""
    return (value or "").strip() or None


def _any(*conds: Column) -> Column:
    out = conds[0]
    for cond in conds[1:]:
        out = out | cond
    return out


def name_match(c: str, value: str, typo_fuzzy: bool = False, threshold: float = 0.3) -> Column:
    """Contains the text or, when asked, is similar enough to it by trigrams."""
    cond = contains_ci(c, value)
    if typo_fuzzy:
        limit = min(max(threshold, 0.1), 1.0)
        cond = cond | (trigram_similarity(c, F.lit(value)) >= limit)
    return cond


def doc_field_filter(doc: str, field: str, value: str | None, op: str) -> Column:
    """``exists``, ``equals`` or ``contains`` (any other word) on a top-level field."""
    if op == "exists":
        return docs.has_field(doc, field)
    text = docs.doc_field(doc, field)
    return text == (value or "") if op == "equals" else contains_ci(text, value or "")


def search_entities(
    df: DataFrame,
    *,
    q: str | None = None,
    name: str | None = None,
    code: str | None = None,
    group_id: int | None = None,
    detail_done: bool | None = None,
    children_done: bool | None = None,
    score_min: float | None = None,
    score_max: float | None = None,
    score2_min: float | None = None,
    score2_max: float | None = None,
    texts: Mapping[str, str | None] | None = None,
    doc_text: str | None = None,
    doc_field: str | None = None,
    doc_value: str | None = None,
    doc_op: str = "contains",
    typo_fuzzy: bool = False,
    threshold: float = 0.3,
    cols: EntityColumns = DEFAULT,
) -> DataFrame:
    """All given filters together; equality and ranges come first so the scan can use them."""
    for low, high in ((score_min, score_max), (score2_min, score2_max)):
        if low is not None and high is not None and low > high:
            raise ValueError("minimum score is above the maximum")
    q, name, code = clean_text(q), clean_text(name), clean_text(code)
    doc_text, doc_field, doc_value = clean_text(doc_text), clean_text(doc_field), clean_text(doc_value)

    for column, value in (
        (cols.group, group_id), (cols.detail_done, detail_done), (cols.children_done, children_done),
    ):
        if value is not None:
            df = df.filter(F.col(column) == value)
    for column, low, high in ((cols.score, score_min, score_max), (cols.score2, score2_min, score2_max)):
        if low is not None:
            df = df.filter(F.col(column) >= low)
        if high is not None:
            df = df.filter(F.col(column) <= high)
    if q:
        found = [name_match(cols.name, q, typo_fuzzy, threshold),
                 contains_ci(cols.code, q), contains_ci(cols.alt_code, q)]
        if q.isdigit():
            found.append(F.col(cols.id) == int(q))
        df = df.filter(_any(*found))
    if name:
        df = df.filter(name_match(cols.name, name, typo_fuzzy, threshold))
    if code:
        df = df.filter(contains_ci(cols.code, code) | contains_ci(cols.alt_code, code))
    for column, value in (texts or {}).items():
        if column not in cols.texts:
            raise ValueError(f"{column} is not a searchable text column")
        if value := clean_text(value):
            df = df.filter(contains_ci(column, value))
    if doc_text:
        df = df.filter(docs.contains_anywhere(cols.doc, doc_text))
    if doc_field:
        df = df.filter(doc_field_filter(cols.doc, doc_field, doc_value, doc_op))
    return df


def simple_search(
    df: DataFrame, term: str | None = None, group_id: int | None = None,
    detail_done: bool | None = None, cols: EntityColumns = DEFAULT,
) -> DataFrame:
    """An all-digit term means that id only; any other term searches name and codes."""
    if group_id:
        df = df.filter(F.col(cols.group) == group_id)
    if detail_done is not None:
        df = df.filter(F.col(cols.detail_done) == detail_done)
    if term := clean_text(term):
        if term.isdigit():
            return df.filter(F.col(cols.id) == int(term))
        df = df.filter(_any(*[contains_ci(c, term) for c in (cols.name, cols.code, cols.alt_code)]))
    return df


def search_work(
    items: DataFrame, status: str | None = None, task_type: str | None = None, term: str | None = None
) -> DataFrame:
    """Work items by status, type and a text over target, url, worker, error (or the id)."""
    if status:
        items = items.filter(F.col("status") == status)
    if task_type:
        items = items.filter(F.col("task_type") == task_type)
    if term := clean_text(term):
        found = [F.coalesce(contains_ci(c, term), F.lit(False))
                 for c in ("target_id", "target_url", "worker_id", "error_message")]
        if term.isdigit():
            found.append(F.col("id") == int(term))
        items = items.filter(_any(*found))
    return items.orderBy(F.col("created_at").desc(), F.col("id").desc())


def list_problems(
    problems: DataFrame, resolved: bool = False, problem_type: str | None = None, code: str | None = None
) -> DataFrame:
    rows = problems.filter(F.col("resolved") == (1 if resolved else 0))
    if problem_type:
        rows = rows.filter(F.col("problem_type") == problem_type)
    if code:
        rows = rows.filter(F.col("problem_code") == code)
    at = "resolved_at" if resolved else "created_at"
    return rows.orderBy(F.col(at).desc(), F.col("id").desc())


def list_endpoints(endpoints: DataFrame, active: bool | None = None, valid: bool | None = None) -> DataFrame:
    """Endpoints newest first; the secret is replaced by ``has_secret``."""
    if active is not None:
        endpoints = endpoints.filter(F.col("is_active") == active)
    if valid is not None:
        endpoints = endpoints.filter(F.col("is_valid") == valid)
    has_secret = F.coalesce(F.col("secret") != "", F.lit(False))
    return endpoints.withColumn("has_secret", has_secret).drop("secret").orderBy(F.col("id").desc())


def exhausted(items: DataFrame) -> DataFrame:
    """Failed items that used up their retries, latest first."""
    rows = items.filter((F.col("status") == "failed") & (F.col("retry_count") >= F.col("max_retry")))
    return rows.orderBy(F.col("completed_at").desc(), F.col("id").desc())


def retryable(items: DataFrame, task_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Oldest failed items with retries left."""
    rows = items.filter((F.col("status") == "failed") & (F.col("retry_count") < F.col("max_retry")))
    if task_type:
        rows = rows.filter(F.col("task_type") == task_type)
    rows = rows.orderBy("created_at", "id")
    return rows if limit is None else rows.limit(limit)


def stale_leases(items: DataFrame, now: Column, timeout: int = 600) -> DataFrame:
    """Running items whose lease is older than ``timeout`` seconds."""
    oldest = now - F.make_dt_interval(secs=F.lit(timeout))
    return items.filter((F.col("status") == "running") & (F.col("locked_at") < oldest))


def due_sources(sources: DataFrame, now: Column) -> DataFrame:
    """Active sources never fetched or fetched at least ``fetch_interval`` seconds ago."""
    elapsed = F.timestamp_diff("SECOND", F.col("last_fetch_at"), now)
    due = F.col("last_fetch_at").isNull() | (elapsed >= F.col("fetch_interval"))
    return sources.filter(F.col("is_active") & due)


def open_problem_ids(problems: DataFrame, code: str | None = None) -> DataFrame:
    rows = problems.filter(F.col("resolved") == 0)
    if code:
        rows = rows.filter(F.col("problem_code") == code)
    return rows.select("journal_id").distinct()


# --- order and pages -------------------------------------------------------------------------

def sort_columns(sort: str, order: str = "desc", cols: EntityColumns = DEFAULT) -> list[Column]:
    """Whitelisted sort column (others mean the score), nulls last both ways, then the id."""
    allowed = {cols.score, cols.score2, cols.name, cols.id, cols.created, cols.updated}
    column = F.col(sort if sort in allowed else cols.score)
    first = column.asc_nulls_last() if order == "asc" else column.desc_nulls_last()
    return [first, F.col(cols.id).asc()]


def sort_entities(df: DataFrame, sort: str, order: str = "desc", cols: EntityColumns = DEFAULT) -> DataFrame:
    return df.orderBy(*sort_columns(sort, order, cols))


def page(df: DataFrame, number: int, size: int, max_size: int | None = None) -> DataFrame:
    """One page of a sorted frame; Spark keeps only the top rows, never a full sort.

    A size above ``max_size``, if the caller sets one, is an error.
    """
    if max_size is not None and size > max_size:
        raise ValueError(f"a page has at most {max_size} rows")
    size = max(size, 1)
    return df.offset((max(number, 1) - 1) * size).limit(size)


def default_listing(df: DataFrame, cols: EntityColumns = DEFAULT) -> DataFrame:
    return sort_entities(df, cols.score, "desc", cols)


def child_order(
    by: str = "crawled", id_col: str = "comment_id", crawled: str = "crawled_at",
    time: str = "comment_time", rating: str = "rating",
) -> list[Column]:
    """Latest crawled first, or highest rating, or latest comment; missing ones last."""
    if by == "rating":
        first = F.coalesce(first_integer(rating), F.lit(0)).desc()
    else:
        first = F.col(time if by == "time" else crawled).desc_nulls_last()
    return [first, F.col(id_col)]


def children_of(
    children: DataFrame, entity_id: int, by: str = "crawled", key: str = "journal_id", **columns: str
) -> DataFrame:
    """Children of one entity in the chosen order."""
    return children.filter(F.col(key) == entity_id).orderBy(*child_order(by, **columns))


def first_children(
    children: DataFrame, size: int = 20, by: str = "crawled", key: str = "journal_id", **columns: str
) -> DataFrame:
    """The first page of children of every entity, with ``place`` from 1.

    Spark applies the rank limit before the shuffle, so an entity with very many children
    sends only ``size`` rows per map task.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(*child_order(by, **columns)))
    return children.withColumn("place", place.cast("int")).filter(F.col("place") <= size)


def child_counts(children: DataFrame, key: str = "journal_id", out: str = "n_children") -> DataFrame:
    return children.groupBy(key).agg(F.count(F.lit(1)).alias(out))


def with_child_counts(
    entities: DataFrame, children: DataFrame, key: str = "journal_id", out: str = "n_children",
    child_key: str | None = None, is_page: bool = False,
) -> DataFrame:
    """Entities with the number of their children, 0 when there are none.

    ``is_page`` says the entities are one page (at most a few hundred rows): the page is
    broadcast and only its children are counted.  Otherwise children are pre-aggregated.
    """
    child_key = child_key or key
    kids = children.select(F.col(child_key).alias(key))
    if is_page:
        kids = kids.join(F.broadcast(entities.select(key)), key, "left_semi")
    counts = child_counts(kids, key, out)
    return entities.join(counts, key, "left").withColumn(out, F.coalesce(out, F.lit(0)).cast("long"))


# --- row summaries ------------------------------------------------------------------------------

def _source(column: str, keys: tuple[str, ...]) -> Column:
    return F.coalesce(blank_to_null(column), *[blank_to_null(F.col("_fields")[k]) for k in keys])


def entity_rows(
    df: DataFrame, counts: DataFrame | None = None, include_doc: bool = False, cols: EntityColumns = DEFAULT
) -> DataFrame:
    """List rows: base columns, child count and the three partition and score summaries."""
    rows = df
    if counts is not None:
        rows = rows.join(counts, cols.id, "left").withColumn(
            "n_children", F.coalesce("n_children", F.lit(0)).cast("long")
        )
    rows = rows.withColumn("_fields", docs.doc_map(cols.doc)).withColumns({
        "jcr_partition_summary": docs.summarize_jcr(_source("jcr_partition", rules.JCR_DOC_KEYS)),
        "cas_partition_summary": docs.summarize_partition(_source("cas_partition", rules.CAS_DOC_KEYS)),
        "citescore_summary": docs.summarize_citescore(_source("citescore", rules.CITESCORE_DOC_KEYS)),
    }).drop("_fields")
    if include_doc:
        return rows.withColumns({
            cols.doc: F.when(docs.is_object(cols.doc), F.col(cols.doc)),
            "page_comment_count": docs.doc_field(cols.doc, "comment_count"),
        })
    return rows.drop(cols.doc)
