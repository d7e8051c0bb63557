"""Exports and keyed table rewrites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.functions.endpoints import endpoint_line
from harvestry.operators.scans import join_on, running

BOM = "\ufeff"

# --- fixed values: export headers --------------------------------------------------------
ENTITY_HEADER = {
    "id": "ID", "journal_id": "期刊ID", "name": "名称", "issn": "ISSN", "eissn": "E-ISSN",
    "impact_factor": "影响因子", "jcr_partition": "JCR分区", "cas_partition": "中科院分区",
    "review_speed": "审稿速度", "acceptance_rate": "录用比例",
}
NESTED_HEADER = {
    "journal_id": "期刊ID", "name": "期刊名称", "issn": "ISSN", "eissn": "E-ISSN",
    "impact_factor": "影响因子", "jcr_partition": "JCR分区", "cas_partition": "中科院分区",
    "review_speed": "审稿速度", "acceptance_rate": "录用比例", "n_children": "评论数量",
    "part_no": "部分", "children": "评论数据",
}
CHILD_HEADER = {
    "comment_id": "评论ID", "journal_id": "期刊ID", "content": "评论内容", "author": "作者",
    "rating": "评分", "submit_experience": "投稿经历", "comment_time": "评论时间",
    "crawled_at": "爬取时间",
}
NESTED_FIELDS = ("comment_id", "content", "author", "rating", "submit_experience", "comment_time")


def export_rows(df: DataFrame, header: dict[str, str]) -> DataFrame:
    """Columns under their export names; the first name carries the byte order mark."""
    named = [F.col(c).alias(label) for c, label in header.items()]
    first, label = next(iter(header.items()))
    return df.select(F.col(first).alias(BOM + label), *named[1:])


def _write_csv(df: DataFrame, path: str) -> None:
    # doubled quotes, as spreadsheet programs read them
    df.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", nullValue="")


def export_entities_csv(entities: DataFrame, path: str, group_id: int | None = None) -> None:
    """Ten columns with the export header; every part file starts with a byte order mark."""
    rows = entities if group_id is None else entities.filter(F.col("category_id") == group_id)
    _write_csv(export_rows(rows, ENTITY_HEADER), path)


def minute_text(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm")


def nest_children(
    entities: DataFrame, children: DataFrame, key: str = "journal_id", child: str = "comment_id",
    fields: Sequence[str] = NESTED_FIELDS, time: str = "comment_time",
    max_children_per_row: int = 10_000,
) -> DataFrame:
    """Rows of (entity, part): ``n_children``, ``part_no`` from 0 and a JSON list of that part ('' without children).

    Children stand in the order of their id, within parts and across them; a part has ``max_children_per_row``
    children, so no cell and no task ever holds an unbounded list.
    """
    counts = children.groupBy(key).agg(F.count(F.lit(1)).alias("n_children"))
    placed = running(children.select(key, child, *[f for f in fields if f not in (key, child)]), [key], [child], {"_place": F.lit(1)})
    values = [minute_text(f).alias(f) if f == time else F.col(f) for f in fields]
    lists = (
        placed.withColumn("part_no", F.floor((F.col("_place") - 1) / max_children_per_row))
        .groupBy(key, "part_no")
        .agg(
            F.array_sort(F.collect_list(F.struct(F.col(child).alias("_by"), F.struct(*values).alias("item"))))
            .alias("_items")
        )
        .select(
            key, "part_no",
            F.to_json(F.transform("_items", lambda x: x["item"]), {"ignoreNullFields": "false"})
            .alias("children"),
        )
    )
    with_counts = join_on(entities, counts, [key])
    return join_on(with_counts, lists, [key]).withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)).cast("long"),
        "part_no": F.coalesce("part_no", F.lit(0)),
        "children": F.coalesce("children", F.lit("")),
    })


def export_entities_nested(
    entities: DataFrame, children: DataFrame, path: str, group_id: int | None = None
) -> None:
    rows = entities if group_id is None else entities.filter(F.col("category_id") == group_id)
    _write_csv(export_rows(nest_children(rows, children), NESTED_HEADER), path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def child_rows(children: DataFrame, entity_id: int | None = None) -> DataFrame:
    rows = children if entity_id is None else children.filter(F.col("journal_id") == entity_id)
    return rows.withColumns({
        "comment_time": F.coalesce(minute_text("comment_time"), F.lit("")),
        "crawled_at": F.coalesce(minute_text("crawled_at"), F.lit("")),
    }).select(*CHILD_HEADER)


def export_children_csv(children: DataFrame, path: str, entity_id: int | None = None) -> None:
    _write_csv(export_rows(child_rows(children, entity_id), CHILD_HEADER), path)


def endpoint_lines(
    endpoints: DataFrame, fmt: str = "hostport_auth", only_active: bool = True,
    only_valid: bool = False, include_auth: bool = True,
) -> DataFrame:
    """id, line for the endpoints to export."""
    rows = endpoints
    if only_active:
        rows = rows.filter("is_active")
    if only_valid:
        rows = rows.filter("is_valid")
    return rows.select("id", endpoint_line(fmt, include_auth).alias("line"))


def export_endpoints(
    endpoints: DataFrame, path: str, fmt: str = "hostport_auth", only_active: bool = True,
    only_valid: bool = False, include_auth: bool = True,
) -> None:
    """Text lines in id order (part files follow each other)."""
    lines = endpoint_lines(endpoints, fmt, only_active, only_valid, include_auth)
    lines.orderBy("id").select("line").write.mode("overwrite").text(path)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], policy: dict[str, str] | None = None) -> DataFrame:
    """Full-outer merge of two tables that are unique on ``keys``.

    ``policy`` per column: ``new`` (default: the new row's value, even NULL), ``keep`` (the
    old row's value once there is an old row) or ``fill`` (the new value unless it is NULL).
    """
    policy = policy or {}
    rest = [c for c in old.columns if c not in keys]
    left = old.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.struct(*rest).alias("_old"))
    right = new.select(*keys, F.struct(*rest).alias("_new"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    both = left.join(right, cond, "full")

    def merged(c: str) -> F.Column:
        was, now = F.col("_old")[c], F.col("_new")[c]
        rule = policy.get(c, "new")
        if rule == "keep":
            return F.when(F.col("_old").isNotNull(), was).otherwise(now)
        if rule == "fill":
            return F.coalesce(now, was)
        return F.when(F.col("_new").isNotNull(), now).otherwise(was)

    out = [F.coalesce(k, f"_o_{k}").alias(k) for k in keys] + [merged(c).alias(c) for c in rest]
    return both.select(*out).select(*old.columns)


def replace_keys(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of the keys present in ``new`` are replaced by the rows of ``new``."""
    touched = new.select(*keys).distinct()
    return old.join(touched, list(keys), "left_anti").unionByName(new.select(*old.columns))


def write_version(df: DataFrame, folder: str, version: int) -> str:
    """Write a table version beside the earlier ones; rewriting the same version is harmless."""
    path = f"{folder}/batch_version={version}"
    df.write.mode("overwrite").parquet(path)
    return path
