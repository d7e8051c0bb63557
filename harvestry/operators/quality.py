"""Record audit, extraction checks and page flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry import rules
from harvestry.functions import documents as docs


@dataclass(frozen=True)
class AuditRules:
    min_fields: int = rules.MIN_FIELDS
    warn_fields: int = rules.WARN_FIELDS
    markers: Sequence[str] = rules.LOGIN_MARKERS
    identity: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(rules.IDENTITY_FIELDS))
    important: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(rules.IMPORTANT_FIELDS))


AUDIT_COLUMNS = (
    "status", "field_count", "hard_reasons", "warnings", "missing_required", "missing_important", "reason_codes",
)


def _codes(*conds: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in conds]))


def audit(df: DataFrame, doc: str = "detail_data", audit_rules: AuditRules = AuditRules()) -> DataFrame:
    """Add status, field_count, hard_reasons, warnings, missing lists and reason_codes."""
    r = audit_rules
    warn_below = max(r.warn_fields, r.min_fields)
    rows = df.withColumns({"_empty": docs.is_empty_doc(doc), "_keys": docs.doc_keys(doc)})
    rows = rows.withColumns({
        "_object": ~F.col("_empty") & F.col("_keys").isNotNull(),
        "field_count": F.when(
            F.col("_empty") | F.col("_keys").isNull(), 0).otherwise(F.size("_keys")).cast("long"),
    })
    keys, obj = F.col("_keys"), F.col("_object")

    def missing(groups: Mapping[str, Sequence[str]]) -> Column:
        return _codes(*[(obj & ~docs.has_any_key(keys, names), g) for g, names in groups.items()])

    rows = rows.withColumns({
        "_no_identity": missing(r.identity), "missing_important": missing(r.important),
    })
    n = F.col("field_count")
    hard = F.concat(
        _codes(
            (F.col("_empty"), rules.DETAIL_EMPTY),
            (~F.col("_empty") & keys.isNull(), rules.DETAIL_NOT_OBJECT),
            (obj & docs.has_marker(doc, r.markers), rules.DETAIL_LOGIN_PLACEHOLDER),
            (obj & (n < r.min_fields), rules.DETAIL_LOW_FIELD_COUNT),
        ),
        F.transform("_no_identity", lambda _: F.lit(rules.DETAIL_MISSING_IDENTITY)),
    )
    rows = rows.withColumn("hard_reasons", hard)
    clean = F.size("hard_reasons") == 0
    rows = rows.withColumns({
        "warnings": _codes(
            (obj & clean & (n < warn_below), rules.DETAIL_WARN_FIELD_COUNT),
            (F.size("missing_important") > 0, rules.DETAIL_MISSING_IMPORTANT),
        ),
        "missing_required": F.when(F.col("_empty"), F.array(F.lit(doc))).otherwise(F.col("_no_identity")),
    })
    rows = rows.withColumns({
        "status": F.when(~clean, "bad").when(F.size("warnings") > 0, "warning").otherwise("ok"),
        "reason_codes": F.concat("hard_reasons", "warnings"),
    })
    # a generator, so that a filter on the outcome does not audit every document again
    return rows.select(*df.columns, F.inline(F.array(F.struct(*AUDIT_COLUMNS))))


def audit_order(df: DataFrame, n: int | None = None, updated: str = "updated_at", id_col: str = "id") -> DataFrame:
    ordered = df.orderBy(updated, id_col)
    return ordered.limit(n) if n else ordered


def audit_job(
    entities: DataFrame, limit: int | None = None, include_ok: bool = False,
    doc: str = "detail_data", audit_rules: AuditRules = AuditRules(),
    done: str = "detail_crawled", updated: str = "updated_at", id_col: str = "id",
) -> DataFrame:
    """Audit of the finished entities, optionally only the ``limit`` least recently updated."""
    rows = entities.filter(F.col(done))
    if limit:
        rows = audit_order(rows, limit, updated, id_col)
    audited = audit(rows, doc, audit_rules)
    return audited if include_ok else audited.filter(F.col("status") != "ok")


def audit_stats(audited: DataFrame, status: str = "status") -> DataFrame:
    """Counts of ok, warning and bad, and their total."""
    return audited.agg(
        F.count_if(F.col(status) == "ok").alias("ok"),
        F.count_if(F.col(status) == "warning").alias("warning"),
        F.count_if(F.col(status) == "bad").alias("bad"),
        F.count(status).alias("total_checked"),
    )


def audit_to_problems(
    audited: DataFrame, key: str = "journal_id", min_fields: int = rules.MIN_FIELDS
) -> tuple[DataFrame, DataFrame]:
    """Problem rows for bad and warning records, and the (key, code) pairs an ok record resolves."""
    code = F.coalesce(F.get("hard_reasons", F.lit(0)), F.get("warnings", F.lit(0)))
    message = F.format_string(rules.AUDIT_MESSAGE, "status", "field_count", F.array_join("reason_codes", ","))
    problems = audited.filter(F.col("status") != "ok").select(
        key,
        F.when(F.size("hard_reasons") > 0, "error").otherwise("warning").alias("problem_type"),
        code.alias("problem_code"),
        message.alias("message"),
        F.when(code == rules.DETAIL_LOW_FIELD_COUNT, F.lit(min_fields)).cast("long").alias("expected_value"),
        F.col("field_count").alias("actual_value"),
    )
    resolves = audited.filter(F.col("status") == "ok").select(
        key, F.explode(F.array(*[F.lit(c) for c in rules.DETAIL_CODES])).alias("problem_code")
    )
    return problems, resolves


def validate_extracted(df: DataFrame, fields: str = "fields") -> DataFrame:
    """Add n_fields, accepted, warns (no core field) and the missing list of a rejected record.

    ``fields`` is a map; fewer than five fields are rejected.
    """
    keys = F.map_keys(F.coalesce(F.col(fields), F.from_json(F.lit("{}"), "map<string,string>")))
    n = F.size(keys)

    def absent(names: Sequence[str]) -> Column:
        return _codes(*[(~docs.has_any_key(keys, [name]), name) for name in names])

    return df.withColumns({
        "n_fields": n.cast("long"),
        "accepted": n >= rules.MIN_EXTRACTED_FIELDS,
        "warns": (n > 0) & ~docs.has_any_key(keys, rules.CORE_FIELDS),
        "missing": F.when(n == 0, F.array(*[F.lit(c) for c in rules.CORE_FIELDS]))
        .when(n < rules.MIN_EXTRACTED_FIELDS, absent(rules.EXPECTED_FIELDS))
        .otherwise(F.array().cast("array<string>")),
    })


def page_flags(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add rate_limited, login_placeholder and overlay flags of stored pages."""
    text = F.coalesce(F.col(html), F.lit(""))
    login = F.lit(False)
    for marker in rules.LOGIN_MARKERS:
        login = login | F.contains(text, F.lit(marker))
    return pages.withColumns({
        "rate_limited": F.contains(text, F.lit(rules.RATE_LIMIT_MARKER)),
        "login_placeholder": login,
        "overlay": F.contains(text, F.lit(rules.OVERLAY_MARKER)),
    })
