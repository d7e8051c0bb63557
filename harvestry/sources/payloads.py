"""API payload pages holding child items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry import rules

_PAYLOAD = """code long, count string, pages string, current_keke_app_status string,
    data array<struct<content: string>>"""


def _parsed(payloads: DataFrame, body: str) -> DataFrame:
    return payloads.withColumn("_p", F.from_json(body, _PAYLOAD))


def payload_rejects(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Pages that were refused or cannot be read, as they came, with ``code`` and ``reason``."""
    code = F.col("_p.code")
    reason = F.when(code.isNull(), "not a payload").otherwise("refused")
    return _parsed(payloads, body).filter(code.isNull() | (code != 0)).select(*payloads.columns, code.alias("code"), reason.alias("reason"))


def payload_pages(payloads: DataFrame, body: str = "body") -> DataFrame:
    """One row per accepted page (code 0) with its counts; the others are in ``payload_rejects``."""
    parsed = _parsed(payloads, body).filter(F.col("_p.code") == 0)
    count = F.coalesce(F.col("_p.count").try_cast("long"), F.lit(0))
    stated = F.coalesce(F.col("_p.pages").try_cast("long"), F.lit(0))
    derived = F.when(
        (stated <= 0) & (count > 0), F.ceil(count / F.lit(rules.PAGE_SIZE))
    ).otherwise(stated)
    first = F.coalesce(F.get(F.col("_p.data"), F.lit(0))["content"], F.lit(""))
    return parsed.select(
        *[c for c in payloads.columns if c != body],
        count.alias("total_count"),
        F.greatest(derived, F.lit(1)).cast("long").alias("total_pages"),
        (F.coalesce(F.col("_p.current_keke_app_status"), F.lit("")) == "NotLogin").alias("not_login"),
        F.contains(first, F.lit(rules.OVERLAY_MARKER)).alias("has_overlay"),
        F.col("_p.data").alias("data"),
    )


def api_items(payloads: DataFrame, body: str = "body") -> DataFrame:
    """One row per child item of the accepted pages, with its 1-based place on the page."""
    pages = payload_pages(payloads, body)
    keep = [c for c in pages.columns if c != "data"]
    items = pages.select(*keep, F.posexplode("data").alias("_pos", "_item"))
    return items.select(
        *keep, (F.col("_pos") + 1).cast("long").alias("position_no"),
        F.col("_item.content").alias("content"),
    )
