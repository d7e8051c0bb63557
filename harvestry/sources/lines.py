"""Endpoint lists kept as text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.functions.endpoints import endpoint_parts


def read_endpoint_lines(
    lines: DataFrame, line: str = "line", protocol: str = "http",
    username: str | None = None, secret: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Split lines into good endpoints and rejects; other columns (line number) pass through.

    Blank lines and comments are neither: they come out as rejects with ``skipped`` true.
    """
    rest = [c for c in lines.columns if c != line]
    # a generator, so that a filter on the outcome does not parse every line again
    parsed = lines.select(*rest, F.trim(line).alias("content"), F.inline(F.array(endpoint_parts(line, protocol))))
    good = F.col("error").isNull()
    ok = parsed.filter(good).select(
        *rest, "ip", "port", "protocol",
        F.coalesce("username", F.lit(username)).alias("username"),
        F.coalesce("secret", F.lit(secret)).alias("secret"),
    )
    rejects = parsed.filter(~good).select(
        *rest, "content", "error", F.col("error").isin("blank line", "comment").alias("skipped")
    )
    return ok, rejects
