"""Connected components by alternating large-star and small-star steps over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.llm.store import written


def components(links: DataFrame) -> DataFrame:
    """``id``, ``component`` (smallest reachable id) of every id in ``links`` (columns ``a``, ``b``, longs).

    Each step takes the smallest neighbour per id by an aggregate that combines before the shuffle and joins
    it back, so an id with very many links is a skewed join that Spark splits, not one task. The number of
    rounds grows with the logarithm of the longest chain; every round is a written table. Links of an id
    with itself, repeated ones and nulls are ignored; no links give an empty result.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, last = written(edges, "links"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == last:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                edges.select("v", "v").distinct()
            )
        last = state
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # every larger neighbour of u now points to the smallest one
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(low).distinct(), "links")
