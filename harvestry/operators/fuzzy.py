"""A table of search terms against all names by trigrams, without comparing each pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.functions.text import trigrams_of


def _needed(size: Column, threshold: float) -> Column:
    """Trigrams that a set shares at least with any set that is similar enough."""
    return F.ceil(size * F.lit(threshold) - F.lit(1e-9)).cast("int")


def _texts(df: DataFrame, c: str) -> DataFrame:
    """Distinct texts that have trigrams."""
    rows = df.select(F.col(c).cast("string").alias("text")).distinct().withColumn("grams", trigrams_of(F.col("text")))
    return rows.filter(F.size("grams") > 0)


def _by_rarity(texts: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """``grams`` rarest first, and the ``prefix`` of which two similar texts share one."""
    each = texts.select("text", F.explode("grams").alias("gram")).join(counts, "gram", "left")
    ranked = each.groupBy("text").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("g"))
    rows = ranked.select("text", F.col("g.gram").alias("grams"), F.size("g").alias("size"))
    return rows.withColumn("prefix", F.slice("grams", F.lit(1), F.col("size") - _needed(F.col("size"), threshold) + 1))


def fuzzy_pairs(
    names: DataFrame, terms: DataFrame, name: str = "name", term: str = "term", threshold: float = 0.3,
) -> DataFrame:
    """``term``, ``name``, ``similarity`` of the distinct texts whose trigram similarity reaches the threshold (0.1 to 1).

    Both sides are reduced to distinct texts.  Trigrams are ordered by how many names have them; texts that are
    similar enough share one among their first few, so only those are posting lists, and a trigram that many names have
    is in few of them.  Sizes and places of the shared trigram bound the overlap before it is counted; a pair
    is kept at the first one that it shares, so it comes up once.  Texts without letters and digits match nothing.
    """
    limit = min(max(threshold, 0.1), 1.0)
    have, wanted = _texts(names, name), _texts(terms, term)
    counts = have.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))

    def postings(texts: DataFrame, side: str) -> DataFrame:
        rows = _by_rarity(texts, counts, limit).select("*", F.posexplode("prefix").alias("at", "gram"))
        return rows.select("gram", *[F.col(c).alias(f"{c}_{side}") for c in ("text", "grams", "size", "prefix", "at")])

    pairs = postings(wanted, "a").join(postings(have, "b"), "gram")
    small, large = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    most = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    pairs = pairs.filter(small >= _needed(large, limit))
    pairs = pairs.filter(most * F.lit(1 + limit) + F.lit(1e-9) >= F.lit(limit) * (F.col("size_a") + F.col("size_b")))
    pairs = pairs.filter(F.get(F.array_intersect("prefix_a", "prefix_b"), F.lit(0)) == F.col("gram"))
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    found = pairs.select(F.col("text_a").alias(term), F.col("text_b").alias(name),
                         (shared / (F.col("size_a") + F.col("size_b") - shared)).alias("similarity"))
    return found.filter(F.col("similarity") >= limit)
