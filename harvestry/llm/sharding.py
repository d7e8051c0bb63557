"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, overfull ranges subdivided.

Records are ordered by a key (the hash of their text, so that equal texts are neighbours) and their id. A
size-weighted sample of bounded size gives the splitters of the ranges; a range that still holds too
much is cut again by a sample of its own. Every range is sorted in one task; sums of the ranges before it turn its
running sums into places in the whole order, and 24 equal stretches of bytes are the shards.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestry.llm.store import small, written

SHARDS = 24
#: First ranges of each shard; their splitters are literals of one expression.
RANGES_PER_SHARD = 4
#: Sampled records of each range.
PER_RANGE = 32
#: Rows of a range, above which it is cut again (besides twice its share of the bytes).
RANGE_ROWS = 2_000_000
#: Ranges that one overfull range is cut into.
CUTS = 32
#: A group of equal texts of at most 1/so many of a shard stays in one shard.
WHOLE_GROUP = 20


def _hex_key(text: Column) -> Column:
    """60 bits of the text's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")


def _lot(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the record alone, so that a task that runs again draws the same sample."""
    return F.pmod(F.xxhash64(*parts, F.lit(41)), F.lit(1 << 40)) / float(1 << 40)


def _at_least(key: int, row: int | None) -> Column:
    after = F.col("key") >= key if row is None else (F.col("key") > key) | ((F.col("key") == key) & (F.col("row") >= row))
    return after


def _search(splitters: list[tuple[int, int | None]], low: int = 0) -> Column:
    """Number of splitters at or below the record, as a binary search in one expression."""
    if not splitters:
        return F.lit(low).cast("long")
    mid = len(splitters) // 2
    return F.when(_at_least(*splitters[mid]), _search(splitters[mid + 1 :], low + mid + 1)).otherwise(_search(splitters[:mid], low))


def _splitters(sample: DataFrame, ranges: Column) -> DataFrame:
    """``rng`` and its sorted splitters: weighted quantiles of the sample of each range.

    A splitter is the start of a group of equal keys, but where several fall into one group they are records of it.
    """
    order = Window.partitionBy("rng").orderBy("key", "row")
    cum = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("weight") / 2
    whole = F.sum("weight").over(Window.partitionBy("rng"))
    placed = sample.withColumn("q", F.floor(cum * ranges / whole))
    first = placed.groupBy("rng", "q").agg(F.min(F.struct("key", "row")).alias("s")).filter("q > 0")
    group = Window.partitionBy("rng", "s.key")
    first = first.withColumn("many", F.count("*").over(group) > 1)
    whole_key = F.struct(F.col("s.key").alias("key"), F.lit(-(2**63)).cast("long").alias("row"))
    return first.groupBy("rng").agg(F.sort_array(F.collect_set(F.when(F.col("many"), F.col("s")).otherwise(whole_key))).alias("splitters"))


def _sampled(rows: DataFrame, wanted: Column, total: Column) -> DataFrame:
    """About ``wanted`` records of each range, each with a chance in proportion to its size."""
    step = total / wanted
    return rows.filter(_lot(F.col("row"), F.col("key"), F.col("size"), F.col("rng")) < F.col("size") / step).select(
        "rng", "key", "row", F.greatest(F.col("size"), step).alias("weight"))


def _ranged(rows: DataFrame, total: int, shards: int, range_rows: int) -> DataFrame:
    """Adds ``rng``, a number that grows with (key, row), such that no range is overfull."""
    count = shards * RANGES_PER_SHARD
    sample = _sampled(rows.withColumn("rng", F.lit(0).cast("long")), F.lit(count * PER_RANGE), F.lit(float(total)))
    cuts = _splitters(sample, F.lit(count)).first()  # fewer than `count` splitters
    splitters = [(s["key"], None if s["row"] == -(2**63) else s["row"]) for s in cuts["splitters"]] if cuts else []
    ranged = written(rows.withColumn("rng", _search(splitters)), "ranges")
    share = 2 * total / count
    before = None
    while True:
        sums = ranged.groupBy("rng").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min(F.struct("key", "row")).alias("lo"), F.max(F.struct("key", "row")).alias("hi"))
        # a range of one repeated record cannot be cut
        overfull = sums.filter((F.col("lo") != F.col("hi")) & ((F.col("bytes") > share) & (F.col("n") > 64) | (F.col("n") > range_rows)))
        overfull = written(overfull.select("rng", "bytes"), "overfull")
        now = overfull.agg(F.count("*"), F.sum("bytes")).first()
        if not now[0] or now == before:
            return ranged
        before = now
        inside = ranged.join(overfull, "rng")
        fine = _splitters(_sampled(inside, F.lit(CUTS * PER_RANGE), F.col("bytes").cast("double")), F.lit(CUTS))
        below = F.size(F.filter("splitters", lambda s: s <= F.struct("key", "row")))
        cut = ranged.join(fine, "rng", "left").withColumn("rng", F.col("rng") * CUTS + F.coalesce(below, F.lit(0)))
        ranged = written(cut.drop("splitters"), "ranges")


def shard_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """``id``, ``size``, ``text_crc32``, ``law`` ('bytes'), ``shard``, ``slot``, ``grown_shard`` (null) per input row.

    Size is the UTF-8 bytes of the text (null: none) plus 8. Shards are consecutive stretches of nearly equal bytes
    in the order of text hash and id: they differ by at most a record and a 1/20 of a shard, as groups of
    equal texts up to that size stay together; larger groups are cut by id. Slots count from 0 in each
    shard. Null ids come first in their group; null texts have the checksum of no bytes; repeated rows have slots of
    their own. Extra columns play no part. An empty table gives an empty result.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("row"), _hex_key(text).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"))
    rows = written(rows, "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranged = _ranged(rows, max(total, 1), shards, range_rows)
    # each holds over 1 / (shards * WHOLE_GROUP) of the bytes: at most so many keys
    heavy = F.broadcast(rows.groupBy("key").agg(F.sum("size").alias("held")).filter(F.col("held") * (shards * WHOLE_GROUP) > total).select("key", F.lit(True).alias("heavy")))
    sums = ranged.groupBy("rng").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    sums = written(sums.withColumn("next", F.lead("lo").over(Window.orderBy("rng"))), "range-sums")
    earlier = Window.orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = sums.select("rng", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("rng").orderBy("key", "row", "size")
    placed = ranged.withColumn("running", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    placed = placed.withColumn("nth", F.row_number().over(inside) - 1).join(starts, "rng")
    placed = placed.withColumn("first", F.col("bytes_before") + F.col("running")).withColumn("rank", F.col("rows_before") + F.col("nth"))
    placed = placed.withColumn("group_first", F.min("first").over(Window.partitionBy("rng", "key"))).join(heavy, "key", "left")
    # a group that goes on in the next range starts behind all smaller keys of the first range that holds it
    open_ranges = small(sums.filter("hi = next").select("rng", "hi"), "open-ranges")
    behind = ranged.join(open_ranges, "rng").groupBy("rng", "hi").agg(F.sum(F.when(F.col("key") < F.col("hi"), F.col("size")).otherwise(0)).alias("below"))
    spans = behind.join(starts, "rng").groupBy(F.col("hi").alias("key")).agg(F.min(F.col("bytes_before") + F.col("below")).alias("span_first"))
    placed = placed.join(small(spans, "open-groups"), "key", "left")
    place = F.when(F.col("heavy"), F.col("first")).otherwise(F.coalesce("span_first", "group_first"))
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(place * shards / F.lit(max(total, 1)))).cast("int"))
    placed = written(placed.select("id", "size", "text_crc32", "shard", "rank"), "places")
    heads = F.broadcast(placed.groupBy("shard").agg(F.min("rank").alias("head")))  # one row per shard
    return placed.join(heads, "shard").select(
        "id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("head")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
