"""Conflict-constrained best-fit packing of documents into training sequences.

Documents are cut into pieces of at most the capacity and dealt at random (by hash) into packing groups of
bounded size, so each group sees every source in proportion and no source or cluster meets in one task. In a
group the pieces go, longest first, into the open bin with the smallest residual that fits and
holds neither their source nor their duplicate cluster: bins lie in a list ordered by residual, each carries
bitmaps of its sources and clusters, and the search walks on from the tightest bin until one is compatible.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.llm.store import pieces, written
from harvestry.llm.words import chunks, word_counts

#: Words of one bin.
CAPACITY = 2048
#: Pieces of one packing group.
GROUP_ROWS = 4096
#: Copies of one piece that go to the same packing group.
COPIES = 256
_BIN_BITS = 32


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """Bin of each piece, in the order given; sources and clusters are bitmaps of one bit or 0 for none."""
    open_bins: list[int] = []  # residual and bin number in one integer, ascending
    source_maps: list[int] = []
    cluster_maps: list[int] = []
    out = []
    for length, source, cluster in zip(lengths, sources, clusters):
        at = bisect_left(open_bins, length << _BIN_BITS)
        while at < len(open_bins):
            number = open_bins[at] & ((1 << _BIN_BITS) - 1)
            if not (source_maps[number] & source or cluster_maps[number] & cluster):
                break
            at += 1
        if at < len(open_bins):
            residual = (open_bins.pop(at) >> _BIN_BITS) - length
            source_maps[number] |= source
            cluster_maps[number] |= cluster
        else:
            number, residual = len(source_maps), capacity - length
            source_maps.append(source)
            cluster_maps.append(cluster)
        if residual:
            insort(open_bins, residual << _BIN_BITS | number)
        out.append(number)
    return out


def _bits(values: list) -> list[int]:
    """A bit for each value that occurs twice or more; a value that occurs once, or null, conflicts with nothing."""
    seen = Counter(v for v in values if v is not None)
    bit = {v: 1 << i for i, v in enumerate(sorted(v for v, n in seen.items() if n > 1))}
    return [bit.get(v, 0) for v in values]


def _pack(capacity: int):
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_words", "descending"), ("id", "ascending"), ("chunk", "ascending"), ("cluster", "ascending")])
        lengths = table.column("n_words").to_pylist()
        bins = np.array(best_fit(lengths, _bits(table.column("source").to_pylist()), _bits(table.column("cluster").to_pylist()), capacity))
        order = np.argsort(bins, kind="stable")
        starts = np.flatnonzero(np.diff(bins[order], prepend=-1))
        slot = np.empty(len(bins), np.int64)
        slot[order] = np.arange(len(bins)) - np.repeat(starts, np.diff(starts, append=len(bins)))
        group = table.column("grp").to_numpy()
        return pa.table({
            "id": table.column("id"), "chunk": table.column("chunk"), "start_word": table.column("start_word"),
            "n_words": table.column("n_words"), "bin_id": pa.array(group.astype(np.int64) * (1 << _BIN_BITS) + bins), "slot": pa.array(slot)})

    return pack


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("id", "source", "cluster")), pa.array(word_counts(part.column("text")))],
                ["id", "source", "cluster", "words"])


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None,
    capacity: int = CAPACITY, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``id``, ``chunk``, ``start_word``, ``n_words``, ``bin_id``, ``slot``: one row per piece of a document.

    A bin holds at most ``capacity`` words, one piece of each source and one of each duplicate cluster
    (``cluster_col``, else documents of equal text). A document longer than a bin gives several pieces, from
    ``start_word`` on. Null, blank and empty texts are one piece of no words without bin and slot. A null
    source or cluster conflicts with nothing. Repeated rows are packed each, in bins of their own by their
    equal text; null ids are packed like others. Equal lengths go by id. Extra columns play no part. An empty
    table gives an empty result.
    """
    cluster = F.xxhash64(text_col) if cluster_col is None else F.when(F.col(cluster_col).isNotNull(), F.xxhash64(cluster_col))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"), F.col(text_col).alias("text"))
    counted = written(rows.mapInArrow(_count_words, "id long, source string, cluster long, words long"), "word-counts")
    total = counted.agg(F.sum(F.ceil(F.col("words") / capacity))).first()[0] or 0
    groups = pieces(total, group_rows)
    # split a document into pieces
    chunk = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("words") / capacity).cast("int") - 1, F.lit(0))))
    cut = counted.withColumn("chunk", chunk).withColumn("start_word", F.col("chunk").cast("long") * capacity)
    cut = cut.withColumn("n_words", F.least(F.lit(capacity).cast("long"), F.col("words") - F.col("start_word")))
    # equal pieces are counted and dealt in stretches, so that no packing group gets all copies of a document
    piece = ["id", "source", "cluster", "chunk", "start_word", "n_words"]
    same = cut.filter("n_words > 0").groupBy(*piece).agg(F.count("*").alias("copies"))
    stretch = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))
    same = same.withColumn("stretch", stretch).withColumn("copies", F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("stretch") * COPIES))
    base = F.xxhash64("id", "chunk", "cluster", "n_words")
    spot = F.when(F.col("stretch") == 0, base).otherwise(F.xxhash64(base, "stretch"))
    same = same.withColumn("grp", F.pmod(spot, F.lit(groups)).cast("int")).repartition("grp")
    dealt = same.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    packed = dealt.select("grp", *piece).groupBy("grp").applyInArrow(
        _pack(capacity), "id long, chunk int, start_word long, n_words long, bin_id long, slot long")
    bare = cut.filter("n_words = 0").selectExpr("id", "chunk", "start_word", "n_words", "cast(null as long) bin_id", "cast(null as long) slot")
    return packed.union(bare)
