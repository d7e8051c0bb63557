"""Embedding near-duplicates by a pivot-permutation index.

Reference points (pivots) are picked from a bounded sample so that no two are alike. A vector is described by its
``NEAREST`` pivots in order of nearness; two vectors are candidates if they share ``SHARED`` of them. Inverted
lists find exactly those: with pivots ordered by rarity, two sets of 8 that share 4 also share l of
their first 4 + l, so lists are kept for combinations of l of these. l grows with the table (its lists
stay short) and changes nothing in what is found. A list counts shared pivots, verifies by cosine in
double precision, and counts a pair only in the first list that both are on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.llm.components import components
from harvestry.llm.store import written

THRESHOLD = 0.93
PIVOTS = 128
#: Vectors of the sample that pivots are picked from.
SAMPLE = 2048
#: Pivots are less similar to each other than this, so that a large group of near copies is not split by many of them.
APART = 0.7
NEAREST, SHARED = 8, 4
#: Expected vectors of a list, above which lists of one more pivot are used.
LIST_ROWS = 500
#: Vectors of a block; longer lists are compared block by block.
BLOCK = 1024


def pick_pivots(vectors: np.ndarray, wanted: int = PIVOTS) -> np.ndarray:
    """Unit vectors, each less than ``APART`` similar to those before it."""
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    chosen = np.empty((0, units.shape[1]))
    for u in units:
        if len(chosen) == wanted:
            break
        if not len(chosen) or (chosen @ u).max() < APART:
            chosen = np.vstack([chosen, u])
    return chosen


def _nearest(pivots: dict[int, np.ndarray]):
    """The nearest pivots of each vector, in order; a vector of another dimension than all samples has none."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("vec").to_pylist():
                x = np.array(v, np.float64)
                own = pivots[len(v)]
                near = np.argsort(-(own @ (x / np.linalg.norm(x))), kind="stable")[:NEAREST]
                out.append(near.astype(np.int32).tolist())
            yield batch.append_column("nearest", pa.array(out, pa.list_(pa.int32())))

    return describe


def _lists(rank: dict[tuple[int, int], int], depth: int):
    """Rows of the inverted lists: a key for each ``depth`` of the first pivots by rarity, and both bit sets."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, label, copies, v, near in zip(*(batch.column(c).to_pylist() for c in ("rep", "label", "copies", "vec", "nearest"))):
                order = sorted(rank[len(v), p] for p in near)
                prefix = order[: max(len(order) - SHARED + depth, depth)]
                raw = np.array(v, np.float64).tobytes()
                bits = (_bytes(order), _bytes(prefix))
                for key in combinations(prefix, min(depth, len(prefix))):
                    out.append((label, len(v), _bytes(key), i, copies, raw, *bits))
                if len(out) >= 5000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return spread


def _bytes(ranks) -> bytes:
    return sum(1 << r for r in ranks).to_bytes(PIVOTS // 8, "little")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    names = ["label", "dim", "key", "id", "copies", "vec", "near", "prefix"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _bit_sets(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, PIVOTS // 64)


def _compare(threshold: float):
    def compare(table: pa.Table) -> pa.Table:
        """Links of one list, or of two blocks of it, counted per vector, and one spanning link of each."""
        empty = pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        side = table.column("side").to_numpy()
        if table.num_rows < 2:
            return empty
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        x = np.frombuffer(b"".join(table.column("vec").to_pylist()), np.float64).reshape(len(ids), -1)
        norm = np.sqrt((x * x).sum(1))
        near, prefix = _bit_sets(table.column("near")), _bit_sets(table.column("prefix"))
        key = _bit_sets(table.column("key"))[0]
        # the bits up to the last one of the key
        upto = np.frombuffer(((1 << int.from_bytes(key.tobytes(), "little").bit_length()) - 1).to_bytes(PIVOTS // 8, "little"), np.uint64)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return empty
        found_a, found_b = [], []
        need = min(SHARED, int(np.bitwise_count(near).sum(1).max()))
        for part in np.array_split(left, max(1, len(left) // 256)):
            shared = np.bitwise_count(near[part][:, None, :] & near[right][None]).sum(2)
            first = (((prefix[part][:, None, :] & prefix[right][None]) & upto) == key).all(2)
            a, b = np.nonzero((shared >= need) & first)
            a, b = part[a], right[b]
            once = (ids[a] < ids[b]) if table.column("i")[0] == table.column("j")[0] else np.ones(len(a), bool)
            a, b = a[once], b[once]
            for lo in range(0, len(a), 100_000):
                p, q = a[lo : lo + 100_000], b[lo : lo + 100_000]
                close = np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q]) >= threshold
                found_a.append(p[close])
                found_b.append(q[close])
        a, b = (np.concatenate(f) if f else np.empty(0, np.int64) for f in (found_a, found_b))
        if not len(a):
            return empty
        # rows of both sides by id
        own, at = np.unique(ids, return_inverse=True)
        weight = np.zeros(len(own), np.int64)
        weight[at] = copies
        a, b = at[a], at[b]
        n = np.bincount(a, weight[b], len(own)) + np.bincount(b, weight[a], len(own))
        root = np.arange(len(own))
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = np.minimum(new, new[new])
            if (new == root).all():
                break
            root = new
        some = n > 0
        return pa.table({"id": pa.array(own[some]), "n": pa.array(n[some].astype(np.int64)), "root": pa.array(own[root[some]])})

    return compare


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD,
) -> DataFrame:
    """``id``, ``n_links``, ``component_id``, ``kept`` per input row.

    Vectors of equal label, not null, and equal dimension link at a cosine of ``threshold``. Null, empty and zero
    vectors and those with null or non-finite components link with nothing, nor do rows without an id. Equal
    vectors of a label are one class that is searched once and counted by its rows; rows that share an id are
    linked through it and each count the other rows. Extra columns play no part. An empty table gives an empty
    result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    usable = "id is not null and label is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)"
    good = written(rows.filter(usable), "vectors")
    classes = good.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = written(classes.select("label", "vec", "rep", "copies"), "vector-classes")
    # the pivots: a bounded sample by hash, of each dimension
    sizes = {r["dim"]: r["n"] for r in classes.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).collect()}
    pivots = {}
    for dim in sorted(sizes):
        sample = classes.filter(F.size("vec") == dim).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vec").collect()
        pivots[dim] = pick_pivots(np.array([r["vec"] for r in sample], np.float64))
    described = written(classes.mapInArrow(_nearest(pivots), "label long, vec array<double>, rep long, copies long, nearest array<int>"), "described")
    used = described.select(F.size("vec").alias("dim"), F.explode("nearest").alias("p")).groupBy("dim", "p").agg(F.count("*").alias("n"))
    rank: dict[tuple[int, int], int] = {}
    for dim, p, _ in sorted(((r["dim"], r["p"], r["n"]) for r in used.collect()), key=lambda r: (r[0], r[2], r[1])):
        rank[dim, p] = sum(d == dim for d, _ in rank)
    most = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    base = NEAREST - SHARED
    depth = next((d for d in range(1, SHARED) if most * math.comb(base + d, d) / math.comb(PIVOTS, d) <= LIST_ROWS), SHARED)
    lists = described.mapInArrow(_lists(rank, depth), "label long, dim int, key binary, id long, copies long, vec binary, near binary, prefix binary")
    lists = written(lists, "pivot-lists")
    keys = lists.groupBy("label", "dim", "key").agg(F.count("*").alias("c")).filter("c > 1")
    lists = lists.join(keys.select("label", "dim", "key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), ["label", "dim", "key"])
    lists = lists.withColumn("own", F.pmod(F.hash("id"), "blocks")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    carried = ["label", "dim", "key", "id", "copies", "vec", "near", "prefix"]
    # of two blocks i <= j, those of i stand on side 0 and those of j on side 1
    first = lists.filter("o >= own").select(*carried, F.col("own").alias("i"), F.col("o").alias("j"), F.lit(0).alias("side"))
    second = lists.filter("o <= own").select(*carried, F.col("o").alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"))
    found = first.union(second).groupBy("label", "dim", "key", "i", "j").applyInArrow(_compare(threshold), "id long, n long, root long")
    found = written(found, "links")
    member = good.join(classes, ["label", "vec"]).select("id", "label", "rep", "copies")
    member = written(member, "members")
    links = found.select(F.col("id").alias("a"), F.col("root").alias("b")).union(member.select("id", "rep").distinct())
    groups = components(links)
    counts = found.groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", "rep")
    # a class is named by its label and rep; one id may stand in several labels
    per_row = member.join(counts, "rep", "left").select("id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rest = rows.filter(f"not coalesce({usable}, false)").select("id", F.lit(0).cast("long").alias("n_links"))
    out = per_row.union(rest).join(groups, "id", "left").withColumn("component_id", F.coalesce("component", "id"))
    return out.select("id", "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
