"""Centroid clustering over subvector dictionaries.

Vectors of whole numbers are gathered into pages. A page splits the dimensions into blocks and stores, for each block, the
distinct subvectors that occur in it and a code per vector: nothing is lost. Neighbouring blocks are joined while that saves
work, so dimensions of few values stay alone and pages of many copies end in few wide blocks. In
each round the exact squared distance of every distinct subvector to every centroid is computed once, and a vector's
distances are sums of these, looked up by its codes. A dictionary is never larger than its page, whatever the
data, so none is broadcast.

Only the centroids and one row of sums per cluster and task leave the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.llm.store import written

#: Vectors of one page.
PAGE_ROWS = 16_384
#: Whole numbers up to this size: distances of vectors of 2^7 dimensions then fit a long.
LARGEST = 1 << 27


def vectors(column: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows with ``dims`` finite components, and floor(scale * component) of those."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dims)
    if not len(rows):
        return rows, np.empty((0, dims), np.int64)
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dims)  # null: nan
    with np.errstate(invalid="ignore", over="ignore"):
        flat = np.floor(flat * scale)
        good = (np.abs(flat) <= LARGEST).all(1)
    return rows[good], flat[good].astype(np.int64)


def encode(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Blocks of neighbouring dimensions: the distinct subvectors of each, and the one of every vector."""
    blocks = []
    for column in x.T:
        found, code = np.unique(column, return_inverse=True)
        blocks.append((found[:, None], code))
    while len(blocks) > 1:
        joined = []
        for (a, p), (b, q) in zip(blocks[::2], blocks[1::2]):
            found, code = np.unique(p * len(b) + q, return_inverse=True)
            both = np.hstack([a[found // len(b)], b[found % len(b)]])
            # a distance costs a step for each component, a vector one for each block
            joined.append([(both, code)] if both.size < a.size + b.size + len(x) else [(a, p), (b, q)])
        if all(len(j) == 2 for j in joined):
            break
        blocks = [b for j in joined for b in j] + (blocks[-1:] if len(blocks) % 2 else [])
        if any(len(j) == 2 for j in joined):
            break
    return blocks


def _small(x: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as hold them."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _pages(dims: int, scale: float, page_rows: int):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []

        def page(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
            blocks = [(_small(a), _small(code)) for a, code in encode(x)]
            return pa.RecordBatch.from_arrays([
                pa.array([ids.to_pylist()], pa.list_(pa.int64())),
                *(pa.array([v], t) for v, t in (
                    ([a.shape[1] for a, _ in blocks], pa.list_(pa.int32())), ([a.tobytes() for a, _ in blocks], pa.list_(pa.binary())),
                    ([a.itemsize for a, _ in blocks], pa.list_(pa.int32())), ([c.tobytes() for _, c in blocks], pa.list_(pa.binary())))),
            ], ["ids", "widths", "subvectors", "bytes", "codes"])

        for batch in batches:
            for at in range(0, batch.num_rows, page_rows):
                part = batch.slice(at, page_rows)
                rows, x = vectors(part.column("x"), dims, scale)
                held.append((part.column("id").take(pa.array(rows)), x))
                if sum(len(v) for _, v in held) >= page_rows:
                    ids, x = pa.concat_arrays([i for i, _ in held]), np.concatenate([v for _, v in held])
                    yield page(ids[:page_rows], x[:page_rows])
                    held = [(ids[page_rows:], x[page_rows:])]
        if sum(len(v) for _, v in held):
            yield page(pa.concat_arrays([i for i, _ in held]), np.concatenate([v for _, v in held]))

    return gather


_PAGE = "ids array<long>, widths array<int>, subvectors array<binary>, bytes array<int>, codes array<binary>"


def _blocks_of(row: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    n, out = len(row["ids"]), []
    for width, raw, size, codes in zip(row["widths"], row["subvectors"], row["bytes"], row["codes"]):
        out.append((np.frombuffer(raw, f"i{size}").astype(np.int64).reshape(-1, width), np.frombuffer(codes, f"i{len(codes) // n}")))
    return out


def nearest(blocks: list[tuple[np.ndarray, np.ndarray]], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid; ties: the smaller number."""
    total, first = np.zeros((len(blocks[0][1]), len(centroids)), np.int64), 0
    for distinct, codes in blocks:
        width = distinct.shape[1]
        part = np.zeros((len(distinct), len(centroids)), np.int64)
        for j in range(width):
            part += (distinct[:, j, None] - centroids[None, :, first + j]) ** 2
        total += part[codes]
        first += width
    best = total.argmin(1)
    return best, total[np.arange(len(best)), best]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _sums(centroids: np.ndarray):
    """Per task and cluster: vectors, and the sum of each component (as decimals, any size)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for row in _rows(batches):
            blocks = _blocks_of(row)
            best, _ = nearest(blocks, centroids)
            n += np.bincount(best, minlength=k)
            first = 0
            for distinct, codes in blocks:
                # how often each subvector is in each cluster; then whole numbers only
                cell, times = np.unique(best * len(distinct) + codes, return_counts=True)
                cluster, which = np.divmod(cell, len(distinct))
                for j in range(distinct.shape[1]):
                    np.add.at(sums[:, first + j], cluster, times * distinct[which, j])
                first += distinct.shape[1]
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(some, dims + 1), pa.int32()), pa.array(np.tile(np.arange(-1, dims), len(some)), pa.int32()),
             pa.array(np.hstack([n[some, None], sums[some]]).ravel())], ["cluster", "dim", "total"])

    return add


def _assign(centroids: np.ndarray):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            best, distance = nearest(_blocks_of(row), centroids)
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(best, pa.int32()), pa.array(distance)], ["id", "cluster", "distance"])

    return assign


def cluster_vectors(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = 40, rounds: int = 5, dims: int = 64,
    scale: float = 256.0, seed: str = "2", page_rows: int = PAGE_ROWS,
) -> DataFrame:
    """``id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid`` (array of longs) per kept vector.

    Kept are vectors of exactly ``dims`` components, none null or not finite; a component c becomes floor(scale * c). A vector
    with a number beyond 2^27 has no exact distance in a long and is left out like one that is not finite. The first centroids are the
    vectors with the smallest SHA-256 of ``seed:id`` (equal ids: the smaller vector first; rows without an id are never
    first centroids, but belong to clusters). With fewer vectors than ``clusters`` there are fewer clusters. Repeated rows
    count each; equal centroids leave the one of larger number empty, and an empty one stays as it is. Extra columns play
    no part. No kept vector: an empty result.
    """
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    pages = written(rows.mapInArrow(_pages(dims, scale, page_rows), _PAGE), "pages")
    whole = F.transform("x", lambda c: F.floor(c * F.lit(scale)))
    fits = lambda c: c.isNotNull() & (c * F.lit(scale) >= -LARGEST) & (c * F.lit(scale) < LARGEST + 1)  # noqa: E731  NaN is above all
    kept = (F.size("x") == dims) & F.forall("x", fits)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.filter(kept & F.col("id").isNotNull()).select(order.alias("h"), whole.alias("x")).orderBy("h", "x").limit(clusters).collect()
    centroids = np.array([r["x"] for r in first], np.int64).reshape(-1, dims)
    if not len(centroids):
        # there is no id to choose by, or no vector at all
        return pages.limit(0).selectExpr("0L id", "0 cluster", "0L distance", "0L cluster_inertia", "0L inertia", "array(0L) centroid")
    for _ in range(rounds):
        sums = pages.mapInArrow(_sums(centroids), "cluster int, dim int, total long")
        totals = {(r["cluster"], r["dim"]): int(r["total"]) for r in sums.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
        centroids = np.array([
            [totals[c, j] // totals[c, -1] for j in range(dims)] if (c, -1) in totals else old
            for c, old in enumerate(centroids.tolist())], np.int64)
    placed = written(pages.mapInArrow(_assign(centroids), "id long, cluster int, distance long"), "clustered")
    inertia = {r["cluster"]: int(r["d"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    about = table.sparkSession.createDataFrame(
        [(c, inertia.get(c, 0), sum(inertia.values()), x) for c, x in enumerate(centroids.tolist())],
        "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return placed.join(F.broadcast(about), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
