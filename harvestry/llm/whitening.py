"""Embedding whitening by Jacobi-Davidson.

The covariance matrix is never formed. It is applied to a block of vectors by one Spark job: each task centres its
rows and returns the sum of row times (row times block). On the driver, on matrices of as many rows as there are
dimensions, a search space is kept; Rayleigh-Ritz in it gives approximate components, and those whose residual has reached
double precision are locked, from the largest eigenvalue down. For the others the correction
equation, projected against all locked and current components, is solved roughly by MINRES, for all of them at once so that each
step costs one job; the solutions extend the search space.

The numbers of the rows are whole: n * x - S is exact, so centring rounds once. A constant added to every number changes
none of the results, so none is added.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.llm.store import written

COMPONENTS = 16
SCALE = 64.0
#: Vectors with whole numbers beyond this size are left out.
LARGEST = 1 << 30
#: Rows summed in one matrix product, and sums that one task adds up.
ROWS, FAN_IN = 512, 256
INNER, MAX_ROUNDS = 6, 200


# rows as whole numbers ---------------------------------------------------------------------------------------------

def whole_rows(column: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows with ``dims`` finite entries, and floor(scale * entry) of those, as longs."""
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


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row in as few bytes as hold its numbers; equal rows give equal bytes."""
    low, high = x.min(1, initial=0), x.max(1, initial=0)
    out: list[bytes] = [b""] * len(x)
    done = np.zeros(len(x), bool)
    for kind in (np.int8, np.int16, np.int32, np.int64):
        fits = ~done & (low >= np.iinfo(kind).min) & (high <= np.iinfo(kind).max)
        for i, row in zip(np.flatnonzero(fits).tolist(), x[fits].astype(kind)):
            out[i] = row.tobytes()
        done |= fits
    return out


def _unpacked(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of packed numbers, as longs, in an order of their own."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    parts = []
    for size in np.unique(sizes):
        raw = b"".join(column.filter(pa.array(sizes == size)).to_pylist())
        parts.append(np.frombuffer(raw, f"i{size // dims}").reshape(-1, dims).astype(np.int64))
    return np.concatenate(parts) if parts else np.empty((0, dims), np.int64)


def _fit_rows(dims: int, scale: float):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                _, x = whole_rows(batch.column("x").slice(at, 4096), dims, scale)
                yield pa.RecordBatch.from_arrays([pa.array(_packed(x), pa.binary())], ["x"])

    return pack


# sums over all rows ------------------------------------------------------------------------------------------------

class FitList:
    """Rows of packed numbers, and sums over all of them."""

    def __init__(self, rows: DataFrame, dims: int) -> None:
        self.rows, self.dims, self.tasks = rows, dims, rows.rdd.getNumPartitions()

    def total(self, part: Callable[[np.ndarray], np.ndarray], kind: type = np.float64) -> np.ndarray:
        """Sum of ``part`` of at most ``ROWS`` rows, as longs. Sums of many tasks are added up by fewer tasks first."""
        dims = self.dims

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = [part(np.empty((0, dims), np.int64))]
            for batch in batches:
                x = _unpacked(batch.column("x"), dims)
                found += [part(x[at : at + ROWS]) for at in range(0, len(x), ROWS)]
                if len(found) > 64:
                    found = [np.sum(found, 0)]
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(found, 0).astype(kind).tobytes()], pa.binary())], ["part"])

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = [np.frombuffer(raw, kind) for batch in batches for raw in batch.column("part").to_pylist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([np.sum(found, 0).tobytes()], pa.binary())], ["part"])

        sums, tasks = self.rows.mapInArrow(each, "part binary"), self.tasks
        while tasks > FAN_IN:
            tasks = -(-tasks // FAN_IN)
            sums = sums.repartition(tasks).mapInArrow(add_up, "part binary")
        like = part(np.empty((0, dims), np.int64))
        return np.sum([like.ravel().astype(kind), *(np.frombuffer(r["part"], kind) for r in sums.collect())], 0).reshape(like.shape)


# eigenvectors ------------------------------------------------------------------------------------------------------

def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what ``block`` adds to the columns of ``against``."""
    for _ in range(2):
        block = block - against @ (against.T @ block)
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 0] / size[size > 0]
        if not block.shape[1]:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10 * s[0]]
    block = block - against @ (against.T @ block)
    return np.linalg.qr(block)[0]


def minres(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of a symmetric system for each column of ``right``, which all share each product."""
    x, k = np.zeros_like(right), right.shape[1]
    beta = np.linalg.norm(right, axis=0)
    scale = beta.copy()
    v_old, v = np.zeros_like(right), right / np.where(beta > 0, beta, 1)
    d_old, d_older = np.zeros_like(right), np.zeros_like(right)
    c_old, s_old, c, s = np.ones(k), np.zeros(k), np.ones(k), np.zeros(k)
    rest, last = beta.copy(), np.zeros(k)
    for _ in range(steps):
        w = apply(v) - v_old * last
        alpha = (w * v).sum(0)
        w = w - v * alpha
        after = np.linalg.norm(w, axis=0)
        # the two rotations before, then a new one that ends the column of the tridiagonal matrix
        r3 = s_old * last
        r2 = s * alpha + c * c_old * last
        r1 = c * alpha - s * c_old * last
        norm = np.hypot(r1, after)
        live = (norm > 1e-14 * np.maximum(np.abs(alpha) + after, 1e-300)) & (np.abs(rest) > 1e-14 * scale)
        safe = np.where(live, norm, 1)
        c_new, s_new = np.where(live, r1 / safe, 1), np.where(live, after / safe, 0)
        d = np.where(live, (v - d_old * r2 - d_older * r3) / safe, 0)
        x += d * (c_new * rest)
        rest = np.where(live, -s_new * rest, 0)
        v_old, v = v, np.where(after > 0, w / np.where(after > 0, after, 1), 0)
        d_older, d_old, last = d_old, d, after
        c_old, s_old, c, s = c, s, c_new, s_new
        if not live.any():
            break
    return x


def leading_eigenvectors(product: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, inner: int = INNER) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric positive matrix, falling, and their unit eigenvectors as columns.

    ``product`` applies the matrix to a block of columns. Residuals end at a few roundings of the largest eigenvalue.
    """
    wanted = min(wanted, dims)
    room = min(dims, 4 * wanted + 8)
    locked, values = np.empty((dims, 0)), np.empty(0)
    basis = _orthonormal(np.random.Generator(np.random.PCG64(11)).normal(size=(dims, min(dims, wanted + 4))), locked)
    image, best = product(basis), np.inf
    for _ in range(MAX_ROUNDS):
        small = basis.T @ image
        theta, y = np.linalg.eigh((small + small.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        basis, image = basis @ y, image @ y
        left = wanted - locked.shape[1]
        residual = image - basis * theta
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        top = max(values[0] if len(values) else 0.0, float(theta[0]), 0.0)
        close = 4 * np.finfo(float).eps * np.sqrt(dims) * top
        # with nothing left to search, what remains is rounding
        full = locked.shape[1] + basis.shape[1] == dims
        ready = 0
        while ready < min(left, basis.shape[1]) and (size[ready] <= close or full):
            ready += 1
        if ready:
            locked, values = np.hstack([locked, basis[:, :ready]]), np.append(values, theta[:ready])
            basis, image, theta, residual, size = basis[:, ready:], image[:, ready:], theta[ready:], residual[:, ready:], size[ready:]
            left -= ready
        if not left:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        if room < dims and basis.shape[1] + left > room and basis.shape[1] > left + 4:
            keep = left + 4
            basis, image, theta, residual = (m[..., :keep] for m in (basis, image, theta, residual))
        now = basis[:, :left]
        held = np.hstack([locked, now])

        def projected(t: np.ndarray) -> np.ndarray:
            t = t - held @ (held.T @ t)
            t = product(t) - t * theta[:left][: t.shape[1]]
            return t - held @ (held.T @ t)

        right = -residual[:, :left]
        more = minres(projected, right - held @ (held.T @ right), inner)
        new = _orthonormal(more, np.hstack([locked, basis]))
        if not new.shape[1]:
            # the equations give nothing new: search on at random
            new = _orthonormal(np.random.Generator(np.random.PCG64(len(values))).normal(size=(dims, left)), np.hstack([locked, basis]))
        basis, image = np.hstack([basis, new]), np.hstack([image, product(new)])
    raise RuntimeError(f"{locked.shape[1]} of {wanted} components after {MAX_ROUNDS} rounds")


# the operator ------------------------------------------------------------------------------------------------------

def _whiten(dims: int, scale: float, n: int, sums: np.ndarray, axes: np.ndarray, e: np.ndarray, explained: np.ndarray, error: float):
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(e)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                rows, x = whole_rows(part.column("x"), dims, scale)
                centred = x * n - sums
                reach = n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0))
                # squares that a long may not hold go on as whole numbers of any size
                exact = centred if reach * reach * dims < 1 << 63 else x.astype(object) * n - sums.astype(object)
                deviation = pa.array((exact * exact).sum(1).tolist(), pa.decimal128(38, 0))
                y = (exact.astype(np.float64) / n) @ axes / np.sqrt(e)
                each, m = pa.array(np.repeat(np.arange(len(rows)), k)), len(rows)
                yield pa.RecordBatch.from_arrays([
                    part.column("id").take(pa.array(rows)).take(each), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, n, np.int64)), deviation.take(each), pa.array(y.ravel()), pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error))], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return project


_OUT = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: float = SCALE,
    dims: int | None = None,
) -> DataFrame:
    """``id``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error`` per kept row and component.

    An entry c becomes x = floor(scale * c). Kept are vectors of ``dims`` entries (default: the most frequent length, of
    equally frequent ones the largest), none null or not finite; one with a number beyond 2^30 is left out, too. The fit
    list has each distinct x once: n vectors with sums S and covariance V (divisor n). ``deviation`` is the exact sum of
    (n * x - S)^2; ``whitened`` is x - S / n projected on the unit eigenvector of V over the root of its eigenvalue,
    ``explained`` that eigenvalue over the trace; ``identity_error`` the largest entry of the covariance of ``whitened`` over the
    fit list less the identity. The largest entry of an eigenvector is positive. Directions without variance (an
    eigenvalue within rounding of zero) are no components: fewer distinct vectors than dimensions give fewer of
    them, and one vector, or an empty table, gives no row. Repeated rows and null ids are rows like others; extra
    columns play no part.
    """
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    if dims is None:
        usual = rows.filter("x is not null").groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        dims = usual["d"] if usual else 0
    empty = table.sparkSession.createDataFrame([], _OUT)
    if not dims:
        return empty
    fit = FitList(written(rows.select("x").mapInArrow(_fit_rows(dims, scale), "x binary").distinct(), "fit-list"), dims)
    counted = fit.total(lambda x: np.append(x.sum(0), len(x)), np.int64)
    sums, n = counted[:-1], int(counted[-1])
    if n < 2:
        return empty

    def centred(x: np.ndarray) -> np.ndarray:
        return (x * n - sums).astype(np.float64) / n

    def product(block: np.ndarray) -> np.ndarray:
        return fit.total(lambda x: (c := centred(x)).T @ (c @ block)) / n

    trace = float(fit.total(lambda x: (centred(x) ** 2).sum(0)).sum()) / n
    e, axes = leading_eigenvectors(product, dims, components)
    some = e > dims * np.finfo(float).eps * e[0]
    e, axes = e[some], axes[:, some]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(len(e))])
    mean = fit.total(lambda x: (centred(x) @ axes / np.sqrt(e)).sum(0)) / n
    moments = fit.total(lambda x: (w := centred(x) @ axes / np.sqrt(e) - mean).T @ w) / n
    error = float(np.abs(moments - np.eye(len(e))).max())
    return rows.mapInArrow(_whiten(dims, scale, n, sums, axes, e, e / trace, error), _OUT)
