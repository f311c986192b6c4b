"""Whitening of embeddings on a fixed grid: principal components of unit variance, from exact sums.

Entries are laid on a grid of whole numbers, ``floor(scale * c) + offset``. The fit is over the distinct grid vectors.
Their scatter is summed by the tasks from entries centred at whole numbers next to the mean, in whole numbers, so no
order of summing changes it; the rest of the centring is done on the exact sums. What reaches the driver are sums of the
size of the scatter matrix, never rows.

The scatter is factored by a Cholesky decomposition that takes the largest remaining diagonal entry as the next pivot and
stops where nothing but rounding is left. One-sided Jacobi then works on the triangular factor itself: pairs of its
columns are rotated until all are at right angles. Their squared norms are the eigenvalues, the normalised
columns the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from spindrift.llm.rows import unused
from spindrift.session import written

#: The grid; components at most.
SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Rows whose products a task sums at once.
ROWS = 8192


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``L, order`` with ``v[order][:, order] = L @ L.T``, L lower triangular with as many columns as the rank of ``v`` (symmetric, no negative eigenvalue)."""
    a, n = v.astype(np.float64).copy(), len(v)
    order, low = np.arange(n), np.zeros((n, n))
    least = n * np.finfo(float).eps * max(0.0, a.diagonal().max(initial=0))
    for k in range(n):
        j = k + int(np.argmax(a.diagonal()[k:]))
        if a[j, j] <= least:
            return low[:, :k], order
        for m in (a, a.T, low):
            m[[k, j]] = m[[j, k]]
        order[[k, j]] = order[[j, k]]
        low[k, k] = np.sqrt(a[k, k])
        low[k + 1 :, k] = a[k + 1 :, k] / low[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(low[k + 1 :, k], low[k + 1 :, k])
    return low, order


def jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns of ``factor`` rotated in pairs until all are at right angles.

    A round takes disjoint pairs, so that all of its rotations are one array operation; a sweep of rounds takes every pair once.
    """
    m = factor.shape[1]
    x = np.pad(factor, ((0, 0), (0, m % 2)))  # with a column of zeros in odd cases
    ring = np.arange(x.shape[1])
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            i, j = ring[: len(ring) // 2], ring[::-1][: len(ring) // 2]
            a, b = x[:, i], x[:, j]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            turn = np.abs(ab) > 1e-15 * np.sqrt(aa * bb)
            if turn.any():
                turned = True
                i, j, a, b = i[turn], j[turn], a[:, turn], b[:, turn]
                z = (bb - aa)[turn] / (2 * ab[turn])
                t = np.where(z >= 0, 1, -1) / (np.abs(z) + np.hypot(1, z))
                c = 1 / np.hypot(1, t)
                x[:, i], x[:, j] = c * (a - t * b), c * (b + t * a)
            ring = np.concatenate((ring[:1], ring[-1:], ring[1:-1]))
        if not turned:
            break
    return x[:, :m]


def components_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above rounding of a covariance, falling, and unit eigenvectors as rows; the largest entry of each is positive."""
    factor, order = pivoted_cholesky(v)
    x = jacobi(factor)
    norms = np.sqrt((x * x).sum(axis=0))
    falling = np.argsort(-norms, kind="stable")
    rows = np.empty((len(norms), len(v)))
    rows[:, order] = (x[:, falling] / norms[falling]).T
    signs = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)]) if rows.size else np.ones(len(rows))
    return norms[falling] ** 2, rows * signs[:, None]


@dataclass(frozen=True)
class Whitening:
    """A fit: ``n`` vectors with exact ``sums``, ``eigenvalues`` (falling) and ``components`` (rows), ``trace`` of the covariance, and how far the
    covariance of the whitened fit list is from the identity (largest absolute entry)."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """A whole number next to the mean of each dimension, and the rest of the mean."""
        whole = [s // max(1, self.n) for s in self.sums]
        rest = [float(Fraction(s, max(1, self.n)) - w) for s, w in zip(self.sums, whole)]
        return np.array(whole, np.int64), np.array(rest)

    def project(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.centre()
        return ((x - whole) - rest) @ self.components.T / np.sqrt(self.eigenvalues)

    def deviation(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of ``(n * x - sum)^2`` of each row, exactly."""
        whole, _ = self.centre()
        rest = np.array([s - self.n * int(w) for s, w in zip(self.sums, whole)], dtype=object)
        z = x - whole
        if x.shape[1] * (float(self.n) * (float(np.abs(z).max(initial=0)) + 1)) ** 2 < 2**63:
            return ((self.n * z - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
        return ((self.n * z.astype(object) - rest) ** 2).sum(axis=1).tolist()


def _grid_of(lists: pa.Array, dims: int | None, scale: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are whole vectors (of ``dims`` entries, none null or not finite; None: any number above zero), and their grid vectors in one row each."""
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    flat = lists.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = ~np.isfinite(values)
    row = np.repeat(np.arange(len(lists)), sizes)
    good = (sizes > 0) & (np.bincount(row, bad, len(lists)) == 0)
    if dims is not None:
        good &= sizes == dims
    grid = np.floor(scale * values[good[row]]) + offset
    if len(grid) and np.abs(grid).max() >= 2**53:
        raise ValueError("an entry of a vector is too large for the grid")
    return good, grid.astype(np.int64)


def on_grid(vectors: DataFrame, vector_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``x``: the grid vectors of the rows whose vector is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, grid = _grid_of(batch.column(0), None, scale, offset)
            sizes = np.asarray(batch.column(0).value_lengths().fill_null(0))[good]
            ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(grid))], names=["x"])

    return vectors.select(vector_col).mapInArrow(run, "x array<long>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _products(z: np.ndarray) -> np.ndarray:
    """``z.T @ z`` of whole numbers, exactly."""
    if z.size and float(np.abs(z).max()) ** 2 * len(z) >= 2**53:
        return z.astype(object).T @ z.astype(object)
    f = z.astype(np.float64)  # sums stay below 2^53, where floating point is exact
    return (f.T @ f).astype(np.int64).astype(object)


def _summed(fit: DataFrame, f, square: int, kind: str) -> np.ndarray:
    """The sum over all rows of a symmetric matrix ``f(x)`` of a block of grid vectors: one matrix a task, added entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch.column(0))
            for lo in range(0, len(x), ROWS):
                part = f(x[lo : lo + ROWS])
                total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(square)
            said = [str(v) for v in total[i, j].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(said, pa.string())], names=["i", "j", "v"])

    parts = fit.select("x").mapInArrow(run, "i long, j long, v string")
    out = np.zeros((square, square), object)
    for r in parts.groupBy("i", "j").agg(F.sum(F.col("v").cast(kind)).alias("v")).collect():  # square^2 / 2 rows
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def fitted(vectors: DataFrame, vector_col: str = "embedding", most: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> Whitening:
    """The whitening of the distinct grid vectors of ``vectors``.

    Rows whose vector is null, empty or holds null or non-finite entries are left out. Of vectors of several lengths the
    length with the most distinct vectors counts (ties: the longest). Directions without variance give no component, so one
    vector, or none, gives none at all. The distinct vectors are a written table: equal ones meet in a shuffle after each task reduced its own.
    """
    x = on_grid(vectors, vector_col, scale, offset)
    fit = written(x.groupBy("x").agg(F.count("*").alias("times")), "op12-fit")
    lengths = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return Whitening(0, (), np.zeros(0), np.zeros((0, 0)), 0.0, 0.0)
    d, n = lengths[0]["d"], lengths[0]["count"]
    fit = fit.filter(F.size("x") == d)
    sums = fit.agg(*(F.sum(F.col("x")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(d))).first()
    sums = tuple(int(s) for s in sums)
    whole = np.array([s // n for s in sums], np.int64)
    scatter = _summed(fit, lambda b: _products(b - whole), d, "decimal(38,0)")
    rest = [s - n * int(w) for s, w in zip(sums, whole)]  # sums of the entries centred at whole numbers
    v = np.array([[float(Fraction(n * int(scatter[i, j]) - rest[i] * rest[j], n * n)) for j in range(d)] for i in range(d)])
    values, rows = components_of(v)
    model = Whitening(n, sums, values[:most], rows[:most], float(np.trace(v)), 0.0)
    k = len(model.eigenvalues)
    if not k:
        return model

    def seen(block: np.ndarray) -> np.ndarray:
        w = model.project(block)
        w = np.column_stack((w, np.ones(len(w))))
        return w.T @ w

    got = _summed(fit, seen, k + 1, "double").astype(np.float64) / n
    off = got[:k, :k] - np.outer(got[:k, k], got[:k, k]) - np.eye(k)
    return Whitening(n, sums, model.eigenvalues, model.components, model.trace, float(np.abs(off).max()))


def whitened(
    vectors: DataFrame, model: Whitening, vector_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET, out: str = "whitened", deviation: str = "deviation"
) -> DataFrame:
    """The rows of ``vectors`` with a whole vector, with ``whitened`` (array of double, one entry a component) and ``deviation`` (decimal, exact).

    Repeated rows come back repeated; rows without a whole vector of the fit's length are left out. The new columns get underscores where
    ``vectors`` has columns of these names.
    """
    out, deviation, raw = unused(vectors.columns, out, deviation, "raw")
    n, d, k = len(vectors.columns), len(model.sums), len(model.eigenvalues)
    names = [*vectors.columns, out, deviation]
    schema = T.StructType([*vectors.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType(), False)), T.StructField(deviation, T.DecimalType(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for batch in batches:
            good, grid = _grid_of(batch.column(n), d, scale, offset)
            own = batch.filter(pa.array(good))
            x = grid.reshape(len(own), d)
            w = model.project(x) if k else np.zeros((len(own), 0))
            ends = pa.array(np.arange(len(own) + 1) * k, pa.int32())
            exact = pa.array([Decimal(v) for v in model.deviation(x)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([*own.columns[:n], pa.ListArray.from_arrays(ends, pa.array(w.reshape(-1))), exact], names=names)

    return vectors.withColumn(raw, F.col(vector_col)).mapInArrow(run, schema)


def digest(rows: DataFrame, model: Whitening, id_col: str = "vec_id") -> DataFrame:
    """One row per row of ``rows`` and component, numbered from 1."""
    share = F.array(*(F.lit(float(e / model.trace)) for e in model.eigenvalues)).cast("array<double>")
    flat = rows.select(id_col, "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return flat.select(
        id_col, (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"),
        "whitened", F.get(share, F.col("k")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
