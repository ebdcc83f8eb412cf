"""Whitening of embeddings by cyclic Jacobi rotations of their covariance.

Vectors become integers, and each distinct one counts once. Tasks add up sums, then centred outer products, which combine
before they are shuffled; the driver gets ``dim`` squared numbers and turns the covariance by rotations in a fixed cycle
until nothing is left off the diagonal, which keeps small eigenvalues accurate. The whitening matrix goes to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import scratch

#: Steps of a unit that an entry is counted in; largest entry in them.
SCALE, MOST = 256.0, float(1 << 53)
#: An eigenvalue below this share of the largest counts as zero.
NOTHING = 1e-13
_LONG = 1 << 63


def _grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, x) of usable rows (vec_id, v): x as bytes of 16-bit integers if they fit, else of 64-bit ones behind a mark."""
    for batch in batches:
        ids, out = [], []
        for k, c in enumerate(batch.column("v")):
            if not c.is_valid or c.values.null_count or not len(c.values):
                continue
            x = np.floor(c.values.to_numpy(zero_copy_only=False).astype(float) * SCALE)
            if np.isfinite(x).all() and np.abs(x).max() <= MOST:
                ids.append(k)
                out.append(x.astype("<i2").tobytes() if np.abs(x).max() < 1 << 15 else b"\1" + x.astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(ids, pa.int64())), pa.array(out, pa.binary())], ["vec_id", "x"])


def _integers(column: pa.Array) -> np.ndarray:
    """Rows of 64-bit integers; all have the same number."""
    rows = [np.frombuffer(x, "<i2") if len(x) % 2 == 0 else np.frombuffer(x, "<i8", offset=1) for x in column.to_pylist()]
    return np.stack(rows).astype(np.int64)


def _size(x: str) -> Column:
    n = F.octet_length(x)
    return F.when(n % 2 == 0, F.floor(n / 2)).otherwise(F.floor((n - 1) / 8))


def _sums(dim: int):
    """(dim, n, total) of the rows of a task; whole numbers, kept exact as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for batch in batches:
            if batch.num_rows:
                x = _integers(batch.column("x"))
                some = x.sum(axis=0).tolist() if np.abs(x).max() < _LONG // max(1, 2 * len(x)) else x.astype(object).sum(axis=0).tolist()
                n, total = n + len(x), [a + b for a, b in zip(total, some, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array([str(t) for t in total])], ["dim", "n", "total"])

    return run


def _scatter(centred, size: int):
    """(cell, sum) of the outer products of ``centred`` rows in a task, on and above the diagonal."""
    upper = np.flatnonzero(np.triu(np.ones((size, size), bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                y = centred(batch)
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(upper), pa.array(total.ravel()[upper])], ["cell", "sum"])

    return run


def _gather(rows: DataFrame, centred, size: int) -> np.ndarray:
    """The whole matrix of summed outer products; ``size`` squared numbers reach the driver."""
    out = np.zeros(size * size)
    for r in rows.mapInArrow(_scatter(centred, size), "cell long, sum double").groupBy("cell").agg(F.sum("sum").alias("sum")).collect():
        out[r.cell] = r.sum
    out = out.reshape(size, size)
    return out + np.triu(out, 1).T


def jacobi(a: np.ndarray, most: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns), falling, of a symmetric matrix.

    A cycle meets every pair of rows once, in rounds of disjoint pairs as in a tournament, whose rotations are done together. A
    pair is left alone once its entry is nothing beside its diagonal; a cycle without a rotation ends it.
    """
    n = len(a)
    a, v = a.astype(float).copy(), np.eye(n)
    seats = list(range(n + n % 2))
    for _ in range(most):
        turned = False
        for _ in range(max(0, len(seats) - 1)):
            half = len(seats) // 2
            pairs = np.array([sorted(x) for x in zip(seats[:half], seats[: half - 1 : -1], strict=True) if max(x) < n], np.int64).reshape(-1, 2)
            p, q = pairs.T
            off, dp, dq = a[p, q], a[p, p], a[q, q]
            use = np.abs(off) > 1e-17 * np.sqrt(np.abs(dp)) * np.sqrt(np.abs(dq)) + 1e-300
            if use.any():
                turned = True
                p, q, off, dp, dq = p[use], q[use], off[use], dp[use], dq[use]
                theta = (dq - dp) / (2 * off)
                t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                for m in (a, v):  # columns
                    mp, mq = m[:, p].copy(), m[:, q].copy()
                    m[:, p], m[:, q] = c * mp - s * mq, s * mp + c * mq
                mp, mq = a[p].copy(), a[q].copy()
                a[p], a[q] = c[:, None] * mp - s[:, None] * mq, s[:, None] * mp + c[:, None] * mq
                a[p, q] = a[q, p] = 0.0
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order]


class Whitening:
    """What all rows share: count and exact sums of the fit list, components, eigenvalues and the trace."""

    def __init__(self, n: int, sums: list[int], scatter: np.ndarray, most: int):
        self.n, self.sums = n, sums
        self.mean = np.array([s / n for s in sums])
        cov = scatter / n
        self.trace = float(np.trace(cov))
        e, v = jacobi(cov)
        k = min(most, len(sums))
        self.e, v = e[:k], v[:, :k]
        lead = np.abs(v).argmax(axis=0)
        v = v * np.sign(v[lead, np.arange(k)])
        self.open = self.e > NOTHING * max(float(e[0]), 0.0)
        self.matrix = np.where(self.open, v / np.sqrt(np.where(self.open, self.e, 1.0)), 0.0)
        self.explained = [float(x / self.trace) if o else 0.0 for x, o in zip(self.e, self.open, strict=True)]

    def white(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.matrix

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S) squared; None beyond 64 bits."""
        reach = self.n * (int(np.abs(x).max()) + max(map(abs, self.sums)) // max(1, self.n) + 1)
        if x.shape[1] * reach * reach < _LONG:
            return ((x * self.n - np.array(self.sums)) ** 2).sum(axis=1).tolist()
        out = [sum((self.n * a - s) ** 2 for a, s in zip(r, self.sums, strict=True)) for r in x.tolist()]
        return [d if d < _LONG else None for d in out]


def fit(grid: DataFrame, dim: int, components: int) -> tuple[Whitening, float]:
    """The whitening of the stored rows (x), each distinct one once, and its identity error."""
    once = scratch.table(grid.select("x").distinct(), "fit")
    parts = once.mapInArrow(_sums(dim), "dim int, n long, total string").groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total"))
    got = {r.dim: (r.n, int(r.total)) for r in parts.collect()}  # a row a dimension
    n, sums = got[0][0], [got[k][1] for k in range(dim)]
    mean = np.array([s / n for s in sums])
    model = Whitening(n, sums, _gather(once, lambda b: _integers(b.column("x")) - mean, dim), components)

    k = int(model.open.sum())
    if not k:
        return model, 0.0
    shared = once.sparkSession.sparkContext.broadcast(model)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                out += shared.value.white(_integers(batch.column("x")))[:, :k].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(out)], ["dim", "total"])

    means = np.zeros(k)
    for r in once.mapInArrow(total, "dim int, total double").groupBy("dim").agg(F.sum("total").alias("total")).collect():
        means[r.dim] = r.total / n
    cov = _gather(once, lambda b: shared.value.white(_integers(b.column("x")))[:, :k] - means, k) / n
    return model, float(np.abs(cov - np.eye(k)).max())


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every usable row of (vec_id, embedding).

    A vector that is null, empty, or holds a null, non-finite or, in steps of 1/256, more than 53-bit entry gives no rows; nor does one
    with fewer entries than the longest usable vector, whose missing entries count as null. There are as many components as
    dimensions, ``components`` at most. A component without variance (all vectors equal, or on a line) has whitened and
    explained 0 and no part in the identity error. ``deviation`` is null beyond 64 bits. Rows with a null id, equal ids or equal vectors
    all get their own rows; other columns are ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch.bound_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    grid = scratch.table(rows.mapInArrow(_grid, "vec_id long, x binary"), "grid")
    dim = grid.agg(F.max(_size("x"))).first()[0]
    if dim is None:
        return spark.createDataFrame([], _OUT)
    grid = grid.where(_size("x") == dim)
    model, error = fit(grid, dim, components)
    shared, k = spark.sparkContext.broadcast(model), len(model.e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _integers(batch.column("x"))
            white, rows = m.white(x), np.repeat(np.arange(len(x)), k)
            far = pa.array(m.deviations(x), pa.int64()).take(pa.array(rows))
            columns = [batch.column("vec_id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows), m.n)), far, pa.array(white.ravel()), pa.array(np.tile(m.explained, len(x))), pa.array(np.full(len(rows), error))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return grid.mapInArrow(run, _OUT)
