"""Embedding whitening: integer vectors, centred covariance, leading eigenvectors, projection.

Each entry c of a vector becomes x = floor(256 * c), a long. The fit list holds each distinct x once;
its sums, its covariance (divisor n, centred before multiplying) and the check of the result are
sums over Spark partitions. Only sums of the size of one covariance reach the driver, which finds the
leading eigenvectors: Householder reflections to a tridiagonal matrix, bisection on Sturm counts for
eigenvalues, inverse iteration with reorthogonalisation inside clusters for vectors. The components
go to the tasks with the projection; their size is that of k vectors.

Defined results for odd input: vectors that are null, empty, or hold null or non-finite entries are
left out, and so are vectors whose length is not the commonest one among distinct vectors (of equally
common lengths the largest counts); entries beyond a long saturate. Components with an eigenvalue of
zero (by rounding) do not exist, so fewer than k may come back, or none for one distinct vector.
Repeated rows each get their rows; a null key is a key. Other columns are not returned.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlumen.session import stage

EPS = np.finfo(float).eps
WIDE = pa.decimal128(38, 0)


@dataclasses.dataclass(frozen=True)
class Whitening:
    """A fitted whitening: sums of the fit list, unit components in rows, eigenvalues, shares."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float | None

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(float) - self.mean()) @ self.components.T / np.sqrt(self.eigenvalues)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Exact sums of (n * x - sums) ** 2; in Python numbers where a long might not hold them."""
        most = self.n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, self.sums))
        if most * most * len(self.sums) < 1 << 63:
            return ((x * self.n - np.array(self.sums)) ** 2).sum(1).tolist()
        return [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]


def integers(vector: Column) -> Column:
    """floor(256 * c) of all entries as longs; null where the vector takes no part."""
    whole = F.size(vector) > 0
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(whole & finite, F.transform(vector, lambda c: F.floor(c.cast("double") * 256)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield _matrix(batch["x"])


def column_sums(x: np.ndarray) -> list[int]:
    """Exact sums of columns of longs, halves of 32 bits apart."""
    high, low = x >> 32, x & 0xFFFFFFFF
    return [(int(h) << 32) + int(s) for h, s in zip(high.sum(0), low.sum(0))]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for x in _batches(batches):
        own = [len(x), *column_sums(x)]
        total = own if total is None else [a + b for a, b in zip(total, own)]
    if total is not None:
        part = pa.array([[Decimal(v) for v in total]], pa.list_(WIDE))
        yield pa.RecordBatch.from_arrays([part], ["part"])


def _products(mean: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(mean), len(mean)))
        for x in _batches(batches):
            y = x.astype(float) - mean
            total += y.T @ y
        rows = pa.array(np.arange(len(mean)), pa.int32())
        yield pa.RecordBatch.from_arrays([rows, pa.array(list(total), pa.list_(pa.float64()))], ["i", "part"])

    return run


def _spread(model: Whitening):
    """Of each task one row: count, mean and centred products of its whitened vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for x in _batches(batches):
            w = model.whitened(x)
            parts.append((float(len(w)), w.mean(0), (w - w.mean(0)).T @ (w - w.mean(0))))
        if parts:
            n, mean, products = merged(parts)
            row = pa.array([[n, *mean, *products.ravel()]], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([row], ["part"])

    return run


def merged(parts: list[tuple[float, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, mean and products about the mean of parts that are centred on their own means."""
    counts = np.array([p[0] for p in parts])
    means = np.array([p[1] for p in parts])
    mean = (counts[:, None] * means).sum(0) / counts.sum()
    off = means - mean
    return counts.sum(), mean, sum(p[2] for p in parts) + (off * counts[:, None]).T @ off


def fit(df: DataFrame, vector: str = "embedding", k: int = 4) -> Whitening | None:
    """Whitening of the distinct integer vectors of ``df``; None if there is none."""
    valid = df.select(integers(F.col(vector)).alias("x")).filter("x is not null")
    listed = stage(valid.distinct(), "fit-list")
    commonest = listed.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if commonest is None:
        return None
    listed = listed.filter(F.size("x") == commonest["d"])
    total = (listed.mapInArrow(_sums, "part array<decimal(38,0)>").select(F.posexplode("part").alias("i", "v"))
             .groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect())
    n, *sums = [int(r["v"]) for r in total]
    model = Whitening(n, sums, np.zeros((0, len(sums))), np.zeros(0), np.zeros(0), None)
    cells = (listed.mapInArrow(_products(model.mean()), "i int, part array<double>")
             .select("i", F.posexplode("part").alias("j", "v"))
             .groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow())
    covariance = np.zeros((len(sums), len(sums)))
    covariance[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["v"].to_numpy() / n
    values, vectors = leading(covariance, k)
    model = dataclasses.replace(
        model, components=vectors, eigenvalues=values, explained=values / max(np.trace(covariance), 1e-300))
    if not len(values):
        return model
    parts = [np.array(r["part"]) for r in listed.mapInArrow(_spread(model), "part array<double>").collect()]
    m = len(values)
    spread = merged([(p[0], p[1:m + 1], p[m + 1:].reshape(m, m)) for p in parts])
    return dataclasses.replace(model, identity_error=float(np.abs(spread[2] / spread[0] - np.eye(m)).max()))


def project(df: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each vector of ``df`` and component, with the key of the vector's row.

    ``deviation`` is exact, as a decimal of 38 digits (null beyond them).
    """
    kept = (df.select(F.col(key).alias("key"), integers(F.col(vector)).alias("x"))
            .filter(F.size("x") == len(model.sums)))
    m = len(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not m:
                continue
            x = _matrix(batch["x"])
            deviation = [Decimal(v) if v < 10 ** 38 else None for v in model.deviation(x)]
            row = np.repeat(np.arange(len(x)), m)
            yield pa.RecordBatch.from_arrays([
                batch["key"].take(pa.array(row)),
                pa.array(np.tile(np.arange(1, m + 1), len(x)), pa.int32()),
                pa.array(np.full(len(row), model.n), pa.int64()),
                pa.array(deviation, WIDE).take(pa.array(row)),
                pa.array(model.whitened(x).ravel()),
                pa.array(np.tile(model.explained, len(x))),
                pa.array(np.full(len(row), model.identity_error)),
            ], ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = kept.schema["key"].dataType.simpleString()
    return kept.mapInArrow(
        run, f"key {kind}, component int, n long, deviation decimal(38,0), whitened double, "
             "explained double, identity_error double").withColumnRenamed("key", key)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 4) -> DataFrame:
    """Rows of ``project`` with a whitening fitted on ``df`` itself; none without vectors."""
    model = fit(df, vector, k)
    if model is None:
        model = Whitening(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0), None)
    return project(df, model, key, vector)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the Householder vectors that make a symmetric matrix tridiagonal."""
    a, reflectors = matrix.copy(), []
    for j in range(len(a) - 2):
        v = a[j + 1:, j].copy()
        length = np.linalg.norm(v)
        if length > 0:
            v /= length
            v[0] += 1.0 if v[0] >= 0 else -1.0
            v /= np.linalg.norm(v)
            rest = a[j + 1:, j + 1:]
            p = rest @ v
            w = 2 * (p - (v @ p) * v)
            rest -= np.outer(v, w) + np.outer(w, v)
            a[j + 1:, j] -= 2 * (v @ a[j + 1:, j]) * v
        reflectors.append(v)
    return np.diagonal(a).copy(), np.diagonal(a, -1).copy(), reflectors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, points: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each point: negative pivots of the shifted matrix."""
    floor = EPS * EPS + EPS * np.abs(off).max(initial=0)
    pivot, counts = np.ones_like(points), np.zeros(len(points), int)
    for i, value in enumerate(diagonal):
        square = off[i - 1] ** 2 if i else 0.0
        pivot = value - points - square / pivot
        pivot = np.where(np.abs(pivot) < floor, -floor, pivot)
        counts += pivot < 0
    return counts


def largest_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection on Sturm counts."""
    reach = np.zeros(len(diagonal))
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    margin = EPS * len(diagonal) * np.abs(diagonal).max() + 1e-300
    low = np.full(k, (diagonal - reach).min() - margin)
    high = np.full(k, (diagonal + reach).max() + margin)
    wanted = len(diagonal) - np.arange(k)
    for _ in range(120):
        middle = (low + high) / 2
        below = sturm_counts(diagonal, off, middle) >= wanted
        low, high = np.where(below, low, middle), np.where(below, middle, high)
        if (high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high))).all():
            break
    return np.maximum.accumulate(((low + high) / 2)[::-1])[::-1]


def solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """Solve (T - shift) z = right by elimination with row exchanges; tiny pivots are kept off zero."""
    n = len(diagonal)
    tiny = EPS * max(np.abs(diagonal).max(), np.abs(off).max(initial=0), 1e-300)
    main, upper, second = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n
    z = right.tolist()
    for i in range(n - 1):
        lower = off[i]
        if abs(lower) > abs(main[i]):
            ratio = main[i] / lower
            main[i], upper[i], second[i], main[i + 1], upper[i + 1], z[i], z[i + 1] = (
                lower, main[i + 1], upper[i + 1], upper[i] - ratio * main[i + 1], -ratio * upper[i + 1],
                z[i + 1], z[i] - ratio * z[i + 1])
        else:
            if abs(main[i]) < tiny:
                main[i] = tiny
            ratio = lower / main[i]
            main[i + 1] -= ratio * upper[i]
            z[i + 1] -= ratio * z[i]
    if abs(main[-1]) < tiny:
        main[-1] = tiny
    for i in range(n - 1, -1, -1):
        tail = (upper[i] * z[i + 1] if i + 1 < n else 0.0) + (second[i] * z[i + 2] if i + 2 < n else 0.0)
        z[i] = (z[i] - tail) / main[i]
    return np.array(z)


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit vectors of falling eigenvalues; those of a cluster are made orthogonal at each step."""
    near = 1e-3 * (np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0))
    apart = 10 * EPS * np.abs(values).max()
    vectors, first, shift = np.zeros((len(values), len(diagonal))), 0, None
    for i, value in enumerate(values):
        if i and values[i - 1] - value > near:
            first = i
        shift = min(value, shift - apart) if i > first else value
        z = np.random.default_rng(i).uniform(0.5, 1.0, len(diagonal))
        for _ in range(5):
            z = solve_shifted(diagonal, off, shift, z / np.linalg.norm(z))
            for _ in range(2):
                z = z / np.abs(z).max()
                z -= vectors[first:i].T @ (vectors[first:i] @ z)
        vectors[i] = z / np.linalg.norm(z)
    return vectors


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to k largest eigenvalues above zero (by rounding) and their unit vectors in rows."""
    k, scale = min(k, len(matrix)), np.abs(matrix).max(initial=0)
    if not k or not scale:
        return np.zeros(0), np.zeros((0, len(matrix)))
    diagonal, off, reflectors = tridiagonal(matrix / scale)
    values = largest_eigenvalues(diagonal, off, k)
    values = values[values > 64 * len(matrix) * EPS * values[0]]
    vectors = inverse_iteration(diagonal, off, values)
    for j in range(len(reflectors) - 1, -1, -1):
        v, part = reflectors[j], vectors[:, j + 1:]
        part -= 2 * np.outer(part @ v, v)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.einsum("ij,jk,ik->i", vectors, matrix, vectors), vectors
