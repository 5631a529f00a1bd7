"""Embedding whitening by a distributed covariance and a symmetric eigensolver.

Vectors enter as integers, x = floor(256 c). The fit list is each distinct vector once: copies collapse before the
shuffle. Its covariance needs two passes: the sums per dimension, then the second moments of x - c, where c is the mean
rounded to an integer. Both are sums of integers, added exactly in any order; what the rounding left is taken off
exactly too, so every entry of the covariance is the true one rounded once, and reruns agree to the last bit.

A task sums its own rows and hands on one value per pair of dimensions, Spark adds those up, and only the matrix, whose
size depends on the number of dimensions alone, comes to the driver. There Householder reflections make it tridiagonal,
bisection on Sturm counts finds the leading eigenvalues, inverse iteration their vectors, and vectors of eigenvalues that
lie close together are made orthogonal to each other. The components go to the tasks, which project their rows.

Defined results: vectors that are null, empty or hold null, infinite or undefined entries are left out; so are vectors of
another length than the most frequent one (of equally frequent ones the longest); a null vec_id stays null; repeated rows
each have their results and count once in the fit list; directions without variance have no component, so there are no
rows where all vectors are equal; an empty table gives no rows; a squared distance beyond a long is null; other columns
are ignored, whatever their names.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.common import table
from turnwise.llm.registry import query
from turnwise.session import materialize

SCALE = 256
EXACT = 2 ** 53
LONG = 2 ** 63 - 1
_OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double")


# Eigenvectors of a symmetric matrix

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, Q) with Q^T a Q tridiagonal, by Householder reflections."""
    a = np.array(a, np.float64)
    n = len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1:, k]
        norm = np.linalg.norm(x)
        if norm == 0.0:
            continue
        v = x.copy()
        v[0] += norm if x[0] >= 0 else -norm
        v /= np.linalg.norm(v)
        # a <- (I - 2vv^T) a (I - 2vv^T) on the trailing block, as one rank-two update.
        p = 2.0 * (a[k + 1:, k + 1:] @ v)
        w = p - (v @ p) * v
        a[k + 1:, k + 1:] -= np.outer(v, w) + np.outer(w, v)
        a[k + 1:, k] -= 2.0 * v * (v @ x)
        a[k, k + 1:] = a[k + 1:, k]
        q[:, k + 1:] -= 2.0 * np.outer(q[:, k + 1:] @ v, v)
    return a.diagonal().copy(), a.diagonal(-1).copy(), q


def count_below(diagonal: np.ndarray, off: np.ndarray, x: float) -> int:
    """Number of eigenvalues below ``x``: the negative pivots of T - xI (Sturm count)."""
    tiny = np.finfo(np.float64).tiny
    below, pivot = 0, 1.0
    for i, d in enumerate(diagonal):
        pivot = d - x - (off[i - 1] ** 2 / pivot if i else 0.0)
        if pivot == 0.0:
            pivot = -tiny
        below += pivot < 0.0
    return below


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected until its interval has no number left inside."""
    n = len(diagonal)
    reach = np.abs(np.concatenate([off, [0.0]])) + np.abs(np.concatenate([[0.0], off]))
    low, high = float((diagonal - reach).min()), float((diagonal + reach).max())
    room = max(abs(low), abs(high)) * np.finfo(np.float64).eps * n
    low, high = low - room, high + room
    found = []
    for nth in range(1, k + 1):
        a, b = low, found[-1] + room if found else high  # counts fall apart by rounding only
        while True:
            middle = a + (b - a) / 2
            if not a < middle < b:
                break
            if n - count_below(diagonal, off, middle) >= nth:
                a = middle
            else:
                b = middle
        found.append(a)
    return np.array(found)


def _solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, floor: float) -> np.ndarray:
    """(T - shift I) x = right by elimination with row exchanges; pivots near zero become ``floor``."""
    n = len(diagonal)
    d, x = diagonal - shift, right.copy()
    up, up2, low = np.append(off, 0.0), np.zeros(n), np.append(off, 0.0)
    for i in range(n - 1):
        if abs(d[i]) >= abs(low[i]):
            ratio = low[i] / d[i] if d[i] else 0.0
            d[i + 1] -= ratio * up[i]
        else:
            ratio = d[i] / low[i]
            d[i], up[i], d[i + 1] = low[i], d[i + 1], up[i] - ratio * d[i + 1]
            up2[i], up[i + 1] = up[i + 1], -ratio * up[i + 1]
            x[i], x[i + 1] = x[i + 1], x[i]
        x[i + 1] -= ratio * x[i]
    for i in range(n - 1, -1, -1):
        pivot = d[i] if abs(d[i]) > floor else floor
        x[i] = (x[i] - (up[i] * x[i + 1] if i + 1 < n else 0.0) - (up2[i] * x[i + 2] if i + 2 < n else 0.0)) / pivot
    return x


def tridiagonal_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of falling ``values`` by inverse iteration; members of a cluster are orthogonal."""
    n = len(diagonal)
    size = max(float(np.abs(diagonal).max()), float(np.abs(off).max()) if len(off) else 0.0, np.finfo(np.float64).tiny)
    floor, near = size * np.finfo(np.float64).eps, size * 1e-3
    rng = np.random.default_rng(11)
    vectors = np.zeros((n, len(values)))
    first = 0  # of the present cluster
    for j, value in enumerate(values):
        if j and values[j - 1] - value > near:
            first = j
        x = rng.normal(size=n)
        for _ in range(6):
            x = _solve_shifted(diagonal, off, value, x, floor)
            x /= np.abs(x).max()
            for _twice in range(2):
                for other in range(first, j):
                    x -= (vectors[:, other] @ x) * vectors[:, other]
                x /= np.linalg.norm(x)
        vectors[:, j] = x
    return vectors


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, unit eigenvectors as columns) of a symmetric matrix, those with variance, at most ``k``."""
    if not len(v):
        return np.zeros(0), np.zeros((0, 0))
    diagonal, off, q = tridiagonal(v)
    values = leading_eigenvalues(diagonal, off, min(k, len(v)))
    values = values[values > len(v) * np.finfo(np.float64).eps * max(values[0], 0.0)]
    vectors = q @ tridiagonal_vectors(diagonal, off, values)
    return values, vectors / np.linalg.norm(vectors, axis=0)


# Sums over rows

def _matrices(batches: Iterator[pa.RecordBatch], column: str = "x", rows: int = 4096) -> Iterator[np.ndarray]:
    """The vectors of each batch as integer matrices of bounded height."""
    for batch in batches:
        held = batch.column(column)
        for at in range(0, batch.num_rows, rows):
            part = held.slice(at, rows)
            if len(part):
                yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def exact_products(x: np.ndarray) -> np.ndarray:
    """x^T x of an integer matrix, exact: in doubles where no sum can pass 2^53, else in whole numbers of any size."""
    most = max(abs(int(x.max())), abs(int(x.min())))
    fit = EXACT // (most * most) if most else len(x)
    if fit == 0:
        big = x.astype(object)
        return big.T @ big
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), fit):
        part = x[at:at + fit].astype(np.float64)
        total += (part.T @ part).astype(np.int64)
    return total


def _decimal_rows(values: np.ndarray, names: tuple[str, str]) -> pa.RecordBatch:
    """(cell, value) of a flat array of whole numbers."""
    from decimal import Decimal

    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(values), dtype=np.int64)),
         pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))], names=list(names))


def _sums(dimensions: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dimensions, object), 0
        for x in _matrices(batches):
            n += len(x)
            total += x.sum(0) if np.abs(x.astype(np.float64)).max() < 2 ** 50 else x.astype(object).sum(0)
        yield _decimal_rows(np.append(total, n), ("cell", "value"))

    return add


def _moments(centre: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    d = len(centre)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for x in _matrices(batches):
            total += exact_products(x - centre)
        yield _decimal_rows(total[np.triu_indices(d)], ("cell", "value"))

    return add


def _added(rows: DataFrame, job: Callable) -> list[int]:
    """The values of each cell, added over tasks."""
    parts = rows.mapInArrow(job, "cell long, value decimal(38,0)")
    held = {r["cell"]: int(r["value"]) for r in
            parts.groupBy("cell").agg(F.sum("value").cast("decimal(38,0)").alias("value")).collect()}
    return [held.get(i, 0) for i in range(max(held, default=-1) + 1)]


@dataclass
class Whitening:
    """n and S of the fit list, and its leading components: eigenvalues (falling) and unit vectors as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of integer rows; centred on the mean's whole part first, so nothing cancels."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([float(Fraction(s - int(w) * self.n, self.n)) for s, w in zip(self.sums, whole)])
        return (((x - whole).astype(np.float64) - rest) @ self.vectors) / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None beyond a long."""
        most = max(abs(int(x.max())), abs(int(x.min()))) * self.n + max(abs(s) for s in self.sums)
        if most * most * x.shape[1] <= LONG:
            gap = self.n * x - np.array(self.sums, np.int64)
            return (gap * gap).sum(1).tolist()
        gap = self.n * x.astype(object) - np.array(self.sums, object)
        return [int(v) if v <= LONG else None for v in (gap * gap).sum(1)]


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the usable rows; x = floor(256 c) of each entry c."""
    usable = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("c")).filter(
        (F.size("c") > 0) & F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    lengths = usable.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    wanted = lengths["d"] if lengths else 0
    return usable.filter(F.size("c") == wanted).select(
        "vec_id", F.transform("c", lambda v: F.floor(v * SCALE)).alias("x"))


def fit_whitening(fit_list: DataFrame, k: int = 4) -> Whitening | None:
    """Fit on the distinct vectors in column ``x``; None where there are none."""
    first = fit_list.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first["d"]
    *sums, n = _added(fit_list, _sums(d))
    centre = [round(Fraction(s, n)) for s in sums]
    moments = _added(fit_list, _moments(np.array(centre, np.int64)))
    left = [s - n * c for s, c in zip(sums, centre)]  # n times what the rounded centre is off
    v = np.zeros((d, d))
    for cell, (i, j) in enumerate(zip(*np.triu_indices(d))):
        v[i, j] = v[j, i] = float(Fraction(n * moments[cell] - left[i] * left[j], n * n))
    values, vectors = leading_components(v, k)
    return Whitening(n, sums, values, vectors, float(np.trace(v)))


def identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, measured on all its rows."""
    k = len(model.values)
    cells = [(i, j) for i in range(k) for j in range(i, k)]

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for x in _matrices(batches):
            w = model.project(x)
            total += w.sum(0)
            products += w.T @ w
        yield pa.RecordBatch.from_arrays(
            [pa.array([v]) for v in (*total, *(products[c] for c in cells))],
            names=[f"v{i}" for i in range(k + len(cells))])

    names = [f"v{i}" for i in range(k + len(cells))]
    got = fit_list.mapInArrow(whiten, ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c).alias(c) for c in names]).first()
    mean = [got[i] / model.n for i in range(k)]  # zero but for rounding: whitening centred the rows
    return max(abs(got[k + at] / model.n - mean[i] * mean[j] - (i == j)) for at, (i, j) in enumerate(cells))


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, component, n, deviation, whitened and explained of each row and component."""
    explained = (model.values / model.trace).tolist()
    k = len(explained)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _matrices([batch]):
                ids = batch.column("vec_id").slice(at, len(x))
                at += len(x)
                each = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                     pa.array([model.n] * (len(x) * k), pa.int64()), pa.array(model.deviations(x), pa.int64()).take(each),
                     pa.array(model.project(x).ravel()), pa.array(explained * len(x), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(project, _OUT)


def whitened_embeddings(embeddings: DataFrame, components: int = 4) -> DataFrame:
    """Whitened coordinates of (vec_id, embedding) on the leading components, with the measured identity error."""
    vectors = integer_vectors(embeddings)
    fit_list = materialize(vectors.select("x").distinct())
    model = fit_whitening(fit_list, components)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], _OUT + ", identity_error double")
    return whiten(vectors, model).withColumn("identity_error", F.lit(identity_error(fit_list, model)))


@query("op13_householder_whitening")
def op13_householder_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_embeddings(table(spark, sf_dir, "embeddings"))
