"""Whitening of embeddings: running moments, a symmetric eigen-solve, a projection.

Each task keeps the count, the mean and the centred products of its vectors and
updates them by one vector at a time (Welford: a rank-one matrix from what the
vector lies off the mean). Tasks' moments merge by the parallel update formula,
in groups and then all. Householder reflections and implicitly shifted QR steps
give the eigenvectors of the covariance; vectors are projected on them.

Nothing is summed uncentred, so a mean far from zero costs no digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, finite, map_arrow

SCALE, SHIFT = 1024, 100_000
#: Entries beyond it either way count as it: they have no place among longs.
LARGEST = 2.0**62
#: Tasks that merge moments before the last one does.
MERGERS = 16
EPS = np.finfo(float).eps


class Moments:
    """Count, mean and centred products of vectors, and the exact sums of integer ones."""

    def __init__(self, size: int):
        self.n, self.mean, self.products = 0, np.zeros(size), np.zeros((size, size))
        # the sums as high * 2**32 + low, neither of which passes a long
        self.high, self.low = np.zeros(size, np.int64), np.zeros(size, np.int64)

    def add(self, vectors: np.ndarray) -> None:
        one = np.empty_like(self.products)
        for x in vectors:
            self.n += 1
            off = x - self.mean
            self.mean += off / self.n
            np.multiply.outer(off, off * ((self.n - 1) / self.n), out=one)
            self.products += one

    def add_sums(self, integers: np.ndarray) -> None:
        self.high += (integers >> 32).sum(0)
        self.low += (integers & 0xFFFFFFFF).sum(0)

    def merge(self, other: Moments) -> None:
        n = self.n + other.n
        if other.n:
            off = other.mean - self.mean
            self.products += other.products + np.multiply.outer(off, off * (self.n * other.n / n))
            self.mean += off * (other.n / n)
        self.n = n
        self.high, self.low = self.high + other.high + (other.low >> 32), self.low + (other.low & 0xFFFFFFFF)

    def sums(self) -> list[int]:
        return [(h << 32) + low for h, low in zip(self.high.tolist(), self.low.tolist())]

    def row(self, part: int) -> pa.RecordBatch:
        lists = lambda x: pa.array([x.ravel().tolist()], pa.list_(pa.int64() if x.dtype == np.int64 else pa.float64()))
        return batch(part=pa.array([part], pa.int32()), n=pa.array([self.n], pa.int64()), mean=lists(self.mean), products=lists(self.products), high=lists(self.high), low=lists(self.low))

    @classmethod
    def of_row(cls, n: int, mean, products, high, low) -> Moments:
        found = cls(len(mean))
        found.n, found.mean, found.products = n, np.array(mean, float), np.array(products, float).reshape(len(mean), -1)
        found.high, found.low = np.array(high, np.int64), np.array(low, np.int64)
        return found


_MOMENTS = "part int, n long, mean array<double>, products array<double>, high array<long>, low array<long>"


def moments(vectors: DataFrame, column: str, size: int, integers: bool = False) -> Moments:
    """The moments of a column of arrays of size doubles; of the numbers that scaled() makes of them, with the mean less SHIFT, if integers.

    One state comes from each task and as many meet in one merging task as there
    are tasks for each of MERGERS; a state holds size * size doubles.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments(size)
        for b in batches:
            x = matrix(b.column(0), size)
            if integers:
                x = scaled(x)
                state.add_sums(x)
                x = (x - SHIFT).astype(float)  # nearer zero; what is centred doesn't change
            state.add(x)
        if state.n:
            yield state.row(TaskContext.get().partitionId())

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments(size)
        for b in batches:
            for _, *row in zip(*(c.to_pylist() for c in b.columns)):
                state.merge(Moments.of_row(*row))
        if state.n:
            yield state.row(TaskContext.get().partitionId())

    states = map_arrow(vectors.select(column), measured, _MOMENTS)
    for tasks in (MERGERS, 1):
        states = map_arrow(states.repartition(tasks, "part").sortWithinPartitions("part"), merged, _MOMENTS)
    found = states.drop("part").collect()
    return Moments.of_row(*found[0]) if found else Moments(size)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), size)


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(1024 * c) + 100000 as longs."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * SCALE), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def symmetric_qr(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its unit eigenvectors as columns."""
    a, n = np.array(matrix, float), len(matrix)
    q = np.eye(n)
    for k in range(n - 2):
        u = a[k + 1 :, k].copy()
        u[0] += np.copysign(np.linalg.norm(u), u[0])
        length = np.linalg.norm(u)
        if length == 0:
            continue
        u /= length
        a[k + 1 :] -= 2 * np.outer(u, u @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ u, u)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ u, u)
    d, e = np.diag(a).copy(), np.append(np.diag(a, -1), 0.0)
    high = n - 1
    while high > 0:
        e[:high][np.abs(e[:high]) <= EPS * (np.abs(d[:high]) + np.abs(d[1 : high + 1]))] = 0
        if e[high - 1] == 0:
            high -= 1
            continue
        low = high - 1
        while low and e[low - 1]:
            low -= 1
        half = (d[high - 1] - d[high]) / 2
        x, z = d[low] - d[high] + e[high - 1] * (e[high - 1] / (half + np.copysign(np.hypot(half, e[high - 1]), half))), e[low]
        for k in range(low, high):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            d[k], d[k + 1], e[k] = c * c * d[k] + 2 * c * s * e[k] + s * s * d[k + 1], s * s * d[k] - 2 * c * s * e[k] + c * c * d[k + 1], c * s * (d[k + 1] - d[k]) + (c * c - s * s) * e[k]
            q[:, k], q[:, k + 1] = c * q[:, k] + s * q[:, k + 1], c * q[:, k + 1] - s * q[:, k]
            if k < high - 1:
                x, z, e[k + 1] = e[k], s * e[k + 1], c * e[k + 1]
    order = np.argsort(-d, kind="stable")
    return d[order], q[:, order]


@dataclass
class Whitening:
    """A fit: n vectors with the exact sums per dimension, the largest eigenvalues with their eigenvectors as columns, the covariance's trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def size_of(vectors: DataFrame) -> int:
    """The length that most usable vectors have (the larger of two such, 0 without any)."""
    found = vectors.where(finite("embedding")).groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return found.size if found else 0


def fit(vectors: DataFrame, components: int = 8, size: int | None = None) -> Whitening:
    """A whitening from the embeddings of vectors (embedding, ...) that are usable: of the given size or the commonest, no component null or not finite.

    A component whose eigenvalue is 0 but for rounding isn't kept: nothing can be divided by its root.
    """
    size = size_of(vectors) if size is None else size
    usable = vectors.where(finite("embedding") & (F.size("embedding") == size))
    state = moments(usable, "embedding", size, integers=True)
    if not state.n:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    covariance = state.products / state.n
    values, axes = symmetric_qr(covariance)
    kept = (values > size * EPS * max(values[0], 0)) & (np.arange(size) < components)
    return Whitening(state.n, state.sums(), values[kept], axes[:, kept], float(np.trace(covariance)))


def whitened(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation and values (whitened, one for each component) of each usable row of vectors.

    deviation is exact; null where it passes a long.
    """
    size, n = len(model.sums), model.n
    sums = np.array(model.sums, object)
    narrow = all(abs(s) < 2**62 for s in model.sums)
    axes = model.vectors / np.sqrt(model.values) / n if n else model.vectors

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = scaled(matrix(b.column(1), size))
            largest = float(np.abs(x).max(initial=0)) * n + float(max(map(abs, model.sums)))
            off = x * n - sums.astype(np.int64) if narrow and largest < 2**62 else x.astype(object) * n - sums
            if off.dtype != object and size * float(np.abs(off).max(initial=0)) ** 2 >= 2**62:
                exact = off.astype(object)
            else:
                exact = off
            squares = [v if v < 2**63 else None for v in (exact * exact).sum(1).tolist()]
            values = off.astype(float) @ axes
            offsets = np.arange(len(b) + 1, dtype=np.int32) * axes.shape[1]
            yield batch(vec_id=b.column(0), deviation=pa.array(squares, pa.int64()), values=pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel())))

    usable = vectors.where(finite("embedding") & (F.size("embedding") == size)) if n else vectors.where("false")
    return map_arrow(usable.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), project, "vec_id long, deviation long, values array<double>")


def whitening(vectors: DataFrame, components: int = 8, size: int | None = None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each usable row and component.

    vectors: vec_id, embedding, ... The fit list is every usable row; rows with
    a null embedding, with null or non-finite entries or of another length than
    most take no part. Rows that repeat a vec_id and those without one stay, a
    row each. There are fewer components where the vectors span fewer
    dimensions, hence no rows for a single vector, for equal ones or for an
    empty table. identity_error is measured on the whitened values themselves.
    """
    model = fit(vectors, components, size)
    rows = whitened(vectors, model)
    kept = len(model.values)
    check = moments(rows, "values", kept) if kept else Moments(0)
    error = float(np.abs(check.products / check.n - np.eye(kept)).max()) if kept else 0.0
    explained = F.element_at(F.array(*map(F.lit, (model.values / model.trace).tolist())), F.col("pos") + 1) if kept else F.lit(0.0)
    return rows.select("vec_id", "deviation", F.posexplode("values").alias("pos", "whitened")).select(
        "vec_id", (F.col("pos") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"),
    )
