"""k-means over integer vectors with Elkan's bounds.

Each vector keeps an upper bound on the distance to its centroid and a lower one
to every centroid; centroids' moves widen them. A centroid whose lower bound, or
half of whose distance from the vector's own centroid, lies above the upper
bound is not looked at. Bounds are rounded away from the truth and a centroid is
skipped only if it is farther for sure, so ties are met and go to the smaller
number; distances that are computed are exact integers.

A round is one pass: it reads vectors and bounds, writes them with the new
bounds, and with them a row for each task with the sums of its clusters.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, discard, finite, map_arrow, settle

#: Slack of a bound for each step in floating point, some eight times its rounding.
SLACK = 2.0**-50
#: Tasks that merge clusters' sums before the last one does.
MERGERS = 16


def integers(column: pa.Array, size: int) -> np.ndarray:
    """floor(1024 * x) of each component: longs, or Python's integers if distances might pass a long."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), size)
    with np.errstate(over="ignore"):
        found = np.floor(x * 1024)
    largest = np.abs(found).max(initial=0)
    if size * (2 * largest) ** 2 < 2**62:
        return found.astype(np.int64)
    if math.isfinite(largest):
        return np.array([[int(v) for v in row] for row in found.tolist()], object).reshape(found.shape)
    return np.array([[math.floor(v * 1024) if abs(v) < 2**60 else int(v) * 1024 for v in row] for row in x.tolist()], object).reshape(x.shape)


def squared(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances between rows of x and centroids, one of each or one for all."""
    far = max((abs(v) for c in centroids for v in c), default=0)
    narrow = x.dtype != object and x.shape[1] * (far + float(np.abs(x).max(initial=0))) ** 2 < 2**62
    off = x - np.array(centroids, np.int64) if narrow else x.astype(object) - np.array(centroids, object)
    return (off * off).sum(1)


def bounds(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubles not above and not below the roots of exact integers."""
    if squares.dtype == object and squares.max(initial=0) >= 2**62:
        roots = [math.isqrt(v) for v in squares.tolist()]
        low, high = (np.array([float(min(r, 10**308)) for r in roots]), np.array([float(r + 1) if r < 10**307 else math.inf for r in roots]))
    else:
        low = high = np.sqrt(squares.astype(float))
    return low * (1 - SLACK), high * (1 + SLACK)


class Centroids:
    """Centroids of one round, half the least distances between them and how far they came since the last."""

    def __init__(self, now: list[list[int]], before: list[list[int]] | None = None):
        self.now, k = now, len(now)
        pairs = [squared(np.array([c], object), now) for c in now]
        self.half = np.array([bounds(p)[0] / 2 for p in pairs]).reshape(k, k)
        others = np.where(np.eye(k, dtype=bool), np.inf, self.half)
        self.near = others.min(1)
        self.moved = bounds(np.array([squared(np.array([a], object), [b])[0] for a, b in zip(now, before)], object))[1] if before else np.zeros(k)

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Brings cluster, upper and lower (all in place) up to date; returns which vectors' upper is that of an exact distance."""
        upper[:] = (upper + self.moved[cluster]) * (1 + SLACK)
        lower[:] = np.maximum(lower - self.moved, 0) * (1 - SLACK)
        exact = np.zeros(len(x), object)
        known = np.zeros(len(x), bool)
        open_ = np.flatnonzero(~(upper < self.near[cluster]))
        for j in range(len(self.now)):
            wanted = lambda i: (cluster[i] != j) & ~(upper[i] < lower[i, j]) & ~(upper[i] < self.half[cluster[i], j])
            at = open_[wanted(open_)]
            fresh = at[~known[at]]
            if len(fresh):
                own = squared(x[fresh], [self.now[c] for c in cluster[fresh]])
                exact[fresh], known[fresh] = own, True
                lower[fresh, cluster[fresh]], upper[fresh] = bounds(own)
                at = at[wanted(at)]
            if not len(at):
                continue
            found = squared(x[at], [self.now[j]])
            low, high = bounds(found)
            lower[at, j] = low
            better = (found < exact[at]) | ((found == exact[at]) & (j < cluster[at]))
            to = at[better]
            exact[to], cluster[to], upper[to] = found[better], j, high[better]
        return known


def _totals(x: np.ndarray, cluster: np.ndarray, distance: np.ndarray | None, k: int) -> list:
    """Count, sums and distances' sum of each cluster, exact."""
    out = []
    for j in range(k):
        own = x[cluster == j]
        wide = own.astype(object) if own.dtype != object and float(np.abs(own).max(initial=0)) * len(own) >= 2**62 else own
        far = 0 if distance is None else sum(distance[cluster == j].tolist())
        out.append([len(own), [int(v) for v in wide.sum(0)], far])
    return out


def _added(a: list | None, b: list) -> list:
    return b if a is None else [[m + n, [p + q for p, q in zip(s, t)], d + e] for (m, s, d), (n, t, e) in zip(a, b)]


def _all_totals(states: DataFrame) -> list:
    """The sum of the tasks' totals, added by MERGERS tasks and then by one."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for b in batches:
            for t in b.column(0).to_pylist():
                found = _added(found, json.loads(t))
        if found is not None:
            yield batch(totals=pa.array([json.dumps(found)]))

    totals = states.where("totals is not null").select("totals")
    for tasks in (MERGERS, 1):
        totals = map_arrow(totals.repartition(tasks, "totals"), add, "totals string")
    return json.loads(totals.first().totals)


def _pass(states: DataFrame, centroids: Centroids, size: int, last: bool) -> DataFrame:
    """One round over states: the vectors with new bounds (with exact distances in the last), and rows with tasks' totals."""
    k = len(centroids.now)
    vector = states.schema["embedding"].dataType.simpleString()
    carried = "distance decimal(38,0)" if last else f"embedding {vector}, upper double, lower array<double>"
    of_longs = lambda v: v if v is not None and v < 10**38 else None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, types = None, None
        for b in batches:
            types = b.schema
            x = integers(b.column("embedding"), size)
            n = len(b)
            if "cluster" in b.schema.names:
                cluster, upper = (b.column(c).to_numpy(zero_copy_only=False).copy() for c in ("cluster", "upper"))
                lower = b.column("lower").flatten().to_numpy().reshape(n, k).copy()
            else:
                cluster, upper, lower = np.zeros(n, np.int32), np.full(n, np.inf), np.zeros((n, k))
            centroids.assign(x, cluster, upper, lower)
            distance = None
            if last:
                distance = squared(x, [centroids.now[c] for c in cluster])
            totals = _added(totals, _totals(x, cluster, distance, k))
            columns = dict(vec_id=b.column("vec_id"), cluster=pa.array(cluster, pa.int32()), totals=pa.nulls(n, pa.string()))
            if last:
                columns |= dict(distance=pa.array([of_longs(v) for v in distance.tolist()], pa.decimal128(38, 0)))
            else:
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(lower.ravel()))
                columns |= dict(embedding=b.column("embedding"), upper=pa.array(upper), lower=lists)
            yield batch(**columns)
        if totals is not None:
            columns = dict(vec_id=pa.nulls(1, pa.int64()), cluster=pa.nulls(1, pa.int32()), totals=pa.array([json.dumps(totals)]))
            if last:
                columns |= dict(distance=pa.nulls(1, pa.decimal128(38, 0)))
            else:
                columns |= dict(embedding=pa.nulls(1, types.field("embedding").type), upper=pa.nulls(1, pa.float64()), lower=pa.nulls(1, pa.list_(pa.float64())))
            yield batch(**columns)

    return map_arrow(states, each, f"vec_id long, cluster int, totals string, {carried}")


def start(vectors: DataFrame, k: int, size: int) -> list[list[int]]:
    """The k vectors whose sha256 of `3:<vec_id>` in hex comes first; rows without vec_id only where others don't suffice, ties by the vectors' values."""
    hashed = vectors.withColumn("hash", F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256))
    first = hashed.orderBy(F.col("hash").asc_nulls_last(), "embedding").limit(k).select("embedding").collect()
    return [integers(pa.array([list(map(float, r.embedding))], pa.list_(pa.float64())), size)[0].tolist() for r in first]


def centroid_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64) -> tuple[DataFrame, list[list[int]], list]:
    """The vectors' clusters, final centroids, and each cluster's count, sums and distances' sum.

    vectors: vec_id, embedding, ... The first is vec_id, cluster, distance for
    each vector of size components, none null or non-finite. distance is
    squared, exact, null from 10**38 on. No vectors give no centroids.
    """
    usable = vectors.where(finite("embedding") & (F.size("embedding") == size)).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    states, now, before = usable, start(usable, k, size), None
    if not now:
        return states.selectExpr("vec_id", "cast(null as int) cluster", "cast(null as decimal(38,0)) distance"), [], []
    for turn in range(rounds):
        done = settle(_pass(states, Centroids(now, before), size, False), f"round{turn}")
        if turn:
            discard(written)
        written, states = done, done.where("totals is null").drop("totals")
        before = now
        now = [[s // n for s in sums] if n else c for c, (n, sums, _) in zip(now, _all_totals(written))]
    final = settle(_pass(states, Centroids(now, before), size, True), "clusters")
    if rounds:
        discard(written)
    return final.where("totals is null").select("vec_id", "cluster", "distance"), now, _all_totals(final)


def clustering(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector of size components, none null or non-finite.

    Rows that repeat a vec_id, and those without one, count one each. Fewer
    than k vectors give as many centroids as there are; a centroid that gets no
    vector stays where it is. Sums that pass a long are null. Empty in, empty out.
    """
    rows, centroids, totals = centroid_clusters(vectors, k, rounds, size)
    long_ = lambda v: F.lit(v if v < 2**63 else None).cast("long")
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    own = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1) if values else F.lit(None)
    return rows.select(
        "vec_id", "cluster", F.when(F.col("distance") < F.lit(2**63 - 1).cast("decimal(38,0)"), F.col("distance")).cast("long").alias("distance"), own([long_(t[2]) for t in totals]).cast("long").alias("cluster_inertia"),
        long_(sum(t[2] for t in totals)).alias("inertia"), own([F.lit(t) for t in text]).cast("string").alias("centroid_sha256"),
    )
