"""Whitening and clustering against plain definitions."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from lumenfold.llm.clustering import Centroids, bounds, centroid_clusters, clustering, squared
from lumenfold.llm.whitening import Moments, fit, symmetric_qr, whitened, whitening

SCHEMA = "vec_id long, embedding array<float>, n string, cluster string"
ODD = [None, [], [1.0] * 5, [1.0, None] * 4, [float("nan")] * 8, [float("inf")] + [0.0] * 7]


def vectors(seed: int, n: int = 400, size: int = 8) -> list[tuple]:
    """Clusters of two widths far from zero, equal and repeated rows, rows without id and unusable ones."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, size))
    rows = [(i, (centres[i % 5] + (0.05 if i % 2 else 0.5) * rng.normal(size=size)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(30)] + [(None, rows[1][1]), (None, rows[2][1]), rows[3], rows[3], (7, rows[9][1])]
    return [(i, v, "x", "y") for i, v in rows + [(10_000 + i, v) for i, v in enumerate(ODD)]]


def usable(rows, size: int = 8) -> list[tuple]:
    return [(i, v) for i, v, *_ in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]


@pytest.mark.parametrize("size", [1, 2, 3, 10, 64])
def test_symmetric_qr(size):
    rng = np.random.default_rng(size)
    for m in (rng.normal(size=(size, size)), np.diag(np.arange(size) // 2 * 1.0), np.zeros((size, size)), np.full((size, size), 3.0)):
        m = m + m.T
        values, axes = symmetric_qr(m)
        scale = max(1, np.abs(m).max())
        assert np.allclose(values, np.linalg.eigvalsh(m)[::-1], atol=1e-13 * scale * size)
        assert np.allclose(axes.T @ axes, np.eye(size), atol=1e-13)
        assert np.allclose(m @ axes, axes * values, atol=1e-13 * scale * size)


def test_moments_merge():
    rng = np.random.default_rng(1)
    x = (rng.integers(-50, 50, (999, 4)) + 10**9).astype(np.int64)
    whole = Moments(4)
    for part in (x[:1], x[1:1], x[1:700], x[700:]):
        own = Moments(4)
        own.add(part.astype(float))
        own.add_sums(part)
        whole.merge(own)
    exact = [[Fraction(int(v)) for v in row] for row in x]
    means = [sum(c) / 999 for c in zip(*exact)]
    want = [[float(sum((r[i] - means[i]) * (r[j] - means[j]) for r in exact)) for j in range(4)] for i in range(4)]
    assert whole.n == 999 and whole.sums() == x.sum(0).tolist()
    # a mean of 1e9 is held to 1e-7, each product to as much of what a vector lies off
    assert np.allclose(whole.products, want, rtol=1e-7, atol=999 * 50 * 2.4e-7)


def test_whitening(spark):
    rows = vectors(2)
    keep = usable(rows)
    x = np.floor(1024 * np.array([v for _, v in keep])).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    values, axes = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    want = (x - sums / n) @ axes / np.sqrt(values)
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    got = whitening(spark.createDataFrame(rows, SCHEMA).repartition(7), components=5).collect()
    assert {g.component for g in got} == {1, 2, 3, 4, 5} and {g.n for g in got} == {n}
    assert len({g.identity_error for g in got}) == 1 and got[0].identity_error < 1e-9
    for c in range(5):
        own = sorted((g.vec_id is None, g.vec_id or 0, g.deviation, g.whitened) for g in got if g.component == c + 1)
        sign = max((1, -1), key=lambda s: sum(abs(a[3] - b[3]) < 1e-8 for a, b in zip(own, sorted((i is None, i or 0, d, s * w[c]) for (i, _), d, w in zip(keep, deviation, want)))))
        expected = sorted((i is None, i or 0, d, sign * w[c]) for (i, _), d, w in zip(keep, deviation, want))
        assert [o[:3] for o in own] == [e[:3] for e in expected]
        assert np.allclose([o[3] for o in own], [e[3] for e in expected], atol=1e-8)
        assert {round(g.explained, 12) for g in got if g.component == c + 1} == {round(values[c] / values.sum(), 12)}


def test_whitening_of_few_or_flat_vectors(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening(frame([])).collect() == []
    assert whitening(frame([(1, [1.0, 2.0])])).collect() == []
    assert whitening(frame([(i, [0.5, 0.25]) for i in range(9)])).collect() == []
    line = whitening(frame([(i, [0.5 * i, 1.0 * i]) for i in range(9)])).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12


def test_whitening_of_huge_vectors(spark):
    """Deviations past a long are null, the rest stands."""
    rows = [(i, [1e9 * i, 1e-3 * i]) for i in range(9)] + [(9, [1e300, -1e300])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitened(frame, fit(frame)).collect()
    assert len(got) == 10 and all(r.deviation is None for r in got)


def lloyd(rows, k: int, rounds: int, size: int):
    """The contract, one vector at a time."""
    keep = usable(rows, size)
    x = [[math.floor(Fraction(v) * 1024) for v in vector] for _, vector in keep]
    order = sorted(range(len(keep)), key=lambda i: (keep[i][0] is None, hashlib.sha256(f"3:{keep[i][0]}".encode()).hexdigest(), keep[i][1]))
    centroids = [x[i] for i in order[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    assign = lambda: [min(range(len(centroids)), key=lambda j: (far(v, centroids[j]), j)) for v in x]
    for _ in range(rounds):
        own = assign()
        for j in range(len(centroids)):
            members = [v for v, o in zip(x, own) if o == j]
            if members:
                centroids[j] = [sum(c) // len(members) for c in zip(*members)]
    own = assign()
    near = [far(v, centroids[o]) for v, o in zip(x, own)]
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, o, d, sum(e for e, p in zip(near, own) if p == o), sum(near), text[o]) for (i, _), o, d in zip(keep, own, near)]


@pytest.mark.parametrize("seed,k,rounds", [(3, 8, 10), (5, 1, 1), (6, 12, 0)])
def test_clustering(spark, seed, k, rounds):
    rows = vectors(seed)
    key = lambda r: (r[0] is None, r)
    got = clustering(spark.createDataFrame(rows, SCHEMA).repartition(5), k, rounds, 8).collect()
    assert sorted(map(tuple, got), key=key) == sorted(lloyd(rows, k, rounds, 8), key=key)


def test_clustering_of_few_equal_and_huge_vectors(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert clustering(frame([])).collect() == []
    equal = [(i, [0.25, -0.25]) for i in range(20)] + [(20, [0.5, 0.5])]
    assert sorted(map(tuple, clustering(frame(equal), 8, 1, 2).collect())) == sorted(lloyd(equal, 8, 1, 2))
    wide = [(i, [1e6 + i % 5, i % 3 - 2e6]) for i in range(40)]  # beyond what longs square
    assert sorted(map(tuple, clustering(frame(wide), 4, 2, 2).collect())) == sorted(lloyd(wide, 4, 2, 2))
    huge = [(i, [1e30 * i, 1e307 * (i % 3)]) for i in range(12)]
    got = sorted((r.vec_id, r.cluster, r.centroid_sha256) for r in clustering(frame(huge), 4, 2, 2).collect())
    assert got == sorted((r[0], r[1], r[5]) for r in lloyd(huge, 4, 2, 2))


def test_ties_on_a_grid(spark):
    """Many vectors as near to two centroids or more: the smaller number has them."""
    rows = [(i, [(i % 7) / 1024, (i // 7 % 7) / 1024]) for i in range(490)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, clustering(frame, 6, 4, 2).collect())) == sorted(lloyd(rows, 6, 4, 2))


def test_bounds_hold_the_truth():
    rng = np.random.default_rng(8)
    squares = np.array([0, 1, 2, 3, 2**53 + 1, *(int(v) for v in rng.integers(0, 2**61, 500))], object)
    for given in (squares.astype(np.int64), squares, squares * 2**90):
        low, high = bounds(given)
        assert all(Fraction(a) ** 2 <= int(s) <= Fraction(b) ** 2 for a, b, s in zip(low.tolist(), high.tolist(), given.tolist()))


def test_bounds_skip_distances(spark, monkeypatch):
    """Once centroids rest, most distances aren't computed, and the clusters are the same."""
    rng = np.random.default_rng(9)
    x = (rng.integers(0, 8, 2000)[:, None] * 1000 + rng.integers(-50, 50, (2000, 16))).astype(np.int64)
    now = [[1000 * j] * 16 for j in range(8)]
    cluster, upper, lower = np.zeros(2000, np.int32), np.full(2000, np.inf), np.zeros((2000, 8))
    Centroids(now).assign(x, cluster, upper, lower)
    moved = [[v + 1 for v in c] for c in now]
    looked = []
    monkeypatch.setattr("lumenfold.llm.clustering.squared", lambda a, b: looked.append(len(a)) or squared(a, b))
    centroids = Centroids(moved, now)
    looked.clear()
    centroids.assign(x, cluster, upper, lower)
    assert sum(looked) < 200
    assert cluster.tolist() == ((x[:, None] - np.array(moved)) ** 2).sum(2).argmin(1).tolist()


def test_centroids_and_totals(spark):
    rows = vectors(11)
    members, centroids, totals = centroid_clusters(spark.createDataFrame(rows, SCHEMA), 8, 2, 8)
    assert sum(t[0] for t in totals) == members.count() == len(usable(rows))
    assert len(centroids) == 8
