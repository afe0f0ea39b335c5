"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from lumenfold.llm.neighbours import nearest


def brute(rows, every, k):
    keep = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    for q in sorted(i for i in keep if i % every == 0):
        near = sorted((float(np.hypot.reduce(keep[q] - v)), i) for i, v in keep.items() if i != q and len(v) == len(keep[q]))
        yield from ((q, r, i, d) for r, (d, i) in enumerate(near[:k], 1))


def compare(spark, rows, every, k, least, **options):
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = [tuple(r) for r in nearest(frame, every, k, **options).collect()]
    want = list(brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], every, k))
    assert {(g[0], g[1]) for g in got} == {(w[0], w[1]) for w in want}
    true = {(w[0], w[2]): w[3] for w in want}
    found = [g for g in got if (g[0], g[2]) in true]
    assert all(abs(g[3] - true[g[0], g[2]]) < 1e-9 for g in found)
    assert len(found) >= least * len(want)


def test_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    rows = [(i, (centres[i % 12] + 0.4 * rng.normal(size=24)).tolist()) for i in range(3000)]
    compare(spark, rows, 50, 10, 0.95, shards=2)


def test_recall_in_a_large_shard(spark):
    """12,000 vectors in one graph, far more than the beam sees."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(100, 64))
    rows = [(i, (centres[i % 97 % 100] + 0.5 * rng.normal(size=64)).tolist()) for i in range(12_000)]
    compare(spark, rows, 100, 10, 0.9, shards=1)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(40)]
    rows += [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None, 2.0, 3.0]), (204, [1.0, float("nan"), 2.0, 3.0]), (205, [float("inf")] * 4), (210, [1.0, 2.0]), (220, [1.0, 3.0]), (None, [1.0] * 4), rows[10]]
    compare(spark, rows, 10, 10, 1.0, shards=2)
    compare(spark, rows[:3], 1, 10, 1.0)


@pytest.mark.parametrize("size", [1e20, 1e-30, 1e37, 1e-44])
def test_vectors_of_any_size(spark, size):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=16) * size).tolist()) for i in range(1700)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in nearest(frame, 100, 10, shards=2).collect()}
    want = {(q, r): (i, d) for q, r, i, d in brute(rows, 100, 10)}
    assert got.keys() == want.keys()
    assert sum(got[k][0] == want[k][0] for k in want) >= 0.95 * len(want)
    assert all(abs(got[k][1] / want[k][1] - 1) < 1e-9 for k in want if got[k][0] == want[k][0])


def test_small_vectors_beside_huge_ones(spark):
    """Every query gets its rows, however far apart the sizes of vectors lie."""
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(-200, 200)).tolist()) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(frame, 10, 10, shards=2).collect()
    assert len(got) == 300 and all(np.isfinite(r.score) for r in got)


def test_empty(spark):
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
