"""Operators along time, for one large key in many buckets, against plain Python."""

import math
import random

import duckdb
import pytest

from lumenfold import registry, signal_queries  # noqa: F401
from lumenfold.operators import buckets, intervals

INF, NAN = float("inf"), float("nan")


def rows(seed: int, n: int = 300) -> list[tuple]:
    """key, id, t, state: one key with most rows, bursts and ties of time, times that are none, null keys and states."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = rng.choice([rng.randrange(-5, 60) / 2, 7.0, rng.uniform(0, 500), None, NAN, INF])
        out.append((rng.choice(["big"] * 6 + ["small", None]), i, t, rng.choice(["pink", "pink", "white", "", None])))
    return out


def timed(data):
    return [r for r in data if r[2] is not None and math.isfinite(r[2])]


def plain_timeline(data, duration):
    out = []
    for key in {r[0] for r in data}:
        own = sorted((r[2], r[3] or "mixed") for r in timed(data) if r[0] == key)
        segments = []
        for i, (t, state) in enumerate(own):
            end = min(duration, max(0.0, (t + own[i + 1][0]) / 2)) if i + 1 < len(own) else duration
            if segments and segments[-1][0] == state:
                segments[-1][2:] = [end, segments[-1][3] + 1]
            else:
                segments.append([state, segments[-1][2] if segments else 0.0, end, 1])
        out += [(key, *s) for s in segments]
    return out


KEY = lambda r: tuple((x is None, x) for x in r)


@pytest.mark.parametrize("width", [0.4, 13.0, 1e6, None])
def test_color_timeline(spark, width):
    data = rows(1)
    got = intervals.color_timeline(spark.createDataFrame(data, "key string, id int, t double, state string"), ["key"], "t", "state", 120.0, width).collect()
    assert sorted(map(tuple, got), key=KEY) == sorted(plain_timeline(data, 120.0), key=KEY)


@pytest.mark.parametrize("ties", ["later", "earlier"])
@pytest.mark.parametrize("width", [0.4, 13.0, 1e6, None])
def test_nearest(spark, ties, width):
    left, right = rows(2), rows(3, 150)
    schema = "key string, id int, t double, state string"
    found = intervals.nearest(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["key"], "t", ["id"], ties, width)
    assert found.columns == ["key", "id", "t", "state", "nearest_at", "nearest_id"]
    want = []
    for key, i, t, _ in left:
        own = [(r[2], r[1]) for r in timed(right) if r[0] == key]
        if t is None or not math.isfinite(t) or not own:
            want.append((i, None, None))
            continue
        least = min(abs(at - t) for at, _ in own)
        at = (max if ties == "later" else min)(at for at, _ in own if abs(at - t) == least)
        want.append((i, at, max(j for a, j in own if a == at)))
    got = [(r.id, r.nearest_at, r.nearest_id) for r in found.collect()]
    # null keys meet null keys
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("width", [0.4, 1e6])
def test_placed_and_beside(spark, width):
    data = [(k, i, t, s or "") for k, i, t, s in timed(rows(4))]
    frame = spark.createDataFrame(data, "key string, id int, t double, state string")
    got = [(r.key, r.id, r.n) for r in buckets.placed(frame, ["key"], "t", width, ["t", "id"]).collect()]
    near = {r.id: (r._before and r._before.id, r._after and r._after.id) for r in buckets.beside(frame, ["key"], "t", width, ["t", "id"]).collect()}
    want, around = [], {}
    for key in {r[0] for r in data}:
        own = [i for _, i in sorted((r[2], r[1]) for r in data if r[0] == key)]
        want += [(key, i, n) for n, i in enumerate(own)]
        around |= {i: (own[n - 1] if n else None, own[n + 1] if n + 1 < len(own) else None) for n, i in enumerate(own)}
    assert sorted(got, key=KEY) == sorted(want, key=KEY)
    assert near == around


@pytest.mark.parametrize("width", [2.0, 1e6, None])
def test_merged(spark, width):
    """Runs over many buckets, and of bins without a state."""
    states = ["a"] * 40 + [None] * 3 + ["b"] + ["a"] * 70 + [None] * 50
    frame = spark.createDataFrame([("k", s, i * 0.5, i * 0.5 + 0.5) for i, s in enumerate(states)], "k string, s string, begins double, ends double")
    got = sorted(intervals.merged(frame, ["k"], "s", "begins", "ends", width).collect(), key=lambda r: r.begins)
    assert [tuple(r) for r in got] == [("k", "a", 0.0, 20.0, 40), ("k", None, 20.0, 21.5, 3), ("k", "b", 21.5, 22.0, 1), ("k", "a", 22.0, 57.0, 70), ("k", None, 57.0, 82.0, 50)]


def test_empty(spark):
    none = spark.createDataFrame([], "key string, id int, t double, state string")
    assert intervals.color_timeline(none, ["key"], "t", "state", 5.0).collect() == []
    assert intervals.nearest(none, none, ["key"], "t", ["id"]).collect() == []
    assert buckets.width(none, "t") == 1.0


def test_one_key_spreads_over_tasks(spark):
    """A key with all rows: no task sees more than a small part of them."""
    frame = spark.range(40_000).selectExpr("'k' as key", "id", "id * 0.25 as t", "if(pmod(hash(id), 3) = 0, 'pink', 'white') as state")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        length = buckets.width(frame, "t", 500)
        near = buckets.beside(frame, ["key"], "t", length, ["t", "id"])
        sizes = [r["count"] for r in near.groupBy(F_partition()).count().collect()]
        assert sum(sizes) == 40_000 and max(sizes) < 12_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def F_partition():
    from pyspark.sql import functions as F

    return F.spark_partition_id()


def shown(rows, alpha=0.28, hysteresis=0.12, required=2):
    """The displayed states, one observation after the other, by the rules."""
    colors = {"violet": -2.0, "blue": -1.0, "white": 0.0, "pink": 1.0, "brown": 2.0}
    state, smooth, beta, pending, count, out = "listening", None, None, None, 0, []
    for t, i, b, s, good, confidence in sorted(rows):
        if not good or b is None or not math.isfinite(b) or s not in colors:
            state, smooth, beta, pending, count = ("mixed" if s is None or s in colors else s), None, None, None, 0
            out.append((t, i, state, smooth, beta, pending, count, "None"))
            continue
        smooth = b if smooth is None else alpha * b + (1 - alpha) * smooth
        near = min(colors, key=lambda c: abs(smooth - colors[c]))
        if state in colors and abs(smooth - colors[near]) + hysteresis >= abs(smooth - colors[state]):
            near = state
        if near == state:
            pending, count, beta = None, 0, smooth
        else:
            count = count + 1 if pending == near else 1
            pending = near
            if count >= required:
                state, pending, count, beta = near, None, 0, smooth
        told = "None" if state not in colors or beta is None else "Provisional" if pending or s != state else confidence or "None"
        out.append((t, i, state, smooth, beta, pending, count, told))
    return out


@pytest.mark.parametrize("width", [3.0, 1e6, None])
def test_color_states(spark, width):
    """One key with nearly all rows: stretches between unreliable observations are folded apart, to the same states."""
    from lumenfold.streaming.color_state import color_states

    rng = random.Random(6)
    names = ["violet", "blue", "white", "pink", "brown", "silence", None]
    data = [("big" if i % 9 else None, i // 3 / 2, i, rng.choice([rng.gauss(0, 1.5), 0.9, None, NAN]) if i % 50 > 20 else 0.4 + i % 50 / 20, rng.choice(names[:5]) if i % 40 else rng.choice(names), bool(i % 37), rng.choice(["High", None])) for i in range(900)]
    frame = spark.createDataFrame(data, "key string, t double, id int, beta double, state string, reliable boolean, confidence string")
    got = color_states(frame, ["key"], ["t", "id"], width=width).collect()
    assert len(got) == 900
    for key in ("big", None):
        own = sorted((r.t, r.id, r.shown_state, r.smoothed, r.shown_beta, r.pending, r.pending_count, r.confidence) for r in got if r.key == key)
        want = shown([r[1:] for r in data if r[0] == key])
        assert own == sorted(want)
    assert color_states(frame.limit(0), ["key"], ["t", "id"]).collect() == []


def test_places_within_spans(spark):
    """Places are those over all rows, though only some buckets are sorted."""
    rows = spark.range(5000).selectExpr("double((id * 7919) % 5003) as t", "id as v").repartition(6)
    whole = {r.n: r.v for r in buckets.placed(rows, [], "t", 50.0, ["t", "v"]).collect()}
    spans = [(0, 30), (1200, 1333), (1320, 1400), (4990, 6000)]
    found = {r.n: r.v for r in buckets.placed_within(rows, "t", 50.0, ["t", "v"], spans).collect()}
    assert found == {n: v for n, v in whole.items() if any(a <= n < b for a, b in spans)}


def test_all_colors_are_recovered():
    """Every nation of the recordings, and all five exponents."""
    sql = registry.ORACLE_SQL["recovered_exponents"]
    con = duckdb.connect()
    con.execute("create table nation as select unnest(range(25)) as n_nationkey")
    found = con.sql(sql).fetchall()
    assert len(found) == 16 and {beta for _, beta in found} == {-2.0, -1.0, 0.0, 1.0, 2.0}
