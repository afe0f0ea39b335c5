"""Live sessions as streams from files, against the same from packets that are all there."""

import json
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import intervals
from lumenfold.signal_queries import colored
from lumenfold.streaming import color_state, live, sessions

RATE, SIZE = 8000, 2048
START = datetime(2024, 1, 1)


def packets():
    """Pink, then silence; blue with a gap; a late session that lets the others end. (session, seq, start, rate, samples, ts)"""
    pink = np.concatenate([colored(1, 1, RATE * 12), np.zeros(RATE * 6), colored(1, 2, RATE * 4)])
    blue = colored(-1, 3, RATE * 20)
    for name, signal in (("a", pink), ("b", blue)):
        for seq in range(len(signal) // SIZE):
            if name == "b" and 30 <= seq < 36:
                continue
            x = signal[seq * SIZE : (seq + 1) * SIZE].astype(np.float32)
            yield name, seq, seq * SIZE, float(RATE), x.tolist(), START + timedelta(seconds=seq * SIZE / RATE)
    # long enough for a frame, which tells the second stream of the later time
    yield "end", 0, 0, float(RATE), [0.0] * SIZE * 2, START + timedelta(hours=1)


def rounded(rows, skip=("ts",)):
    cell = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return Counter(tuple(sorted((k, cell(v)) for k, v in r.asDict().items() if k not in skip)) for r in rows if r.session_id != "end")


@pytest.fixture(scope="module")
def streamed(spark, tmp_path_factory):
    """live()'s rows and the sessions' from a stream of four files, run to its end."""
    folder = tmp_path_factory.mktemp("stream")
    rows = sorted(packets(), key=lambda p: p[5])
    for i in range(4):
        part = rows[i * len(rows) // 4 : (i + 1) * len(rows) // 4]
        spark.createDataFrame(part, live.PACKET).coalesce(1).write.mode("append").parquet(str(folder / "packets"))

    def run(df, name):
        query = df.writeStream.format("parquet").option("path", str(folder / name)).option("checkpointLocation", str(folder / f"{name}-checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
        return spark.read.parquet(str(folder / name))

    source = spark.readStream.schema(live.PACKET).option("maxFilesPerTrigger", 1).parquet(str(folder / "packets"))
    measured = run(sessions.with_states(live.live(source)), "measured")
    again = spark.readStream.schema(measured.schema).option("maxFilesPerTrigger", 4).parquet(str(folder / "measured"))
    return measured, run(sessions.sessions(again), "sessions")


@pytest.fixture(scope="module")
def batch(spark):
    rows = sessions.with_states(live.replayed(spark.createDataFrame(list(packets()), live.PACKET))).persist()
    return rows, sessions.summarized(rows)


def test_stream_gives_the_rows_of_the_batch(streamed, batch):
    got, want = rounded(streamed[0].collect()), rounded(batch[0].collect())
    assert got == want
    kinds = Counter(r.kind for r in batch[0].collect())
    assert kinds["gap"] == 1 and min(kinds[k] for k in ("frame", "fast", "stable")) > 10


def test_sessions_of_the_stream(streamed, batch):
    got = rounded(streamed[1].collect(), ("ts",))
    want = rounded(batch[1].collect(), ("ts",))
    assert {k for k in got if dict(k)["kind"] == "summary"} == {k for k in want if dict(k)["kind"] == "summary"}
    assert got == want


def test_summary(batch):
    rows, found = batch
    one = {r.session_id: r for r in found.where("kind = 'summary'").collect()}
    a, b = one["a"], one["b"]
    assert (a.dominant, a.reliable) == ("pink", False) and (b.dominant, b.reliable) == ("blue", False)
    seconds = json.loads(a.durations)
    assert seconds["silence"] == pytest.approx(6, abs=0.6) and sum(seconds.values()) == pytest.approx(a.seconds) and a.timeline_covers and a.timeline_matches
    assert b.beta_mean == pytest.approx(-1, abs=0.2) and b.observations >= 3
    # statistics of the running sums are those of the stable windows as a whole
    stable = rows.where("kind = 'stable' and reliable").groupBy("session_id").agg(F.avg("beta").alias("m"), F.stddev_pop("beta").alias("s"), F.avg("rmse_db").alias("e")).collect()
    for r in stable:
        assert (one[r.session_id].beta_mean, one[r.session_id].beta_sd, one[r.session_id].rmse_db_mean) == pytest.approx((r.m, r.s, r.e))


def test_segments_in_state():
    """A session whose closed segments are stored and whose state is loaded anew for each batch ends as one that runs through."""
    rng = np.random.default_rng(3)
    rows = [("silence" if rng.random() < 0.5 else "clipping", 0.5) for _ in range(9000)]
    whole = sessions.Running()
    for r in rows:
        whole._frame(*r)
    stored: dict = {}
    head, kept, loads = sessions.Running().head(), {}, 0
    for i in range(0, len(rows), 7):
        running = sessions.Running.of(head, kept, lambda: [stored[k] for k in sorted(stored)])
        for r in rows[i : i + 7]:
            running._frame(*r)
        loads += running.loaded
        if running.loaded:
            stored.clear()
        stored |= running.closing()
        head, kept = running.head(), dict(running.durations)
    assert 0 < loads < 12
    last = sessions.Running.of(head, kept, lambda: [stored[k] for k in sorted(stored)])
    assert last.summary() == whole.summary() and len(json.loads(whole.summary()["timeline"])) > 100


def test_gap_is_not_silence(batch):
    gap = batch[0].where("kind = 'gap'").first()
    assert gap.ends - gap.begins == pytest.approx(6 * SIZE / RATE) and gap.session_id == "b"
    windows = batch[0].where("session_id = 'b' and kind in ('fast', 'stable')").collect()
    assert all(w.ends <= gap.begins + 1e-9 or w.begins >= gap.ends - 1e-9 for w in windows)


def test_display_is_the_fold(spark):
    """The display of a session against the fold in DataFrame functions, over states that come and go."""
    rng = np.random.default_rng(5)
    names = ["pink", "white", "blue", "silence", "pink", "white"]
    rows = [(i, float(rng.normal(0.4, 0.6)), names[rng.integers(6)]) for i in range(300)]
    frame = spark.createDataFrame(rows, "i int, beta double, state string").withColumns({"k": F.lit(1), "reliable": F.col("state") != "silence", "confidence": F.lit("High")})
    want = {r.i: (r.shown_state, r.shown_beta, r.confidence) for r in color_state.color_states(frame, ["k"], ["i"]).collect()}
    display = sessions.Display()
    for i, beta, state in rows:
        display.observe(state, beta, state != "silence", "High")
        assert (display.state, display.confidence) == (want[i][0], want[i][2]) and (display.beta is None) == (want[i][1] is None)
        assert display.beta is None or display.beta == pytest.approx(want[i][1])


def test_long_timelines_are_folded():
    running = sessions.Running()
    for i in range(2148):
        running._frame("silence" if i % 2 else "clipping", 0.5)
    summary = running.summary()
    timeline = json.loads(summary["timeline"])
    assert len(timeline) <= sessions.SEGMENTS and timeline[0][0] == "session-compressed" and summary["timeline_covers"] and summary["timeline_matches"]
    assert summary["seconds"] == 1074 and summary["rejected_percent"] == 100 and not summary["reliable"]


def test_schedule():
    """One window with a packet: stable ones come when they are due and enough is there, fast ones between; what is passed over stays due."""
    session, kinds = live.Session("instant"), []
    for seq in range(40):
        kinds += [(r[0], r[2], r[3]) for r in session.add(seq, seq * 500, 2000.0, np.zeros(500, np.float32)) if r[0] != "frame"]
    fast, stable = ([t for k, t, _ in kinds if k == name] for name in ("fast", "stable"))
    assert len({t for _, t, _ in kinds}) == len(kinds)
    assert stable[0] == 3.0 and set(np.diff(stable)) == {0.5}
    assert fast == [t / 4 for t in range(6, 41) if t / 4 not in stable]
    assert list(session.add(39, 39 * 500, 2000.0, np.zeros(500, np.float32))) == []


@pytest.mark.parametrize("mode,first,length", [("instant", 1.5, 1.5), ("balanced", 1.5, 1.5), ("stable", 1.5, 1.5)])
def test_first_fast_window(mode, first, length):
    """A fast window takes what there is from 1.5 seconds on, and no more than its length."""
    session, found = live.Session(mode), []
    for seq in range(60):
        found += [(r[2], r[3] / 2000) for r in session.add(seq, seq * 500, 2000.0, np.zeros(500, np.float32)) if r[0] == "fast"]
    assert found[0] == (first, length)
    assert max(n for _, n in found) == live.MODES[mode][0]


def test_what_is_kept_is_bounded():
    """Chunks leave the buffer, and windows and frames are those of the samples as one array."""
    rng = np.random.default_rng(2)
    session, x, at, rows = live.Session("balanced"), rng.normal(size=100_000).astype(np.float32), 0, []
    for seq in range(400):
        n = int(rng.integers(1, 500))
        rows += list(session.add(seq, at, 1000.0, x[at : at + n]))
        at += n
        assert sum(map(len, session.chunks.values())) < 30_000 + 500 and session.pending < 500
    for kind, begins, ends, n, measured in rows:
        part = x[round(ends * 1000) - n : round(ends * 1000)]
        assert len(part) == n and measured["peak"] == pytest.approx(float(np.abs(part).max()))
        assert n == 500 or kind != "frame"


def test_a_packet_writes_its_own_chunk():
    """Of a full buffer, a batch rewrites nothing: it puts the new chunk and removes the old one."""

    class Value:
        def __init__(self):
            self.value = None

        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

    class Map(dict):
        put: list = []

        def updateValue(self, key, value):
            self.put.append(len(value[0]))
            self[key] = value

        removeKey = lambda self, key: self.pop(key)
        iterator = lambda self: iter(self.items())

    class Handle:
        value, map = Value(), Map()
        getValueState = lambda self, *a: self.value
        getMapState = lambda self, *a: self.map
        listTimers = lambda self: iter([])
        registerTimer = lambda self, at: None

    processor = live.LiveSession("balanced", 1000)
    processor.init(Handle())
    for seq in range(50):
        Map.put.clear()
        frame = pd.DataFrame([("s", seq, seq * 1000, 1000.0, np.zeros(1000, np.float32).tolist(), pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=seq))], columns=["session_id", "seq", "start_sample", "rate", "samples", "ts"])
        list(processor.handleInputRows(("s",), iter([frame]), None))
        assert Map.put == [4000]
    assert len(Handle.map) <= 31


def test_restart_from_a_checkpoint(spark, tmp_path):
    """A stream that is stopped between files and started again gives the rows of one that ran through."""
    rows = sorted((p for p in packets() if p[0] != "b"), key=lambda p: p[5])

    def run(folder, upto):
        source = spark.readStream.schema(live.PACKET).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
        query = live.live(source).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None

    for i in range(2):
        spark.createDataFrame(rows[i * len(rows) // 2 : (i + 1) * len(rows) // 2], live.PACKET).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(tmp_path, i)  # a query of its own each time, from what the last one left
    got = rounded(spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == rounded(live.replayed(spark.createDataFrame(rows, live.PACKET)).collect())


def test_many_rows_of_one_key(spark):
    """100,000 rows of one key find their nearest in seconds."""
    left = spark.range(100_000).selectExpr("1 as k", "id * 1.0D as t")
    right = spark.range(50_000).selectExpr("1 as k", "id * 2.0D + 0.75D as t", "id as v")
    found = intervals.nearest(left, right, ["k"], "t", ["v"])
    assert found.agg(F.sum(F.abs(F.col("nearest_at") - F.col("t")))).first()[0] == pytest.approx(sum(min(abs(t - 2 * v - 0.75) for v in (t // 2 - 1, t // 2, t // 2 + 1) if 0 <= v < 50_000) for t in range(100_000)))
