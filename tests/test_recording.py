"""Recordings as rows of samples, in chunks and frames, against whole signals in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import spectra
from lumenfold.operators import intervals, spectral
from lumenfold.plans import recording

RATE = 1000
BAND = (10.0, 400.0)


def noise(seed: int, n: int, level: float = 0.2) -> np.ndarray:
    x = np.random.default_rng(seed).normal(size=n) * level
    return np.clip(x + 0.5 * np.append(0, x[:-1]), -1, 1).astype(np.float32).astype(float)


SIGNALS = {
    "long": noise(1, 50_500), "quiet end": np.append(noise(2, 21_000), np.zeros(4_250)), "short": noise(3, 3_000), "too short": noise(4, 1_400), "flat tops": np.clip(noise(5, 9_000) * 5, -0.97, 0.97), "few": noise(6, 200),
}


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(k, i, None if k == "few" and i == 77 else float(v), float(RATE)) for k, x in SIGNALS.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "signal string, n long, x double, rate double").repartition(5).persist()


def plain_windows(x: np.ndarray, seconds: int = 6, step: int = 2) -> list[int]:
    size = min(seconds * RATE, len(x))
    return list(range(0, len(x) - size + 1, step * RATE))


def test_chunks_are_bounded_and_windows_whole(samples):
    cut = spectral.chunks(samples, ["signal"])
    assert max(len(r.samples) for r in cut.collect()) <= (8 * 2 + 6) * RATE
    found = {(r.signal, r.start): r.samples for r in spectral.windows(cut, ["signal"]).collect()}
    want = {(k, s): x[s : s + min(6 * RATE, len(x))].tolist() for k, x in SIGNALS.items() if k != "few" for s in plain_windows(x)}
    assert {k: v for k, v in found.items() if k[0] != "few"} == want
    assert [len(v) for k, v in found.items() if k[0] == "few"] == [200]


@pytest.mark.parametrize("seconds,step", [(0.5, 2.0), (40.0, 1.0)])
def test_windows_of_other_lengths(samples, seconds, step):
    """Windows far shorter than their step, and longer than the steps of a chunk."""
    cut = spectral.chunks(samples.where("signal = 'long'"), ["signal"], seconds, step)
    found = {r.start: r.samples for r in spectral.windows(cut, ["signal"], seconds, step).collect()}
    x = SIGNALS["long"]
    size, hop = int(seconds * RATE), int(step * RATE)
    assert found == {s: x[s : s + size].tolist() for s in range(0, len(x) - size + 1, hop)}


def test_observations(samples):
    got = {(r.signal, r.start): r for r in recording.observations(samples, ["signal"], low=BAND[0], high=BAND[1]).collect()}
    want = {(k, s): recording.measure(x[s : s + 6 * RATE], RATE, *BAND, 24) for k, x in SIGNALS.items() for s in plain_windows(x)}
    assert got["few", 0].state == "invalid"
    del got["few", 0], want["few", 0]
    assert got.keys() == want.keys()
    for k, m in want.items():
        assert got[k].beta == pytest.approx(m["beta"]) and got[k].dbfs == pytest.approx(m["dbfs"]) and got[k].smooth_db == pytest.approx(m["smooth_db"]) and got[k].segments == m["segments"]
        assert got[k].time == k[1] / RATE + min(6, len(SIGNALS[k[0]]) / RATE) / 2
    assert {got[k].state for k in got if k[0] == "flat tops"} == {"clipping"}


NAMES = ["rms", "dbfs", "peak", "clipping", "near_clipping", "plateau", "crest", "kurtosis", "edge_density", "non_finite"]


def same(row, plain: dict) -> None:
    for name in NAMES:
        assert (row[name] is None and plain[name] is None) or row[name] == pytest.approx(plain[name]), name


def test_frame_levels(samples):
    found = {(r.signal, r.frame): r for r in recording.frame_levels(samples, ["signal"]).collect()}
    for k, x in SIGNALS.items():
        assert len([1 for s, _ in found if s == k]) == -(-len(x) // 500)
        for f in range(0, -(-len(x) // 500), 7):
            part, row = x[f * 500 : f * 500 + 500], found[k, f]
            assert (row.begins, row.ends, row.samples) == (f * 0.5, (f * 500 + len(part)) / RATE, len(part))
            if k != "few":
                same(row, recording.levels(part, RATE))


def test_whole(samples):
    found = {r.signal: r for r in recording.whole(samples, ["signal"], *BAND).collect()}
    for k, x in SIGNALS.items():
        x = np.where((np.arange(len(x)) == 77) & (k == "few"), np.nan, x)
        plain = recording.measure(x, RATE, *BAND)
        same(found[k], plain)
        for name in ("duration", "beta", "r2", "rmse_db", "smooth_db", "evidence", "prominence_db", "occupancy", "segments"):
            a, b = found[k][name], plain[name]
            assert (a is None and b is None) or a == pytest.approx(b, rel=1e-6), (k, name)


def test_timeline(spark, samples):
    seen = spark.createDataFrame([("quiet end", 4.0, "pink"), ("quiet end", 14.0, "unheard of"), ("long", 1.0, "silence")], "signal string, time double, state string")
    got = sorted((r.signal, r.begins, r.ends, r.state) for r in recording.timeline(samples, ["signal"], seen).collect())
    assert [g for g in got if g[0] == "quiet end"] == [("quiet end", 0.0, 9.0, "pink"), ("quiet end", 9.0, 21.0, "insufficient"), ("quiet end", 21.0, 25.25, "silence")]
    assert [(g[0], g[3]) for g in got if g[0] in ("few", "flat tops", "long", "short")] == [("few", "invalid"), ("flat tops", "clipping"), ("long", "mixed"), ("short", "insufficient")]


def test_recordings(samples):
    got = {r.signal: r for r in recording.recordings(samples, ["signal"], low=BAND[0], high=BAND[1]).collect()}
    assert got.keys() == SIGNALS.keys()
    assert got["few"].final_state == "invalid" and got["too short"].final_state == "insufficient" and got["flat tops"].final_state == "clipping"
    states = [r.state for r in recording.observations(samples, ["signal"], low=BAND[0], high=BAND[1]).collect() if r.signal == "long" and r.reliable]
    assert got["long"].observations == len(states)


def test_spectrogram(samples):
    found = spectral.spectrogram(samples.where("signal in ('long', 'short', 'few')"), ["signal"]).collect()
    for k in ("long", "short"):
        times, freq, level = spectra.spectrogram(SIGNALS[k], RATE)
        own = sorted((r.time, r.freq, r.db) for r in found if r.signal == k)
        assert np.allclose(own, [(t, f, d) for t, row in zip(times, level) for f, d in zip(freq, row)])
    assert {r.signal for r in found} == {"long", "short"}


def test_no_signals(spark):
    none = spark.createDataFrame([], "signal string, n long, x double, rate double")
    assert recording.observations(none, ["signal"]).collect() == []
    assert recording.recordings(none, ["signal"]).collect() == []
    assert intervals.COLORS


def test_chunks_give_frames_and_whole_signals(samples):
    """What is measured chunk by chunk is what rows give, and samples are put into chunks once for all of it."""
    cut = recording.chunked(samples, ["signal"]).persist()
    columns = ["signal", "frame", "begins", "ends", "time", "samples"]
    found = {tuple(r[c] for c in columns): r for r in recording.framed(cut, ["signal"]).collect()}
    want = {tuple(r[c] for c in columns): r for r in recording.frame_levels(samples, ["signal"]).collect()}
    assert found.keys() == want.keys()
    for k, row in want.items():
        same(found[k], row.asDict())
    plan = recording.framed(cut, ["signal"])._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan and not plan.partition("InMemoryRelation")[0].count("Exchange")


def test_plateaus_pass_from_chunk_to_chunk(spark):
    """A flat top over a chunk's end counts each of its samples but the first, as in the signal whole."""
    n = 16 * RATE
    x = np.zeros(2 * n + 100)
    x[n - 5 : n + 5], x[n - 2], x[2 * n] = 0.9, np.nan, 0.8
    rows = spark.createDataFrame([("s", i, float(v), float(RATE)) for i, v in enumerate(x)], "signal string, n long, x double, rate double")
    found = recording.whole(rows, ["signal"], *BAND).first()
    assert found.plateau == recording.levels(x, RATE)["plateau"] == 8 / (len(x) - 1)


@pytest.mark.parametrize("rate", [1000.0, 64.0])
def test_whole_signals_use_every_frame(spark, rate):
    """Also if signals have over 48 frames, and if a frame is longer than a window or a chunk of windows."""
    x = noise(8, 150_000) * np.where(np.arange(150_000) // 4096 % 3 == 1, 0.1, 1)
    rows = spark.createDataFrame([("s", i, float(v), rate) for i, v in enumerate(x)], "signal string, n long, x double, rate double").repartition(5)
    band = (rate / 100, rate * 0.4)
    found, plain = recording.whole(rows, ["signal"], *band).first(), recording.measure(x, rate, *band, budget=None)
    assert found.segments == plain["segments"] == (150_000 - 4096) // 2048 + 1
    for name in ("beta", "r2", "rmse_db", "flatness", "smooth_db", "evidence", "prominence_db", "occupancy"):
        assert found[name] == pytest.approx(plain[name], rel=1e-6), name


def test_chunks_too_short_for_a_frame_are_refused(spark):
    rows = spark.range(20_000).select(F.lit("s").alias("signal"), F.col("id").alias("n"), F.sin("id").alias("x"), F.lit(64.0).alias("rate"))
    with pytest.raises(Exception, match="chunks must hold a frame"):
        recording.measured_whole(recording.chunked(rows, ["signal"]), ["signal"], 2.0, 30.0).collect()


def test_recordings_use_every_frame_of_slow_signals(spark):
    """At 64 Hz a frame is longer than eight steps of windows; the recording's chunks hold it all the same."""
    x = noise(9, 130_000) * np.where(np.arange(130_000) // 4096 % 3 == 1, 0.1, 1)
    rows = spark.createDataFrame([("s", i, float(v), 64.0) for i, v in enumerate(x)], "signal string, n long, x double, rate double").repartition(5)
    seen = spark.createDataFrame([("s", 3.0, "pink", True, 1.0, 1.0, 0.9, 0.5)], "signal string, time double, state string, reliable boolean, beta double, rmse_db double, r2 double, flatness double")
    found, plain = recording.recordings(rows, ["signal"], low=2.0, high=30.0, seen=seen).first(), recording.measure(x, 64.0, 2.0, 30.0, budget=None)
    assert found.segments == plain["segments"] == (130_000 - 4096) // 2048 + 1
    same(found, plain)
    assert found.beta == pytest.approx(plain["beta"], rel=1e-6) and found.flatness == pytest.approx(plain["flatness"], rel=1e-6)
