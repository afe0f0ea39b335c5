"""Spectra, fits, diagnostics and gates on synthesised signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import spectra
from lumenfold.operators import spectral
from lumenfold.plans import recording, replay
from lumenfold.signal_queries import colored

RATE = 16_000


@pytest.mark.parametrize("beta", [-2, -1, 0, 1, 2])
def test_exponents(beta):
    """Recovered within 0.2 on 65,536 samples, whatever the gain."""
    x = colored(beta, 5 + beta, 65_536)
    found = [spectra.power_law(*spectra.welch(x * g, RATE)[:2], 100, 7000).beta for g in (1, 0.01)]
    assert abs(found[0] - beta) <= 0.2 and found[0] == pytest.approx(found[1], abs=1e-9)


def test_welch_is_the_direct_transform():
    x = np.random.default_rng(1).normal(size=700)
    freq, power, n = spectra.welch(x, 1000.0, 256)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 255)
    turn = np.exp(-2j * np.pi * np.outer(np.arange(129), np.arange(256)) / 256)
    want = np.mean([np.abs(turn @ ((x[s : s + 256] - x[s : s + 256].mean()) * w)) ** 2 for s in range(0, 700 - 255, 128)], 0) / (1000 * (w @ w))
    want[1:-1] *= 2
    assert n == 4 and np.allclose(power, want, rtol=1e-9) and freq[1] == 1000 / 256


def test_frames():
    assert spectra.frame_starts(1000, 256, budget=1).tolist() == [2 * 128]
    assert spectra.frame_starts(384, 256, budget=1).tolist() == [0]
    assert spectra.frame_starts(256 * 11, 256, budget=3).tolist() == [0, 10 * 128, 20 * 128]
    assert len(spectra.frame_starts(255, 256)) == 0 and spectra.welch(np.zeros(255), 100.0)[2] == 0
    assert spectra.frame_size(3000) == 2048 and spectra.frame_size(100) == 256


@pytest.mark.parametrize("beta", [-2, -1, 0, 1, 2])
def test_noise_is_shaped_to_each_color(beta):
    noise = np.random.default_rng(beta + 3).random(120_000) - 0.5
    x = spectra.shaped(noise, beta)
    assert len(x) == len(noise) - 4096
    assert spectra.power_law(*spectra.welch(x, 16_000.0)[:2], 100, 7000).beta == pytest.approx(beta, abs=0.03)
    assert np.allclose(spectra.shaped(noise[1000:30_000], beta), x[1000 : 1000 + 29_000 - 4096], atol=1e-9)


def test_fits_at_once_are_those_one_by_one():
    """All hinges of a spectrum are fitted together; one by one took over a tenth of a second a window."""
    rng = np.random.default_rng(5)
    x = np.linspace(2, 4, 48)
    y = rng.normal(size=48) * np.where(rng.random(48) < 0.1, 5, 0.2) + x
    powers = np.stack([(x - x.mean()) ** k for k in range(6)], 1)
    bases = np.stack([np.column_stack([powers, np.maximum(0.0, x - at)]) for at in [*x[7:47], 0.0]])
    found = spectra.robust_each(bases, y)
    for i, basis in enumerate(bases):
        one = spectra.robust(basis, y)
        assert found.good[i] == (one is not None)
        if one:
            assert found.last[i] == pytest.approx(one.coefficients[-1]) and np.allclose(found.rest[i], one.rest) and np.allclose(found.weights[i], one.weights) and found.novelty[i] == pytest.approx(one.novelty)
    assert not found.good[-1] and not spectra.robust_each(bases[:, :8], y[:8]).good.any()
    exact = spectra.robust_each(bases[:3], bases[0] @ np.arange(7.0))
    assert exact.good.all() and exact.last[0] == pytest.approx(6)


def test_a_spectrum_takes_few_solves(monkeypatch):
    calls = []
    monkeypatch.setattr(spectra, "_solve", lambda *a, own=spectra._solve: calls.append(1) or own(*a))
    spectra.adequacy(np.arange(513) * 15.625, np.exp(np.random.default_rng(2).normal(size=513)))
    assert len(calls) <= 5


def test_robust_fits_do_not_follow_outliers():
    x = np.linspace(-1, 1, 40)
    basis = np.stack([np.ones(40), x], 1)
    y = 2 + 3 * x + np.random.default_rng(2).normal(0, 0.05, 40)
    far = y.copy()
    far[::9] += 30
    clean, dirty = spectra.robust(basis, y), spectra.robust(basis, far)
    assert np.allclose(clean.coefficients, [2, 3], atol=0.1) and np.allclose(dirty.coefficients, clean.coefficients, atol=0.6)
    # a constant far from 0 is no outlier: the weights look at the distance from the median
    shifted = spectra.robust(basis[:, 1:], y + 1000, 1)
    assert shifted is not None and spectra.robust(np.stack([np.ones(40), np.ones(40)], 1), y) is None and spectra.robust(basis, y[:3]) is None
    assert clean.novelty == pytest.approx(1, abs=1e-3) and clean.mad_db == pytest.approx(10 * spectra.deviation(clean.rest))


def spectrum(beta_low, beta_high, at):
    """Power that falls by one exponent below `at` Hz and another above."""
    freq = np.arange(2049) * 44100 / 4096
    f = np.maximum(freq, 1)
    return freq, np.where(f < at, (f / at) ** -beta_low, (f / at) ** -beta_high)


def hinges(freq, power):
    """By evidence the best plain hinge, each fitted by least squares: evidence, delta, improvement, relative, support, Hz."""
    x, y = spectra.log_binned(freq, power, 100.0, 8000.0)
    fit = lambda basis: np.linalg.lstsq(basis, y, rcond=None)[0]
    line = np.stack([np.ones(len(x)), x], 1)
    before = np.sum((y - line @ fit(line)) ** 2)
    for i in range(7, len(x) - 1):
        at = (x[i - 1] + x[i]) / 2
        basis = np.column_stack([line, np.maximum(0, x - at)])
        found = fit(basis)
        after = np.sum((y - basis @ found) ** 2)
        support, delta, relative = min(i, len(x) - i), abs(found[2]), max(0.0, 1 - after / before)
        yield delta * relative * np.sqrt(support), delta, 10 * (np.sqrt(before / len(x)) - np.sqrt(after / len(x))), relative, support, 10**at


@pytest.mark.parametrize("change", [0.6, 1.0, 2.0])
@pytest.mark.parametrize("at", [500, 1000, 2500])
@pytest.mark.parametrize("base", [-1.0, 0.0, 1.0, 1.5])
def test_slope_changes(change, at, base):
    freq, power = spectrum(base, base + change, at)
    found = spectra.adequacy(freq, power)
    assert [found[k] for k in ("evidence", "delta", "improvement", "relative", "support", "break_hz")] == pytest.approx(max(hinges(freq, power)), rel=1e-6)
    assert found["delta"] == pytest.approx(change, rel=0.35) and found["break_hz"] == pytest.approx(at, rel=0.4)
    assert found["abrupt_delta"] >= 0.6 * change and found["abrupt_evidence"] >= 0.8 and found["abrupt_relative"] >= 0.35 and found["abrupt_improvement"] >= 0.04


def test_hinges_of_many_spectra_at_once(spark):
    """The scan over rows against the one over arrays, whatever the spectrum."""
    made = {f"{b} {c} {at}": spectrum(b, b + c, at) for b in (-1.0, 0.5) for c in (0.0, 0.7, -1.5) for at in (400, 2000)}
    rows = [(k, i, float(f), float(p)) for k, (freq, power) in made.items() for i, (f, p) in enumerate(zip(freq, power))]
    levels = spectral.log_bin_median(spark.createDataFrame(rows, "k string, bin int, freq double, power double"), ["k"], 100.0, 8000.0)
    found = {r.k: r for r in spectral.hinge_scan(levels, ["k"]).collect()}
    for k, (freq, power) in made.items():
        want = spectra.adequacy(freq, power)
        if want["evidence"] > 1e-6:
            got = found[k]
            assert (got.evidence, got.delta, got.improvement, got.relative, got.support, 10**got.at) == pytest.approx([want[n] for n in ("evidence", "delta", "improvement", "relative", "support", "break_hz")], rel=1e-8)
    assert spectral.hinge_scan(levels.limit(0), ["k"]).collect() == []


def test_one_slope_has_no_change():
    found = spectra.adequacy(*spectrum(1.2, 1.2, 1000))
    assert found["delta"] < 0.1 and found["evidence"] < 0.2 and found["smooth_db"] < 1 and found["abrupt_evidence"] < 0.2
    short = spectra.adequacy(np.arange(5) * 100.0, np.ones(5))
    assert short["smooth_db"] == np.inf and short["evidence"] == 0


def tones(freqs, noise=0.01):
    t = np.arange(RATE * 4) / RATE
    return sum(0.1 * np.sin(2 * np.pi * f * t) for f in freqs) + colored(0, 9, len(t), rms=noise)


def test_tones():
    def found(x, earlier=None):
        freq, power, _ = spectra.welch(x, RATE)
        return spectra.tonality(freq, power, spectra.power_law(freq, power, 100, 7680), 100, 7680, earlier)

    chord = found(tones([440, 880, 1320, 1760]), [445.0, 3000.0])
    assert len(chord["peaks"]) == 4 and chord["harmonic_peaks"] == 4 and chord["harmonic_evidence"] == 1 and chord["persistent"] == 1 and chord["tonal_ratio"] > 0.5
    odd = found(tones([500, 1637, 4211]))
    assert len(odd["peaks"]) == 3 and odd["prominence_db"] > 30
    noise = found(colored(0, 4, RATE * 4))
    assert noise["peaks"] == [] and noise["tonal_ratio"] < 0.02 and noise["normalized_flatness"] > 0.9 and noise["occupancy"] == 1
    few = spectra.tonality(np.arange(10) * 100.0, np.ones(10), spectra.Fit(), 100, 8000)
    assert few["normalized_flatness"] == 0 and few["peaks"] == []


def test_greedy_suppression():
    place, height = np.array([0, 8, 16, 40]), np.array([10.0, 12.0, 11.0, 12.0])
    assert spectra.strongest_apart(place, height).tolist() == [1, 3]
    assert spectra.strongest_apart(np.array([5, 9]), np.array([3.0, 3.0])).tolist() == [0]


def gate(spark, **changes):
    """The gate's state for measurements of clean pink noise with some changed."""
    base = recording.measure(colored(1, 3), RATE) | changes
    frame = spark.createDataFrame([tuple(v.item() if isinstance(v, np.generic) else v for v in (base[f.split(" ")[0]] for f in recording.MEASURES.split(", ")))], recording.MEASURES)
    return recording.gated(frame, F.lit(base.get("temporal_sd"))).select("state", "confidence", "reliable", "reasons").first()


RUNGS = [
    ("pink", {}), ("invalid", {"duration": -1.0}), ("invalid", {"non_finite": 0.1}), ("invalid", {"rms": None}), ("insufficient", {"duration": 1.4}), ("silence", {"dbfs": -58.1}), ("clipping", {"clipping": 0.002}),
    ("clipping", {"near_clipping": 0.02}), ("clipping", {"peak": 1.0}), ("clipping", {"plateau": 0.01}), ("tonal", {"prominence_db": 18.0, "tonal_ratio": 0.3, "normalized_flatness": 0.7}),
    ("tonal", {"prominence_db": 22.0, "tonal_ratio": 0.15, "normalized_flatness": 0.8}), ("tonal", {"prominence_db": 30.0, "tonal_ratio": 0.025}), ("tonal", {"harmonic_peaks": 3, "harmonic_evidence": 0.55, "tonal_ratio": 0.02}),
    ("tonal", {"peaks": 4, "tonal_ratio": 0.06, "normalized_flatness": 0.7}), ("tonal", {"normalized_flatness": 0.07, "occupancy": 0.5}), ("mixed", {"beta": 2.9}), ("mixed", {"beta": None}), ("mixed", {"rmse_db": 5.9}),
    ("mixed", {"abrupt_delta": 0.6, "abrupt_improvement": 0.04, "abrupt_relative": 0.35, "abrupt_evidence": 0.8}), ("pink", {"delta": 0.6, "improvement": 0.04, "relative": 0.35, "evidence": 0.8, "abrupt_delta": 0.3}),
    ("mixed", {"smooth_db": 5.5, "delta": 0.55, "improvement": 0.012, "relative": 0.18, "evidence": 0.2, "abrupt_delta": 0.35}), ("mixed", {"smooth_db": 22.1}), ("mixed", {"smooth_db": float("inf")}),
    ("mixed", {"smooth_rmse_db": 1.6, "smooth_mad_db": 1.2, "rmse_db": 3.9}), ("mixed", {"rmse_db": 2.3, "normalized_flatness": 0.17}), ("mixed", {"smooth_db": 6.1, "occupancy": 0.6}), ("unstable", {"temporal_sd": 0.56}),
    ("pink", {"temporal_sd": 0.55}), ("brown", {"beta": 1.6}), ("white", {"beta": 0.5}),
]


def test_rungs_of_the_gate(spark):
    for state, changes in RUNGS:
        assert gate(spark, **changes).state == state, changes
    assert gate(spark).confidence == "High" and gate(spark, rmse_db=2.3).confidence == "Moderate" and gate(spark, rmse_db=4.7).confidence == "Low"
    assert gate(spark, temporal_sd=0.2).confidence == "Moderate" and gate(spark, beta=1.31).confidence == "Moderate" and not gate(spark, dbfs=-60.0).reliable


def test_framed_density_is_welch(spark):
    x = np.random.default_rng(3).normal(size=5000)
    rows = spark.createDataFrame([("s", i, float(v), 1000.0) for i, v in enumerate(x)] + [("t", i, 1.0, 1000.0) for i in range(200)], "k string, n int, x double, rate double")
    got = spectral.framed_density(rows, ["k"], requested=512, budget=5).orderBy("bin").collect()
    freq, power, n = spectra.welch(x, 1000.0, 512, budget=5)
    assert {r.k for r in got} == {"s"} and {r.segments for r in got} == {n} and np.allclose([r.power for r in got], power) and np.allclose([r.freq for r in got], freq)


def test_spectrogram():
    """One tone is the brightest row; the first bin is never looked at, silence lies at the least double."""
    times, freq, level = spectra.spectrogram(np.sin(2 * np.pi * 1000 * np.arange(RATE) / RATE), RATE)
    assert level.shape == (len(times), 56) and freq[0] == 80 and freq[-1] == pytest.approx(7680) and abs(freq[level.mean(0).argmax()] - 1000) < 90
    assert len(spectra.spectrogram(np.ones(RATE * 60), RATE)[0]) <= 80
    assert spectra.spectrogram(np.zeros(4096), RATE)[2].max() < -3200
    assert len(spectra.spectrogram(np.ones(255), RATE)[0]) == 0


def test_replay(spark):
    freq, power, _ = spectra.welch(colored(1, 6, 65_536), RATE)
    fit = spectra.power_law(freq, power, 100, 7680)
    row = lambda pair, role, rate, p: (pair, role, rate, 100.0, 7680.0, freq.tolist(), p.tolist(), float(fit.beta))
    data = [row("same", "a", 16000.0, power), row("same", "b", 16000.0, power), row("rate", "a", 16000.0, power), row("rate", "b", 8000.0, power), row("bad", "a", 16000.0, -power), row("bad", "b", 16000.0, power)]
    frame = spark.createDataFrame(data, replay.SCHEMA.split(", ", 1)[1])
    reports = replay.replayed(replay.documents(frame)).persist()
    slim = frame.withColumn("compacted", F.col("pair_id") != "same")
    assert replay.documents(slim).count() == 2 and replay.documents(frame.withColumn("power", F.lit(None).cast("array<double>"))).count() == 0
    one = reports.where("pair_id = 'same' and role = 'a'").first()
    assert one.passed and one.valid and one.normalized_flatness == pytest.approx(spectra.tonality(freq, power, fit, 100, 7680)["normalized_flatness"]) and one.smooth_db == pytest.approx(spectra.adequacy(freq, power, 100, 7680)["smooth_db"])
    assert {r.pair_id: r.passed for r in replay.compared(reports).collect()} == {"same": True, "rate": False, "bad": None}
    with pytest.raises(ValueError):
        recording.validated(0, 100, 8000, 4096, 0.5, 48)
    recording.validated(16000, 100, 8000, 4096, 0.5, 48)
