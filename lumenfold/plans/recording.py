"""The whole analysis of recordings: windows, measurements, gates, timelines and a summary."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import spectra
from lumenfold.functions.scalars import half_up
from lumenfold.operators import classify, intervals, spectral, stats

from .shared import settled

MEASURES = (
    "duration double, rms double, dbfs double, peak double, clipping double, near_clipping double, plateau double, crest double, kurtosis double, edge_density double, non_finite double, "
    "beta double, r2 double, rmse_db double, mae_db double, points int, flatness double, prominence_db double, tonal_ratio double, peaks int, persistent int, harmonic_peaks int, normalized_flatness double, "
    "occupancy double, harmonic_evidence double, smooth_db double, smooth_rmse_db double, smooth_mad_db double, delta double, support double, improvement double, relative double, evidence double, abrupt_delta double, abrupt_improvement double, abrupt_relative double, abrupt_evidence double, segments int"
)


def validated(rate: float, low: float, high: float, size: int, overlap: float, budget: int) -> None:
    """Raises ValueError for options that no analysis can use."""
    if not (np.isfinite(rate) and rate > 0):
        raise ValueError("rate must be positive")
    if not 0 < low < high:
        raise ValueError("the fit range must be positive and ascending")
    if size < 256 or not 0 <= overlap < 1 or budget <= 0:
        raise ValueError("frames need 256 samples, an overlap below 1 and a budget")


def levels(samples: np.ndarray, rate: float) -> dict:
    """Duration, level, clipping and shape of some samples."""
    x = np.asarray(samples, np.float32).astype(np.float64)
    good = x[np.isfinite(x)]
    n = len(good)
    a, rms = np.abs(good), float(np.sqrt(np.square(good).mean())) if n else None
    share = lambda m: float(m.sum()) / n if n else None
    out = dict(duration=len(x) / rate if rate else None, rms=rms, dbfs=20 * float(np.log10(max(1e-12, rms))) if n else None, peak=float(a.max()) if n else None)
    out |= dict(clipping=share(a >= stats.CLIP), near_clipping=share(a >= stats.NEAR_CLIP), plateau=share((a[1:] >= stats.PLATEAU_LEVEL) & (np.abs(np.diff(good)) <= stats.PLATEAU_STEP)))
    return out | dict(crest=out["peak"] / rms if rms else None, kurtosis=float((good**4).mean() / rms**4) if rms else None, edge_density=share(a >= 0.9 * a.max()) if n else None, non_finite=1 - n / len(x) if len(x) else 0.0)


def measure(samples: np.ndarray, rate: float, low: float = spectra.FIT_RANGE[0], high: float = spectra.FIT_RANGE[1], budget: int = 48) -> dict:
    """All measurements of one window of samples."""
    x = np.asarray(samples, np.float32).astype(np.float64)
    freq, power, segments = spectra.welch(np.where(np.isfinite(x), x, 0.0), rate or 0.0, budget=budget)
    return levels(samples, rate) | diagnosed(freq, power, rate, low, high) | {"segments": segments}


def diagnosed(freq: np.ndarray, power: np.ndarray, rate: float, low: float, high: float) -> dict:
    """The measurements of a spectrum."""
    high = min(high, 0.48 * (rate or 0.0))
    fit = spectra.power_law(freq, power, low, high)
    tone = spectra.tonality(freq, power, fit, low, high)
    model = spectra.adequacy(freq, power, low, max(high, low + 1))
    value = lambda v: float(v) if v is not None and np.isfinite(v) else None
    out = dict(beta=value(fit.beta), r2=fit.r2, rmse_db=value(fit.rmse_db), mae_db=value(fit.mae_db), points=fit.points, flatness=spectra.flatness(power[spectra.in_range(freq, power, low, high)]) if len(freq) else 0.0)
    out |= {k: tone[k] for k in ("prominence_db", "tonal_ratio", "persistent", "harmonic_peaks", "normalized_flatness", "occupancy", "harmonic_evidence")} | {"peaks": len(tone["peaks"])}
    return out | {k: float(model[k]) for k in ("smooth_db", "smooth_rmse_db", "smooth_mad_db", "delta", "support", "improvement", "relative", "evidence", "abrupt_delta", "abrupt_improvement", "abrupt_relative", "abrupt_evidence")}


def clipped() -> Column:
    """Whether the levels of a row tell of clipping or limiting."""
    limited = stats.limiting(*(F.col(x) for x in ("plateau", "dbfs", "crest", "kurtosis", "edge_density")))
    return (F.col("clipping") > 0.001) | (F.col("near_clipping") > 0.01) | (F.col("peak") >= 0.9999) | limited


def gated(measured: DataFrame, temporal_sd: Column | None = None) -> DataFrame:
    """measured with state, confidence, reliable and reasons."""
    c = {name: F.col(name) for name in measured.columns}
    c["limiting"] = stats.limiting(*(F.col(x) for x in ("plateau", "dbfs", "crest", "kurtosis", "edge_density")))
    c["temporal_sd"] = F.lit(None).cast("double") if temporal_sd is None else temporal_sd
    return measured.withColumn("_gate", classify.quality_gate(c)).select(*measured.columns, "_gate.*")


#: Seconds of frames that are put in order together, and of a frame.
TIMELINE_BUCKET, FRAME_SECONDS = 512.0, 0.5
_LEVELS = ["rms", "dbfs", "peak", "clipping", "near_clipping", "plateau", "crest", "kurtosis", "edge_density", "non_finite"]


def _single(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples as rows (keys, n from 0 without gaps, x, rate), to single precision as they were captured."""
    return samples.select(*keys, "n", F.col("x").cast("float").cast("double").alias("x"), F.col("rate").cast("double").alias("rate"))


def observations(samples: DataFrame, keys: Sequence[str], seconds: float = 6.0, step: float = 2.0, low: float = spectra.FIT_RANGE[0], high: float = spectra.FIT_RANGE[1]) -> DataFrame:
    """One gated row for each window of signals as rows (keys, n from 0 without gaps, x, rate), measured chunk by chunk."""
    return observed(chunked(samples, keys, seconds, step), keys, seconds, step, low, high)


def chunked(samples: DataFrame, keys: Sequence[str], seconds: float = 6.0, step: float = 2.0, least: int = 1) -> DataFrame:
    """Samples as spectral.chunks() from which observed(), framed() and, if least is spectral.FRAME, measured_whole() take their own: rows are shuffled once."""
    return spectral.chunks(_single(samples, keys), keys, max(seconds, FRAME_SECONDS), step, least)


def observed(cut: DataFrame, keys: Sequence[str], seconds: float = 6.0, step: float = 2.0, low: float = spectra.FIT_RANGE[0], high: float = spectra.FIT_RANGE[1]) -> DataFrame:
    """observations() of chunked() samples."""
    validated(1.0, low, high, 256, 0.5, 24)
    keys = list(keys)
    measured = spectral.each_signal(spectral.windows(cut, keys, seconds, step), lambda x, r: measure(x, r, low, high, 24), MEASURES, [*keys, "start", "begins", "ends"])
    return gated(measured).withColumn("time", (F.col("begins") + F.col("ends")) / 2)


def frame_levels(samples: DataFrame, keys: Sequence[str], seconds: float = FRAME_SECONDS) -> DataFrame:
    """keys, frame, begins, ends, time, samples and levels of frames of seconds, the last one as it is; the samples meet by frame."""
    keys = list(keys)
    size = F.greatest(F.lit(1), half_up(F.col("rate") * seconds))
    framed = _single(samples, keys).select(*keys, F.floor(F.col("n") / size).alias("frame"), size.alias("_size"), "rate", "n", "x")
    found = stats.input_metrics(framed, [*keys, "frame", "_size", "rate"], "x", ["n"])
    begins, ends = F.col("frame") * F.col("_size") / F.col("rate"), (F.col("frame") * F.col("_size") + F.col("samples")) / F.col("rate")
    return found.select(*keys, "frame", begins.alias("begins"), ends.alias("ends"), ((begins + ends) / 2).alias("time"), "samples", *_LEVELS, "limiting")


def framed(cut: DataFrame, keys: Sequence[str], seconds: float = FRAME_SECONDS) -> DataFrame:
    """frame_levels() of chunked() samples, without limiting: a chunk measures the frames that begin in it."""
    keys = list(keys)
    fields = ["frame long", "begins double", "ends double", "time double", "samples long", *[f"{n} double" for n in _LEVELS]]

    def one(x: np.ndarray, rate: float, chunk: float, span: float) -> dict:
        size, base, found = max(1, int(spectra.half_up((rate or 0.0) * seconds))), int(chunk) * int(span), []
        for f in range(-(-base // size), -(-(base + min(int(span), len(x))) // size)):
            part = x[f * size - base : (f + 1) * size - base]
            begins, ends = (f * size / rate, (f * size + len(part)) / rate) if rate else (None, None)
            level = levels(part, rate)
            found.append(dict(frame=f, begins=begins, ends=ends, time=(begins + ends) / 2 if rate else None, samples=len(part)) | {n: level[n] for n in _LEVELS})
        return {"frames": found}

    kind = ", ".join(f.replace(" ", ": ") for f in fields)
    return spectral.each_signal(cut, one, f"frames array<struct<{kind}>>", keys, more=["chunk", "span"]).select(*keys, F.inline("frames"))


def timeline(samples: DataFrame, keys: Sequence[str], seen: DataFrame) -> DataFrame:
    """Segments of half-second frames by their own level, else by the state of the nearest of seen (keys, time, state)."""
    return framed_timeline(frame_levels(samples, keys), keys, seen)


def framed_timeline(frames: DataFrame, keys: Sequence[str], seen: DataFrame) -> DataFrame:
    """timeline() of frames with their levels."""
    keys = list(keys)
    near = intervals.nearest(frames, seen.select(*keys, "time", "state"), keys, "time", ["state"], width=TIMELINE_BUCKET)
    state = classify.activity_state(F.col("samples"), F.col("non_finite"), F.col("dbfs"), clipped(), F.col("nearest_state"))
    return intervals.merged(near.withColumn("state", state), keys, "state", "begins", "ends", TIMELINE_BUCKET)


PARTS = "n long, good long, squares double, fourths double, peak double, clipping long, near_clipping long, plateau long, first double, last double"


def _part(x: np.ndarray, rate: float, span: float) -> dict:
    """Sums over a chunk's own samples, from which those of its signal follow."""
    own = x[: int(span)].astype(np.float32).astype(np.float64)
    good = own[np.isfinite(own)]
    if not len(good):
        return dict.fromkeys(f.split(" ")[0] for f in PARTS.split(", ")) | dict(n=len(own), good=0)
    a, square = np.abs(good), np.square(good)
    plateau = (a[1:] >= stats.PLATEAU_LEVEL) & (np.abs(np.diff(good)) <= stats.PLATEAU_STEP)
    return dict(
        n=len(own), good=len(good), squares=float(square.sum()), fourths=float(np.square(square).sum()), peak=float(a.max()), clipping=int((a >= stats.CLIP).sum()), near_clipping=int((a >= stats.NEAR_CLIP).sum()),
        plateau=int(plateau.sum()), first=float(good[0]), last=float(good[-1]),
    )


def whole(samples: DataFrame, keys: Sequence[str], low: float = spectra.FIT_RANGE[0], high: float = spectra.FIT_RANGE[1]) -> DataFrame:
    """keys and MEASURES of whole signals: levels from partial sums, the spectrum from all frames, one row of at most 2049 bins for each signal."""
    return measured_whole(settled(chunked(samples, keys, least=spectral.FRAME)), keys, low, high)


def measured_whole(cut: DataFrame, keys: Sequence[str], low: float = spectra.FIT_RANGE[0], high: float = spectra.FIT_RANGE[1]) -> DataFrame:
    """whole() of chunked() samples. Rows of one for each signal are sent to the chunks, which stay where they are."""
    validated(1.0, low, high, spectral.FRAME, 0.5, 1)
    keys = list(keys)
    parts = settled(spectral.each_signal(cut, _part, PARTS, [*keys, "chunk", "rate"], more=["span"]))
    before = F.last("last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    flat = (F.abs("first") >= stats.PLATEAU_LEVEL) & (F.abs(F.col("first") - F.col("_before")) <= stats.PLATEAU_STEP)
    sums = ["n", "good", "squares", "fourths", "clipping", "near_clipping", "plateau"]
    joint = parts.withColumn("_before", before).withColumn("plateau", F.col("plateau") + F.coalesce(flat.cast("int"), F.lit(0)))
    total = settled(joint.groupBy(*keys).agg(F.max("rate").alias("rate"), F.max("peak").alias("peak"), *[F.sum(c).alias(c) for c in sums]))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    edged = cut.alias("c").join(F.broadcast(total.where("peak is not null").select(*keys, F.col("peak").alias("_peak"))).alias("p"), same).select("c.*", "p._peak")
    count = lambda x, r, span, peak: {"edges": int((np.abs(x[: int(span)].astype(np.float32).astype(np.float64)[np.isfinite(x[: int(span)])]) >= 0.9 * peak).sum())}
    edges = spectral.each_signal(edged, count, "edges long", keys, more=["span", "_peak"]).groupBy(*keys).agg(F.sum("edges").alias("edges"))
    found = total.alias("c").join(edges.alias("p"), same, "left").select("c.*", "p.edges")
    good = F.nullif(F.col("good"), F.lit(0))
    rms = F.sqrt(F.col("squares") / good)
    found = found.select(
        *keys, "rate", (F.col("n") / F.col("rate")).alias("duration"), rms.alias("rms"), stats.dbfs(rms).alias("dbfs"), "peak", (F.col("clipping") / good).alias("clipping"), (F.col("near_clipping") / good).alias("near_clipping"), (F.col("plateau") / good).alias("plateau"),
        (F.col("peak") / F.nullif(rms, F.lit(0.0))).alias("crest"), (F.col("fourths") / good / F.nullif(F.pow(rms, F.lit(4.0)), F.lit(0.0))).alias("kurtosis"), (F.col("edges") / good).alias("edge_density"), (1 - F.col("good") / F.col("n")).alias("non_finite"),
    )
    bins = spectral.chunked_density(cut, total.select(*keys, F.col("n").alias("_length"), F.col("rate").alias("_rate")), keys)
    ordered = F.array_sort(F.collect_list(F.struct("bin", "freq", "power")))
    spectrum = bins.groupBy(*keys).agg(ordered.alias("_b"), F.max("segments").alias("segments"))
    packed = F.concat(F.transform("_b", lambda b: b["freq"]), F.transform("_b", lambda b: b["power"]))
    joined = found.join(spectrum.select(*keys, packed.alias("spectrum"), "segments"), keys, "left").withColumn("segments", F.coalesce("segments", F.lit(0)))
    names = [f.split(" ") for f in MEASURES.split(", ")]
    own = [n for n, _ in names if n not in ("duration", "segments", *_LEVELS)]
    carried = [*keys, "duration", *_LEVELS, "segments"]
    measured = spectral.each_signal(joined, lambda x, r: diagnosed(x[: len(x) // 2], x[len(x) // 2 :], r, low, high), ", ".join(f"{n} {k}" for n, k in names if n in own), carried, "spectrum")
    return measured.select(*keys, *[n for n, _ in names])


def recordings(samples: DataFrame, keys: Sequence[str], seconds: float = 6.0, step: float = 2.0, low: float = spectra.FIT_RANGE[0], high: float = spectra.FIT_RANGE[1], seen: DataFrame | None = None) -> DataFrame:
    """One row for each signal: its measurements, gate, stability over windows (seen, if they are known), and the session's summary.

    rejected_percent and top_rejected come from the seconds of the activity
    timeline; of states that last as long the one named first in STATES counts.
    """
    return summarized(settled(chunked(samples, keys, seconds, step, spectral.FRAME)), keys, seconds, step, low, high, seen)


def summarized(cut: DataFrame, keys: Sequence[str], seconds: float = 6.0, step: float = 2.0, low: float = spectra.FIT_RANGE[0], high: float = spectra.FIT_RANGE[1], seen: DataFrame | None = None) -> DataFrame:
    """recordings() of chunked() samples, which are read some times."""
    keys = list(keys)
    if seen is None:  # measured once, read by the timeline and the summary
        seen = settled(observed(cut, keys, seconds, step, low, high).select(*keys, "time", "state", "reliable", "beta", "rmse_db", "r2", "flatness"))
    durations = settled(intervals.state_durations(framed_timeline(framed(cut, keys), keys, seen), keys))
    rank = F.array_position(F.array(*map(F.lit, intervals.STATES)), F.col("state"))
    rejected = ~F.col("state").isin(intervals.COLORS)
    worst = durations.groupBy(*keys).agg(F.max_by(F.when(rejected, F.col("state")), F.when(rejected, F.struct("seconds", -rank))).alias("top_rejected"))
    summary = intervals.session_summary(seen, durations, keys).select(*keys, "dominant", "reliable_percent", "rejected_percent", "beta_mean", F.col("beta_sd").alias("temporal_sd"), "beta_median", "observations")
    joined = gated(measured_whole(cut, keys, low, high).join(summary, keys, "left"), F.col("temporal_sd")).join(worst, keys, "left")
    return joined.withColumn("final_state", classify.recording_state(F.col("state"), F.col("reliable"), F.col("temporal_sd"), F.col("rejected_percent"), F.col("top_rejected")))
