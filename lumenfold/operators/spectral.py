"""Spectral operators over tables: framing, power density, bands, fits, peaks, calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from lumenfold.functions import spectra
from lumenfold.functions.scalars import TINY, decibels, half_up

# Canonical colors by exponent, third-octave centres in Hz.
CANONICAL = [("violet", -2.0), ("blue", -1.0), ("white", 0.0), ("pink", 1.0), ("brown", 2.0)]
THIRD_OCTAVES = [100, 125, 160, 200, 250, 315, 400, 500, 630, 800, 1000, 1250, 1600, 2000, 2500, 3150, 4000, 5000, 6300, 8000, 10000, 12500, 16000]


def signals(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Samples in order as one array for each key. A signal is one row, so its length bounds a task."""
    pairs = F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_v"))))
    return rows.groupBy(*keys).agg(F.transform(pairs, lambda p: p["_v"]).alias("samples"))


def each_signal(rows: DataFrame, function: Callable[[np.ndarray, float], dict], fields: str, keys: Sequence[str], samples: str = "samples", rate: str = "rate", more: Sequence[str] = ()) -> DataFrame:
    """keys and function(samples, rate, numbers of the columns in more) for each row, in Arrow batches."""
    keys = list(keys)
    kinds = _parse_datatype_string(fields)
    arrow = to_arrow_schema(kinds)
    schema = StructType([*rows.select(*keys).schema, *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(keys)
            none = np.zeros(0)
            values = (np.asarray(s.values.to_numpy(zero_copy_only=False), float) if s.is_valid else none for s in b.column(n))
            out = [function(v, *(c.as_py() for c in rest)) for v, *rest in zip(values, *b.columns[n + 1 :])]
            made = [pa.array([o[f.name] for o in out], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), *made], [*keys, *arrow.names])

    return rows.select(*keys, F.col(samples).alias("_samples"), F.col(rate).cast("double").alias("_each_rate"), *[F.col(c).cast("double").alias(f"_each_{c}") for c in more]).mapInArrow(run, schema)


SPECTRUM = "freq array<double>, power array<double>, segments int"


def power_density(rows: DataFrame, keys: Sequence[str], requested: int = 4096, overlap: float = 0.5, budget: int | None = 48) -> DataFrame:
    """keys, freq, power, segments of rows (keys, samples, rate): Welch's averaged periodogram."""

    def one(samples: np.ndarray, rate: float) -> dict:
        freq, power, n = spectra.welch(samples, rate or 0.0, requested, overlap, budget)
        return {"freq": freq.tolist(), "power": power.tolist(), "segments": n}

    return each_signal(rows, one, SPECTRUM, keys)


def framed_density(samples: DataFrame, keys: Sequence[str], requested: int = 4096, overlap: float = 0.5, budget: int = 48) -> DataFrame:
    """keys, bin, freq, power, segments of samples as rows (keys, n from 0, x, rate): Welch's averaged periodogram.

    Only the frames that are used are gathered, each on its own, so a signal may
    be of any length; the average is over rows. Signals under 256 samples have none.
    """
    keys = list(keys)
    lengths = samples.groupBy(*keys).agg((F.max("n") + 1).alias("_length"), F.max("rate").alias("_rate"))
    return _averaged(gathered(samples, keys, frame_plan(lengths, requested, overlap, budget), ["segments", "_rate"]), keys, overlap)


#: Samples of a frame of a long signal, and frames of a chunk that are transformed together.
FRAME, TOGETHER = 4096, 64


def chunked_density(cut: DataFrame, lengths: DataFrame, keys: Sequence[str], requested: int = FRAME, overlap: float = 0.5) -> DataFrame:
    """keys, bin, freq, power, segments of chunks() and their signals' lengths (keys, _length, _rate): the average over every frame.

    A row for each signal is sent to the chunks. A chunk sums the spectra of the
    frames that begin in it, so it must hold a frame's samples beyond its span.
    """
    keys = list(keys)
    same = [F.col(f"c.{k}") == F.col(f"f.{k}") for k in keys]
    framed = lengths.where("_length >= 256 and _rate > 0").select(*keys, "_length", "_rate")
    joined = cut.alias("c").join(F.broadcast(framed).alias("f"), same).select("c.*", "f._length", "f._rate")

    def one(x: np.ndarray, rate: float, chunk: float, span: float, length: float) -> dict:
        size, base = spectra.frame_size(int(length), requested), int(chunk) * int(span)
        hop = max(1, int(spectra.half_up(size * (1 - overlap))))
        first, last = -(-base // hop), min((int(length) - size) // hop, (base + min(int(span), len(x)) - 1) // hop)
        if first <= last and last * hop + size > base + len(x):
            raise ValueError("chunks must hold a frame's samples beyond their span")
        freq, sums = np.zeros(0), 0.0
        for f in range(first, last + 1, TOGETHER):
            part = x[f * hop - base : min(f + TOGETHER - 1, last) * hop + size - base]
            freq, power, n = spectra.welch(np.where(np.isfinite(part), part, 0.0), rate, size, overlap, None)
            sums = sums + power * n
        return {"freq": freq, "sums": sums if len(freq) else freq, "segments": max(0, last - first + 1)}

    rows = each_signal(joined, one, "freq array<double>, sums array<double>, segments long", keys, rate="_rate", more=["chunk", "span", "_length"])
    exploded = rows.select(*keys, "segments", F.posexplode(F.arrays_zip("freq", "sums")).alias("bin", "b"))
    power = F.greatest(F.sum("b.sums") / F.sum("segments"), F.lit(TINY))
    return exploded.groupBy(*keys, "bin").agg(F.first("b.freq").alias("freq"), power.alias("power"), F.sum("segments").cast("int").alias("segments"))


def frame_plan(lengths: DataFrame, requested: int = 4096, overlap: float = 0.5, budget: int = 48) -> DataFrame:
    """Of signals (keys, _length, _rate) with a spectrum the _size and _starts of their frames, at most budget evenly spaced ones."""
    size = F.least(F.lit(1 << (requested.bit_length() - 1)), F.pow(F.lit(2.0), F.floor(F.log2("_length"))).cast("int"))
    framed = lengths.where("_length >= 256 and _rate > 0").withColumn("_size", size).withColumn("_hop", F.greatest(F.lit(1), half_up(F.col("_size") * (1 - overlap)).cast("int")))
    framed = framed.withColumn("_all", F.floor((F.col("_length") - F.col("_size")) / F.col("_hop")).cast("int") + 1).withColumn("segments", F.least(F.lit(budget), "_all"))
    even = F.transform(F.sequence(F.lit(0), F.col("segments") - 1), lambda i: half_up(i * (F.col("_all") - 1) / (F.col("segments") - 1)).cast("int"))
    chosen = F.when(F.col("segments") == 1, F.array(F.floor((F.col("_all") - 1) / 2).cast("int"))).otherwise(even)
    return framed.withColumn("_starts", F.transform(chosen, lambda i: i * F.col("_hop")))


def _averaged(frames: DataFrame, keys: list[str], overlap: float) -> DataFrame:
    """keys, bin, freq, power, segments of frames (keys, _start, segments, _rate, samples)."""

    def one(x: np.ndarray, rate: float) -> dict:
        freq, power, _ = spectra.welch(np.where(np.isfinite(x), x, 0.0), rate, len(x), overlap, 1)
        return {"freq": freq.tolist(), "power": power.tolist()}

    rows = each_signal(frames, one, "freq array<double>, power array<double>", [*keys, "_start", "segments"], rate="_rate")
    exploded = rows.select(*keys, "segments", F.posexplode(F.arrays_zip("freq", "power")).alias("bin", "b"))
    return exploded.groupBy(*keys, "bin").agg(F.first("b.freq").alias("freq"), F.greatest(F.avg("b.power"), F.lit(TINY)).alias("power"), F.first("segments").alias("segments"))


def gathered(samples: DataFrame, keys: Sequence[str], framed: DataFrame, carried: Sequence[str]) -> DataFrame:
    """keys, _start, samples and carried columns of each frame of samples as rows (keys, n, x): framed has keys, _size, _starts and carried."""
    placed = samples.select(*keys, "n", "x").join(framed.select(*keys, "_size", "_starts", *carried), list(keys))
    inside = F.filter("_starts", lambda s: (F.col("n") >= s) & (F.col("n") < s + F.col("_size")))
    placed = placed.select(*keys, *carried, F.explode(inside).alias("_start"), "n", F.col("x").cast("double").alias("x"))
    pairs = F.array_sort(F.collect_list(F.struct("n", "x")))
    return placed.groupBy(*keys, "_start").agg(*[F.first(c).alias(c) for c in carried], F.transform(pairs, lambda p: p["x"]).alias("samples"))


#: Steps of windows that begin in one chunk of a signal.
CHUNK_HOPS = 8


def chunks(samples: DataFrame, keys: Sequence[str], seconds: float = 6.0, step: float = 2.0, least: int = 1) -> DataFrame:
    """keys, chunk, span, rate, samples: a signal as rows (keys, n from 0 without gaps, x, rate) in stretches of span samples.

    Each has as many samples of what follows as windows need that begin in it,
    and at least as many as least, so a signal of any length spreads over tasks
    and no row is longer than a chunk and a window. A span is no shorter than least.
    """
    hop, halo = F.greatest(F.lit(1), half_up(F.col("rate") * step)), F.greatest(F.lit(least), half_up(F.col("rate") * seconds))
    span = hop * F.greatest(F.lit(max(CHUNK_HOPS, -int(-seconds // step))), F.ceil(F.lit(least) / hop))
    placed = samples.select(*keys, "n", F.col("x").cast("double").alias("x"), "rate", span.alias("span"), halo.alias("_halo"))
    own = F.floor(F.col("n") / F.col("span"))
    inside = F.col("n") - own * F.col("span")
    back = F.when(inside < F.col("_halo"), F.floor((F.col("_halo") - 1 - inside) / F.col("span")) + 1).otherwise(0)
    dealt = placed.withColumn("chunk", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), own - back), own)))
    pairs = F.array_sort(F.collect_list(F.struct("n", "x")))
    rows = dealt.groupBy(*keys, "chunk").agg(F.max("span").alias("span"), F.max("rate").alias("rate"), F.transform(pairs, lambda p: p["x"]).alias("samples"))
    return rows


def windows(cut: DataFrame, keys: Sequence[str], seconds: float = 6.0, step: float = 2.0) -> DataFrame:
    """Whole sliding windows of chunks() as rows (keys, start, begins, ends, rate, samples).

    A signal shorter than a window is one window.
    """
    n, hop = F.size("samples"), F.greatest(F.lit(1), half_up(F.col("rate") * step)).cast("int")
    whole = F.greatest(F.lit(1), half_up(F.col("rate") * seconds)).cast("int")
    size = F.when(F.col("chunk") == 0, F.least(whole, n)).otherwise(whole)
    enough = (n >= size) & (n > 0)
    last = F.least(F.col("span").cast("int") - hop, n - size)
    offset = F.explode(F.when(enough, F.sequence(F.lit(0), last, hop)).otherwise(F.array().cast("array<int>")))
    rows = cut.select("*", size.alias("_size"), offset.alias("_offset")).withColumn("start", F.col("chunk") * F.col("span") + F.col("_offset"))
    begins = F.col("start") / F.col("rate")
    return rows.select(*keys, "start", "rate", begins.alias("begins"), (begins + F.col("_size") / F.col("rate")).alias("ends"), F.slice("samples", F.col("_offset") + 1, F.col("_size")).alias("samples"))


def spectrogram(samples: DataFrame, keys: Sequence[str], most: int = 80, rows: int = 56) -> DataFrame:
    """keys, time, freq, db of strided frames of samples as rows (keys, n, x, rate), at log-spaced frequencies; none under 256 samples."""
    keys = list(keys)
    lengths = samples.groupBy(*keys).agg((F.max("n") + 1).alias("_length"), F.max("rate").alias("_rate")).where("_length >= 256 and _rate > 0")
    framed = lengths.withColumn("_size", F.least(F.lit(2048), F.pow(F.lit(2.0), F.floor(F.log2("_length"))).cast("int")))
    hop = F.floor(F.col("_size") / 2)
    stride = F.ceil((F.floor((F.col("_length") - F.col("_size")) / hop) + 1) / most)
    framed = framed.withColumn("_starts", F.sequence(F.lit(0).cast("long"), F.col("_length") - F.col("_size"), hop * stride))

    def one(x: np.ndarray, rate: float) -> dict:
        freq, level = spectra.log_spaced_levels(x, rate, rows)
        return {"freq": freq.tolist(), "db": level.tolist(), "size": len(x)}

    frames = gathered(samples, keys, framed, ["_rate"])
    found = each_signal(frames, one, "freq array<double>, db array<double>, size int", [*keys, "_start", "_rate"], rate="_rate")
    time = (F.col("_start") + F.col("size") / 2) / F.col("_rate")
    return found.select(*keys, time.alias("time"), F.explode(F.arrays_zip("freq", "db")).alias("c")).select(*keys, "time", "c.freq", "c.db")


def bins(spectrum: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, bin, freq, power: a spectrum as rows."""
    return spectrum.select(*keys, F.posexplode(F.arrays_zip("freq", "power")).alias("bin", "b")).select(*keys, "bin", "b.freq", "b.power")


def band(rows: DataFrame, low: float, high: float) -> DataFrame:
    return rows.where((F.col("bin") > 0) & F.col("freq").between(low, high) & (F.col("power") > 0) & (F.col("power") < float("inf")))


def fit_power_law(rows: DataFrame, keys: Sequence[str], low: float, high: float) -> DataFrame:
    """beta, intercept, r2, rmse_db, points of log10 power on log10 frequency, from partial sums; null under 8 points."""
    logs = band(rows, low, high).select(*keys, F.log10("freq").alias("x"), F.log10("power").alias("y"))
    slope, fixed, flat = F.regr_slope("y", "x"), F.regr_intercept("y", "x"), F.regr_syy("y", "x")
    rest = F.greatest(F.lit(0.0), flat - F.pow(F.regr_sxy("y", "x"), F.lit(2.0)) / F.nullif(F.regr_sxx("y", "x"), F.lit(0.0)))
    out = logs.groupBy(*keys).agg(
        F.count("*").alias("points"), (-slope).alias("beta"), fixed.alias("intercept"), F.when(flat > 0, F.greatest(F.lit(0.0), 1 - rest / F.nullif(flat, F.lit(0.0)))).otherwise(0.0).alias("r2"),
        (10 * F.sqrt(rest / F.count("*"))).alias("rmse_db"),
    )
    enough = F.col("points") >= 8
    return out.select(*keys, "points", *[F.when(enough, F.col(c)).alias(c) for c in ("beta", "intercept", "r2", "rmse_db")])


def flatness(power: Column) -> Column:
    return F.exp(F.avg(F.ln(F.greatest(power, F.lit(TINY))))) / F.avg(power)


def third_octaves(rows: DataFrame, keys: Sequence[str], width: Column, centres: Sequence[float] = THIRD_OCTAVES) -> DataFrame:
    """Power within a third octave of each centre, in dB; a bin may lie in two bands or none, empty bands don't come out."""
    half = 2 ** (1 / 6)
    table = F.array(*[F.struct(F.lit(float(c)).alias("c"), F.lit(c / half).alias("lo"), F.lit(c * half).alias("hi")) for c in centres])
    banded = rows.withColumn("_band", F.explode(F.filter(table, lambda b: (F.col("freq") >= b["lo"]) & (F.col("freq") < b["hi"]))))
    return banded.groupBy(*keys, F.col("_band.c").alias("centre")).agg(decibels(F.sum(F.col("power") * width)).alias("db"), F.count("*").alias("bins"))


def log_bin_median(rows: DataFrame, keys: Sequence[str], low: float, high: float, buckets: int = 48) -> DataFrame:
    """Median log10 power in equal buckets of log frequency."""
    a, b = float(np.log10(low)), float(np.log10(high))
    bucket = F.least(F.lit(buckets - 1), F.floor((F.log10("freq") - a) / (b - a) * buckets).cast("int"))
    return band(rows, low, high).groupBy(*keys, bucket.alias("bucket")).agg(F.median(F.log10("power")).alias("level"), F.count("*").alias("bins")).withColumn("x", a + (F.col("bucket") + 0.5) * (b - a) / buckets)


def hinge_scan(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "level", least: int = 7) -> DataFrame:
    """Per key the change of slope between two neighbouring points with the most evidence: at, delta, improvement, relative, evidence, support.

    Every place between points is tried from the least-th one on, with a point
    left after it, as a hinge beside a straight line. What a hinge adds follows
    from sums over the points beyond it, which are totals less running sums, so
    all places of a key come from one window over its points (a few dozen). Sums
    are of x from its mean. Keys with too few points or no gain don't come out.
    """
    keys = list(keys)
    everything = Window.partitionBy(*keys)
    before = everything.orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    centred = points.select(*keys, (F.col(x) - F.avg(x).over(everything)).alias("_x"), (F.col(y) - F.avg(y).over(everything)).alias("_y"), F.col(x).alias("_at"))
    placed = centred.withColumns({"_n": F.count("*").over(everything), "_i": F.row_number().over(everything.orderBy("_x")) - 1, "_b": (F.col("_x") + F.lag("_x").over(everything.orderBy("_x"))) / 2, "_mid": (F.col("_at") + F.lag("_at").over(everything.orderBy("_x"))) / 2})
    terms = {"1": F.lit(1.0), "x": F.col("_x"), "y": F.col("_y"), "xx": F.col("_x") * F.col("_x"), "xy": F.col("_x") * F.col("_y"), "yy": F.col("_y") * F.col("_y")}
    sums = placed.withColumns({f"_all_{k}": F.sum(t).over(everything) for k, t in terms.items()} | {f"_to_{k}": F.sum(t).over(before) for k, t in terms.items() if k != "yy"})
    sums = sums.where((F.col("_i") >= least) & (F.col("_i") < F.col("_n") - 1))
    beyond = {k: F.col(f"_all_{k}") - F.col(f"_to_{k}") for k in terms if k != "yy"}
    b, n, xx, xy, yy = (F.col(c) for c in ("_b", "_n", "_all_xx", "_all_xy", "_all_yy"))
    h = beyond["x"] - b * beyond["1"]
    hh = beyond["xx"] - 2 * b * beyond["x"] + b * b * beyond["1"] - h * h / n
    xh, yh = beyond["xx"] - b * beyond["x"], beyond["xy"] - b * beyond["y"]
    energy = hh - xh * xh / F.nullif(xx, F.lit(0.0))
    gained = sums.withColumns({"_energy": energy, "_line": yy - xy * xy / F.nullif(xx, F.lit(0.0)), "_pull": yh - xy * xh / F.nullif(xx, F.lit(0.0))}).where(F.col("_energy") > 2.0**-52)
    gained = gained.withColumn("delta", F.abs(F.col("_pull") / F.col("_energy"))).withColumn("_rest", F.greatest(F.lit(0.0), F.col("_line") - F.col("_pull") * F.col("_pull") / F.col("_energy")))
    relative = F.when(F.col("_line") > 0, F.greatest(F.lit(0.0), 1 - F.col("_rest") / F.nullif(F.col("_line"), F.lit(0.0)))).otherwise(0.0)
    gained = gained.withColumns({"relative": relative, "support": F.least(F.col("_i"), n - F.col("_i"))})
    gained = gained.withColumns({"evidence": F.col("delta") * F.col("relative") * F.sqrt("support"), "improvement": 10 * (F.sqrt(F.col("_line") / n) - F.sqrt(F.col("_rest") / n))})
    best = F.max_by(F.struct(F.col("_mid").alias("at"), "delta", "improvement", "relative", "evidence", "support"), F.struct("evidence", -F.col("_i")))
    return gained.where("evidence > 0").groupBy(*keys).agg(best.alias("_h")).select(*keys, "_h.*")


def local_maxima(rows: DataFrame, keys: Sequence[str], order: str, value: str, reach: int = 2) -> DataFrame:
    """Rows strictly above all neighbours within reach."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = (F.coalesce(F.max(value).over(w.rowsBetween(*r)), F.lit(float("-inf"))) for r in ((-reach, -1), (1, reach)))
    return rows.withColumn("_top", F.greatest(before, after)).where(F.col(value) > F.col("_top")).drop("_top")


def floor_and_prominence(rows: DataFrame, keys: Sequence[str], order: str, value: str, reach: int = 18, gap: int = 3) -> DataFrame:
    """floor: the median of the neighbours within reach but not within gap; prominence: value above it."""
    w = Window.partitionBy(*keys).orderBy(order)
    near = F.array_sort(F.concat(F.collect_list(value).over(w.rowsBetween(-reach, -gap - 1)), F.collect_list(value).over(w.rowsBetween(gap + 1, reach))))
    n = F.size("_near")
    middle = (F.get("_near", F.floor((n - 1) / 2).cast("int")) + F.get("_near", F.floor(n / 2).cast("int"))) / 2
    return rows.withColumn("_near", near).withColumn("floor", middle).drop("_near").withColumn("prominence", F.col(value) - F.col("floor"))


def persistent(peaks: DataFrame, earlier: DataFrame, keys: Sequence[str], freq: str = "freq") -> DataFrame:
    """Peaks with an earlier peak within the larger of 12 Hz and 2% of it. Both sides are a few peaks for each key."""
    e = earlier.select(*keys, F.col(freq).alias("_g"))
    condition = [F.col(f"p.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys] + [F.abs(F.col(f"p.{freq}") - F.col("e._g")) <= F.greatest(F.lit(12.0), 0.02 * F.col("e._g"))]
    return peaks.alias("p").join(e.alias("e"), condition, "left_semi")


def harmonic_match(peaks: DataFrame, keys: Sequence[str], step: Column, freq: str = "freq", most: int = 12) -> DataFrame:
    """Per key the most peaks that are multiples (1 to most) of one base of at least 40 Hz, a peak over 1 to most."""
    arrays = peaks.groupBy(*keys).agg(F.sort_array(F.collect_set(freq)).alias("_f"), F.max(step).alias("_step"))
    base = F.explode(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda d: F.col("_seed") / d))
    bases = arrays.select("*", F.explode("_f").alias("_seed")).select("*", base.alias("_base")).where("_base >= 40")

    def fits(f: Column) -> Column:
        number = half_up(f / F.col("_base"))
        return number.between(1, most) & (F.abs(f / F.col("_base") - number) / number <= F.greatest(F.lit(0.018), 2 * F.col("_step") / f))

    return bases.groupBy(*keys).agg(F.max(F.size(F.filter("_f", fits))).alias("harmonic_peaks"))


def suppressed(peaks: Column, reach: int = 10) -> Column:
    """Of an array of (prominence, bin, ...) those that no stronger kept one is within reach of, strongest first, of equals the lower bin."""
    order = lambda a, b: F.when(a["prominence"] != b["prominence"], F.when(a["prominence"] > b["prominence"], -1).otherwise(1)).when(a["bin"] < b["bin"], -1).when(a["bin"] > b["bin"], 1).otherwise(0)
    ranked = F.array_sort(peaks, order)
    return F.aggregate(ranked, F.slice(ranked, 1, 0), lambda kept, p: F.when(F.exists(kept, lambda k: F.abs(k["bin"] - p["bin"]) <= reach), kept).otherwise(F.concat(kept, F.array(p))))


def correction_at(freq: Column, points: Column) -> Column:
    """Calibration in dB at freq: linear in log frequency between points (frequency, db), flat beyond them."""
    ordered = F.array_sort(F.filter(points, lambda p: (p["frequency"] > 0) & (p["frequency"] < float("inf")) & (F.abs(p["db"]) < float("inf"))))
    below, above = F.filter(ordered, lambda p: p["frequency"] <= freq), F.filter(ordered, lambda p: p["frequency"] > freq)
    a, b = F.try_element_at(below, F.lit(-1)), F.get(above, F.lit(0))
    share = F.ln(freq / a["frequency"]) / F.ln(b["frequency"] / a["frequency"])
    between = a["db"] + (b["db"] - a["db"]) * share
    return F.when(a.isNull(), b["db"]).when(b.isNull(), a["db"]).otherwise(between)


def calibrated(rows: DataFrame, profiles: DataFrame, route: str = "route_id") -> DataFrame:
    """rows (route, freq, power) with the profile's correction; without a profile as they are, and why."""
    joined = rows.join(profiles.select(F.col(route), F.col("points").alias("_points")), route, "left")
    db = F.coalesce(correction_at(F.col("freq"), F.col("_points")), F.lit(0.0))
    reason = F.when(F.col("_points").isNull(), "no profile for this route")
    return joined.withColumn("correction_db", db).withColumn("power", F.col("power") * F.pow(F.lit(10.0), db / 10)).withColumn("uncorrected_reason", reason).drop("_points")


def nearest_canonical(beta: Column) -> Column:
    """The color whose exponent is nearest; halfway the lower one."""
    ranked = F.array_sort(F.array(*[F.struct(F.abs(beta - b).alias("d"), F.lit(b).alias("b"), F.lit(c).alias("c")) for c, b in CANONICAL]))
    return F.when(beta.isNotNull() & ~F.isnan(beta), ranked[0]["c"])
