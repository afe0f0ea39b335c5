"""Summaries of samples: levels, clipping, plateaus, spread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.scalars import finite

from . import buckets

# Fixed thresholds of level and limiting checks.
CLIP, NEAR_CLIP, PLATEAU_LEVEL, PLATEAU_STEP, SILENT_RMS = 0.99, 0.98, 0.75, 1e-4, 1e-12


#: Digits after the point to which exact sums hold their terms, and the size from which on terms are left out.
EXACT_DIGITS, EXACT_MOST = 9, 1e9


def exact(value: Column) -> Column:
    """A finite value as a decimal of EXACT_DIGITS; null for any other and beyond EXACT_MOST.

    Sums of decimals are the same in whatever order and parts they are added, so
    what is made of them agrees between runs, partitionings and a running state.
    """
    x = finite(value)
    return F.when(F.abs(x) < EXACT_MOST, x).cast(f"decimal(19,{EXACT_DIGITS})")


def exact_moments(value: Column, over=None) -> tuple[Column, Column, Column]:
    """Count, mean and population deviation from exact sums; as aggregates, or over a window."""
    x = exact(value)
    add = lambda c: F.sum(c) if over is None else F.sum(c).over(over)
    n = F.count(x) if over is None else F.count(x).over(over)
    whole = F.nullif(n, F.lit(0)).cast("double")
    mean = add(x).cast("double") / whole
    square = add((x * x).cast(f"decimal(38,{2 * EXACT_DIGITS})")).cast("double") / whole
    return n, mean, F.sqrt(F.greatest(F.lit(0.0), square - mean * mean))


def summarize(value: Column) -> list[Column]:
    """Count, mean, population deviation and median of the finite values."""
    x = finite(value)
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.median(x).alias("median")]


def dbfs(rms: Column) -> Column:
    return 20 * F.log10(F.greatest(rms, F.lit(SILENT_RMS)))


def meter(samples: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Counts, peak, RMS, level and share of non-zero samples; sums that merge over any partitioning."""
    x = finite(F.col(value))
    out = samples.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.count(x).alias("finite"), F.count_if(x != 0).alias("nonzero"), F.max(F.abs(x)).alias("peak"), F.sqrt(F.avg(x * x)).alias("rms")
    )
    return out.withColumn("dbfs", dbfs(F.col("rms"))).withColumn("nonzero_ratio", F.col("nonzero") / F.col("samples"))


def trace(packets: DataFrame, stage: str, order: str, metrics: Sequence[str], count: str) -> DataFrame:
    """Per stage the metrics of its latest packet, and all its packets and samples."""
    newest = F.max_by(F.struct(*metrics), order).alias("latest")
    return packets.groupBy(stage).agg(newest, F.count("*").alias("blocks"), F.sum(count).alias("samples")).select(stage, "latest.*", "blocks", "samples")


def input_metrics(samples: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], length: float | None = None) -> DataFrame:
    """Level, clipping, plateaus, crest, raw kurtosis and edge density of each key's samples.

    The peak is needed before the edges can be counted: two aggregations of
    constant-size partial sums. A plateau sample is loud and no different from
    the finite one before it in order. That one is found in a window for each
    key, or, for keys of any size, in buckets of the given length of order's
    first column.
    """
    keys = list(keys)
    marked = samples.select(*keys, *order, finite(F.col(value)).alias("_x"))
    if length is None:
        before = F.last("_x", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        marked = marked.withColumn("_before", before)
    else:
        near = buckets.beside(marked.where("_x is not null"), keys, order[0], length, [*order, "_x"])
        marked = near.select(*keys, "_x", F.col("_before._x").alias("_before")).unionByName(marked.where("_x is null").select(*keys, "_x"), allowMissingColumns=True)
    peaks = samples.groupBy(*keys).agg(F.max(F.abs(finite(F.col(value)))).alias("_peak")).alias("p")
    joined = marked.alias("m").join(peaks, [F.col(f"m.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]).select("m.*", "p._peak")
    a, square = F.abs(F.col("_x")), F.col("_x") * F.col("_x")
    share = lambda condition: F.count_if(condition) / F.nullif(F.count("_x"), F.lit(0))
    out = joined.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.sqrt(F.avg(square)).alias("rms"), F.max("_peak").alias("peak"), share(a >= CLIP).alias("clipping"), share(a >= NEAR_CLIP).alias("near_clipping"),
        share((a >= PLATEAU_LEVEL) & (F.abs(F.col("_x") - F.col("_before")) <= PLATEAU_STEP)).alias("plateau"), F.avg(square * square).alias("_fourth"), share(a >= 0.9 * F.col("_peak")).alias("edge_density"),
        (F.count_if(F.col("_x").isNull()) / F.count("*")).alias("non_finite"),
    )
    out = out.withColumn("dbfs", dbfs(F.col("rms"))).withColumn("crest", F.col("peak") / F.nullif(F.col("rms"), F.lit(0.0)))
    out = out.withColumn("kurtosis", F.col("_fourth") / F.nullif(F.pow("rms", F.lit(4.0)), F.lit(0.0))).drop("_fourth")
    return out.withColumn("limiting", limiting(*(F.col(c) for c in ("plateau", "dbfs", "crest", "kurtosis", "edge_density"))))


def limiting(plateau: Column, level: Column, crest: Column, kurtosis: Column, edges: Column) -> Column:
    """Whether a signal looks limited: flat tops, or too loud for its crest."""
    dense = (kurtosis < 1.9) | (edges > 0.08)
    return F.coalesce((plateau > 0.002) | ((level > -4) & (crest < 1.35)) | ((level > -8) & (crest < 1.55) & dense), F.lit(False))


def effective_count(weight: Column) -> Column:
    """Kish's effective number of equally weighted observations."""
    return F.sum(weight) * F.sum(weight) / F.nullif(F.sum(weight * weight), F.lit(0.0))


def floor_rank(values: Column, share: float) -> Column:
    """The value at the floor of share of the way through the sorted array."""
    at = F.least(F.floor(F.size(values) * share).cast("int"), F.size(values) - 1)
    return F.get(F.array_sort(values), at)


def rolling_deviation(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, accepted: Column, width: int = 10) -> DataFrame:
    """Population deviation of value over the accepted ones of the `width` rows before each."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-width, -1)
    return rows.withColumn("rolling_sd", F.stddev_pop(F.when(accepted, F.col(value))).over(w))


def recent_range(rows: DataFrame, keys: Sequence[str], time: str, value: str, seconds: int = 30) -> DataFrame:
    """rows with the least and greatest finite value of the last seconds up to each row's time."""
    w = Window.partitionBy(*keys).orderBy(time).rangeBetween(-seconds, 0)
    x = finite(F.col(value))
    return rows.withColumns({"recent_min": F.min(x).over(w), "recent_max": F.max(x).over(w), "recent_n": F.count(x).over(w)})


def recent_since(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], since: Column, most: int = 10) -> DataFrame:
    """The last rows of each key, at most `most`, and of these only those for which since holds: the limit comes first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n").where(since)


def running_moments(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """rows with count, mean and population deviation of the finite values so far, from exact running sums."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns(dict(zip(("run_n", "run_mean", "run_sd"), exact_moments(F.col(value), w))))
