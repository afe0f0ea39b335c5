"""Phase summaries, comparisons with a baseline, projections and paging of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.scalars import finite, half_up

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def phase_rows(spark, phases: Sequence[tuple[str, float, float | None]]) -> DataFrame:
    """A phase dimension of half-open ranges; no end means no limit."""
    return spark.createDataFrame([(i, n, float(a), float("inf") if b is None else float(b)) for i, (n, a, b) in enumerate(phases)], "phase_no int, phase string, begins double, ends double")


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float] = QUARTILES, bins: int = 1024) -> DataFrame:
    """keys, n and exact quantiles of the finite values, interpolated between neighbours; keys without any don't come out.

    No key is sorted whole: equal values are counted first, counts fall into
    bins of each key's range, sums of bins tell which bins hold the wanted
    places, and only these bins' values are put in order.
    """
    keys = list(keys)
    same = lambda x, y: [F.col(f"{x}.{k}").eqNullSafe(F.col(f"{y}.{k}")) for k in keys]
    counted = rows.select(*keys, finite(F.col(value)).alias("_v")).where("_v is not null").groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    ranges = counted.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.sum("_c").alias("n"))
    at = (F.col("_v") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * bins
    binned = counted.alias("a").join(ranges.alias("b"), same("a", "b")).select("a.*", "n", F.least(F.floor(F.coalesce(at, F.lit(0.0))), F.lit(bins - 1)).alias("_bin"))
    sums = binned.groupBy(*keys, "n", "_bin").agg(F.sum("_c").alias("_words"))
    before = F.coalesce(F.sum("_words").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = F.array(*[F.struct((F.lit(float(p)) * (F.col("n") - 1)).alias("at"), F.lit(name).alias("name")) for name, p in shares.items()])
    wanted = sums.withColumn("_before", before).withColumn("_p", F.explode(places))
    hit = lambda low, count: (F.ceil("_p.at") >= low) & (F.floor("_p.at") < low + count)
    wanted = wanted.where(hit(F.col("_before"), F.col("_words"))).select(*keys, "_bin", "_before").distinct()
    near = binned.alias("a").join(wanted.alias("b"), [*same("a", "b"), F.col("a._bin") == F.col("b._bin")]).select("a.*", "_before")
    inner = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = near.withColumn("_from", F.col("_before") + F.coalesce(F.sum("_c").over(inner), F.lit(0))).withColumn("_p", F.explode(places)).where(hit(F.col("_from"), F.col("_c")))
    # at most two values for each place: where it falls between them, its share of the way
    share = F.col("_p.at") - F.floor("_p.at")
    lower, upper = F.max(F.when(F.col("_from") <= F.floor("_p.at"), F.col("_v"))), F.max("_v")
    each = ranked.groupBy(*keys, "n", F.col("_p.name").alias("_name")).agg((lower + (upper - lower) * F.max(share)).alias("_q"))
    return each.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("_name") == name, F.col("_q"))).alias(name) for name in shares])


def phase_summary(rows: DataFrame, phases: DataFrame, time: str, metrics: Sequence[str]) -> DataFrame:
    """For each phase and metric the rows in range, the finite values and their quartiles.

    Every phase comes out, empty ones with nulls. Rows look their phase up in
    the broadcast phases (literal, one for each row at most) and meet by partial sums.
    """
    long = rows.select(F.col(time).alias("at"), F.stack(F.lit(len(metrics)), *[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))]).alias("metric", "value"))
    placed = long.join(F.broadcast(phases.select("phase", "begins", "ends")), (F.col("at") >= F.col("begins")) & (F.col("at") < F.col("ends"))).select("phase", "metric", "value")
    counts = placed.groupBy("phase", "metric").agg(F.count("*").alias("row_count"))
    every = phases.select("phase", F.explode(F.array(*map(F.lit, metrics))).alias("metric"))
    out = every.join(counts, ["phase", "metric"], "left").join(exact_quantiles(placed, ["phase", "metric"], "value"), ["phase", "metric"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("row_count", "n")})


def against_baseline(summary: DataFrame, key: str, baseline: str, metrics: Sequence[str]) -> DataFrame:
    """Each row's metrics, the baseline row's and the differences; null where either is missing."""
    base = summary.where(F.col(key) == baseline).limit(1).select(F.struct(*metrics).alias("base"))
    joined = summary.crossJoin(F.broadcast(base))  # one row
    long = F.stack(F.lit(len(metrics)), *[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"), F.col(f"base.{m}").cast("double"))]).alias("metric", "value", "baseline")
    return joined.select(key, (F.col(key) == baseline).alias("is_baseline"), long).withColumn("delta", F.col("value") - F.col("baseline"))


def band(rows: DataFrame, time: str, metric: str, low: float, high: float, base: float, height: float) -> DataFrame:
    """Points of a plot band: rows with finite time and value, the value clamped into the band."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(metric) - low) / (high - low)))
    kept = rows.where(finite(F.col(time)).isNotNull() & finite(F.col(metric)).isNotNull())
    return kept.select(F.col(time).alias("time"), (base + share * height).alias("plotted"), F.col(metric).alias("value"))


def numbered(rows: DataFrame, bucket: Column, order: Sequence[Column]) -> DataFrame:
    """rows with _i, their place in order from 0; bucket must rise with order.

    Rows are put in order within buckets; only the buckets' counts pass one task.
    """
    marked = rows.withColumn("_bucket", bucket)
    counts = marked.groupBy("_bucket").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = marked.alias("m").join(counts.select("_bucket", before.alias("_before")).alias("c"), F.col("m._bucket").eqNullSafe(F.col("c._bucket"))).select("m.*", "_before")
    return joined.withColumn("_i", F.col("_before") + F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1).drop("_bucket", "_before")


def event_points(rows: DataFrame, time: str, strength: str, tie: str, bucket_seconds: float = 3600.0) -> DataFrame:
    """Markers of events in order of time (0 if missing): a height that sways with the place, a size up to 60 (6 if missing)."""
    at = F.coalesce(F.col(time), F.lit(0.0))
    size = F.least(F.lit(60.0), F.abs(F.coalesce(F.col(strength), F.lit(6.0))))
    return numbered(rows, F.floor(at / bucket_seconds), [at, F.col(tie)]).select(tie, at.alias("time"), (0.88 + F.sin(F.col("_i") * 2.17) * 0.045).alias("height"), size.alias("size"))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: int) -> DataFrame:
    """The last `keep` rows of each key in order; what is older goes."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_place") <= keep).drop("_place")


def page(rows: DataFrame, order: Sequence[Column], limit: int = 25, offset: int = 0) -> DataFrame:
    """One page, with has_more on its rows; limit is kept within 1 and 25, offset at 0 or more."""
    limit, offset = max(1, min(25, int(limit))), max(0, int(offset))
    ahead = rows.orderBy(*order).offset(offset).limit(limit + 1)
    everything = Window.partitionBy(F.lit(1))  # limit + 1 rows at most
    numbered = ahead.withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))).withColumn("_all", F.count("*").over(everything))
    return numbered.where(F.col("_n") <= limit).withColumn("has_more", F.col("_all") > limit).drop("_n", "_all")


def evenly(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """At most `most` rows of each key, evenly spaced in order, both ends among them."""
    w = Window.partitionBy(*keys)
    placed = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    slot = half_up(F.col("_i") * (most - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    near = F.explode(F.array_distinct(F.transform(F.sequence(slot - 1, slot + 1), lambda s: F.greatest(F.lit(0), F.least(s, F.lit(most - 1))))))
    chosen = half_up(F.col("_slot") * (F.col("_n") - 1) / (most - 1)) == F.col("_i")
    few = placed.where(F.col("_n") <= most)
    return few.unionByName(placed.where(F.col("_n") > most).withColumn("_slot", near).where(chosen).drop("_slot")).drop("_i", "_n")


def quality_label(accepted: Column, windows: Column) -> Column:
    """How many windows were accepted, as text."""
    return F.format_string("%d of %d windows", accepted.cast("long"), windows.cast("long"))
