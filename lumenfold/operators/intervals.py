"""Timelines of states, their durations, and lookups of the nearest observation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.scalars import finite

from . import buckets, stats, tables

# States in the order in which ties go.
COLORS = ["violet", "blue", "white", "pink", "brown"]
STATES = [*COLORS, "mixed", "tonal", "silence", "unstable", "clipping", "insufficient", "invalid"]


def known_state(state: Column) -> Column:
    return F.when(state.isin(STATES), state).otherwise("insufficient")


def merged(rows: DataFrame, keys: Sequence[str], state: str, begins: str, ends: str, width: float | None = None) -> DataFrame:
    """Neighbouring rows of one state as one segment. Rows spread by buckets of width seconds, measured if not given."""
    rows, order = rows.select(*keys, state, begins, ends), [begins, ends, state]
    near = buckets.beside(rows, keys, begins, buckets.width(rows, begins) if width is None else width, order)
    new = F.col("_before").isNull() | ~F.col(f"_before.{state}").eqNullSafe(F.col(state))
    return buckets.runs(near, keys, order, state, new, begins, ends)


def color_timeline(observations: DataFrame, keys: Sequence[str], time: str, state: str, duration: float, width: float | None = None) -> DataFrame:
    """Segments from 0 to duration; states change midway between observations of different time, or at the end of the span if that lies outside.

    Observations without a finite time are left out, one without a state is
    mixed. A key without any has no segment here; see empty_timeline. A key's
    observations spread by buckets of width seconds, measured if not given.
    """
    duration = max(0.0, float(duration))
    timed = observations.select(*keys, finite(F.col(time)).alias("_t"), F.coalesce(F.nullif(F.col(state), F.lit("")), F.lit("mixed")).alias(state)).where("_t is not null")
    near = buckets.beside(timed, keys, "_t", buckets.width(timed, "_t") if width is None else width, ["_t", state])
    midway = lambda other: F.least(F.lit(duration), F.greatest(F.lit(0.0), (F.col("_t") + other) / 2))
    begins = F.when(F.col("_before").isNull(), 0.0).otherwise(midway(F.col("_before._t")))
    ends = F.when(F.col("_after").isNull(), duration).otherwise(midway(F.col("_after._t")))
    new = F.col("_before").isNull() | (F.col(f"_before.{state}") != F.col(state))
    return buckets.runs(near.withColumns({"_begins": begins, "_ends": ends}), keys, ["_t", state], state, new, "_begins", "_ends")


def empty_timeline(duration: float) -> Column:
    """The one segment of a key without observations."""
    return F.struct(F.lit("insufficient").alias("state"), F.lit(0.0).alias("begins"), F.lit(float(duration)).alias("ends"))


def state_durations(segments: DataFrame, keys: Sequence[str], state: str = "state", begins: str = "begins", ends: str = "ends") -> DataFrame:
    return segments.groupBy(*keys, state).agg(F.sum(F.greatest(F.lit(0.0), F.col(ends) - F.col(begins))).alias("seconds"))


def duration_summary(durations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: all seconds, the share of reliable ones, and the color that lasts longest (ties in canonical order)."""
    rank = F.array_position(F.array(*map(F.lit, COLORS)), F.col("state"))
    color = (rank > 0) & (F.col("seconds") > 0)
    out = durations.groupBy(*keys).agg(
        F.sum("seconds").alias("seconds"), F.sum(F.when(rank > 0, F.col("seconds")).otherwise(0.0)).alias("_reliable"),
        F.max_by(F.when(color, F.col("state")), F.when(color, F.struct(F.col("seconds"), -rank))).alias("dominant"),
    )
    share = 100 * F.col("_reliable") / F.nullif(F.col("seconds"), F.lit(0.0))
    return out.withColumn("reliable_percent", share).withColumn("rejected_percent", 100 - F.col("reliable_percent")).drop("_reliable")


def session_summary(observations: DataFrame, durations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """duration_summary with statistics of the reliable observations (reliable, beta, rmse_db, r2, flatness); keys with durations only.

    Means and deviations come from exact sums, which merge over any parts of a
    session to the same figures; the median from exact quantiles, which sort no
    session whole.
    """
    keys = list(keys)
    good = observations.where(F.coalesce(F.col("reliable"), F.lit(False)) & finite(F.col("beta")).isNotNull())
    n, mean, sd = stats.exact_moments(F.col("beta"))
    spread = good.groupBy(*keys).agg(n.alias("observations"), mean.alias("beta_mean"), sd.alias("beta_sd"), *[stats.exact_moments(F.col(c))[1].alias(f"{c}_mean") for c in ("rmse_db", "r2", "flatness")])
    middle = tables.exact_quantiles(good, keys, "beta", {"beta_median": 0.5}).drop("n")
    same = lambda x, y: [F.col(f"{x}.{k}").eqNullSafe(F.col(f"{y}.{k}")) for k in keys]
    spread = spread.alias("s").join(middle.alias("m"), same("s", "m"), "left").select("s.*", "m.beta_median")
    shares = duration_summary(durations, keys)
    joined = shares.alias("a").join(spread.alias("b"), same("a", "b"), "left").select("a.*", *[f"b.{c}" for c in spread.columns if c not in keys])
    return joined.withColumn("observations", F.coalesce("observations", F.lit(0)))


def signal_percentages(durations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the shares of silence (low_signal) and of time without analysis (awaiting_analysis), in percent."""
    share = lambda state: F.coalesce(100 * F.sum(F.when(F.col("state") == state, F.col("seconds"))) / F.nullif(F.sum("seconds"), F.lit(0.0)), F.lit(0.0))
    return durations.groupBy(*keys).agg(share("silence").alias("low_signal"), share("insufficient").alias("awaiting_analysis"))


def state_counts(observations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key and state how many observations, and the least and greatest exponent."""
    return observations.groupBy(*keys, "state").agg(F.count("*").alias("n"), F.min(finite(F.col("beta"))).alias("beta_min"), F.max(finite(F.col("beta"))).alias("beta_max"))


def composition(durations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the states and their percentages as text, longest first."""
    whole = F.sum("seconds").over(Window.partitionBy(*keys))
    shares = durations.withColumn("_share", 100 * F.col("seconds") / F.nullif(whole, F.lit(0.0)))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("_share")).alias("s"), F.col("state"))))
    text = F.array_join(F.transform(parts, lambda p: F.format_string("%s %.1f%%", p["state"], -p["s"])), ", ")
    return shares.groupBy(*keys).agg(text.alias("composition"))


def compress_timeline(segments: DataFrame, keys: Sequence[str], most: int = 2048) -> DataFrame:
    """Keys with more than `most` segments get their older half folded into one, with the seconds of each state in it."""
    w = Window.partitionBy(*keys)
    placed = segments.withColumn("_i", F.row_number().over(w.orderBy("begins", "ends"))).withColumn("_n", F.count("*").over(w))
    old = (F.col("_n") > most) & (F.col("_i") <= most // 2)
    rest = placed.where(~old).select(*keys, "state", "begins", "ends", F.lit(False).alias("compressed"), F.lit(None).cast("map<string,double>").alias("state_seconds"))
    by_state = placed.where(old).groupBy(*keys, "state").agg(F.min("begins").alias("begins"), F.max("ends").alias("ends"), F.sum(F.col("ends") - F.col("begins")).alias("s"))
    folded = by_state.groupBy(*keys).agg(F.min("begins").alias("begins"), F.max("ends").alias("ends"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "s")))).alias("state_seconds"))
    return rest.unionByName(folded.select(*keys, F.lit("session-compressed").alias("state"), "begins", "ends", F.lit(True).alias("compressed"), "state_seconds"))


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, payload: Sequence[str], ties: str = "later", width: float | None = None) -> DataFrame:
    """left with the payload of the nearest right row of its key; of two as near the later, or the earlier.

    Of right rows of one time the last in order of payload counts. Left rows
    without a finite time get none. Both sides fall into buckets of width
    seconds (measured on right, if not given); each bucket is sorted by time and
    carries the last and next right row along, and gets those of the buckets
    around it from a scan over buckets: no join of pairs, and no task for a key.
    """
    keys = list(keys)
    width = buckets.width(right.select(finite(F.col(time)).alias("_t")), "_t") if width is None else width
    place = buckets.bucket(F.col("_t"), width).alias("_b")
    r = right.select(*keys, finite(F.col(time)).alias("_t"), F.struct(finite(F.col(time)).alias("_at"), *payload).alias("_r")).where("_t is not null").select("*", place)
    marks = left.select(*keys, finite(F.col(time)).alias("_t"), F.struct(*left.columns).alias("_l"))
    untimed, marks = marks.where("_t is null").select("_l"), marks.where("_t is not null").select("*", place)
    edges = r.select(*keys, "_b", "_r").unionByName(marks.select(*keys, "_b"), allowMissingColumns=True).groupBy(*keys, "_b").agg(F.max_by("_r", F.struct(-F.col("_r._at"), "_r")).alias("_first"), F.max("_r").alias("_last"))
    # both look back, the second in falling order: frames that grow are carried along, frames that shrink are read anew for each row
    along, against = (Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1) for b in (F.col("_b"), F.desc("_b")))
    around = F.array_compact(F.array(F.last("_last", ignorenulls=True).over(along), F.last("_first", ignorenulls=True).over(against)))
    halos = edges.select(*keys, "_b", around.alias("_h")).select(*keys, "_b", F.explode("_h").alias("_r")).withColumn("_t", F.col("_r._at"))
    both = r.unionByName(halos).unionByName(marks, allowMissingColumns=True).withColumn("_left", F.col("_l").isNotNull())
    w, back = Window.partitionBy(*keys, "_b").orderBy("_t", "_left", "_r"), Window.partitionBy(*keys, "_b").orderBy(F.desc("_t"), F.desc("_left"), "_r")
    past = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("_r", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    near = both.withColumn("_p", past).withColumn("_f", after).where("_left")
    ahead, behind = F.col("_f._at") - F.col("_t"), F.col("_t") - F.col("_p._at")
    take = F.col("_p").isNull() | (F.col("_f").isNotNull() & ((ahead <= behind) if ties == "later" else (ahead < behind)))
    chosen = near.select("_l", F.when(take, F.col("_f")).otherwise(F.col("_p")).alias("_c")).unionByName(untimed, allowMissingColumns=True)
    return chosen.select("_l.*", F.col("_c._at").alias("nearest_at"), *[F.col(f"_c.{p}").alias(f"nearest_{p}") for p in payload])
