"""The library's operators as queries over the driver's tables, and their SQL.

`events` stands for measured windows and for samples, `embeddings` for short
spectra. Results of floating-point sums are rounded, as their order is not fixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import scalars
from lumenfold.operators import buckets, intervals, spectral, stats, tables
from lumenfold.plans import replay
from lumenfold.registry import query
from lumenfold.streaming import capture, color_state, live, sessions

DAY = 86400.0
PHASES = [("early", 0, 10 * DAY), ("middle", 10 * DAY, 20 * DAY), ("late", 20 * DAY, None)]
STATES = {"click": "pink", "view": "white", "signup": "brown", "error": "silence", "purchase": "mixed"}

_E = "e as (select event_id, user_id, event_type, value, props, ts, date_diff('microsecond', timestamp '2024-01-01', ts) / 1e6 as t from events)"
_B = "b as (select vec_id, i as bin, i * 125.0 as freq, embedding[i + 1]::double * embedding[i + 1]::double as power from (select vec_id, embedding, unnest(range(len(embedding))) as i from embeddings))"
_STATE = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in STATES.items()) + " end"
_SEG = f"""{_E}, o as (select user_id, t, {_STATE} as state from e),
x as (select user_id, coalesce(state, 'mixed') as state, case when lag(t) over w is null then 0 else least({30 * DAY}, greatest(0, (lag(t) over w + t) / 2)) end as b, case when lead(t) over w is null then {30 * DAY} else least({30 * DAY}, greatest(0, (lead(t) over w + t) / 2)) end as z from o window w as (partition by user_id order by t, state)),
y as (select *, case when lag(state) over w is not distinct from state then 0 else 1 end as new from x window w as (partition by user_id order by b, z)),
r as (select *, sum(new) over (partition by user_id order by b, z rows unbounded preceding) as run from y),
seg as (select user_id, state, min(b) as begins, max(z) as ends, count(*) as rows from r group by user_id, run, state),
dur as (select user_id, state, sum(greatest(0.0, ends - begins)) as seconds from seg group by user_id, state)"""


def _events(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.withColumn("t", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01', ts)") / 1e6)


def _bins(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("bin", "x"))
    return rows.select("vec_id", "bin", (F.col("bin") * 125.0).alias("freq"), (F.col("x").cast("double") * F.col("x").cast("double")).alias("power"))


def _observed(spark, sf_dir: str) -> DataFrame:
    state = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])[F.col("event_type")]
    return _events(spark, sf_dir).select("user_id", "event_id", "t", "value", state.alias("state"))


def _segments(spark, sf_dir: str) -> DataFrame:
    return intervals.color_timeline(_observed(spark, sf_dir), ["user_id"], "t", "state", 30 * DAY)


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(f"`{n}`", digits).alias(n) if kind == "double" else F.col(f"`{n}`") for n, kind in df.dtypes])


def _r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) as {n}" for n in names)


@query(
    f"with {_E}, p(phase, begins, ends) as (values ('early', 0.0, {10 * DAY}), ('middle', {10 * DAY}, {20 * DAY}), ('late', {20 * DAY}, 'infinity'::double)), "
    "l as (select t, 'value' as metric, value as v from e union all select t, 'user_id', user_id::double from e), m as (select unnest(['value', 'user_id']) as metric) "
    "select phase, m.metric, count(t) as row_count, count(v) as n, round(quantile_cont(v, 0.25), 6) as q1, round(quantile_cont(v, 0.5), 6) as median, round(quantile_cont(v, 0.75), 6) as q3 "
    "from p cross join m left join l on l.metric = m.metric and t >= begins and t < ends group by phase, m.metric"
)
def phase_summary(spark, sf_dir):
    return _round(tables.phase_summary(_events(spark, sf_dir), tables.phase_rows(spark, PHASES), "t", ["value", "user_id"]))


@query("select l_returnflag, l_linestatus, count(l_extendedprice) as n, round(quantile_cont(l_extendedprice, 0.25), 6) as q1, round(quantile_cont(l_extendedprice, 0.5), 6) as median, round(quantile_cont(l_extendedprice, 0.75), 6) as q3 from lineitem group by all")
def quantile_by_group(spark, sf_dir):
    return _round(tables.exact_quantiles(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_returnflag", "l_linestatus"], "l_extendedprice"))


@query(
    "with s as (select event_type, avg(value) as mean, max(value) as peak, min(value) as least from events group by 1), b as (select * from s where event_type = 'view'), "
    "l as (select s.event_type, unnest(['mean', 'peak', 'least']) as metric, unnest([s.mean, s.peak, s.least]) as value, unnest([b.mean, b.peak, b.least]) as baseline from s, b) "
    "select event_type, event_type = 'view' as is_baseline, metric, round(value, 6) as value, round(baseline, 6) as baseline, round(value - baseline, 6) as delta from l"
)
def baseline_delta(spark, sf_dir):
    summary = _events(spark, sf_dir).groupBy("event_type").agg(F.avg("value").alias("mean"), F.max("value").alias("peak"), F.min("value").alias("least"))
    return _round(tables.against_baseline(summary, "event_type", "view", ["mean", "peak", "least"]))


@query(f"with {_E} select round(t, 6) as time, round(0.1 + greatest(0.0, least(1.0, (value - 10) / 190.0)) * 0.3, 6) as plotted, value from e where event_type = 'view' and value is not null")
def metric_band(spark, sf_dir):
    return _round(tables.band(_events(spark, sf_dir).where("event_type = 'view'"), "t", "value", 10.0, 200.0, 0.1, 0.3))


@query(f"with {_E} select event_id, round(t, 6) as time, round(0.88 + sin((row_number() over (order by t, event_id) - 1) * 2.17) * 0.045, 6) as height, least(60.0, abs(coalesce(value, 6.0))) as size from e where event_type = 'error'")
def event_points(spark, sf_dir):
    return _round(tables.event_points(_events(spark, sf_dir).where("event_type = 'error'"), "t", "value", "event_id"))


@query("select event_id, event_type, value from events qualify row_number() over (partition by event_type order by ts desc, event_id desc) <= 100")
def retention_topn(spark, sf_dir):
    return tables.latest(_events(spark, sf_dir), ["event_type"], [F.desc("t"), F.desc("event_id")], 100).select("event_id", "event_type", "value")


@query("select event_id, value, (select count(*) from events) > 50 as has_more from events order by ts desc, event_id desc limit 25 offset 25")
def page_2(spark, sf_dir):
    return tables.page(_events(spark, sf_dir).select("event_id", "value", "t"), [F.desc("t"), F.desc("event_id")], 25, 25).select("event_id", "value", "has_more")


@query(
    f"with {_E}, n as (select user_id, event_id, row_number() over (partition by user_id order by t, event_id) - 1 as i, count(*) over (partition by user_id) as n from e) "
    "select user_id, event_id from n where n <= 10 or list_contains(list_transform(range(10), lambda s: floor(s * (n - 1) / 9.0 + 0.5)::bigint), i)"
)
def even_sample(spark, sf_dir):
    return tables.evenly(_events(spark, sf_dir), ["user_id"], [F.col("t"), F.col("event_id")], 10).select("user_id", "event_id")


@query("select vec_id, unnest(range(9)) as place, embedding[(floor(unnest(range(9)) * (len(embedding) - 1) / 8.0 + 0.5))::bigint + 1]::double as x from embeddings")
def even_array_sample(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("vec_id", F.posexplode(scalars.sample_evenly(F.col("embedding"), 9)).alias("place", "x")).withColumns({"place": F.col("place").cast("long"), "x": F.col("x").cast("double")})


@query("select event_type, count(value) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as sd, round(median(value), 6) as median from events group by 1")
def summary_pop_sd(spark, sf_dir):
    # the median by the distributed quantiles: values of one type are not held together
    rows = _events(spark, sf_dir)
    spread = rows.groupBy("event_type").agg(*stats.summarize(F.col("value"))[:3])
    return _round(spread.join(tables.exact_quantiles(rows, ["event_type"], "value", {"median": 0.5}).drop("n"), "event_type", "left"))


@query("select event_type, count(*) as samples, count(value) as finite, count(*) filter (value <> 0) as nonzero, max(abs(value)) as peak, round(sqrt(avg(value * value)), 6) as rms, round(20 * log10(greatest(sqrt(avg(value * value)), 1e-12)), 6) as dbfs, round(count(*) filter (value <> 0) / count(*), 6) as nonzero_ratio from events group by 1")
def pcm_meter(spark, sf_dir):
    return _round(stats.meter(_events(spark, sf_dir), ["event_type"], "value"))


@query("select event_type, arg_max(value, event_id) as value, count(*) as blocks, sum(user_id)::bigint as samples from events group by 1")
def stage_trace(spark, sf_dir):
    return stats.trace(_events(spark, sf_dir), "event_type", "event_id", ["value"], "user_id")


_METRICS = ("rms", "peak", "clipping", "near_clipping", "plateau", "edge_density", "non_finite", "dbfs", "crest", "kurtosis")


@query(
    f"with {_E}, s as (select user_id, value / 500 as x, lag(value / 500) over (partition by user_id order by t, event_id) as p, max(abs(value / 500)) over (partition by user_id) as top from e), "
    "m as (select user_id, count(*) as samples, sqrt(avg(x * x)) as rms, max(top) as peak, count(*) filter (abs(x) >= 0.99) / count(x) as clipping, count(*) filter (abs(x) >= 0.98) / count(x) as near_clipping, "
    "count(*) filter (abs(x) >= 0.75 and abs(x - p) <= 1e-4) / count(x) as plateau, count(*) filter (abs(x) >= 0.9 * top) / count(x) as edge_density, 0.0::double as non_finite, avg(x * x * x * x) as fourth from s group by 1), "
    "d as (select *, 20 * log10(greatest(rms, 1e-12)) as dbfs, peak / rms as crest, fourth / pow(rms, 4) as kurtosis from m) "
    f"select user_id, samples, {_r(*_METRICS)}, plateau > 0.002 or (dbfs > -4 and crest < 1.35) or (dbfs > -8 and crest < 1.55 and (kurtosis < 1.9 or edge_density > 0.08)) as limiting from d"
)
def input_metrics(spark, sf_dir):
    return _round(stats.input_metrics(_events(spark, sf_dir).withColumn("x", F.col("value") / 500), ["user_id"], "x", ["t", "event_id"]))


@query("select event_type, round(sum(value) * sum(value) / sum(value * value), 4) as effective from events group by 1")
def effective_count(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type").agg(F.round(stats.effective_count(F.col("value")), 4).alias("effective"))


@query("select vec_id, list_sort(embedding)[least(floor(len(embedding) * 0.08), len(embedding) - 1)::bigint + 1]::double as low, list_sort(embedding)[least(floor(len(embedding) * 0.96), len(embedding) - 1)::bigint + 1]::double as high from embeddings")
def contrast_percentiles(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("vec_id", *[stats.floor_rank(F.col("embedding"), p).cast("double").alias(n) for n, p in (("low", 0.08), ("high", 0.96))])


@query(f"with {_E} select event_id, round(stddev_pop(case when value > 20 then value end) over (partition by user_id order by t, event_id rows between 10 preceding and 1 preceding), 6) as rolling_sd from e")
def rolling_sd10(spark, sf_dir):
    return _round(stats.rolling_deviation(_events(spark, sf_dir), ["user_id"], ["t", "event_id"], "value", F.col("value") > 20).select("event_id", "rolling_sd"))


@query(f"with {_SEG} select user_id, state, {_r('begins', 'ends', digits=4)}, rows from seg")
def color_timeline(spark, sf_dir):
    return _round(_segments(spark, sf_dir), 4)


@query(f"with {_SEG} select user_id, state, round(seconds, 4) as seconds from dur")
def state_durations(spark, sf_dir):
    return _round(intervals.state_durations(_segments(spark, sf_dir), ["user_id"]), 4)


@query(
    f"with {_SEG}, c as (select *, list_position(['violet', 'blue', 'white', 'pink', 'brown'], state) as rank from dur), s as (select user_id, sum(seconds) as seconds, sum(case when rank > 0 then seconds else 0 end) as good, "
    "first(state order by seconds desc, rank) filter (rank > 0 and seconds > 0) as dominant from c group by 1) "
    "select user_id, round(seconds, 4) as seconds, dominant, round(100 * good / seconds, 4) as reliable_percent, round(100 - 100 * good / seconds, 4) as rejected_percent from s"
)
def duration_summary(spark, sf_dir):
    return _round(intervals.duration_summary(intervals.state_durations(_segments(spark, sf_dir), ["user_id"]), ["user_id"]), 4)


@query(f"with {_SEG}, p as (select *, 100 * seconds / sum(seconds) over (partition by user_id) as share from dur) select user_id, string_agg(printf('%s %.1f%%', state, share), ', ' order by share desc, state) as composition from p group by 1")
def composition(spark, sf_dir):
    return intervals.composition(intervals.state_durations(_segments(spark, sf_dir), ["user_id"]), ["user_id"])


@query(
    f"with {_SEG}, n as (select *, row_number() over (partition by user_id order by begins, ends) as i, count(*) over (partition by user_id) as n from seg), old as (select * from n where n > 8 and i <= 4) "
    "select user_id, state, round(begins, 4) as begins, round(ends, 4) as ends, false as compressed, 0::bigint as states from n where not (n > 8 and i <= 4) "
    "union all select user_id, 'session-compressed', round(min(begins), 4), round(max(ends), 4), true, count(distinct state) from old group by user_id"
)
def compress_timeline(spark, sf_dir):
    out = intervals.compress_timeline(_segments(spark, sf_dir), ["user_id"], 8)
    return _round(out.withColumn("states", F.coalesce(F.size(F.map_keys("state_seconds")), F.lit(0)).cast("long")).drop("state_seconds"), 4)


def _near(tie: str) -> str:
    return (
        f"with {_E}, l as (select * from e where event_type = 'purchase'), r as (select user_id, t as rt, event_id as rid from e where event_type = 'click') "
        f"select event_id, round(rt, 6) as nearest_at, rid as nearest_id from l left join r using (user_id) qualify row_number() over (partition by event_id order by abs(rt - t), rt {tie}) = 1"
    )


def _nearest(spark, sf_dir, ties: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", "event_id", "event_type", "t")
    found = intervals.nearest(rows.where("event_type = 'purchase'"), rows.where("event_type = 'click'").withColumn("id", F.col("event_id")), ["user_id"], "t", ["id"], ties)
    return _round(found.select("event_id", "nearest_at", "nearest_id"))


@query(_near("desc"))
def nearest_asof(spark, sf_dir):
    return _nearest(spark, sf_dir, "later")


@query(_near("asc"))
def nearest_asof_earlier(spark, sf_dir):
    return _nearest(spark, sf_dir, "earlier")


@query("select event_id, case when value / 100 - 2.5 <= -1.5 then 'violet' when value / 100 - 2.5 <= -0.5 then 'blue' when value / 100 - 2.5 <= 0.5 then 'white' when value / 100 - 2.5 <= 1.5 then 'pink' else 'brown' end as color from events")
def nearest_canonical(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", spectral.nearest_canonical(F.col("value") / 100 - 2.5).alias("color"))


@query(
    "select event_id, floor(value * -1 + 0.5)::bigint as half_up, round(greatest(0.0, least(1.0, (value - 10) / 90.0)), 6) as normalized, round(10 * log10(value + 0.001), 6) as db, pow(2, floor(log2(greatest(1.0, value))))::bigint as power, "
    "printf('%02d:%02d', floor(least(1891.0, value * 10))::bigint // 60, floor(least(1891.0, value * 10))::bigint % 60) as clock, null::double as unread, try_cast(props[7:8] as double) as cell from events"
)
def scalar_functions(spark, sf_dir):
    v = F.col("value")
    text = F.when(F.col("event_type") == "view", "NaN").when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    return _events(spark, sf_dir).select(
        "event_id", scalars.half_up(-v).alias("half_up"), F.round(scalars.normalize(v, F.lit(10.0), F.lit(100.0)), 6).alias("normalized"), F.round(scalars.decibels(v + 0.001), 6).alias("db"), scalars.power_of_two(v).alias("power"),
        scalars.clock(v * 10, 1891.0).alias("clock"), scalars.numeric(text).alias("unread"), scalars.numeric(F.substring("props", 7, 2)).alias("cell"),
    )


@query("select event_id, case when user_id % 5 = 0 then '—' else regexp_replace(printf('%.1f', user_id / 7.0), '\\.0$', '') end as shown, case when user_id = 70 then '0' when user_id > 70 then '+' || regexp_replace(printf('%.1f', (user_id - 70) / 7.0), '\\.0$', '') else '−' || regexp_replace(printf('%.1f', (70 - user_id) / 7.0), '\\.0$', '') end as signed, user_id || ' of 200 windows' as quality from events")
def metric_texts(spark, sf_dir):
    u = F.col("user_id")
    return _events(spark, sf_dir).select("event_id", scalars.metric_text(F.when(u % 5 != 0, u / 7.0)).alias("shown"), scalars.signed_metric_text((u - 70) / 7.0).alias("signed"), tables.quality_label(u, F.lit(200)).alias("quality"))


@query("select event_id, printf('%08x', list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(props, ''), lambda c: ord(c)::bigint)), lambda h, u: (xor(h, u) * 16777619) % 4294967296)) as fnv from events")
def fnv1a(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", scalars.fnv1a32(F.col("props")).alias("fnv"))


@query(
    f"with {_B}, l as (select vec_id, log10(freq) as x, log10(power) as y from b where bin > 0 and freq between 100 and 8000 and power > 0), s as (select vec_id, count(*) as points, -regr_slope(y, x) as beta, regr_intercept(y, x) as intercept, "
    "regr_syy(y, x) as syy, greatest(0.0, regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x)) as rest from l group by 1) select vec_id, points, round(beta, 6) as beta, round(intercept, 6) as intercept, round(1 - rest / syy, 6) as r2, round(10 * sqrt(rest / points), 6) as rmse_db from s where points >= 8"
)
def power_law_fit(spark, sf_dir):
    return _round(spectral.fit_power_law(_bins(spark, sf_dir), ["vec_id"], 100.0, 8000.0))


@query(f"with {_B} select vec_id, round(exp(avg(ln(greatest(power, 5e-324)))) / avg(power), 6) as flatness from b where bin > 0 and freq between 100 and 8000 and power > 0 group by 1")
def spectral_flatness(spark, sf_dir):
    return _round(spectral.band(_bins(spark, sf_dir), 100.0, 8000.0).groupBy("vec_id").agg(spectral.flatness(F.col("power")).alias("flatness")))


@query(f"with {_B}, c as (select unnest({spectral.THIRD_OCTAVES})::double as centre) select vec_id, centre, round(10 * log10(greatest(sum(power * 125.0), 5e-324)), 6) as db, count(*) as bins from b join c on freq >= centre / pow(2, 1 / 6.0) and freq < centre * pow(2, 1 / 6.0) group by all")
def third_octave(spark, sf_dir):
    return _round(spectral.third_octaves(_bins(spark, sf_dir), ["vec_id"], F.lit(125.0)))


@query(
    f"with {_B}, l as (select vec_id, least(47, floor((log10(freq) - 2) / (log10(8000) - 2) * 48))::int as bucket, log10(power) as y from b where bin > 0 and freq between 100 and 8000 and power > 0) "
    "select vec_id, bucket, round(median(y), 6) as level, count(*) as bins, round(2 + (bucket + 0.5) * (log10(8000) - 2) / 48, 6) as x from l group by all"
)
def log_bin_median(spark, sf_dir):
    return _round(spectral.log_bin_median(_bins(spark, sf_dir), ["vec_id"], 100.0, 8000.0))


@query(
    f"with {_B}, l as (select vec_id, least(47, floor((log10(freq) - 2) / (log10(8000) - 2) * 48))::int as bucket, log10(power) as y from b where bin > 0 and freq between 100 and 8000 and power > 0), "
    "p as (select vec_id, 2 + (bucket + 0.5) * (log10(8000) - 2) / 48 as x, median(y) as y from l group by vec_id, bucket), o as (select *, row_number() over w - 1 as i, count(*) over (partition by vec_id) as n, (x + lag(x) over w) / 2 as mid from p window w as (partition by vec_id order by x)), "
    "t as (select c.vec_id, c.i, c.n, c.mid, o.x, o.y, greatest(0, o.x - c.mid) as h from o c join o on o.vec_id = c.vec_id where c.i >= 7 and c.i < c.n - 1), "
    "g as (select vec_id, i, any_value(n) as n, any_value(mid) as mid, regr_sxx(y, x) as xx, regr_sxy(y, x) as xy, regr_syy(y, x) as yy, regr_sxy(h, x) as xh, regr_syy(h, x) as hh, regr_sxy(y, h) as yh from t group by vec_id, i), "
    "e as (select *, hh - xh * xh / xx as energy, yy - xy * xy / xx as line, yh - xy * xh / xx as pull from g), d as (select *, abs(pull / energy) as delta, greatest(0.0, line - pull * pull / energy) as rest, least(i, n - i) as support from e where energy > 2.3e-16), "
    "f as (select *, greatest(0.0, 1 - rest / line) as relative, delta * greatest(0.0, 1 - rest / line) * sqrt(support) as evidence, 10 * (sqrt(line / n) - sqrt(rest / n)) as improvement from d) "
    "select vec_id, round(mid, 6) as at, round(delta, 6) as delta, round(improvement, 6) as improvement, round(relative, 6) as relative, round(evidence, 6) as evidence, support from f qualify row_number() over (partition by vec_id order by evidence desc, i) = 1"
)
def slope_changes(spark, sf_dir):
    return _round(spectral.hinge_scan(spectral.log_bin_median(_bins(spark, sf_dir), ["vec_id"], 100.0, 8000.0), ["vec_id"]))


_MAXIMA = f"{_B}, m as (select *, max(power) over (partition by vec_id order by bin rows between 2 preceding and 1 preceding) as p, max(power) over (partition by vec_id order by bin rows between 1 following and 2 following) as f from b), top as (select vec_id, bin, freq, power from m where power > coalesce(p, -1) and power > coalesce(f, -1))"


@query(f"with {_MAXIMA} select vec_id, bin from top")
def local_maxima(spark, sf_dir):
    return spectral.local_maxima(_bins(spark, sf_dir), ["vec_id"], "bin", "power").select("vec_id", "bin")


@query(f"with {_B} select a.vec_id, a.bin, round(median(n.power), 6) as floor, round(a.power - median(n.power), 6) as prominence from b a join b n on a.vec_id = n.vec_id and abs(a.bin - n.bin) between 4 and 18 group by a.vec_id, a.bin, a.power")
def neighbourhood_floor(spark, sf_dir):
    return _round(spectral.floor_and_prominence(_bins(spark, sf_dir), ["vec_id"], "bin", "power").select("vec_id", "bin", "floor", "prominence"))


def _peaks(spark, sf_dir) -> DataFrame:
    return spectral.local_maxima(_bins(spark, sf_dir), ["vec_id"], "bin", "power").where("power > 0.04")


@query(f"with {_MAXIMA}, a as (select * from top where power > 0.04) select vec_id, bin from a where exists (select 1 from a e where e.vec_id = a.vec_id + 1 and abs(a.freq - e.freq) <= greatest(12.0, 0.02 * e.freq))")
def persistent_peaks(spark, sf_dir):
    peaks = _peaks(spark, sf_dir)
    return spectral.persistent(peaks, peaks.withColumn("vec_id", F.col("vec_id") - 1), ["vec_id"]).select("vec_id", "bin")


@query(
    f"with {_MAXIMA}, a as (select * from top where power > 0.04 and freq > 0), h as (select s.vec_id, s.freq as seed, d, s.freq / d as base from a s cross join (select unnest(range(1, 13)) as d) where s.freq / d >= 40), "
    "c as (select h.vec_id, seed, d, count(distinct a.freq) as n from h join a on a.vec_id = h.vec_id and floor(a.freq / base + 0.5) between 1 and 12 and abs(a.freq / base - floor(a.freq / base + 0.5)) / floor(a.freq / base + 0.5) <= greatest(0.018, 250.0 / a.freq) group by all) "
    "select vec_id, max(n)::int as harmonic_peaks from c group by 1"
)
def harmonic_match(spark, sf_dir):
    return spectral.harmonic_match(_peaks(spark, sf_dir).where("freq > 0"), ["vec_id"], F.lit(125.0))


@query(
    f"with recursive {_MAXIMA}, r as (select vec_id, bin, row_number() over (partition by vec_id order by power desc, bin) as i, count(*) over (partition by vec_id) as n from top where power > 0.04), "
    "s as (select distinct vec_id, 0::bigint as i, []::bigint[] as kept, n from r union all select s.vec_id, r.i, case when len(list_filter(kept, lambda x: abs(x - r.bin) <= 10)) > 0 then kept else list_append(kept, r.bin::bigint) end, s.n from s join r on r.vec_id = s.vec_id and r.i = s.i + 1) "
    "select vec_id, (generate_subscripts(kept, 1) - 1)::int as place, unnest(kept)::int as bin from s where i = n"
)
def suppressed_peaks(spark, sf_dir):
    peaks = _peaks(spark, sf_dir).groupBy("vec_id").agg(F.collect_list(F.struct(F.col("power").alias("prominence"), "bin")).alias("p"))
    return peaks.select("vec_id", F.posexplode(spectral.suppressed(F.col("p"))).alias("place", "kept")).select("vec_id", "place", "kept.bin")


@query(
    f"with {_B} select vec_id, bin, round(case when vec_id % 3 = 0 then 0.0 when freq <= 200 then 1.0 when freq >= 4000 then -2.0 when freq < 1000 then 1 + 2 * ln(freq / 200.0) / ln(5.0) else 3 - 5 * ln(freq / 1000.0) / ln(4.0) end, 6) as correction_db, "
    "case when vec_id % 3 = 0 then 'no profile for this route' end as uncorrected_reason from b where bin > 0"
)
def calibration_interp(spark, sf_dir):
    profiles = spark.createDataFrame([("r1",), ("r2",)], "route_id string").withColumn("points", F.expr("array(named_struct('frequency', 4000D, 'db', -2D), named_struct('frequency', 200D, 'db', 1D), named_struct('frequency', 1000D, 'db', 3D))"))
    rows = _bins(spark, sf_dir).where("bin > 0").withColumn("route_id", F.concat(F.lit("r"), (F.col("vec_id") % 3).cast("string")))
    return _round(spectral.calibrated(rows, F.broadcast(profiles)).select("vec_id", "bin", "correction_db", "uncorrected_reason"))


@query("select time_bucket(interval '1 hour', ts) as begins, time_bucket(interval '1 hour', ts) + interval '1 hour' as ends, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def tumbling_events(spark, sf_dir):
    return _round(live.event_windows(_events(spark, sf_dir), "1 hour"), 4)


@query("with w as (select *, unnest([time_bucket(interval '30 minutes', ts), time_bucket(interval '30 minutes', ts) - interval '30 minutes']) as begins from events) select begins, begins + interval '1 hour' as ends, event_type, count(*) as n, round(sum(value), 4) as total from w group by all")
def sliding_events(spark, sf_dir):
    return _round(live.event_windows(_events(spark, sf_dir), "1 hour", "30 minutes"), 4)


@query(
    "with g as (select *, case when ts < lag(ts) over w + interval '6 hours' then 0 else 1 end as new from events window w as (partition by user_id order by ts)), s as (select *, sum(new) over (partition by user_id order by ts) as run from g) "
    "select user_id, min(ts) as begins, max(ts) + interval '6 hours' as ends, count(*) as n, round(sum(value), 4) as total from s group by user_id, run"
)
def gap_sessions(spark, sf_dir):
    return _round(live.event_sessions(_events(spark, sf_dir), "6 hours"), 4)


_NEAREST = "case when m <= -1.5 then 'violet' when m <= -0.5 then 'blue' when m <= 0.5 then 'white' when m <= 1.5 then 'pink' else 'brown' end"
_BETA = "case {} when 'violet' then -2.0 when 'blue' then -1.0 when 'white' then 0.0 when 'pink' then 1.0 when 'brown' then 2.0 end"


@query(
    f"with recursive {_E}, o as (select user_id, event_id, t, value / 100 - 1.5 as beta, {_STATE} as now, row_number() over (partition by user_id order by t, event_id) as i from e), "
    "s as (select distinct user_id, 0::bigint as i, 'listening' as state, null::double as smoothed, null::double as shown_beta, null::varchar as pending, 0 as pending_count, 'None' as confidence, null::double as t, null::bigint as event_id, null::double as beta from o "
    "union all select user_id, i, case when not good then now when moved then proposed else state end, case when good then m end, case when good and not waits then m when good then shown_beta end, case when good and waits then proposed end, case when good and waits then times else 0 end, "
    "case when not good then 'None' when (case when moved then proposed else state end) not in ('violet', 'blue', 'white', 'pink', 'brown') or (case when waits then shown_beta else m end) is null then 'None' when waits or now <> (case when moved then proposed else state end) then 'Provisional' else 'High' end, t, event_id, beta from ("
    "select *, proposed is distinct from state and times >= 2 as moved, proposed is distinct from state and times < 2 as waits from (select *, case when pending is not distinct from proposed then pending_count + 1 else 1 end as times from ("
    f"select *, case when coalesce(abs(m - {_BETA.format('near')}) + 0.12 >= abs(m - {_BETA.format('state')}), false) then state else near end as proposed from (select *, {_NEAREST} as near from ("
    "select o.user_id, o.i, o.t, o.event_id, o.beta, o.now, o.now in ('pink', 'white', 'brown') as good, s.state, s.shown_beta, s.pending, s.pending_count, case when s.smoothed is null then o.beta else 0.28 * o.beta + (1 - 0.28) * s.smoothed end as m from s join o on o.user_id = s.user_id and o.i = s.i + 1))))))"
    " select user_id, round(t, 6) as t, event_id, round(beta, 6) as beta, state as shown_state, round(smoothed, 6) as smoothed, round(shown_beta, 6) as shown_beta, pending, pending_count, confidence from s where i > 0"
)
def hysteresis_fold(spark, sf_dir):
    colors = list(STATES.values())[:3]
    rows = _observed(spark, sf_dir).withColumns({"beta": F.col("value") / 100 - 1.5, "reliable": F.col("state").isin(colors), "confidence": F.lit("High")})
    return _round(color_state.color_states(rows, ["user_id"], ["t", "event_id"]))


def _numbered(spark, sf_dir) -> DataFrame:
    """Samples of a signal for each event type, in order of time."""
    rows = _events(spark, sf_dir).select("event_type", "t", "event_id", (F.col("value") / 500).alias("x"))
    placed = buckets.placed(rows, ["event_type"], "t", buckets.width(rows, "t"), ["t", "event_id"])
    return placed.select("event_type", "n", "x", F.lit(1000.0).alias("rate"))


_N = "e as (select event_type, row_number() over (partition by event_type order by ts, event_id) - 1 as n, value / 500 as x from events)"


@query(
    f"with {_N}, l as (select event_type, count(*) as len, least(4096, pow(2, floor(log2(count(*))))::bigint) as size from e group by 1 having count(*) >= 256), a as (select *, (len - size) // (size // 2) + 1 as everything from l), "
    "g as (select *, least(48, everything) as segments from a), f as (select *, unnest(range(segments)) as i from g), "
    "s as (select event_type, size, segments, i, (case when segments = 1 then (everything - 1) // 2 else floor(i * (everything - 1) / (segments - 1) + 0.5)::bigint end) * (size // 2) as start from f), "
    "x as (select s.event_type, size, segments, i, n - start as j, (x - avg(x) over (partition by s.event_type, i)) * (0.5 - 0.5 * cos(2 * pi() * (n - start) / (size - 1))) as v, 0.5 - 0.5 * cos(2 * pi() * (n - start) / (size - 1)) as w from s join e on e.event_type = s.event_type and n between start and start + size - 1), "
    "b as (select event_type, unnest(range(size // 2 + 1)) as bin from l), "
    "d as (select x.event_type, i, bin, any_value(size) as size, any_value(segments) as segments, pow(sum(v * cos(2 * pi() * ((j * bin) % size) / size)), 2) + pow(sum(v * sin(2 * pi() * ((j * bin) % size) / size)), 2) as p, sum(w * w) as energy from x join b on b.event_type = x.event_type group by x.event_type, i, bin) "
    "select event_type, bin::int as bin, round(any_value(bin * 1000.0 / size), 6) as freq, round(10 * log10(avg(p / (1000 * energy) * case when bin > 0 and bin < size // 2 then 2 else 1 end)), 4) as db, any_value(segments)::int as segments from d group by event_type, bin"
)
def power_density(spark, sf_dir):
    found = spectral.framed_density(_numbered(spark, sf_dir), ["event_type"])
    return found.select("event_type", "bin", F.round("freq", 6).alias("freq"), F.round(scalars.decibels(F.col("power")), 4).alias("db"), "segments")


def _packets(spark, sf_dir) -> DataFrame:
    """Packets of 64 samples at 64 Hz for each event type; every seventh is lost."""
    rows = _numbered(spark, sf_dir).withColumn("rate", F.lit(64.0))
    return live.packets(rows, "event_type", 64, 1704067200).where("seq % 7 != 3")


_P = f"{_N}, p as (select event_type as session_id, n // 64 as seq, (n // 64) * 64 as start, count(*) as len from e where (n // 64) % 7 <> 3 group by 1, 2, 3), g as (select *, lag(start + len) over (partition by session_id order by seq) as stop from p)"


@query()
def live_session(spark, sf_dir):
    return _round(sessions.with_states(live.replayed(_packets(spark, sf_dir), "instant")))


@query()
def live_summaries(spark, sf_dir):
    return _round(sessions.summarized(sessions.with_states(live.replayed(_packets(spark, sf_dir), "instant"))))


@query(
    f"with {_P}, r as (select event_type as session_id, 'frame' as kind, (n // 32) * 32 / 64.0 as begins, (max(n) + 1) / 64.0 as ends, round(20 * log10(greatest(1e-12, sqrt(avg(pow(x::float::double, 2))))), 4) as dbfs, round(max(abs(x::float::double)), 6) as peak, count(*) as samples "
    "from e where (n // 64) % 7 <> 3 group by event_type, n // 32 union all select session_id, 'gap', stop / 64.0, start / 64.0, null, null, 0 from g where stop < start) select * from r"
)
def live_frames(spark, sf_dir):
    rows = live.replayed(_packets(spark, sf_dir), "instant").where("kind in ('frame', 'gap')")
    return rows.select("session_id", "kind", "begins", "ends", F.round("dbfs", 4).alias("dbfs"), F.round("peak", 6).alias("peak"), "samples")


@query(
    f"with {_P}, m as (select event_type as session_id, n // 64 as seq, max(abs(x::float::double)) as peak, 20 * log10(greatest(1e-12, sqrt(avg(pow(x::float::double, 2))))) as dbfs from e where (n // 64) % 7 <> 3 group by 1, 2), "
    "t as (select session_id, max(seq) as seq, count(*) as blocks, sum(len)::bigint as samples from p group by 1) select session_id, seq, round(peak, 6) as peak, round(dbfs, 6) as dbfs, blocks, samples from t join m using (session_id, seq)"
)
def capture_trace(spark, sf_dir):
    return _round(capture.traced(_packets(spark, sf_dir)))


@query(f"with {_P} select session_id, stop as sample_offset, start as resume_sample_offset, (start - stop) / 64.0 as gap_seconds from g where stop < start")
def capture_gaps(spark, sf_dir):
    return live.gaps(_packets(spark, sf_dir))


@query(
    f"with {_B}, l as (select vec_id, log10(freq) as x, log10(power) as y from b where bin > 0 and freq between 100 and 8000 and power > 0), f as (select vec_id, -regr_slope(y, x) as beta from l group by 1 having count(*) >= 8) "
    "select 'p' || (a.vec_id // 2) as pair_id, round(a.beta, 6) as beta_a, round(b.beta, 6) as beta_b, 16000.0::double as rate_a, 16000.0::double as rate_b, round(abs(a.beta - b.beta), 6) as difference, true as same_rate, true as same_config, abs(a.beta - b.beta) <= 1e-12 as passed from f a join f b on b.vec_id = a.vec_id + 1 where a.vec_id % 2 = 0"
)
def replay_pairs(spark, sf_dir):
    spectra_ = _bins(spark, sf_dir).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("freq", "power"))).alias("s"))
    beta = spectral.fit_power_law(_bins(spark, sf_dir), ["vec_id"], 100.0, 8000.0).select("vec_id", "beta")
    rows = spectra_.join(beta, "vec_id").select(
        F.concat(F.lit("p"), F.floor(F.col("vec_id") / 2).cast("string")).alias("pair_id"), F.when(F.col("vec_id") % 2 == 0, "a").otherwise("b").alias("role"), F.lit(16000.0).alias("rate"),
        F.lit(100.0).alias("fit_low"), F.lit(8000.0).alias("fit_high"), F.col("s.freq").alias("frequencies"), F.col("s.power").alias("power"), "beta",
    )
    return _round(replay.compared(replay.replayed(replay.documents(rows))))
