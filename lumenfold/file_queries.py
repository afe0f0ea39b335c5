"""Sources, sinks, projections and session statistics as queries, and their SQL."""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import scalars
from lumenfold.operators import intervals, stats, tables
from lumenfold.plans import shared
from lumenfold.queries import _E, _SEG, _STATE, _events, _observed, _round, _segments
from lumenfold.registry import query
from lumenfold.sources import audio, committed, store, text, wav_files


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("select n_regionkey::bigint as region, n_name || ' \"q\", x' as name, 'abc,de' || n_nationkey as note from nation")
def csv_cells(spark, sf_dir):
    """A CSV text for each region, with quotes in the middle of fields, CRLF, an empty record and a surplus cell."""
    line = F.concat(F.lit('"'), "n_name", F.lit(' ""q"", x",ab"c,d"e'), F.col("n_nationkey").cast("string"), F.lit(",surplus\r\n"))
    texts = _table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("region")).agg(F.concat(F.lit("name,note\r\n,\r\n"), F.array_join(F.collect_list(line), "")).alias("text"))
    return text.csv_rows(texts, "text", ["name", "note"], ["region"])


def _wav_bytes(values: list[float] | None) -> bytes:
    data = np.array(values or [], "<f4").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 3, 1, 8000, 32000, 4, 32) + b"data" + struct.pack("<I", len(data)) + data


def _wav(rows: DataFrame) -> DataFrame:
    """embeddings as WAV files of 32-bit floats."""

    def write(batches):
        for b in batches:
            out = [_wav_bytes(v) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array([len(x) for x in out], pa.int64()), pa.array(out, pa.binary())], ["path", "length", "content"])

    return rows.select("vec_id", "embedding").mapInArrow(write, "path string, length long, content binary")


@query("select vec_id::varchar as path, 'wav' as kind, 8000.0::double as rate, unnest(range(len(embedding)))::int as place, unnest(embedding)::float as x from embeddings")
def wav_samples(spark, sf_dir):
    files = audio.decoded(_wav(_table(spark, sf_dir, "embeddings")))
    return files.select("path", "kind", "rate", F.posexplode("samples").alias("place", "x"))


def _wav_folder(spark, sf_dir: str, vectors: int) -> str:
    """A new shared folder with embeddings as WAV files, a file for each so many vec_ids, its vectors end to end; tasks write them."""
    target = f"{shared.folder(spark)}/wav/{uuid.uuid4().hex}"
    row = F.struct("vec_id", "embedding")
    packed = _table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / vectors).cast("long").alias("file")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["embedding"])).alias("x"))

    def write(rows):
        system, root = fs.FileSystem.from_uri(target)
        system.create_dir(root, recursive=True)
        for r in rows:
            # whole files appear at once, so that a task that runs twice leaves one
            hidden = f"{root}/.{uuid.uuid4().hex}"
            with system.open_output_stream(hidden) as out:
                out.write(_wav_bytes(r.x))
            system.move(hidden, f"{root}/{r.file}.wav")

    packed.foreachPartition(write)
    return target


@query(
    "with r as (select vec_id, unnest(range(len(embedding))) as i, unnest(embedding)::float as x from embeddings), p as (select (vec_id // 256) || '.wav' as file, row_number() over (partition by vec_id // 256 order by vec_id, i) - 1 as place, count(*) over (partition by vec_id // 256) as n, x from r) "
    "select file, 8000.0::double as rate, 1 as channels, place - greatest(0, n - 12000) as place, x from p where place >= n - 12000"
)
def wav_frames(spark, sf_dir):
    """The last one and a half seconds of WAV files, read by ranges of bytes."""
    wav_files.register(spark)
    rows = spark.read.format(wav_files.FORMAT).options(mostSeconds=1.5, splitBytes=40_000).load(_wav_folder(spark, sf_dir, 256))
    return rows.select(F.substring_index("path", "/", -1).alias("file"), "rate", "channels", "place", "x")


@query(
    "with r as (select vec_id, unnest(range(len(embedding))) as i, unnest(embedding)::float as x from embeddings), s as (select vec_id // 256 as file, x, (row_number() over (partition by vec_id // 256 order by vec_id, i) - 1) // 4000 as half from r) "
    "select file || '.wav' as file, half, round(20 * log10(greatest(1e-12, sqrt(avg(pow(x::double, 2))))), 6) as dbfs, round(max(abs(x::double)), 6) as peak, count(*) as frames from s group by all"
)
def wav_stream_levels(spark, sf_dir):
    """The level of each half second of WAV files that a stream finds, written with its state batch by batch."""
    wav_files.register(spark)
    source, folder = _wav_folder(spark, sf_dir, 256), f"{shared.folder(spark)}/streams/{uuid.uuid4().hex}"
    frames = spark.readStream.format(wav_files.FORMAT).option("lag", 0).load(source)

    def levels(batch: DataFrame, number: int) -> None:
        halves = batch.groupBy(F.substring_index("path", "/", -1).alias("file"), F.floor(F.col("place") / (F.col("rate") / 2)).cast("long").alias("half"))
        x = F.col("x").cast("double")
        found = halves.agg(stats.dbfs(F.sqrt(F.avg(x * x))).alias("dbfs"), F.max(F.abs(x)).alias("peak"), F.count("*").alias("frames"))
        found.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    frames.writeStream.foreachBatch(levels).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return _round(spark.read.parquet(f"{folder}/rows").drop("batch"))


@query(
    "with f as (select l_orderkey, l_linenumber, (l_extendedprice * 200)::bigint as length, 7000 + (l_partkey % 40) * 5000 as rate, (l_quantity % 10)::int as channels, l_quantity * 2.5 as seconds from lineitem), "
    "p as (select *, ceil(seconds * rate) as frames from f), q as (select *, length + frames * channels * 4 + frames * 4 + greatest(8388608, ceil(frames * channels * 2)) as peak from p) "
    "select l_orderkey, l_linenumber, peak::bigint as peak, case when length > 12582912 then 'file too large' when rate not between 7350 and 192000 or channels not between 1 and 8 then 'layout not verified' when seconds <= 0 then 'duration unknown' when seconds > 120 then 'too long' when peak > 134217728 then 'needs too much memory' end as problem from q"
)
def upload_rules(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 200).cast("long").alias("length"), (7000 + (F.col("l_partkey") % 40) * 5000).alias("rate"), (F.col("l_quantity") % 10).cast("int").alias("channels"), (F.col("l_quantity") * 2.5).alias("seconds"))
    parts = {n: F.col(n) for n in ("length", "rate", "channels", "seconds")}
    peak = audio.decode_peak(parts["length"], parts["seconds"], parts["rate"], parts["channels"]).cast("long")
    return rows.select("l_orderkey", "l_linenumber", peak.alias("peak"), audio.upload_problem(**parts).alias("problem"))


@query("select vec_id, i::int as place, (((0 + embedding[i + 1]::double / 4) + embedding[i + 17]::double / 4) + embedding[i + 33]::double / 4 + embedding[i + 49]::double / 4)::float as x from (select vec_id, embedding, unnest(range(16)) as i from embeddings)")
def mono_mix(spark, sf_dir):
    rows = audio.float_samples(_table(spark, sf_dir, "embeddings"), "embedding")
    channels = F.array(*[F.slice("embedding", 16 * k + 1, 16) for k in range(4)])
    return rows.select("vec_id", F.posexplode(audio.mono(channels)).alias("place", "x"))


@query(
    "select vec_id, len(embedding) / 4.0 as source_seconds, greatest(0, len(embedding) - 40) / 4.0 as begins, len(embedding) > 40 as truncated, embedding[greatest(1, len(embedding) - 39)]::double as first, least(40, len(embedding))::int as kept from embeddings"
)
def bounded_tails(spark, sf_dir):
    """The last ten seconds of embeddings taken as samples at 4 Hz."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", audio.bounded(F.col("embedding"), F.lit(4.0), 10.0).alias("b"))
    return rows.select("vec_id", "b.source_seconds", "b.begins", "b.truncated", F.get("b.samples", F.lit(0)).cast("double").alias("first"), F.size("b.samples").alias("kept"))


_FNV = "printf('fnv1a32-%08x', list_reduce(list_prepend(2166136261::bigint, list_transform(string_split({}, ''), lambda c: ord(c)::bigint)), lambda h, u: (xor(h, u) * 16777619) % 4294967296))"


@query(
    "with p as (select s_suppkey, 'r' || s_suppkey as route_id, '[{\"frequency\":' || (100 + s_suppkey) || ',\"correctionDb\":' || (s_suppkey % 7 - 3) || '},{\"frequency\":5000000.25,\"correctionDb\":-2.5}]' as points from supplier where s_suppkey % 4 <> 0 and s_suppkey % 5 <> 0) "
    f"select s_suppkey, route_id, {_FNV.format('points')} as correction from p"
)
def calibration_profiles(spark, sf_dir):
    """Profiles from JSON: those without a name, or with a frequency twice, are left out."""
    rows = _table(spark, sf_dir, "supplier")
    other = F.when(F.col("s_suppkey") % 5 == 0, F.col("s_suppkey") + 100).otherwise(F.lit(5000000.25))
    document = F.to_json(F.struct(
        F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name")).otherwise(" ").alias("name"), F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("route_id"),
        F.array(F.struct(other.cast("double").alias("frequency"), F.lit(-2.5).alias("db")), F.struct((100.0 + F.col("s_suppkey")).alias("frequency"), (F.col("s_suppkey") % 7 - 3.0).alias("db"))).alias("points"),
    ))
    read = rows.select("s_suppkey", F.from_json(document, text.CALIBRATION).alias("p")).select("s_suppkey", "p.*")
    return text.calibrations(read).select("s_suppkey", "route_id", text.snapshot(F.col("points")).alias("correction"))


@query("select s_nationkey, 'r' || s_suppkey as route_id, (s_suppkey % 7 - 3)::double as db from supplier where s_nationkey % 5 <> 0 and s_suppkey % 4 <> 0")
def calibration_lists(spark, sf_dir):
    """Lists of profiles, one for each nation; some are cut short, and some profiles have no name."""
    key = F.col("s_suppkey")
    points = F.array(F.struct((100.0 + key).alias("frequency"), (key % 7 - 3.0).alias("correctionDb")), F.struct(F.lit(5e6).alias("frequency"), F.lit(0.0).alias("correctionDb")))
    profile = F.struct(F.when(key % 4 != 0, F.col("s_name")).otherwise("").alias("name"), F.concat(F.lit("r"), key.cast("string")).alias("routeId"), points.alias("points"))
    lists = _table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.to_json(F.collect_list(profile)).alias("list"))
    cut = lists.withColumn("list", F.when(F.col("s_nationkey") % 5 == 0, F.substring("list", 1, 40)).otherwise(F.col("list")))
    return text.calibration_list(cut, "list", ["s_nationkey"]).select("s_nationkey", "route_id", F.get("points", F.lit(0))["db"].alias("db"))


@query("select event_id, '{\"event_id\":' || event_id || ',\"info\":{\"type\":\"' || event_type || '\",\"x\":null},\"items\":[{\"k\":1},{\"k\":' || user_id || '}]}' as document from events")
def sanitized_documents(spark, sf_dir):
    nested = F.struct(F.col("event_type").alias("type"), F.lit("secret").alias("GroupId"), F.lit(float("nan")).alias("x"))
    items = F.array(F.struct(F.lit(1).cast("long").alias("k"), F.lit("s").alias("rawSamples")), F.struct(F.col("user_id").alias("k"), F.lit("t").alias("rawSamples")))
    rows = _events(spark, sf_dir).select("event_id", F.lit("id").alias("deviceId"), nested.alias("info"), items.alias("items"), F.encode("event_type", "UTF-8").alias("bytes"))
    return text.json_documents(rows).select(F.get_json_object("document", "$.event_id").cast("long").alias("event_id"), "document")


@query(
    "select event_id, case when event_type = 'view' then null else 16000 + user_id end as rate, case when event_type in ('view', 'error') then null else value end as latency, case when event_type = 'view' then null else user_id % 2 = 0 end as echo, event_type as label, null::varchar as missing, null::varchar as nested, "
    "case when user_id % 3 = 0 then '[]' else '[1.5,null,' || user_id || '.0]' end as numbers from events"
)
def kept_settings(spark, sf_dir):
    """Settings by the list of allowed ones, columns by a closed list, numbers of text arrays."""
    latency = F.when(F.col("event_type") == "error", F.lit(float("inf"))).otherwise(F.col("value"))
    settings = F.when(F.col("event_type") != "view", F.struct((16000 + F.col("user_id")).alias("sampleRate"), latency.alias("latency"), (F.col("user_id") % 2 == 0).alias("echoCancellation"), F.lit("me").alias("deviceId"), F.lit("text").alias("sampleSize")))
    rows = _events(spark, sf_dir).select("event_id", F.col("event_type").alias("label"), settings.alias("s"), F.when(F.col("user_id") % 3 != 0, F.array(F.lit("1.5"), F.lit("x"), F.col("user_id").cast("string"))).alias("n"))
    kept = rows.withColumn("k", text.audio_settings(F.col("s"), rows.schema["s"].dataType)).withColumn("nested", F.struct("label"))
    assert kept.schema["k"].dataType.names == ["sampleRate", "latency", "echoCancellation"]
    flat = kept.select("event_id", "label", "nested", F.col("k.sampleRate").alias("rate"), F.col("k.latency").alias("latency"), F.col("k.echoCancellation").alias("echo"), text.numbers(F.col("n")).alias("numbers"))
    return text.picked(flat.withColumn("numbers", F.to_json("numbers")), ["event_id", "rate", "latency", "echo", "label", "missing", "nested", "numbers"])


@query(
    "with g as (select user_id, list(event_id order by ts, event_id) as ids from events group by 1) select user_id, least(20, len(ids))::int as points, ids[1] as first, case when len(ids) <= 20 then ids[2] else ids[floor((len(ids) - 1) / 19.0 + 0.5)::bigint + 1] end as second, ids[-1] as last, true as compacted, false as detail_arrays_stored, 4::bigint as n_columns from g where len(ids) > 1"
)
def compacted_results(spark, sf_dir):
    points = F.transform(F.array_sort(F.collect_list(F.struct("t", "event_id"))), lambda p: p["event_id"])
    rows = _events(spark, sf_dir).groupBy("user_id").agg(points.alias("temporal_beta")).withColumns({"psd": F.array(F.lit(1.0)), "spectrogram": F.lit("x"), "deviceId": F.lit("d")})
    slim = store.compacted(rows, most=20)
    ids = F.col("temporal_beta")
    return slim.where(F.size(ids) > 1).select("user_id", F.size(ids).alias("points"), F.get(ids, F.lit(0)).alias("first"), F.get(ids, F.lit(1)).alias("second"), F.element_at(ids, -1).alias("last"), "compacted", "detail_arrays_stored", F.lit(len(slim.columns)).cast("long").alias("n_columns"))


@query(
    "with b as (select o_orderkey as id, o_orderdate as timestamp, 'old' as state, 0 as fresh from orders where o_orderkey % 3 <> 0 union all select o_orderkey, o_orderdate + interval 1 day, 'new', 1 from orders where o_orderkey % 2 = 0), "
    "k as (select * from b qualify row_number() over (partition by id order by fresh desc, timestamp desc) = 1) select id, timestamp, state from k order by timestamp desc, id desc limit 100"
)
def upserted_results(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("timestamp"))
    stored = orders.where("id % 3 != 0").withColumn("state", F.lit("old"))
    return store.upserted(stored, orders.where("id % 2 = 0").select("id", F.expr("timestamp + interval 1 day").alias("timestamp"), F.lit("new").alias("state")))


@query(
    "with b as (select o_orderkey as id, o_orderdate as timestamp, 'old' as state, 0 as fresh from orders where o_orderkey % 3 <> 0 union all select o_orderkey, o_orderdate + interval 1 day, 'new', 1 from orders where o_orderkey % 2 = 0), "
    "k as (select * from b qualify row_number() over (partition by id order by fresh desc, timestamp desc) = 1) select id, timestamp, state from k where id not in (select l_orderkey from lineitem where l_returnflag = 'R') order by timestamp desc, id desc limit 1000"
)
def committed_results(spark, sf_dir):
    """A table on disk after four commits: rows put in, rows in place of others, rows deleted, the latest thousand kept."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("timestamp"))
    stored = orders.where("id % 3 != 0").withColumn("state", F.lit("old"))
    kept = committed.CommittedTable(spark, f"{shared.folder(spark)}/results/{uuid.uuid4().hex}", stored.schema, "id", 16)
    kept.upsert(stored, "timestamp")
    kept.upsert(orders.where("id % 2 = 0").select("id", F.expr("timestamp + interval 1 day").alias("timestamp"), F.lit("new").alias("state")), "timestamp")
    kept.delete(_table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")))
    kept.retain(1000, "timestamp")
    return kept.read()


@query("select o_orderkey, o_orderstatus from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def deleted_results(spark, sf_dir):
    gone = _table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return store.without(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), gone, "o_orderkey")


@query(
    "with r as (select r.r_regionkey, r.r_name, list(n order by n.n_nationkey) as ns from region r join nation n on n.n_regionkey = r.r_regionkey group by all), "
    "l as (select r_regionkey, 'metadata' as section, 0 as place, '# name,\"' || r_name || '\"' as line from r union all select r_regionkey, 'metadata', 1, '# key,' || r_regionkey from r union all select r_regionkey, 'metadata', 2, '# nothing,\"\"' from r "
    "union all select r_regionkey, 'observations', 0, 'time,classification' from r union all select r_regionkey, 'observations', unnest(range(len(ns)))::int + 1, unnest(list_transform(ns, lambda x: x.n_nationkey || ',\"' || x.n_name || ' \\\"q\\\"\"')) from r "
    "union all select r_regionkey, 'timeline', 0, 'begins,label' from r union all select r_regionkey, 'timeline', unnest(range(len(ns)))::int + 1, unnest(list_transform(ns, lambda x: x.n_nationkey || ',\"\"')) from r) select r_regionkey, section, place, line from l"
)
def csv_export(spark, sf_dir):
    nations = _table(spark, sf_dir, "nation")
    entry = F.struct(F.col("n_nationkey").alias("time"), F.concat("n_name", F.lit(' "q"')).alias("classification"), F.col("n_nationkey").alias("begins"), F.lit(None).cast("string").alias("label"))
    results = nations.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(entry)).alias("seen")).join(_table(spark, sf_dir, "region"), "r_regionkey")
    results = results.withColumn("nothing", F.lit(None).cast("double"))
    return store.csv_lines(results, "r_regionkey", {"name": "r_name", "key": "r_regionkey", "nothing": "nothing"}, "seen", ["time", "classification"], "seen", ["begins", "label"])


@query("select * from (select user_id, event_id, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 10) where value >= 20")
def recent_stable(spark, sf_dir):
    rows = _events(spark, sf_dir)
    return stats.recent_since(rows, ["user_id"], [F.desc("t"), F.desc("event_id")], F.col("value") >= 20).select("user_id", "event_id", "value")


@query(f"with {_E} select event_id, min(value) over w as recent_min, max(value) over w as recent_max, count(value) over w as recent_n from e window w as (partition by user_id order by t range between 86400 preceding and current row)")
def recent_range(spark, sf_dir):
    return stats.recent_range(_events(spark, sf_dir), ["user_id"], "t", "value", 86400).select("event_id", "recent_min", "recent_max", "recent_n")


@query(f"with {_E} select event_id, run_n, round(m, 6) as run_mean, round(sqrt(greatest(0.0, q - m * m)), 6) as run_sd from (select event_id, count(value) over w as run_n, (sum(value::decimal(19,9)) over w)::double / count(value) over w as m, (sum((value::decimal(19,9) * value::decimal(19,9))::decimal(38,18)) over w)::double / count(value) over w as q from e window w as (partition by user_id order by t, event_id rows unbounded preceding))")
def running_moments(spark, sf_dir):
    return _round(stats.running_moments(_events(spark, sf_dir), ["user_id"], ["t", "event_id"], "value").select("event_id", "run_n", "run_mean", "run_sd"))


def _measured(spark, sf_dir: str) -> DataFrame:
    reliable = F.col("state").isin(intervals.COLORS)
    return _observed(spark, sf_dir).withColumns({"beta": F.col("value") / 100 - 1, "reliable": reliable, "rmse_db": F.col("value") / 50, "r2": F.col("value") / 500, "flatness": F.col("event_id") % 10 / 10.0})


@query(f"select user_id, {_STATE} as state, count(*) as n, round(min(value) / 100 - 1, 6) as beta_min, round(max(value) / 100 - 1, 6) as beta_max from events group by all")
def state_counts(spark, sf_dir):
    return _round(intervals.state_counts(_measured(spark, sf_dir), ["user_id"]))


@query(f"with {_SEG} select user_id, round(coalesce(100 * sum(seconds) filter (state = 'silence') / sum(seconds), 0), 4) as low_signal, round(coalesce(100 * sum(seconds) filter (state = 'insufficient') / sum(seconds), 0), 4) as awaiting_analysis from dur group by 1")
def signal_split(spark, sf_dir):
    return _round(intervals.signal_percentages(intervals.state_durations(_segments(spark, sf_dir), ["user_id"]), ["user_id"]), 4)


@query(
    f"with {_SEG}, c as (select *, list_position(['violet', 'blue', 'white', 'pink', 'brown'], state) as rank from dur), s as (select user_id, sum(seconds) as seconds, sum(case when rank > 0 then seconds else 0 end) as good, first(state order by seconds desc, rank) filter (rank > 0 and seconds > 0) as dominant from c group by 1), "
    "g as (select user_id, value, event_id, value / 100 - 1 as beta from e where event_type in ('click', 'view', 'signup')), m as (select user_id, count(*) as observations, sum(beta::decimal(19,9))::double / count(*) as beta_mean, sum((beta::decimal(19,9) * beta::decimal(19,9))::decimal(38,18))::double / count(*) as beta_square, median(beta) as beta_median, sum((value / 50)::decimal(19,9))::double / count(*) as rmse_db_mean, sum((value / 500)::decimal(19,9))::double / count(*) as r2_mean, sum((event_id % 10 / 10.0)::double::decimal(19,9))::double / count(*) as flatness_mean from g group by 1) "
    "select s.user_id, round(seconds, 7) as seconds, dominant, round(100 * good / seconds, 7) as reliable_percent, round(100 - 100 * good / seconds, 7) as rejected_percent, coalesce(observations, 0) as observations, round(beta_mean, 7) as beta_mean, round(sqrt(greatest(0.0, beta_square - beta_mean * beta_mean)), 7) as beta_sd, round(beta_median, 7) as beta_median, round(rmse_db_mean, 7) as rmse_db_mean, round(r2_mean, 7) as r2_mean, round(flatness_mean, 7) as flatness_mean from s left join m using (user_id)"
)
def session_summary(spark, sf_dir):
    durations = intervals.state_durations(_segments(spark, sf_dir), ["user_id"])
    return _round(intervals.session_summary(_measured(spark, sf_dir), durations, ["user_id"]), 7)


@query(
    "select event_id, case when user_id % 5 = 0 then '—' else printf('%.2f dB', user_id / 7.0) end as number, printf('%02d:%02d', floor(value * 20 + 0.5)::bigint // 60, floor(value * 20 + 0.5)::bigint % 60) as duration, '&lt;' || event_type || '&gt; &amp; &quot;x&quot;' as html, "
    "case when user_id % 3 = 0 then null when user_id % 3 = 1 then 'https://x.org/' else 'http://x.org/a/' end as url, case when user_id % 2 = 0 then 'd' || user_id when user_id % 3 = 0 then 'mic' else 'default-microphone' end as route, "
    "strftime(ts, '%Y-%m-%dT%H:%M:%S.') || printf('%03d', (epoch_us(ts) // 1000) % 1000) || 'Z' as iso, "
    "case event_type when 'view' then 'Edge' when 'click' then 'Firefox' when 'signup' then 'Chrome' when 'error' then 'Safari' else 'unknown' end as browser, case event_type when 'view' then '12.1' when 'click' then '99' when 'signup' then '7.0.1' when 'error' then '17.4' end as version from events"
)
def display_texts(spark, sf_dir):
    u, kind = F.col("user_id"), F.col("event_type")
    agents = {"view": "Mozilla Chrome/11 Safari/5 Edg/12.1", "click": "Mozilla FxiOS/99 Safari", "signup": "Mozilla Chrome/7.0.1 Safari/537", "error": "Mozilla Version/17.4 Mobile Safari/6"}
    agent = F.create_map(*[F.lit(x) for pair in agents.items() for x in pair])[kind]
    url = F.when(u % 3 == 0, "file:///x/y").when(u % 3 == 1, "https://x.org?a=1#b").otherwise("http://x.org/a/index.html?q")
    found = text.browser_family(F.coalesce(agent, F.lit("curl")))
    return _events(spark, sf_dir).select(
        "event_id", scalars.number_text(F.when(u % 5 != 0, u / 7.0), 2, " dB").alias("number"), scalars.duration_text(F.col("value") * 20).alias("duration"), scalars.html_text(F.concat(F.lit("<"), kind, F.lit('> & "x"'))).alias("html"),
        text.app_url(url).alias("url"), text.input_route(F.when(u % 2 == 0, F.concat(F.lit("d"), u.cast("string"))).otherwise(""), F.when(u % 3 == 0, "mic")).alias("route"), text.iso_time(F.col("ts").cast("timestamp")).alias("iso"),
        found["family"].alias("browser"), found["version"].alias("version"),
    )


@query(
    "select event_id, case event_type when 'view' then 'NotAllowedError' when 'click' then 'NotFoundError' when 'signup' then 'TrackStartError' else 'Error' end as error_name, case event_type when 'view' then 'denied' when 'click' then 'not found' when 'signup' then 'not readable' when 'error' then 'denied' else 'failed' end as category, "
    "case when user_id % 2 = 0 then 'get-user-media' else 'startup' end as stage, event_type in ('view', 'error') as permission_denied, event_type in ('view', 'error') and user_id % 2 = 0 and user_id % 3 = 0 as ios_standalone_denial from events"
)
def startup_failures(spark, sf_dir):
    kind, u = F.col("event_type"), F.col("user_id")
    name = F.when(kind == "view", "NotAllowedError").when(kind == "click", "NotFoundError").when(kind == "signup", "TrackStartError").when(kind == "error", "Weird")
    message = F.when(kind == "error", "Access was denied by /home/me")
    found = text.startup_failure(name, message, F.when(u % 2 == 0, "get-user-media").otherwise("elsewhere"), u % 3 == 0, F.lit(True))
    return _events(spark, sf_dir).select("event_id", found.alias("f")).select("event_id", "f.*")


@query("select user_id, event_id from events where event_type = 'view' qualify row_number() over (partition by user_id order by ts, event_id) = 1")
def first_match(spark, sf_dir):
    return tables.latest(_events(spark, sf_dir).where("event_type = 'view'"), ["user_id"], ["t", "event_id"], 1).select("user_id", "event_id")
