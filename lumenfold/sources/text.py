"""Text tables, calibration profiles, and documents to hand out."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, FloatType, NumericType, StringType, StructField, StructType

from lumenfold.functions.scalars import finite, fnv1a32, numeric

# Fields that never leave, in lower case; settings that may.
FORBIDDEN = {"deviceid", "groupid", "routeid", "inputrouteid", "calibrationroutekey", "samples", "rawsamples", "pcmsamples", "audio", "audiobuffer", "recordingblob"}


def _absent(text: str) -> Iterator[str]:
    """Characters that text doesn't hold."""
    return (c for c in map(chr, range(0xE000, 0x110000)) if c not in text)


def records(text: str) -> list[list[str]]:
    """Comma-separated records: quotes may open anywhere in a field and are dropped, doubled ones inside stand for one; records of empty fields are none.

    Cut at its quotes, a text is outside and inside of them by turns. Separators
    count outside alone, where characters that the text doesn't hold take their
    place; nothing between two insides is a doubled quote.
    """
    free = _absent(text)
    cell, row = next(free), next(free)
    parts = text.split('"')
    for i in range(0, len(parts), 2):
        if not parts[i] and 0 < i < len(parts) - 1:
            parts[i] = '"'
        else:
            parts[i] = re.sub("\r\n?|\n", row, parts[i].replace(",", cell))
    found = (r.split(cell) for r in "".join(parts).split(row))
    return [r for r in found if any(r)]


def csv_rows(texts: DataFrame, column: str, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """keep and all-text columns of the records of each text with a header; missing cells are empty, surplus ones dropped."""
    keep, columns = list(keep), list(columns)
    kinds = to_arrow_schema(texts.select(*keep).schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, cells = [], []
            for i, text in enumerate(b.column(len(keep)).to_pylist()):
                header, *rows = records(text or "") or [[]]
                place = [header.index(c) if c in header else None for c in columns]
                for r in rows:
                    of.append(i)
                    cells.append([r[p] if p is not None and p < len(r) else "" for p in place])
            kept = [b.column(i).take(pa.array(of, pa.int64())) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([r[i] for r in cells], pa.string()) for i in range(len(columns)))], [*kinds.names, *columns])

    fields = StructType([*texts.select(*keep).schema, *(StructField(c, StringType()) for c in columns)])
    return texts.select(*keep, column).mapInArrow(parse, fields)


#: Lines of a file that are put in order together.
LINES = 1 << 14


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """file, place, cells of each record of files of comma-separated text, however long: place orders a file's records.

    A line begins inside quotes if an odd number of quotes comes before it. So
    the lines of a file are dealt to many tasks, a scan over parts of some lines
    gives each part the parity before it, and the lines of a record (quoted
    fields may hold line ends) meet by the line that the record begins with. No
    task holds more than a part, or a record.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    lines = lines.withColumn("part", F.floor(F.col("id") / LINES)).withColumn("odd", (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2)
    by, along = ["file", "block", "part"], Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    parity = lines.groupBy(*by).agg(F.sum("odd").alias("odd")).select(*by, F.coalesce(F.sum("odd").over(along), F.lit(0)).alias("odd"), F.lit(-1).cast("long").alias("id"))
    inner = Window.partitionBy(*by).orderBy("id")
    quotes = F.sum("odd").over(inner.rowsBetween(Window.unboundedPreceding, -1))
    started = lines.unionByName(parity, allowMissingColumns=True).withColumn("_first", quotes % 2 == 0).where("id >= 0")
    own = F.last(F.when(F.col("_first"), F.struct("block", "id")), ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0))
    started = started.withColumn("place", own)
    last = started.groupBy(*by).agg(F.max("place").alias("last")).select(*by, F.last("last", ignorenulls=True).over(along).alias("carried"))
    open_ = started.where("place is null").alias("s").join(last.alias("l"), by).select("s.file", "s.block", "s.id", "s.value", F.col("l.carried").alias("place"))
    joined = started.where("place is not null").select("file", "block", "id", "value", "place").unionByName(open_)
    whole = joined.groupBy("file", "place").agg(F.array_sort(F.collect_list(F.struct("block", "id", "value"))).alias("l"))
    texts = whole.select("file", "place", F.array_join(F.transform("l", lambda x: x["value"]), "\n").alias("text"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, n, r) for i, text in enumerate(b.column(2).to_pylist()) for n, r in enumerate(records(text.removesuffix("\r")))]
            at = pa.array([i for i, _, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([n for _, n, _ in found], pa.int32()), pa.array([r for _, _, r in found], pa.list_(pa.string()))], ["file", "place", "n", "cells"])

    # a line end of the old kind, a carriage return alone, parts records of one line
    cells = texts.mapInArrow(parse, "file string, place struct<block: long, id: long>, n int, cells array<string>")
    return cells.select("file", F.struct("place.block", "place.id", "n").alias("place"), "cells")


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """All-text columns of files with a header, of any length; missing cells are empty, surplus ones dropped.

    Quotes may open in the middle of a field, which Spark's reader takes
    literally; see csv_records(). Each file has its own header, a row for each
    file. Rows come in the order of the files, sorted by ranges.
    """
    found = csv_records(spark, path)
    heads = found.groupBy("file").agg(F.min(F.struct("place", "cells")).alias("h")).select("file", F.col("h.place").alias("first"), F.col("h.cells").alias("header"))
    rows = found.join(heads, "file").where(F.col("place") != F.col("first"))
    cell = lambda c: F.coalesce(F.get("cells", F.nullif(F.array_position("header", c), F.lit(0)).cast("int") - 1), F.lit(""))
    return rows.orderBy("file", "place").select(*[cell(F.lit(c)).alias(c) for c in columns])


def load_tables(spark: SparkSession, tables: dict[str, tuple[str, Sequence[str]]]) -> dict[str, DataFrame]:
    """All of the named tables (path, columns), or an error: each header is read and must name its columns before any is given."""
    found = {}
    for name, (path, columns) in tables.items():
        first = spark.read.text(path).limit(1).collect()  # one line
        header = (records(first[0].value) or [[]])[0] if first else []
        if missing := [c for c in columns if c not in header]:
            raise ValueError(f"table {name} lacks {', '.join(missing)}")
        found[name] = read_csv(spark, path, columns)
    return found


CALIBRATION = "name string, route_id string, points array<struct<frequency: double, db: double>>"


def calibrations(rows: DataFrame) -> DataFrame:
    """Profiles that can be used: named, with a route, at least two points, finite and of different frequencies."""
    good = lambda p: (p["frequency"] > 0) & (p["frequency"] < float("inf")) & (F.abs(p["db"]) < float("inf"))
    frequencies = F.transform("points", lambda p: p["frequency"])
    checked = rows.where((F.trim("name") != "") & (F.trim("route_id") != "") & (F.size("points") >= 2) & F.forall("points", good) & (F.size(F.array_distinct(frequencies)) == F.size("points")))
    return checked.withColumn("points", F.array_sort("points"))


#: A list of profiles as it is stored.
CALIBRATION_LIST = "array<struct<name: string, routeId: string, points: array<struct<frequency: double, correctionDb: double>>>>"


def calibration_list(texts: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """keep, name, route_id, points of the usable profiles in lists of them as JSON text; a text that is no such list has none."""
    profiles = texts.select(*keep, F.explode(F.from_json(column, CALIBRATION_LIST)).alias("p"))
    points = F.transform("p.points", lambda q: F.struct(q["frequency"].alias("frequency"), q["correctionDb"].alias("db")))
    return calibrations(profiles.select(*keep, F.col("p.name").alias("name"), F.col("p.routeId").alias("route_id"), points.alias("points")))


def json_number(x: Column) -> Column:
    """A finite number as JSON writers of browsers print it: shortest digits, no ".0", no exponent from 1e-6 up to 1e20."""
    plain = F.regexp_replace(F.when(F.abs(x) < 1, x.cast("decimal(38,24)").cast("string")).otherwise(x.cast("decimal(38,17)").cast("string")), r"\.?0+$", "")
    whole = F.when(F.abs(x) < 1e15, x.cast("long").cast("string"))
    power = F.regexp_replace(F.regexp_replace(F.regexp_replace(x.cast("string"), r"\.0E", "E"), "E-", "e-"), "E", "e+")
    return F.when(x == 0, "0").when((x == F.floor(x)) & (F.abs(x) < 1e15), whole).when((F.abs(x) >= 1e-6) & (F.abs(x) < 1e20), plain).otherwise(power)


def snapshot(points: Column) -> Column:
    """Short identity of a profile's usable points (frequency, db), in order of frequency."""
    good = F.filter(points, lambda p: (p["frequency"] > 0) & (p["frequency"] < float("inf")) & (F.abs(p["db"]) < float("inf")))
    one = lambda p: F.concat(F.lit('{"frequency":'), json_number(p["frequency"]), F.lit(',"correctionDb":'), json_number(p["db"]), F.lit("}"))
    text = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(good), one), ","), F.lit("]"))
    return F.when(F.size(points) > 0, F.concat(F.lit("fnv1a32-"), fnv1a32(text)))


def sanitized(df: DataFrame) -> DataFrame:
    """df without forbidden fields and binaries at any depth, non-finite numbers null. Only the schema is walked."""

    def clean(value: Column, kind) -> Column | None:
        if isinstance(kind, StructType):
            parts = [(f.name, clean(value.getField(f.name), f.dataType)) for f in kind if f.name.lower() not in FORBIDDEN]
            kept = [c.alias(n) for n, c in parts if c is not None]
            return F.when(value.isNotNull(), F.struct(*kept)) if kept else None
        if isinstance(kind, ArrayType):
            inner = clean(F.col("_"), kind.elementType)
            return None if inner is None else F.transform(value, lambda x: clean(x, kind.elementType))
        if isinstance(kind, BinaryType):
            return None
        return finite(value) if isinstance(kind, (DoubleType, FloatType)) else value

    parts = [(f.name, clean(F.col(f"`{f.name}`"), f.dataType)) for f in df.schema if f.name.lower() not in FORBIDDEN]
    return df.select(*[c.alias(n) for n, c in parts if c is not None])


def picked(df: DataFrame, names: Sequence[str], kind: str = "string") -> DataFrame:
    """The named columns; those that df lacks, or that are not scalar, are null."""
    flat = {f.name for f in df.schema if not isinstance(f.dataType, (StructType, ArrayType))}
    return df.select(*[F.col(f"`{n}`") if n in flat else F.lit(None).cast(kind).alias(n) for n in names])


def json_documents(df: DataFrame) -> DataFrame:
    """One sanitized JSON document for each row."""
    return sanitized(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document"))


# Settings of a track that may be kept, of which these are numbers.
SETTINGS = ["sampleRate", "sampleSize", "channelCount", "latency", "echoCancellation", "noiseSuppression", "autoGainControl", "suppressLocalAudioPlayback", "restrictOwnAudio"]


def audio_settings(settings: Column, kind: StructType) -> Column:
    """The allowed fields of a struct of settings that are numbers or booleans, non-finite numbers null; null for null."""
    named = {f.name: f.dataType for f in kind}
    kept = [n for n in SETTINGS if isinstance(named.get(n), (NumericType, BooleanType))]
    value = lambda n: finite(settings.getField(n)) if isinstance(named[n], (DoubleType, FloatType)) else settings.getField(n)
    return F.when(settings.isNotNull(), F.struct(*[value(n).alias(n) for n in kept])) if kept else F.lit(None)


def numbers(values: Column) -> Column:
    """The numbers of a text array as doubles, null for what is none; a missing array is empty."""
    return F.coalesce(F.transform(values, lambda v: numeric(v)), F.array().cast("array<double>"))


# Error names that may be kept, and what stands for each kind of failure.
ERROR_NAMES = ["NotAllowedError", "PermissionDeniedError", "SecurityError", "NotFoundError", "DevicesNotFoundError", "NotReadableError", "TrackStartError", "AbortError", "OverconstrainedError", "NotSupportedError", "TypeError", "Error"]
DENIED = r"(?i)not allowed|permission denied|permission dismissed|denied permission|access was denied|user agent or the platform|not permitted.*context"


def startup_failure(name: Column, message: Column, stage: Column, ios: Column, standalone: Column) -> Column:
    """struct(error_name, category, stage, permission_denied, ios_standalone_denial) of a failed start; the free text is not kept."""
    kept = F.when(name.isin(ERROR_NAMES), name).otherwise("Error")
    denied = F.coalesce(kept.isin(ERROR_NAMES[:3]) | message.rlike(DENIED), kept.isin(ERROR_NAMES[:3]))
    category = F.when(denied, "denied").when(kept.isin("NotFoundError", "DevicesNotFoundError"), "not found").when(kept.isin("NotReadableError", "TrackStartError"), "not readable").otherwise("failed")
    step = F.when(stage.isin("get-user-media", "audio-setup", "startup"), stage).otherwise("startup")
    special = F.coalesce(ios & standalone & (step == "get-user-media") & denied, F.lit(False))
    return F.struct(kept.alias("error_name"), category.alias("category"), step.alias("stage"), denied.alias("permission_denied"), special.alias("ios_standalone_denial"))


def app_url(url: Column) -> Column:
    """The folder of an HTTP(S) page without query and fragment; null for other schemes."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    return F.when(bare.rlike(r"^https?://[^/]+$"), F.concat(bare, F.lit("/"))).when(bare.rlike("^https?://"), F.regexp_extract(bare, "^(.*/)", 1))


def input_route(device_id: Column, label: Column) -> Column:
    return F.coalesce(F.when(device_id != "", device_id), F.when(label != "", label), F.lit("default-microphone"))


def iso_time(ts: Column) -> Column:
    """A timestamp in UTC as ISO 8601 with milliseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


# Names by which a user agent's products tell its family, the more special ones first.
PRODUCTS = {"Edg": "Edge", "EdgA": "Edge", "EdgiOS": "Edge", "Firefox": "Firefox", "FxiOS": "Firefox", "Chrome": "Chrome", "CriOS": "Chrome", "Version": "Safari"}


def browser_family(agent: Column) -> Column:
    """struct(family, version) of the first of PRODUCTS that a user agent names with a number; the agent itself is not kept."""
    named = F.transform(F.split(agent, r"[\s();,]+"), lambda word: F.split(word, "/"))
    number = lambda p: F.regexp_extract(F.get(p, F.lit(1)), r"^[0-9]+(\.[0-9]+)*", 0)
    known = F.filter(named, lambda p: (F.size(p) == 2) & (number(p) != ""))
    own = lambda name: F.get(F.filter(known, lambda p: p[0] == name), F.lit(0))
    found = [F.when(own(n).isNotNull(), F.struct(F.lit(f).alias("family"), number(own(n)).alias("version"))) for n, f in PRODUCTS.items()]
    return F.coalesce(*found, F.struct(F.lit("unknown").alias("family"), F.lit(None).cast("string").alias("version")))
