"""A table of kept results: upsert, retention, deletion, compaction, and export as lines of CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.scalars import sample_evenly

from .text import sanitized

RETAINED, POINTS = 100, 600


def result_id(timestamp: Column, source: Column) -> Column:
    return F.concat(F.lit("result-"), timestamp, F.lit("-"), F.coalesce(source, F.lit("unknown")))


def upserted(stored: DataFrame, new: DataFrame, key: str = "id", order: str = "timestamp", most: int = RETAINED) -> DataFrame:
    """stored with the rows of new put in place of those with their key, then the most latest rows by order.

    Of rows of new with one key the latest counts; ties in order go by key. One
    shuffle by key settles the upsert, a top-n without a full sort the retention.
    """
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(key).orderBy(F.desc("_new"), F.desc(order))
    kept = both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_new")
    return kept.orderBy(F.desc(order), F.desc(key)).limit(most)


def without(stored: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """stored less the rows whose key is in gone; a null key is none."""
    return stored.join(gone.select(key), key, "left_anti")


def compacted(results: DataFrame, arrays: Sequence[str] = ("temporal_beta", "color_timeline"), dropped: Sequence[str] = ("psd", "spectrogram", "third_octave", "input_route_id"), most: int = POINTS) -> DataFrame:
    """Sanitized results without their large parts, the arrays thinned evenly to most entries, and marked as compacted."""
    slim = sanitized(results.drop(*dropped))
    thin = {a: sample_evenly(F.col(a), most) for a in arrays if a in slim.columns}
    return slim.withColumns(thin | {"compacted": F.lit(True), "detail_arrays_stored": F.lit(False)})


def _quoted(value: Column) -> Column:
    """A value as JSON: text quoted, the rest as it is."""
    return F.regexp_replace(F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":(.*)\}$', "$1")


def csv_lines(results: DataFrame, key: str, metadata: dict[str, str], observations: str, observation_fields: Sequence[str], timeline: str, timeline_fields: Sequence[str], texts: Sequence[str] = ("classification", "label")) -> DataFrame:
    """key, section, place, line: a result as CSV of three parts, for one file each or one file in this order.

    The first has a line "# name,value" for each of metadata (name to column),
    the others a header and a line for each entry of the arrays of structs.
    """
    notes = F.array(*[F.struct(F.lit(i).alias("place"), F.concat(F.lit(f"# {name},"), F.coalesce(_quoted(F.col(c)), F.lit('""'))).alias("line")) for i, (name, c) in enumerate(metadata.items())])
    notes = F.transform(notes, lambda n: F.struct(n["place"], F.regexp_replace(n["line"], ",null$", ',""').alias("line")))

    def table(array: str, fields: Sequence[str]) -> Column:
        cell = lambda x, f: F.coalesce(_quoted(F.coalesce(x[f], F.lit(""))) if f in texts else x[f].cast("string"), F.lit(""))
        lines = F.transform(F.coalesce(F.col(array), F.slice(array, 1, 0)), lambda x, i: F.struct((i + 1).alias("place"), F.concat_ws(",", *[cell(x, f) for f in fields]).alias("line")))
        return F.concat(F.array(F.struct(F.lit(0).alias("place"), F.lit(",".join(fields)).alias("line"))), lines)

    parts = [("metadata", notes), ("observations", table(observations, observation_fields)), ("timeline", table(timeline, timeline_fields))]
    rows = [results.select(key, F.lit(n).alias("section"), F.explode(lines).alias("l")).select(key, "section", "l.place", "l.line") for n, lines in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
