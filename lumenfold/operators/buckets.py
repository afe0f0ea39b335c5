"""Work along time for keys of any size.

Rows fall into buckets of time. What has to pass from one bucket to the next is
carried by a scan over the buckets' edges, a row for each bucket, and put into
the bucket as a row of its own; so a key's rows spread over as many tasks as it
has buckets, and no window holds more than one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket, on average over all keys.
BUCKET_ROWS = 4096


def width(rows: DataFrame, time: str, per_bucket: int = BUCKET_ROWS) -> float:
    """The length of buckets that hold per_bucket rows on average; one aggregation of the times. 1 if all are equal."""
    found = rows.agg(F.count(time).alias("n"), F.min(time).alias("low"), F.max(time).alias("high")).first()
    if not found.n or not found.high > found.low:
        return 1.0
    return float(found.high - found.low) / -(-found.n // per_bucket)


def bucket(time: Column, length: float) -> Column:
    return F.floor(time / F.lit(float(length)))


def beside(rows: DataFrame, keys: Sequence[str], time: str, length: float, order: Sequence[str]) -> DataFrame:
    """rows with _b, their bucket, and _before and _after, the order's columns of the rows before and after; null at a key's ends.

    order begins with time, and its columns can be compared. Rows are shuffled once.
    """
    keys, item = list(keys), F.struct(*order)
    placed = rows.select("*", bucket(F.col(time), length).alias("_b"))
    edges = placed.groupBy(*keys, "_b").agg(F.min(item).alias("_first"), F.max(item).alias("_last"))
    along = Window.partitionBy(*keys).orderBy("_b")
    halos = edges.select(*keys, "_b", F.array_compact(F.array(F.lag("_last").over(along), F.lead("_first").over(along))).alias("_h")).select(*keys, "_b", F.explode("_h").alias("_item"))
    both = placed.select(*keys, "_b", item.alias("_item"), F.struct(*[c for c in rows.columns if c not in keys]).alias("_row")).unionByName(halos, allowMissingColumns=True)
    inner = Window.partitionBy(*keys, "_b").orderBy("_item")
    near = both.withColumns({"_before": F.lag("_item").over(inner), "_after": F.lead("_item").over(inner)}).where("_row is not null")
    return near.select(*keys, "_row.*", "_b", "_before", "_after")


def placed(rows: DataFrame, keys: Sequence[str], time: str, length: float, order: Sequence[str], name: str = "n") -> DataFrame:
    """rows with their place in order within their key, from 0."""
    keys, item = list(keys), F.struct(*order)
    marked = rows.select("*", bucket(F.col(time), length).alias("_b"))
    counts = marked.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    earlier = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*keys, "_b", F.coalesce(earlier, F.lit(0)).alias("_offset"))
    both = marked.select(*keys, "_b", item.alias("_item"), F.struct(*[c for c in rows.columns if c not in keys]).alias("_row")).unionByName(offsets, allowMissingColumns=True)
    inner = Window.partitionBy(*keys, "_b").orderBy(F.col("_item").asc_nulls_first())
    found = both.withColumn("_place", F.row_number().over(inner) - 2 + F.first("_offset").over(inner)).where("_row is not null")
    return found.select(*keys, "_row.*", F.col("_place").alias(name))


def placed_within(rows: DataFrame, time: str, length: float, order: Sequence[str], spans: Sequence[tuple[int, int]], name: str = "n") -> DataFrame:
    """Of placed() without keys the rows at places from up to before each of a few spans.

    All rows are counted by bucket; only the buckets that spans meet are sorted,
    and no other row is shuffled.
    """
    marked = rows.select("*", bucket(F.col(time), length).alias("_b"))
    counts = marked.groupBy("_b").agg(F.count("*").alias("_c"))
    earlier = F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_b", "_c", F.coalesce(earlier, F.lit(0)).alias("_offset"))
    wanted = F.array(*[F.struct(F.lit(int(a)).alias("a"), F.lit(int(b)).alias("b")) for a, b in spans])
    met = offsets.where(F.exists(wanted, lambda s: (F.col("_offset") < s["b"]) & (F.col("_offset") + F.col("_c") > s["a"]))).select(F.col("_b").alias("_bucket"), "_offset")
    own = marked.join(F.broadcast(met), F.col("_b").eqNullSafe(F.col("_bucket"))).withColumn("_item", F.struct(*order))
    found = own.withColumn(name, F.col("_offset") + F.row_number().over(Window.partitionBy("_b").orderBy(F.col("_item").asc_nulls_first())) - 1)
    return found.where(F.exists(wanted, lambda s: F.col(name).between(s["a"], s["b"] - 1))).select(*rows.columns, name)


def runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], state: str, new: Column, begins: str, ends: str) -> DataFrame:
    """Rows in buckets (_b) as one segment for each run: from a row for which new holds up to the next such.

    Each bucket makes its own segments; one that goes on from an earlier bucket
    gets the start of the run it belongs to from a scan over buckets.
    """
    keys = list(keys)
    inner = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    started = rows.withColumn("_start", F.last(F.when(new, F.struct(*order)), ignorenulls=True).over(inner))
    spans = [F.min(begins).alias("begins"), F.max(ends).alias("ends")]
    own = started.groupBy(*keys, "_b", "_start", F.col(state).alias("_s")).agg(*spans, F.count("*").alias("rows"))
    parts = F.struct("_s", "begins", "ends", "rows")
    edges = own.groupBy(*keys, "_b").agg(F.max("_start").alias("_last"), F.max(F.when(F.col("_start").isNull(), parts)).alias("_open"))
    back = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.withColumn("_start", F.last("_last", ignorenulls=True).over(back)).where("_open is not null").select(*keys, "_start", "_open.*")
    whole = own.where("_start is not null").drop("_b").unionByName(carried)
    return whole.groupBy(*keys, "_start", "_s").agg(F.min("begins").alias("begins"), F.max("ends").alias("ends"), F.sum("rows").alias("rows")).select(*keys, F.col("_s").alias(state), "begins", "ends", "rows")


def latest(rows: DataFrame, keys: Sequence[str], time: str, length: float, order: Sequence[str], marks: Column) -> DataFrame:
    """rows with _since, the order's columns of the last row up to this one, in order of its key, for which marks holds; null before the first."""
    keys, item = list(keys), F.struct(*order)
    placed = rows.select("*", bucket(F.col(time), length).alias("_b"), marks.alias("_mark"))
    ends = placed.groupBy(*keys, "_b").agg(F.max(F.when(F.col("_mark"), item)).alias("_item"))
    back = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    halos = ends.select(*keys, "_b", F.last("_item", ignorenulls=True).over(back).alias("_item")).where("_item is not null").withColumn("_mark", F.lit(True))
    own = placed.select(*keys, "_b", item.alias("_item"), "_mark", F.struct(*[c for c in rows.columns if c not in keys]).alias("_row"))
    inner = Window.partitionBy(*keys, "_b").orderBy("_item").rowsBetween(Window.unboundedPreceding, 0)
    found = own.unionByName(halos, allowMissingColumns=True).withColumn("_since", F.last(F.when(F.col("_mark"), F.col("_item")), ignorenulls=True).over(inner))
    return found.where("_row is not null").select(*keys, "_row.*", "_since")
