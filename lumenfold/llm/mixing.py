"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words: its weight's share of all words, at
most three times what it has, the excess shared again. Within a source longer
documents are wanted more: a document's expected copies rise with the root of
its size over the source's mean, in steps of a factor of two, up to three. A
document is taken as often as its expected copies' whole part says; for what is
left, documents are ranked by their random odds over their inclusion odds and
the first are taken, up to the fixed number of words.

A source is never sorted whole: ranks fall into about sqrt(n) bins of it, sums
of bins find the bin in which the target is reached, and only that bin's
documents are ranked one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

MOST_COPIES = 3
#: Rows of the source table up to which it is broadcast.
BROADCAST_SOURCES = 100_000


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, n, source_size, target from documents' source and size.

    Water filling: in the order of cap over weight, the first source whose share
    of what the sources before it leave lies within its cap sets the level for
    all from there on. There is a row for each source, so one task holds them.
    """
    by_source = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighted = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("double"))
    cap = (MOST_COPIES * F.col("source_size")).cast("double")
    order = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = weighted.withColumn("level", level).withColumn("place", F.row_number().over(order))
    fits = F.when(F.col("level") <= cap / F.col("weight"), F.struct("place", "level"))
    water = F.coalesce(F.min(fits).over(everything).getField("level"), F.lit(float("inf")))
    return leveled.select("source", "n", "source_size", F.least(cap, water * F.col("weight")).alias("target"))


#: A document's class: powers of two of its size over its source's mean, kept between these.
LEAST_CLASS, MOST_CLASS = -4, 4


def size_class(size: Column, n: Column, source_size: Column) -> Column:
    """The power of two at or below size over the mean, by whole numbers; LEAST_CLASS for an empty document."""
    scaled = size * n * (1 << -LEAST_CLASS)
    over = [F.when(scaled >= source_size * (1 << (k - LEAST_CLASS)), 1).otherwise(0) for k in range(LEAST_CLASS + 1, MOST_CLASS + 1)]
    return F.when(size > 0, sum(over, F.lit(LEAST_CLASS))).otherwise(LEAST_CLASS)


def expected_copies(classes: DataFrame) -> DataFrame:
    """source, class, copies, share from each source's classes (source, class, words, target).

    Copies are the level times the root of the class's factor, at most
    MOST_COPIES, at the level that makes the words the target: classes reach
    the cap from the top, and the first class that doesn't sets the level.
    """
    wanted = F.pow(F.lit(2.0), F.col("class") / 2.0)
    order = Window.partitionBy("source").orderBy(F.desc("class"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("target") - MOST_COPIES * F.coalesce(F.sum("words").over(before), F.lit(0))
    level = left / F.nullif(F.sum(wanted * F.col("words")).over(rest), F.lit(0.0))
    leveled = classes.withColumn("level", level).withColumn("place", F.row_number().over(order))
    fits = F.when(F.col("level") * wanted <= MOST_COPIES, F.struct("place", "level"))
    found = F.coalesce(F.min(fits).over(Window.partitionBy("source")).getField("level"), F.lit(float("inf")))
    times = F.when(F.col("target") > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(MOST_COPIES)), found * wanted))).otherwise(0.0)
    copies = F.floor(times)
    share = F.when(copies < MOST_COPIES, times - copies).otherwise(0.0)
    return leveled.withColumn("times", times).select("source", "class", "words", copies.alias("copies"), share.alias("share"))


def _first(ranked: DataFrame, goal: str, carried: tuple[str, ...]) -> DataFrame:
    """ranked (source, bin, rank, doc_id, size, goal, carried columns) with taken_once.

    In the order of rank, a document is taken if half of it still fits before
    goal, which brings the sum as near goal as a document allows.
    """
    sums = ranked.groupBy("source", "bin", goal).agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = sums.select("source", "bin", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("earlier"), "words")
    ranked = ranked.alias("r").join(bins.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.bin") == F.col("b.bin")))
    ranked = ranked.select("r.*", "b.earlier", (F.col("b.earlier") + F.col("b.words")).alias("later"))
    inner = Window.partitionBy("source", "bin").orderBy("rank", "doc_id", "size", *carried).rowsBetween(Window.unboundedPreceding, -1)
    cut = (F.col("earlier") < F.col(goal)) & (F.col("later") > F.col(goal))
    within = ranked.where(cut).withColumn("at", F.col("earlier") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    within = within.withColumn("taken_once", (F.col("at") + F.col("size") / 2 <= F.col(goal)).cast("int")).drop("at")
    whole = ranked.where(~cut).withColumn("taken_once", (F.col("later") <= F.col(goal)).cast("int"))
    return whole.unionByName(within).drop("earlier", "later")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 20, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies for each row of docs (doc_id, text, source, ...).

    size counts runs of anything but ASCII white space; null or empty text has
    size 0 and is taken with 0 words. A null source is a source of its own. The
    random odds come from doc_id and seed alone, so reruns agree; rows that
    repeat a doc_id share its odds, and null doc_ids count as one. A source's
    taken words miss its target by half of a short document at most, or by half
    of a long one where its short ones don't suffice. Expected copies depend on
    the document's size class and source alone, and a document's inclusion beyond
    its whole copies has that share as its probability, as near as Pareto's order
    gives it. Columns named in carried come last, as they are in their row. Empty in, empty out.
    """
    sizes = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words().alias("size"), *carried), "sizes")
    targets = settle(source_targets(sizes, weights), "targets")
    small = targets.count() <= BROADCAST_SOURCES
    t = (F.broadcast(targets) if small else targets).alias("t")
    joined = sizes.alias("d").join(t, F.col("d.source").eqNullSafe(F.col("t.source")), "left").select("d.*", "t.n", "t.source_size", "t.target")
    classed = joined.withColumn("class", size_class(F.col("size"), F.col("n"), F.col("source_size")))
    # a row for each class of a source
    classes = classed.groupBy("source", "class").agg(F.sum("size").alias("words"), F.first("target").alias("target"))
    expected = settle(expected_copies(classes), "expected")
    e = (F.broadcast(expected) if small else expected).alias("e")
    joined = classed.alias("d").join(e, F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d.class") == F.col("e.class"))).select("d.*", "e.copies", "e.share")
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    odds = (u / (1 - u)) / (F.col("share") / (1 - F.col("share")))
    rank = F.when(F.col("share") > 0, odds / (1 + odds)).otherwise(1.0)
    long_ = F.col("class") >= 0
    n_bins = F.ceil(F.sqrt("n"))
    ranked = joined.withColumn("rank", rank).withColumn("long", long_).withColumn("bin", F.least(F.floor(F.col("rank") * n_bins), n_bins - 1))
    ranked = settle(ranked, "ranked")
    # what the ranks should bring: sums over a source's classes in their order, so that reruns agree to the last bit
    parts = F.array_sort(F.collect_list(F.struct("class", (F.col("share") * F.col("words")).alias("w"))))
    wanted = lambda p: F.aggregate(p, F.lit(0.0), lambda a, x: a + x["w"])
    goals = expected.groupBy("source").agg(parts.alias("p")).select("source", wanted(F.filter("p", lambda x: x["class"] >= 0)).alias("long_goal"), wanted(F.col("p")).alias("goal"))
    goals = (F.broadcast(goals) if small else goals).alias("s")
    longs = ranked.where("long").alias("r").join(goals, F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.*", F.col("s.long_goal").alias("goal"))
    longs = settle(_first(longs, "goal", carried).drop("goal"), "longs")
    so_far = longs.where("share > 0").groupBy("source").agg(F.sum(F.col("size") * F.col("taken_once")).alias("words"))
    left = goals.join(so_far.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")), "left").select("s.source", (F.col("s.goal") - F.coalesce("t.words", F.lit(0))).alias("goal"))
    left = (F.broadcast(left) if small else left).alias("s")
    shorts = ranked.where("not long").alias("r").join(left, F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.*", "s.goal")
    shorts = _first(shorts, "goal", carried).drop("goal")
    # a class that has its whole copies takes no more, whatever its source lacks
    copies = F.col("copies") + F.when(F.col("share") > 0, F.col("taken_once")).otherwise(0)
    return longs.unionByName(shorts).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.cast("int").alias("copies"), *carried,
    )
