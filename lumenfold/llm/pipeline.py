"""The stages of the corpus pipeline.

Each takes (spark, docs, sf_dir); all but the last return the columns of docs.
An empty table stays empty. Rows without doc_id and rows that repeat one are
rows of their own in every stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, numbered, passing, scratch, settle, table
from .decontamination import clean
from .language_id import UNKNOWN, fit, held_out, predict
from .mixing import mix
from .near_duplicates import near_duplicates
from .token_files import read_tokens, write_tokens


def marks(docs: DataFrame) -> list[Column]:
    """m1 and m2, two hashes of a row with all its columns: 128 bits that equal rows share; a null is no other value."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return [F.xxhash64(F.lit(k), *columns, *(c.isNull() for c in columns)).alias(f"m{k}") for k in (1, 2)]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (null texts, texts without a letter); names the language of those that have no lang.

    The prototypes come from the documents that are not held out. Where nothing
    could be learned (no labelled text), nothing can be rejected or named.
    """
    model = fit(docs.where(~held_out()))
    if not model[0]:
        return docs
    whole = docs.select(F.struct("*").alias("row"))
    named = predict(whole, model, ["row"]).where(F.col("lang_pred") != UNKNOWN)
    return named.select("row.*", "lang_pred").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays, the one with the smallest doc_id; one without doc_id only if all are.

    Every row is compared, also those that share a doc_id or have none. Among
    equal doc_ids a hash of the row decides, so that reruns agree. Equal rows
    are told from others by their marks, so that docs itself is read again at
    the end; of equal rows of which one stays, that one is set apart before.
    What goes grows with docs, so it is joined by sorting at every size.
    """
    with passing(spark):
        rows = settle(docs.select(F.monotonically_increasing_id().alias("row"), *marks(docs), F.struct("*").alias("d")), "rows")
        found = near_duplicates(rows.select(F.col("row").alias("doc_id"), "d.text")).select(F.col("doc_id").alias("row"), "component_id")
        found = settle(found, "found")
        several = found.groupBy("component_id").agg(F.count("*").alias("size")).where("size > 1").select("component_id")
        ranked = rows.select("row", "d.doc_id", "m1", "m2").join(found.join(several, "component_id"), "row")
        order = ["component_id", F.col("doc_id").isNull().alias("none"), "doc_id", "m1", "m2"]
        kinds = settle(ranked.groupBy(*order).agg(F.min("row").alias("row"), F.count("*").alias("n")), "kinds")
        first = kinds.groupBy("component_id").agg(F.min(F.struct("none", "doc_id", "m1", "m2", "row", "n")).alias("first")).select("first.*")
        first = settle(first, "first")
        repeated = first.where("n > 1")
        once = settle(rows.join(repeated.select("row"), "row", "left_semi").select("d.*"), "once")
        gone = kinds.select("m1", "m2").join(first, ["m1", "m2"], "left_anti").unionByName(repeated.select("m1", "m2"))
        gone, once = kept(settle(gone, "gone")), kept(once)
    marked = docs.select(*marks(docs), F.struct("*").alias("d"))
    return marked.join(gone.hint("merge"), ["m1", "m2"], "left_anti").select("d.*").unionByName(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs; null texts have none and stay."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; its odds come from a hash of the row, also without doc_id.

    Equal rows have equal odds; null and empty texts have no words to take. A
    null source is one of its own.
    """
    rows = numbered(docs, "rows")
    with passing(spark):
        copies = mix(rows.select(marks(docs)[0].alias("doc_id"), "source", "text", "row"), carried=("row",)).where("copies > 0").select("row", "copies")
        copies = kept(settle(copies, "copies"))
    taken = rows.join(copies.hint("merge"), "row").select(F.struct(*docs.columns).alias("d"), "copies")
    return taken.select(F.explode(F.array_repeat("d", F.col("copies"))).alias("row")).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, read back: doc_id, start, n_tokens, ids_crc32. Each copy is a document; a null text has the end id alone."""
    path = scratch(spark, "corpus")
    write_tokens(docs, path)
    return read_tokens(spark, path)
