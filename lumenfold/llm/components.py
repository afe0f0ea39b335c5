"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Ties each node's larger neighbours to the least of it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.join(least, "a").where("b > a").select(F.col("low").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Ties each node and its smaller neighbours to the least of these."""
    least = edges.groupBy("b").agg(F.min("a").alias("low"))
    up = edges.join(least, "b").where("a > low").select(F.col("low").alias("a"), F.col("a").alias("b"))
    return up.unionByName(least.select(F.col("low").alias("a"), "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """doc_id, root (the smallest doc_id reachable) of every document in links (a, b).

    Each turn is written to the shared folder; the edges end as stars around the
    roots, after a number of turns that grows with the logarithm of the longest
    path. Minima are combined before the exchange, so a node with very many
    links stays one row for each task.
    """
    edges = links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    before = None
    while True:
        turned = settle(_small_star(_large_star(edges)), "edges")
        if before is not None:
            discard(edges)
        edges = turned
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.select(F.col("a").alias("doc_id"), F.col("a").alias("root")).distinct()
            return edges.select(F.col("b").alias("doc_id"), F.col("a").alias("root")).unionByName(roots)
        before = now
