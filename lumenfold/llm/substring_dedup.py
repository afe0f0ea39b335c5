"""Substring dedup by level-wise doubling, in words.

Windows are taken in runs around their least short gram (repeats.py). The first
level's length is that gram's: runs whose gram occurs once can't repeat and are
dropped. At each level runs with equal texts are one, the first of them going
on; a run that then is alone with its core is settled: it is the first
occurrence of all its windows. The others are extended: cut into runs whose
cores are twice as long, and compared again, until no candidates survive, at the
latest when the core is the whole window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, identified, map_arrow, settle
from .grams import _A, _B, gram_hashes, slices, split_words
from .repeats import cut_runs, per_document, removed, repeated_keys, repeated_runs, representatives, run_rows, wanted_runs, whole_copies


def _reader(gram: int):
    def read(data: np.ndarray, bounds: np.ndarray):
        w = split_words(data, bounds)
        one = w.hashes()

        def hasher(lo: np.ndarray, hi: np.ndarray):
            return _A.spans(_A.prefix(one), lo, hi), _B.spans(_B.prefix(w.hashes(second=True)), lo, hi)

        return gram_hashes(one, gram), w.first, hasher

    return read


def first_windows(docs: DataFrame, runs: DataFrame, read, window: int, length: int) -> DataFrame:
    """doc_id, at, n: the n windows from at on that are the first of their text, from runs with cores of length words."""
    settled = []
    while True:
        first = F.min(F.struct("doc_id", "lo", "n", "anchor", "twice", "key"))
        texts = settle(runs.groupBy("c1", "c2").agg(first.alias("f")).select("f.*"), f"texts-{length}")
        cores = texts.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1").select("key", F.lit(True).alias("again"))
        texts = settle(texts.join(cores, "key", "left"), f"cores-{length}")
        settled.append(texts.where("again is null").select("doc_id", F.col("lo").alias("at"), "n"))
        texts = texts.where("again")
        if length == window or texts.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        length = min(2 * length, window)
        runs = cut_runs(docs, wanted_runs(texts), read, window, length)


def repeated_spans(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, text and what removal needs: known, at, n, whole. One row for each row of docs that has a doc_id."""
    docs = identified(docs)
    gram = max(1, window // 4)
    read = _reader(gram)
    known = settle(repeated_keys(representatives(docs, read, window, gram)), "known")
    later = settle(whole_copies(docs).where("doc_id > first").select("doc_id").distinct(), "later")
    fresh = known.join(later, "doc_id", "left_anti")
    runs = run_rows(docs.join(fresh.hint("shuffle_hash"), "doc_id"), read, window, gram)
    firsts = first_windows(docs, runs, read, window, gram).groupBy("doc_id").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))
    info = fresh.join(firsts, "doc_id", "left").withColumn("whole", F.lit(False))
    info = info.unionByName(later.withColumn("whole", F.lit(True)), allowMissingColumns=True)
    return docs.join(info.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "known", "at", "n", "whole")


def substring_dedup(docs: DataFrame, window: int = 20, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs (doc_id, text, ...); kept text, if wanted.

    A word is removed if it lies in a window of `window` consecutive words that
    also starts earlier: in a smaller doc_id, or before it in its own document.
    Windows are judged on the input. Words are runs of anything but ASCII white
    space. Null text has no words and keeps nothing (the hash of no bytes); rows
    without doc_id have no place in the order and are left out; rows that repeat
    a doc_id with its text are one document and each return its result. Other
    columns are not read; an empty table gives an empty result.
    """
    gram = max(1, window // 4)
    read = _reader(gram)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, data, bounds in slices(b.column(1)):
                runs, first, _ = repeated_runs(data, bounds, b.column(2).slice(a, z - a), read, window, gram)
                words = split_words(data, bounds)
                n = np.diff(first)
                at, count = (per_document(b.column(c), a, z, x) for c, x in ((3, first), (4, np.zeros(z - a + 1, np.int64))))
                gone = removed(len(words.start), runs, at, count, window)
                whole = b.column(5).slice(a, z - a).fill_null(False).to_numpy(zero_copy_only=False) & (n >= window)
                gone |= np.repeat(whole, n)
                n_removed = np.add.reduceat(np.append(gone, False).astype(np.int64), first[:-1]) * (n > 0)
                hashes, texts, raw = [], [], data.tobytes()
                for d in range(z - a):
                    if n_removed[d]:
                        kept = np.flatnonzero(~gone[first[d] : first[d + 1]]) + first[d]
                        text = b" ".join([raw[x:y] for x, y in zip(words.start[kept].tolist(), words.end[kept].tolist())])
                    else:
                        text = b" ".join(raw[bounds[d] : bounds[d + 1]].split())
                    hashes.append(hashlib.sha256(text).hexdigest())
                    if with_text:
                        texts.append(text.decode())
                out = dict(doc_id=b.column(0).slice(a, z - a), n_words=pa.array(n, pa.int64()), n_removed=pa.array(n_removed, pa.int64()), kept_sha256=pa.array(hashes, pa.string()))
                yield batch(**out, **({"kept_text": pa.array(texts, pa.string())} if with_text else {}))

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return map_arrow(repeated_spans(docs, window), remove, schema)
