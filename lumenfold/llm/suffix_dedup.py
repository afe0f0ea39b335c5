"""Suffix-array dedup, in bytes.

Every run of windows that may repeat (repeats.py) goes through a suffix array.
Runs with one representative stand together in a block of bounded size, runs
with equal texts as one that weighs two; the block's suffixes are sorted by the
two-stage sort (suffixes.py), and a window repeats if a suffix beside it has a
common prefix of the window's length, or its text weighs two. The windows that
turn out to be alone are what documents keep.

A run's text has 2 * window - gram bytes at most, so BLOCK_RUNS bounds a block.
A representative with more differing runs is cut into runs with longer cores
until each core has few enough; at the longest core all texts are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, identified, map_arrow, settle
from .grams import _A, _B, slices
from .repeats import cut_runs, per_document, removed, repeated_keys, repeated_runs, representatives, run_rows, stretches, wanted_runs, whole_copies
from .suffixes import common_prefixes, suffix_order

GRAM = 64
BLOCK_BYTES = 1 << 20
#: Differing runs of one representative that are sorted together at most.
BLOCK_RUNS = 4096


def _reader(gram: int):
    def read(data: np.ndarray, bounds: np.ndarray):
        values = _A.table[data]
        prefix = _A.prefix(values)
        at = np.arange(len(data))
        grams = _A.spans(prefix, at, np.minimum(at + gram, len(data)))

        def hasher(lo: np.ndarray, hi: np.ndarray):
            return _A.spans(prefix, lo, hi), _B.spans(_B.prefix(_B.table[data]), lo, hi)

        return grams, bounds, hasher

    return read


def lone_windows(data: np.ndarray, lengths: np.ndarray, twice: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts (laid end to end in data), places and lengths of the stretches of windows that occur once in all; texts that occur twice count so."""
    sizes = lengths + 1
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.ones(sizes.sum(), bool)
    inside[first + lengths] = False
    symbols = np.zeros(len(inside), np.int16)
    symbols[inside] = data.astype(np.int16) + 1
    order = suffix_order(symbols, window)
    at = order[(first + lengths)[owner[order]] - order >= window]
    shared = common_prefixes(symbols, at, window, exact=False)
    begins = np.flatnonzero(np.append(True, shared[1:] < window)) if len(at) else at
    weight = np.add.reduceat(1 + twice[owner[at]].astype(np.int64), begins) if len(at) else at
    lone = np.zeros(len(symbols), bool)
    lone[at[begins[weight == 1]]] = True
    begin, end = stretches(lone)
    return owner[begin], begin - first[owner[begin]], end - begin


def _texts(runs: DataFrame, name: str) -> DataFrame:
    """The first of the runs (RUN) of each text, and whether the text occurs elsewhere too."""
    place = F.struct("doc_id", "lo", "n", "anchor", "key")
    found = runs.groupBy("c1", "c2").agg(F.min(place).alias("f"), F.max(F.struct("doc_id", "lo")).alias("l"), F.max("twice").alias("twice"))
    elsewhere = (F.col("l.doc_id") != F.col("f.doc_id")) | (F.col("l.lo") != F.col("f.lo"))
    return settle(found.select("f.*", (F.col("twice") | elsewhere).alias("twice")), name)


def bounded_texts(docs: DataFrame, runs: DataFrame, read, window: int, gram: int, block_runs: int) -> DataFrame:
    """The texts of the runs, at most block_runs with one key: larger keys' runs are cut until that holds."""
    parts, span = [], window - gram + 1
    while True:
        texts = _texts(runs, "texts")
        large = texts.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block_runs).select("key", F.lit(True).alias("large"))
        large = settle(large, "large")
        if span == 1 or large.isEmpty():
            return reduce(DataFrame.unionByName, [*parts, texts])
        marked = settle(texts.join(large, "key", "left"), "marked")
        parts.append(marked.where("large is null").drop("large"))
        span = -(-span // 8)
        runs = cut_runs(docs, wanted_runs(marked.where("large")), read, window, window - span + 1)


_PIECE = {"key": pa.int64(), "doc_id": pa.int64(), "lo": pa.int32(), "twice": pa.bool_(), "text": pa.binary()}


def lone_spans(docs: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """doc_id, at, n: the n windows from at on that occur nowhere else, of the texts' runs."""
    wanted = texts.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "n", "key", "twice")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for doc_id, text, wanted in zip(*b.columns):
                doc_id, raw = doc_id.as_py(), text.as_py().encode()
                for w in wanted.as_py():
                    rows.append((w["key"], doc_id, w["lo"], w["twice"], raw[w["lo"] : w["lo"] + w["n"] + window - 1]))
                    size += len(rows[-1][-1])
                if size >= BLOCK_BYTES:
                    yield batch(**{n: pa.array(x, _PIECE[n]) for n, x in zip(_PIECE, zip(*rows))})
                    rows, size = [], 0
            if rows:
                yield batch(**{n: pa.array(x, _PIECE[n]) for n, x in zip(_PIECE, zip(*rows))})

    pieces = map_arrow(docs.select("doc_id", "text").join(wanted.hint("shuffle_hash"), "doc_id"), cut, "key long, doc_id long, lo int, twice boolean, text binary")
    pieces = pieces.repartition("key").sortWithinPartitions("key")

    def settled(rows: pa.Table) -> pa.RecordBatch:
        doc_id, lo, twice = (rows.column(c).to_numpy() for c in ("doc_id", "lo", "twice"))
        # rows that repeat a document give its runs again
        order = np.lexsort((lo, doc_id))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(doc_id[order]) != 0) | (np.diff(lo[order]) != 0)
        kept = np.sort(order[new])
        text = pc.cast(rows.column("text"), pa.large_binary()).combine_chunks().take(pa.array(kept))
        bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        of, at, n = lone_windows(data, np.diff(bounds), twice[kept], window)
        return batch(doc_id=pa.array(doc_id[kept][of], pa.int64()), at=pa.array(lo[kept][of] + at, pa.int32()), n=pa.array(n, pa.int32()))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of whole keys, of about BLOCK_BYTES where keys allow."""
        waiting, size = [], 0
        for b in batches:
            waiting.append(b)
            size += b.nbytes
            if size < BLOCK_BYTES:
                continue
            rows = pa.Table.from_batches(waiting)
            key = rows.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield from (settled(rows.slice(x, z - x)) for x, z in zip(*_blocks(key[:last], rows.column("text").slice(0, last))))
                rows = rows.slice(last)
            waiting = rows.combine_chunks().to_batches()
            size = sum(x.nbytes for x in waiting) if last else 0
        if waiting:
            rows = pa.Table.from_batches(waiting)
            yield from (settled(rows.slice(x, z - x)) for x, z in zip(*_blocks(rows.column("key").to_numpy(), rows.column("text"))))

    return map_arrow(pieces, sort, "doc_id long, at int, n int")


def _blocks(key: np.ndarray, text: pa.ChunkedArray) -> tuple[list[int], list[int]]:
    """Cuts sorted keys into blocks of whole keys of about BLOCK_BYTES."""
    begins = np.flatnonzero(np.append(True, np.diff(key) != 0))
    sizes = np.add.reduceat(pc.binary_length(text).to_numpy().astype(np.int64), begins)
    block = (np.cumsum(sizes) - sizes) // BLOCK_BYTES
    at = begins[np.append(True, np.diff(block) != 0)].tolist()
    return at, [*at[1:], len(key)]


def suffix_dedup(docs: DataFrame, window: int = 400, gram: int | None = None, with_text: bool = False, block_runs: int = BLOCK_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs (doc_id, text, ...); kept bytes, if wanted.

    A byte of a document's UTF-8 is removed if it lies in a string of `window`
    bytes that also starts anywhere else, in its document or another. Strings
    are judged on the input, overlaps count, matches stay within documents. Null
    text is empty; of documents with equal texts the first and the last stand
    for those between; rows without doc_id are left out; rows that repeat a doc_id
    with its text are one document and each return its result. Other columns
    are not read; an empty table gives an empty result.
    """
    gram = gram or min(GRAM, max(1, window // 2))
    read = _reader(gram)
    docs = identified(docs)
    known = settle(repeated_keys(settle(representatives(docs, read, window, gram), "representatives")), "known")
    copies = whole_copies(docs).groupBy("doc_id").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    between = settle(copies.where("first < doc_id and doc_id < last").select("doc_id"), "between")
    fresh = known.join(between, "doc_id", "left_anti")
    runs = run_rows(docs.join(fresh.hint("shuffle_hash"), "doc_id"), read, window, gram)
    texts = bounded_texts(docs, runs, read, window, gram, block_runs)
    lone = settle(lone_spans(docs, texts, window), "lone")
    inner = lone.groupBy("doc_id").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))
    info = fresh.join(inner, "doc_id", "left").withColumn("whole", F.lit(False)).unionByName(between.withColumn("whole", F.lit(True)), allowMissingColumns=True)
    every = docs.join(info.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "known", "at", "n", "whole")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, data, bounds in slices(b.column(1)):
                runs, first, _ = repeated_runs(data, bounds, b.column(2).slice(a, z - a), read, window, gram)
                at, n = (per_document(b.column(c), a, z, x) for c, x in ((3, first), (4, np.zeros(z - a + 1, np.int64))))
                gone = removed(len(data), runs, at, n, window)
                lengths = np.diff(bounds)
                gone |= np.repeat(b.column(5).slice(a, z - a).fill_null(False).to_numpy(zero_copy_only=False) & (lengths >= window), lengths)
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                edges = bounds[:-1][lengths > 0]
                begins[edges] = gone[edges]
                count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])
                n_removed, spans, kept = count(gone), count(begins), ~gone
                rest = [data[s:e][kept[s:e]].tobytes() if r else data[s:e].tobytes() for s, e, r in zip(bounds[:-1], bounds[1:], n_removed)]
                out = dict(
                    doc_id=b.column(0).slice(a, z - a), n_bytes=pa.array(lengths, pa.int64()), n_removed=pa.array(n_removed, pa.int64()), n_spans=pa.array(spans, pa.int64()),
                    kept_sha256=pa.array([hashlib.sha256(x).hexdigest() for x in rest], pa.string()),
                )
                yield batch(**out, **({"kept": pa.array(rest, pa.binary())} if with_text else {}))

    return map_arrow(every, remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
