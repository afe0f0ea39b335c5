"""Benchmark decontamination by winnowing.

Of every window of consecutive words, in documents and benchmark items alike,
the least hash of its short word grams is the fingerprint. Equal windows have
equal fingerprints, so the fingerprints of both sides are joined, and only
document windows whose fingerprint is among the benchmark's are extended: joined
with the benchmark's windows by 128 bits of hash. Every shared span of at least
a window is found.

A bit field of fixed size, set from the benchmark's fingerprints, spares
documents the rows of most fingerprints that can't meet any. A large benchmark
fills it, which costs rows but no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, kept, map_arrow, passing, settle
from .grams import Words, gram_hashes, mix64, slices, sliding, split_words
from .repeats import signed

#: Bits of the bit field, as a power of two: 2 MB, whatever the benchmark's size.
FIELD_BITS = 24
_PRINTS = "array<struct<k: int, print: long>>"


def _prints(w: Words, one: np.ndarray, starts: np.ndarray, k: int, gram: int) -> np.ndarray:
    """The fingerprints of the windows of k words from starts on."""
    gram = min(gram, k)
    return mix64(sliding(gram_hashes(one, gram), k - gram + 1)[starts] + np.uint64(k))


def benchmark_windows(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """k, print, w1, w2, item_id of every window of the items (item_id, text, ...), once each; written.

    An item of fewer words than window, but not none, is one window of k words.
    Rows without item_id are left out.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for first, last, data, bounds in slices(b.column(1)):
                w = split_words(data, bounds, alnum=True)
                one, two, owner, n = w.hashes(), w.hashes(second=True), ids[first:last][w.doc_of()], np.diff(w.first)
                for k in sorted({min(int(x), window) for x in n if x}):
                    starts = np.flatnonzero(w.has(window)) if k == window else w.first[:-1][n == k]
                    yield batch(
                        k=pa.array(np.full(len(starts), k), pa.int32()), print=signed(_prints(w, one, starts, k, gram)), w1=signed(gram_hashes(one, k)[starts]),
                        w2=signed(gram_hashes(two, k, True)[starts]), item_id=pa.array(owner[starts], pa.int64()),
                    )

    return settle(map_arrow(items, each, "k int, print long, w1 long, w2 long, item_id long").distinct(), "benchmark")


def _bit_field(known: DataFrame) -> np.ndarray:
    """The bit field as 64-bit words: as many rows come to the driver at most, 4 MB."""
    word, bit = f"shiftrightunsigned(print, {70 - FIELD_BITS})", f"cast(shiftrightunsigned(print, {64 - FIELD_BITS}) & 63 as int)"
    rows = known.groupBy(F.expr(word).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias("bits")).collect()
    out = np.zeros(1 << (FIELD_BITS - 6), np.int64)
    for r in rows:
        out[r.word] = r.bits
    return out.view(np.uint64)


def _may_be(field: np.ndarray, prints: np.ndarray) -> np.ndarray:
    bits = len(field).bit_length() + 5
    return (field[prints >> np.uint64(70 - bits)] >> (prints >> np.uint64(64 - bits) & np.uint64(63)) & np.uint64(1)).astype(bool)


def _scanned(docs: DataFrame, known: DataFrame, window: int, gram: int) -> DataFrame:
    """row, doc_id (of any type), n_words and, if a fingerprint may be the benchmark's, prints and text, of docs (row, doc_id, text); written."""
    lengths = sorted(r.k for r in known.select("k").distinct().collect())  # 1 to window, at most
    shared = docs.sparkSession.sparkContext.broadcast(_bit_field(known))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for b in batches:
            for first, last, data, bounds in slices(b.column(2)):
                w = split_words(data, bounds, alnum=True)
                one, owner = w.hashes(), w.doc_of()
                doc, length, prints = [], [], []
                for k in lengths:
                    starts = np.flatnonzero(w.has(k))
                    found = _prints(w, one, starts, k, gram)
                    kept = _may_be(field, found)
                    doc.append(owner[starts[kept]])
                    prints.append(found[kept])
                    length.append(np.full(int(kept.sum()), k))
                doc, length, prints = (np.concatenate([*x, np.zeros(0, t)]).astype(t) for x, t in ((doc, np.int64), (length, np.int32), (prints, np.uint64)))
                order = np.lexsort((prints, length, doc))
                doc, length, prints = doc[order], length[order], prints[order]
                new = np.ones(len(doc), bool)
                new[1:] = (np.diff(doc) != 0) | (np.diff(length) != 0) | (prints[1:] != prints[:-1])
                doc, length, prints = doc[new], length[new], prints[new]
                some = np.bincount(doc, minlength=last - first) > 0
                each_print = pa.StructArray.from_arrays([pa.array(length, pa.int32()), signed(prints)], ["k", "print"])
                text = b.column(2).slice(first, last - first)
                yield batch(
                    row=b.column(0).slice(first, last - first), doc_id=b.column(1).slice(first, last - first), n_words=pa.array(np.diff(w.first), pa.int64()),
                    prints=pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(last - first + 1)), pa.int32()), each_print),
                    text=pa.array([text[i].as_py() if s else None for i, s in enumerate(some.tolist())], pa.string()),
                )

    return settle(map_arrow(docs.select("row", "doc_id", "text"), each, f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, prints {_PRINTS}, text string"), "scanned")


def _met(scanned: DataFrame, known: DataFrame, window: int, gram: int) -> DataFrame:
    """row, start, k, w1, w2: the windows of documents that are the benchmark's; written."""
    prints = scanned.select("row", F.explode("prints").alias("p")).select("row", "p.k", "p.print")
    shared = prints.join(known.select("k", "print").distinct(), ["k", "print"], "left_semi")
    to_extend = settle(shared.groupBy("row").agg(F.collect_list(F.struct("k", "print")).alias("prints")), "shared")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(0).to_numpy()
            for first, last, data, bounds in slices(b.column(1)):
                w = split_words(data, bounds, alnum=True)
                one, two, owner = w.hashes(), w.hashes(second=True), w.doc_of()
                part = b.column(2).slice(first, last - first).flatten()
                length, prints = part.field(0).to_numpy(), part.field(1).to_numpy().view(np.uint64)
                for k in np.unique(length).tolist():
                    starts = np.flatnonzero(w.has(k))
                    starts = starts[np.isin(_prints(w, one, starts, k, gram), prints[length == k])]
                    yield batch(
                        row=pa.array(rows[first:last][owner[starts]], pa.int64()), start=pa.array(starts - w.first[owner[starts]], pa.int32()), k=pa.array(np.full(len(starts), k), pa.int32()),
                        w1=signed(gram_hashes(one, k)[starts]), w2=signed(gram_hashes(two, k, True)[starts]),
                    )

    texts = scanned.where("text is not null").select("row", "text").join(to_extend, "row")
    windows = map_arrow(texts.select("row", "text", "prints"), each, "row long, start int, k int, w1 long, w2 long")
    return settle(windows.join(known.select("k", "w1", "w2").distinct(), ["k", "w1", "w2"], "left_semi"), "met")


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """doc_id, n_words, hits (places of hit words), items (item_ids that occur).

    docs: doc_id, text, ...; benchmark: item_id, text, ... Words are runs of
    letters, digits and non-ASCII characters, A-Z lower-cased. Null texts have
    no words; items without words or item_id match nothing; a null doc_id stays
    null. There is a row for each row of docs, whatever doc_ids repeat: rows are
    numbered. An empty benchmark hits nothing; an empty table gives an empty result.
    """
    known = benchmark_windows(benchmark, window, gram)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = _scanned(rows, known, window, gram)
    met = _met(scanned, known, window, gram)
    places = F.flatten(F.transform(F.collect_set(F.struct("start", "k")), lambda x: F.sequence(x.start, x.start + x.k - 1)))
    hits = met.groupBy("row").agg(F.array_sort(F.array_distinct(places)).alias("hits"))
    items = met.select("row", "k", "w1", "w2").distinct().join(known.select("k", "w1", "w2", "item_id"), ["k", "w1", "w2"])
    items = items.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    found = scanned.select("row", "doc_id", "n_words").join(settle(hits.join(items, "row"), "overlaps"), "row", "left")
    return found.select("doc_id", "n_words", F.coalesce("hits", none("int")).alias("hits"), F.coalesce("items", none("long")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """The rows of docs (text, ...), all columns, in which no window of the benchmark occurs.

    A text's md5 stands for it, as equal texts are dropped together: what is hit
    is a small table of them, and docs is neither numbered nor written again.
    """
    mark = F.unhex(F.md5(F.col("text").cast("string").cast("binary")))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), mark.alias("doc_id"), F.col("text").cast("string").alias("text"))
    with passing(docs.sparkSession):
        known = benchmark_windows(benchmark, window, gram)
        scanned = _scanned(texts, known, window, gram)
        met = _met(scanned, known, window, gram).select("row").distinct()
        hit = kept(settle(scanned.select("row", F.col("doc_id").alias("mark")).join(met, "row").select("mark").distinct(), "hit"))
    return docs.select(F.struct("*").alias("row"), mark.alias("mark")).join(hit, "mark", "left_anti").select("row.*")


def decontamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document."""
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return overlaps(docs, benchmark, window, gram).select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )
