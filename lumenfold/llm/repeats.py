"""Candidates for repeated windows of a sequence, as runs of windows.

A window of `window` symbols is represented by the least hash among its grams
of `gram` symbols. Equal windows have equal representatives at equal places, so
a window can repeat only if its representative does. Neighbouring windows with
one representative (at one place, the anchor) form a run of at most
window - gram + 1 windows. All windows of a run hold its core, from the last
one's start to the first one's end; a run is cut by the places of its windows
before the anchor into shorter runs with longer cores, and equal windows fall
into runs with equal cores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_arrow
from .grams import mix64, slices, sliding


@dataclass
class Runs:
    """Runs of windows in a slice: representative, first window, windows, document."""

    key: np.ndarray
    lo: np.ndarray
    n: np.ndarray
    doc: np.ndarray

    def take(self, kept: np.ndarray) -> Runs:
        return Runs(self.key[kept], self.lo[kept], self.n[kept], self.doc[kept])


def runs_of(grams: np.ndarray, first: np.ndarray, window: int, gram: int) -> Runs:
    """grams: hash of the gram at each symbol; first: each document's first symbol, and the total."""
    lengths = np.diff(first)
    doc_of = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.flatnonzero(np.repeat(first[1:], lengths) - np.arange(len(doc_of)) >= window)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Runs(grams[:0], none, none, none)
    least = sliding(grams, window - gram + 1)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (least[1:] != least[:-1]) | (grams[starts[:-1]] == least[:-1]) | (np.diff(starts) != 1)
    at = np.flatnonzero(new)
    return Runs(least[at], starts[at], np.diff(np.append(at, len(starts))), doc_of[starts[at]])


#: Of a slice (data, bounds): gram hashes, first symbols, and the two hashes of a run's text given its symbols' bounds.
Reader = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, Callable]]


def signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(hashes).view(np.int64))


def representatives(docs: DataFrame, read: Reader, window: int, gram: int) -> DataFrame:
    """key, doc_id, n: the representatives of each document's runs, and how many runs have each."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for first, last, data, bounds in slices(b.column(1)):
                grams, starts, _ = read(data, bounds)
                runs = runs_of(grams, starts, window, gram)
                order = np.lexsort((runs.key, runs.doc))
                key, doc = runs.key[order], runs.doc[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                yield batch(key=signed(key[at]), doc_id=pa.array(ids[first:last][doc[at]], pa.int64()), n=pa.array(np.diff(np.append(at, len(key))), pa.int32()))

    return map_arrow(docs.select("doc_id", "text"), each, "key long, doc_id long, n int")


def repeated_keys(found: DataFrame) -> DataFrame:
    """doc_id, known: of each document the representatives that occur more than once.

    Counts are summed before the exchange; a very common key's rows go back to
    their documents by a join, which Spark splits where it is skewed.
    """
    twice = found.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
    return found.join(twice, "key").groupBy("doc_id").agg(F.collect_list("key").alias("known"))


#: Parts in which the members of a group of copies meet its bounds.
SALTS = 8


def whole_copies(docs: DataFrame) -> DataFrame:
    """doc_id of each document whose whole text another one has, and the first and last that have it."""
    hashed = docs.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("md5"))
    groups = hashed.groupBy("md5").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("last > first")
    groups = groups.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    salted = hashed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return salted.join(groups, ["md5", "salt"]).select("doc_id", "first", "last")


def repeated_runs(data: np.ndarray, bounds: np.ndarray, known: pa.Array, read: Reader, window: int, gram: int):
    """The runs of a slice whose representative is among known, and read's hasher and first symbols."""
    grams, first, hasher = read(data, bounds)
    runs = runs_of(grams, first, window, gram)
    keys = np.unique(known.flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
    return runs.take(np.isin(runs.key, keys)), first, hasher


RUN = "key long, c1 long, c2 long, doc_id long, lo int, n int, anchor int, twice boolean"


def _anchors(grams: np.ndarray, runs: Runs) -> np.ndarray:
    """Place of each run's representative: of the grams that equal its key, the first in its first window."""
    keys = np.unique(runs.key)
    at = np.flatnonzero(np.isin(grams, keys))
    total = len(grams)
    code = np.sort(np.searchsorted(keys, grams[at]) * total + at)
    return code[np.searchsorted(code, np.searchsorted(keys, runs.key) * total + runs.lo)] % total if total else at


def run_rows(marked: DataFrame, read: Reader, window: int, gram: int) -> DataFrame:
    """The repeated runs of marked (doc_id, text, known) as rows (RUN), c1 and c2 hashing their texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for a, z, data, bounds in slices(b.column(1)):
                grams, first, hasher = read(data, bounds)
                runs = runs_of(grams, first, window, gram)
                keys = np.unique(b.column(2).slice(a, z - a).flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
                runs = runs.take(np.isin(runs.key, keys))
                one, two = hasher(runs.lo, runs.lo + runs.n + window - 1)
                from_ = first[runs.doc]
                yield batch(
                    key=signed(runs.key), c1=signed(one), c2=signed(two), doc_id=pa.array(ids[a:z][runs.doc], pa.int64()), lo=pa.array(runs.lo - from_, pa.int32()),
                    n=pa.array(runs.n, pa.int32()), anchor=pa.array(_anchors(grams, runs) - from_, pa.int32()), twice=pa.array(np.zeros(len(one), bool)),
                )

    return map_arrow(marked.select("doc_id", "text", "known"), each, RUN)


def wanted_runs(runs: DataFrame) -> DataFrame:
    """doc_id and its runs of runs (RUN), for cut_runs."""
    return runs.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "n", "anchor", "twice")).alias("wanted"))


def cut_runs(docs: DataFrame, wanted: DataFrame, read: Reader, window: int, length: int) -> DataFrame:
    """The wanted runs, cut into runs (RUN) with cores of length symbols, whose hash is the key.

    Windows stand 0 to window - gram places before the anchor; those of each
    window - length + 1 neighbouring places stay together.
    """
    span = window - length + 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for a, z, data, bounds in slices(b.column(1)):
                _, first, hasher = read(data, bounds)
                part = b.column(2).slice(a, z - a)
                doc = np.repeat(np.arange(z - a), part.value_lengths().to_numpy(zero_copy_only=False))
                lo, n, anchor, twice = (x.to_numpy(zero_copy_only=False) for x in part.flatten().flatten())
                most, least = anchor - lo, anchor - lo - n + 1
                parts = most // span - least // span + 1
                run = np.repeat(np.arange(len(lo)), parts)
                node = (least // span)[run] + np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)
                top, low = np.minimum(most[run], (node + 1) * span - 1), np.maximum(least[run], node * span)
                zero, n = first[doc[run]] + anchor[run], top - low + 1
                core, _ = hasher(zero - node * span, zero - node * span + length)
                one, two = hasher(zero - top, zero - top + n + window - 1)
                yield batch(
                    key=signed(mix64(core + node.astype(np.uint64))), c1=signed(one), c2=signed(two), doc_id=pa.array(ids[a:z][doc[run]], pa.int64()), lo=pa.array(anchor[run] - top, pa.int32()),
                    n=pa.array(n, pa.int32()), anchor=pa.array(anchor[run], pa.int32()), twice=pa.array(twice[run].astype(bool)),
                )

    joined = docs.select("doc_id", "text").join(wanted.hint("shuffle_hash"), "doc_id")
    return map_arrow(joined, each, RUN)


def per_document(column: pa.Array, a: int, z: int, first: np.ndarray) -> np.ndarray:
    """A list column's entries of rows a to z-1, as places in the slice."""
    part = column.slice(a, z - a)
    if part.null_count:
        import pyarrow.compute as pc

        lengths = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    else:
        lengths = part.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return part.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(first[:-1], lengths)


def covered(total: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of total places lie in one of the spans."""
    change = np.bincount(start, minlength=total + 1) - np.bincount(end, minlength=total + 1)
    return np.cumsum(change[:total]) > 0


def stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of set flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]])))
    return edges[::2], edges[1::2]


def removed(total: int, runs: Runs, at: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Which of total symbols lie in a window of the runs that isn't one of the n from a place of at on."""
    begin, end = stretches(covered(total, runs.lo, runs.lo + runs.n) & ~covered(total, at, at + n))
    return covered(total, begin, end + window - 1)
