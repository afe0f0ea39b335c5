"""MinHash near-dedup by a multi-index Hamming join.

A document's signature is SIZE minima of its shingles, BITS bits each. Split
into chunks of CHUNK values, two signatures that differ in at most RADIUS places
agree, but for one place, in some chunk; so each chunk is looked up once for
each place that may be wrong, without it. That finds all pairs within RADIUS.
Pairs further apart that meet in a lookup are kept too: of two sets of
similarity 0.75, a place differs with a chance of a quarter, a chunk in two
places or more with one of 0.262, and all 16 chunks with one of 5e-10, which is
the share of links at the threshold that is missed; above it is smaller.

Groups are not expanded into pairs. Within a lookup key, documents first meet
the one that shares most keys with others; links are confirmed on the whole
shingle sets, and keys whose documents are all in one component are done. What
is left is compared inside a task, block by block, and only pairs come out that
may be similar: with each signature goes a bitmap of the set, a bit for the
parity of the shingles that fall there. Two sets differ in at least as many
shingles as their bitmaps differ in bits, so what the bitmaps rule out is
certainly no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, identified, map_arrow, settle
from .components import components
from .grams import _A, gram_hashes, mix64, slices, split_words

SIZE, CHUNK, BITS = 64, 4, 16
#: One place of a chunk may differ: with all chunks wrong in two places or more, SIZE / CHUNK * 2 places differ.
RADIUS = 2 * SIZE // CHUNK - 1
#: 64-bit words of a set's bitmap.
WORDS = 16
#: Documents of a key that one task compares; a larger key is dealt to a task for each two of its parts.
PART, SQUARE = 4096, 256

_FACTORS = np.random.default_rng(17).integers(1 << 62, size=SIZE).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document of a slice, in order, and each document's first."""
    w = split_words(data, bounds, lower=True)
    n = np.diff(w.first)
    words = w.hashes()
    full = np.flatnonzero(w.has(width))
    short = np.flatnonzero((n > 0) & (n < width))
    prefix = _A.prefix(words)
    hashes = np.append(gram_hashes(words, width)[full], _A.spans(prefix, w.first[short], w.first[short + 1]))
    doc = np.append(w.doc_of()[full], short)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(n) + 1))


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (distinct shingles), f1, f2 (a hash of the whole set), sketch (signature and bitmap); of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, data, bounds in slices(b.column(1)):
                hashes, first = shingles(data, bounds, width)
                n = np.diff(first)
                some = np.flatnonzero(n)
                at = first[:-1][some]
                sums = np.zeros((2, z - a), np.uint64)
                marks = np.zeros((z - a, SIZE), np.uint64)
                if len(some):
                    for k, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
                        sums[k, some] = np.add.reduceat(mix64(hashes ^ np.uint64(salt)), at)
                    for j, factor in enumerate(_FACTORS):
                        marks[some, j] = np.minimum.reduceat(hashes * factor, at)
                signature = (mix64(marks) & np.uint64((1 << BITS) - 1)).astype("<u2")
                bits = np.zeros((z - a, WORDS), np.uint64)
                spot = (mix64(hashes) % np.uint64(64 * WORDS)).astype(np.int64)
                np.bitwise_xor.at(bits.reshape(-1), np.repeat(np.arange(z - a), n) * WORDS + (spot >> 6), np.uint64(1) << (spot & 63).astype(np.uint64))
                yield batch(
                    doc_id=b.column(0).slice(a, z - a), n=pa.array(n, pa.int32()), f1=pa.array(sums[0].view(np.int64)), f2=pa.array(sums[1].view(np.int64)),
                    sketch=pa.array([s.tobytes() + x.astype("<u8").tobytes() for s, x in zip(signature, bits)], pa.binary()),
                )

    return map_arrow(docs, each, "doc_id long, n int, f1 long, f2 long, sketch binary")


def _sketches(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and bitmaps."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), 2 * SIZE + 8 * WORDS)
    return np.ascontiguousarray(raw[:, : 2 * SIZE]).view("<u2"), np.ascontiguousarray(raw[:, 2 * SIZE :]).view("<u8")


def _possible(bits_a: np.ndarray, bits_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes and bitmaps can be so similar: by how much they differ at least."""
    apart = np.bitwise_count(bits_a ^ bits_b).sum(-1, dtype=np.int64)
    return (100 + percent) * apart <= (100 - percent) * (n_a.astype(np.int64) + n_b)


def lookup_keys(signed: DataFrame) -> DataFrame:
    """key, place, doc_id, n: SIZE keys for each row of signed (doc_id, n, sketch); place tells the chunk and what is left out."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = _sketches(b.column(2))[0].astype(np.uint64).reshape(len(b), SIZE // CHUNK, CHUNK)
            keys = np.zeros((len(b), SIZE), np.uint64)
            for wrong in range(CHUNK):
                key = np.zeros(values.shape[:2], np.uint64)
                for place in range(CHUNK):
                    if place != wrong:
                        key = (key << np.uint64(BITS)) | values[:, :, place]
                keys[:, wrong::CHUNK] = key
            keys = mix64(keys ^ mix64(np.arange(1, SIZE + 1, dtype=np.uint64)))
            row = np.repeat(np.arange(len(b)), SIZE)
            place = np.tile(np.arange(SIZE, dtype=np.int32), len(b))
            yield batch(key=pa.array(keys.reshape(-1).view(np.int64)), place=pa.array(place), doc_id=b.column(0).take(pa.array(row)), n=b.column(1).take(pa.array(row)))

    return map_arrow(signed.select("doc_id", "n", "sketch"), each, "key long, place int, doc_id long, n int")


def _both(rows: DataFrame, other: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b) with these columns of both."""
    for side in ("a", "b"):
        rows = rows.join(other.select(F.col("doc_id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
    return rows.select("a", "b", *(f"{c}_{side}" for c in columns for side in ("a", "b")))


def possible(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their bitmaps don't rule out."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (_, bits_a), (_, bits_b) = (_sketches(b.column(c)) for c in (2, 3))
            n_a, n_b = (b.column(c).to_numpy(zero_copy_only=False) for c in (4, 5))
            yield b.select([0, 1]).filter(pa.array(_possible(bits_a, bits_b, n_a, n_b, percent)))

    return map_arrow(_both(pairs, signed, "sketch", "n"), near, "a long, b long")


def compared(members: DataFrame, signed: DataFrame, percent: int, part: int = PART) -> DataFrame:
    """Pairs (a, b) of members (key, place, doc_id, root) of one key and different roots, as possible() keeps them.

    A pair that meets in several keys is looked at in the first place of these alone.
    """
    sized = members.join(members.groupBy("key").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")), "key")
    own = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    tasks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(own, p).alias("low"), F.greatest(own, p).alias("high")))
    dealt = sized.select("key", "place", "doc_id", "root", own.alias("part"), F.explode(tasks).alias("t"))
    dealt = dealt.join(signed, "doc_id").select("key", "t.low", "t.high", "place", "doc_id", "root", "part", "n", "sketch")
    dealt = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "part", "n")

    def first_place(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        same = (x == y).reshape(len(x), SIZE // CHUNK, CHUNK)
        chunk = (same.sum(2) >= CHUNK - 1).argmax(1)
        return chunk * CHUNK + (~same[np.arange(len(x)), chunk]).argmax(1)

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        low, high, place, doc, root, own, n = (rows.column(c).to_numpy() for c in range(1, 8))
        (sign, bits), single = _sketches(rows.column(8)), low[0] == high[0]
        border = len(doc) if single else int((own == low[0]).sum())
        for i in range(0, border, SQUARE):
            a = slice(i, min(i + SQUARE, border))
            for j in range(i if single else border, len(doc), SQUARE):
                b = slice(j, min(j + SQUARE, len(doc)))
                if percent * n[j] > 100 * n[a.stop - 1]:
                    break  # sizes rise: from here on all sets are too large
                if 100 * n[b.stop - 1] < percent * n[a.start]:
                    continue
                fit = 100 * np.minimum(n[a, None], n[None, b]) >= percent * np.maximum(n[a, None], n[None, b])
                x, y = np.nonzero(fit & (root[a, None] != root[None, b]) & ((doc[a, None] < doc[None, b]) | (i != j)))
                x, y = x + i, y + j
                kept = _possible(bits[x], bits[y], n[x], n[y], percent)
                x, y = x[kept], y[kept]
                kept = first_place(sign[x], sign[y]) == place[0]
                x, y = x[kept], y[kept]
                if len(x):
                    yield batch(a=pa.array(np.minimum(doc[x], doc[y])), b=pa.array(np.maximum(doc[x], doc[y])))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        task = None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in range(3)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), len(b)] if len(b) else []
            for at, to in zip(cuts, cuts[1:]):
                if held and tuple(keys[:, at]) != task:
                    yield from pairs(pa.Table.from_batches(held).combine_chunks())
                    held = []
                task = tuple(keys[:, at])
                held.append(b.slice(at, to - at))
        if held:
            yield from pairs(pa.Table.from_batches(held).combine_chunks())

    return map_arrow(dealt, each, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, sets = [], ([], [])
            for side in (0, 1):
                for _, _, data, bounds in slices(b.column(2 + side)):
                    hashes, first = shingles(data, bounds, width)
                    sets[side].extend(np.split(hashes, first[1:-1]))
            for x, y in zip(*sets):
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    return map_arrow(_both(pairs, texts, "text"), similar, "a long, b long")


def _fits(x: str, y: str, percent: int) -> F.Column:
    """Whether sets of these sizes can be so similar."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, part: int = PART) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text, ...).

    Words are runs of anything but ASCII white space, A-Z lower-cased; a
    document's set has its distinct runs of `width` words, or all its words as
    one if it has fewer. Documents are linked if their sets' intersection is at
    least percent / 100 of the union; component_id is the smallest doc_id
    reachable. Null or empty text has no shingles and no links; rows without
    doc_id are left out; rows that repeat a doc_id with its text are one
    document. Other columns are not read; an empty table gives an empty result.
    """
    docs = identified(docs)
    every = settle(profiles(docs, width), "profiles")
    sets = every.where("n > 0")
    groups = settle(sets.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.min("sketch").alias("sketch")), "sets")
    signed = groups.select(F.col("rep").alias("doc_id"), "n", "sketch")
    keys = lookup_keys(signed)
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    members = settle(keys.join(shared, "key"), "members")
    counted = members.groupBy("doc_id").agg(F.count("*").alias("degree"))
    texts = settle(docs.join(counted.select("doc_id").hint("shuffle_hash"), "doc_id").dropDuplicates(["doc_id"]), "texts")
    leader = F.max(F.struct("degree", -F.col("doc_id"), "doc_id", "n")).alias("l")
    leaders = members.join(counted, "doc_id").groupBy("key").agg(leader).select("key", F.col("l.doc_id").alias("leader"), F.col("l.n").alias("leader_n"))
    members = settle(members.join(leaders, "key").where("doc_id != leader"), "led")
    met = members.where(_fits("n", "leader_n", percent)).select(F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b")).distinct()
    links = settle(confirmed(possible(met, signed, percent), texts, width, percent), "met")
    labels = None if links.isEmpty() else components(links)

    rooted = members.withColumn("root", F.col("doc_id"))
    if labels is not None:
        rooted = members.join(labels, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    rooted = rooted.select("key", "place", "doc_id", "root")
    apart = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    rest = settle(rooted.join(apart, "key"), "apart")
    links = settle(confirmed(compared(rest, signed, percent, part), texts, width, percent), "compared")
    if not links.isEmpty():
        labels = components(links if labels is None else links.unionByName(labels.select(F.col("doc_id").alias("a"), F.col("root").alias("b"))))
    grouped = every.select("doc_id", "n", "f1", "f2").join(groups.select("f1", "f2", "n", "rep"), ["f1", "f2", "n"], "left")
    if labels is not None:
        grouped = grouped.join(labels.select(F.col("doc_id").alias("rep"), "root"), "rep", "left")
    else:
        grouped = grouped.withColumn("root", F.lit(None).cast("long"))
    component = F.coalesce("root", "rep", "doc_id")
    return grouped.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
