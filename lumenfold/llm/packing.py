"""Packing documents into sequences of a fixed number of tokens by local search.

A task encodes its documents and packs them a block at a time: each piece goes
to the bin it fills best, largest first; then underfull bins trade, the fullest
first, with those less full than they are: they take a document (move), swap one
for one, or two for one either way, whatever brings most tokens. Each trade
raises the sum of squared fills, so the emptiest bins empty and trading ends.

Full bins are written as they are found. The least full ones join the next
block; what a task has left at its end is shuffled, with a few blocks' worth of
other tasks' rests, and packed once more.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, map_arrow, scratch
from .pieces import text_encoder

CAPACITY = 2048
#: Tokens that are packed together, at least.
BLOCK_TOKENS = 1 << 21
#: Share of a block that may be left for the next one.
CARRIED = 0.25
#: Tokens that an underfull bin of a task's last block may lack and still be written.
SLACK = 8

_ENCODERS: dict = {}


def best_fit(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indices into sizes: largest first, each to the fullest bin that holds it."""
    room: dict[int, list[list[int]]] = {}
    rooms, bins = 0, []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fitting = rooms >> sizes[i]
        if fitting:
            free = (fitting & -fitting).bit_length() - 1 + sizes[i]
            own = room[free].pop()
            if not room[free]:
                rooms ^= 1 << free
        else:
            free, own = capacity, []
            bins.append(own)
        own.append(i)
        free -= sizes[i]
        room.setdefault(free, []).append(own)
        rooms |= 1 << free
    return bins


class _Offers:
    """What bins less full than the one that asks hold, by size."""

    def __init__(self):
        self.at: dict[int, Counter] = {}
        self.sizes = 0

    def add(self, size: int, where: int) -> None:
        self.at.setdefault(size, Counter())[where] += 1
        self.sizes |= 1 << size

    def drop(self, size: int, where: int) -> None:
        own = self.at[size]
        own[where] -= 1
        if not own[where]:
            del own[where]
            if not own:
                self.sizes ^= 1 << size

    def largest(self, most: int) -> int:
        """The largest size offered up to most, 0 if none."""
        return (self.sizes & ((2 << most) - 1)).bit_length() - 1 if self.sizes else 0


def _trade(own: Counter, room: int, offers: _Offers, emptiest: Counter) -> tuple[int, tuple, tuple]:
    """The trade that brings a bin with own sizes most tokens within room: gain, sizes it gives, sizes it takes.

    Two are taken for one, or for none, from the emptiest bin alone, which they help to empty.
    """
    best: tuple = (0, (), ())
    given = [(0, ())] + [(a, (a,)) for a in own]
    sizes = sorted(own)
    given += [(a + b, (a, b)) for i, a in enumerate(sizes) for b in sizes[i if own[a] > 1 else i + 1 :]]
    for total, gives in given:
        found = offers.largest(total + room)
        if found - total > best[0]:
            best = (found - total, gives, (found,))
            if best[0] == room:
                return best
    pairs = {}
    taken = sorted(emptiest)
    for i, a in enumerate(taken):
        for b in taken[i if emptiest[a] > 1 else i + 1 :]:
            pairs[a + b] = (a, b)
    sums = sum(1 << s for s in pairs)
    for total, gives in given[: 1 + len(own)]:
        found = (sums & ((2 << (total + room)) - 1)).bit_length() - 1
        if found - total > best[0]:
            best = (found - total, gives, pairs[found])
            if best[0] == room:
                break
    return best


def local_search(bins: list[list[int]], sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """bins, traded among until no underfull bin gains from a less full one; empty ones are gone.

    Only sizes matter to a trade, so bins are counts of sizes until the end.
    """
    full = [b for b in bins if sum(sizes[i] for i in b) == capacity]
    open_ = [b for b in bins if sum(sizes[i] for i in b) < capacity]
    names: dict[int, list[int]] = {}
    for b in open_:
        for i in b:
            names.setdefault(sizes[i], []).append(i)
    held = [Counter(sizes[i] for i in b) for b in open_]
    fill = [sum(sizes[i] for i in b) for b in open_]
    again = True
    while again:
        again = False
        order = sorted((k for k in range(len(held)) if 0 < fill[k] < capacity), key=lambda k: (-fill[k], k))
        offers = _Offers()
        for k in order:
            for s, n in held[k].items():
                for _ in range(n):
                    offers.add(s, k)
        last = len(order) - 1
        for place, k in enumerate(order):
            while last > place and not fill[order[last]]:
                last -= 1
            if last <= place:
                break
            for s, n in held[k].items():
                for _ in range(n):
                    offers.drop(s, k)
            while fill[k] < capacity and last > place:
                end = order[last]
                gain, gives, takes = _trade(held[k], capacity - fill[k], offers, held[end])
                if not gain:
                    break
                j = end if len(takes) > 1 else min(offers.at[takes[0]], key=lambda j: (fill[j], j))
                for s in takes:
                    offers.drop(s, j)
                    held[j][s] -= 1
                    held[k][s] += 1
                    if not held[j][s]:
                        del held[j][s]
                for s in gives:
                    offers.add(s, j)
                    held[j][s] += 1
                    held[k][s] -= 1
                    if not held[k][s]:
                        del held[k][s]
                fill[k] += gain
                fill[j] -= gain
                again = True
                while last > place and not fill[order[last]]:
                    last -= 1
    return full + [[names[s].pop() for s, n in sorted(h.items()) for _ in range(n)] for h in held if h]


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indices into sizes (1 to capacity each) of at most capacity in sum."""
    return local_search(best_fit(sizes, capacity), sizes, capacity)


def _encoder(vocabulary: str):
    """text_encoder(), made once in each process."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = text_encoder(vocabulary)
    return _ENCODERS[vocabulary]


_PACKED = "sequence_id long, doc_id array<long>, row array<long>, piece array<int>, start array<long>, length array<int>, ids binary"
_WRITE = 64


class _Packer:
    """Packs pieces (doc_id, row, piece, start, ids as bytes) as they come and gives rows of sequences."""

    def __init__(self, capacity: int, block_tokens: int, first_id: int):
        self.capacity, self.block_tokens, self.next, self.out = capacity, block_tokens, first_id, []
        self.pieces, self.tokens, self.block = [], 0, block_tokens

    def put(self, piece: tuple) -> Iterator[pa.RecordBatch]:
        if len(piece[4]) == 4 * self.capacity:
            yield from self.write([piece])
            return
        self.pieces.append(piece)
        self.tokens += len(piece[4]) // 4
        if self.tokens >= self.block:
            yield from self.cut(CARRIED, 0)

    def cut(self, carried: float, slack: int) -> Iterator[pa.RecordBatch]:
        """Packs what is held; keeps the emptiest bins, up to a share of the block, that lack more than slack."""
        sizes = [len(p[4]) // 4 for p in self.pieces]
        kept, most = [], carried * self.tokens
        fills = sorted(((sum(sizes[i] for i in b), b) for b in pack(sizes, self.capacity)), key=lambda f: f[0])
        for fill, own in fills:
            if fill + slack < self.capacity and fill <= most:
                most -= fill
                kept += own
            else:
                most = 0
                yield from self.write([self.pieces[i] for i in own])
        self.pieces = [self.pieces[i] for i in sorted(kept)]
        self.tokens = sum(sizes[i] for i in kept)
        self.block = self.tokens + self.block_tokens

    def write(self, pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
        self.out.append((self.next, pieces))
        self.next += 1
        if len(self.out) >= _WRITE:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        column = lambda at, kind: pa.array([[p[at] for p in pieces] for _, pieces in rows], pa.list_(kind))
        return batch(
            sequence_id=pa.array([i for i, _ in rows], pa.int64()), doc_id=column(0, pa.int64()), row=column(1, pa.int64()), piece=column(2, pa.int32()), start=column(3, pa.int64()),
            length=pa.array([[len(p[4]) // 4 for p in pieces] for _, pieces in rows], pa.list_(pa.int32())), ids=pa.array([b"".join(p[4] for p in pieces) for _, pieces in rows], pa.binary()),
        )

    def rest(self) -> Iterator[pa.RecordBatch]:
        """What is held, a row of no sequence for each piece."""
        if self.out:
            yield self.flush()
        for piece in self.pieces:
            self.out.append((None, [piece]))
            if len(self.out) >= _WRITE:
                yield self.flush()
        if self.out:
            yield self.flush()


def write_packed(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int | None = 0, capacity: int = CAPACITY, block_tokens: int = BLOCK_TOKENS) -> None:
    """Writes the sequences that hold docs (doc_id, text, ...) to path.

    path is a folder (any store Spark can write) with two Parquet folders,
    first and second. A row is a sequence: its id, its pieces' doc_id, row
    (a number that rows that repeat a doc_id don't share), piece, start (the
    document's ids before it) and length, and all ids as little-endian unsigned
    32-bit integers. Rows of first without a sequence_id are pieces that second
    packs. A document, with end_id after its ids, is cut only if it is longer
    than capacity, into pieces of capacity ids, the first one shorter. Null text
    is empty; a document without any id (no end_id) has no piece.

    A task holds a block of block_tokens ids, and the share CARRIED of those before
    it, beyond its longest document.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _encoder(vocabulary)
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        row = TaskContext.get().partitionId() << 32
        packer, whole = _Packer(capacity, block_tokens, row), 4 * capacity
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = ids_of(text.as_py() or "").tobytes() + end
                at = 0
                for piece, to in enumerate(range(len(ids) % whole or whole, len(ids) + 1, whole)):
                    yield from packer.put((doc_id, row, piece, at // 4, ids[at:to]))
                    at = to
                row += 1
        yield from packer.cut(CARRIED, SLACK)
        yield from packer.rest()

    map_arrow(docs, encode, _PACKED).write.parquet(f"{path}/first")
    left = spark.read.schema(_PACKED).parquet(f"{path}/first").where("sequence_id is null")
    tokens = left.agg(F.sum(F.element_at("length", 1).cast("long"))).first()[0] or 0
    tasks = -(-tokens // (4 * block_tokens)) or 1

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(capacity, block_tokens, (1 << 62) + (TaskContext.get().partitionId() << 32))
        for b in batches:
            for doc_id, row, piece, start, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "row", "piece", "start", "ids"))):
                yield from packer.put((doc_id[0], row[0], piece[0], start[0], ids))
        yield from packer.cut(0, 0)
        yield from packer.rest()

    dealt = left.repartition(tasks, "row", "piece").sortWithinPartitions("row", "piece")
    map_arrow(dealt, again, _PACKED).write.parquet(f"{path}/second")


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """The sequences in path, as write_packed() gives them."""
    return spark.read.schema(_PACKED).parquet(f"{path}/first", f"{path}/second").where("sequence_id is not null")


def pieces_of(sequences: DataFrame) -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32, sequence_id, offset of each piece in sequences."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, doc, row, piece, start, length, ids = b.columns
            n = length.flatten().to_numpy().astype(np.int64)
            many = np.diff(length.offsets.to_numpy())
            ends = np.cumsum(n)
            first = np.repeat((ends - n)[np.cumsum(many) - many], many)
            offset = ends - n - first
            crc = []
            at = 0
            for count, raw in zip(many.tolist(), ids):
                raw = memoryview(raw.as_buffer())
                for i in range(at, at + count):
                    o = 4 * int(offset[i])
                    crc.append(zlib.crc32(raw[o : o + 4 * int(n[i])]))
                at += count
            yield batch(
                doc_id=doc.flatten(), row=row.flatten(), piece=piece.flatten(), start=start.flatten(), length=pa.array(n), ids_crc32=pa.array(crc, pa.int64()),
                sequence_id=pa.array(np.repeat(sequence.to_numpy(), many)), offset=pa.array(offset),
            )

    return map_arrow(sequences, cut, "doc_id long, row long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes docs to path (a new folder in the shared one, if none) and returns the pieces read back from it.

    Rows that repeat a doc_id, and those without one, are documents of their
    own, told apart by row. Empty in, empty out.
    """
    path = path or scratch(docs.sparkSession, "sequences")
    write_packed(docs, path, **options)
    return pieces_of(read_packed(docs.sparkSession, path))
