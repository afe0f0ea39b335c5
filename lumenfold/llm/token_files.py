"""Token ids in patched frame-of-reference blocks.

A segment holds the ids of whole documents, in order, cut into blocks of BLOCK
ids. A block stores its minimum, the ids less the minimum at a width that the
given share of them fits (a percentile), and the rest as an exception list of
positions and whole values. The segment's index has every block's byte offset,
so one block can be read without the others.

Segment bytes: magic "PFR1"; uint32 ids; uint32 blocks; uint32 block offsets
(blocks + 1); then blocks: uint32 minimum, uint8 width, uint8 exceptions,
packed 64-bit little-endian words, uint8 exception positions, uint32 values.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, map_arrow, scratch
from .pieces import Cache, drops_space, encoder, pieces, tokenizer

MAGIC, BLOCK = b"PFR1", 128
SEGMENT_IDS = 1 << 18

_CACHES: dict = {}


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values at width bits each, as rows of 64-bit words."""
    out = np.zeros((2 * width, len(values)), np.uint64)
    columns = np.ascontiguousarray(values.T)
    for j in range(BLOCK if width else 0):
        word, shift = divmod(j * width, 64)
        out[word] |= columns[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= columns[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T)


def _unpacked(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((BLOCK, len(words)), np.uint64)
    columns, mask = np.ascontiguousarray(words.T), np.uint64((1 << width) - 1)
    for j in range(BLOCK if width else 0):
        word, shift = divmod(j * width, 64)
        got = columns[word] >> np.uint64(shift)
        if shift + width > 64:
            got |= columns[word + 1] << np.uint64(64 - shift)
        out[j] = got & mask
    return np.ascontiguousarray(out.T)


def write_segment(ids: np.ndarray, share: float = 0.9) -> bytes:
    """ids (below 2**32) as a segment; the last block is filled with its last id."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    values = np.empty(blocks * BLOCK, np.uint64)
    values[:n] = ids
    values[n:] = ids[-1] if n else 0
    values = values.reshape(blocks, BLOCK)
    least = values.min(1, keepdims=True) if blocks else values[:, :1]
    above = values - least
    need = _bits(above)
    width = np.sort(need, 1)[:, int(np.ceil(share * BLOCK)) - 1] if blocks else np.zeros(0, np.int64)
    patched = need > width[:, None]
    exceptions = patched.sum(1)
    body = 6 + 16 * width + 5 * exceptions
    offsets = np.zeros(blocks + 1, np.int64)
    offsets[1:] = np.cumsum(body)
    out = np.zeros(offsets[-1], np.uint8)
    out[offsets[:-1, None] + np.arange(4)] = least.astype("<u4").view(np.uint8).reshape(blocks, 4)
    out[offsets[:-1] + 4], out[offsets[:-1] + 5] = width, exceptions
    low = np.where(patched, 0, above)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            words = _packed(low[rows], int(w)).astype("<u8").view(np.uint8)
            out[offsets[rows, None] + 6 + np.arange(16 * w)] = words
    block, position = np.nonzero(patched)
    order = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    tail = (offsets[:-1] + 6 + 16 * width)[block]
    out[tail + order] = position
    out[(tail + exceptions[block] + 4 * order)[:, None] + np.arange(4)] = values[block, position].astype("<u4").view(np.uint8).reshape(-1, 4)
    head = MAGIC + np.array([n, blocks], "<u4").tobytes() + offsets.astype("<u4").tobytes()
    return head + out.tobytes()


def read_segment(payload: bytes) -> np.ndarray:
    if payload[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    n, blocks = np.frombuffer(payload, "<u4", 2, 4).tolist()
    offsets = np.frombuffer(payload, "<u4", blocks + 1, 12).astype(np.int64)
    body = np.frombuffer(payload, np.uint8, offset=16 + 4 * blocks)
    at = offsets[:-1]
    least = body[at[:, None] + np.arange(4)].view("<u4").astype(np.uint64).reshape(blocks, 1)
    width, exceptions = body[at + 4].astype(np.int64), body[at + 5].astype(np.int64)
    values = np.empty((blocks, BLOCK), np.uint64)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        words = body[at[rows, None] + 6 + np.arange(16 * w)].view("<u8") if w else np.zeros((len(rows), 0), np.uint64)
        values[rows] = _unpacked(words, int(w))
    values += least
    block = np.repeat(np.arange(blocks), exceptions)
    order = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    tail = (at + 6 + 16 * width)[block]
    values[block, body[tail + order]] = body[(tail + exceptions[block] + 4 * order)[:, None] + np.arange(4)].view("<u4").reshape(-1)
    return values.reshape(-1)[:n].astype(np.uint32)


def write_tokens(docs: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json", end_id: int | None = 1, share: float = 0.9) -> None:
    """Writes the ids of docs (doc_id, text, ...) in ascending doc_id order to path.

    path is a Parquet folder (any store Spark can write) with a row for each
    segment: shard and segment in order, the documents' ids and lengths, and the
    segment's bytes. Shards are ranges of doc_id; rows of equal doc_id keep the
    order of their texts, null doc_ids come last, null text is empty (it still
    gets end_id). A document is never split, so a row is as large as one
    document at most beyond SEGMENT_IDS ids.
    """
    own = drops_space(vocabulary)
    by = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.repartitionByRange(by[0]).sortWithinPartitions(*by)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary)
        if vocabulary not in _CACHES:
            _CACHES[vocabulary] = Cache(encoder(vocabulary), 1 << 18, {"": b""})
        ids_of = _CACHES[vocabulary].__getitem__
        shard, segment, first = TaskContext.get().partitionId(), 0, 0
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        doc_ids, lengths, parts, n = [], [], [], 0

        def flush():
            ids = np.frombuffer(b"".join(parts), "<u4")
            return batch(
                shard=pa.array([shard], pa.int32()), segment=pa.array([segment], pa.int32()), first=pa.array([first], pa.int64()), n_ids=pa.array([n], pa.int64()),
                doc_ids=pa.array([doc_ids], pa.list_(pa.int64())), lengths=pa.array([lengths], pa.list_(pa.int64())), payload=pa.array([write_segment(ids, share)], pa.binary()),
            )

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py() or ""
                got = b"".join(map(ids_of, pieces(text))) if own else np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                doc_ids.append(doc_id)
                lengths.append(len(got + end) // 4)
                parts += [got, end]
                n += lengths[-1]
                if n >= SEGMENT_IDS:
                    yield flush()
                    doc_ids, lengths, parts, first, segment, n = [], [], [], first + n, segment + 1, 0
        if doc_ids:
            yield flush()

    map_arrow(docs, encode, "shard int, segment int, first long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in path; ids, if wanted."""
    stored = spark.read.parquet(path)
    # a row for each shard: as many as the writing job had tasks
    totals = stored.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = stored.join(F.broadcast(bases), "shard").select((F.col("base") + F.col("first")).alias("first"), "doc_ids", "lengths", "payload")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, doc_ids, lengths, payload in zip(*(c for c in b.columns)):
                ids = read_segment(payload.as_py()).astype("<u4")
                n = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(n)
                starts = ends - n
                raw = memoryview(ids.tobytes())
                out = dict(
                    doc_id=pa.array(doc_ids.as_py(), pa.int64()), start=pa.array(starts + first.as_py(), pa.int64()), n_tokens=pa.array(n, pa.int64()),
                    ids_crc32=pa.array([zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())], pa.int64()),
                )
                if with_ids:
                    out["ids"] = pa.array([ids[s:e] for s, e in zip(starts, ends)], pa.list_(pa.int64()))
                yield batch(**out)

    return map_arrow(placed, decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def token_files(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes docs to path (a new folder in the shared one, if none) and reads it back."""
    path = path or scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, **options)
    return read_tokens(docs.sparkSession, path)
