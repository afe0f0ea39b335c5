"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the lengths, in tokens, of the corpus's
frequent pre-tokens; tier two is a cache in each Python worker, filled by
encoding what the table lacks. Pre-tokens are never shuffled: the table comes
from each task's own heaviest pre-tokens, at most task_words rows a task, and
it decides only how fast a count is found, never the count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_arrow
from .pieces import LONGEST, Cache, drops_space, pieces, tokenizer

_CACHES: dict = {}


def frequent_pieces(docs: DataFrame, table_size: int, task_words: int) -> list[str]:
    """The table_size heaviest pre-tokens, from every task's task_words heaviest."""

    def heaviest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0):
                if text.is_valid:
                    seen.update(pieces(text.as_py()))
                if len(seen) > 16 * task_words:
                    seen = Counter(dict(seen.most_common(8 * task_words)))
        top = [(p, n) for p, n in seen.most_common(task_words) if p and len(p) <= LONGEST]
        yield batch(piece=pa.array([p for p, _ in top], pa.string()), n=pa.array([n for _, n in top], pa.int64()))

    found = map_arrow(docs.select("text"), heaviest, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r.piece for r in found.orderBy(F.desc("n"), "piece").limit(table_size).collect()]


def token_counts(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = 2048, table_size: int = 1 << 15, task_words: int = 1 << 12) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text, ...).

    Null text counts as empty: 0 bytes, 0 tokens. A null doc_id stays null,
    repeated rows give repeated rows, an empty table an empty result; columns
    other than doc_id and text are not read. The broadcast is at most
    table_size pre-tokens of LONGEST characters (8 MB by default). Tokenizers
    that give white space ids of its own have no such table: their texts are
    encoded whole.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared, own = None, drops_space(vocabulary)
    if own:
        top = frequent_pieces(docs, table_size, task_words)
        lengths = [min(len(e.ids), 65535) for e in tokenizer(vocabulary).encode_batch(top, add_special_tokens=False)]
        shared = spark.sparkContext.broadcast(("\n".join(top), np.array(lengths, np.uint16).tobytes()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary)
        if own:
            key = (vocabulary, hash(shared.value))
            if key not in _CACHES:
                _CACHES.clear()
                words, lengths = shared.value
                start = dict(zip(words.split("\n"), np.frombuffer(lengths, np.uint16).tolist())) if words else {}
                start[""] = 0
                _CACHES[key] = Cache(lambda p: len(tok.encode(p, add_special_tokens=False).ids), start=start)
            length = _CACHES[key].__getitem__
        for b in batches:
            texts = b.column(1)
            n_bytes, n_tokens = [], []
            for t in texts:
                text = t.as_py() or ""
                n_bytes.append(len(text) if text.isascii() else len(text.encode()))
                n_tokens.append(sum(map(length, pieces(text))) if own else len(tok.encode(text, add_special_tokens=False).ids))
            n = pa.array(n_tokens, pa.int64())
            yield batch(doc_id=b.column(0), n_bytes=pa.array(n_bytes, pa.int64()), n_tokens=n, over_limit=pa.array([x > limit for x in n_tokens], pa.bool_()))

    return map_arrow(docs, count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
