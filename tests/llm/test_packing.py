"""Packing: ids against the tokenizers library, bins against what bins must be."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lumenfold.llm.packing import best_fit, local_search, pack, packed, pieces_of, read_packed, write_packed
from lumenfold.llm.pieces import text_encoder

from .data import SCHEMA, documents
from .test_tokens import BYTES, ODD, WORDS, ids


@pytest.mark.parametrize("vocabulary", [WORDS, BYTES])
def test_ids(vocabulary):
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "᠎", "　", "a", "It's", "we'll", "'", "12", "½", "²x", "é", "ß.", "日本", "́", "word", ",", "_", "😀", "ªb", "<|endoftext|>", "ω", "ж", "한", "カ", "thenderation", "ſ", "'S"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(4000)] + ODD + ["", " ", " a", "a "]
    own = text_encoder(vocabulary)
    assert [own(t).tolist() for t in texts] == [ids(t, vocabulary) for t in texts]


def checked(bins, sizes, capacity):
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(b and sum(sizes[i] for i in b) <= capacity for b in bins)
    return len(bins)


@pytest.mark.parametrize("seed", range(30))
def test_local_search_packs_better(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 50, 2048])
    sizes = [min(capacity, max(1, int(rng.choice([rng.paretovariate(0.7), rng.uniform(1, capacity), capacity / 3])))) for _ in range(rng.randrange(1, 400))]
    least = -(-sum(sizes) // capacity)
    alone = [[i] for i in range(len(sizes))]
    squares = lambda bins: sum(sum(sizes[i] for i in b) ** 2 for b in bins)
    traded = local_search([list(b) for b in alone], sizes, capacity)
    first = best_fit(sizes, capacity)
    assert squares(traded) >= squares(alone)
    assert least <= checked(pack(sizes, capacity), sizes, capacity) <= checked(first, sizes, capacity)
    assert checked(traded, sizes, capacity) <= len(sizes)


def test_local_search_trades():
    """Bins that only a swap of one for one, of two for one, of one for two or a move completes."""
    for sizes, bins in (
        ([6, 3, 7, 2], [[0, 1], [2, 3]]),  # 6+3 and 7+2: 3 for 2 leaves 6+2, 7+3
        ([4, 2, 3, 6, 1], [[0, 1, 2], [3, 4]]),  # 2+3 for 6 makes 10
        ([7, 2, 2, 1, 3], [[0, 1], [2, 3, 4]]),  # 2 for 2+1 makes 10
        ([9, 1, 3], [[0], [1, 2]]),  # a move
    ):
        found = local_search([list(b) for b in bins], sizes, 10)
        assert max(sum(sizes[i] for i in b) for b in found) == 10, (sizes, found)


def test_bins_empty():
    """Two bins too many after a bad start; trades leave none."""
    sizes = [5, 5, 4, 6, 3, 7, 2, 8]
    found = local_search([[i] for i in range(8)], sizes, 10)
    assert checked(found, sizes, 10) == 4


def run(spark, tmp_path, data, vocabulary=BYTES, end=0, capacity=2048, **options):
    """The pieces of data, checked against its ids; the number of sequences and the least possible."""
    path = f"file://{tmp_path}/packed"
    frame = spark.createDataFrame(data, SCHEMA).repartition(3)
    write_packed(frame, path, vocabulary, end, capacity, **options)
    sequences = read_packed(spark, path)
    pieces = pieces_of(sequences).collect()
    got, own, places, filled = [], defaultdict(list), defaultdict(list), {}
    for s in sequences.collect():
        values, at = np.frombuffer(s.ids, "<u4").tolist(), 0
        for doc_id, row, piece, start, length in zip(s.doc_id, s.row, s.piece, s.start, s.length):
            own[row].append((piece, start, values[at : at + length], doc_id))
            at += length
        assert at == len(values) <= capacity
        filled[s.sequence_id] = at
    assert len(filled) == sequences.count()
    for p in pieces:
        places[p.sequence_id].append((p.offset, p.length))
        got.append((p.row, p.piece, p.start, p.length, p.ids_crc32))
    for sequence, spans in places.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == filled[sequence]
    assert sorted(got) == sorted((row, piece, start, len(v), zlib.crc32(np.array(v, "<u4").tobytes())) for row, parts in own.items() for piece, start, v, _ in parts)
    texts = []
    for parts in own.values():
        parts.sort()
        assert [p[0] for p in parts] == list(range(len(parts)))
        assert all(len(p[2]) == capacity for p in parts[1:])
        assert [p[1] for p in parts] == [sum(len(q[2]) for q in parts[:i]) for i in range(len(parts))]
        texts.append((parts[0][3], [v for p in parts for v in p[2]]))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [(r[0], ids(r[1], vocabulary) + ([] if end is None else [end])) for r in data]
    assert sorted(texts, key=key) == sorted((w for w in want if w[1]), key=key)
    return len(filled), -(-sum(len(w[1]) for w in want) // capacity)


@pytest.mark.parametrize("vocabulary,end,capacity,options", [(BYTES, 0, 2048, {}), (BYTES, 0, 64, {"block_tokens": 500}), (WORDS, None, 100, {"block_tokens": 1000})])
def test_packed(spark, tmp_path, vocabulary, end, capacity, options):
    data = documents(5, n=120) + [(9000 + i, t, None, None, None, None) for i, t in enumerate(ODD)] + [(None, "no id", None, None, None, None), (None, None, None, None, None, None)]
    n, least = run(spark, tmp_path, data, vocabulary, end, capacity, **options)
    assert n <= 1.05 * least + 1


def test_very_long_and_equal_documents(spark, tmp_path):
    data = [(1, "word " * 300_000, None, None, None, None)] + [(2, "and so on " * 200, None, None, None, None)] * 300 + [(i, "x", None, None, None, None) for i in range(10, 60)]
    n, least = run(spark, tmp_path, data)
    # three of the equal ones fit a sequence, and nothing else fills it
    assert least < n <= -(-300_001 // 2048) + 100 + 1


def test_empty(spark):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert packed(frame([])).collect() == []
    only = packed(frame([(7, None, None, None, None, None)])).collect()
    assert [(r.doc_id, r.piece, r.start, r.length, r.offset) for r in only] == [(7, 0, 0, 1, 0)]
