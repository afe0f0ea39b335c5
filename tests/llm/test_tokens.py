"""Token counts and token files against the tokenizers library on whole texts."""

import zlib

import numpy as np
import pytest

from lumenfold.llm.pieces import Cache, encoder, tokenizer
from lumenfold.llm.token_counts import token_counts
from lumenfold.llm.token_files import BLOCK, read_segment, read_tokens, token_files, write_segment, write_tokens

from .data import SCHEMA, documents

WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"
ODD = ["<|endoftext|>", "a<|startoftext|>b <|endoftext|>", " a  b\t\tc\r\nd ", "I'll it's we've '", "É É Ä", "x\x1cy\x85z a b", "日本語 1234 ½", "A" * 500, "\u0000 ‍"]


def rows(seed=1):
    return documents(seed) + [(9000 + i, t, None, None, None, None) for i, t in enumerate(ODD)] + [(None, "no id", None, None, None, None)]


def ids(text, vocabulary):
    return tokenizer(vocabulary).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("vocabulary", [WORDS, BYTES])
def test_encoder(vocabulary):
    letters = [chr(c) for c in [*range(0x21, 0x250), 0x301, 0x3A3, 0x212A, 0x212B]]
    pieces = [*letters, *(f"A{c}b's{c}LL1" for c in letters), *(a + b for a in letters[:400:7] for b in letters[::5]), "ΟΔΟΣ", "<|endoftext|>x", "Word.", "it'Ll", ""]
    encode = encoder(vocabulary)
    assert [np.frombuffer(encode(p), "<u4").tolist() for p in pieces] == [ids(p, vocabulary) for p in pieces]


def test_cache_keeps_what_is_in_use():
    made = []
    cache = Cache(lambda p: made.append(p) or len(p), 3, {"": 0})
    for p in ["a", "bb", "ccc", "a", "dddd", "a", "", "x" * 100, "ee", "a", "f", "g"]:
        assert cache[p] == len(p)
        assert len(cache) <= 4
    assert made.count("a") == 1 and len(made) == 8


@pytest.mark.parametrize("vocabulary,table_size", [(WORDS, 1 << 15), (WORDS, 3), (BYTES, 10)])
def test_token_counts(spark, vocabulary, table_size):
    data = rows()
    got = token_counts(spark.createDataFrame(data, SCHEMA), vocabulary, 100, table_size, 8).collect()
    want = [(r[0], len((r[1] or "").encode()), len(ids(r[1], vocabulary))) for r in data]
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got), key=key) == sorted(((*w, w[2] > 100) for w in want), key=key)


def test_token_counts_empty(spark):
    assert token_counts(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("vocabulary,end", [(WORDS, 1), (BYTES, None)])
def test_token_files(spark, tmp_path, vocabulary, end):
    data = rows(2)
    path = f"file://{tmp_path}/tokens"
    write_tokens(spark.createDataFrame(data, SCHEMA), path, vocabulary, end)
    got = [tuple(r) for r in read_tokens(spark, path, with_ids=True).collect()]
    start, want = 0, []
    for r in sorted(data, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        own = ids(r[1], vocabulary) + ([] if end is None else [end])
        want.append((r[0], start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), own))
        start += len(own)
    key = lambda r: (r[1], r[2])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_token_files_empty(spark):
    assert token_files(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("n", [0, 1, BLOCK - 1, BLOCK, BLOCK + 1, 5000])
@pytest.mark.parametrize("top", [1, 2, 50_000, 2**32 - 1])
def test_segment_round_trip(n, top):
    rng = np.random.default_rng(n)
    values = rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
    values[rng.random(n) < 0.7] //= 1000
    assert read_segment(write_segment(values)).tolist() == values.tolist()


def test_segment_exceptions_are_patched():
    values = np.arange(BLOCK) % 4
    values[[5, 77]] = 40_000
    small = write_segment(values)
    assert read_segment(small).tolist() == values.tolist()
    assert len(small) < 100
