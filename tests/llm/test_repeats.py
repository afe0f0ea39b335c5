"""Substring and suffix-array dedup against plain dictionaries of windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from lumenfold.llm.substring_dedup import substring_dedup
from lumenfold.llm.suffix_dedup import BLOCK_RUNS, suffix_dedup
from lumenfold.llm.suffixes import common_prefixes, suffix_order

from .data import SCHEMA, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_words(rows, window):
    unique = dict(sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda x: x[0]))
    seen, out = set(), {}
    for doc_id, text in unique.items():
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[doc_id] = (doc_id, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return sorted(out[r[0]] for r in rows if r[0] is not None)


@pytest.mark.parametrize("seed,window", [(1, 20), (2, 20), (3, 6)])
def test_substring_dedup(spark, seed, window):
    rows = documents(seed)
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA), window)
    assert sorted(map(tuple, got.collect())) == plain_words(rows, window)


def test_substring_dedup_empty(spark):
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    assert substring_dedup(spark.createDataFrame([(None, "a b", None, None, None, None)], SCHEMA)).collect() == []


def plain_bytes(rows, window):
    unique = {r[0]: (r[1] or "").encode() for r in rows if r[0] is not None}
    seen = Counter(t[i : i + window] for t in unique.values() for i in range(len(t) - window + 1))
    out = {}
    for doc_id, text in unique.items():
        gone = bytearray(len(text))
        for i in range(len(text) - window + 1):
            if seen[text[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(c for c, g in zip(text, gone) if not g)
        out[doc_id] = (doc_id, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted(out[r[0]] for r in rows if r[0] is not None)


@pytest.mark.parametrize("seed,window,block_runs", [(1, 40, 1024), (2, 100, 2), (4, 12, 3)])
def test_suffix_dedup(spark, seed, window, block_runs):
    rows = documents(seed)
    got = suffix_dedup(spark.createDataFrame(rows, SCHEMA), window, block_runs=block_runs)
    assert sorted(map(tuple, got.collect())) == plain_bytes(rows, window)


def test_many_differing_runs_of_one_key(spark):
    """More differing runs around one passage than a block takes, at its real size, so keys are cut."""
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(500))
    other = lambda n: "".join(rng.choice("ijklmnop ") for _ in range(n))
    rows = [(i, other(40 + i % 50) + passage + other(20 + i % 70), None, None, None, None) for i in range(BLOCK_RUNS + 900)]
    rows += [(10_000 + i, rows[i * 7][1][20:530] + "tail", None, None, None, None) for i in range(200)]
    got = suffix_dedup(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect())) == plain_bytes(rows, 400)


def test_suffix_dedup_empty(spark):
    assert suffix_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("letters", [2, 3, 255])
def test_suffix_order(letters):
    rng = np.random.default_rng(letters)
    s = rng.integers(1, letters + 1, 300).astype(np.int16)
    s[100:180] = s[20:100]
    s[250:270] = 1
    texts = [tuple(s[i:].tolist()) for i in range(len(s))]
    want = sorted(range(len(s)), key=lambda i: texts[i])
    order = suffix_order(s, 300)
    assert order.tolist() == want
    for k in range(1, len(s)):
        a, b = texts[want[k - 1]], texts[want[k]]
        n = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common_prefixes(s, order, 300)[k] == n
