"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1; a letter n-gram's vector is the
product of its letters' vectors, each rotated by its place; a text's vector is
the sum over its n-grams, and a language's prototype the sum over its training
texts. A text gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import batch, map_arrow

GRAM, BLANK, UNKNOWN = 3, 0x20, "und"
_SLICE_CHARS, _SLICE_DOCS, _COLUMNS = 1 << 19, 512, 1024

_LETTERS: dict = {}


def letter_vector(code: int, size: int, seed: int) -> np.ndarray:
    key = (code, size, seed)
    if key not in _LETTERS:
        if len(_LETTERS) > 4096:
            _LETTERS.clear()
        _LETTERS[key] = np.random.default_rng([seed, code]).integers(0, 2, size).astype(np.float32) * 2 - 1
    return _LETTERS[key]


class Grams:
    """The letter n-grams of some texts: for each one its text, and which it is.

    Letters are lower-cased; each run of other characters is one blank, and a
    text begins and ends with one.
    """

    def __init__(self, texts: list[str]):
        texts = [f" {t.lower()} " for t in texts]
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        used = np.zeros(0x110000, bool)
        used[codes] = True
        letters = np.array([BLANK] + [c for c in np.flatnonzero(used).tolist() if chr(c).isalpha()], np.int64)
        place = np.zeros(0x110000, np.int32)
        place[letters[1:]] = np.arange(1, len(letters))
        sym = place[codes]
        lengths = np.array([len(t) for t in texts])
        keep = sym > 0
        self.has_letter = np.add.reduceat(keep, np.cumsum(lengths) - lengths) > 0
        keep[1:] |= sym[:-1] > 0
        keep[np.cumsum(lengths) - lengths] = True
        text_of = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)[keep]
        sym = sym[keep].astype(np.int64)
        n, a = max(0, len(sym) - GRAM + 1), len(letters)
        key = np.zeros(n, np.int64)
        for j in range(GRAM):
            key = key * a + sym[j : j + n]
        inside = text_of[:n] == text_of[GRAM - 1 :]
        self.text_of, key = text_of[:n][inside], key[inside]
        if a**GRAM <= 1 << 22:
            there = np.zeros(a**GRAM, bool)
            there[key] = True
            kinds = np.flatnonzero(there)
            number = np.zeros(a**GRAM, np.int32)
            number[kinds] = np.arange(len(kinds))
            self.kind = number[key]
        else:
            kinds, self.kind = np.unique(key, return_inverse=True)
        self.n, self.letters, self.kinds = len(texts), letters, kinds

    def counts(self) -> Iterator[tuple[int, np.ndarray]]:
        """Of some kinds after others: the first one's number, and how often each text has each."""
        group = self.kind // _COLUMNS
        group = group.astype(np.uint16) if len(self.kinds) < _COLUMNS << 16 else group
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(-(-len(self.kinds) // _COLUMNS) + 1))
        for at, low, high in zip(range(0, len(self.kinds), _COLUMNS), cuts, cuts[1:]):
            here, width = order[low:high], min(_COLUMNS, len(self.kinds) - at)
            cell = self.text_of[here].astype(np.int64) * width + self.kind[here] - at
            yield at, np.bincount(cell, minlength=self.n * width).reshape(self.n, width).astype(np.float32)

    def parts(self, size: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Counts (text, kind) and vectors (kind, size) for some kinds after others."""
        own = np.stack([letter_vector(int(c), size, seed) for c in self.letters])
        turned = [np.roll(own, GRAM - 1 - j, 1) for j in range(GRAM)]
        for at, counts in self.counts():
            vectors, rest = np.ones((counts.shape[1], size), np.float32), self.kinds[at : at + counts.shape[1]]
            for j in reversed(range(GRAM)):
                rest, letter = np.divmod(rest, len(self.letters))
                vectors *= turned[j][letter]
            yield counts, vectors


def _some(rows: Iterable[tuple]) -> Iterator[list]:
    """Runs of rows (text first) of bounded length."""
    run, chars = [], 0
    for row in rows:
        if run and (chars + len(row[0]) > _SLICE_CHARS or len(run) >= _SLICE_DOCS):
            yield run
            run, chars = [], 0
        run.append(row)
        chars += len(row[0])
    if run:
        yield run


def fit(train: DataFrame, size: int = 2048, seed: int = 7) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit prototypes, from all of train (text, lang).

    Texts weigh alike, whatever their length. Each task sends one vector for each
    language it has seen; the driver gets one for each language.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for run in _some((t.as_py(), x.as_py()) for t, x in zip(b.column(0), b.column(1))):
                grams, langs = Grams([t for t, _ in run]), np.array([x for _, x in run], object)
                which = {x: langs == x for x in set(langs)}
                squares = np.zeros(grams.n)
                for _, counts in grams.counts():
                    squares += np.einsum("ij,ij->i", counts, counts, dtype=np.float64)
                weight = (grams.has_letter / np.sqrt(np.maximum(squares, 1))).astype(np.float32)
                for counts, vectors in grams.parts(size, seed):
                    for lang, rows in which.items():
                        got = (weight[rows] @ counts[rows]) @ vectors
                        sums[lang] = sums.get(lang, 0) + got.astype(np.float64)
        for lang, vector in sums.items():
            yield batch(lang=pa.array([lang]), vector=pa.array([vector], pa.list_(pa.float64())))

    parts = map_arrow(train.select("text", "lang").where("text is not null and lang is not null"), bundle, "lang string, vector array<double>")
    summed = parts.select("lang", F.posexplode("vector").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    rows = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v")).orderBy("lang").collect()
    vectors = np.array([[e.x for e in r.v] for r in rows], np.float64).reshape(len(rows), size)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    kept = norms[:, 0] > 0
    return [r.lang for r, k in zip(rows, kept) if k], (vectors[kept] / norms[kept]).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], extra: list[str] | None = None, seed: int = 7) -> DataFrame:
    """extra columns of docs, then lang_pred and score (the cosine, 0 if below 0).

    If the first of extra is a struct with a text, that is the text, else it is the column text.
    Null texts, texts without a letter, and all texts if nothing was learned,
    are "und" with score 0.
    """
    langs, prototypes = model
    size, extra = prototypes.shape[1], extra or ["doc_id"]
    first = docs.schema[extra[0]].dataType
    inside = isinstance(first, StructType) and "text" in first.names

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = [], []
            texts = b.column(0).field(first.names.index("text")) if inside else b.column(len(extra))
            for run in _some((t.as_py() or "",) for t in texts):
                grams = Grams([t for (t,) in run])
                vectors = np.zeros((grams.n, size), np.float32)
                for counts, of_kind in grams.parts(size, seed):
                    vectors += counts @ of_kind
                norms = np.linalg.norm(vectors, axis=1)
                cosines = vectors @ prototypes.T / np.where(norms > 0, norms, 1)[:, None]
                known = grams.has_letter & (norms > 0) & bool(langs)
                best = cosines.argmax(1) if langs else np.zeros(grams.n, int)
                names += [langs[j] if k else UNKNOWN for j, k in zip(best.tolist(), known.tolist())]
                top = cosines[np.arange(grams.n), best] if langs else np.zeros(grams.n)
                scores += np.where(known, np.clip(top, 0, 1), 0).astype(float).tolist()
            kept = {c: b.column(i) for i, c in enumerate(extra)}
            yield batch(**kept, lang_pred=pa.array(names, pa.string()), score=pa.array(scores, pa.float64()))

    chosen = docs.select(*extra) if inside else docs.select(*extra, F.col("text").cast("string").alias("text"))
    fields = StructType([*docs.select(*extra).schema, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return map_arrow(chosen, classify, fields)


def held_out() -> F.Column:
    """Whether crc32(doc_id as text) mod 4 is 2; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def language_id(docs: DataFrame, size: int = 2048, seed: int = 7) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs (doc_id, text, lang, ...).

    Learned from the rows that are not held out and have text and lang; a row
    without doc_id is held out of training and has held_out false. Repeated rows
    give repeated rows; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", held_out().alias("held_out"))
    model = fit(docs.where(~F.col("held_out")), size, seed)
    named = docs.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "text")
    return predict(named, model, ["doc_id", "held_out"], seed)
