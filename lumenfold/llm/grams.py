"""Vectorised words and word n-grams over Arrow string batches.

Everything here works on one bounded slice of a batch at a time: the UTF-8
bytes of some documents laid end to end, word boundaries as index arrays, and
64-bit polynomial hashes from prefix sums, so no Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes outside [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower-cased.
_NOT_ALNUM = np.zeros(256, bool)
_NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes up to which a word is hashed from prefix sums. Texts of two letters in the order of Thue and Morse meet from 1,024 on, whatever the base.
PLAIN_BYTES = 256


class Rolling:
    """Hashes of arbitrary sub-sequences of up to some 700 symbols from prefix sums modulo 2**64.

    Longer ones may meet by their structure alone. What is hashed here is
    shorter: words up to PLAIN_BYTES, grams and runs of a few windows.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 62)) * 2 + 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.table = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = max(n, 2 * min(len(self._up), 1 << 22))
            up = np.full(size, self.base, np.uint64)
            down = np.full(size, self.inverse, np.uint64)
            up[0] = down[0] = 1
            self._up, self._down = np.cumprod(up), np.cumprod(down)
        return self._up[:n], self._down[:n]

    def prefix(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self._powers(len(values))[0], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = self._powers(len(prefix))
        return mix64((prefix[end] - prefix[start]) * down[start])


_A, _B = Rolling(11), Rolling(23)


@dataclass
class Words:
    """Words of a slice of documents.

    data: the documents' bytes; start, end: byte bounds of each word; first:
    index of each document's first word, with the total at the end.
    """

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self, second: bool = False) -> np.ndarray:
        r = _B if second else _A
        out = r.spans(r.prefix(r.table[self.data]), self.start, self.end)
        for i in np.flatnonzero(self.end - self.start > PLAIN_BYTES).tolist():
            digest = blake2b(self.data[self.start[i] : self.end[i]].tobytes(), digest_size=16).digest()
            out[i] = int.from_bytes(digest[8:] if second else digest[:8], "little")
        return out

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def has(self, k: int) -> np.ndarray:
        """For each word whether k words of its document start there."""
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.start))
        return left >= k

    def text(self, a: int, b: int) -> bytes:
        """Words a to b-1, joined by single spaces."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b]))


def gram_hashes(words: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """Hash of the k words from each position on (of fewer, at the very end)."""
    r = _B if second else _A
    prefix = r.prefix(words)
    at = np.arange(len(words))
    return r.spans(prefix, at, np.minimum(at + k, len(words)))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of rows of about limit bytes.

    Yields first row, row after the last, the rows' bytes and the rows' bounds
    in them. Nulls count as empty; a longer row stands alone.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield at, to, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def split_words(data: np.ndarray, bounds: np.ndarray, alnum: bool = False, lower: bool = False) -> Words:
    """Words between ASCII white space, or runs of letters and digits (alnum)."""
    data = _LOWER[data] if lower or alnum else data
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~(_NOT_ALNUM if alnum else _SPACE)[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    begins, ends = inside.copy(), np.zeros(n + 1, bool)
    begins[1:] &= ~inside[:-1] | edge[1:]
    ends[1:] = inside[:-1] & (~inside[1:] | edge[1:])
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return Words(data, start, end, np.searchsorted(start, bounds))


def sliding(values: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """best over values[i : i+width]; shorter by width-1 than values."""
    if len(values) < width:
        return values[:0]
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = best(out[: len(out) - step], out[step:])
        done += step
    return out


def window_minima(grams: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing: the least gram hash of each window of width grams.

    starts: positions where a whole window begins (all of one document).
    Returns each such window's minimum and the sorted positions that hold one.
    Equal minima of a window are all kept, so equal texts keep equal positions.
    """
    if not len(starts):
        return grams[:0], starts
    least = sliding(grams, width)[starts]
    top = np.zeros(len(grams), np.uint64)
    top[starts] = least
    padded = np.concatenate([np.zeros(width - 1, np.uint64), top])
    chosen = np.flatnonzero((sliding(padded, width, np.maximum) == grams) & (grams > 0))
    return least, chosen
