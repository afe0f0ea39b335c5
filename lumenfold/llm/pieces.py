"""Pre-tokens of texts for tokenizers that drop white space.

Such a tokenizer encodes each run between blanks on its own, so a text's ids
are those of its runs in order; runs repeat, and one lookup per run replaces
most calls of the tokenizer.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

LONGEST = 64

_LOADED: dict = {}


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file by its name; any other path as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(name: str):
    """The tokenizers library's tokenizer, loaded once in each process."""
    if name not in _LOADED:
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(tokenizer_path(name))
        loaded.no_truncation()
        loaded.no_padding()
        _LOADED[name] = loaded
    return _LOADED[name]


def drops_space(name: str) -> bool:
    """Whether white space only separates pre-tokens and has no ids."""
    ids = lambda text: tokenizer(name).encode(text, add_special_tokens=False).ids
    return ids(" ") == [] and ids("a b") == ids("a") + ids("b") and ids(" \n a\tb\r") == ids("a b")


def pieces(text: str) -> list[str]:
    """Runs between blanks, tabs and line ends; may hold empty strings."""
    if "\n" in text:
        text = text.replace("\n", " ")
    if "\t" in text:
        text = text.replace("\t", " ")
    if "\r" in text:
        text = text.replace("\r", " ")
    return text.split(" ")


class Cache(dict):
    """make(piece), kept for short pieces.

    Once it holds most, what it holds becomes the former half, from which pieces
    still in use come back; so at most twice as many are held.
    """

    def __init__(self, make: Callable, most: int = 1 << 19, start: dict | None = None):
        super().__init__(start or {})
        self.make, self.most, self.start, self.former = make, most, start or {}, {}

    def __missing__(self, piece: str):
        value = self.former.get(piece)
        if value is None:
            value = self.make(piece)
        if len(piece) <= LONGEST:
            if len(self) >= self.most + len(self.start):
                self.former = dict(self)
                self.clear()
                self.update(self.start)
            self[piece] = value
        return value


# Characters that Unicode normalization keeps, whatever stands beside them, and
# whose lower case is one character that depends on no other.
_PLAIN = regex.compile("[\x21-\x7e\xa1-\u012f\u0131-\u017f]*")

# The byte-level alphabet: printable Latin-1 bytes stand for themselves, the
# others for the code points from 256 on.
_SELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SELF)}


def _word_pattern(name: str) -> tuple[str, list[str]] | None:
    """The pattern of a tokenizer's words and its added tokens, if it only composes,
    lower-cases, matches words and maps bytes before its BPE model; else None."""
    with open(tokenizer_path(name), encoding="utf-8") as f:
        spec = json.load(f)
    steps = lambda part, inner: (part or {}).get(inner, [part] if part else [])
    normal, before = steps(spec["normalizer"], "normalizers"), steps(spec["pre_tokenizer"], "pretokenizers")
    blanks = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    if not all(n == blanks or n["type"] in ("NFC", "Lowercase") for n in normal) or "Lowercase" not in [n["type"] for n in normal]:
        return None
    if [b["type"] for b in before] != ["Split", "ByteLevel"] or before[1]["use_regex"] or before[1]["add_prefix_space"]:
        return None
    split = before[0]
    if split["behavior"] != "Removed" or not split["invert"] or "Regex" not in split["pattern"]:
        return None
    if spec["model"]["type"] != "BPE" or spec["model"]["dropout"] or any(a["normalized"] or a["content"].isalpha() for a in spec["added_tokens"]):
        return None
    return split["pattern"]["Regex"], [a["content"] for a in spec["added_tokens"]]


# Characters that any version of Unicode puts into the same of the classes that byte-level tokenizers split by.
_SETTLED = re.compile("[\t\n\r\x20-\x7e\xa1-\u017f\u0391-\u03a1\u03a3-\u03a9\u03b1-\u03c9\u0410-\u044f\u2013-\u2022\u20ac\u3041-\u3093\u30a1-\u30f6\u4e00-\u9fa5\uac00-\ud7a3]*")
# What a byte-level tokenizer takes as one pre-token unless it says otherwise (fixed).
_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranked(name: str):
    """A byte-level tokenizer's vocabulary as one of ranks, and its added tokens; None for a tokenizer of another kind.

    Ranks do if ids rise in the order of the merges, as then the merge that
    comes first is the one that makes the least id.
    """
    with open(tokenizer_path(name), encoding="utf-8") as f:
        spec = json.load(f)
    before, model = spec["pre_tokenizer"] or {}, spec["model"]
    if spec["normalizer"] or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before["add_prefix_space"]:
        return None
    if model["type"] != "BPE" or model["dropout"] or model["continuing_subword_prefix"] or model["end_of_word_suffix"] or model.get("ignore_merges"):
        return None
    added = [a["content"] for a in spec["added_tokens"]]
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(set(made)):
        return None
    import tiktoken

    byte_of = {letter: b for b, letter in _BYTE_LETTERS.items()}
    ranks = {bytes(byte_of.get(ord(c), ord(c)) for c in token): i for token, i in model["vocab"].items() if token not in added}
    return tiktoken.Encoding(os.path.basename(name), pat_str=_PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}), added


def text_encoder(name: str) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids, by ranks where that gives what the tokenizer would: some five times faster for byte-level ones."""
    tok, found = tokenizer(name), _ranked(name)

    def encode(text: str) -> np.ndarray:
        if found and _SETTLED.fullmatch(text) and not any(token in text for token in found[1]):
            return np.array(found[0].encode_ordinary(text), "<u4")
        return np.array(tok.encode(text, add_special_tokens=False).ids, "<u4")

    return encode


def encoder(name: str) -> Callable[[str], bytes]:
    """A function from a piece to its ids, as little-endian unsigned 32-bit integers.

    A piece of plain Latin letters, digits and signs goes by words straight to
    the tokenizer's BPE model, for tokenizers that allow it; any other piece,
    and one with an added token, goes through the whole tokenizer.
    """
    tok = tokenizer(name)
    packed = lambda ids: struct.pack(f"<{len(ids)}I", *ids)
    whole = lambda piece: packed(tok.encode(piece, add_special_tokens=False).ids)
    found = _word_pattern(name)
    if found is None:
        return whole
    words, added, tokens = regex.compile(found[0]).findall, found[1], tok.model.tokenize

    def of_word(word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return packed([t.id for t in tokens(word)])

    known = Cache(of_word)

    def encode(piece: str) -> bytes:
        low = piece.lower()
        if low.isascii():
            if low.isalpha():
                return known[low]
            plain = low.isprintable()
        else:
            plain = _PLAIN.fullmatch(piece)
        if plain:
            for token in added:
                if token in piece:
                    return whole(piece)
            return b"".join([known[w] for w in words(low)])
        return whole(piece)

    return encode
