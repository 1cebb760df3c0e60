"""Whole-text token encoding with a bounded cache of pre-tokens.

The ids always equal those of the ``tokenizers`` library for the given
tokenizer definition with ``add_special_tokens=False`` and neither truncation
nor padding.  Most of a corpus is made of pre-tokens that were seen before, so
texts whose characters all lie below U+0250 are split here with the
tokenizer's own pre-token pattern and looked up in a cache; the library's model
encodes what the cache does not hold.  With a function for long pre-tokens of a
byte-level tokenizer every other text is split by the library's own
pre-tokenizer, around special tokens, and its pre-tokens are encoded alike.
Without one such texts go to the library whole, as do those of a tokenizer whose
normaliser or pre-tokenizer is not one of the two known shapes.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from importlib import import_module

import numpy as np

from .runtime import hold

# The pre-token patterns of the two known tokenizer shapes.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}

# Letters and numbers below U+0250 in terms of Python's re.
_NUMBERS = "²³¹¼½¾"
_L, _N, _O = rf"[^\W\d_{_NUMBERS}]", rf"[\d{_NUMBERS}]", r"(?:[^\s\w]|_)"
_WORD_RE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{_L}+|{_N}|{_O}+")
_BYTE_RE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{_L}+| ?{_N}+| ?{_O}+|\s+(?!\S)|\s+")
# Control characters are white space to some engines only.
_NO_CUT = re.compile(r" (?:\s|\Z)")
_PLAIN = re.compile(r"[\t\n\r -~\xa0-ɏ]*")

#: Entries and longest entry of each of a worker's caches; a full cache takes no more.
CACHE_ENTRIES = 400_000
CACHE_LENGTH = 64


def tokenizer_json(name_or_path: str) -> str:
    """The definition of a tokenizer, by path or by its public file name."""
    path = name_or_path
    if not os.path.exists(path):
        path = import_module("public_tokenizers").path(name_or_path)
    with open(path, encoding="utf-8") as f:
        return f.read()


@lru_cache(1)
def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = [""] * 256, 256
    for b in range(256):
        if b in kept:
            table[b] = chr(b)
        else:
            table[b] = chr(extra)
            extra += 1
    return table


def to_alphabet(data: bytes) -> str:
    return data.decode("latin-1").translate(_translation())


@lru_cache(1)
def _translation() -> dict[int, str]:
    return dict(enumerate(byte_alphabet()))


class _Cache(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= CACHE_LENGTH and len(self) < CACHE_ENTRIES:
            self[piece] = ids
        return ids


class Encoder:
    """ids(text): the little-endian unsigned 32-bit ids of a whole text."""

    def __init__(self, definition: str, long_piece=None):
        """long_piece: encodes a pre-token given as byte-alphabet string; used beyond CACHE_LENGTH bytes."""
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec = json.loads(definition)
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.long_piece = long_piece
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.shape = self._shape(spec)
        self.pieces, self.others = _Cache(self._piece), _Cache(self._mapped)
        self.words = _Cache(self._whole if self.shape == "words" else lambda word: self._whole(f" {word}"))

    def _shape(self, spec: dict) -> str | None:
        model, pre, norm = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        added = spec.get("added_tokens") or []
        if model.get("type") != "BPE" or model.get("dropout") or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            return None
        if norm is None and pre == BYTE_LEVEL | {"use_regex": True}:
            return "bytes"
        lower = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
        split = {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}
        if norm == lower and pre == {"type": "Sequence", "pretokenizers": [split, BYTE_LEVEL | {"use_regex": False}]}:
            return "words"
        return None

    def _piece(self, piece: str) -> bytes:
        return self._mapped(to_alphabet(piece.encode()))

    def _mapped(self, mapped: str) -> bytes:
        if self.long_piece and len(mapped) > CACHE_LENGTH:
            return self.long_piece(mapped)
        return np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()

    def pretokens(self, text: str) -> list[str] | None:
        """The pre-tokens of a text, or None where only the library may split it."""
        if self.shape is None or any(s in text for s in self.special) or not _PLAIN.fullmatch(text):
            return None
        if self.shape == "bytes":
            return _BYTE_RE.findall(text)
        return _WORD_RE.findall(text.lower()) if unicodedata.is_normalized("NFC", text) else None

    def split(self, text: str) -> Iterator[str | int]:
        """A text's pre-tokens in the byte alphabet, by the library's
        pre-tokenizer, and the ids of its special tokens."""
        special = sorted(self.special, key=len, reverse=True)
        for piece in re.split("(" + "|".join(map(re.escape, special)) + ")", text) if special else [text]:
            if piece in self.special:
                yield self.special[piece]
            elif piece:
                yield from (mapped for mapped, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece))

    def _whole(self, text: str) -> bytes:
        pieces = self.pretokens(text)
        if pieces is None:
            if self.long_piece and self.shape == "bytes":
                return b"".join(self.others[x] if isinstance(x, str) else np.array([x], "<u4").tobytes() for x in self.split(text))
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.pieces.__getitem__, pieces))

    def ids(self, text: str) -> bytes:
        """Neither shape has a pre-token, special token or normalisation that
        reaches across a cut before a space followed by other than white
        space; so the words between such cuts are encoded on their own."""
        if self.shape == "words":
            return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))
        if self.shape == "bytes" and not _NO_CUT.search(text):
            first, *rest = text.split(" ")
            return self._whole(first) + b"".join(map(self.words.__getitem__, rest))
        return self._whole(text)


@lru_cache(4)
def _encoder(definition: str) -> Encoder:
    return Encoder(definition)


def worker_encoder(definition: str) -> Encoder:
    """One encoder, and so one cache, for each Python worker and definition."""
    hold("encoder", _encoder.cache_clear)
    return _encoder(definition)


def ids_crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
