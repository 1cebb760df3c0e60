"""Word and shingle hashes of whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

from .runtime import hold

#: Entries of a worker's cache of word hashes; a full cache takes no more.
CACHE_ENTRIES = 300_000

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_ENTRIES and len(word) <= 64:
            self[word] = value
        return value


_hashes = _Hashes()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    hold("words", _hashes.clear)
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows of a text of word hashes h."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    size = len(h) - n + 1
    out = h[:size].copy()
    for k in range(1, n):
        out = mixed(out * _M1 + h[k : k + size])
    return mixed(out)


def shingles(text: str, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's n-word windows: words are
    separated by ASCII white space, A-Z are lower-cased; a text of fewer words
    is one window, one of none has none."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(word_hashes(words), min(n, len(words))))
