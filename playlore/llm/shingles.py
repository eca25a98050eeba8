"""Word shingles as sorted arrays of 64-bit hashes, for code that runs inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words in a shingle.
SIZE = 5
_ODD = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a UTF-8 text: A-Z lowered, parted by ASCII white space."""
    words = text.lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(text: bytes | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of the windows of `size` words; of all words together if there are fewer; empty without words."""
    w = word_hashes(text or b"")
    if not len(w):
        return w
    span = min(size, len(w))
    h = np.full(len(w) - span + 1, span, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(span):
            h = _mixed(h * np.uint64(_ODD) + w[k : len(w) - span + 1 + k])
    return np.unique(h)
