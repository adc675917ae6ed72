"""Words and word shingles of a text as 64-bit hashes, in numpy.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII characters of the lower-cased text.
Hashes depend on the bytes alone, so that every executor computes the same.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_U = np.uint64
_POWERS = np.ones(1, np.uint64)
_BASE, _GOLD = _U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED03)
_IN_WORD = np.zeros(256, bool)
_IN_WORD[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789_":
    _IN_WORD[_c] = True


def wrapped(a: int, b: int) -> np.uint64:
    """a * b modulo 2**64."""
    return _U(int(a) * int(b) & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 2 * len(_POWERS)), _BASE, np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS


def word_hashes(text: str | None) -> np.ndarray:
    """One hash a word, in order; empty for null, empty or wordless texts."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _IN_WORD[raw]
    turns = np.flatnonzero(np.diff(inside))
    starts, lengths = turns[::2], turns[1::2] - turns[::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    kept = raw[inside[1:-1] > 0].astype(np.uint64) + _U(1)
    first = np.cumsum(lengths) - lengths
    at = np.arange(len(kept)) - np.repeat(first, lengths)
    return mix(np.add.reduceat(kept * _powers(int(lengths.max()))[at], first) + lengths.astype(np.uint64) * _GOLD)


def shingle_hashes(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """One hash for each run of k words; a shorter text is one shingle, a text without words has none."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    total = np.full(n - k + 1, wrapped(k, _GOLD), np.uint64)
    for j in range(k):
        total += mix(words[j : n - k + 1 + j] + wrapped(j + 1, _BASE)) * _U(2 * j + 1)
    return mix(total)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and how often each occurs."""
    return np.unique(shingle_hashes(word_hashes(text)), return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags; 0 if one of them is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)
