"""Hashes of words and of word runs, by whole arrays."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Random 64-bit numbers for (place in the word, byte): a word's hash is the sum of its bytes' numbers (tabulation).
_TABLE = np.random.default_rng(20240517).integers(0, 1 << 64, (64, 256), np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(b: bytes) -> np.ndarray:
    """One 64-bit hash for each word (run of bytes other than \\x20 and \\x09-\\x0D)."""
    x = np.frombuffer(b, np.uint8)
    space = _SPACE[x]
    begins = ~space
    begins[1:] &= space[:-1]
    start = np.flatnonzero(begins)
    if not len(start):
        return np.zeros(0, np.uint64)
    return span_hashes(x, start, space)


def span_hashes(x: np.ndarray, start: np.ndarray, space: np.ndarray | None = None) -> np.ndarray:
    """One 64-bit hash for each span of bytes that begins at `start`, without the bytes marked in `space`."""
    place = np.arange(len(x)) - np.repeat(np.append(0, start), np.diff(np.concatenate(([0], start, [len(x)]))))
    value = _TABLE[place & 63, x]
    if place.max() > 63:
        value *= (2 * (place >> 6) + 1).astype(np.uint64)
    if space is not None:
        value[space] = 0
    return mix(np.add.reduceat(value, start))


def runs(w: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of n consecutive words (none if there are fewer), by doubling."""
    if len(w) < n:
        return np.zeros(0, np.uint64)
    have, h = 1, w
    while have < n:
        step = min(have, n - have)
        h = mix(h[: len(h) - step] * np.uint64(0x9E3779B97F4A7C15) + h[step:] + np.uint64(step))
        have += step
    return h


def shingle_set(w: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct run hashes; with fewer words, the whole sequence as one; without words none."""
    if not len(w):
        return w
    return np.unique(runs(w, min(n, len(w))) + np.uint64(min(n, len(w)) < n))
