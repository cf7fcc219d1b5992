"""Fast similarity sketching: t coordinates filled by rounds of hashed bin placement."""

from __future__ import annotations

import numpy as np

from corvane.llm.shingles import mix


def fill(s: np.ndarray, t: int) -> np.ndarray:
    """The sketch of a non-empty set of 64-bit hashes.

    In round i < t every element falls into a random bin with value (i, hash); each bin keeps its least value. Rounds
    t to 2t - 1 put every element into bin i - t, so every coordinate fills. Later rounds can't change a filled bin,
    so work stops when all are filled. Two sets agree in a coordinate with probability equal to their Jaccard
    similarity, and the share of agreeing coordinates is concentrated as if coordinates were drawn independently.
    """
    out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    i, m = 0, len(s)
    while i < t:
        k = int(min(t - i, max(1, -(-2 * t // m))))
        h = mix(s[None, :] + (np.arange(i, i + k, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))[:, None])
        value = ((np.arange(i, i + k, dtype=np.uint64) << np.uint64(48))[:, None] | (h >> np.uint64(16))).ravel()
        bins = ((h & np.uint64(0xFFFF)) * np.uint64(t) >> np.uint64(16)).ravel().astype(np.int64)
        order = np.argsort(value)[::-1]
        new = np.full(t, np.iinfo(np.uint64).max, np.uint64)
        new[bins[order]] = value[order]  # the last written, the least, stays
        np.minimum(out, new, out=out)
        i += k
        if out.max() != np.iinfo(np.uint64).max:
            return out
    for j in np.flatnonzero(out == np.iinfo(np.uint64).max):
        r = t + int(j)
        shift = np.uint64(r * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)
        out[j] = (np.uint64(r) << np.uint64(48)) | (mix(s + shift).min() >> np.uint64(16))
    return out


def short(sketch: np.ndarray) -> np.ndarray:
    """The coordinates as 16-bit numbers: four make one 64-bit band, and equal coordinates stay equal."""
    return (mix(sketch) & np.uint64(0xFFFF)).astype(np.uint16)


def bands(sketch16: np.ndarray) -> np.ndarray:
    """Bands of four coordinates each, as 64-bit integers."""
    return sketch16.view(np.int64)
