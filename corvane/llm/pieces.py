"""Texts cut into pieces by whole arrays: what a byte-level tokenizer's pattern matches, one after another.

`PATTERN` is cut by the classes of its code points; any other pattern by the regex module. Both give the same pieces.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corvane.llm.shingles import span_hashes

#: Fixed value: the pattern that is cut without a regular-expression engine.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE, LETTER, NUMBER, OTHER = range(4)


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    every = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
    out = np.full(0x110000, OTHER, np.uint8)
    for k, p in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        out[np.frombuffer("".join(regex.findall(p, every)).encode("utf-32-le"), np.uint32)] = k
    return out


def starts(cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a piece of PATTERN starts at each code point; ends: where each text ends."""
    n, kind = len(cp), classes()[cp]
    first = np.zeros(n + 1, bool)
    first[0] = True
    first[ends] = True
    first = first[:n]
    new = first.copy()
    new[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # of white space before something else, the last character is a piece of its own, or belongs to it if it is a blank
    run = np.flatnonzero(new & ~space & ~first)
    last = run[space[run - 1]] - 1
    new[last] = True
    new[last[cp[last] == 32] + 1] = False
    # an apostrophe that starts a piece takes the letters of a contraction with it
    q = np.flatnonzero((cp == 39) & new)
    q = q[q + 1 < n]
    q = q[~first[q + 1]]
    a, after = cp[q + 1], np.minimum(q + 2, n - 1)
    b = np.where((q + 2 < n) & ~first[after], cp[after], 0)
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    for at, size in ((q[one], 2), (q[two], 3)):
        new[at + 1] = False
        new[(at + size)[at + size < n]] = True
    return new


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each ends (nulls are empty)."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets[1:] - offsets[0]


def cut(texts: pa.Array, pattern: str) -> tuple[pa.Array, np.ndarray]:
    """All pieces (binary) and, for each text, the place of its first piece."""
    raw, ends = joined(texts)
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else ends
    if not len(raw):
        return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
    if pattern == PATTERN:
        cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        if len(cp) == len(raw):
            at = np.flatnonzero(starts(cp, ends))
        else:
            lead = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # the byte of every code point
            at = lead[np.flatnonzero(starts(cp, np.searchsorted(lead, ends)))]
    else:
        import regex

        split, found = regex.compile(pattern).findall, []
        for a, z in zip(begins.tolist(), ends.tolist(), strict=True):
            sizes = [len(w.encode()) for w in split(raw[a:z].tobytes().decode("utf-8"))]
            if sum(sizes) != z - a:
                raise ValueError("the pattern leaves out characters")
            found.append(a + np.cumsum([0, *sizes[:-1]])[: len(sizes)])
        at = np.concatenate(found).astype(np.int64)
    offsets = np.append(at, len(raw)).astype(np.int32)
    arr = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])
    return arr, np.searchsorted(at, begins)


def hashes(words: pa.Array, part: int = 1 << 16) -> np.ndarray:
    """A 64-bit hash of each binary value (none of them empty), `part` values at a time."""
    out = np.zeros(len(words), np.uint64)
    for lo in range(0, len(words), part):
        some = words.slice(lo, part)
        offsets = np.frombuffer(some.buffers()[1], np.int32)[some.offset : some.offset + len(some) + 1]
        out[lo : lo + len(some)] = span_hashes(np.frombuffer(some.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0])
    return out


class Known:
    """Distinct pieces and their ids, in arrays: found by hash, then compared, so that none is mistaken for another."""

    def __init__(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray):
        """ids: those of the first word, then of the second, ...; sizes: how many each has."""
        h = hashes(words)
        order = np.argsort(h, kind="stable")
        self.hash, self.words = h[order], words.take(pa.array(order))
        begin, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
        self.begin = np.append(0, np.cumsum(size)).astype(np.uint32 if len(ids) < 1 << 32 else np.uint64)
        self.ids = np.empty(len(ids), np.uint16 if len(ids) and ids.max() < 1 << 16 else np.int32)
        for lo in range(0, len(order), 1 << 16):
            n, b = size[lo : lo + (1 << 16)], begin[lo : lo + (1 << 16)]
            at = int(self.begin[lo])
            self.ids[at : at + n.sum()] = ids[np.repeat(b - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def find(self, pieces: pa.Array) -> np.ndarray:
        """The place of each piece, or -1."""
        out = np.full(len(pieces), -1, np.int64)
        if len(self.hash) and len(pieces):
            h = hashes(pieces)
            at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            maybe = np.flatnonzero(self.hash[at] == h)
            same = pc.equal(pieces.take(pa.array(maybe)), self.words.take(pa.array(at[maybe]))).to_numpy(zero_copy_only=False)
            out[maybe[same]] = at[maybe[same]]
        return out

    def spans(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of places begin, and their number; none for -1."""
        begin = self.begin[at].astype(np.int64)
        return begin, np.where(at < 0, 0, self.begin[at + 1].astype(np.int64) - begin)
