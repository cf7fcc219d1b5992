"""What the searches over vectors share: usable rows as matrices, and the best hits of every request so far."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.rows import name


def floats(df: DataFrame, vector: str) -> Column:
    """The vector as an array of floats or doubles."""
    kind = df.schema[vector].dataType
    plain = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    return name(vector) if plain else name(vector).cast("array<double>")


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors: the places of those without a null or non-finite component, and their matrix (doubles).

    A null vector is in none.
    """
    import pyarrow.compute as pc

    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component is no number
    start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    for d in np.unique(size[size >= 0]):
        at = np.flatnonzero(size == d)
        m = flat[start[at][:, None] + np.arange(d)]
        fine = np.isfinite(m).all(1)
        yield at[fine], m[fine]


CHUNK_BYTES = 32 << 20


def chunks(parts: Iterator[tuple[np.ndarray, ...]], rows: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The parts' arrays, put together by the width of the last one, a matrix: `rows` rows at most, and CHUNK_BYTES of it."""
    held: dict[int, list] = {}
    waiting = 0

    def let_go() -> Iterator[tuple[np.ndarray, ...]]:
        for own in held.values():
            whole = [np.concatenate(x) for x in zip(*own, strict=True)]
            step = max(1, min(rows, CHUNK_BYTES // max(8, 8 * whole[-1].shape[1])))
            for lo in range(0, len(whole[-1]), step):
                yield tuple(x[lo : lo + step] for x in whole)
        held.clear()

    for part in parts:
        held.setdefault(part[-1].shape[1], []).append(part)
        waiting += max(len(part[-1]), rows * part[-1].nbytes // CHUNK_BYTES)
        if waiting >= rows:
            yield from let_go()
            waiting = 0
    yield from let_go()


class Best:
    """The k best (score, id) of each request, higher scores first, ties to the smaller id.

    `least` is the score that a further hit must reach: minus infinity, or the given floor, until k are known.
    """

    def __init__(self, requests: int, k: int, kind: type, floor: np.ndarray | None = None):
        low = -np.inf if kind is np.float64 else np.iinfo(kind).min
        self.k, self.least = k, np.full(requests, low, kind) if floor is None else floor.copy()
        self.request, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
        self.new: list[tuple] = []
        self.waiting = 0

    def add(self, request: np.ndarray, ids: np.ndarray, score: np.ndarray, at_once: bool = False) -> None:
        if len(request):
            self.new.append((request, ids, score))
            self.waiting += len(request)
        if self.waiting > 200_000 or at_once:
            self.settle()

    def settle(self) -> None:
        if not self.new:
            return
        r, i, s = (np.concatenate(x) for x in zip((self.request, self.id, self.score), *self.new, strict=True))
        self.new, self.waiting = [], 0
        order = np.lexsort((i, ~s if s.dtype == np.int64 else -s, r))
        r, i, s = r[order], i[order], s[order]
        first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        place = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
        near = place < self.k
        self.request, self.id, self.score = r[near], i[near], s[near]
        full = place == self.k - 1
        self.least[r[full]] = np.maximum(self.least[r[full]], s[full])


def bordered(requests: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best rows of each request (columns `by`) with their rank; each task has passed on k a request at most."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return requests.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
