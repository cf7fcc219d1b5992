"""Nearest neighbours by inner product through randomly rotated one-bit codes.

Index: every partition's vectors go to pages of PAGE_ROWS rows, written once. A page has a centre c, the mean of its rows.
A row o is stored as the signs of the rotated unit vector u of o - c, one bit a coordinate, and three numbers: the scale
|o - c| / a, where a is the inner product of u and its code; the length of the estimate's error; and c.(o - c).

Search: for a query q, code.(q - c) times the scale estimates (o - c).(q - c), without bias over rotations; its error is
|o - c| |q - c| sqrt(1 - a^2) / a / sqrt(D - 1) times a number that passes `width` very rarely (`width` = 3: about one in
a thousand, on the side that matters). Only rows whose estimate plus that error reaches the query's current kth score are
multiplied with the query exactly, in doubles, from the vectors stored beside the codes. The first page scores its
SEEDS * k rows of best estimate first, which sets the kth score.

So scores are exact and a true neighbour is missed only where its error passed the bound; tests measure recall. The
rotation is three rounds of random signs and a Hadamard transform, drawn from a fixed seed, over coordinates padded with
zeros to a power of two. Queries go with the tasks in blocks of BLOCK; each task passes on k hits a query at most.

Defined cases: rows with a null id or vector, a null or non-finite component, or only zeros take no part; vectors of another
length are no hit of a query; rows that share the query's id are no hit of it; other repeated rows are hits of their own,
and a repeated query asks again; ties go to the smaller id; fewer rows than k give all; an empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.dense import Best, bordered, chunks, floats, matrices
from corvane.llm.rows import bounded, name
from corvane.operators.retrieval import in_blocks
from corvane.scratch import stored

PAGE_ROWS, BLOCK, GROUP, PAIRS, SEEDS, WIDTH = 4096, 2048, 512, 16384, 8, 3.0
PAGE = "dims int, n int, centre binary, ids binary, codes binary, numbers binary, vectors binary"


def padded(d: int) -> int:
    return max(8, 1 << max(0, d - 1).bit_length())


def rotated(x: np.ndarray) -> np.ndarray:
    """The rows of x (doubles), padded and rotated; lengths and inner products stay."""
    size = padded(x.shape[1])
    out = np.zeros((len(x), size))
    out[:, : x.shape[1]] = x
    signs = np.random.default_rng(20250211).integers(0, 2, (3, size)) * 2.0 - 1
    for s in signs:
        out *= s
        step = 1
        while step < size:
            pairs = out.reshape(len(x), -1, 2, step)
            out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(x), size)
            step *= 2
        out /= np.sqrt(size)
    return out


def page(ids: np.ndarray, m: np.ndarray, kind: type) -> dict:
    """The codes of the rows of m, with what estimates need."""
    centre = m.mean(0)
    rest = rotated(m - centre)
    size = rest.shape[1]
    length = np.sqrt((rest**2).sum(1))
    a = np.abs(rest).sum(1) / np.sqrt(size) / np.where(length > 0, length, 1)
    a = np.where(length > 0, np.minimum(a, 1.0), 1.0)
    error = length * np.sqrt(1 - a * a) / a / np.sqrt(size - 1) + 1e-5 * length  # and what single precision rounds
    numbers = np.stack((length / a / np.sqrt(size), error, (m - centre) @ centre))
    return {"dims": m.shape[1], "n": len(m), "centre": centre.tobytes(), "ids": ids.tobytes(), "codes": np.packbits(rest > 0, axis=1).tobytes(), "numbers": numbers.tobytes(), "vectors": m.astype(kind).tobytes()}


def bit_index(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The pages of all usable rows (schema PAGE)."""
    bounded(df.sparkSession)
    rows = df.where(name(key).isNotNull()).select(name(key).cast("bigint").alias("id"), floats(df, vector).alias("v"))
    kind = np.float32 if rows.schema["v"].dataType.elementType.typeName() == "float" else np.float64

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for b in batches:
            for at, m in matrices(b.column(1)):
                some = (m != 0).any(1)
                if some.any():
                    yield b.column(0).to_numpy()[at[some]], m[some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, m in chunks(parts(batches), PAGE_ROWS):
            p = page(ids, m, kind)
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if k in ("dims", "n") else pa.binary()) for k, v in p.items()], names=list(p))

    return stored(rows.mapInArrow(run, PAGE), "pages")


class Asked:
    """A block's queries of one length, and their best hits so far."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, width: float):
        self.numbers, self.ids, self.q, self.width = numbers, ids, q, width
        self.turned = rotated(q)
        self.best = Best(len(q), k, np.float64)

    def visit(self, p: dict) -> None:
        n, d = p["n"], p["dims"]
        vectors = np.frombuffer(p["vectors"], np.float32 if len(p["vectors"]) == 4 * n * d else np.float64).reshape(n, d)
        ids, centre, numbers = np.frombuffer(p["ids"], np.int64), np.frombuffer(p["centre"]), np.frombuffer(p["numbers"]).reshape(3, n)
        size = padded(d)
        codes = np.unpackbits(np.frombuffer(p["codes"], np.uint8).reshape(n, -1), axis=1).astype(np.float32) * 2 - 1
        scale, error, offset = (x.astype(np.float32)[:, None] for x in numbers)
        away = rotated(centre[None, :])
        for lo in range(0, len(self.q), GROUP):
            asked = np.arange(lo, min(lo + GROUP, len(self.q)))
            turned = self.turned[asked] - away
            upper = codes @ turned.T.astype(np.float32)
            upper *= scale
            upper += offset
            first = self.best.least[asked] == -np.inf
            seeds = np.zeros((n, len(asked)), bool)
            if first.any():
                k = min(n, SEEDS * self.best.k + 1)  # one more: the query's own row may be among them
                at = np.argpartition(-upper[:, first], k - 1, axis=0)[:k]
                seeds[at, np.flatnonzero(first)[None, :]] = True
                self.rerank(ids, vectors, *np.nonzero(seeds), asked)
                self.best.settle()
            lengths = np.sqrt((turned**2).sum(1))
            upper += error * (self.width * lengths).astype(np.float32)
            upper += (self.q[asked] @ centre).astype(np.float32)
            floor = self.best.least[asked]
            floor = floor - 1e-5 * (np.abs(floor) + lengths * float(np.sqrt(size)))  # single precision never prunes
            wanted = ~(upper < floor.astype(np.float32)) & ~seeds  # what isn't a number is scored
            self.rerank(ids, vectors, *np.nonzero(wanted), asked)
        self.best.settle()

    def rerank(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray, asks: np.ndarray, asked: np.ndarray) -> None:
        """Adds the exact products of these rows and queries that reach the queries' kth score."""
        asks = asked[asks]
        other = ids[rows] != self.ids[asks]
        rows, asks = rows[other], asks[other]
        for lo in range(0, len(rows), PAIRS):
            r, a = rows[lo : lo + PAIRS], asks[lo : lo + PAIRS]
            score = (vectors[r].astype(np.float64) * self.q[a]).sum(1)
            good = score >= self.best.least[a]
            self.best.add(a[good], ids[r[good]], score[good])


def nearest(df: DataFrame, asked: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", width: float = WIDTH, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score): the k rows of largest inner product for every row that satisfies `asked`."""
    pages = bit_index(df, key, vector)
    queries = stored(df.where(asked & name(key).isNotNull()).select(F.monotonically_increasing_id().alias("number"), name(key).cast("bigint").alias("id"), floats(df, vector).cast("array<double>").alias("v")), "queries")

    def search(rows: list[tuple]) -> DataFrame:
        asks = []
        for at, m in matrices(pa.array([r[2] for r in rows], pa.list_(pa.float64()))):
            some = (m != 0).any(1)
            at, m = at[some], m[some]
            asks.append((np.array([rows[i][0] for i in at], np.int64), np.array([rows[i][1] for i in at], np.int64), m))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            live = {m.shape[1]: Asked(numbers, ids, m, k, width) for numbers, ids, m in asks if len(m)}
            for b in batches:
                for p in (r for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
                    if p["dims"] in live:
                        live[p["dims"]].visit(p)
            for x in live.values():
                if len(x.best.request):
                    yield pa.RecordBatch.from_arrays([pa.array(x.numbers[x.best.request]), pa.array(x.ids[x.best.request]), pa.array(x.best.id), pa.array(x.best.score)], names=["request", "query_id", "id", "score"])

        return bordered(pages.mapInArrow(run, "request long, query_id long, id long, score double"), k, "request")

    return in_blocks(queries, search, block).select("query_id", "rank", "id", "score")
