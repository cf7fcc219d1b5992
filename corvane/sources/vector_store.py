"""Stored vectors: matrix blocks with their norms, written once, partitioned by repository, searched block by block.

A block holds up to BLOCK_ROWS vectors of one length and one repository, and BLOCK_BYTES of them: Parquet's writer holds
100 rows before it looks at their size, its reader 4096 at once. Writing a repository again replaces its partition only. A
search for given repositories reads their partitions only; queries of a repository meet its own blocks alone. Blocks of
hashed texts hold only what isn't zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TYPES

from corvane.functions.vectors import DIMENSIONS
from corvane.operators.embedding import token_counts
from corvane.operators.retrieval import _merged, ranked

BLOCK_ROWS, BLOCK_BYTES, TEXTS = 4096, 512 << 10, 256
CELLS, GROUP_BYTES = 1_000_000, 16 << 20  # scores held at once; a row group, which a reader has whole


def blocks(records: DataFrame, key: str, vector: str = "vector", scope: Column | None = None) -> DataFrame:
    """(repo_id, dims, ids, vectors, norms) of records that have a key and a vector; components are kept in their precision.

    scope: the repository's column; without it all are of none (null).
    """
    kind = "bigint" if records.schema[key].dataType.typeName() in ("byte", "short", "integer", "long") else "string"
    arrow = pa.int64() if kind == "bigint" else pa.string()
    precision = np.float32 if records.schema[vector].dataType.elementType.typeName() == "float" else np.float64
    rows = records.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    rows = rows.select((F.lit(None) if scope is None else scope).cast("string").alias("repo_id"), F.col(key).cast(kind).alias("id"), F.col(vector))
    if scope is not None:
        rows = rows.hint("rebalance", "repo_id")  # few files a repository; a large one is split

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = waiting = 0

        def let_go() -> Iterator[pa.RecordBatch]:
            for (repo, dims), own in held.items():
                m = np.stack([v for _, v in own]).astype(precision)
                norms = np.sqrt((m.astype(np.float64) ** 2).sum(1))
                values = [[repo], [dims], [[i for i, _ in own]], [m.tobytes()], [norms.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.string(), pa.int32(), pa.list_(arrow), pa.binary(), pa.binary()), strict=True)], names=["repo_id", "dims", "ids", "vectors", "norms"])
            held.clear()

        for b in batches:
            for repo, i, v in zip(*(b.column(c) for c in range(3)), strict=True):
                x = v.values.to_numpy(zero_copy_only=False)
                if waiting >= BLOCK_ROWS or size + x.nbytes > BLOCK_BYTES:
                    yield from let_go()
                    size = waiting = 0
                held.setdefault((repo.as_py(), len(x)), []).append((i.as_py(), x))
                size, waiting = size + x.nbytes, waiting + 1
        yield from let_go()

    return rows.mapInArrow(run, f"repo_id string, dims int, ids array<{kind}>, vectors binary, norms binary")


def hashed(records: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Blocks (places, vectors, norms, ...) of the texts' token counts by hash bucket; a null text has none.

    places: row * dims + bucket, ascending, of every count that isn't zero; vectors has the counts.
    """
    kind = "bigint" if records.schema[key].dataType.typeName() in ("byte", "short", "integer", "long") else "string"
    arrow = pa.int64() if kind == "bigint" else pa.string()
    rows = records.where(F.col(key).isNotNull()).select(F.col(key).cast(kind).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, ids, held, size = token_counts(), [], [], 0

        def block() -> pa.RecordBatch:
            rows_, bucket, n = (np.concatenate(x) for x in zip(*held, strict=True))
            norms = np.sqrt(np.bincount(rows_, n.astype(np.float64) ** 2, len(ids)))
            values = [None, DIMENSIONS, ids, (rows_ * DIMENSIONS + bucket).astype("<i4").tobytes(), n.astype("<f4").tobytes(), norms.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.string(), pa.int32(), pa.list_(arrow), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["repo_id", "dims", "ids", "places", "vectors", "norms"])

        for b in batches:
            for lo in range(0, b.num_rows, TEXTS):
                part = b.slice(lo, TEXTS)
                m = counts(part.column(1).to_pylist())
                r, c = np.nonzero(m)
                new = part.column(0).to_pylist()
                more = 8 * len(r) + (sum(map(len, new)) if kind == "string" else 8 * len(new))
                if ids and (len(ids) + len(new) > BLOCK_ROWS or size + more > BLOCK_BYTES):
                    yield block()
                    ids, held, size = [], [], 0
                held.append((r + len(ids), c, m[r, c]))
                ids, size = ids + new, size + more
        if ids:
            yield block()

    return rows.mapInArrow(run, f"repo_id string, dims int, ids array<{kind}>, places binary, vectors binary, norms binary")


def save(found: DataFrame, folder: str) -> None:
    """Replaces the partitions of the repositories in `found`, which are blocks."""
    found.write.option("parquet.block.size", GROUP_BYTES).partitionBy("repo_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The stored blocks; repository ids stay text."""
    kinds = spark.read.parquet(folder).schema
    return spark.read.schema(TYPES.StructType([TYPES.StructField(f.name, TYPES.StringType() if f.name == "repo_id" else f.dataType) for f in kinds])).parquet(folder)


def search(store: DataFrame, queries: list[tuple], k: int, scoped: bool = False, digits: int = 6) -> DataFrame:
    """(query_id, record_id, score, rank): the k records of largest cosine for each query (id, vector[, repo_id]).

    Zero vectors score 0; a record is no hit of a query of another length, nor, if `scoped`, of another repository.
    Queries without id, vector or, if scoped, repository are left out.
    """
    queries = [q for q in queries if q[0] is not None and q[1] is not None and (not scoped or q[2] is not None)]
    names = np.array([q[0] for q in queries], np.int64)
    kind = store.schema["ids"].dataType.elementType.simpleString()
    places: dict[tuple, list] = {}
    for i, q in enumerate(queries):
        places.setdefault((str(q[2]) if scoped else None, len(q[1])), []).append(i)
    asked = {}
    for at, own in places.items():
        m = np.array([queries[i][1] for i in own], np.float64).reshape(len(own), at[1])
        asked[at] = np.array(own), m, np.sqrt((m * m).sum(1))
    if "places" not in store.columns:
        store = store.withColumn("places", F.lit(None).cast("binary"))
    if scoped:
        store = store.where(F.col("repo_id").isin(sorted({at[0] for at in asked})))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list = []
        for b in batches:
            for repo, dims, ids, vectors, norms, places in zip(*(b.column(c) for c in range(6)), strict=True):
                at = (repo.as_py() if scoped else None, d := dims.as_py())
                if at not in asked or k <= 0:
                    continue
                own, m, size = asked[at]
                ids, norms, raw = np.array(ids.as_py()), np.frombuffer(norms.as_py()), vectors.as_py()
                if places.is_valid:
                    places, raw = np.frombuffer(places.as_py(), "<i4"), np.frombuffer(raw, "<f4")
                else:
                    places, raw = None, np.frombuffer(raw, np.float32 if len(raw) == 4 * len(ids) * d else np.float64).reshape(len(ids), -1)
                step = max(1, min(BLOCK_ROWS, CELLS // len(own)))
                for lo in range(0, len(ids), step):
                    own_norms = norms[lo : lo + step]
                    if places is None:
                        x = raw[lo : lo + step].astype(np.float64)
                    else:
                        x = np.zeros((len(own_norms), d))
                        some = slice(*np.searchsorted(places, (lo * d, (lo + step) * d)))
                        x.reshape(-1)[places[some] - lo * d] = raw[some]
                    n = own_norms[:, None] * size[None, :]
                    scores = np.divide(x @ m.T, n, out=np.zeros(n.shape), where=n > 0)
                    best = _merged(best, np.round(scores, digits, out=scores) + 0.0, ids[lo : lo + step], k, own)
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(names[best[0]]), pa.array(best[1].tolist(), pa.int64() if kind == "bigint" else pa.string()), pa.array(best[2], pa.float64())], names=["query_id", "record_id", "score"])

    got = store.select("repo_id", "dims", "ids", "vectors", "norms", "places").mapInArrow(run, f"query_id long, record_id {kind}, score double")
    return ranked(got, k)


_KNOWN: dict[tuple, str] = {}


def indexed(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame], partitioned: bool = False) -> DataFrame:
    """The blocks that build() makes of the tables in `source`, made once a session: later searches read what was written."""
    from corvane.scratch import fresh

    at = spark.sparkContext.applicationId, source, name
    if at not in _KNOWN:
        path = fresh(spark, f"index-{name}")
        found = build()
        save(found, path) if partitioned else found.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
        _KNOWN[at] = path
    return load(spark, _KNOWN[at])
