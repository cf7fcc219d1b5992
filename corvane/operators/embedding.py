"""Embeddings from a chosen provider: a model is loaded once a task and sees bounded batches of texts.

A provider is a name and a function make(), called where a task first needs it, which returns the function from a list of
texts to a matrix of one row each. `hash` is built in and the default; others are given. Rows may name their provider.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.vectors import DIMENSIONS

Make = Callable[[], Callable[[list[str]], np.ndarray]]
BATCH_TEXTS, BATCH_CHARS = 256, 4_000_000


def token_counts(dims: int = DIMENSIONS) -> Callable[[list[str]], np.ndarray]:
    """Texts to counts of their tokens by hash bucket."""
    token = re.compile(T.TOKEN)

    class Buckets(dict):
        def __missing__(self, w: str) -> int:
            if len(self) > 200_000:
                self.clear()
            self[w] = int.from_bytes(hashlib.sha256(w.encode()).digest()[:4], "big") % dims
            return self[w]

    known = Buckets()

    def embed(texts: list[str]) -> np.ndarray:
        sizes: list[int] = []

        def words() -> Iterator[list[str]]:
            for t in texts:
                found = token.findall(t)
                sizes.append(len(found))
                yield found

        at = np.fromiter(map(known.__getitem__, chain.from_iterable(words())), np.int64)
        at += np.repeat(np.arange(len(texts)) * dims, sizes)
        return np.bincount(at, minlength=len(texts) * dims).reshape(len(texts), dims).astype(np.float64)

    return embed


def hash_vectors(dims: int = DIMENSIONS) -> Make:
    """The built-in provider: token counts by bucket, brought to length 1."""

    def make() -> Callable[[list[str]], np.ndarray]:
        counts = token_counts(dims)

        def embed(texts: list[str]) -> np.ndarray:
            m = counts(texts)
            size = np.linalg.norm(m, axis=1, keepdims=True)
            return m / np.where(size > 0, size, 1)

        return embed

    return make


def embedded(df: DataFrame, text: str = "text", provider: Column | str = "hash", providers: dict[str, Make] | None = None, vector: str = "vector", batch: int = BATCH_TEXTS) -> DataFrame:
    """df with a column `vector` (array<float>) of each text's embedding; a null text is embedded as the empty one.

    provider: one for all rows, or a column that names each row's; an unknown one fails the job.
    """
    known = {"hash": hash_vectors()} | (providers or {})
    if isinstance(provider, str) and provider not in known:
        raise ValueError(f"no provider {provider}; known: {', '.join(sorted(known))}")
    named = F.lit(provider) if isinstance(provider, str) else F.coalesce(provider, F.lit("hash"))
    rows = df.select(F.struct(*df.columns).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), named.alias("provider"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live: dict[str, Callable] = {}
        for b in batches:
            texts, names = b.column(1).to_pylist(), b.column(2).to_pylist()
            out: list = [None] * len(texts)
            for name in dict.fromkeys(names):
                if name not in live:
                    if name not in known:
                        raise ValueError(f"no provider {name}")
                    live[name] = known[name]()
                part: list[int] = []
                for i in [*(i for i, x in enumerate(names) if x == name), None]:
                    if part and (i is None or len(part) >= batch or sum(len(texts[j]) for j in part) + len(texts[i]) > BATCH_CHARS):
                        for j, v in zip(part, np.asarray(live[name]([texts[j] for j in part]), np.float32), strict=True):
                            out[j] = v
                        part = []
                    if i is not None:
                        part.append(i)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32()))], names=["row", "vector"])

    schema = rows.select("row", F.array().cast("array<float>").alias("vector")).schema
    return rows.mapInArrow(run, schema).select("row.*", F.col("vector").alias(vector))
