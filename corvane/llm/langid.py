"""Language ID by nearest centroid: TF-IDF vectors of byte 3-grams, several clustered centroids per language, cosine.

Each text becomes a vector of `dims` hashed counts of its byte 3-grams (A-Z and the common two-byte capitals folded,
runs of non-letters one space), damped by log(1 + tf), weighted by idf and scaled to length 1. Per language spherical
k-means makes `k` centroids. A text gets the language of the centroid with the highest cosine; it is `rejected` (a
column of its own; the nearest language is still given) when it lies farther from it than nearly all (`quantile`) of
that centroid's own training texts.

`sample` bounds the rows learned from: an equal share for every language there is, 20 at least, of those with the
smallest hashes of id and text; every row is predicted. Defined cases: null text or no letter: `und`, score 0; nothing to
learn from: `und` everywhere; equal cosines: the alphabetically first language; rows repeated in id and text teach once
and predict alike; rows with a null id teach like others where `keep` lets them; input columns are carried in `row`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.rows import map_text, name
from corvane.scratch import small

FIELDS = "lang_pred string, score double, rejected boolean"


def _classes() -> np.ndarray:
    """Bytes, letters folded to lower case, anything else that is ASCII made a space."""
    t = np.arange(256, dtype=np.uint8)
    t[: 0x80] = 32
    for a in range(26):
        t[65 + a] = t[97 + a] = 97 + a
    return t


def vectors(texts: list, dims: int) -> np.ndarray:
    """log(1 + tf) rows; 3-grams never cross texts."""
    table, out = _classes(), np.zeros((len(texts), dims), np.float32)
    shift = np.uint32(32 - int(dims).bit_length() + 1)
    for i, b in enumerate(texts):
        if not b:
            continue
        x = table[np.frombuffer(b" " + b + b" ", np.uint8)]
        after = x[:-1] == 0xC3  # Latin-1 capitals in UTF-8: C3 80..9E
        y = x[1:]
        y[after & (y >= 0x80) & (y <= 0x9E)] += 0x20
        x = x[np.concatenate(([True], (x[1:] != 32) | (x[:-1] != 32)))]
        if len(x) < 3:
            continue
        g = x.astype(np.uint32)
        h = (g[:-2] << np.uint32(16) | g[1:-1] << np.uint32(8) | g[2:]) * np.uint32(2654435761) >> shift
        out[i] = np.bincount(h, minlength=dims)[:dims]
    return np.log1p(out)


def has_letter(b: bytes | None) -> bool:
    return bool(b) and any(c.isalpha() for c in b.decode("utf-8", "replace"))


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts spread out (farthest first), so it needs no random numbers."""
    centres = [unit(x.mean(0))]
    near = x @ centres[0]
    while len(centres) < min(k, len(x)):
        centres.append(x[int(np.argmin(near))])
        near = np.maximum(near, x @ centres[-1])
    c = np.stack(centres)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, 1)
        c = np.stack([unit(x[own == j].mean(0)) if (own == j).any() else c[j] for j in range(len(c))])
    return c


class Model:
    def __init__(self, langs: list[str], centroids: np.ndarray, idf: np.ndarray, floors: np.ndarray):
        self.langs, self.centroids, self.idf, self.floors = langs, centroids, idf, floors

    def predictor(self):
        langs, c, idf, floors, dims = self.langs, self.centroids, self.idf, self.floors, len(self.idf)

        def predict(texts: list) -> list:
            pred, score, rejected = [], [], []
            for at in range(0, len(texts), 512):
                part = texts[at : at + 512]
                cos = unit(vectors(part, dims) * idf) @ c.T if len(c) else np.zeros((len(part), 0))
                for b, row in zip(part, cos, strict=True):
                    if not len(row) or not has_letter(b):
                        pred.append("und"), score.append(0.0), rejected.append(True)
                        continue
                    j = int(np.argmax(row))
                    pred.append(langs[j]), score.append(float(min(1.0, max(0.0, row[j])))), rejected.append(bool(row[j] < floors[j]))
            return [pred, score, rejected]

        return predict


def train_rows(docs: DataFrame, keep: Column, sample: int, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """(_id, lang, text) rows to learn from: about `sample` in all, the same number for each language.

    A row's hash is compared with its language's share, so no language's rows are ordered or meet in one task.
    """
    rows = docs.select(name(key).alias("_id"), name(lang).cast("string").alias("lang"), name(text).cast("string").alias("text")).where("lang is not null and text is not null").where(keep)
    known = small(rows.groupBy("lang").agg(F.count("*").alias("n")), "langs")
    share = max(20, sample // max(1, known.count()))
    h = F.xxhash64("_id", F.xxhash64("text"), F.lit(29))
    drawn = rows.withColumn("h", h).join(known, "lang").where(F.col("h") / F.lit(float(1 << 64)) + 0.5 < F.lit(float(share)) / F.col("n"))
    return drawn.groupBy("lang", "h").agg(F.first("_id").alias("_id"), F.first("text").alias("text")).select("_id", "lang", "text")


def learn(train: DataFrame, k: int = 4, dims: int = 8192, quantile: float = 0.005) -> Model:
    """Centroids from (lang, text) rows, whose number the caller has bounded. Vectors are made on the executors."""

    def make():
        def run(texts: list) -> list:
            keep = []
            for b in texts:
                v = vectors([b], dims)[0] if has_letter(b) else np.zeros(dims, np.float32)
                at = np.flatnonzero(v)
                keep.append(at.astype("<u2").tobytes() + v[at].astype("<f2").tobytes())
            return [keep]

        return run

    rows = map_text(train, make, "sparse binary", "text", ["_id", "lang"]).select("row.lang", "sparse", "row._id").toPandas()  # sparse rows
    rows = rows.sort_values(["lang", "_id", "sparse"], kind="stable")
    x = np.zeros((len(rows), dims), np.float32)
    for i, b in enumerate(rows["sparse"]):
        n = len(b) // 4
        x[i, np.frombuffer(b, "<u2", n)] = np.frombuffer(b, "<f2", n, 2 * n)
    lang = rows["lang"].to_numpy()
    used = x.any(1)
    x, lang = x[used], lang[used]
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    x = unit(x * idf)
    langs, centroids, floors = [], [], []
    for v in sorted(set(lang)):
        own = x[lang == v]
        c = cluster(own, k)
        cos = own @ c.T
        near = cos.argmax(1)
        for j in range(len(c)):
            mine = cos[near == j, j]
            langs.append(str(v)), centroids.append(c[j]), floors.append(float(np.quantile(mine, quantile)) if len(mine) else 0.0)
    return Model(langs, np.stack(centroids) if centroids else np.zeros((0, dims), np.float32), idf, np.array(floors))


def language_id(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`row` and the columns of FIELDS for every row."""
    return map_text(docs, model.predictor, FIELDS, text, carry)
