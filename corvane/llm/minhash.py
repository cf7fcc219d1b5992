"""Near-duplicates by fast similarity sketching, banding and exact verification.

1. Each text's set of shingles (runs of `shingle` words) gets a sketch of 96 coordinates; texts with the same word
   sequence are one class.
2. Banding: classes that agree in all four coordinates of one of 24 bands are candidates. A pair at similarity s misses
   all bands with probability (1 - s^4)^24: 2.0e-8 at 0.85, 3.2e-6 at 0.8. Buckets are joined through their least
   member, so the candidate graph stays linear in the rows, and its components (clusters) hold every candidate pair.
3. Verification inside clusters, in blocks of bounded size: pairs whose sketches agree enough are checked on their full
   sets, most similar first, unless they are already linked. Members of a cluster that spans several blocks are dealt
   out twice by different hashes, which unites its bulk; whoever is still outside the largest part is then compared
   with the members of its own buckets, block against block, unless a bucket is of one part already. No candidate pair
   of different parts is left unchecked.
4. Components of the verified links; the least id stands for each.

Links: 100 * |A & B| >= limit * |A | B|. Defined cases: null, empty and word-less texts have no shingles and link with
nothing; fewer than `shingle` words are one shingle; equal rows are linked; a null id keeps a null component; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.components import components
from corvane.llm.rows import map_text, name
from corvane.llm.shingles import shingle_set, word_hashes
from corvane.llm.sketch import bands, fill, short
from corvane.scratch import dropped, few, small, stored

T, SHINGLE, LIMIT = 96, 5, 85  # op6 and the pipeline each pass their own words and percent
BLOCK_ROWS, BLOCK_BYTES = 512, 24 << 20
BROADCAST_ROWS = 1_000_000  # narrow rows; more are joined by shuffle


def _key(b: bytes) -> bytes:
    return hashlib.blake2b(b" ".join(b.split()), digest_size=16).digest()


def _sketches(shingle: int):
    def run(texts: list) -> list:
        keys, sizes, out = [], [], []
        known: dict[bytes, tuple] = {}
        for b in texts:
            b = (b or b"").lower()
            k = _key(b)
            if k not in known:
                s = shingle_set(word_hashes(b), shingle)
                known[k] = (k, len(s), bands(short(fill(s, T))).tolist()) if len(s) else (None, 0, None)
            got = known[k]
            keys.append(got[0]), sizes.append(got[1]), out.append(got[2])
        return [keys, sizes, out]

    return lambda: run


def _sets(shingle: int):
    def run(texts: list) -> list:
        keys, sets = [], []
        for b in texts:
            b = (b or b"").lower()
            keys.append(_key(b)), sets.append(shingle_set(word_hashes(b), shingle).tobytes())
        return [keys, sets]

    return lambda: run


def linked(a: np.ndarray, b: np.ndarray, limit: int) -> bool:
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if 100 * small < limit * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= limit * (len(a) + len(b) - both)


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.find(x)] = self.find(y)


def links(nodes: list, labels: list, sets: list, sketches: list, limit: int, left: int | None = None) -> list[tuple]:
    """Verified links that join different parts of a block; with `left`, only between rows before and after it."""
    m = len(nodes)
    k = np.array(sketches, np.int64).reshape(m, -1).view(np.uint16) if m else np.zeros((0, T), np.uint16)
    s = [np.frombuffer(x, np.uint64) for x in sets]
    size = np.array([len(x) for x in s])
    part, first = Union(m), {}
    for i, x in enumerate(labels):
        if x in first:
            part.join(i, first[x])
        else:
            first[x] = i
    # at the limit the agreeing coordinates have mean T * limit and deviation below sqrt(T) / 2; six of these below
    # are never met. Small sets, whose coordinates are less independent, are always checked.
    least = T * limit / 100 - 3 * np.sqrt(T) if limit >= 50 else 0
    cand = []
    for i in range(m if left is None else left):
        lo = i + 1 if left is None else left
        agree = (k[lo:] == k[i]).sum(1)
        ok = np.flatnonzero((agree >= least) | ((size[lo:] < 64) & (agree > 0)))
        cand += [(-int(agree[j]), i, lo + int(j)) for j in ok if nodes[lo + int(j)] != nodes[i]]
    out = []
    for _, i, j in sorted(cand):
        if part.find(i) != part.find(j) and linked(s[i], s[j], limit):
            part.join(i, j)
            out.append((nodes[i], nodes[j]))
    return out


def _linker(limit: int):
    """For applyInArrow: rows (label, node, side, sketch, shingles) of one block; links between sides, if it has two."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted({r["node"] if r["side"] is None else (r["side"], r["node"]): r for r in table.select(["label", "node", "side", "sketch", "shingles"]).to_pylist()}.values(), key=lambda r: (r["side"] or 0, r["node"]))
        left = sum(r["side"] == 0 for r in rows) if rows and rows[0]["side"] is not None else None
        found = links(*[[r[c] for r in rows] for c in ("node", "label", "shingles", "sketch")], limit, left)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", limit: int = LIMIT, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per document; links at `limit` percent of shingles of `shingle` words."""
    rows = map_text(docs.select(name(key).alias("_id"), name(text).alias("_text")), _sketches(shingle), "class binary, n long, sketch array<long>", "_text", ["_id"])
    rows = stored(rows.select(F.col("row._id").alias("doc_id"), "class", "n", "sketch"), "sketches")
    classes = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    banded = classes.select("node", F.posexplode("sketch").alias("band", "value"))
    buckets = banded.groupBy("band", "value").agg(F.min("node").alias("centre"), F.count("*").alias("members")).where("members > 1").select("band", "value", "centre")
    buckets = small(buckets, "buckets", BROADCAST_ROWS)
    near = banded.join(buckets, ["band", "value"]).where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    clusters = components(near).withColumnRenamed("root", "cluster")

    picked = stored(classes.join(clusters, "node").select("node", "cluster", "class", "least", "sketch"), "picked")
    texts = docs.select(name(key).alias("_id"), name(text).cast("string").alias("_text"))
    n = picked.count()
    if n <= BROADCAST_ROWS:  # then only the texts of candidates are shuffled
        texts = texts.join(F.broadcast(picked.select("least")), F.col("_id").eqNullSafe(F.col("least")), "left_semi")
    found = texts.join(picked, F.col("_id").eqNullSafe(F.col("least")))
    found = map_text(found, _sets(shingle), "own binary, shingles binary", "_text", ["node", "cluster", "class", "sketch"])
    written = members = stored(found.where("own = row.class").select("row.node", "row.cluster", "row.sketch", "shingles").dropDuplicates(["node"]), "members")

    sizes = members.groupBy("cluster").agg(F.count("*").alias("rows"), F.sum(F.length("shingles")).alias("bytes"))
    sizes = sizes.select("cluster", F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    members = members.join(small(few(sizes, n), "sizes", BROADCAST_ROWS), "cluster")  # written, which leaves a hot cluster to be split
    wide = members.where("blocks > 1")

    def dealt(salt: int) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(salt)), F.col("blocks")).cast("int")

    def resolve(part: DataFrame, salt: int) -> DataFrame:
        block = part.withColumn("block", dealt(salt)).select("cluster", "block", F.col("node").alias("label"), "node", F.lit(None).cast("int").alias("side"), "sketch", "shingles")
        return block.groupBy("cluster", "block").applyInArrow(_linker(limit), "a long, b long")

    verified, parts = stored(resolve(members, 0), "links"), None
    if wide.limit(1).count():
        verified = verified.union(stored(resolve(wide, 1), "links"))
        inside = verified.join(wide.select(F.col("node").alias("a")), "a", "left_semi")
        wide = parts = stored(wide.join(components(inside), "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root"), "wide")
        part = wide.groupBy("cluster", "label").agg(F.count("*").alias("k"))
        core = small(few(part.groupBy("cluster").agg(F.max_by("label", F.struct("k", "label")).alias("core")), n), "core", BROADCAST_ROWS)
        banded = stored(wide.join(core, "cluster").select("node", "label", (F.col("label") != F.col("core")).alias("out"), F.length("shingles").alias("bytes"), F.posexplode("sketch").alias("band", "value")), "banded")
        # buckets of several parts: every block of outsiders against every block of the bucket's members
        outside = F.when(F.col("out"), F.col("bytes"))
        count = banded.groupBy("band", "value").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(outside).alias("o"), F.sum(outside).alias("ob"), F.count("*").alias("m"), F.sum("bytes").alias("mb")).where("lo <> hi")
        blocks_of = lambda n, size: F.greatest(F.ceil(F.col(n) / BLOCK_ROWS), F.ceil(F.col(size) / BLOCK_BYTES)).cast("int")
        asked = banded.join(small(count.select("band", "value", blocks_of("o", "ob").alias("xs"), blocks_of("m", "mb").alias("ys")), "open", BROADCAST_ROWS), ["band", "value"])
        at = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = asked.where("out").select("band", "value", "node", at(3, "xs").alias("x"), every("ys").alias("y"), F.lit(0).alias("side"))
        right = asked.select("band", "value", "node", every("xs").alias("x"), at(4, "ys").alias("y"), F.lit(1).alias("side"))
        blocks = left.union(right).join(wide.select("node", "label", "sketch", "shingles"), "node")
        verified = verified.union(stored(blocks.groupBy("band", "value", "x", "y").applyInArrow(_linker(limit), "a long, b long"), "links"))

    dropped(written)
    if parts is not None:
        dropped(parts), dropped(banded)
    roots = components(verified)
    joined = classes.join(roots, "node", "left").select("class", "least", "copies", "root", F.coalesce("root", "node").alias("part"))
    ids = joined.where("root is not null").groupBy("part").agg(F.min("least").alias("component_id"))
    named = joined.join(ids, "part", "left").where("copies > 1 or root is not null").select("class", F.coalesce("component_id", "least").alias("component_id"))
    named = small(named, "named", BROADCAST_ROWS)  # classes of several rows or with links; any other row is its own component
    for x in (picked, classes):
        dropped(x)
    return rows.join(named, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
