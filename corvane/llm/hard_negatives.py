"""Hard negatives by ball-tree branch and bound, over integer grids of the vectors.

1. Index: every partition's vectors, floor(`scale` * x), become ball trees of at most TREE_ROWS rows, written once; a label
   with several leaves' worth of rows gets trees of its own, so searches for or without it skip these at the root. A node
   is a centre, a radius and the least and largest label below it; a tree halves its rows, so its nodes follow from its
   number of rows.
2. Positives: the rows of an anchor's own label with the largest inner products.
3. Negatives: for each anchor and positive, the best rows of other labels whose score s lies in the window
   low * p <= 100 * s <= high * p of the positive's score p.

For an anchor q and a ball (c, r) all inner products lie in [q.c - |q| r, q.c + |q| r]. A node goes for a request if the
upper bound is strictly beneath the request's current kth score or the window's floor, if the lower bound is above the
window's ceiling, or if its labels can't serve. A request first scores its most promising leaf, which sets the kth score;
then the tree is descended level by level. Nothing is approximate: every row not pruned is scored in exact integers.

Anchors go in blocks of BLOCK with the tasks; each task passes on the k best of each request, which one exchange merges.
Anchors of any number are searched block after block. Trees are a written table, so a lost task reads its trees again.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take no part; vectors of
another length are no hit of an anchor; rows that share the anchor's id are no hit of it; other repeated rows are hits of
their own, and a repeated anchor asks again; ties go to the smaller id; a window of a negative score is empty; an
anchor without positives gives no row; an empty table gives an empty result. Components whose inner products may pass 64
bits raise an error, as no long can hold the score. Other columns are not read.
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

TREE_ROWS, LEAF, BLOCK, SCALE = 8192, 128, 2048, 256
TREE = "dims int, n int, ids binary, labels binary, grid binary, centres binary, radii binary, lowest binary, highest binary"


def grid(m: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers."""
    z = np.floor(m * float(scale))
    if len(z) and z.size and max(z.max(), -z.min()) >= 2.0**53:
        raise OverflowError("a component is too large for exact inner products")
    return z.astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and b: by doubles where no sum passes 2^53, else by 64-bit integers."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most >= 1 << 63:
        raise OverflowError("an inner product may pass 64 bits")
    return a @ b.T


def cuts(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin and end: level l halves n rows l times."""
    return (np.arange((1 << level) + 1, dtype=np.int64) * n) >> level


def depth(n: int) -> int:
    return max(0, -(-n // LEAF) - 1).bit_length()


def built(ids: np.ndarray, labels: np.ndarray, z: np.ndarray) -> dict:
    """A ball tree of these rows: each node's rows are halved along the line between two far ones."""
    n, order, x = len(z), np.arange(len(z)), z.astype(np.float64)
    levels = depth(n)
    for level in range(levels):
        c = cuts(n, level)
        middle = cuts(n, level + 1)[1::2]
        for s, e, m in zip(c[:-1], c[1:], middle, strict=True):
            own = x[order[s:e]]
            one = own[((own - own.mean(0)) ** 2).sum(1).argmax()]
            two = own[((own - one) ** 2).sum(1).argmax()]
            order[s:e] = order[s:e][np.argpartition(own @ (two - one), m - s)]
    ids, labels, z, x = ids[order], labels[order], z[order], x[order]
    centres, radii, low, high = [], [], [], []
    for level in range(levels + 1):
        c = cuts(n, level)
        centre = np.add.reduceat(x, c[:-1], axis=0) / np.diff(c)[:, None]
        away = np.sqrt(((x - np.repeat(centre, np.diff(c), axis=0)) ** 2).sum(1))
        centres.append(centre), radii.append(np.maximum.reduceat(away, c[:-1]))
        low.append(np.minimum.reduceat(labels, c[:-1])), high.append(np.maximum.reduceat(labels, c[:-1]))
    small = np.int32 if not z.size or np.abs(z).max() < 1 << 31 else np.int64
    parts = {"ids": ids, "labels": labels, "grid": z.astype(small), "centres": np.concatenate(centres), "radii": np.concatenate(radii), "lowest": np.concatenate(low), "highest": np.concatenate(high)}
    return {"dims": z.shape[1], "n": n} | {k: v.tobytes() for k, v in parts.items()}


def groups(labels: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of each tree: those of one label where it has several leaves' worth, all others together."""
    order = np.argsort(labels, kind="stable")
    rest = []
    for own in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1):
        if len(own) >= 4 * LEAF:
            yield from (own[lo : lo + TREE_ROWS] for lo in range(0, len(own), TREE_ROWS))
        else:
            rest.append(own)
    if rest and sum(map(len, rest)):
        rest = np.concatenate(rest)
        yield from (rest[lo : lo + TREE_ROWS] for lo in range(0, len(rest), TREE_ROWS))


def ball_trees(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """The ball trees of all usable rows, one a row (schema TREE)."""
    bounded(df.sparkSession)
    rows = df.where(name(key).isNotNull() & name(label).isNotNull()).select(name(key).cast("bigint").alias("id"), name(label).cast("bigint").alias("label"), floats(df, vector).alias("v"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for b in batches:
            for at, m in matrices(b.column(2)):
                if len(at):
                    yield b.column(0).to_numpy()[at], b.column(1).to_numpy()[at], grid(m, scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, z in chunks(parts(batches), 4 * TREE_ROWS):
            for own in groups(labels):
                tree = built(ids[own], labels[own], z[own])
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if k in ("dims", "n") else pa.binary()) for k, v in tree.items()], names=list(tree))

    return stored(rows.mapInArrow(run, TREE), "trees")


class Requests:
    """What a block of anchors asks of trees of one length of vectors, and the best hits so far.

    anchors: places in the block with their vectors, ids and labels. A request is (number, anchor's place, floor, ceiling).
    """

    def __init__(self, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, numbers: np.ndarray, own: np.ndarray, floor: np.ndarray, ceiling: np.ndarray, k: int, same: bool):
        self.q, self.ids, self.labels, self.numbers, self.own, self.ceiling, self.same = q, ids, labels, numbers, own, ceiling, same
        self.norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        self.best = Best(len(own), k, np.int64, floor)

    def visit(self, t: dict) -> None:
        n, d = t["n"], t["dims"]
        of = lambda key, kind: np.frombuffer(t[key], kind)
        z = of("grid", np.int32 if len(t["grid"]) == 4 * n * d else np.int64).reshape(n, d).astype(np.int64)
        self.rows = of("ids", np.int64), of("labels", np.int64), z
        centres, radii, low, high = of("centres", np.float64).reshape((2 << depth(n)) - 1, d), of("radii", np.float64), of("lowest", np.int64), of("highest", np.int64)
        levels, q = depth(n), self.q.T.astype(np.float64)
        c = cuts(n, levels)
        mine = self.labels[self.own]

        def useful(level: int, above: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            """Nodes by requests: which may still hold a hit; and the nodes' middle products."""
            at = slice((1 << level) - 1, (2 << level) - 1)
            middle = centres[at] @ q
            wide = radii[at][:, None] * self.norm[None, :]
            wide += 1e-9 * (np.abs(middle) + wide) + 1e-6  # rounding never prunes
            lo, hi = low[at][:, None], high[at][:, None]
            fits = ((lo <= mine) & (mine <= hi)) if self.same else ((lo != mine) | (hi != mine))
            fits &= (middle + wide)[:, self.own] >= self.best.least
            fits &= (middle - wide)[:, self.own] <= self.ceiling
            return fits if above is None else fits & np.repeat(above, 2, axis=0), middle

        leaves, middle = useful(levels, None)
        middle = np.where(leaves, np.minimum(middle[:, self.own], self.ceiling), -np.inf)
        first = middle.argmax(0)
        ready = np.flatnonzero(leaves[first, np.arange(len(first))])
        done = np.zeros(leaves.shape, bool)
        done[first[ready], ready] = True
        for leaf in np.unique(first[ready]):
            self.score(c[leaf], c[leaf + 1], ready[first[ready] == leaf])
        self.best.settle()
        open_nodes = None
        for level in range(levels + 1):
            open_nodes, _ = useful(level, open_nodes)
            if not open_nodes.any():
                return
        for leaf in np.flatnonzero((open_nodes & ~done).any(1)):
            self.score(c[leaf], c[leaf + 1], np.flatnonzero(open_nodes[leaf] & ~done[leaf]))
        self.best.settle()

    def score(self, s: int, e: int, asked: np.ndarray) -> None:
        """Adds the rows s to e that serve the asked requests."""
        ids, labels, z = (x[s:e] for x in self.rows)
        anchors, back = np.unique(self.own[asked], return_inverse=True)
        got = products(z, self.q[anchors])
        fits = (labels[:, None] == self.labels[anchors]) == self.same
        fits &= ids[:, None] != self.ids[anchors]
        got, fits = got[:, back], fits[:, back]
        fits &= (got >= self.best.least[asked]) & (got <= self.ceiling[asked])
        r, a = np.nonzero(fits)
        self.best.add(asked[a], ids[r], got[r, a])


def searched(trees: DataFrame, block: list[tuple], k: int, same: bool, scale: int) -> DataFrame:
    """(request, id, score, rank) of one block of (number, id, label, vector, requests); a request is (number, floor, ceiling)."""
    by_size: dict[int, list] = {}
    for (_, i, label, v, requests), z in zip(block, gridded(block, scale), strict=True):
        if z is not None and requests:
            by_size.setdefault(len(z), []).append((i, label, z, requests))
    asks = {}
    for d, rows in by_size.items():
        requests = [(n, at, lo, hi) for at, (*_, rs) in enumerate(rows) for n, lo, hi in rs]
        anchors = np.array([x[2] for x in rows], np.int64).reshape(len(rows), d), np.array([x[0] for x in rows], np.int64), np.array([x[1] for x in rows], np.int64)
        asks[d] = anchors, [np.array(x, np.int64) for x in zip(*requests, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = {d: Requests(*anchors, *requests, k, same) for d, (anchors, requests) in asks.items()}
        for b in batches:
            for t in (r for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
                if t["dims"] in live:
                    live[t["dims"]].visit(t)
        for x in live.values():
            if len(x.best.request):
                yield pa.RecordBatch.from_arrays([pa.array(x.numbers[x.best.request]), pa.array(x.best.id), pa.array(x.best.score)], names=["request", "id", "score"])

    return bordered(trees.mapInArrow(run, "request long, id long, score long"), k, "request")


def gridded(block: list[tuple], scale: int) -> list[np.ndarray | None]:
    """The grid vector of each row of a block; None where the vector takes no part."""
    out: list[np.ndarray | None] = [None] * len(block)
    for at, m in matrices(pa.array([r[3] for r in block], pa.list_(pa.float64()))):
        for i, z in zip(at, grid(m, scale), strict=True):
            out[i] = z
    return out


def hard_negatives(df: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for all rows that satisfy `anchor`.

    `positives` rows of the same label per anchor; for each the first `negatives` rows of other labels whose score is
    between `low` and `high` percent of the positive's.
    """
    trees = ball_trees(df, key, vector, label, scale)
    every = (-(1 << 63), (1 << 63) - 1)
    asked = df.where(anchor & name(key).isNotNull() & name(label).isNotNull())
    asked = stored(asked.select(F.monotonically_increasing_id().alias("number"), name(key).cast("bigint").alias("id"), name(label).cast("bigint").alias("label"), floats(df, vector).cast("array<double>").alias("v")), "anchors")
    near = in_blocks(asked, lambda b: searched(trees, [(*r, [(r[0], *every)]) for r in b], positives, True, scale), block)
    near = stored(near.select(F.col("request").alias("number"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.monotonically_increasing_id().alias("pair")), "positives")
    wanted = near.groupBy("number").agg(F.collect_list(F.struct("pair", "positive_score")).alias("pairs"))  # `positives` at most

    def windows(r: tuple) -> list[tuple]:
        return [(x.pair, -(-low * x.positive_score // 100), high * x.positive_score // 100) for x in r[4]]

    found = in_blocks(stored(asked.join(wanted, "number"), "windows"), lambda b: searched(trees, [(*r[:4], windows(r)) for r in b], negatives, False, scale), block)
    out = found.select(F.col("request").alias("pair"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank").join(near, "pair").join(asked.select("number", F.col("id").alias("anchor_id")), "number")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
