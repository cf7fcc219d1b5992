"""Substring dedup by seed and extend: repeated runs of words, found from winnowed anchors, are removed.

Winnowing: of the ANCHOR-word grams inside a window of `length` words, the one with the least hash is the window's
anchor. Equal windows have equal anchors, so only windows around anchors that occur twice can repeat. Every anchor
place owns the run of windows that chose it; its context is all the words of that run.

1. Seed: anchor places are counted by anchor; places of unique anchors go. Places of one anchor whose whole contexts
   agree repeat as a whole, so of these one place goes on for all.
2. Extend: the different contexts of an anchor are extended word by word, to the left and to the right, as far as
   another context of the anchor agrees. Contexts aren't paired: those that agree in the l words to the left are a class,
   in which neighbours in the order of the words to the right agree longest (`extended`). Where an anchor has over
   `CONTEXTS` contexts, its places list their windows instead, which are counted over all tasks, with the same result.
3. Keep: a match of `length` words or more is a maximal repeat. Words covered by one are removed; the others stay, joined
   by one space. Longer repeats have an anchor in each window, whose matches overlap and are united.

Windows are judged on the input. Defined cases: null and empty texts have no words and keep the empty string; texts
shorter than `length` keep all words; repeated rows repeat each other; rows of one id and different texts are different
rows; an empty table gives an empty result; input columns are carried in `row`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.rows import map_text, name, slices
from corvane.llm.shingles import mix, runs, word_hashes
from corvane.scratch import dropped, small, stored

LENGTH, ANCHOR = 35, 8
BROADCAST_ROWS = 1_000_000  # narrow rows; more are joined by shuffle
BROADCAST_BYTES = 64 << 20  # of rows with lists
CONTEXTS, GROUP_ROWS = 4096, 16_384  # contexts of an anchor that are extended in one task; contexts a task extends at once


class Spans:
    """Anchor places of a text: anchor and context hashes, place, first and last owned window, end of the context; the
    hashes of every window and word."""

    def __init__(self, b: bytes, length: int, gram: int):
        w = word_hashes(b)
        self.n = len(w)
        self.windows = runs(w, length)
        if not len(self.windows):
            self.words, self.anchor, self.context = w, self.windows, self.windows
            self.first = self.last = self.at = self.end = np.zeros(0, np.int64)
            return
        g = runs(w, gram)
        place = np.empty(len(self.windows), np.int64)
        view = np.lib.stride_tricks.sliding_window_view(g, length - gram + 1)
        for at in range(0, len(view), 65536):
            part = view[at : at + 65536]
            place[at : at + len(part)] = part.argmin(1) + np.arange(at, at + len(part))
        self.first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        self.last = np.append(self.first[1:], len(place)) - 1
        self.at = at = place[self.first]
        self.words, self.end = w, self.last + length
        self.anchor = g[at]
        shape = ((self.last - self.first) * 4096 + (at - self.first)).astype(np.uint64)
        self.context = mix(mix(self.windows[self.first]) * np.uint64(0x9E3779B97F4A7C15) + self.windows[self.last] + shape)


def _seeds(length: int, gram: int):
    def run(texts: list) -> list:
        import pyarrow as pa

        a, c, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [0]
        for b in texts:
            s = Spans(b or b"", length, gram)
            a.append(s.anchor.view(np.int64)), c.append(s.context.view(np.int64)), ends.append(ends[-1] + len(s.anchor))
        spans = pa.StructArray.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(c))], names=["a", "c"])
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)]

    return lambda: run


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many leading columns of two matrices agree, row by row."""
    differ = np.ones((len(x), x.shape[1] + 1), bool)
    differ[:, :-1] = x != y
    return differ.argmax(1)


def ids(*keys: np.ndarray) -> np.ndarray:
    """A number for each distinct row of `keys`."""
    order = np.lexsort(keys)
    out = np.zeros(len(order), np.int64)
    if len(order):
        out[order[1:]] = np.cumsum(np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0))
    return out


def extended(anchor: np.ndarray, left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """For every context, how far its matches with other contexts of its anchor reach to the left and to the right.

    left, right: words nearest the anchor first, of which the first n_left, n_right count. Matches with fewer than
    `need` words on both sides together don't count; a context without any gets -1, -1. All matches of a context hold
    the anchor, so together they cover one run of words.
    """
    reach_left, reach_right = np.full(len(anchor), -1), np.full(len(anchor), -1)
    rank = np.empty(len(anchor), np.int64)
    rank[np.lexsort(right.T[::-1])] = np.arange(len(anchor))
    live, part = np.arange(len(anchor)), ids(anchor)
    for taken in range(left.shape[1] + 1):
        if taken:
            keep = n_left[live] >= taken
            live = live[keep]
            part = ids(left[live, taken - 1], part[keep])
        order = np.lexsort((rank[live], part))
        live, part = live[order], part[order]
        pair = np.flatnonzero(part[1:] == part[:-1])
        if not len(pair):
            break
        x, y = live[pair], live[pair + 1]
        both = np.minimum(agreeing(right[x], right[y]), np.minimum(n_right[x], n_right[y]))
        best = np.full(len(live), -1)
        best[pair] = both
        best[pair + 1] = np.maximum(best[pair + 1], both)
        ok = (best >= 0) & (best + taken >= need)
        reach_left[live[ok]] = taken
        reach_right[live[ok]] = np.maximum(reach_right[live[ok]], best[ok])
        live, part = live[best >= 0], part[best >= 0]  # a context alone in its class stays alone
    return reach_left, reach_right


def _words(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A binary column of 64-bit words as a matrix, filled up with zeros, and the words of each row."""
    rows = column.to_pylist()
    n = np.array([len(r) // 8 for r in rows], np.int64)
    out = np.zeros((len(rows), width), np.uint64)
    out[np.arange(width) < n[:, None]] = np.frombuffer(b"".join(rows), np.uint64)
    return out, n


def _extender(length: int, gram: int):
    """For applyInArrow: contexts (d, a, known, at, left, right) of some anchors; matched runs of those not known."""

    def run(table):
        import pyarrow as pa

        cols = {c: table.column(c) for c in ("d", "a", "known", "at")}
        d, anchor, known, at = (cols[c].to_numpy() for c in cols)
        (left, n_left), (right, n_right) = (_words(table.column(c), length - gram) for c in ("left", "right"))
        lo, hi = extended(anchor, left, n_left, right, n_right, length - gram)
        found = (lo >= 0) & ~known.astype(bool)
        return pa.table({"d": pa.array(d[found], pa.int64()), "b": pa.array((at - lo)[found], pa.int32()), "e": pa.array((at + gram + hi)[found], pa.int32())})

    return run


def repeated(docs: DataFrame, text: str, key: str, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """The texts (d, their columns in `row`) and, by d, what is repeated: `whole` anchors' contexts and `spans` of words."""
    texts = docs.select(F.struct(*[name(c) for c in docs.columns]).alias("row"), name(text).cast("string").alias("_text"), F.xxhash64(name(key), F.xxhash64(name(text), F.lit(1))).alias("d"))
    spans = map_text(texts, _seeds(length, gram), "spans array<struct<a:long,c:long>>", "_text", ["d"])
    found = stored(spans.where(F.size("spans") > 0).select("row.d", "spans"), "spans")
    seeds = found.select("d", F.posexplode("spans").alias("j", "s")).select("d", "j", "s.a", "s.c")
    # rows that are counted small are broadcast; beyond, a written side leaves a hot anchor to be split
    often = seeds.groupBy("a").agg(F.count("*").alias("k")).where("k > 1").select("a")
    seeds = stored(seeds.join(small(often, "often", BROADCAST_ROWS), "a"), "seeds")
    dropped(found)

    contexts = seeds.groupBy("a", "c").agg(F.count("*").alias("k"), F.min(F.struct("d", "j")).alias("one"))
    contexts = stored(contexts, "contexts")
    mixed = small(contexts.groupBy("a").agg(F.count("*").alias("ways")).where("ways > 1").select("a", (F.col("ways") > CONTEXTS).alias("hot")), "mixed", BROADCAST_ROWS)
    again = small(contexts.where("k > 1").select("a", "c"), "again", BROADCAST_ROWS)
    whole = seeds.join(again, ["a", "c"], "left_semi").groupBy("d").agg(F.collect_set("j").alias("whole"))
    asked = contexts.join(mixed, "a").select("one.d", "one.j", "k", "hot").groupBy("d").agg(F.collect_list(F.struct("j", (F.col("k") > 1).alias("known"), "hot")).alias("asked"))
    asked = stored(asked, "asked")
    dropped(contexts)

    some = texts.select("_text", "d")
    rows, entries = asked.agg(F.count("*"), F.sum(F.size("asked"))).first()
    if rows <= BROADCAST_ROWS and 32 * rows + 40 * (entries or 0) <= BROADCAST_BYTES:  # then no text is shuffled
        pending = some.join(F.broadcast(asked), "d")
    else:
        if rows <= BROADCAST_ROWS:
            some = some.join(F.broadcast(asked.select("d")), "d", "left_semi")
        pending = some.join(asked, "d")

    def listing(batches):
        import pyarrow as pa

        types = {"d": pa.int64(), "a": pa.int64(), "known": pa.bool_(), "at": pa.int32(), "win": pa.int64(), "left": pa.binary(), "right": pa.binary()}
        for batch in (x for whole in batches for x in slices(whole, whole.column(1))):
            out: dict = {c: [] for c in types}
            for i, b, asks in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                s = Spans((b or "").encode(), length, gram)
                anchors, windows = s.anchor.view(np.int64), s.windows.view(np.int64)
                for x in asks:
                    j = x["j"]
                    first, at, end = int(s.first[j]), int(s.at[j]), int(s.end[j])
                    n = end - length + 1 - first if x["hot"] else 1
                    out["d"] += [i] * n
                    out["a"] += [int(anchors[j])] * n
                    out["known"] += [x["known"]] * n
                    if x["hot"]:
                        out["at"] += range(first, first + n)
                        out["win"] += windows[first : first + n].tolist()
                        out["left"] += [None] * n
                        out["right"] += [None] * n
                    else:
                        out["at"].append(at)
                        out["win"].append(None)
                        out["left"].append(s.words[first:at][::-1].tobytes())
                        out["right"].append(s.words[at + gram : end].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in types.items()], names=list(types))

    listed = stored(pending.select("d", "_text", "asked").mapInArrow(listing, "d long, a long, known boolean, at int, win long, left binary, right binary"), "listed")
    beside, counted = listed.where("win is null"), listed.where("win is not null")
    tasks = max(1, -(-beside.count() // GROUP_ROWS))  # anchors are dealt out by hash, all contexts of one together
    spans = beside.withColumn("g", F.pmod(F.xxhash64("a"), F.lit(tasks))).groupBy("g").applyInArrow(_extender(length, gram), "d long, b int, e int")
    twice = counted.groupBy("a", "win").agg(F.count("*").alias("k")).where("k > 1").select("a", "win")
    windows = counted.where("not known").join(twice, ["a", "win"], "left_semi").select("d", F.col("at").alias("b"), (F.col("at") + length).alias("e"))
    spans = spans.union(windows).groupBy("d").agg(F.collect_list(F.struct("b", "e")).alias("spans"))
    return texts, whole.join(spans, "d", "full")


def covered(s: Spans, whole: list | None, spans: list | None) -> np.ndarray:
    """Which words lie in maximal repeats."""
    edge = np.zeros(s.n + 1, np.int64)
    if whole:
        np.add.at(edge, s.first[whole], 1)
        np.add.at(edge, s.end[whole], -1)
    if spans:
        np.add.at(edge, [x["b"] for x in spans], 1)
        np.add.at(edge, [x["e"] for x in spans], -1)
    return np.cumsum(edge[:-1]) > 0


def substring_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, gram: int = ANCHOR, carry: list[str] | None = None) -> DataFrame:
    """`row` (the carried columns), n_words, n_removed, kept (the remaining text)."""
    carry = list(docs.columns if carry is None else carry)
    base = docs.select(*[name(c) for c in dict.fromkeys([*carry, key, text])])
    texts, places = repeated(base, text, key, length, gram)
    texts = texts.select(F.struct(*[F.col("row")[c].alias(c) for c in carry]).alias("row"), "_text", "d")
    places = stored(places, "places")
    held = places.select("d")
    rows, entries = places.agg(F.count("*"), F.sum(F.coalesce(F.size("whole"), F.lit(0)) + 4 * F.coalesce(F.size("spans"), F.lit(0)))).first()
    if rows <= BROADCAST_ROWS and 40 * rows + 8 * (entries or 0) <= BROADCAST_BYTES:  # then no text is shuffled
        joined = texts.join(F.broadcast(places), "d", "left").select("row", "_text", "whole", "spans")
    elif rows <= BROADCAST_ROWS:  # then only texts with places are shuffled
        none = texts.join(F.broadcast(held), "d", "left_anti").select("row", "_text", F.lit(None).cast("array<int>").alias("whole"), F.lit(None).cast("array<struct<b:int,e:int>>").alias("spans"))
        joined = texts.join(F.broadcast(held), "d", "left_semi").join(places, "d").select("row", "_text", "whole", "spans").union(none)
    else:
        joined = texts.join(places, "d", "left").select("row", "_text", "whole", "spans")
    out_type = T.StructType([joined.schema["row"], *T._parse_datatype_string("n_words long, n_removed long, kept string").fields])

    def cut(batches):
        import pyarrow as pa

        for batch in (x for whole in batches for x in slices(whole, whole.column(1))):
            n, removed, kept = [], [], []
            for b, whole, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = (b or "").encode().split()
                gone = 0
                if whole or spans:
                    out = covered(Spans((b or "").encode(), length, gram), whole, spans)
                    gone = int(out.sum())
                    words, all_words = [w for w, x in zip(words, out.tolist(), strict=True) if not x], len(words)
                else:
                    all_words = len(words)
                n.append(all_words), removed.append(gone), kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["row", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(cut, out_type)
