"""Byte-level BPE: ranked merges folded over the bytes of distinct words by Spark's higher-order functions.

A text is cut by the pattern; equal pieces have equal ids, so every distinct piece is encoded once. A piece that is a
token is that token. Any other is folded: from its bytes, each step merges the leftmost adjacent pair of least rank.
Ranks of pairs are a literal of the plan: a perfect hash over all pairs, each slot with its key (of two ids) and its
rank, so a look-up is three array reads. The rank of a merged pair is its token's id. A piece longer than `window`
bytes is folded window by window, each beginning at the last token kept of the one before; should it not begin with
that token, the piece is begun again with windows four times as long, so results stay exact and the work stays near
linear. Decoding joins the tokens' bytes.

Pieces are counted over the whole corpus. The most frequent ones that occur twice at least, up to `broadcast_words`,
are folded once each and travel as arrays of bounded size. The others are folded beside the text that has them, so no
text is shuffled: once each, unless more distinct pieces repeat than `broadcast_words`, in which case the least
frequent of those are folded once in every text that has them.

Defined cases: null and empty texts have no ids; repeated rows are encoded each; an empty table gives an empty result;
a pattern that leaves out characters, and a vocabulary without all 256 bytes, raise ValueError. Input columns are
carried in `row`.
"""

from __future__ import annotations

import base64
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import pieces
from corvane.llm.rows import bounded, name, slices
from corvane.scratch import stored

NONE = 2147483647
LOW = (1 << 32) - 1
SLICE, PLAN_TEXT = 2 << 20, 1_000_000  # bytes of text cut at once; characters of a plan kept on the driver


class Ranks:
    """Literals of a vocabulary: ranks of pairs of ids, of pairs of bytes, and the bytes of ids."""

    def __init__(self, path: str, window: int = 256):
        with open(path, "rb") as f:
            vocabulary = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if not all(bytes([i]) in vocabulary for i in range(256)) or max(vocabulary.values()) >= NONE:
            raise ValueError(f"not a byte-level vocabulary: {path}")
        self.vocabulary, self.none = vocabulary, max(vocabulary.values()) + 1
        self.window = max(window, 2 * max(map(len, vocabulary)))
        pairs = {(vocabulary[t[:i]], vocabulary[t[i:]]): r for t, r in vocabulary.items() for i in range(1, len(t)) if t[:i] in vocabulary and t[i:] in vocabulary}
        one = [vocabulary[bytes([i])] for i in range(256)]
        pair = [vocabulary.get(bytes([i, j])) for i in range(256) for j in range(256)]
        two = [None if r is None else r << 32 | one[k >> 8] for k, r in enumerate(pair)]  # most are none: null is short
        back = {r: t for t, r in vocabulary.items()}
        known = [back.get(i, b"") for i in range(self.none)]
        hashed = {k: v.tolist() for k, v in self._hash(pairs).items()}
        self.tables = _literal(hashed | {"byte": one, "two": two, "length": [*map(len, known)]}, "struct<move:array<bigint>,keys:array<bigint>,ranks:array<bigint>,byte:array<bigint>,two:array<bigint>,length:array<int>>")
        self.text = _literal([t.decode("latin-1") for t in known], "array<string>")

    def _hash(self, pairs: dict) -> dict:
        """A slot for every pair: pairs of one bucket are moved together until all their slots are free. The moves, keys and ranks."""
        key = np.array(list(pairs), np.int64).reshape(-1, 2)
        rank = np.fromiter(pairs.values(), np.int64, len(pairs))
        bits = max(4, int(1.3 * len(key)).bit_length())
        for seed in range(64):
            self.slots, self.buckets, self.mix = 1 << bits + seed // 16, 1 << bits - 1, (31337 + 2 * seed, 7919 + 6 * seed, 104729 + 10 * seed)
            bucket, slot = (key[:, 0] * self.mix[0] + key[:, 1]) & (self.buckets - 1), (key[:, 0] * self.mix[1] + key[:, 1] * self.mix[2]) & (self.slots - 1)
            order = np.lexsort((slot, bucket))
            if not (np.diff(bucket[order]) | np.diff(slot[order])).all():
                continue  # two pairs of a bucket would always meet
            taken, move = np.zeros(self.slots, bool), np.zeros(self.buckets, np.int64)
            keys, ranks = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.int64)
            for g in sorted(np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1), key=len, reverse=True):
                d = next((d for d in range(self.slots) if not taken[slot[g] ^ d].any()), None) if len(g) else 0
                if d is None:
                    break
                at = slot[g] ^ d
                taken[at], move[bucket[g]], keys[at], ranks[at] = True, d, key[g, 0] * (self.none + 1) + key[g, 1], rank[g]
            else:
                return {"move": move, "keys": keys, "ranks": ranks}
        raise ValueError("no perfect hash found")

    def near(self, use) -> Column:
        """use(encode), encode being a function of a non-empty binary piece.

        The tables are one literal at the expression's top, and a variable in it: each level of nesting copies the text
        of what is below whenever Spark describes the plan, and a literal in several places is parsed and held for each.
        """
        return _with(self.tables, lambda t: use(lambda piece: self.encode(piece, t)))

    def rank(self, t: Column, a: Column, b: Column) -> Column:
        """The rank of a pair of ids (bigint), or NONE."""
        move = F.get(t["move"], (a * self.mix[0] + b).bitwiseAND(self.buckets - 1).cast("int"))
        at = (a * self.mix[1] + b * self.mix[2]).bitwiseAND(self.slots - 1).bitwiseXOR(move).cast("int")
        return F.when(F.get(t["keys"], at) == a * (self.none + 1) + b, F.get(t["ranks"], at)).otherwise(F.lit(NONE).cast("bigint"))

    def fold(self, piece: Column, t: Column) -> Column:
        """Ids of a non-empty binary piece. The state holds, for each part, its rank with the next (high) and its id (low)."""
        low, edge = lambda x: x.bitwiseAND(LOW), F.lit((NONE << 32) + self.none)

        def begin(c: Column) -> Column:
            inner = F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c)), lambda x, y: F.coalesce(F.get(t["two"], x * 256 + y), F.get(t["byte"], x) + F.lit(NONE << 32)))
            return F.concat(F.array(edge), inner, F.array(F.get(t["byte"], F.element_at(c, -1)) + F.lit(NONE << 32), edge))

        def merged(x: Column, least: Column) -> Column:
            new = F.shiftright(least, 32)

            def put(i: Column) -> Column:
                beside = F.zip_with(F.array(low(F.get(x, i - 1)), new), F.array(new, low(F.get(x, i + 2))), lambda a, b: F.shiftleft(self.rank(t, a, b), 32) + a)
                return F.concat(F.slice(x, F.lit(1), i - 1), beside, F.slice(x, i + 3, F.size(x)))

            return _with(low(least).cast("int"), put)

        def step(x: Column, _: Column) -> Column:
            places = F.transform(x, lambda v, i: F.shiftleft(F.shiftright(v, 32), 32) + i)  # rank, then place: the least is the leftmost
            return _with(F.array_min(places), lambda m: F.when(m >= NONE << 32, x).otherwise(merged(x, m)))

        first = _with(F.transform(F.split(F.decode(piece, "ISO-8859-1"), ""), F.ascii), begin)
        return F.aggregate(F.sequence(F.lit(2), F.greatest(F.octet_length(piece), F.lit(2))), first, step, lambda x: F.transform(F.slice(x, F.lit(2), F.size(x) - 2), lambda v: low(v).cast("int")))

    def encode(self, piece: Column, t: Column) -> Column:
        """Ids of a non-empty binary piece of any length, window by window; t: the tables."""
        n = F.octet_length(piece)
        state = "struct<at:int,first:int,width:int,out:array<array<int>>>"

        def of(at, first, width, out) -> Column:
            return F.struct(at.alias("at"), first.alias("first"), width.alias("width"), out.alias("out")).cast(state)

        def kept(ids: Column, width: Column) -> Column:
            """Tokens that end in the window's first half: their number, and where the last of them begins."""

            def add(s: Column, i: Column) -> Column:
                end = s["end"] + F.get(t["length"], i)
                return F.when(s["done"] | (end * 2 > width), F.struct(s["k"].alias("k"), s["begin"].alias("begin"), s["end"].alias("end"), F.lit(True).alias("done"))).otherwise(F.struct((s["k"] + 1).alias("k"), s["end"].alias("begin"), end.alias("end"), F.lit(False).alias("done")))

            return F.aggregate(ids, F.struct(F.lit(0).alias("k"), F.lit(0).alias("begin"), F.lit(0).alias("end"), F.lit(False).alias("done")), add)

        def used(s: Column, ids: Column) -> Column:
            fresh = F.when(s["first"] < 0, 1).otherwise(2)  # the token in common is out already
            again = of(F.lit(0), F.lit(-1), s["width"] * 4, F.array())
            last = of(n, F.lit(-1), s["width"], F.concat(s["out"], F.array(F.slice(ids, fresh, F.size(ids)))))
            more = lambda k: F.when(k["begin"] == 0, again).otherwise(of(s["at"] + k["begin"], F.get(ids, k["k"] - 1), s["width"], F.concat(s["out"], F.array(F.slice(ids, fresh, k["k"] + 1 - fresh)))))
            good = F.when(s["at"] + s["width"] >= n, last).otherwise(_with(kept(ids, s["width"]), more))
            return F.when((s["first"] >= 0) & (F.get(ids, 0) != s["first"]), again).otherwise(good)

        def step(s: Column, _: Column) -> Column:
            return F.when(s["at"] >= n, s).otherwise(_with(self.fold(F.substring(piece, s["at"] + 1, s["width"]), t), lambda ids: used(s, ids)))

        turns = F.when(n <= self.window, 1).otherwise(F.ceil(n / self.window).cast("int") * 12 + 24)
        return F.aggregate(F.sequence(F.lit(1), turns), of(F.lit(0), F.lit(-1), F.lit(self.window), F.array()), step, lambda s: F.when(s["at"] >= n, F.flatten(s["out"])).otherwise(F.raise_error(F.lit("a piece was not encoded"))))

    def decode(self, ids: Column) -> Column:
        """The bytes of ids: token after token, each byte as one character on the way."""
        return F.encode(F.array_join(F.transform(ids, lambda i: F.get(self.text, i)), ""), "ISO-8859-1")

    def tokens(self) -> pieces.Known:
        """Pieces that are tokens themselves."""
        return pieces.Known(pa.array(self.vocabulary, pa.binary()), np.fromiter(self.vocabulary.values(), np.int32), np.ones(len(self.vocabulary), np.int64))


def _literal(value: list | dict, kind: str) -> Column:
    """A literal of any nested kind; the optimizer folds the call."""
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)


def _with(value: Column, use) -> Column:
    """use(value), evaluating value once."""
    return F.get(F.transform(F.array(value), use), 0)


def words(docs: DataFrame, pattern: str, tokens: pieces.Known, text: str = "text", most: int = 300_000) -> DataFrame:
    """(piece binary, k long): distinct pieces of all texts that are no tokens, and their counts.

    A task adds up its own counts and passes them on whenever it holds `most` pieces.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokens)

    def run(batches):
        held, rows = [], 0

        def added() -> pa.Table:
            return pa.concat_tables(held).group_by("piece").aggregate([("k", "sum")]).rename_columns(["piece", "k"])

        for batch in (x for whole in batches for x in slices(whole, whole.column(0), SLICE)):
            found = pc.value_counts(pieces.cut(batch.column(0), pattern)[0])
            new = pa.array(shared.value.find(found.field(0)) < 0)
            held.append(pa.table({"piece": found.field(0), "k": found.field(1)}).filter(new))
            rows += held[-1].num_rows
            if rows > 2 * most:
                held, rows = [added()], 0
                rows = held[0].num_rows
                if rows > most:
                    yield from held[0].to_batches()
                    held, rows = [], 0
        if held:
            yield from added().to_batches()

    return docs.select(name(text).cast("string").alias("t")).mapInArrow(run, "piece binary, k long").groupBy("piece").agg(F.sum("k").alias("k"))


def frequent(found: DataFrame, ranks: Ranks, most: int) -> pieces.Known:
    """Tokens, and the ids of the most frequent pieces that occur twice at least: `most` of them at most."""
    counts = found.where("k > 1").groupBy(F.least("k", F.lit(10_000)).alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("k")).collect()
    total, least = 0, 10_001  # the least count whose pieces, with all more frequent ones, stay within the bound
    for r in counts:
        total += r["n"]
        if total > most:
            break
        least = r["k"]
    top = found.where(F.col("k") >= least).select("piece", ranks.near(lambda encode: encode(F.col("piece"))).alias("ids"))

    def packed(batches):
        for batch in batches:
            word, ids = batch.column(0).cast(pa.binary()), batch.column(1)
            cols = b"".join(word.to_pylist()), pc.binary_length(word), ids.flatten().cast(pa.int32()), pc.list_value_length(ids)
            yield pa.RecordBatch.from_pydict({k: pa.array([c if isinstance(c, bytes) else c.to_numpy(zero_copy_only=False).astype("<i4").tobytes()], pa.binary()) for k, c in zip(("words", "lengths", "ids", "sizes"), cols, strict=True)})

    own = ranks.vocabulary
    got = [bytearray(x) for x in (b"".join(own), np.array([*map(len, own)], "<i4").tobytes(), np.array([*own.values()], "<i4").tobytes(), np.ones(len(own), "<i4").tobytes())]
    rows = stored(top.mapInArrow(packed, "words binary, lengths binary, ids binary, sizes binary"), "frequent")  # made in parallel
    for row in rows.toLocalIterator():
        for held, new in zip(got, row, strict=True):
            held += new  # in place: the driver has each array once
    lengths, ids, sizes = (np.frombuffer(x, "<i4") for x in got[1:])
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
    words_ = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(got[0])])
    return pieces.Known(words_, ids, sizes.astype(np.int64))


def byte_bpe(docs: DataFrame, path: str, pattern: str, text: str = "text", carry: list[str] | None = None, broadcast_words: int = 1_500_000, window: int = 256) -> DataFrame:
    """`row` (the carried columns), ids array<int> and decoded binary."""
    bounded(docs.sparkSession)
    if int(docs.sparkSession.conf.get("spark.sql.maxPlanStringLength").removesuffix("b")) > PLAN_TEXT:  # a plan's description spells its literals
        docs.sparkSession.conf.set("spark.sql.maxPlanStringLength", str(PLAN_TEXT))
    carry = list(docs.columns if carry is None else carry)
    ranks = Ranks(path, window)
    known = frequent(stored(words(docs, pattern, ranks.tokens(), text), "words"), ranks, broadcast_words)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    texts = docs.select(F.struct(*[name(c) for c in carry]).alias("row"), name(text).cast("string").alias("t"))

    def run(batches):
        """Ids of known pieces, in runs between the others; each text's other pieces, and their places among the runs."""
        for batch in (x for whole in batches for x in slices(whole, whole.column(1), SLICE)):
            got = shared.value
            found, first = pieces.cut(batch.column(1), pattern)
            coded = found.dictionary_encode()
            index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            at = got.find(coded.dictionary)
            begin, size = (v[index] for v in got.spans(at))
            end = np.cumsum(size, dtype=np.int64)
            start = np.append(end - size, end[-1:] if len(end) else 0)
            flat = got.ids[np.repeat(begin - start[:-1], size) + np.arange(start[-1])]
            rare = np.flatnonzero(at[index] < 0)
            cuts = np.insert(start[rare], np.searchsorted(rare, first), start[first])
            many = np.diff(np.append(np.searchsorted(rare, first), len(rare)))  # other pieces of each text
            runs = pa.ListArray.from_arrays(pa.array(np.append(cuts, start[-1]), pa.int32()), pa.array(flat, pa.int32()))
            runs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many + 1))), pa.int32()), runs)
            of, words_ = np.repeat(np.arange(len(many)), many), len(coded.dictionary)
            own, place = np.unique(of * words_ + index[rare], return_inverse=True)
            each = np.searchsorted(own, np.arange(len(many) + 1) * words_) if words_ else np.zeros(len(many) + 1, np.int64)
            others = pa.ListArray.from_arrays(pa.array(each, pa.int32()), coded.dictionary.take(pa.array(own % max(words_, 1))))
            places = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))), pa.int32()), pa.array(place - each[of], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), runs, others, places], names=["row", "runs", "rare", "places"])

    kind = T.StructType([texts.schema["row"], *T._parse_datatype_string("runs array<array<int>>, rare array<binary>, places array<int>").fields])
    got = texts.mapInArrow(run, kind)
    put = lambda codes: F.flatten(F.zip_with("runs", "places", lambda r, k: F.concat(r, F.coalesce(F.get(codes, k), F.array().cast("array<int>")))))
    ids = got.select("row", _with(ranks.near(lambda encode: F.transform("rare", encode)), put).alias("ids"))
    return ids.select("row", "ids", ranks.decode(F.col("ids")).alias("decoded"))
