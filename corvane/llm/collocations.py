"""Collocations by hierarchical pair naming: frequent phrases of 2 to `longest` words, their cuts, what longer ones cover.

1. Texts become batches of word codes, one language a batch, with the batch's own list of words. The batches' words are
   counted; a word that is frequent in its language gets a global id, which replaces its code; this is written once.
2. Pair naming: two adjacent places of frequent (k-1)-word phrases make a pair of ids. Each batch lists its distinct
   pairs; they are added up over all batches; a pair that is frequent is a phrase of k words and gets an id of its own.
   The batches' pairs are joined with these names, and every batch's codes are replaced by the names of its pairs. Only
   phrases both of whose parts are frequent can be, so nothing else is counted: each level is shorter.
3. A name's two ids are its parents: the phrase without its last and without its first word. So the counts of both parts
   of any cut are found along parent pointers, level by level, and a phrase is covered by a longer one if and only if a
   phrase one word longer, of which it is a parent, covers it (a still longer one is rarer than one between).

A batch lists a pair once, whatever its count, so a frequent word, pair or language weighs as much as there are batches,
and sums are begun before each exchange. Up to BROADCAST_ROWS names of a level, counted first (of words BROADCAST_BYTES
too), go to the tasks, which look their pairs up; more are joined with the batches' pairs by shuffle, where skewed keys
can be split. Counts are exact; scores are computed in decimals.

Defined cases: a null text is empty; a null language is `und`; repeated rows each count; words are cut only at spaces
and tabs, so any other character is part of one; a piece is held whole in a batch; ties go to the smaller cut, and
phrases of equal score and count are ordered by their UTF-8 bytes; an empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.rows import bounded, name, slices
from corvane.scratch import stored

LEAST, LONGEST, COVER, TOP, SCALE = 30, 4, 80, 2000, 2_000_000
BATCH, SALTS = 1_000_000, 64
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20
BREAK = b"\xff"  # in no UTF-8 text: stands between pieces
#: Upper to lower case, and every character that ends a piece to \n.
TABLE = bytes(10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else c + 32 if 65 <= c <= 90 else c for c in range(256))
CODED = "batch long, lang string, n long, codes binary, words array<string>"
NAMED = "batch long, lang string, n long, codes binary, names binary"


def tokens(text: bytes) -> list[bytes]:
    """The words of a text, with BREAK between pieces."""
    return text.translate(TABLE).replace(b"\n", b" \xff ").split()


def coder(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """(language, codes, words) of about BATCH places each, from batches of (lang, text).

    A code is a place in the words, -1 between pieces.
    """
    held: dict[str, tuple] = {}
    waiting = 0

    def let_go() -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
        for key, (known, codes) in held.items():
            known.pop(BREAK, None)
            yield key, np.concatenate(codes), list(known)
        held.clear()

    for whole in batches:
        for b in slices(whole, whole.column(1)):
            for key, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = tokens(t or b"")
                if not words:
                    continue
                if key not in held:
                    known: dict = defaultdict(count().__next__)
                    known[BREAK] = -1
                    held[key] = known, []
                known, codes = held[key]
                codes.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                codes.append(np.array([-1], np.int32))
                waiting += len(words)
                if waiting >= BATCH:
                    yield from let_go()
                    waiting = 0
    yield from let_go()


def packed(codes: np.ndarray) -> bytes:
    """Codes compressed: their bytes by significance, so the many zeros stand together."""
    turned = np.ascontiguousarray(codes.astype(np.int32).view(np.uint8).reshape(-1, 4).T)
    return len(codes).to_bytes(8, "little") + pa.compress(turned, codec="zstd", asbytes=True)


def unpacked(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    turned = np.frombuffer(pa.decompress(b[8:], decompressed_size=4 * n, codec="zstd"), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(turned.T).view(np.int32).ravel()


def numbers() -> Iterator[int]:
    """Numbers that no other task of the stage gives."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return count((context.partitionId() if context else 0) << 33)


def one_row(types: dict, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types.values(), strict=True)], names=list(types))


CODED_TYPES = {"batch": pa.int64(), "lang": pa.string(), "n": pa.int64(), "codes": pa.binary(), "words": pa.list_(pa.string())}
NAMED_TYPES = {"batch": pa.int64(), "lang": pa.string(), "n": pa.int64(), "codes": pa.binary(), "names": pa.binary()}


def texts_of(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of each batch."""
    for lang, codes, words in coder(batches):
        n = np.bincount(codes[codes >= 0], minlength=len(words))
        for lo in range(0, len(words), 65536):
            cut = words[lo : lo + 65536]
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(cut)), texts_of(cut), pa.array(n[lo : lo + 65536])], names=["lang", "word", "n"])


def pairs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where two adjacent places are both named, which distinct pair that is, and the pairs: codes and count."""
    at = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
    both = codes[at].astype(np.int64) << 32 | codes[at + 1]
    distinct, which, n = np.unique(both, return_inverse=True, return_counts=True)
    return at, which, distinct >> 32, distinct & 0xFFFFFFFF, n


def listed(level: DataFrame) -> DataFrame:
    """(batch, place, left, right, n): the distinct pairs of every batch by the ids of their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, codes, names in zip(*(c.to_pylist() for c in b.columns), strict=True):
                names = np.frombuffer(names, np.int64)
                _, _, left, right, n = pairs(unpacked(codes))
                for lo in range(0, len(n), 65536):
                    cut = slice(lo, lo + 65536)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(n[cut]), batch), np.arange(lo, lo + len(n[cut])), names[left[cut]], names[right[cut]], n[cut])], names=["batch", "place", "left", "right", "n"])

    return level.select("batch", "codes", "names").mapInArrow(run, "batch long, place long, left long, right long, n long")


def replaced(codes: np.ndarray, at: np.ndarray, which: np.ndarray, place: np.ndarray) -> np.ndarray:
    """New codes: at `at` stands what is `which` in the batch's list; of these, those in `place` are named, in that order."""
    new = np.full(int(which.max(initial=-1)) + 1, -1, np.int32)
    new[place] = np.arange(len(place), dtype=np.int32)
    out = np.full(len(codes), -1, np.int32)
    out[at] = new[which]
    return out


def joined(level: DataFrame, found: DataFrame, make) -> DataFrame:
    """The next level's batches by a join. found: (batch, place, id) of the places in a batch's list that have a name.

    make(codes) returns where the listed places stand and which each is.
    """
    maps = found.groupBy("batch").agg(F.collect_list(F.struct("place", "id")).alias("map"))  # as many as a batch lists at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 1) for i in range(whole.num_rows)):
                batch, lang, n, codes = (b.column(i)[0].as_py() for i in range(4))
                codes = unpacked(codes)
                place, ids = (x.to_numpy() for x in b.column(4).flatten().flatten())
                yield one_row(NAMED_TYPES, batch, lang, n, packed(replaced(codes, *make(codes), place)), ids.tobytes())

    return level.select("batch", "lang", "n", "codes").join(maps, "batch", "left").mapInArrow(run, NAMED)


def looked_up(left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """The names of pairs, sorted for `names_of`: distinct lefts and rights, pairs as one number, ids."""
    lefts, rights = np.unique(left), np.unique(right)
    key = np.searchsorted(lefts, left) * len(rights) + np.searchsorted(rights, right)
    order = np.argsort(key)
    return lefts, rights, key[order], ids[order]


def names_of(known: tuple[np.ndarray, ...], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the pairs that have a name, and the names."""
    lefts, rights, keys, ids = known
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.minimum(np.searchsorted(lefts, left), len(lefts) - 1), np.minimum(np.searchsorted(rights, right), len(rights) - 1)
    key = a * len(rights) + b
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    fits = np.flatnonzero((lefts[a] == left) & (rights[b] == right) & (keys[at] == key))
    return fits, ids[at[fits]]


def next_level(level: DataFrame, name_of: DataFrame, broadcast_rows: int) -> DataFrame:
    """The batches with their pairs' names. Up to `broadcast_rows` names (three numbers each) go to the tasks; more are joined."""
    if name_of.count() > broadcast_rows:
        found = listed(level).join(name_of.select("left", "right", "id"), ["left", "right"]).select("batch", "place", "id")
        return stored(joined(level, found, lambda codes: pairs(codes)[:2]), "named")
    got = name_of.select("left", "right", "id").toArrow()
    sent = level.sparkSession.sparkContext.broadcast(looked_up(*(c.to_numpy() for c in got.columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, lang, n, codes, names in zip(*(c.to_pylist() for c in b.columns), strict=True):
                codes, names = unpacked(codes), np.frombuffer(names, np.int64)
                at, which, left, right, _ = pairs(codes)
                place, ids = names_of(sent.value, names[left], names[right])
                if len(place):
                    yield one_row(NAMED_TYPES, batch, lang, n, packed(replaced(codes, at, which, place)), ids.tobytes())

    return stored(level.mapInArrow(run, NAMED), "named")


def first_level(rows: DataFrame, first: DataFrame, broadcast_rows: int) -> DataFrame:
    """Batches of (lang, text) rows with their frequent words' names: looked up if these are few and short, else joined."""
    most = first.agg(F.count("*"), F.sum(F.octet_length("word"))).first()
    if most[0] > broadcast_rows or (most[1] or 0) > BROADCAST_BYTES:

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = numbers()
            for lang, codes, words in coder(batches):
                yield one_row(CODED_TYPES, next(number), lang, int((codes >= 0).sum()), packed(codes), texts_of(words).to_pylist())

        texts = stored(rows.mapInArrow(code, CODED), "coded")
        words = texts.select("batch", "lang", F.posexplode("words").alias("place", "word"))
        found = words.join(first.select("lang", "word", "id"), ["lang", "word"]).select("batch", "place", "id")

        def word_places(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.flatnonzero(codes >= 0)
            return at, codes[at]

        return stored(joined(texts, found, word_places), "named")
    import pyarrow.compute as pc

    got = first.select("lang", "word", "id").toArrow()
    by_lang = {k: got.filter(pc.equal(got["lang"], k)).combine_chunks() for k in got["lang"].unique().to_pylist()}
    sent = rows.sparkSession.sparkContext.broadcast({k: (t["word"].cast(pa.string()).combine_chunks(), t["id"].to_numpy()) for k, t in by_lang.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbers()
        for lang, codes, words in coder(batches):
            if lang not in sent.value:
                continue
            known, ids = sent.value[lang]
            index = pc.fill_null(pc.index_in(texts_of(words), value_set=known), -1).to_numpy()
            place, at = np.flatnonzero(index >= 0), np.flatnonzero(codes >= 0)
            yield one_row(NAMED_TYPES, next(number), lang, len(at), packed(replaced(codes, at, codes[at], place)), ids[index[place]].tobytes())

    return stored(rows.mapInArrow(run, NAMED), "named")


def named(sums: DataFrame, least: int, tag: str) -> DataFrame:
    """Rows with f of `least` or more, each with an id."""
    return stored(sums.where(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id()), tag)


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, broadcast_rows: int = BROADCAST_ROWS) -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases of each number of words from 1: (lang, phrase, id, f, left, right, tail, heads, tails), and the
    number of all words, (lang, n).

    left and right are the ids of the phrase without its last and its first word, tail its last word; heads and tails are
    the counts of its beginnings and of its ends, of 1 word to all but one.
    """
    bounded(docs.sparkSession)
    rows = docs.select(F.coalesce(name(lang).cast("string"), F.lit("und")).alias("lang"), name(text).cast("string").alias("text"))
    sums = rows.mapInArrow(counted_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    first = named(sums, least, "words")
    level = first_level(rows, first, broadcast_rows)
    total = level.groupBy("lang").agg(F.sum("n").alias("n"))
    none = F.array().cast("array<bigint>")
    out = [first.select("lang", F.col("word").alias("phrase"), "id", "f", F.lit(None).cast("bigint").alias("left"), F.lit(None).cast("bigint").alias("right"), F.col("word").alias("tail"), none.alias("heads"), none.alias("tails"))]
    for k in range(2, longest + 1):
        name_of = named(listed(level).groupBy("left", "right").agg(F.sum("n").alias("f")), least, f"pairs{k}")
        below = out[-1]
        left = below.select(F.col("id").alias("left"), "lang", "phrase", F.concat("heads", F.array("f")).alias("heads"))
        right = below.select(F.col("id").alias("right"), "tail", F.concat("tails", F.array("f")).alias("tails"))
        rows = name_of.join(left, "left").join(right, "right")
        out.append(stored(rows.select("lang", F.concat_ws(" ", "phrase", "tail").alias("phrase"), "id", "f", "left", "right", "tail", "heads", "tails"), f"phrases{k}"))
        if k < longest:
            level = next_level(level, name_of, broadcast_rows)
    return out, total


def weakest_cut(scale: int = SCALE) -> str:
    """SQL for the cut (score, k, l, r) of least score, then k, of a phrase with columns a, heads and tails; in decimals."""
    wide = "cast({} as decimal(19,0))".format
    parts = f"{wide('heads[k - 1]')} + {wide('tails[size(heads) - k]')}"
    return f"""array_min(transform(sequence(1, size(heads)), k -> named_struct('score', cast({scale} as decimal(10,0)) * {wide('a')} div ({parts}),
        'k', k, 'l', heads[k - 1], 'r', tails[size(heads) - k])))"""


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, cover: int = COVER, top: int = TOP, scale: int = SCALE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best `top` phrases of each language by their weakest cut."""
    levels, total = phrases(docs, text, lang, least, longest, broadcast_rows)
    parts = []
    for k in range(1, longest):
        own, longer = levels[k], levels[k + 1] if k + 1 < longest else None
        if longer is not None:
            by = longer.select(F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("g")).groupBy("id").agg(F.max("g").alias("g"))
            big = lambda x: F.col(x).cast("decimal(19,0)")
            own = own.join(by, "id", "left").where(F.col("g").isNull() | (100 * big("g") < cover * big("f")))
        parts.append(own.select("lang", "phrase", F.col("f").alias("a"), "heads", "tails"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    scored = every.withColumn("c", F.expr(weakest_cut(scale))).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
