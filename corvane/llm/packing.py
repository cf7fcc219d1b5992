"""Best-fit packing of token sequences by a grouping genetic algorithm, run as islands with elite migration.

Documents become token ids (and an end id); those over `capacity` are cut from their end into full pieces, so only the
first piece may be shorter. Full pieces are sequences of their own. All other pieces go by hash of their row into shards
of about `shard` pieces. Every shard is a bin-packing problem that several islands work on. An island begins with
best-fit packings of differently disturbed orders. Crossover injects well-filled bins of one parent whole into the
other and drops the bins that now hold a piece twice; mutation opens the emptiest bins and a few others. Displaced
pieces are swapped into bins whose fill grows by it (one for one, one for two, two for one), until none does, and the
rest goes in by best fit, largest first. Between rounds each island's elite migrates to the next. A search ends early
at the lower bound. Bins that the best packing of a shard leaves badly filled are opened again and their pieces packed
once more with those of other shards, as long as that takes fewer shards; then they stay as they are. So a shard never
holds more than about `shard` pieces.

Defined cases: null and empty texts are the end id alone; an empty table gives no rows; repeated rows are packed each;
equal lengths are interchangeable, ties go by row number; very long texts are cut like others. Input columns are
carried in `row`.
"""

from __future__ import annotations

import heapq
import random
import zlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.rows import map_text
from corvane.scratch import stored

CAPACITY, END = 1024, 2
PIECES = "pieces array<struct<piece:int,start:long,length:long,ids_crc32:long>>"


BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def _bytes_of(token: str, back: dict) -> bytes | None:
    try:
        return bytes(back[c] for c in token)
    except KeyError:
        return None


def ranked(vocabulary: str) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """Ranks and special tokens, if ranked merges give the ids that the tokenizers library gives; else None.

    They do for a byte-level model without normalizer whose ids grow along its list of merges (then the rank of a
    merged pair is its id) and whose merges lead to every token from its bytes (then a piece that is a token is it).
    """
    import json

    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type", "BPE") == "BPE" and not model.get("dropout") and not model.get("byte_fallback") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
    if not plain or spec.get("normalizer") or any({"use_regex": True, **before}.get(k) != v for k, v in BYTE_LEVEL.items()):
        return None
    if any(t.get("normalized") and not t.get("special") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec["added_tokens"]):
        return None
    special, last = {t["content"]: t["id"] for t in spec["added_tokens"]}, -1
    for m in model["merges"]:
        i = model["vocab"].get("".join(m) if isinstance(m, list) else m.replace(" ", ""), -1)
        if i <= last:
            return None
        last = i
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes written as themselves; the others follow 255
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {_bytes_of(t, back): i for t, i in model["vocab"].items() if t not in special}
    if None in ranks or not all(merges_to_itself(t, ranks) for t in ranks):
        return None
    return ranks, special


def merges_to_itself(token: bytes, ranks: dict[bytes, int]) -> bool:
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        r, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 31), i) for i in range(len(parts) - 1))
        if r == 1 << 31:
            return False
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return True


def encoder(vocabulary: str, pattern: str, fast: tuple | None = None):
    """Text to little-endian 32-bit ids, as the tokenizers library gives them.

    With `fast` (what `ranked` found), tiktoken's encoder of ranked merges gives them several times faster; special
    tokens that a text spells stay special, as in the library.
    """
    if fast is None:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(vocabulary)
        return lambda text: array("I", tok.encode(text, add_special_tokens=False).ids).tobytes()
    import tiktoken

    ranks, special = fast
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)
    return lambda text: enc.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()).tobytes()


def cut(ids: bytes, capacity: int = CAPACITY) -> list[dict]:
    n, out, at = len(ids) // 4, [], 0
    while at < n:
        size = (n - at) % capacity or capacity
        out.append({"piece": len(out), "start": at, "length": size, "ids_crc32": zlib.crc32(ids[4 * at : 4 * (at + size)])})
        at += size
    return out


def tokenized(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", carry: list[str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """`row` and an array of pieces per document."""

    fast = docs.sparkSession.sparkContext.broadcast(ranked(vocabulary))  # the vocabulary

    def make():
        encode, end = encoder(vocabulary, pattern, fast.value), array("I", [END]).tobytes()
        return lambda texts: [[cut(encode((b or b"").decode("utf-8", "replace")) + end, capacity) for b in texts]]

    return map_text(docs, make, PIECES, text, carry)


def bound(sizes: list[int], capacity: int) -> int:
    """Bins that any packing needs. Items over capacity - a stand alone among items from size a on; of the others, those
    over half share no bin and leave room that items from a to half must fill first."""
    many, total = [0] * (capacity + 2), [0] * (capacity + 2)  # items, and their sum, of this size and more
    for s in sizes:
        many[s] += 1
        total[s] += s
    for s in range(capacity, -1, -1):
        many[s] += many[s + 1]
        total[s] += total[s + 1]
    half = capacity // 2 + 1
    least = -(-total[0] // capacity)
    for a in range(1, half):
        alone = capacity - a + 1
        room = (many[half] - many[alone]) * capacity - (total[half] - total[alone])
        least = max(least, many[half] + max(0, -(-(total[a] - total[half] - room) // capacity)))
    return least


class Packing:
    """A packing is (bins, fills): lists of item numbers and their sums; sizes are those of the items."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity

    def best_fit(self, items: list[int], bins: list[list[int]], fills: list[int]) -> tuple[list, list]:
        """Puts items in the fullest bin with room, or a new one. A set bit of `free` marks a room that some bin has."""
        sizes, rooms, free = self.sizes, [[] for _ in range(self.capacity + 1)], 0
        for j, f in enumerate(fills):
            if f < self.capacity:
                rooms[self.capacity - f].append(j)
                free |= 1 << self.capacity - f
        for i in items:
            s = sizes[i]
            fit = free >> s
            if fit:
                r = s + (fit & -fit).bit_length() - 1
                j = rooms[r].pop()
                if not rooms[r]:
                    free ^= 1 << r
                bins[j].append(i)
            else:
                j, r = len(bins), self.capacity
                bins.append([i])
                fills.append(0)
            fills[j] += s
            if r > s:
                rooms[r - s].append(j)
                free |= 1 << r - s
        return bins, fills

    def swapped(self, loose: list[int], bins: list[list[int]], fills: list[int], places: list[int]) -> list[int]:
        """Gives each bin of `places` the swap with loose items that fills it most; what is loose afterwards."""
        sizes, held, mask = self.sizes, {}, 0  # loose items by size, and the set of these sizes
        for i in loose:
            held.setdefault(sizes[i], []).append(i)
        for s in held:
            mask |= 1 << s

        def largest(room: int) -> int:
            return (mask & (2 << room) - 1).bit_length() - 1

        for j in places:
            r = self.capacity - fills[j]
            if not mask:
                break
            b, gain, out, into = bins[j], max(0, largest(r)), (), (largest(r),)
            for p in range(len(b)):
                if gain == r:
                    break
                x = sizes[b[p]]
                y = largest(x + r)
                if y - x > gain:
                    gain, out, into = y - x, (p,), (y,)
                for y in held if len(held) <= 24 else ():
                    z = largest(x + r - y) if y < x + r else 0
                    if y + z - x > gain and z > 0 and (z != y or len(held[y]) > 1):
                        gain, out, into = y + z - x, (p,), (y, z)
                for q in range(p):
                    x2 = x + sizes[b[q]]
                    y = largest(x2 + r)
                    if y - x2 > gain:
                        gain, out, into = y - x2, (p, q), (y,)
            if gain:
                new = []
                for y in into:
                    new.append(held[y].pop())
                    if not held[y]:
                        del held[y]
                        mask ^= 1 << y
                for p in out:
                    held.setdefault(sizes[b[p]], []).append(b[p])
                    mask |= 1 << sizes[b[p]]
                bins[j] = [i for p, i in enumerate(b) if p not in out] + new
                fills[j] += gain
        return [i for v in held.values() for i in v]

    def completed(self, loose: list[int], bins: list[list[int]], fills: list[int], rng: random.Random, turns: int = 4, most: int = 400) -> tuple[list, list]:
        """A packing of all items: swaps in up to `most` bins a turn, as long as less is loose, then best fit."""
        for _ in range(turns):
            places = [j for j, f in enumerate(fills) if f < self.capacity]
            rng.shuffle(places)
            rest = self.swapped(loose, bins, fills, places[:most])
            better = sum([self.sizes[i] for i in rest]) < sum([self.sizes[i] for i in loose])
            loose = rest
            if not better:
                break
        return self.best_fit(sorted(loose, key=lambda i: -self.sizes[i]), bins, fills)

    def fitness(self, fills: list[int]) -> float:
        """Fewer bins first; among equals, those with the more unequal fill (mean square)."""
        return -len(fills) + sum([f * f for f in fills]) / (self.capacity**2 * max(1, len(fills)))

    def shaken(self, rng: random.Random, noise: float) -> tuple[list, list]:
        """Best fit, largest first, of sizes that look up to `noise` larger than they are."""
        return self.best_fit(sorted(range(len(self.sizes)), key=lambda i: -self.sizes[i] * (1 + noise * rng.random())), [], [])

    def mutated(self, one: tuple[list, list], rng: random.Random) -> tuple[list, list]:
        bins, fills = one
        gone = set(heapq.nsmallest(rng.randint(1, 2), range(len(bins)), fills.__getitem__))
        gone |= {rng.randrange(len(bins)) for _ in range(rng.randint(0, max(1, min(6, len(bins) // 8))))}
        loose = [i for j in gone for i in bins[j]]
        return self.completed(loose, [list(b) for j, b in enumerate(bins) if j not in gone], [f for j, f in enumerate(fills) if j not in gone], rng)

    def crossover(self, a: tuple[list, list], b: tuple[list, list], rng: random.Random) -> tuple[list, list]:
        """Well-filled bins of a, whole; the bins of b that share no piece with them; the displaced, put back."""
        given = [(list(x), f) for x, f in zip(*a, strict=True) if f >= 0.995 * self.capacity and rng.random() < 0.5]
        inside = {i for x, _ in given for i in x}
        loose = []
        for x, f in zip(*b, strict=True):
            if inside.isdisjoint(x):
                given.append((list(x), f))
            else:
                loose += [i for i in x if i not in inside]
        return self.completed(loose, [x for x, _ in given], [f for _, f in given], rng)


NOISE = (0, 0.02, 0.1, 0.3, 0.6, 1.0)


def evolve(sizes: list[int], seeds: list[list[int]], seed: int, capacity: int, population: int = 6, effort: int = 300_000) -> tuple[list[int], float]:
    """The best packing found, as the bin of each item, and its fitness. seeds: packings to begin with.

    Generations take time in proportion to the items: there are effort / items of them, 12 at least and 200 at most.
    """
    p, rng = Packing(sizes, capacity), random.Random(seed)
    least, pool = bound(sizes, capacity), []
    for s in seeds:
        bins: dict[int, list[int]] = {}
        for i, b in enumerate(s):
            bins.setdefault(b, []).append(i)
        pool.append((list(bins.values()), [sum([sizes[i] for i in b]) for b in bins.values()]))
    while len(pool) < population and all(len(x[0]) > least for x in pool):
        pool.append(p.shaken(rng, NOISE[len(pool) % len(NOISE)]))
    scored = sorted(((-p.fitness(x[1]), k, x) for k, x in enumerate(pool)), key=lambda v: v[:2])
    k = len(pool)
    for _ in range(min(200, max(12, effort // max(1, len(sizes))))):
        if len(scored[0][2][0]) <= least:
            break
        (*_, a), (*_, b) = rng.sample(scored, 2)
        for child in (p.crossover(a, b, rng), p.crossover(b, a, rng), p.mutated(scored[0][2], rng), p.mutated(rng.choice(scored)[2], rng)):
            k += 1
            f = -p.fitness(child[1])
            if all(abs(f - v[0]) > 1e-12 for v in scored):  # no two alike
                scored.append((f, k, child))
        scored = sorted(scored, key=lambda v: v[:2])[:population]
    out = [0] * len(sizes)
    for j, b in enumerate(scored[0][2][0]):
        for i in b:
            out[i] = j
    return out, -scored[0][0]


STATE = "shard int, island int, uids array<long>, sizes array<int>, elite array<int>, fitness double"
NAMES = [x.split()[0] for x in STATE.split(", ")]


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = 24_000, islands: int = 2, rounds: int = 2, well_filled: float = 0.98) -> DataFrame:
    """(uid, sequence_id, offset) for items (uid long, size int), sizes 1 to capacity."""
    level, before, done = 0, 0, []
    left = items
    count = left.count()
    while True:
        n = max(1, -(-count // shard))
        final = level > 0 and n >= before or n == 1  # opening bins once more would take as many shards: they stay
        left = left.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(n)).cast("int"))
        # one row per shard: about `shard` pairs of numbers, evened out by the hash of the row number
        state = left.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("size", "uid"))).alias("x"))
        state = state.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("x.uid").alias("uids"), F.col("x.size").cast("array<int>").alias("sizes"), F.lit(None).cast("array<int>").alias("elite"), F.lit(None).cast("double").alias("fitness"))
        for turn in range(rounds):
            if turn:  # the elite of island i - 1 visits island i
                guests = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("elite").alias("guest"))
                state = state.join(guests, ["shard", "island"])
            else:
                state = state.withColumn("guest", F.lit(None).cast("array<int>"))
            state = state.repartition(n * islands, "shard", "island")

            def run(batches, turn=turn, level=level, capacity=capacity):
                for batch in batches:
                    for row in batch.to_pylist():
                        seeds = [x for x in (row["elite"], row["guest"]) if x is not None]
                        row["elite"], row["fitness"] = evolve(row["sizes"], seeds, hash((level, turn, row["shard"], row["island"])), capacity)
                        yield pa.RecordBatch.from_pylist([{k: row[k] for k in NAMES}], schema=pa.schema([("shard", pa.int32()), ("island", pa.int32()), ("uids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("elite", pa.list_(pa.int32())), ("fitness", pa.float64())]))

            state = stored(state.select(*NAMES, "guest").mapInArrow(run, STATE), "islands")
        best = state.groupBy("shard").agg(F.max_by(F.struct("uids", "sizes", "elite"), F.struct("fitness", -F.col("island"))).alias("b")).select("shard", "b.*")

        def place(batches, capacity=capacity, floor=0 if final else well_filled * capacity, level=level):
            for batch in batches:
                for row in batch.to_pylist():
                    fill, cols = {}, ([], [], [], [], [])
                    for i, b in enumerate(row["elite"]):
                        fill[b] = fill.get(b, 0) + row["sizes"][i]
                    at: dict[int, int] = {}
                    for i, b in enumerate(row["elite"]):
                        for col, v in zip(cols, (row["uids"][i], row["sizes"][i], (level << 52) + (row["shard"] << 24) + b, at.get(b, 0), fill[b] >= floor), strict=True):
                            col.append(v)
                        at[b] = at.get(b, 0) + row["sizes"][i]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["uid", "size", "sequence_id", "offset", "good"])

        placed = stored(best.mapInArrow(place, "uid long, size int, sequence_id long, offset long, good boolean"), "placed")
        done.append(placed.where("good").select("uid", "sequence_id", "offset"))
        left = placed.where("not good").select("uid", "size")
        rest = left.count()
        if not rest:
            break
        level, before, count = level + 1, n, rest
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def packed(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", carry: list[str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: `row`, piece, start, length, ids_crc32, sequence_id and offset."""
    rows = tokenized(docs, vocabulary, pattern, text, carry, capacity).select("row", F.explode("pieces").alias("p")).select("row", "p.*")
    rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    own = rows.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    short = rows.where(F.col("length") < capacity)
    found = pack(short.select("uid", F.col("length").cast("int").alias("size")), capacity)
    return own.unionByName(short.join(found, "uid")).select("row", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
