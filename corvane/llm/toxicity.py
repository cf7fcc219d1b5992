"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length, with exception phrases.

Folding lower-cases, strips marks from homoglyphs of Latin letters and undoes digit and symbol substitutions inside
words ("1d10t" is "idiot"); the plain and the folded form are both looked up. The lexicon is learned: every folded word
and every word beginning of 4 to 6 letters is a candidate term, counted per class over labelled documents; terms whose
smoothed log odds are high and well supported stay, weighted by these log odds. A two-word phrase around a term that
clean documents use and toxic ones never do becomes an exception, which cancels the terms inside it. A document's raw
score is the sum of its hits' weights over log2(2 + words); a one-variable logistic curve, fitted on the same labelled
rows, turns it into 0..1.

`sample` bounds the labelled rows that are learned from (those with the smallest hash of their id), and by that the
lexicon; scoring covers every row. Defined cases: null and empty texts have no hit and get the curve's value at 0; no
labelled rows, or one class only: the lexicon is empty and the score is the smoothed share of toxic labels; null labels
and ids teach nothing; several labels of one id: the largest holds; several texts of one id: the least is learned from;
repeated rows score alike; of several hits at one word the heaviest counts; input columns are carried in `row`.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.rows import map_text, name
from corvane.scratch import stored

#: Letters of other scripts that look like Latin ones, and substitutions for letters.
HOMOGLYPHS = dict(zip("асеорхуіјѕԁһӏвкмнтгαοερτυικνѵ", "aceopxyijsdhlbkmhtraoeptuikvv", strict=True))
LEET = dict(zip("013457@$!|8", "oieastasiib", strict=True))
_FOLD = str.maketrans(HOMOGLYPHS | {"ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l"})
_DELEET = str.maketrans(LEET)
WORD = re.compile(r"[^\s.,;:?\"()\[\]{}/\\]+")
_HAS_LEET = re.compile(r"[013457@$!|8]")
FIELDS = "score double, predicted int, n_hits long, weight double"


def fold(word: str) -> str:
    """One lower-cased word, homoglyphs and substitutions folded, other marks than letters at its ends dropped."""
    if not word.isascii():
        word = unicodedata.normalize("NFKC", word).translate(_FOLD)
    if _HAS_LEET.search(word):
        bare = word.strip("!|$*#%&'")
        if any(c.isalpha() for c in bare):
            word = bare.translate(_DELEET)
    return word.strip("!|$*#%&'-_<>") or word


def folder(most: int = 200_000):
    """Text to folded words; distinct words are folded once, `most` of them remembered."""
    known: dict[str, str] = {}

    def folded(b: bytes) -> list[str]:
        words = WORD.findall(b.decode("utf-8", "replace").lower())
        try:
            return [known[w] for w in words]
        except KeyError:
            if len(known) > most:
                known.clear()
            for w in {x for x in words if x not in known}:
                known[w] = fold(w)
            return [known[w] for w in words]

    return folded


def split_of(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(by))


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column, sample: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(text, y) of at most `sample` labelled documents, one for each id: those that are in `labels` and pass `keep`."""
    ids = labels.select(name(key).alias("_id"), name(label).cast("int").alias("y")).where("_id is not null and y is not null").where(keep)
    ids = ids.groupBy("_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64(F.col("_id"), F.lit(17)), "_id").limit(sample)
    return docs.select(name(key).alias("_id"), name(text).cast("string").alias("text")).where("text is not null").join(F.broadcast(ids), "_id").groupBy("_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")


def term_counts(train: DataFrame, most: int = 300_000) -> DataFrame:
    """(t, a, b): documents with label 1 and with label 0 that have the candidate term, `=word` or `^beginning`.

    Each task adds up its own counts and passes them on whenever it holds `most` terms.
    """

    def run(batches):
        import pyarrow as pa

        folded, held = folder(), ({}, {})

        def out():
            terms = list(held[0].keys() | held[1].keys())
            got = pa.RecordBatch.from_pydict({"t": terms, "a": pa.array([held[1].get(t, 0) for t in terms], pa.int64()), "b": pa.array([held[0].get(t, 0) for t in terms], pa.int64())})
            held[0].clear(), held[1].clear()
            return got

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, into = set(folded((text or "").encode())), held[int(y == 1)]
                for t in {"=" + w for w in words} | {"^" + w[:n] for w in words for n in (4, 5, 6) if len(w) >= n}:
                    into[t] = into.get(t, 0) + 1
                if len(held[0]) + len(held[1]) > most:
                    yield out()
        yield out()

    return train.select("text", "y").mapInArrow(run, "t string, a long, b long").groupBy("t").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


class Lexicon:
    """Terms, weights, exceptions and the curve; `matcher()` builds the automaton."""

    def __init__(self, weights: dict[str, float], exceptions: frozenset = frozenset(), curve: tuple[float, float] = (1.0, 0.0)):
        self.weights, self.exceptions, self.curve = weights, exceptions, curve

    def matcher(self):
        import ahocorasick

        auto = ahocorasick.Automaton()
        for t, w in self.weights.items():
            auto.add_word(" " + t[1:] + (" " if t[0] == "=" else ""), (t, w))
        for e in self.exceptions:
            auto.add_word(f" {e} ", ("!", e))
        if len(auto):
            auto.make_automaton()
        slope, base = self.curve
        folded = folder()

        def hits(b: bytes | None) -> tuple[int, list]:
            """Words, and the best hit of each hit word that no exception covers: (place, weight)."""
            words = folded(b) if b else []
            line = " " + " ".join(words) + " "
            best: dict[int, float] = {}
            free: list[tuple[int, int]] = []
            for end, (t, w) in auto.iter(line) if len(auto) else ():
                if t == "!":
                    free.append((end - len(w) - 1, end))
                else:
                    at = end - len(t) + (0 if t[0] == "=" else 1)
                    best[at] = max(best.get(at, 0.0), w)
            if free:  # exceptions in the order of their beginnings, each with the farthest end so far
                free.sort()
                ends = list(accumulate((z for _, z in free), max))
                begins = [a for a, _ in free]
                best = {k: v for k, v in best.items() if not (n := bisect_right(begins, k)) or ends[n - 1] <= k}
            return len(words), [(line, k, v) for k, v in best.items()]

        def score(texts: list) -> list:
            out = [[], [], [], []]
            for b in texts:
                n, found = hits(b)
                total = sum(v for *_, v in found)
                z = slope * total / math.log2(2 + n) + base
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
                for col, v in zip(out, (p, int(p >= 0.5), len(found), total), strict=True):
                    col.append(v)
            return out

        score.hits = hits
        return score


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """A logistic curve of one variable, by Newton steps with a light ridge."""
    a = np.stack([x, np.ones_like(x)], 1)
    share = (y.sum() + 1) / (len(y) + 2)
    w = np.array([0.0, math.log(share / (1 - share))])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(h, a.T @ (p - y) + np.array([1e-3, 0]) * w)
        w -= np.clip(step, -4, 4)
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def specific(found: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Weights of terms; a beginning goes where one longer term or word explains nearly all of its documents."""
    kept: dict[str, float] = {}
    most: dict[str, int] = {}  # of each beginning: documents of its largest kept term
    for t in sorted(found, key=lambda t: (t[0] != "=", -len(t), t)):
        a, w = found[t]
        if t[0] == "^" and most.get(t[1:], 0) >= 0.85 * a:
            continue
        kept[t] = w
        for n in range(4, len(t) - (t[0] == "^")):
            most[t[1 : n + 1]] = max(most.get(t[1 : n + 1], 0), a)
    return kept


def learn(train: DataFrame, support: int = 6, odds: float = 3.0) -> Lexicon:
    """A Lexicon from (text, y) rows. Counts are made on the executors; the driver gets the chosen terms only,
    which the rows bound."""
    train = stored(train, "toxic-train")
    n = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    tox, clean = n.get(1, 0), n.get(0, 0)
    if not tox or not clean:
        share = (tox + 1) / (tox + clean + 2)
        return Lexicon({}, curve=(0.0, math.log(share / (1 - share))))
    counts = term_counts(train)
    w = F.log((F.col("a") + 0.5) / (tox + 1)) - F.log((F.col("b") + 0.5) / (clean + 1))
    got = counts.where(F.col("a") >= support).withColumn("w", w).where(F.col("w") >= odds).collect()
    weights = specific({r["t"]: (r["a"], float(r["w"])) for r in got})
    first = Lexicon(weights)

    def phrases():
        hits = first.matcher().hits

        def near(texts: list) -> list:
            found = []
            for b in texts:
                mine = set()
                for line, at, _ in hits(b)[1]:
                    end = line.find(" ", at + 1)
                    left = line.rfind(" ", 0, at)
                    right = line.find(" ", end + 1)
                    if left >= 0:
                        mine.add(line[left + 1 : end])
                    if right >= 0:
                        mine.add(line[at + 1 : right])
                found.append(list(mine))
            return [found]

        return near

    near = map_text(train, phrases, "near array<string>", "text", ["y"])
    by = near.select(F.col("row.y").alias("y"), F.explode("near").alias("p")).groupBy("p").agg(F.sum(F.col("y").cast("long")).alias("a"), F.count("*").alias("n"))
    exceptions = frozenset(r["p"] for r in by.where("a = 0 and n >= 3").collect())
    unit = Lexicon(weights, exceptions, (1.0, 0.0))
    scored = map_text(train, unit.matcher, FIELDS, "text", ["y"]).select("row.y", F.log(F.col("score") / (1 - F.col("score"))).alias("x")).toPandas()  # two numbers for each sampled row
    return Lexicon(weights, exceptions, fit_curve(scored["x"].to_numpy(float), scored["y"].to_numpy(float)))


def toxicity(docs: DataFrame, lexicon: Lexicon, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`row` and the columns of FIELDS for every row."""
    return map_text(docs, lexicon.matcher, FIELDS, text, carry)
