"""Hard negatives, nearest neighbours and collocations against brute force, and their edge cases."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import bit_codes, collocations, hard_negatives
from corvane.llm.dense import Best, chunks, matrices

RNG = np.random.default_rng(3)
NAN, INF = float("nan"), float("inf")


def vectors():
    base = RNG.normal(size=(12, 16))
    rows = [(i, [float(np.float32(x)) for x in base[i % 12] + 0.7 * RNG.normal(size=16)], i % 4) for i in range(700)]
    rows[10] = (10, rows[20][1], 0)  # ties
    rows[11] = (11, rows[20][1], 1)
    odd = [(700, None, 1), (720, rows[20][1], None), (740, [NAN] * 16, 1), (760, [INF] + [1.0] * 15, 2), (780, [None] + [1.0] * 15, 2), (800, [0.0] * 16, 1), (820, [1.0, 2.0], 1), (821, [1.0, 2.0], 1), (822, [0.9, 1.0], 2), (840, [], 1), (None, rows[20][1], 1)]
    return [*rows, *odd, rows[30], rows[30], rows[40]]  # repeated rows, a repeated asked one


ROWS = vectors()


def frame(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.withColumns({"rank": F.lit("mine"), "score": F.lit(1), "id": F.lit(2), "number": F.lit(0), "a.b": F.lit(0)}).repartition(3)


def usable(zero):
    for i, v, label in ROWS:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            yield i, v, label


def negatives_by_hand(every, positives=3, negatives=4):
    rows = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in usable(True) if label is not None]
    out = []
    for i, v, label in rows:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other == label) for j, w, other in rows if j != i and len(w) == len(v))
        for p, j, _ in [x for x in scored if x[2]][:positives]:
            hits = [x for x in scored if not x[2] and 30 * -p <= 100 * -x[0] <= 90 * -p][:negatives]
            out += [(i, j, r, n, -p, -s) for r, (s, n, _) in enumerate(hits, 1)]
    return sorted(out)


@pytest.mark.parametrize("leaf,tree,block", [(128, 8192, 2048), (4, 50, 3)])
def test_hard_negatives(spark, monkeypatch, leaf, tree, block):
    monkeypatch.setattr(hard_negatives, "LEAF", leaf)
    monkeypatch.setattr(hard_negatives, "TREE_ROWS", tree)
    got = hard_negatives.hard_negatives(frame(spark), F.col("vec_id") % 20 == 0, positives=3, negatives=4, block=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == negatives_by_hand(20)


def test_ball_trees_prune():
    """Rows in far groups: most leaves are never scored, and every node holds its rows."""
    centres = 1000 * RNG.normal(size=(8, 16))
    z = hard_negatives.grid(np.repeat(centres, 256, axis=0) + RNG.normal(size=(2048, 16)), 4)
    ids, labels = np.arange(2048), np.arange(2048) % 3
    t = hard_negatives.built(ids, labels, z)
    centre, radius = np.frombuffer(t["centres"]).reshape(-1, 16), np.frombuffer(t["radii"])
    stored = np.frombuffer(t["grid"], np.int32).reshape(-1, 16)
    for level in range(hard_negatives.depth(2048) + 1):
        c = hard_negatives.cuts(2048, level)
        for k, (s, e) in enumerate(zip(c[:-1], c[1:])):
            node = (1 << level) - 1 + k
            assert np.sqrt(((stored[s:e] - centre[node]) ** 2).sum(1)).max() <= radius[node] + 1e-6
    asked = hard_negatives.Requests(z[:4], ids[:4], labels[:4], np.arange(4), np.arange(4), np.full(4, -(1 << 63)), np.full(4, (1 << 63) - 1), 5, True)
    seen = []
    plain = asked.score
    asked.score = lambda s, e, a: (seen.append((s, e)), plain(s, e, a))
    asked.visit(t)
    assert sum(e - s for s, e in seen) <= 1024  # half of the rows at most
    for r in range(4):
        want = sorted((-int(z[j] @ z[r]), j) for j in range(2048) if j != r and labels[j] == labels[r])[:5]
        own = asked.best.request == r
        assert sorted(zip(-asked.best.score[own], asked.best.id[own])) == want


def test_exact_products():
    a = np.array([[1 << 40, 3]], np.int64)
    assert hard_negatives.products(a >> 10, a >> 10)[0, 0] == (1 << 60)
    with pytest.raises(OverflowError):
        hard_negatives.products(a, a)
    with pytest.raises(OverflowError):
        hard_negatives.grid(np.array([[1e30]]), 256)


def nearest_by_hand(every, k):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in usable(False)]
    out = []
    for i, v in rows:
        if i % every == 0:
            scored = sorted((-float((v * w).sum()), j) for j, w in rows if j != i and len(w) == len(v))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("page,block", [(4096, 2048), (60, 7)])
def test_nearest(spark, monkeypatch, page, block):
    monkeypatch.setattr(bit_codes, "PAGE_ROWS", page)
    got = bit_codes.nearest(frame(spark), F.col("vec_id") % 20 == 0, 10, block=block)
    assert got.columns == ["query_id", "rank", "id", "score"]
    got, want = sorted(map(tuple, got.collect())), nearest_by_hand(20, 10)
    mine, theirs = Counter((q, i) for q, _, i, _ in got), Counter((q, i) for q, _, i, _ in want)
    assert sum((mine & theirs).values()) >= 0.98 * len(want) and len(got) == len(want)
    exact = {(q, i): s for q, _, i, s in want}
    assert all(exact.get((q, i), s) == s for q, _, i, s in got)
    by = defaultdict(list)
    for q, r, i, s in sorted(got):
        by[q].append((r, -s, i))
    order = [x[2] for x in by[20]]
    assert order.index(10) + 1 == order.index(11) < order.index(720)  # equal scores: the smaller id
    assert [x[0] for x in by[820]] == [1, 2] and {x[2] for x in by[820]} == {821, 822}  # fewer rows than asked for


def test_few_codes_are_reranked():
    """The bound holds back most rows, and estimates are right on average."""
    m = RNG.normal(size=(4000, 128)).astype(np.float32).astype(np.float64)
    p = bit_codes.page(np.arange(4000), m, np.float32)
    asked = bit_codes.Asked(np.arange(30), np.arange(30), m[:30], 10, bit_codes.WIDTH)
    seen = []
    plain = asked.rerank
    asked.rerank = lambda ids, v, rows, asks, some: (seen.append(len(rows)), plain(ids, v, rows, asks, some))
    asked.visit(p)
    assert sum(seen) < 0.5 * 30 * 4000
    hits = 0
    for q in range(30):
        s = m @ m[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:10]) & set(asked.best.id[asked.best.request == q]))
    assert hits >= 297
    numbers = np.frombuffer(p["numbers"]).reshape(3, -1)
    codes = np.unpackbits(np.frombuffer(p["codes"], np.uint8).reshape(4000, -1), axis=1) * 2.0 - 1
    centre = np.frombuffer(p["centre"])
    turned = bit_codes.rotated(m[:30]) - bit_codes.rotated(centre[None, :])
    off = (codes @ turned.T) * numbers[0][:, None] - (m - centre) @ (m[:30] - centre).T
    assert abs(off.mean()) < 0.5 and (np.abs(off) > 3 * numbers[1][:, None] * np.linalg.norm(turned, axis=1)).mean() < 0.01
    assert np.allclose(np.linalg.norm(bit_codes.rotated(m), axis=1), np.linalg.norm(m, axis=1))


def test_nothing_to_search(spark):
    none = frame(spark).where("false")
    assert hard_negatives.hard_negatives(none, F.col("vec_id") % 20 == 0).count() == 0
    assert bit_codes.nearest(none, F.col("vec_id") % 20 == 0).count() == 0
    assert bit_codes.nearest(frame(spark), F.col("vec_id") % 20 == 21).count() == 0
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_chunks_are_bounded():
    parts = [(np.arange(40), np.ones((40, d))) for d in (2, 3, 2, 2)]
    got = list(chunks(iter(parts), 50))
    assert all(len(i) <= 50 for i, _ in got) and sum(len(i) for i, _ in got) == 160
    assert sorted(m.shape[1] for _, m in got) == [2, 2, 2, 3] or sum(len(i) for i, m in got if m.shape[1] == 3) == 40
    best = Best(1, 2, np.int64)
    best.add(np.zeros(4, np.int64), np.array([4, 3, 2, 1]), np.array([5, 5, 9, 5]), True)
    assert best.id.tolist() == [2, 1] and best.least.tolist() == [5]
    assert list(matrices(frame_column([]))) == []


def frame_column(rows):
    import pyarrow as pa

    return pa.array(rows, pa.list_(pa.float32()))


def said_by_hand(rows, least, longest, cover, top):
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    count[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, f in count.items():
        c = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        kept = []
        for p, a in c.items():
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            if not any(len(q) > len(p) and 100 * c[q] >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q in c):
                score, _, left, right = min(cuts)
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r, p.decode(), -a, left, right, total[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def spoken():
    words = [f"w{i}" for i in range(30)] + ["Été", "中文", "\x00", "#", "A\xa0b"]
    fixed = ["new york city hall", "New York", "of the people", "a a a a a", "x\ty z"]
    text = lambda n: "".join(str(RNG.choice(fixed if RNG.random() < 0.3 else words)) + str(RNG.choice([" ", " ", " ", ", ", "\n", ".", "\t"])) for _ in range(n))
    rows = [(["en", "fr", None, "und"][i % 4], text(120)) for i in range(60)]
    return [*rows, rows[0], rows[0], ("en", None), ("en", ""), ("xx", " .\n"), ("en", "Very. long " * 3 + text(6000)), ("fr", "b " * 3000)]


@pytest.mark.parametrize("most,batch", [(1_000_000, 1_000_000), (0, 1_000_000), (0, 700), (1_000_000, 700)])
def test_collocations(spark, monkeypatch, most, batch):
    monkeypatch.setattr(collocations, "BATCH", batch)
    rows = spoken()
    df = spark.createDataFrame([(a, b, "mine", 1) for a, b in rows], "lang string, text string, phrase string, n int").repartition(3)
    got = sorted(map(tuple, collocations.collocations(df, least=5, top=40, broadcast_rows=most).collect()))
    assert got == said_by_hand(rows, 5, 4, 80, 40)


def test_large_counts_stay_exact(spark):
    """Scores beyond 64 bits on the way."""
    a, b = 9_000_000_000_000_000_000, 9_100_000_000_000_000_000
    df = spark.createDataFrame([(a, [b], [b])], "a long, heads array<long>, tails array<long>")
    assert df.select(F.expr(collocations.weakest_cut(2_000_000)).alias("c")).first().c.score == 2_000_000 * a // (2 * b)


def test_codes_round_trip():
    for c in (np.zeros(0, np.int32), np.array([-1, 0, 5, 2**31 - 1], np.int32)):
        assert collocations.unpacked(collocations.packed(c)).tolist() == c.tolist()
