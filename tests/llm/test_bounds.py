"""Results don't depend on what is broadcast; long texts; columns of any name; licence templates against a plain walk."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import components, license_scan, mil, minhash, packing, quality_rules, substring

RNG = random.Random(11)
WORDS = [f"w{i}" for i in range(300)]


def text(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def rows():
    base, passage = [text(120) for _ in range(8)], text(60)
    texts = [None, "", "one", *base, *base[:4], *[b + " x" for b in base[:4]], *[b.replace("w1", "q", 1) for b in base], *[text(30) + " " + passage + " " + text(10) for _ in range(6)], "# " * 300, *["short one"] * 12]
    return [(i if i % 9 else None, t, ["a.org", "b.org", None, "bad"][3 if t == "short one" else i % 3], "en", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, source string, lang string, n_chars long").repartition(3).cache()


@pytest.fixture
def nothing_broadcast(spark, monkeypatch):
    for module in (quality_rules, minhash, substring):
        monkeypatch.setattr(module, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(components, "small", lambda df, tag, most=0: components.stored(df, tag))
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def results(docs, only=range(4)):
    sort = lambda df: sorted(map(repr, df.collect()))
    edges = docs.sparkSession.createDataFrame([(i, i // 3) for i in range(60)] + [(7, 59), (100, 101)], "a long, b long")
    jobs = [
        lambda: quality_rules.quality_rules(docs, min_words=3, host_limit=0.2).select("row.*", "n_words", "host_rejected", "kept"),
        lambda: minhash.near_duplicates(docs.withColumn("doc_id", F.monotonically_increasing_id()), limit=80),
        lambda: substring.substring_dedup(docs).select("row.*", "n_removed", "kept"),
        lambda: components.components(edges),
    ]
    return [sort(jobs[i]()) for i in only]


@pytest.fixture(scope="module")
def usual(docs):
    return results(docs)


def test_nothing_broadcast(docs, usual, nothing_broadcast):
    assert results(docs) == usual
    assert any("host_rejected=True" in r for r in usual[0]) and any("kept=True" in r for r in usual[0])


def test_near_stage_without_broadcast(docs, nothing_broadcast):
    want = sorted(map(repr, corpus_pipeline.distinct_documents(docs.sparkSession, docs, "").collect()))
    minhash.BROADCAST_ROWS = 1_000_000  # the fixture puts back what was
    assert sorted(map(repr, corpus_pipeline.distinct_documents(docs.sparkSession, docs, "").collect())) == want and 0 < len(want) < len(rows())


def test_columns_of_any_name(spark):
    """Every stage but the last returns the columns that came, whatever their names, with their values."""
    names = ["_row", "row", "_id", "doc", "d", "class", "host", "cluster", "k", "a.b", "text_", "component_id", "n_words", "kept", "x y"]
    one, two = text(80), text(70)
    data = [(i, t, "s", "en", len(t), *[f"{n}{i}" for n in names]) for i, t in enumerate([one, one, two, text(60)])]
    df = spark.createDataFrame(data, ["doc_id", "text", "source", "lang", "n_chars", *names])
    for stage in (corpus_pipeline.quality, corpus_pipeline.distinct_documents, corpus_pipeline.without_repeats):
        got = stage(spark, df, "")
        assert got.columns == df.columns
        for r in got.collect():
            assert list(r[5:]) == [f"{n}{r.doc_id}" for n in names]
    assert sorted(r.doc_id for r in corpus_pipeline.distinct_documents(spark, df, "").collect()) == [0, 2, 3]
    clash = df.withColumnsRenamed({"row": "piece", "doc": "offset", "d": "sequence_id", "class": "length"})
    import public_tokenizers

    assert packing.packed(clash, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).select("row.*").columns == clash.columns


def walked(template, words):
    """Whether some run of words satisfies the template, by trying every way."""

    def go(parts, at):
        if not parts:
            return True
        p, rest = parts[0], parts[1:]
        if isinstance(p, str):
            return at < len(words) and words[at] == p.encode() and go(rest, at + 1)
        if p[0] == "opt":
            return go([*p[1], *rest], at) or go(rest, at)
        return any(at + n <= len(words) and go(rest, at + n) for n in range(p[1], p[2] + 1))

    return any(go(license_scan.parse(template), i) for i in range(len(words)))


def test_templates_against_a_walk():
    templates = {"one": "a <<opt>>b <<opt>>c<</opt>><</opt>> <<var 0-2>> d", "two": "a b", "three": "<<opt>>a<</opt>> c <<var 2-3>> c", "four": "d <<opt>><<var 1-1>> a<</opt>>"}
    match = license_scan.Matcher(templates)
    rng = random.Random(2)
    for _ in range(3000):
        words = [rng.choice([b"a", b"b", b"c", b"d", b"e"]) for _ in range(rng.randint(0, 9))]
        assert match.labels(words) == {k for k, t in templates.items() if walked(t, words)}, words


def test_long_licence_texts():
    scan = license_scan.scanner()()
    began = time.time()
    got = scan([b"licensed " * 1_000_000, b"all rights " * 300_000, b"copyright " * 500_000 + b"all rights reserved"])
    assert time.time() - began < 20 and got[5] == ["", "", "reserved,reserved-notice"] and got[0][0] == 1_000_000


def test_cut_licences_are_refused():
    """Of each whole licence a text without its last word, or without one in the middle, isn't taken for it."""
    import re

    scan = license_scan.scanner()()
    for label in ("mit-text", "isc-text", "bsd-2-clause", "bsd-3-clause", "apache-2.0-header"):
        words = re.sub(r"<<opt>>|<</opt>>", "", re.sub(r"<<var \d+-\d+>>", "someone", license_scan.TEMPLATES[label])).split()
        whole, cut, hole = (" ".join(x).encode() for x in (words, words[:-1], words[:60] + words[61:]))
        got = [set(x.split(",")) for x in scan([whole, cut, hole])[5]]
        assert label in got[0] and label not in got[1] and label not in got[2], label


def test_passages_learned_from_are_bounded(spark):
    """A very long labelled text isn't brought to the driver; the rest is learned as without it."""
    good, bad = [(text(60 + i), 1) for i in range(40)], [("# | # " * (30 + i), 0) for i in range(40)]
    rows = spark.createDataFrame([*good, *bad], "text string, y int")
    long = spark.createDataFrame([("long " * 64 * 2000, 1)], "text string, y int")
    whole, bounded = mil.learn(rows, steps=20), mil.learn(rows.union(long), learned=8000, steps=20)
    assert all(np.array_equal(v, bounded.p[k]) for k, v in whole.p.items())
    assert mil.taken([(3, 10), (1, 5), (2, 90)], 800) is None
    assert mil.taken([(3, 10), (1, 5), (2, 90), (4, 101)], 800) == {1, 2, 3}
    assert mil.taken([(i, 10) for i in range(20)], 90) == set(range(9))


def test_a_step_in_groups_has_the_same_gradient():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 9, 12)
    stats, counts = rng.normal(size=(size.sum(), mil.N_FEATURES)), rng.integers(0, 3, (size.sum(), mil.HASHED))
    first, y, n = np.cumsum(np.append(0, size[:-1])), rng.integers(0, 2, 12).astype(float), mil.N_FEATURES + mil.HASHED
    model = mil.Model({"mean": np.zeros(mil.N_FEATURES), "scale": np.ones(mil.N_FEATURES), "W": rng.normal(size=(n, 3)) / 5, "b": rng.normal(size=3), "V": rng.normal(size=(3, 2)), "U": rng.normal(size=(3, 2)), "w": rng.normal(size=2), "c": rng.normal(size=3), "d": np.array(0.3)})
    pick = rng.integers(0, 12, 10)
    one, many = (mil.step_gradient(model, stats, counts, first, size, y, pick, most) for most in (10**6, 7))
    assert len(mil.groups(size[pick], 7)) > 4 and [hi - lo for lo, hi in mil.groups(np.array([9, 1, 1, 9]), 7)] == [1, 2, 1]
    assert one.keys() == many.keys() and all(np.allclose(one[k], many[k]) for k in one)


def test_extension_against_all_pairs():
    rng = np.random.default_rng(5)
    n, width, need = 300, 6, 6
    anchor = rng.integers(0, 6, n)
    left, right = rng.integers(1, 3, (2, n, width)).astype(np.uint64)
    n_left, n_right = rng.integers(0, width + 1, (2, n))
    left[np.arange(width) >= n_left[:, None]] = 0
    right[np.arange(width) >= n_right[:, None]] = 0

    def common(x, y, most):
        k = 0
        while k < most and x[k] == y[k]:
            k += 1
        return k

    want = [(-1, -1)] * n
    for i in range(n):
        for j in range(n):
            if i != j and anchor[i] == anchor[j]:
                a, b = common(left[i], left[j], min(n_left[i], n_left[j])), common(right[i], right[j], min(n_right[i], n_right[j]))
                if a + b >= need:
                    want[i] = (max(want[i][0], a), max(want[i][1], b))
    lo, hi = substring.extended(anchor, left, n_left, right, n_right, need)
    assert list(zip(lo.tolist(), hi.tolist(), strict=True)) == want and 20 < sum(x >= 0 for x, _ in want) < n
    none = substring.extended(anchor[:0], left[:0], n_left[:0], right[:0], n_right[:0], need)
    assert [len(x) for x in none] == [0, 0]


@pytest.mark.parametrize("contexts,group", [(4096, 16_384), (4096, 5), (3, 5), (0, 5)])
def test_repeats_with_many_contexts(spark, monkeypatch, contexts, group):
    """Pieces of one passage, from any word on and of any length, between other words: many contexts an anchor."""
    monkeypatch.setattr(substring, "CONTEXTS", contexts)
    monkeypatch.setattr(substring, "GROUP_ROWS", group)
    rng = random.Random(13)
    passage = [f"p{i}" for i in range(90)]
    texts = []
    for i in range(40):
        at, n = rng.randrange(60), rng.randint(25, 60)
        words = [*(f"{i}a{k}" for k in range(rng.randint(0, 12))), *passage[at : at + n], *(f"{i}b{k}" for k in range(rng.randint(0, 12)))]
        texts.append(words * (2 if i % 10 == 0 else 1))
    texts += [["same"] * 80, ["same"] * 34, ["same"] * 35]
    where = {}
    for w in texts:
        for i in range(len(w) - 34):
            where[tuple(w[i : i + 35])] = where.get(tuple(w[i : i + 35]), 0) + 1
    got = {r.doc_id: r for r in substring.substring_dedup(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")).select("row.doc_id", "n_removed", "kept").collect()}
    for k, w in enumerate(texts):
        gone = {i + d for i in range(len(w) - 34) if where[tuple(w[i : i + 35])] > 1 for d in range(35)}
        assert (got[k].n_removed, got[k].kept) == (len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)), k
    assert 500 < sum(r.n_removed for r in got.values()) < sum(map(len, texts))


def test_components_leave_few_files(spark, tmp_path, monkeypatch):
    """However many partitions a shuffle has, rounds on few edges write few files, and only the last table stays."""
    from corvane import scratch

    monkeypatch.setattr(scratch, "shared_dir", lambda s: f"file://{tmp_path}")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "20")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = components.components(spark.createDataFrame([(i, i + 1) for i in range(20)] + [(300, 301)], "a long, b long"))
        assert {(r.node, r.root) for r in got.collect()} == {(i, 0) for i in range(21)} | {(300, 300), (301, 300)}
        assert len(list((tmp_path / "corvane").iterdir())) == 1 and len(list(tmp_path.rglob("part-*"))) == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
