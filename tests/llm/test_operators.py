"""Edge cases of every operator, and results against brute force on small fixtures."""

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corvane.llm import bpe, components, langid, license_scan, media, mil, minhash, packing, pieces, quality_rules, sketch, substring, toxicity
from corvane.llm.rows import map_text, slices
from corvane.llm.shingles import runs, shingle_set, word_hashes

RNG = random.Random(5)
VOCAB = [f"w{i}" for i in range(400)] + ["Été", "ß", "中文", "a" * 70, "A" * 70]


def words(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


BASE = [words(120) for _ in range(6)]
PASSAGE = words(60)
TEXTS = [None, "", " \n\t", "one", "two words", "two words", "TWO words", "a b c", "b c a b c a", *BASE, BASE[0], BASE[0].upper(), BASE[1] + " x", "y " + BASE[1], PASSAGE, words(30) + " " + PASSAGE + " " + words(20), words(3) + " " + PASSAGE, PASSAGE + " " + PASSAGE, "the " * 200, words(9000), "\n".join([BASE[2][:200]] * 3), "#*$%&|<> ### x", "all rights reserved"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["h1", "h2", None][i % 3], "kept", i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words string, row long").repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_slices_and_carried_rows(spark):
    df = spark.createDataFrame([(i, "x" * 3_000_000, str(i)) for i in range(7)], "k long, text string, tail string").coalesce(1)
    got = map_text(df, lambda: lambda texts: [[len(b) for b in texts]], "n long").select("row.k", "row.tail", "n").collect()
    assert sorted((r.k, r.tail, r.n) for r in got) == [(i, str(i), 3_000_000) for i in range(7)]


def test_quality_rules(docs, none):
    got = by_id(quality_rules.quality_rules(docs).select("row.*", F.col("n_words").alias("n"), "n_repeat_words", "n_dup_lines", "base_failed", "kept"))
    for i, t in enumerate(TEXTS):
        w = (t or "").encode().split()
        seen = Counter(zip(w, w[1:], w[2:]))
        cover = {j + d for j in range(len(w) - 2) if seen[tuple(w[j : j + 3])] > 1 for d in range(3)}
        assert (got[i].n, got[i].n_repeat_words) == (len(w), len(cover))
        assert got[i].base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        assert not (got[i].kept and got[i].base_failed) and got[i].n_words == "kept"
    assert quality_rules.quality_rules(none).count() == 0


def test_a_bad_host_is_rejected(spark):
    rows = [(i, "short" if i % 10 else BASE[0], "bad") for i in range(200)] + [(1000 + i, BASE[i % 6], f"good{i % 9}") for i in range(200)] + [(2000, "short", "tiny"), (2001, BASE[3], "tiny")]
    got = by_id(quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), carry=["doc_id"]).select("row.doc_id", "host_rejected", "kept"))
    assert got[10].host_rejected and not got[10].kept and got[1003].kept and got[2001].kept  # one failure of two is little


def tiktoken_of(path):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Ranks(path).vocabulary, special_tokens={})


def test_bpe_against_tiktoken(docs, none, spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken_of(path)
    some = ["aaaaaaaaaaaaaaaaaaaaaaaaaaaa  \n\n x", "🙂 don't　\x85'll ²½ <|endoftext|>\x1c\x1d x", "qzxvj qzxvj", "x" * 3000, "=" * 2000 + "ab" * 900, " " * 1500 + "q", "日本語のテキスト" * 200, "".join(RNG.choice("abcdefghij") for _ in range(4000))]
    some = docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(some, 100)), "doc_id long, text string"))
    for most, window in ((0, 256), (50, 2)):
        got = by_id(bpe.byte_bpe(some, path, public_tokenizers.PATTERN, broadcast_words=most, window=window).select("row.*", "ids", "decoded"))
        for i, r in got.items():
            assert r.ids == enc.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode(), i
    assert bpe.byte_bpe(none, path, public_tokenizers.PATTERN).count() == 0


def test_tables_of_the_fold_are_spelled_once_at_the_top(spark):
    """Every level above a literal copies its text when the plan is described: that filled the driver's memory."""
    got = bpe.byte_bpe(spark.createDataFrame([(1, "hello qzxvj")], "doc_id long, text string"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    text = got._jdf.queryExecution().optimizedPlan().children().apply(0).simpleString(25)
    above = [text.count("(", 0, m.start()) - text.count(")", 0, m.start()) for m in re.finditer(r"(?<![\d,])(?:-?\d+,){250}", text)]
    assert above and max(above) <= 4 and len(text) < 3_000_000


def test_a_word_of_100000_letters(spark):
    path, word = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "".join(RNG.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))
    got = bpe.byte_bpe(spark.createDataFrame([(1, word)], "doc_id long, text string"), path, public_tokenizers.PATTERN).first()
    assert got.ids == tiktoken_of(path).encode_ordinary(word) and bytes(got.decoded) == word.encode()


def test_pieces_are_those_of_the_pattern():
    import pyarrow as pa
    import regex

    parts = [" ", "  ", "\n", "\t", "\x1c", "\x85", "　", "a", "Z", "'", "'s", "'ll", "'re", "'t", "1", "²", "中", "🙂", "\x00", "é", " the", "...", "s", "l", "ve", "m"]
    split = regex.compile(public_tokenizers.PATTERN).findall
    assert pieces.PATTERN == public_tokenizers.PATTERN
    for _ in range(1500):
        texts = [None if RNG.random() < 0.1 else "".join(RNG.choice(parts) for _ in range(RNG.randint(0, 12))) for _ in range(RNG.randint(0, 4))]
        want = [split(t or "") for t in texts]
        for pattern in (pieces.PATTERN, pieces.PATTERN + "|x^"):
            found, first = pieces.cut(pa.array(texts, pa.string()), pattern)
            assert [w.decode() for w in found.to_pylist()] == [w for ws in want for w in ws]
            assert first.tolist() == [sum(map(len, want[:i])) for i in range(len(texts))]
    with pytest.raises(ValueError):
        pieces.cut(pa.array(["a b"]), "a")


def test_license_automata():
    scan = license_scan.scanner({"t": "a <<opt>>b <<opt>>c<</opt>><</opt>> <<var 1-2>> d"}, {"x y": "xy"})()
    ok = [b"a q d", b"a b q r d", b"z A b c q D", b"a a q d"]
    bad = [b"a d", b"a c c c d", b"b q d", b"a q r s d", None, b""]
    assert scan(ok)[5] == ["t"] * 4 and scan(bad)[5] == [""] * 6
    n, base, first, last, *_ = scan([b"x y x, y x"])
    assert (n, base, first, last) == ([5], [2], [0], [2])
    with pytest.raises(ValueError):
        license_scan.parse("a <<opt>> b")
    with pytest.raises(ValueError):
        license_scan.Automaton("<<opt>>a<</opt>>")


def test_license_scan(docs, none):
    got = by_id(license_scan.license_scan(docs).select("row.doc_id", "labels", "score"))
    assert got[len(TEXTS) - 1].labels == "reserved,reserved-notice" and got[0].score == 0
    assert license_scan.license_scan(none).count() == 0


def test_whole_licences():
    scan = license_scan.scanner()()
    text = {k: re.sub(r"<<opt>>|<</opt>>", "", re.sub(r"<<var \d+-\d+>>", "someone", v)).encode() for k, v in license_scan.TEMPLATES.items()}
    found = dict(zip(text, [x.split(",") for x in scan(list(text.values()))[5]], strict=True))
    assert all(k in v for k, v in found.items()) and {"mit-text", "mit-grant"} <= set(found["mit-text"]) and "bsd-2-clause" not in found["bsd-3-clause"]
    again = scan([text["mit-text"].replace(b" including the next paragraph", b""), text["mit-text"].replace(b"sublicense", b"license"), text["isc-text"].replace(b" or distribute", b", distribute").upper()])[5]
    assert again == ["mit-grant,mit-text", "mit-grant", "isc-text"]


def test_media_round_trip():
    for n in (0, 1, 63, 64, 65, 8064, 8065, 60000):
        p = media.payload_of(RNG.randbytes(n))
        m = media.mux(p)
        got = media.demux(m)
        assert len(m) % 188 == 0 and got["payload"] == p and got["cc_errors"] == got["faults"] == 0
        assert got["streams"] == {media.ES_PID: media.PRIVATE_DATA} and got["pts"] == [k * media.TICKS for k in range(len(got["pts"]))]
        assert got["raps"] == list(range(0, len(got["pts"]), media.RAP_EVERY))
    assert media.crc_mpeg(b"123456789") == 0x0376E6E7
    assert media._time(media._stamp(2**33 - 5)) == 2**33 - 5


def test_media_faults():
    m = media.mux(media.payload_of(RNG.randbytes(20000)))
    at = 188 * 20
    lost = media.demux(m[:at] + m[at + 188 :])
    assert lost["cc_errors"] == 1 and lost["faults"] == 1
    twice = media.demux(m[: at + 188] + m[at:])
    assert twice["cc_errors"] == 0 and twice["payload"] == media.demux(m)["payload"]
    assert media.demux(m[:at] + b"\x00" + m[at + 1 :])["faults"] >= 1
    assert media.demux(b"")["payload"] == b""


def test_media_tables_and_clock():
    m = media.mux(media.payload_of(RNG.randbytes(media.PES_BYTES * 20)))
    got = media.demux(m)
    assert got["tables"] == 2 * 3 and got["faults"] == got["cc_errors"] == 0  # sent before elementary packets 0, 8 and 16
    ahead = {(300 * t - c) % (300 << 33) for t, c in zip(got["pts"], got["pcr"], strict=True)}
    assert ahead == {300 * media.TICKS}
    shifted = media.demux(m[:1000] + m[1001:])  # a byte is lost: what follows is found again
    assert shifted["faults"] >= 1 and shifted["payload"][-5000:] == got["payload"][-5000:]


def test_media_of_two_streams():
    """Two elementary PIDs, interleaved, with a program map that spans packets."""
    other = media.ES_PID + 1
    entry = lambda pid, info: bytes([6]) + (0xE000 | pid).to_bytes(2, "big") + (0xF000 | len(info)).to_bytes(2, "big") + info
    section = media._section(2, 1, (0xE000 | media.ES_PID).to_bytes(2, "big") + b"\xf0\x00" + entry(media.ES_PID, b"\x05\xfa" + bytes(250)) + entry(other, b""))
    one, two = (media.payload_of(RNG.randbytes(n)) for n in (30000, 20000))

    def body(p):
        m = media.mux(p)
        packets = [m[k : k + 188] for k in range(0, len(m), 188)]
        return [x for x in packets if (x[1] & 31) << 8 | x[2] == media.ES_PID]

    a, b = body(one), [x[:1] + bytes([x[1], other & 255]) + x[3:] for x in body(two)]
    table = [media._packet(media.PMT_PID, True, 0, (b"\x00" + section)[:184]), media._packet(media.PMT_PID, False, 1, (b"\x00" + section)[184:].ljust(184, b"\xff"))]
    both = [x for k in range(max(len(a), len(b))) for x in a[k : k + 1] + b[k : k + 1]]
    got = media.demux(b"".join([media._TABLES[0][0], *table, *both]))
    assert got["faults"] == got["cc_errors"] == 0 and got["tables"] == 2
    assert got["elementary"][media.ES_PID]["payload"] == one == got["payload"] and got["elementary"][other]["payload"] == two
    assert got["elementary"][other]["raps"] == [0] and got["elementary"][media.ES_PID]["raps"] == [0]


def test_media_columns(docs, none):
    got = by_id(media.media_columns(docs).select("row.*", "payload_sha256", "payload_bytes", "tail_crc32"))
    for i, t in enumerate(TEXTS):
        p = media.payload_of((t or "").encode())
        assert (got[i].payload_sha256, got[i].payload_bytes, got[i].tail_crc32) == (hashlib.sha256(p).hexdigest(), len(p), zlib.crc32(p[-64:]))
    assert media.media_columns(none).count() == 0
    assert bytes(media.streams(docs.where("doc_id = 3")).first()["media"]) == media.mux(media.payload_of(b"one"))


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.packed(docs, path, public_tokenizers.PATTERN, carry=["doc_id", "text"]).select("row.*", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()
    tok, pieces, seqs = Tokenizer.from_file(path), {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(TEXTS):
        ids, mine = [*tok.encode(t or "", add_special_tokens=False).ids, 2], sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and len(mine) == -(-len(ids) // 1024)
        assert all(r.length == 1024 for r in mine[1:]) and sum(r.length for r in mine) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(array("I", ids[r.start : r.start + r.length]).tobytes()) for r in mine)
    for s in seqs.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(seqs) == -(-sum(r.length for r in got) // 1024)
    assert packing.packed(none, path, public_tokenizers.PATTERN).count() == 0


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, tok = packing.encoder(path, public_tokenizers.PATTERN), Tokenizer.from_file(path)
    parts = [" ", "\n", "\t", "\x1c", "\x85", "　", "a", "Z", "'s", "'ll", "1", "²", "中", "🙂", "\x00", "<|endoftext|>", " the", "hello", "..."]
    for _ in range(3000):
        s = "".join(RNG.choice(parts) for _ in range(RNG.randint(0, 12)))
        assert encode(s) == array("I", tok.encode(s, add_special_tokens=False).ids).tobytes(), s


def test_many_shards(spark):
    sizes = [RNG.randint(1, 100) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(sizes)), "uid long, size int")
    got = packing.pack(items, 100, shard=500).collect()
    fill = Counter()
    for r in got:
        fill[r.sequence_id] += sizes[r.uid]
    assert sorted(r.uid for r in got) == list(range(3000)) and max(fill.values()) <= 100
    assert len(fill) <= 1.03 * sum(sizes) / 100


def bins_of(packing_):
    return sorted(i for b in packing_[0] for i in b)


def test_the_operators_keep_every_item():
    sizes = [RNG.randint(1, 90) for _ in range(200)]
    p, rng = packing.Packing(sizes, 100), random.Random(3)
    a, b = p.shaken(random.Random(1), 0.3), p.shaken(random.Random(2), 0.3)
    for child in (p.crossover(a, b, rng), p.mutated(a, rng), p.mutated(b, rng)):
        assert bins_of(child) == list(range(200)) and [sum(sizes[i] for i in x) for x in child[0]] == child[1] and max(child[1]) <= 100
    assert bins_of(a) == bins_of(b) == list(range(200))


def test_the_search_beats_best_fit_decreasing():
    """Bins of 100 cut into pieces, so the least number is known; where best fit decreasing misses it, the search mostly doesn't."""
    rng, missed, found = random.Random(4), 0, 0
    for trial in range(12):
        sizes = []
        for _ in range(60):
            cuts = sorted(rng.sample(range(1, 100), rng.randint(1, 3)))
            sizes += [b - a for a, b in zip([0, *cuts], [*cuts, 100], strict=True)]
        seed, best = len(packing.Packing(sizes, 100).shaken(rng, 0)[0]), max(packing.evolve(sizes, [], trial, 100)[0]) + 1
        assert packing.bound(sizes, 100) == 60 <= best <= seed
        missed, found = missed + (seed > 60), found + (seed > 60 and best == 60)
    assert missed >= 6 and found >= 0.7 * missed


def test_the_bound():
    assert packing.bound([60] * 10, 100) == 10 and packing.bound([], 100) == 0 and packing.bound([100, 1], 100) == 2
    assert packing.bound([60] * 4 + [41] * 4, 100) == 6  # a 41 fits beside no 60
    for _ in range(200):
        sizes = [RNG.randint(1, 20) for _ in range(RNG.randint(1, 12))]
        assert packing.bound(sizes, 20) <= len(packing.Packing(sizes, 20).shaken(RNG, 0)[0])


def test_shards_stay_bounded(spark):
    """Pieces of which no two fit together: levels must not end in one shard of them all."""
    got = packing.pack(spark.range(1500).selectExpr("id as uid", "60 as size"), 100, shard=300).collect()
    assert len({r.sequence_id for r in got}) == len(got) == 1500
    assert max(Counter(r.sequence_id >> 24 for r in got).values()) < 400  # pieces of one level and shard


def test_word_hashes_and_runs():
    for t in ("", " ", "a", " a  b\na\x0bc ", "x" * 200 + " " + "x" * 201):
        w = t.encode().split()
        h = word_hashes(t.encode())
        assert len(h) == len(w) and all((h[i] == h[j]) == (w[i] == w[j]) for i in range(len(w)) for j in range(len(w)))
    h = word_hashes(b"a b c d a b c e")
    r = runs(h, 3)
    assert len(r) == 6 and r[0] == r[4] and len(set(r.tolist())) == 5 and len(runs(h, 9)) == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.8, 0.95):
        hits = []
        for _ in range(60):
            x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
            k = int(300 * 2 * share / (1 + share))
            y = np.concatenate((x[:k], rng.integers(0, 1 << 63, 300 - k, dtype=np.uint64)))
            hits.append((sketch.fill(x, 96) == sketch.fill(y, 96)).mean())
        assert abs(np.mean(hits) - k / (600 - k)) < 0.03
    one = sketch.fill(np.array([7], np.uint64), 96)
    assert (one != np.iinfo(np.uint64).max).all()


def brute_components(texts, limit=85):
    sets = [set(shingle_set(word_hashes((t or "").lower().encode())).tolist()) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        return x if up[x] == x else find(up[x])

    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= limit * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def test_near_duplicates(docs, none):
    want, sizes = brute_components(TEXTS)
    got = by_id(minhash.near_duplicates(docs))
    assert [got[i].component_id for i in range(len(TEXTS))] == want and [got[i].n_shingles for i in range(len(TEXTS))] == sizes
    assert minhash.near_duplicates(none).count() == 0


def test_a_wide_cluster(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 12)
    rng, base = random.Random(9), words(90).split()
    texts = []
    for i in range(80):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(90)] = f"z{i}-{rng.random()}"
        texts.append(" ".join(w))
    want, _ = brute_components(texts)
    got = by_id(minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[i].component_id for i in range(80)] == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 102), (102, 101), (7, 7), (101, 102), (200, 100)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100, 200: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_substring_dedup(docs, none, spark):
    rows = [r.text for r in docs.orderBy("doc_id").collect()]
    split = [(t or "").split() for t in rows]
    where = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    got = by_id(substring.substring_dedup(docs).select("row.doc_id", F.col("row.n_words").alias("mine"), "n_words", "n_removed", "kept"))
    for k, w in enumerate(split):
        gone = {i + d for i in range(len(w) - 34) if where[tuple(w[i : i + 35])] > 1 for d in range(35)}
        assert (got[k].n_words, got[k].n_removed, got[k].kept, got[k].mine) == (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone), "kept")
    assert substring.substring_dedup(none).count() == 0
    same = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (1, BASE[0]), (None, BASE[4]), (None, None)], "doc_id long, text string")
    assert sorted(r.n_removed for r in substring.substring_dedup(same).collect()) == [0, 0, 0, 60, 60]


def labelled_docs(spark):
    rows = []
    for i in range(900):
        w = words(60, RNG).split()
        bad = i % 5 == 0
        if bad:
            w[RNG.randrange(60)] = RNG.choice(["vilex", "vilexa", "v1lex", "nasto", "n4st0"])
        junk = i % 4 == 0
        rows.append((i, " ".join(x.upper() + "!!" for x in w) if junk else " ".join(w) + ".", int(bad), int(not junk)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int, quality int").cache()


def test_toxicity(spark, docs, none):
    df = labelled_docs(spark)
    train = toxicity.labelled(df.select("doc_id", "text"), df, "toxic", F.col("_id") % 3 != 0, 500)
    assert train.count() == 500
    lexicon = toxicity.learn(train)
    got = by_id(toxicity.toxicity(df, lexicon).select("row.doc_id", "row.toxic", "predicted", "score"))
    held = [r for r in got.values() if r.doc_id % 3 == 0]
    assert sum(r.toxic == r.predicted for r in held) >= 0.97 * len(held)
    blank = by_id(toxicity.toxicity(docs, lexicon).select("row.doc_id", "predicted", "score"))
    assert len(blank) == len(TEXTS) and blank[0].score == blank[1].score and blank[0].predicted == 0
    assert toxicity.toxicity(none, lexicon).count() == 0
    assert toxicity.learn(train.where("false")).weights == {}


def test_folding_and_exceptions():
    assert [toxicity.fold(w) for w in ("1d10t!!", "іdіоt", "stup!d", "2024", "$$$")] == ["idiot", "idiot", "stupid", "2024", "$$$"]
    m = toxicity.Lexicon({"=clown": 5.0, "^tras": 4.0}, frozenset(["clown fish"]), (1.0, -1.0)).matcher()
    assert m([b"a CLOWN fish", b"a cl0wn", b"trashy clown fish", b"extras", None])[2] == [0, 1, 1, 0, 0]


def test_quality_classifier(spark, docs, none):
    df = labelled_docs(spark)
    model = mil.learn(toxicity.labelled(df.select("doc_id", "text"), df, "quality", F.col("_id") % 3 != 0, 400))
    got = mil.quality(df, model).select("row.doc_id", "row.quality", "predicted", "score").where("doc_id % 3 = 0").collect()
    assert sum(r.quality == r.predicted for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in mil.quality(docs, model).collect()) and mil.quality(none, model).count() == 0
    assert abs(mil.learn(labelled_docs(spark).where("false").selectExpr("text", "toxic as y")).scorer()([None])[0][0] - 0.5) < 1e-9


def test_passages_cover_the_text():
    x, c = mil.passages(("w " * 200).encode())
    assert len(x) == 4 and np.isfinite(x).all() and c.sum() == 200 and (c.max(1) == [64, 64, 64, 8]).all()
    assert len(mil.passages(None)[0]) == 1 and len(mil.passages(b"  x")[0]) == 1


def test_language_id(spark, docs, none):
    syllables = {"xx": ["kra", "zug", "bro"], "yy": ["éla", "moi", "queu"], "zz": ["ña", "los", "ción"]}
    rows = [(i, " ".join("".join(RNG.choice(syllables[v]) for _ in range(3)) for _ in range(30)), v) for i, v in enumerate(["xx", "yy", "zz"] * 60)]
    df = spark.createDataFrame([*rows, (900, "123 !!", None), (901, None, "xx"), (902, "", "yy")], "doc_id long, text string, lang string")
    model = langid.learn(langid.train_rows(df, F.col("_id") % 2 == 0, 60))
    got = by_id(langid.language_id(df, model).select("row.*", "lang_pred", "score"))
    assert all(got[i].lang_pred == v for i, _, v in rows) and {got[i].lang_pred for i in (900, 901, 902)} == {"und"}
    assert langid.language_id(none, model).count() == 0
    empty = langid.learn(langid.train_rows(df.where("false"), F.lit(True), 60))
    assert {r.lang_pred for r in langid.language_id(df, empty).collect()} == {"und"}


def test_quality_model_by_hand_and_its_gradient():
    """Scores equal a plain-Python pass over the passages; the gradient equals differences of the loss."""
    rng = np.random.default_rng(1)
    n = mil.N_FEATURES + mil.HASHED
    p = {"mean": rng.normal(size=mil.N_FEATURES), "scale": np.ones(mil.N_FEATURES), "W": rng.normal(size=(n, 3)) / 5, "b": rng.normal(size=3), "V": rng.normal(size=(3, 2)), "U": rng.normal(size=(3, 2)), "w": rng.normal(size=2), "c": rng.normal(size=3), "d": np.array(0.3)}
    model, texts = mil.Model(p), [b.encode() for b in (BASE[0], BASE[1] * 3, "one", PASSAGE, "")]
    sig = lambda z: 1 / (1 + np.exp(-z))
    want = []
    for b in texts:
        encoded, weight = [], []
        for stats, counts in zip(*mil.passages(b), strict=True):
            x = [*((stats - p["mean"]) / p["scale"]), *np.sqrt(counts / 64)]
            h = [np.tanh(sum(x[i] * p["W"][i, j] for i in range(n)) + p["b"][j]) for j in range(3)]
            gate = [np.tanh(sum(h[j] * p["V"][j, g] for j in range(3))) * sig(sum(h[j] * p["U"][j, g] for j in range(3))) for g in range(2)]
            encoded.append(h), weight.append(np.exp(sum(gate[g] * p["w"][g] for g in range(2))))
        z = [sum(a * h[j] for a, h in zip(weight, encoded, strict=True)) / sum(weight) for j in range(3)]
        want.append(sig(sum(z[j] * p["c"][j] for j in range(3)) + 0.3))
    got = model.scorer()(texts)
    assert np.allclose(got[0], want, atol=1e-6) and got[1] == [int(v >= 0.5) for v in want]
    parts = [mil.passages(b) for b in texts]
    x = np.concatenate([model.features(*q) for q in parts]).astype(float)
    first, y = np.cumsum([0, *[len(q[0]) for q in parts[:-1]]]), np.array([1.0, 0, 1, 0, 1])
    _, grad = mil.loss_and_gradient(model, x, first, y)
    for k, at in (("W", (3, 1)), ("W", (n - 5, 2)), ("b", (0,)), ("V", (1, 1)), ("U", (2, 0)), ("w", (1,)), ("c", (2,)), ("d", ())):
        ends = []
        for step in (1e-5, -1e-5):
            q = {a: v.copy() for a, v in p.items()}
            q[k][at] += step
            ends.append(mil.loss_and_gradient(mil.Model(q), x, first, y)[0])
        assert abs((ends[0] - ends[1]) / 2e-5 - grad[k][at]) < 1e-6, k


def test_very_long_texts_of_the_learned_operators():
    long = ("word " * 300_000 + "vilex ").encode()
    stats, counts = mil.passages(long)
    assert len(stats) == -(-300_001 // 64) and counts.sum(dtype=int) == 300_001
    score = toxicity.Lexicon({"=vilex": 3.0}, frozenset(["word vilex"]), (1.0, 0.0)).matcher()
    assert score([long, long[5:-6] + b"vilex vilex"])[2] == [0, 1]
    many = b"a trash b " * 50_000  # as many hits as exceptions
    assert toxicity.Lexicon({"=trash": 1.0}, frozenset(["trash b"]), (1.0, 0.0)).matcher()([many, b"trash"])[2] == [0, 1]


def test_lexicon_against_a_scan():
    """The automaton's hits equal those of looking at every word and phrase."""
    weights, exceptions = {"=clown": 5.0, "^tras": 4.0, "^clow": 1.0, "=trasher": 6.0}, frozenset(["clown fish", "old trash"])
    score = toxicity.Lexicon(weights, exceptions, (0.7, -1.0)).matcher()
    rng, vocabulary = random.Random(8), ["clown", "cl0wn", "clowns", "fish", "trash", "TRASHER", "old", "a", "extras", "cløwn", "tra5h"]
    for _ in range(400):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9)))
        w = [toxicity.fold(x) for x in toxicity.WORD.findall(text.lower())]
        hits = {}
        for i, x in enumerate(w):
            best = max([v for t, v in weights.items() if (x == t[1:] if t[0] == "=" else x.startswith(t[1:]))], default=0)
            if best and not any(" ".join(w[j : j + 2]) in exceptions for j in (i - 1, i) if j >= 0):
                hits[i] = best
        z = 0.7 * sum(hits.values()) / np.log2(2 + len(w)) - 1
        got = [c[0] for c in score([text.encode()])]
        assert got[2] == len(hits) and abs(got[0] - 1 / (1 + np.exp(-z))) < 1e-9, text


def test_language_vectors_by_dictionaries():
    """Cosines to centroids equal those of counted 3-grams; equal cosines go to the first language; far texts are rejected."""
    dims, texts = 8192, ["Der Hund läuft", "the dog runs, THE DOG", "ÉCOLE école", "x", "日本 語"]
    table = {i: (chr(i).lower().encode() if chr(i).isalpha() else b" ") if i < 128 else bytes([i]) for i in range(256)}
    for t in texts:
        b = b"".join(table[x] for x in (" " + t.lower() + " ").encode())
        while b"  " in b:
            b = b.replace(b"  ", b" ")
        grams = Counter(((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 19 for i in range(len(b) - 2))
        v = langid.vectors([t.encode()], dims)[0]
        assert {int(i): round(float(np.expm1(v[i]))) for i in np.flatnonzero(v)} == grams
    c = np.stack([langid.unit(langid.vectors([t.encode()], dims)[0]) for t in ("the dog", "the dog", "der hund")])
    model = langid.Model(["aa", "bb", "de"], c, np.ones(dims, np.float32), np.array([0.9, 0.9, 0.9]))
    pred, score, rejected = model.predictor()([b"the dog", b"der hund", b"zzz qqq", b"", None, b"12 !"])
    assert pred == ["aa", "de", "aa", "und", "und", "und"] and rejected == [False, False, True, True, True, True] and score[3:] == [0, 0, 0] and score[0] > 0.999


def test_rows_learned_from_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"t{i}") for i in range(50)] + [(2, "x"), (3, None), (None, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (None, 1), (9, None)], "doc_id long, toxic int")
    assert sorted(map(tuple, toxicity.labelled(docs, labels, "toxic", F.lit(True), 10).collect())) == [("t0", 1), ("x", 0)]
    assert toxicity.labelled(docs, labels, "toxic", F.lit(True), 1).count() <= 1
    rows = [(i, f"text {i}", f"l{i % 300}") for i in range(3000)] + [(i, "same", "big") for i in range(3000)] + [(7, "same", "big")] * 500
    drawn = langid.train_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), 600)
    by = {r["lang"]: r["count"] for r in drawn.groupBy("lang").count().collect()}
    assert len(by) == 301 and sum(by.values()) == 3000 + by["big"] and by["big"] < 60


def test_rows_repeat_and_names_clash(spark):
    """Repeated rows give equal rows, and every operator keeps the input's columns whatever their names."""
    rows = [(1, BASE[0], "a", "b"), (1, BASE[0], "a", "b"), (2, None, "c", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, `x.ids` string")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    model = mil.constant(0.5)
    for got in (license_scan.license_scan(df), media.media_columns(df), bpe.byte_bpe(df, path, public_tokenizers.PATTERN), mil.quality(df, model), toxicity.toxicity(df, toxicity.Lexicon({})), langid.language_id(df, langid.Model([], np.zeros((0, 8)), np.ones(8), np.zeros(0)))):
        got = [tuple(r) for r in got.select("row.*", *[F.col(c).alias(f"out_{c}") for c in got.columns if c != "row"]).collect()]
        assert len(got) == 3 and sum(r[2:4] == ("a", "b") for r in got) == 2
        same = [r for r in got if r[0] == 1]
        assert same[0] == same[1]
    for got in (quality_rules.quality_rules(df, host="score"), substring.substring_dedup(df)):
        assert sorted(r[3] for r in got.select("row.*").collect()) == ["b", "b", "d"]
