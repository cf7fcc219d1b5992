"""The pipeline and the queries that have SQL, over the smallest tables."""

import base64
import glob
import hashlib
import os
import zlib
from array import array

import duckdb
import public_tokenizers as P
import pytest

import corpus_pipeline
from corvane.llm import media, minhash, queries
from corvane.scratch import stored

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    cols = [d[0] for d in cur.description]
    rows = lambda names, data: sorted(tuple(repr(r[names.index(c)]) for c in sorted(names)) for r in data)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(cols, cur.fetchall())


def expected(texts):
    """What the registered queries without SQL must return for texts, computed plainly."""
    import tiktoken
    from tokenizers import Tokenizer

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}, special_tokens={})
    tok, sha = Tokenizer.from_file(P.path("byte_bpe_50k.json")), lambda b: hashlib.sha256(b).hexdigest()
    out = {"op2": {}, "op4": {}, "op5": {}}
    for i, t in texts.items():
        b = (t or "").encode()
        ids = enc.encode_ordinary(t or "")
        out["op2"][i] = (len(ids), sha(",".join(map(str, ids)).encode()), sha(b))
        pay = b + bytes(-len(b) % 64 or (64 if not b else 0))
        out["op4"][i] = (len(b), len(pay), sha(pay), zlib.crc32(pay[-64:]), len(media.mux(pay)), sha(media.mux(pay)))
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        out["op5"][i] = [(k, a, z - a, zlib.crc32(array("I", ids[a:z]).tobytes())) for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return out


def test_registered_queries_without_sql(spark):
    docs = {r.doc_id: r for r in queries.table(spark, SF, "documents").collect()}
    want = expected({i: r.text for i, r in docs.items()})
    got = lambda name: queries.QUERIES[name](spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got("op2_byte_bpe")} == want["op2"]
    rows = got("op4_media_columns")
    assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in rows} == want["op4"]
    assert len({r.feature for r in rows}) == len({r.media_sha256 for r in rows}) or all(r.feature for r in rows)
    pieces, seqs = {}, {}
    for r in got("op5_best_fit_packing"):
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {i: sorted(x) for i, x in pieces.items()} == want["op5"]
    for s in seqs.values():
        assert all(o == sum(n for q, n in s if q < o) for o, _ in s) and sum(n for _, n in s) <= 1024
    for name, by, rest in (("op8_quality_classifier", 3, 1), ("op9_toxicity", 5, 0), ("op10_language_id", 4, 2)):
        rows = got(name)
        assert sorted(r.doc_id for r in rows) == sorted(docs) and all(0 <= r.score <= 1 for r in rows)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % by == rest) for r in rows)
        if by != 4:
            assert all(r.predicted == int(r.score >= 0.5) for r in rows)
    right = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out and docs[r.doc_id].lang]
    assert sum(right) >= 0.9 * len(right)


def test_stages_on_odd_rows(spark):
    """Nulls, empty and repeated texts, long words, columns of any name."""
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "en", "s", 9, "a"), (1, text, "en", "s", 9, "b"), (None, None, None, None, None, None), (2, "", "", "", 0, "c"), (3, "x" * 5000 + " y z", "en", None, 1, "d"), (4, " ".join(reversed(text.split())), "fr", "s", 1, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.row` string")
    kept = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept = stored(stage(spark, kept, SF), "odd")
        if k < 4:
            assert kept.columns == docs.columns
        if k == 0:
            assert sorted(r["a.row"] for r in kept.collect()) == ["a", "b", "d", "e"]
        if k == 2:
            assert sorted(r["a.row"] for r in kept.select("`a.row`").collect())[-2:] == ["d", "e"] and kept.count() == 3
        if k == 3:
            assert all(r.n_chars == len(r.text) for r in kept.collect())
    assert {r.doc_id for r in kept.collect()} == {1, 3, 4}
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "", None, "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (corpus_pipeline.clean, corpus_pipeline.distinct_documents, corpus_pipeline.without_repeats):
        assert sorted(((r.doc_id, r.text, r.source) for r in stage(spark, docs, SF).collect()), key=str) == [(1, None, None), (None, "", "s")]
    assert sorted(r.length for r in corpus_pipeline.sequences(spark, docs, SF).collect()) == [1, 1]


def test_stages(spark):
    docs = queries.table(spark, SF, "documents")
    names = docs.columns
    kept = {0: docs}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept[k + 1] = stored(stage(spark, kept[k], SF), "test")
        if k < 4:
            assert kept[k + 1].columns == names
            ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
            assert ids(kept[k + 1]) <= ids(kept[k])
    assert kept[4].count() == kept[3].count()
    near = minhash.near_duplicates(kept[3])
    assert near.where("component_id <> doc_id").count() == 0
    assert {r.doc_id for r in kept[5].collect()} == {r.doc_id for r in kept[4].collect()}
    assert corpus_pipeline.run(spark, SF).count() == kept[5].count()


def test_stages_on_an_empty_table(spark):
    docs = queries.table(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
