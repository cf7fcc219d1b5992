"""The pipeline's near-duplicate stage: its own shingles and limit, and one row kept of each group, whatever the ids."""

import corpus_pipeline
from corvane.llm import minhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOCS)


def run_of(mark, n):
    return [f"{mark}{i}" for i in range(n)]


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_own_shingles_and_limit(spark):
    base, other = run_of("a", 400), run_of("b", 400)
    replaced = base[:360] + run_of("x", 40)  # 0.817 by three words and by five
    longer = base + run_of("y", 80)  # 0.833 and 0.832
    scattered = [f"z{i}" if i % 40 == 20 else w for i, w in enumerate(other)]  # 0.860 by three words, 0.776 by five
    df = frame(spark, [(i, " ".join(w)) for i, w in enumerate([base, replaced, longer, other, scattered])])
    assert ids(corpus_pipeline.distinct_documents(spark, df, "")) == [0, 3, 4]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, limit=85, shingle=3).collect()}
    assert got == {0: (398, 0), 1: (398, 1), 2: (478, 2), 3: (398, 3), 4: (398, 3)}


def test_one_row_of_each_group(spark):
    a, b, c, d = [" ".join(run_of(m, 60)) for m in "abcd"]
    rows = [(1, a), (1, a), (1, b), (2, a), (None, b), (None, c), (None, c), (3, None), (3, ""), (4, d), (None, d), (None, d)]
    left = corpus_pipeline.distinct_documents(spark, frame(spark, rows), "")
    key = lambda r: (str(r[0]), str(r[1]))
    want = [(1, a), (1, b), (None, c), (3, None), (3, ""), (4, d)]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=key) == sorted(want, key=key)
    texts = {r.text for r in corpus_pipeline.without_repeats(spark, left, "").collect()}
    assert texts == {a, b, c, d, None, ""}
