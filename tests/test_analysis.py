"""Analysing repositories: versions, unchanged files, failures; events of any cutting; the newest entries."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.plans import analysis
from corvane.sources import vector_store
from corvane.streaming import events


def test_analysis(spark, tmp_path, monkeypatch):
    root, folder = tmp_path / "src", str(tmp_path / "out")
    (root / "pkg").mkdir(parents=True)
    (root / "pkg/__init__.py").write_text("import os\n\ndef f():\n    return 1\n")
    (root / "a.ts").write_text("import x from './x'\nclass A { m(): void { } }\n")
    repo = {"repo_id": "007", "root_path": str(root), "name": "n", "url": "u/"}
    assert analysis.read(spark, folder, "007", "files") is None
    first = analysis.analyse(spark, folder, repo)
    assert (first["file_count"], first["function_count"], first["dependency_edges"], first["parsed"], first["number"]) == (2, 3, 2, 2, 1)
    again = analysis.analyse(spark, folder, repo)
    assert again["version"] == first["version"] and again["parsed"] == 0
    (root / "a.ts").write_text("class B { }\n")
    (root / "new.go").write_text("func G() {\n}\n")
    monkeypatch.setattr(analysis.vector_store, "blocks", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        analysis.analyse(spark, folder, repo)
    assert analysis.current(spark, folder, "007")["version"] == first["version"]  # half a run isn't seen
    monkeypatch.undo()
    second = analysis.analyse(spark, folder, repo)
    assert (second["parsed"], second["number"], second["file_count"]) == (2, 2, 3)
    assert sorted(r.name for r in analysis.read(spark, folder, "007", "functions").collect()) == ["B", "G", "f"]
    assert [r.target for r in analysis.read(spark, folder, "007", "edges").collect()] == ["os"]
    from corvane.operators.embedding import hash_vectors

    asked = [(1, hash_vectors()()(["func G() {\n}"])[0].tolist())]
    got = vector_store.search(analysis.read(spark, folder, "007", "vectors"), asked, 2).orderBy("rank").collect()
    assert {r.record_id for r in got} == {f"{root}/new.go", f"{root}/new.go:1-2"} and all(r.score == 1.0 for r in got)
    (root / "new.go").unlink()
    assert analysis.analyse(spark, folder, repo)["file_count"] == 2


def test_analysis_of_a_stream(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "m.py").write_text(f"def {name}(): pass\n")
    rows = spark.createDataFrame([(n, str(tmp_path / n), n, "") for n in ("one", "two")], "repo_id string, root_path string, name string, url string")
    rows.write.parquet(str(tmp_path / "asked"))
    for checkpoint in ("c1", "c1", "c2"):  # as it is, again, and replayed from the begin
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "asked"))
        analysis.follow(stream, str(tmp_path / "out"), str(tmp_path / checkpoint)).awaitTermination()
    assert {(r.repo_id, r.number, r.function_count) for r in analysis.published(spark, str(tmp_path / "out")).collect()} == {("one", 1, 1), ("two", 1, 1)}


def streamed(spark, tmp_path, df, batches, make, mode, name):
    """Feeds df in `batches` files, one a batch; the rows that came out, with the batch's number."""
    for b in range(batches):
        df.where(F.col("batch") == b).drop("batch").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    out = []
    source = spark.readStream.schema(df.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    make(source).writeStream.outputMode(mode).foreachBatch(lambda rows, i: out.extend((i, r) for r in rows.collect())).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start().awaitTermination()
    return out


def test_events_of_any_cutting(spark, tmp_path):
    rng = random.Random(6)
    sent = {c: b"".join(b'data: {"type":"token","text":"\xc3\xa9 %d"}\n\n' % i if i % 4 else b"data: {broken\n: note\n\n" for i in range(12)) + b'data: {"type":"end"' for c in ("a", "b")}
    rows = []
    for c, raw in sent.items():
        cuts = sorted(rng.sample(range(len(raw)), 9))
        rows += [(c, k, raw[x:y], k // 4) for k, (x, y) in enumerate(zip([0, *cuts], [*cuts, len(raw)]))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "connection string, seq long, data binary, batch int")
    got = sorted((r.connection, r.number, r.kind, r.body) for _, r in streamed(spark, tmp_path, df, 3, events.events, "append", "chunks"))
    assert got == [(c, n, "token", f'{{"type":"token","text":"é {i}"}}') for c in "ab" for n, i in enumerate(i for i in range(12) if i % 4)]


def test_newest_entries(spark, tmp_path):
    rows = [(f"k{i % 3}" if i < 280 else "hot", i, f"e{i}", i // 100) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, seq long, entry string, batch int")
    last = {}
    for i, r in sorted(streamed(spark, tmp_path, df, 4, lambda s: events.newest(s, 50), "update", "log"), key=lambda x: x[0]):
        last[r.key] = r.entries
    assert last == {k: [e for key, _, e, _ in rows if key == k][-50:] for k in ("k0", "k1", "k2", "hot")}
