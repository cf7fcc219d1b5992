import json
import random
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import embedding, extraction, graph, retrieval, stats
from corvane.plans import agents
from corvane.settings import Settings, settings
from corvane.sources import repository, vector_store
from corvane.streaming import tracker


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(expr.alias("x")).first()["x"]


def test_python_definitions_and_imports():
    src = "import os\nimport numpy as np\nfrom a.b import c\nfrom . import d\nfrom __future__ import annotations\n\nclass A:\n    def f(self):\n        return 1\n\n@x\nasync def g(): pass\n"
    assert extraction.definitions(src, "python") == [("A", 7, 9, "class A:"), ("f", 8, 9, "def f(self):"), ("g", 12, 12, "async def g(): pass")]
    assert extraction.imports(src, "python") == [".", "a.b", "os"]
    assert [d[0] for d in extraction.definitions("def ok():\n  pass\ndef broken(:\n", "python")] == ["ok", "broken"]


def test_js_definitions_and_imports():
    src = "import a from './a'\nexport { b } from \"b\"\nfunction f() {\n  return 1\n}\nconst g = (x) => x;\nclass C {}\n"
    assert [(n, s, e) for n, s, e, _ in extraction.definitions(src, "tsx")] == [("f", 3, 5), ("<anonymous>", 6, 6), ("C", 7, 7)]
    methods = "class C { foo(a) { if (a) { return 1 } } }\nclass D {\n  constructor() {\n  }\n  static async bar(x, y) {\n    while (x) { y() }\n  }\n}\n"
    assert [d[0] for d in extraction.definitions(methods, "typescript")] == ["C", "foo", "D", "constructor", "bar"]
    assert extraction.imports(src, "javascript") == ["./a", "b"]
    assert extraction.definitions("x", "cobol") == [] and extraction.definitions(None, "go") == []


def test_kinds_without_a_name():
    names = lambda src, language: [d[0] for d in extraction.definitions(src, language)]
    assert names("int main(void) {\n}\nstruct S {\n};\n", "c") == ["<anonymous>", "S"]
    assert names("impl Foo for Bar {\n  fn x() {}\n}\nstruct Z {}\n", "rust") == ["<anonymous>", "x", "Z"]
    assert names("type T struct {\n}\nfunc (t T) M() {\n}\nfunc F() {\n}\n", "go") == ["<anonymous>", "M", "F"]


def test_view_language_of_suffixes(spark):
    want = {"a.py": "python", "b.tsx": "typescript", "two.hpp": "hpp", "build.KT": "KT", "Makefile": "", "x/.git/config": "", ".bashrc": "", "d/e.tar.gz": "gz", "s.cs": "csharp", "y.yml": "yaml", "r.bat": "batch", "m.scala": "scala"}
    df = spark.createDataFrame([(k,) for k in want], "path string")
    assert {r.path: r.x for r in df.select("path", T.view_language(F.col("path")).alias("x")).collect()} == want
    assert one(spark, T.scan_language(F.col("p")), p="two.hpp") == "cpp"


def test_small_functions(spark):
    ints = [(" 12 ", 12), ("-3", -3), ("1_000", 1000), ("", None), ("x", None), ("1.5", None), ("99999999999999999999", None), (None, None)]
    df = spark.createDataFrame(ints, "s string, want long")
    assert [r.x for r in df.select(T.safe_int(F.col("s")).alias("x")).collect()] == [w for _, w in ints]
    assert one(spark, T.byte_slice(F.col("s"), F.lit(1), F.lit(4)), s="aéb") == "éb" and one(spark, T.byte_slice(F.col("s"), F.lit(2), F.lit(3)), s="aéb") == "�"
    assert [one(spark, T.more(F.col("s"), 2), s=x) for x in (["a"], ["a", "b"], ["a", "b", "c", "d"])] == ["a", "a, b", "a, b +2 more"]
    assert one(spark, T.code_language(F.col("s")), s="x language-py3 y") == "py3" and one(spark, T.code_language(F.col("s")), s="plain") == ""
    label = lambda n, r: one(spark, T.repo_label(F.col("n"), F.col("r").cast("string"), F.lit("0123456789")), n=n, r=r)
    assert (label("Name", "u/r.git"), label("", "https://h/o/r.git/"), label("", "")) == ("Name", "r", "01234567")


def test_addresses():
    cases = {" https://h/o/r/ ": ("https://h/o/r", "r"), "https://h/o/r.git": ("https://h/o/r.git", "r"), "https://h/o/digit.git": ("https://h/o/digit.git", "d"), "https://h/o/r/tree/main": ("https://h/o/r", "r"), "https://h/o/r/blob/main/a/b.py": ("https://h/o/r", "r"), "https://h/o/tree": ("https://h/o/tree", "tree"), "": ("", "")}
    assert {u: repository.address(u) for u in cases} == cases


def test_fetching_and_remote_names(tmp_path):
    ran = []
    row = repository.fetch("https://h/o/r.git/", str(tmp_path), run=lambda *a, **k: ran.append(a[0]))
    assert row["url"] == "https://h/o/r.git/" and row["name"] == "r" and row["root_path"] == f"{tmp_path}/{row['repo_id']}" and ran == [["git", "clone", "--depth", "1", "https://h/o/r.git", row["root_path"]]]

    class Said:
        stdout = "https://h/o/name.git\n"

    assert repository.remote_name(["x"], run=lambda *a, **k: Said()) == "name"

    def broken(*a, **k):
        raise OSError

    assert repository.remote_name(["x"], run=broken) is None


def test_scan_extract_and_state(spark, tmp_path):
    root = tmp_path / "r"
    (root / "pkg").mkdir(parents=True)
    (root / "pkg/a.py").write_bytes(b"import os\r\ndef f():\r\n    return '\xff'\r\n")
    (root / "b.md").write_text("no")
    files = repository.scan(spark, str(root), "r1")
    got = files.collect()
    assert [(r.language, r.content) for r in got] == [("python", "import os\ndef f():\n    return '�'\n")]
    fn = extraction.functions(files)
    assert [(r.name, r.start_line, r.end_line) for r in fn.collect()] == [("f", 2, 3)]
    e = extraction.import_edges(files)
    assert [r.target for r in e.collect()] == ["os"]
    out = str(tmp_path / "state")
    repository.save(fn, out)
    repository.save(fn.withColumn("repo_id", F.lit("r2")), out)
    repository.save(fn.where("false"), out)
    assert repository.load(spark, out, "r1").count() == 1 and repository.load(spark, out).count() == 2


def test_scan_sees_every_name(spark, tmp_path, monkeypatch):
    """Hidden and underscored files and folders too; unwanted content isn't read; what can't be read says so."""
    names = ["pkg/__init__.py", "pkg/__main__.py", "pkg/_private.py", "pkg/mod.py", "__tests__/t.js", ".github/x.py", "a/b/c/d/e/deep.go", "Makefile", ".py", "x.PY", "deep/.hidden/y.rs"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(n)
    with (tmp_path / "pkg/big.bin").open("wb") as f:
        f.truncate(3_000_000_000)
    with (tmp_path / "pkg/big.py").open("wb") as f:
        f.truncate(2000)
    (tmp_path / "gone.py").symlink_to(tmp_path / "nowhere.py")
    (tmp_path / "linked.py").symlink_to(tmp_path / "pkg/mod.py")
    (tmp_path / "loop").symlink_to(tmp_path)
    (tmp_path / "folder.py").mkdir()
    want = {n: n for n in names if n not in ("Makefile", ".py", "x.PY")} | {"linked.py": "pkg/mod.py"}
    for folders in (256, 1, 2):
        monkeypatch.setattr(repository, "FOLDERS", folders)
        got = {r.path.removeprefix(f"{tmp_path}/"): r for r in repository.scan(spark, str(tmp_path), "r", most=1000).collect()}
        assert {k: r.content for k, r in got.items() if r.error is None} == want
        assert set(got) - set(want) == {"pkg/big.py"} and got["pkg/big.py"].size_bytes == 2000 and "1000 are read" in got["pkg/big.py"].error
    assert [r.error is None for r in repository.scan(spark, str(tmp_path / "absent"), "r").collect()] == []
    assert "absent" in repository.listing(spark, str(tmp_path / "absent")).first().error


def test_ids_stay_text(spark, tmp_path):
    ids = ["007", "0042", "1e5", "2024-01-01", "true", "a/b=c d", "x"]
    rows = spark.createDataFrame([(i, f"{i}.py", [1.0, 2.0]) for i in ids], "repo_id string, path string, vector array<float>")
    repository.save(rows, str(tmp_path / "s"))
    assert sorted(r.repo_id for r in repository.load(spark, str(tmp_path / "s")).collect()) == sorted(ids)
    for i in ids:
        one = repository.load(spark, str(tmp_path / "s"), i)
        assert [tuple(r) for r in one.select("repo_id", "path", "vector").collect()] == [(i, f"{i}.py", [1.0, 2.0])]
    assert "PartitionFilters: [isnotnull(repo_id" in one._jdf.queryExecution().toString()


def test_state_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"repo_id": "x", "files": [{"path": "p"}]}))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text(json.dumps({"name": "no id"}))
    r = repository.read_state(spark, str(tmp_path)).collect()
    assert [(x.repo_id, x.name, x.files[0].path, x.edges) for x in r] == [("x", "", "p", [])]


def test_memories(spark, tmp_path):
    f = str(tmp_path / "m")
    assert repository.memories(spark, f, "global").count() == 0
    repository.remember(spark, f, "global", "one")
    repository.remember(spark, f, "repo:1", "two")
    assert [r.content for r in repository.memories(spark, f, "global").collect()] == ["one"]


def test_memories_in_the_question_loop(spark, tmp_path):
    f, before = str(tmp_path / "m"), datetime.now(UTC).replace(tzinfo=None)
    e = agents.Engine(lambda q, k: ("found", []), memory=repository.Memories(spark, f, "repo:1"))
    assert e.remember("list") == "Nothing saved."
    assert e.remember("save:  a note ") == "Saved."
    repository.remember(spark, f, "global", "elsewhere")
    e.remember("SAVE: second")
    said = e.remember(" List ").split("\n")
    assert [x.split("] ", 1)[1] for x in said] == ["a note", "second"]
    at = repository.memories(spark, f, "repo:1").first()["created_at"]
    assert said[0] == f"[{at}] a note" and before <= at <= datetime.now(UTC).replace(tzinfo=None)


def test_memory_line_is_the_time_as_text(spark):
    times = [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5, 120000), datetime(1999, 12, 31, 23, 59, 59, 7)]
    for at in times:
        assert one(spark, T.memory_line(F.col("at").cast("timestamp_ntz"), F.col("c")), at=at, c="x ] y") == f"[{at}] x ] y"


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\n\n", "\n\n", "a\r\nb\rc\n", "x\n" * 300, "a\u2028b"])
@pytest.mark.parametrize("span", [(None, None), (1, 2), (2, 1), (0, 0), (3, 500), (None, 4)])
def test_snippet_and_its_summary(spark, text, span):
    lo, hi = span
    ls = text.splitlines()
    part = "\n".join(ls[:200] if lo is None or hi is None else ls[max(lo - 1, 0):max(hi, max(lo - 1, 0))])
    df = spark.createDataFrame([(text, lo, hi)], "t string, lo int, hi int")
    cut = T.snippet(F.col("t"), F.col("lo"), F.col("hi"))
    r = df.select(cut.alias("part"), T.snippet_summary(F.lit("p.py"), F.col("lo"), F.col("hi"), cut).alias("said")).first()
    span_said = f" (lines {lo}-{hi})" if lo is not None and hi is not None else ""
    assert (r.part, r.said) == (part, f"Snippet from p.py{span_said}, {len(part.splitlines())} lines.")


def test_snippet_of_nothing(spark):
    df = spark.createDataFrame([(None, 1, 2)], "t string, lo int, hi int")
    cut = T.snippet(F.col("t"), F.col("lo"), F.col("hi"))
    assert df.select(cut.alias("p"), T.snippet_summary(F.lit("p"), F.col("lo"), F.col("hi"), cut).alias("s")).first() == ("", "Snippet from p (lines 1-2), 0 lines.")


def test_lines_match_python(spark):
    for s in ("", "a", "a\n", "\n\n", "a\r\nb\x0bc\x0c\x1cd\x1d\x1e\x85e\u2028f\u2029", "a\n\nb"):
        assert one(spark, T.lines(F.col("s")), s=s) == s.splitlines(), repr(s)


def test_scalars(spark):
    assert one(spark, T.repo_name(F.col("u")), u="https://h/x/digit.git") == "d"
    assert one(spark, T.normalized_url(F.col("u")), u=" https://h/x/y/tree/main/z ") == "https://h/x/y"
    assert one(spark, T.display_path(F.col("p"), r"\.engine"), p="a/.engine/repos/id/x/y.py") == "x/y.py"
    assert one(spark, T.line_range(F.col("s"), F.lit(2), F.lit(9)), s="a\nb\nc") == "b\nc"
    assert one(spark, T.layer(F.col("p")), p="domain/x.py") == "entry"
    assert one(spark, T.unquoted(F.col("p")), p="'a'") == "a"
    assert one(spark, T.chunks(F.col("p")), p="a b c d e") == ["a b c d ", "e"]


def test_citation(spark):
    c = retrieval.citation(F.col("p"), F.col("s"), F.lit(1), F.lit(2))
    assert one(spark, c, p="f.py", s="x = 1\ny\nz") == "f.py (lines 1-2) | x = 1 y"
    assert one(spark, retrieval.citation(F.col("p"), F.col("s")), p="f.py", s="a" * 300) == "f.py | " + "a" * 200 + "..."


def test_search_finds_the_aligned_vector(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 2.0, 0.0]), (3, [0.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    df.write.parquet(str(tmp_path / "v"))
    got = retrieval.vector_search(spark.read.parquet(str(tmp_path / "v")), [(0, [0.0, 1.0, 0.0])], 5).orderBy("rank").collect()
    assert [(r.record_id, r.score) for r in got] == [(2, 1.0), (1, 0.0), (3, 0.0)]
    assert retrieval.vector_search(df, [], 5).count() == 0


def test_top_k_is_a_prefix(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(200)], "vec_id long, embedding array<double>").repartition(5)
    q = [(0, rng.normal(size=8).tolist())]
    a, b = ([r.record_id for r in retrieval.vector_search(df, q, k).orderBy("rank").collect()] for k in (5, 20))
    assert b[:5] == a


def test_p95_floor_rank(spark):
    for n in (1, 2, 19, 20, 21, 100):
        v = [float(x) for x in range(n)]
        random.Random(n).shuffle(v)
        df = spark.createDataFrame([("a", x) for x in v], "agent string, latency_ms double")
        assert stats.p95(df, "agent").first()["p95_ms"] == sorted(v)[min(int(n * 0.95), n - 1)]


def test_empty_log(spark):
    df = spark.createDataFrame([], "latency_ms double, citations long")
    assert tuple(stats.session(df).first()) == (0, 0.0, 0.0)


def test_neighbours(spark):
    e = graph.edges(spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "b")], ["source", "target"]))
    assert sorted(r[0] for r in graph.neighbours(e, "b").collect()) == ["a", "c"]
    assert [r[0] for r in graph.neighbours(e, "a", "outbound").collect()] == ["b"]
    assert {tuple(r) for r in graph.degrees(e).collect()} == {("a", 1, 0), ("b", 0, 2), ("c", 1, 0)}


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    tracker.write(tracker.running(tracker.log_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    key = lambda df: sorted((r.agent, r.invocations, round(r.total_ms, 3)) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(tracker.running(src))
    tracker.write(tracker.windowed(tracker.log_stream(spark, str(tmp_path / "in"), 10)), str(tmp_path / "w"), str(tmp_path / "cp2"), "append").awaitTermination()
    assert 0 < spark.read.parquet(str(tmp_path / "w")).agg(F.sum("invocations")).first()[0] <= src.count()


class Memory(list):
    save = list.append

    def listing(self):
        return list(self)


def test_agents():
    e = agents.Engine(lambda q, k: ("found", ["a.py | x"]))
    got = e.ask("explain the code")
    assert got["answer"] == agents.OFFLINE and len(got["reasoning_steps"]) == 3 and "(analyst)" in got["reasoning_steps"][1] and got["reasoning_steps"][2].startswith("Validation")
    got = e.ask("where is f")
    assert got["citations"] == ["a.py | x"]
    plan = {"steps": [{"agent": "memory", "instruction": "save: note"}, {"agent": "nobody", "instruction": "x"}]}
    m = Memory()
    e = agents.Engine(lambda q, k: ("found", []), memory=m, llm=lambda p: f"```json\n{json.dumps(plan)}\n```")
    assert e.ask("q")["answer"] == "Saved." and m == ["note"]
    assert e.remember("list") == "note" and e.remember("what") .startswith("Use")
    assert agents.Engine(lambda q, k: ("f", []), llm=lambda p: "not json").plan("q")["steps"][0]["agent"] == "retrieval"
    assert e.generate("x")["notes"] == []
    assert e.explain("f.py:2-3", lambda *a: ["1", "2", "3"])["snippet"] == "2\n3"
    assert e.explain("g.py", lambda *a: None)["summary"] == "Not found."


def test_routes_and_plans():
    def failing(prompt):
        raise RuntimeError

    e = agents.Engine(lambda q, k: ("found", []), llm=failing)
    assert e.plan("explain it") == {"steps": [{"agent": "retrieval", "instruction": "explain it"}]}  # a failing model isn't asked for keywords
    assert agents.Engine(lambda q, k: ("f", []), llm=lambda p: "[1]").plan("q")["steps"][0]["agent"] == "retrieval"
    route = lambda *steps, **k: e.route(agents.State("q", plan={"steps": list(steps)}, **k))
    assert [route({"agent": "Analyst"}), route({}), route({"agent": "nobody"}), route(), route(validated=True)] == ["analyst", "retrieval", "end", "validator", "end"]
    assert agents.USED == {"ask": ["planner", "retrieval", "mentor", "validator"], "fast": ["retrieval", "mentor"], "general": ["mentor"], "generate": ["retrieval", "mentor"]}
    assert agents.Engine(lambda q, k: ("found", ["a.py"])).fast("q")["citations"] == ["a.py"]


def test_requests(spark):
    overview = spark.createDataFrame([("r1", "One", 2, 3, 2), ("r2", "Two", 0, 0, 0)], "repo_id string, name string, file_count long, function_count long, dependency_edges long")
    edges = spark.createDataFrame([("r1", "a.py", "os"), ("r1", "b.py", "os"), ("r2", "c.py", "a.py")], "repo_id string, source string, target string")
    r = agents.Requests(overview, edges, lambda *a: edges.limit(0))
    assert [x["name"] for x in r.repos()] == ["One", "Two"] and r.repo("r1")["file_count"] == 2
    assert r.neighbours("r1", "os") == ["a.py", "b.py"] and r.neighbours("r1", "a.py", "outbound") == ["os"] and r.neighbours("r1", "os", "outbound") == []
    assert r.analysed("r1") == "Files: 2\nFunctions: 3\nDependency edges: 2\nMost used modules: os (2)" and r.search("r1", "q") == []
    for call in (lambda: r.repo("r9"), lambda: r.neighbours("r1", "c.py"), lambda: r.search("r9", "q")):
        with pytest.raises(agents.NotFound):
            call()


def test_file_content_and_models(spark):
    overview = spark.createDataFrame([("r1", "One")], "repo_id string, name string")
    files = spark.createDataFrame([("r1", "a/b.tsx", "x\ny"), ("r1", "gone.py", None)], "repo_id string, path string, content string")
    r = agents.Requests(overview, files, None, files)
    assert r.content("r1", "a/b.tsx") == {"path": "a/b.tsx", "content": "x\ny", "language": "typescript", "line_count": 2}
    for asked in (("r1", "b.tsx"), ("r2", "a/b.tsx"), ("r1", "gone.py")):
        with pytest.raises(agents.NotFound):
            r.content(*asked)
    models = {"local": lambda p: "said " + p}
    assert agents.model_of("local", models)("x") == "said x" and agents.model_of("other", models)("x") == agents.OFFLINE


def test_relative_paths(spark):
    rel = lambda p, r: one(spark, T.relative_path(F.col("p"), F.col("r").cast("string")), p=p, r=r)
    cases = [("/a/b/c.py", "/a", "b/c.py"), ("/a/b/c.py", "/a/", "b/c.py"), ("/ab/c.py", "/a", "c.py"), ("/a", "/a", "."), ("/x/repos/id/b/c.py", "", "b/c.py"), ("x/repos/id/c.py", "rel", "c.py"), ("/x/repos/id", "", None), ("x/y.py", "", "y.py"), ("/x/repos/id/c.py", "/q", "c.py"), ("/repos/1/repos/2/z", "", "repos/2/z")]
    assert [rel(p, r) for p, r, _ in cases] == [w for _, _, w in cases]


def test_odd_vectors_and_scopes(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.0, 1.0], "y"), (3, [1.0], "x"), (4, None, "x"), (5, [1.0, 0.1], None)], "vec_id long, embedding array<double>, label string")
    found = lambda qs, **k: {(r.query_id, r.record_id) for r in retrieval.vector_search(df, qs, 5, **k).collect()}
    assert found([(10, [1.0, 0.0]), (11, None), (12, [2.0])]) == {(10, 1), (10, 2), (10, 5), (12, 3)}
    assert found([(10, [1.0, 0.0], "x"), (11, [1.0, 0.0], "y"), (12, [1.0], None), (13, [1.0, 0.0], "z")], scope="label") == {(10, 1), (11, 2)}
    assert found([]) == set()


def test_all_similarities(spark, monkeypatch):
    """Every pair, in slices too, equals the column function; odd vectors as in a search."""
    from corvane.functions import vectors

    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.3, 0.7]), (2, [0.3, 0.7]), (3, [1.0]), (4, None), (None, [1.0, 0.1]), (5, [0.0, 0.0])], "vec_id long, embedding array<double>")
    asked = [(10, [1.0, 0.0]), (11, None), (12, [2.0]), (None, [1.0, 1.0]), (13, [0.2, 0.9])]
    got = sorted(tuple(r) for r in retrieval.similarities(df, asked).collect())
    assert [(q, r) for q, r, _ in got] == [(10, 1), (10, 2), (10, 2), (10, 5), (12, 3), (13, 1), (13, 2), (13, 2), (13, 5)]
    pairs = spark.createDataFrame([(asked[i][0], x, r, v) for i in (0, 4) for r, v in ((1, [1.0, 0.0]), (2, [0.3, 0.7]), (5, [0.0, 0.0])) for x in [asked[i][1]]], "q long, x array<double>, r long, y array<double>")
    want = {(p.q, p.r): p.s for p in pairs.select("q", "r", F.round(vectors.cosine(F.col("x"), F.col("y")), 6).alias("s")).collect()}
    assert {(q, r): s for q, r, s in got if q != 12} == want
    monkeypatch.setattr(retrieval, "CELLS", 8)
    assert sorted(tuple(r) for r in retrieval.similarities(df, asked).collect()) == got
    assert retrieval.similarities(df, []).count() == retrieval.similarities(df.limit(0), asked).count() == 0


def test_vector_store(spark, tmp_path, monkeypatch):
    """What was saved is found after a reload; other repositories aren't read; writing one again replaces its partition."""
    rng = np.random.default_rng(4)
    rows = [(f"f{i}.py:1-{i}", f"00{i % 3}", rng.normal(size=6).tolist()) for i in range(90)] + [("short", "001", [1.0]), ("zero", "001", [0.0] * 6), (None, "001", [1.0] * 6), ("none", "002", None)]
    df = spark.createDataFrame(rows, "record_id string, repo string, vector array<float>").repartition(4)
    monkeypatch.setattr(vector_store, "BLOCK_ROWS", 7)
    folder = str(tmp_path / "store")
    vector_store.save(vector_store.blocks(df, "record_id", scope=F.col("repo")), folder)
    store = vector_store.load(spark, folder)
    asked = [(1, rows[5][2], "001"), (2, rows[5][2], "000"), (3, [2.0], "001"), (4, [2.0] * 6, None), (5, None, "001"), (6, rows[0][2], "absent")]
    got = vector_store.search(store, asked, 4, scoped=True)
    key = lambda df: sorted((r.query_id, r.rank, r.record_id, r.score) for r in df.collect())
    plain = retrieval.vector_search(df, asked, 4, key="record_id", vector="vector", scope="repo")
    assert key(got) == key(plain) and {r[0] for r in key(got)} == {1, 2, 3}
    assert "PartitionFilters: [repo_id" in got._jdf.queryExecution().toString().replace("isnotnull(repo_id#", "repo_id#") and "002" not in got._jdf.queryExecution().toString().split("PartitionFilters")[1][:120]
    assert key(vector_store.search(store, [a[:2] for a in asked], 4)) == key(retrieval.vector_search(df, [a[:2] for a in asked], 4, key="record_id", vector="vector"))
    vector_store.save(vector_store.blocks(df.where("repo = '000'").limit(2), "record_id", scope=F.col("repo")), folder)
    left = {r.repo_id: r.n for r in vector_store.load(spark, folder).groupBy("repo_id").agg(F.sum(F.size("ids")).alias("n")).collect()}
    assert left == {"000": 2, "001": 32, "002": 30}
    assert vector_store.search(vector_store.load(spark, folder), [], 4).count() == 0


def test_index_is_made_once(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return vector_store.blocks(spark.createDataFrame([(1, [1.0, 0.0])], "id long, vector array<float>"), "id")

    for _ in range(2):
        assert vector_store.search(vector_store.indexed(spark, str(tmp_path), "x", build), [(9, [1.0, 1.0])], 1).first().record_id == 1
    assert made == [1]


def test_providers(spark, tmp_path):
    """Two providers through one query; each task loads each model once, batches are bounded."""
    log = str(tmp_path / "loads")

    def stub():
        import os

        with open(log, "a") as f:
            f.write(f"load {os.getpid()}\n")

        def model(texts):
            with open(log, "a") as f:
                f.write(f"batch {len(texts)}\n")
            return [[float(len(t)), 1.0] for t in texts]

        return model

    rows = [(i, None if i == 3 else "x" * i, ["stub", "hash", None][i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "vector_id long, text string, provider string").repartition(2).cache()
    df.count()
    got = {r.vector_id: r for r in embedding.embedded(df, provider=F.col("provider"), providers={"stub": stub}, batch=4).collect()}
    assert all(got[i].vector == [0.0 if i == 3 else float(i), 1.0] for i in range(0, 60, 3)) and all(len(got[i].vector) == 384 for i in (1, 2, 4))
    said = open(log).read().split("\n")
    assert sum(x.startswith("load") for x in said) == 2 and max(int(x.split()[1]) for x in said if x.startswith("batch")) == 4
    one = embedding.embedded(spark.createDataFrame([("a b_c a_",)], "text string"), vector="v").first()
    assert abs(sum(x * x for x in one.v) - 1) < 1e-6 and one.text == "a b_c a_"
    with pytest.raises(ValueError):
        embedding.embedded(df, provider="nobody")


def test_small_minds_bytes(spark):
    from corvane.scratch import small

    df = spark.createDataFrame([("x" * 1000, 1)] * 50, "t string, n long")
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(small(df, "a")) and not hinted(small(df, "b", most_bytes=49_000)) and not hinted(small(df, "c", most=49)) and hinted(small(df.select("n"), "d", most_bytes=0))


def test_first_occurrences_in_order(spark):
    from corvane import queries

    got = queries.QUERIES["citation_dedupe"](spark, "/root/testdata/sf0.001")
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect()
    want = {}
    for r in rows:
        if r.role and r.role not in want.setdefault(r.conv_id, []):
            want[r.conv_id].append(r.role)
    assert {r.conv_id: r.roles for r in got.collect()} == {k: "|".join(v) for k, v in want.items() if v}


@pytest.mark.parametrize("enabled,expected,given,code", [(False, None, None, 200), (True, None, "x", 500), (True, "k", "x", 401), (True, "k", "k", 200)])
def test_authorized(enabled, expected, given, code):
    assert agents.authorized(enabled, expected, given) == code


def test_string_ids_ties_and_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (300, 4)).astype(float)
    df = spark.createDataFrame([(f"f{i}.py", r.tolist()) for i, r in enumerate(x)] + [(None, [1.0] * 4), ("none", None)], "vec_id string, embedding array<double>").repartition(4)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(25)], "q long, v array<double>")
    n = np.linalg.norm(x, axis=1, keepdims=True)
    unit = x / np.where(n > 0, n, 1)
    want = {(q, j + 1, f"f{i}.py") for q in range(25) for j, i in enumerate(sorted(range(300), key=lambda i: (-round(float(unit[i] @ unit[q]), 6), f"f{i}.py"))[:7])}
    for block in (4096, 10):
        got = retrieval.in_blocks(asked, lambda q: retrieval.vector_search(df, q, 7), block)
        assert {(r.query_id, r.rank, r.record_id) for r in got.collect()} == want


def test_p95_of_large_and_tied_groups(spark):
    rng = random.Random(3)
    groups = {"even": [rng.random() for _ in range(4000)], "tied": [float(rng.randrange(3)) for _ in range(3000)], None: [5.0] * 50, "one": [2.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("one", None)], "agent string, latency_ms double").repartition(6)
    got = {r.agent: (r.p95_ms, r.n) for r in stats.p95(df, "agent", whole=40).collect()}
    assert got == {g: (sorted(v)[min(int(len(v) * 0.95), len(v) - 1)], len(v)) for g, v in groups.items()}
    assert stats.p95(df.limit(0), "agent").count() == 0


def test_settings():
    assert settings({}) == Settings() and not settings({}).auth_enabled
    got = settings({"CORVANE_AUTH_ENABLED": "True", "CORVANE_LLM_TEMPERATURE": "0.7", "CORVANE_ALLOWED_ORIGINS": " http://a , ,http://b", "OTHER": "x"})
    assert (got.auth_enabled, got.llm_temperature, got.allowed_origins) == (True, 0.7, ("http://a", "http://b"))
    assert settings({"CORVANE_ALLOWED_ORIGINS": ""}).allowed_origins == Settings.allowed_origins


def test_exposition(spark):
    log = spark.createDataFrame([("GET", "/x", "200", 0.02), ("GET", "/x", "200", 3.0), ("POST", '/"y', "500", 20.0)], "method string, path string, status string, elapsed_s double")
    lines = [r.line for r in stats.exposition(log).orderBy("place", "line").collect()]
    assert lines[:2] == ["# HELP requests_total Requests by method, path and status.", "# TYPE requests_total counter"]
    for want in ('requests_total{method="GET",path="/x",status="200"} 2.0', 'requests_total{method="POST",path="/\\"y",status="500"} 1.0', 'request_latency_seconds_bucket{path="/x",le="0.025"} 1.0', 'request_latency_seconds_bucket{path="/x",le="+Inf"} 2.0', 'request_latency_seconds_count{path="/x"} 2.0', 'request_latency_seconds_sum{path="/x"} 3.02', 'request_latency_seconds_bucket{path="/\\"y",le="10.0"} 0.0'):
        assert want in lines, want
    assert len(stats.exposition(log.limit(0)).collect()) == 4


def test_quoting(spark):
    docs = spark.createDataFrame([(3, "the cat sat"), (1, "a cat"), (2, None), (None, "cat"), (5, "naïve sat")], "doc_id long, text string").repartition(3)
    asked = [(10, "cat"), (11, "sat"), (12, "dog"), (13, None), (14, "cat"), (15, ""), (16, "ïve")]
    assert {tuple(r) for r in retrieval.quoting(docs, asked).collect()} == {(10, 1), (11, 3), (14, 1), (15, 1), (16, 5)}
    assert retrieval.quoting(docs, []).count() == 0 and retrieval.quoting(docs.limit(0), asked).count() == 0


def test_hashed_blocks_are_small_and_alike(spark, tmp_path):
    """Blocks of hashed texts hold what isn't zero, in rows of bounded size, and are searched as those of whole vectors."""
    df = spark.createDataFrame([(f"r{i}", " ".join(f"word{(i * j) % 997}" for j in range(i % 9))) for i in range(9000)] + [("none", None)], "id string, text string").coalesce(1)
    asked = [(q, embedding.token_counts()([f"word{q} word{2 * q} word{3 * q}"])[0].tolist()) for q in range(20)]
    whole = vector_store.blocks(embedding.embedded(df, provider="counts", providers={"counts": embedding.token_counts}).drop("text"), "id")
    thin = vector_store.hashed(df, "id")
    sizes = lambda b: [r.n for r in b.select(sum(F.length(c) for c, kind in b.dtypes if kind == "binary").alias("n")).collect()]
    assert max(sizes(whole)) <= 1.1 * vector_store.BLOCK_BYTES and sum(sizes(thin)) * 10 < sum(sizes(whole))
    found = [vector_store.search(b, asked, 10).orderBy("query_id", "rank").collect() for b in (whole, thin)]
    assert found[0] == found[1] and len(found[0]) == 200


def test_ties_hold_few_candidates():
    """Of many records with one score only the k lowest ids are held, in any order of records."""
    ids = np.random.default_rng(1).permutation(50_000)
    best = []
    for lo in range(0, 50_000, 10_000):
        scores = np.where(ids[lo : lo + 10_000, None] % 3 == 0, 0.5, np.array([[0.0, 0.5]]))
        best = retrieval._merged(best, scores, ids[lo : lo + 10_000].astype(str), 4)
    text = sorted(map(str, range(50_000)))
    assert best[0].tolist() == [0] * 4 + [1] * 4 and best[1].tolist() == [x for x in text if int(x) % 3 == 0][:4] + text[:4]


def test_buckets_are_counted_in_their_row(spark):
    """No exchange carries (id, bucket) of rows with an id of their own; rows that share an id, or have none, are added up."""
    from corvane import queries

    df = spark.createDataFrame([(1, "aa bb aa"), (2, None), (3, "cc cc"), (3, "cc dd"), (None, "aa"), (None, "aa"), (4, "")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.bucket, r.tf) for r in queries.buckets(df, "doc_id").collect())
    at = {w: int(embedding.token_counts()([w]).argmax()) for w in ("aa", "bb", "cc", "dd")}
    assert got == sorted([("1", at["aa"], 2), ("1", at["bb"], 1), ("3", at["cc"], 3), ("3", at["dd"], 1), ("None", at["aa"], 2)])
    plan = queries.buckets(df.where("doc_id < 3"), "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and plan.count("Aggregate") == 1


def test_all_cosines_without_a_table_of_scores(spark, monkeypatch):
    """Blocks of both sides meet in tasks: only vectors are written, whatever the number of blocks."""
    from corvane import queries

    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 8)).round(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(100, [1.0]), (120, None), (None, [0.0] * 8), (140, [0.0] * 8)], "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(retrieval, "PAIR_ROWS", 7)
    monkeypatch.setattr(queries, "table", lambda *a: df)
    monkeypatch.setattr(retrieval, "stored_parts", lambda *a: 1 / 0)
    got = {(r.a, r.b): r.score for r in queries.pairwise_cosine(spark, "").collect()}
    unit = np.vstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(8)])
    ids = [*range(90), 140]
    want = {(a, b): round(float(unit[i] @ unit[j]), 5) for i, a in enumerate(ids) if a % 20 == 0 for j, b in enumerate(ids)} | {(100, 100): 1.0}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 2e-5


def test_all_cosines_take_few_bytes_a_row(spark, monkeypatch, tmp_path):
    """Written, the scores are coded by a dictionary in every file, and one file's vectors are dealt to several tasks."""
    import pyarrow.parquet as pq

    from corvane import queries

    x = np.random.default_rng(5).normal(size=(4000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(1)
    monkeypatch.setattr(queries, "table", lambda *a: df)
    monkeypatch.setattr(retrieval, "TASK_PAIRS", 400_000, raising=False)
    monkeypatch.setattr(retrieval, "CELLS", 1_000_000)
    queries.pairwise_cosine(spark, "").write.parquet(f"{tmp_path}/got")
    files = [*(tmp_path / "got").glob("*.parquet")]
    chunks = [m.row_group(g).column(2) for m in map(pq.read_metadata, files) for g in range(m.num_row_groups)]
    assert sum(c.num_values for c in chunks) == 4000 * 200
    assert all(c.has_dictionary_page for c in chunks) and sum(f.stat().st_size for f in files) < 5 * 4000 * 200
    assert len(files) == 2
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    got = pq.read_table(f"{tmp_path}/got")
    a, b, score = (got[c].to_numpy() for c in ("a", "b", "score"))
    assert len(np.unique(a * 4000 + b)) == len(a) and not (a % 20).any() and np.abs((unit[a] * unit[b]).sum(1) - score).max() < 6e-6


def test_all_cosines_where_queries_are_not_broadcast(spark, monkeypatch):
    """Queries of many blocks meet the records part by part, with the same rows; no queries give no rows."""
    x = np.random.default_rng(6).normal(size=(90, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    want = sorted(retrieval.all_similarities(df, df.where("vec_id % 3 = 0")).collect())
    monkeypatch.setattr(retrieval, "PAIR_ROWS", 4)
    monkeypatch.setattr(retrieval, "PAIR_BLOCKS", 2)
    monkeypatch.setattr(retrieval, "TASK_PAIRS", 100, raising=False)
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = retrieval.all_similarities(df, df.where("vec_id % 3 = 0"))
        assert "CartesianProduct" in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(got.collect()) == want and len(want) == 2700
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
    assert retrieval.all_similarities(df, df.where("vec_id < 0")).count() == 0
