"""Queries that hold whole contents, not their first characters or lines."""

import re

from corvane import queries
from corvane.sources.tables import files

SF = "/root/testdata/sf0.001"


def test_context_holds_whole_documents(spark):
    got = {r.query_id: r.block for r in queries.QUERIES["context_block"](spark, SF).collect()}
    want = {}
    for r in queries.answered(spark, SF).select("query_id", "position", "path", "snippet").orderBy("query_id", "position").collect():
        want.setdefault(r.query_id, []).append(f"[{r.path}]\n{r.snippet or ''}")
    assert got == {q: "\n\n".join(x) for q, x in want.items()} and max(map(len, want.values())) == queries.TOP


def test_every_line_is_a_record(spark):
    want = {(f"{r.path}:{i}-{i}", x) for r in files(spark, SF).collect() for i, x in enumerate((r.content or "").split("\n"), 1) if x}
    got = [(r.record_id, r.snippet) for r in queries.QUERIES["function_snippets"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want and any(not k.endswith(("-1", "-2")) for k, _ in want)
    index = queries.QUERIES["index_records"](spark, SF).where("scope = 'function'").collect()
    assert {(r.record_id, r.name) for r in index} == {(k, (re.findall("[A-Za-z_][A-Za-z0-9_]+", x) or ["<anonymous>"])[0]) for k, x in want}


def test_functions_of_every_repository(spark):
    want = {}
    for r in files(spark, SF).collect():
        want[r.repo_id] = want.get(r.repo_id, 0) + sum(x != "" for x in (r.content or "").split("\n"))
    assert {r.repo_id: r.function_count for r in queries.QUERIES["repo_functions"](spark, SF).collect()} == want
