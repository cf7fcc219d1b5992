"""Definitions and imports out of source files: one file row in, many rows out, in Arrow batches.

Python is parsed by its own grammar; a file that doesn't parse, and the other languages, by a lexical scanner (lexer,
definitions), so comments and strings hold none. Rows come in order of their place in the file. Lines count from 1 and ends
are included. Kinds of definitions whose node has no name of its own are anonymous: arrow functions, functions of C and
C++, Rust's impl blocks and Go's type declarations.
"""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.definitions import FINDERS, SAME, definitions_of, script_imports

def head(line: str) -> str:
    return line.strip()[:200]


def python_definitions(source: str) -> list[tuple]:
    lines, out = source.split("\n"), []

    def walk(node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                out.append((child.name, child.lineno, child.end_lineno, head(lines[child.lineno - 1])))
            walk(child)

    walk(ast.parse(source))
    return sorted(out, key=lambda x: (x[1], -x[2]))


def definitions(source: str | None, language: str | None) -> list[tuple]:
    """(name, start_line, end_line, signature); nothing for unknown languages and missing sources."""
    kind = SAME.get(language, language)
    if not source or kind not in FINDERS:
        return []
    if kind == "python":
        try:
            return python_definitions(source)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            pass
    return definitions_of(source, kind, language in ("typescript", "tsx"))


def imports(source: str | None, language: str | None) -> list[str]:
    """Sorted distinct import targets. Python: plainly imported modules and the modules of `from` (relative ones with
    their dots; renamed and future imports don't count). JavaScript family: sources of import and export ... from."""
    kind = SAME.get(language, language)
    if kind == "python" and source:
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return sorted(set(re.findall(r"^[ \t]*(?:import[ \t]+([\w.]+)[ \t]*$)", source, re.M)) | {x for x in re.findall(r"^[ \t]*from[ \t]+([\w.]+)[ \t]+import\b", source, re.M) if x != "__future__"})
        out = set()
        for node in ast.walk(tree):
            if isinstance(node, ast.Import):
                out |= {a.name for a in node.names if not a.asname}
            elif isinstance(node, ast.ImportFrom) and node.module != "__future__":
                out.add("." * node.level + (node.module or ""))
        return sorted(out)
    if kind == "javascript" and source:
        return script_imports(source)
    return []


def _each(files: DataFrame, fn, kind: str, schema: str) -> DataFrame:
    rows = files.select("repo_id", "path", "language", "content")

    def run(batches):
        for b in batches:
            found = [fn(s, g) for s, g in zip(b.column(3).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, kind)], names=["repo_id", "path", "found"])

    return rows.mapInArrow(run, f"repo_id string, path string, found {schema}")


def functions(files: DataFrame) -> DataFrame:
    """(repo_id, name, file_path, start_line, end_line, signature, ordinal) of every definition."""
    kind = pa.list_(pa.struct([("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("signature", pa.string())]))
    fn = lambda s, g: [dict(zip(("name", "start_line", "end_line", "signature"), x, strict=True)) for x in definitions(s, g)]
    got = _each(files, fn, kind, "array<struct<name:string,start_line:int,end_line:int,signature:string>>")
    return got.select("repo_id", F.col("path").alias("file_path"), F.posexplode("found").alias("ordinal", "f")).select("repo_id", "f.name", "file_path", "f.start_line", "f.end_line", "f.signature", "ordinal")


def import_edges(files: DataFrame) -> DataFrame:
    """(repo_id, source, target, relation), each pair once."""
    got = _each(files, imports, pa.list_(pa.string()), "array<string>")
    return got.select("repo_id", F.col("path").alias("source"), F.explode("found").alias("target"), F.lit("imports").alias("relation")).distinct()
