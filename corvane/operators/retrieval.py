"""Exact top-k retrieval, reranking and citations.

A block of queries travels with the task; the corpus is scanned once for it, by matrix products of bounded size. Each task
passes on its own k best per query, so what is shuffled is at most k rows a query and task. Query tables of any size are
searched block after block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.vectors import DIMENSIONS
from corvane.scratch import stored, stored_parts

BLOCK, CELLS = 4096, 4_000_000  # queries a scan; scores held at once
PAIR_ROWS, PAIR_BLOCKS = 1024, 128  # vectors of a block where all pairs of blocks meet; blocks that are broadcast
TASK_PAIRS, LEAST_PAIRS = 1 << 25, 1 << 20  # scores that a task of all pairs makes: at most about, and worth a task of its own


def _merged(best: list[np.ndarray], scores: np.ndarray, ids: np.ndarray, k: int, own: np.ndarray | None = None) -> list[np.ndarray]:
    """The k best of each query so far, as (query place, id, score), with a block of rows by queries. Ties: lower id.

    own: the places of the queries that the columns of scores stand for, where these aren't all.
    """
    places = np.arange(scores.shape[1]) if own is None else own
    floor = np.full(len(places), -np.inf)  # a query that has k already takes none below its last
    if best:
        ends = np.flatnonzero(np.append(best[0][1:] != best[0][:-1], True))
        full = ends[np.diff(ends, prepend=-1) >= k]
        last = np.full(max(places.max(initial=0), best[0][-1]) + 1, -np.inf)
        last[best[0][full]] = best[2][full]
        floor = last[places]
    near = (scores >= floor) & (scores > -np.inf)
    if near.sum() > 4 * k * len(places):  # of many alike only the k of lowest id, so what is held stays bounded
        n = min(k, len(scores))
        floor = np.maximum(floor, np.partition(scores, len(scores) - n, axis=0)[len(scores) - n])
        above, order = scores > floor, np.argsort(ids, kind="stable")
        near = ((scores == floor) & near)[order]
        near &= np.cumsum(near, axis=0, dtype=np.int32) <= k - above.sum(0)
        near[np.argsort(order)[np.nonzero(above)[0]], np.nonzero(above)[1]] = True
        r, c = np.nonzero(near)
        r = order[r]
    else:
        r, c = np.nonzero(near)
    i, v, c = ids[r], scores[r, c], places[c]
    q, i, v = [np.concatenate(x) for x in zip(best, (c, i, v), strict=True)] if best else (c, i, v)
    order = np.lexsort((i, -v, q))
    q, i, v = q[order], i[order], v[order]
    starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
    near = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q)))) < k
    return [q[near], i[near], v[near]]


def _search(records: DataFrame, key: str, value: Column, names: list, make, k: int, scope: Column | None = None, scopes: list | None = None) -> DataFrame:
    """One scan. make() runs in each task and returns the function from a column of values to scores, rows by queries.

    A score of minus infinity is no hit. With `scope`, only records whose scope is that of the query are hits.
    """
    kind = "bigint" if records.schema[key].dataType.typeName() in ("byte", "short", "integer", "long") else "string"
    arrow = pa.int64() if kind == "bigint" else pa.string()

    def run(batches):
        score, best, step = make(), [], max(1, CELLS // max(1, len(names)))
        at = {x: i for i, x in enumerate(dict.fromkeys(scopes or []))}
        own = np.array([at[x] for x in scopes or []])
        for b in batches:
            for lo in range(0, b.num_rows if names and k > 0 else 0, step):
                part = b.slice(lo, step)
                scores = score(part.column(1).to_pylist())
                if scopes is not None:
                    scores = np.where(np.array([at.get(x, -1) for x in part.column(2).to_pylist()])[:, None] == own[None, :], scores, -np.inf)
                best = _merged(best, scores, np.array(part.column(0).to_pylist()), k)
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(names)[best[0]], pa.int64()), pa.array(best[1].tolist(), arrow), pa.array(best[2], pa.float64())], names=["query_id", "record_id", "score"])

    rows = records.where(F.col(key).isNotNull()).select(F.col(key).cast(kind), value, *([] if scope is None else [scope.alias("scope")]))
    return ranked(rows.mapInArrow(run, f"query_id long, record_id {kind}, score double"), k)


def in_blocks(queries: DataFrame, search: Callable[[list[tuple]], DataFrame], block: int = BLOCK) -> DataFrame:
    """search() of all rows (id, value, ...) of `queries`, of which the driver holds two blocks at a time.

    What several blocks find is written block by block into one table, so the plan is one scan for any number of them.
    """
    rows = (tuple(r) for r in queries.where(F.col(queries.columns[0]).isNotNull()).toLocalIterator())
    part, rest = list(islice(rows, block)), list(islice(rows, block))
    if not rest:
        return search(part)

    def found():
        nonlocal part, rest
        while part:
            yield search(part)
            part, rest = rest, list(islice(rows, block))

    return stored_parts(found(), "found")


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "record_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _cosines(queries: list[tuple], digits: int) -> Callable:
    """For a task: from vectors to their rounded cosines with the queries (id, vector), -inf where lengths differ."""
    blocks = {}
    for n in {len(q[1]) for q in queries}:
        own = [i for i, q in enumerate(queries) if len(q[1]) == n]
        m = np.array([queries[i][1] for i in own], np.float64).reshape(len(own), n)
        size = np.linalg.norm(m, axis=1, keepdims=True)
        blocks[n] = own, m / np.where(size > 0, size, 1)

    def make():
        def score(vectors: list) -> np.ndarray:
            out = np.full((len(vectors), len(queries)), -np.inf)
            for n, (own, m) in blocks.items():
                rows = [i for i, v in enumerate(vectors) if len(v) == n]
                x = np.array([vectors[i] for i in rows], np.float64).reshape(len(rows), n)
                size = np.linalg.norm(x, axis=1, keepdims=True)
                out[np.ix_(rows, own)] = np.round(x / np.where(size > 0, size, 1) @ m.T, digits) + 0.0
            return out

        return score

    return make


def similarities(records: DataFrame, queries: list[tuple], digits: int = 6, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, record_id, score): every record's cosine with each query (id, vector), integer ids, in one scan.

    Zero vectors score 0; queries and records without id or vector, and pairs of unequal lengths, are left out. At most
    CELLS scores are held at once.
    """
    queries = [q for q in queries if q[0] is not None and q[1] is not None]
    names, make = np.array([q[0] for q in queries], np.int64), _cosines(queries, digits)

    def run(batches):
        score, step = make(), max(1, CELLS // 8 // max(1, len(names)))
        for b in batches:
            for lo in range(0, b.num_rows if len(names) else 0, step):
                part = b.slice(lo, step)
                scores = score(part.column(1).to_pylist())
                r, c = np.nonzero(scores > -np.inf)
                ids = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(names[c]), pa.array(ids[r]), pa.array(scores[r, c])], names=["query_id", "record_id", "score"])

    rows = records.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint"), vector)
    return rows.mapInArrow(run, "query_id long, record_id long, score double")


def all_similarities(records: DataFrame, queries: DataFrame, digits: int = 6, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, record_id, score): every record's cosine with each of any number of queries (of the same columns).

    Queries are written in blocks, records are dealt out evenly, and every pair of blocks meets in a task, so neither side
    passes through the driver and no score is written before it is asked for. Zero vectors score 0; queries and records
    without id or vector, and pairs of unequal lengths, are left out.

    Rows come record by record, so a file's ids are runs and repeats, and a task's first scores come in order: a Parquet
    writer judges by a column's first page whether a dictionary pays, then keeps it, for 17 bits a score instead of 64. A
    task's rows (TASK_PAIRS) fit one such column.
    """

    def whole(df: DataFrame) -> DataFrame:
        return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint"), vector)

    def blocks(rows: DataFrame, names: list[str]) -> DataFrame:
        def run(batches):
            for b in batches:
                for lo in range(0, b.num_rows, PAIR_ROWS):
                    part = b.slice(lo, PAIR_ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array([c.to_pylist()], t) for c, t in zip(part.columns, kinds, strict=True)], names=names)

        kinds = [pa.list_(pa.int64()), pa.list_(pa.list_(pa.float32() if rows.dtypes[1][1] == "array<float>" else pa.float64()))]
        return rows.mapInArrow(run, f"{names[0]} array<bigint>, {names[1]} array<{rows.dtypes[1][1] if rows.dtypes[1][1] == 'array<float>' else 'array<double>'}>")

    known, wanted = whole(records), whole(queries)
    n = wanted.count()
    sides, total = max(1, -(-n // (PAIR_ROWS * PAIR_BLOCKS))), n * known.count()
    cores = min(records.sparkSession.sparkContext.defaultParallelism, -(-total // LEAST_PAIRS))
    asked = stored(blocks(wanted.repartition(sides), ["q", "qv"]), "asked")
    dealt = known.repartition(max(1, cores // sides, -(-total // (TASK_PAIRS * sides))))
    pairs = blocks(dealt, ["r", "rv"]).crossJoin(F.broadcast(asked) if sides == 1 else asked)

    def run(batches):
        first = True
        for b in batches:
            for r, rv, q, qv in zip(*b.columns, strict=True):
                names, ids, vectors = np.array(q.as_py(), np.int64), np.array(r.as_py(), np.int64), rv.as_py()
                score, step = _cosines(list(zip(names, qv.as_py(), strict=True)), digits)(), max(1, CELLS // 8 // max(1, len(names)))
                for lo in range(0, len(ids), step):
                    scores = score(vectors[lo : lo + step])
                    i, c = np.nonzero(scores > -np.inf)
                    if first:
                        order = np.argsort(scores[i, c])
                        i, c, first = i[order], c[order], False
                    yield pa.RecordBatch.from_arrays([pa.array(names[c]), pa.array(ids[lo : lo + step][i]), pa.array(scores[i, c])], names=["query_id", "record_id", "score"])

    return pairs.mapInArrow(run, "query_id long, record_id long, score double")


def vector_search(records: DataFrame, queries: list[tuple], k: int, key: str = "vec_id", vector: str = "embedding", scope: str | None = None) -> DataFrame:
    """(query_id, record_id, score, rank): the k records of highest cosine for each query (id, vector).

    With `scope`, queries are (id, vector, scope) and only records whose column of that name has this value are searched.
    Zero vectors score 0. Queries and records without id or vector are left out, and a record is no hit for a query of
    another length; so are null scopes. Ids of records may be integers or strings.
    """
    queries = [q for q in queries if q[0] is not None and q[1] is not None and (scope is None or q[2] is not None)]
    names = [q[0] for q in queries]
    given = records.where(F.col(vector).isNotNull())
    return _search(given, key, F.col(vector), names, _cosines(queries, 6), k, *([] if scope is None else [F.col(scope), [q[2] for q in queries]]))


def hash_search(records: DataFrame, queries: list[tuple[int, str]], k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As vector_search, over hash embeddings made on the fly from texts (null: no tokens)."""
    token = re.compile(T.TOKEN)

    def counts(t: str | None, known: dict) -> np.ndarray:
        out = np.zeros(DIMENSIONS)
        words = token.findall(t or "")
        for w in {w for w in words if w not in known}:
            if len(known) > 200_000:
                known.clear()
            known[w] = int.from_bytes(hashlib.sha256(w.encode()).digest()[:4], "big") % DIMENSIONS
        if words:
            out = np.bincount([known[w] if w in known else int.from_bytes(hashlib.sha256(w.encode()).digest()[:4], "big") % DIMENSIONS for w in words], minlength=DIMENSIONS).astype(float)
        return out

    names = [q for q, _ in queries]
    m = np.array([counts(t, {}) for _, t in queries]).reshape(len(names), DIMENSIONS)
    q2 = (m * m).sum(1)

    def make():
        known: dict = {}

        def score(texts: list) -> np.ndarray:
            x = np.array([counts(t, known) for t in texts])
            n = np.sqrt((x * x).sum(1))[:, None] * np.sqrt(q2)[None, :]
            return np.round(np.divide(x @ m.T, n, out=np.zeros((len(x), len(names))), where=n > 0), 6)

        return score

    return _search(records, key, F.col(text).cast("string"), names, make, k)


def quoting(records: DataFrame, queries: list[tuple[int, str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, record_id): for each query whose text some record contains, the least such record (integer id).

    One scan, one automaton of all query texts; a task passes on one row a query at most. An empty query text is in every
    text; a null one, and a null text, is in none.
    """
    ids: dict[str, list[int]] = {}
    for q, t in queries:
        if t is not None:
            ids.setdefault(t, []).append(q)

    def run(batches):
        import ahocorasick

        auto = ahocorasick.Automaton()
        for t in filter(None, ids):
            auto.add_word(t, t)
        auto.make_automaton()
        least: dict[str, int] = {}
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = {w for _, w in auto.iter(t)} if len(auto) else set()
                for w in found | ({""} & ids.keys()):
                    least[w] = min(i, least.get(w, i))
        rows = [(q, i) for w, i in least.items() for q in ids[w]]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.int64())], names=["query_id", "record_id"])

    rows = records.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint"), F.col(text).cast("string"))
    return rows.mapInArrow(run, "query_id long, record_id long").groupBy("query_id").agg(F.min("record_id").alias("record_id"))


def overlap(question: Column, content: Column) -> Column:
    """Share of the question's distinct tokens that the content has; 0 where either has none."""
    q = T.token_set(question)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, T.token_set(F.coalesce(content, F.lit("")))))  / F.size(q))


def reranked(found: DataFrame, k: int) -> DataFrame:
    """found has query_id, question, path, snippet and rank; keeps the k with most overlap, earlier rank first.

    A package's near-empty entry file counts a tenth.
    """
    thin = F.endswith("path", F.lit("__init__.py")) & (F.length(T.strip(F.col("snippet"))) < 50)
    s = F.round(overlap(F.col("question"), F.col("snippet")) * F.when(thin, 0.1).otherwise(1.0), 6)
    w = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "rank")
    return found.withColumn("overlap", s).withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def citation(path: Column, snippet: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """path, the line range if both ends are known, and the first two lines, 200 characters at most."""
    head = path if start is None else F.concat(path, F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lit(" (lines "), start, F.lit("-"), end, F.lit(")"))).otherwise(""))
    two = T.strip(F.array_join(F.slice(T.lines(snippet), 1, 2), " "))
    short = F.when(F.length(two) > 200, F.concat(F.substring(two, 1, 200), F.lit("..."))).otherwise(two)
    return F.when(F.coalesce(short, F.lit("")) == "", head).otherwise(F.concat(head, F.lit(" | "), short))


def record_line(path: Column, language: Column, signature: Column) -> Column:
    """The line of an answer: of a function if there is a signature, else of a file."""
    plain = F.when(F.coalesce(language, F.lit("")) == "", F.concat(F.lit("- file: "), path)).otherwise(F.concat(F.lit("- "), language, F.lit(" file: "), path))
    return F.when(signature.isNotNull(), F.concat(F.lit("- function: "), path, F.lit(" :: "), signature)).otherwise(plain)
