"""Registered queries of the engine and, beside each, the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions import vectors as V
from corvane.operators import embedding, graph, retrieval, stats
from corvane.scratch import small
from corvane.sources import vector_store
from corvane.sources.tables import files, query_log, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
EVERY, TOP, FETCH = 20, 5, 10
FOLDER = ".engine"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


FILES = "select source as repo_id, source || '/' || doc_id as path, lang as language, n_chars as size_bytes, text as content, doc_id from documents"
LOG = "select event_id, user_id as repo_id, event_type as agent, value as latency_ms, cast(json_extract_string(props, '$.k') as bigint) as citations, ts from events"
EDGES = "select distinct url as source, target from (select url, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) as target from pages)"
TOK = "regexp_extract_all({}, '[A-Za-z_][A-Za-z0-9_]+')"
NAMES = ["src/main.py", "web/app/index.tsx", "lib/auth/guard.js", "core/services/engine.java", "api/router.go", "db/store.rs", "model/types.h", "tests/test_all.cpp", "ui/page.jsx", "conf/settings.yml", "docs/readme.md", "tool/helper.rb", "a/b/c.cs", "x/.git/config", "node_modules/m/index.js", "pkg/__init__.py", "Makefile", "build.KT", "util/log.scala", "k/view.swift", "one.php", "two.hpp"]
#: A path of every document: its repository, a word of its text, and a file name in turn.
PATHS = f"select doc_id, coalesce(source, 'none') || '/' || coalesce(nullif(lower(regexp_extract(text, '[A-Za-z]+')), ''), 'x') || '/' || {NAMES}[(doc_id % {len(NAMES)} + 1)::int] as path from documents"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a file path each."""
    names = F.array(*[F.lit(x) for x in NAMES])
    word = F.coalesce(F.nullif(F.lower(F.regexp_extract("text", "[A-Za-z]+", 0)), F.lit("")), F.lit("x"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), word, F.lit("/"), F.element_at(names, (F.col("doc_id") % len(NAMES) + 1).cast("int"))).alias("path"))


SUFFIX = r"regexp_extract(path, '[^/](\.[^./]+)$', 1)"
EXT = f"ltrim({SUFFIX}, '.')"
#: Tables written out for SQL, apart from those of the implementation.
SCAN_SQL = "case {} when '.py' then 'python' when '.js' then 'javascript' when '.jsx' then 'javascript' when '.ts' then 'typescript' when '.tsx' then 'tsx' when '.java' then 'java' when '.go' then 'go' when '.rs' then 'rust' when '.c' then 'c' when '.h' then 'c' when '.cpp' then 'cpp' when '.cc' then 'cpp' when '.cxx' then 'cpp' when '.hpp' then 'cpp' when '.rb' then 'ruby' when '.cs' then 'c_sharp' when '.php' then 'php' when '.kt' then 'kotlin' when '.swift' then 'swift' when '.scala' then 'scala' end"
VIEW_SQL = "case {} when 'py' then 'python' when 'js' then 'javascript' when 'jsx' then 'javascript' when 'ts' then 'typescript' when 'tsx' then 'typescript' when 'java' then 'java' when 'go' then 'go' when 'rs' then 'rust' when 'c' then 'c' when 'h' then 'c' when 'cpp' then 'cpp' when 'rb' then 'ruby' when 'cs' then 'csharp' when 'php' then 'php' when 'kt' then 'kotlin' when 'swift' then 'swift' when 'json' then 'json' when 'yaml' then 'yaml' when 'yml' then 'yaml' when 'md' then 'markdown' when 'txt' then 'text' when 'toml' then 'toml' when 'cfg' then 'ini' when 'ini' then 'ini' when 'sh' then 'bash' when 'bat' then 'batch' end"
IGNORED_SQL = "['__pycache__', '.git', '.pytest_cache', '.venv', 'node_modules']"

# ---- scans and projections


@query(FILES.replace("text as content, doc_id", "length(text) as n") + " where lang is not null")
def scan_documents(spark, sf_dir):
    f = files(spark, sf_dir).where("language is not null")
    return f.select("repo_id", "path", "language", "size_bytes", F.length("content").cast("bigint").alias("n"))


@query("select vec_id as record_id, label as scope, len(embedding)::bigint as dims from embeddings")
def scan_embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), F.col("label").alias("scope"), F.size("embedding").cast("bigint").alias("dims"))


@query(f"select path, length(content) - length(replace(content, chr(10), '')) + 1 as line_count, coalesce({VIEW_SQL.format(EXT)}, {EXT}) as language from ({FILES}) where doc_id = 7")
def file_content(spark, sf_dir):
    f = files(spark, sf_dir).where("doc_id = 7")
    return f.select("path", (F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("line_count"), T.view_language(F.col("path")).alias("language"))


@query(f"""select doc_id, full_path as path, case when k = 0 then path when starts_with(full_path, '/src' || k || '/') then substr(full_path, length('/src' || k) + 2) else list_last(string_split(path, '/')) end as rel
    from (select doc_id, path, doc_id % 7 as k, case when doc_id % 7 = 0 then '/w/repos/' || doc_id else '' end || '/' || path as full_path from ({PATHS}))
    where not list_has_any(string_split(path, '/'), {IGNORED_SQL})""")
def list_files(spark, sf_dir):
    """Files of repositories with an absolute root, or (every seventh) known by their folder `repos` only."""
    k = F.col("doc_id") % 7
    full = F.concat(F.when(k == 0, F.concat(F.lit("/w/repos/"), "doc_id")).otherwise(""), F.lit("/"), "path")
    p = paths(spark, sf_dir).withColumn("path", full).where(T.visible(F.col("path")))
    root = F.when(k > 0, F.concat(F.lit("/src"), k))
    return p.select("doc_id", "path", T.relative_path(F.col("path"), root).alias("rel")).where("rel is not null").orderBy("path", "doc_id")


@query(f"select doc_id, path, {SCAN_SQL.format(SUFFIX)} as language from ({PATHS})")
def language_from_suffix(spark, sf_dir):
    return paths(spark, sf_dir).select("doc_id", "path", T.scan_language(F.col("path")).alias("language"))


@query(f"select doc_id, path, coalesce({VIEW_SQL.format(EXT)}, {EXT}) as language from ({PATHS})")
def language_from_ext(spark, sf_dir):
    return paths(spark, sf_dir).select("doc_id", "path", T.view_language(F.col("path")).alias("language"))


@query(f"select doc_id, case when {SUFFIX} = '.py' then 'python' when {SUFFIX} in ('.js', '.jsx', '.ts', '.tsx') then 'javascript' end as grammar from ({PATHS})")
def import_grammar(spark, sf_dir):
    return paths(spark, sf_dir).select("doc_id", T.import_grammar(F.col("path")).alias("grammar"))


LINES = "select path, repo_id, doc_id, content, string_split(content, chr(10)) as ls from ({f})".format(f=FILES)


REPOS = "select distinct source as repo_id, case when source like '%0' then 'Named ' || source else '' end as name, case when source like '%1' then 'https://example.org/team/' || source || 'x.git/' end as remote from documents where source is not null"


def repos(spark, sf_dir):
    """The catalogue of repositories: some have a name, some a remote address only, some neither."""
    r, c = table(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("repo_id")).distinct(), F.col("repo_id")
    return r.select("repo_id", F.when(F.endswith(c, F.lit("0")), F.concat(F.lit("Named "), c)).otherwise("").alias("name"), F.when(F.endswith(c, F.lit("1")), F.concat(F.lit("https://example.org/team/"), c, F.lit("x.git/"))).alias("remote"))


NAMED = f"select repo_id, case when name <> '' then name when remote is not null then regexp_extract(remote, '/([^/]+)[.]git/$', 1) else left(repo_id, 8) end as name from ({REPOS})"


@query(f"{NAMED} order by repo_id")
def list_repos(spark, sf_dir):
    return repos(spark, sf_dir).select("repo_id", T.repo_label(F.col("name"), F.col("remote"), F.col("repo_id")).alias("name")).orderBy("repo_id")


# ---- text


@query(f"select doc_id, len({TOK.format('text')})::bigint as n, len(list_distinct({TOK.format('text')}))::bigint as n_distinct from documents")
def token_counts(spark, sf_dir):
    t = T.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("bigint").alias("n"), F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"))


@query(f"select item_id, array_to_string(list_sort(list_distinct({TOK.format('lower(text)')})), ' ') as tokens from benchmark")
def token_sets(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(T.token_set(F.col("text"))), " ").alias("tokens"))


@query("select doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: i between 2 and 3 and (x <> '' or i < len(string_split(text, chr(10))))), chr(10)) as snippet from documents")
def line_snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.line_range(F.col("text"), F.lit(2), F.lit(3)).alias("snippet"))


WHOLE_LINES = f"select f.path, s, ls[s] as x from ({LINES}) f, unnest(range(1, len(ls) + 1)) t(s) where ls[s] <> ''"


def line_spans(spark, sf_dir):
    """Every line that isn't empty, with its number from 1."""
    f = files(spark, sf_dir).select("path", F.posexplode(T.lines(F.col("content"))).alias("i", "x")).where("x <> ''")
    return f.select("path", F.concat("path", F.lit(":"), F.col("i") + 1, F.lit("-"), F.col("i") + 1).alias("record_id"), "x")


@query(f"select path || ':' || s || '-' || s as record_id, x as snippet from ({WHOLE_LINES})")
def function_snippets(spark, sf_dir):
    return line_spans(spark, sf_dir).select("record_id", F.col("x").alias("snippet"))


@query(f"""select path as record_id, 'file' as scope, path, null::varchar as name from ({FILES}) union all
    select path || ':' || s || '-' || s, 'function', path, coalesce(nullif(regexp_extract(x, '[A-Za-z_][A-Za-z0-9_]+'), ''), '<anonymous>') from ({WHOLE_LINES})""")
def index_records(spark, sf_dir):
    whole = files(spark, sf_dir).select(F.col("path").alias("record_id"), F.lit("file").alias("scope"), "path", F.lit(None).cast("string").alias("name"))
    return whole.unionByName(line_spans(spark, sf_dir).select("record_id", F.lit("function").alias("scope"), "path", F.coalesce(F.nullif(F.regexp_extract("x", "[A-Za-z_][A-Za-z0-9_]+", 0), F.lit("")), F.lit("<anonymous>")).alias("name")))


@query(r"select doc_id, left(regexp_replace(string_split(text, chr(10))[1], '^\s+|\s+$', '', 'g'), 200) as signature from documents")
def node_signature(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.signature(F.col("text")).alias("signature"))


HEADS = r"""regexp_extract_all(html, '<(h[1-6]|title|li|nav|p)\b', 1)"""


@query(f"select page_id, i as ordinal, {HEADS}[i] as kind, coalesce(nullif(trim({HEADS}[i]), ''), '<anonymous>') as name from pages, unnest(range(1, len({HEADS}) + 1)) t(i)")
def extract_nodes(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"<(h[1-6]|title|li|nav|p)\b"), F.lit(1))).alias("i", "kind"))
    return p.select("page_id", (F.col("i") + 1).cast("bigint").alias("ordinal"), "kind", F.coalesce(F.nullif(F.trim("kind"), F.lit("")), F.lit("<anonymous>")).alias("name"))


@query("select doc_id, array_to_string(list_slice(case when list_last(ls) = '' then ls[1:len(ls) - 1] else ls end, 1, 200), chr(10)) as head from (select doc_id, string_split(text, chr(10)) as ls from documents)")
def explain_head(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(T.lines(F.col("text")), 1, 200), "\n").alias("head"))


@query("""with f as (select doc_id, coalesce(source, 'none') || '/' || doc_id as path, string_split(coalesce(text, ''), chr(10)) as ls, case when doc_id % 4 > 0 then doc_id % 5 + 1 end as lo, case when doc_id % 4 > 0 then doc_id % 5 + 10 end as hi from documents),
    g as (select doc_id, path, lo, hi, array_to_string(list_slice(case when list_last(ls) = '' then ls[1:len(ls) - 1] else ls end, coalesce(lo, 1), coalesce(hi, 200)), chr(10)) as part from f)
    select doc_id, 'Snippet from ' || path || case when lo is null then '' else ' (lines ' || lo || '-' || hi || ')' end || ', ' ||
    (case when part = '' then 0 else len(string_split(part, chr(10))) - (right(part, 1) = chr(10))::int end) || ' lines.' as summary from g""")
def explain_summary(spark, sf_dir):
    """A sentence on a snippet of every document: ten lines of three in four, the head of the others."""
    k = F.col("doc_id")
    lo, hi = F.when(k % 4 > 0, k % 5 + 1).cast("int"), F.when(k % 4 > 0, k % 5 + 10).cast("int")
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), k)
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet_summary(path, lo, hi, T.snippet(F.col("text"), lo, hi)).alias("summary"))


CHUNK = "select item_id, i // 4 as n, array_to_string(ws[i + 1:i + 4], ' ') || case when i + 4 < len(ws) then ' ' else '' end as chunk from (select item_id, string_split(text, ' ') as ws from benchmark), unnest(range(0, len(ws), 4)) t(i)"


@query(CHUNK)
def stream_chunks(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.chunks(F.col("text"))).alias("n", "chunk")).withColumn("n", F.col("n").cast("bigint"))


@query("""select conv_id, turn, 'data: {"type":"token","turn":' || turn || '}' || chr(10) || chr(10) as event from conversations""")
def sse_encode(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.sse(F.struct(F.lit("token").alias("type"), "turn")).alias("event"))


@query("select conv_id, turn, role as kind, turn as value, text from conversations where turn % 3 <> 0")
def sse_decode(spark, sf_dir):
    """Events that are broken or have no `data: ` are dropped."""
    body = F.to_json(F.struct(F.col("role").alias("type"), "turn", "text"))
    sent = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("data: {"), "text")).otherwise(F.concat(F.lit("data: "), body)).alias("line"))
    got = sent.where(F.startswith("line", F.lit("data: "))).withColumn("x", F.from_json(F.expr("substring(line, 7)"), "type string, turn bigint, text string", {"mode": "PERMISSIVE"}))
    return got.where("x.type is not null").select("conv_id", "turn", F.col("x.type").alias("kind"), F.col("x.turn").alias("value"), "x.text")


# ---- embeddings

BUCKET = "('0x' || substr(sha256(tok), 1, 8))::ubigint % 384"
BUCKETS = f"select {{id}}, ({BUCKET})::bigint as bucket, count(*) as tf from (select {{id}}, unnest({TOK.format('text')}) as tok from {{t}}) group by all"


def buckets(df, key):
    """Tokens become counted buckets in their row; only rows that share their key are added up over an exchange."""
    again = small(df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("again")), "again")
    same = F.col(key).eqNullSafe(F.col("again"))

    def counted(rows):
        return rows.select(key, F.inline(V.tally(F.transform(T.tokens(F.col("text")), V.bucket)))).select(key, F.col("x").alias("bucket"), F.col("n").alias("tf"))

    shared = counted(df.join(again, same, "left_semi")).groupBy(key, "bucket").agg(F.sum("tf").alias("tf"))
    return counted(df.join(again, same, "left_anti")).unionByName(shared)


@query(BUCKETS.format(id="doc_id", t="documents"))
def hash_buckets(spark, sf_dir):
    return buckets(table(spark, sf_dir, "documents"), "doc_id")


@query(f"with b as ({BUCKETS.format(id='item_id', t='benchmark')}) select item_id, bucket, round(tf / sqrt(sum(tf * tf) over (partition by item_id))::double, 6) as weight from b")
def hash_embedding(spark, sf_dir):
    from pyspark.sql import Window

    b = buckets(table(spark, sf_dir, "benchmark"), "item_id")
    n = F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(Window.partitionBy("item_id")).cast("double"))
    return b.select("item_id", "bucket", F.round(F.col("tf") / n, 6).alias("weight"))


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 5) as norm from embeddings")
def vector_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 5).alias("norm"))


@query(f"select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5) as score from embeddings a join embeddings b on a.vec_id % {EVERY} = 0")
def pairwise_cosine(spark, sf_dir):
    """Every twentieth vector with every vector."""
    e = table(spark, sf_dir, "embeddings")
    got = retrieval.all_similarities(e, e.where(F.col("vec_id") % EVERY == 0), 5)
    return got.select(F.col("query_id").alias("a"), F.col("record_id").alias("b"), "score")


KNN = "select query_id, record_id, score, rank from (select q.vec_id as query_id, e.vec_id as record_id, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) as score, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) desc, e.vec_id) as rank from embeddings q, embeddings e where q.vec_id {which}) where rank <= {k}"


def embedding_store(spark, sf_dir):
    """The embeddings, stored in blocks by their label."""
    return vector_store.indexed(spark, sf_dir, "embeddings", lambda: vector_store.blocks(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("label")), partitioned=True)


@query(KNN.format(which=f"% {EVERY} = 0", k=TOP))
def knn_topk(spark, sf_dir):
    """The nearest of every twentieth vector, from the stored blocks."""
    asked = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % EVERY == 0).select("vec_id", "embedding")
    return retrieval.in_blocks(asked, lambda q: vector_store.search(embedding_store(spark, sf_dir), q, TOP))


@query(KNN.format(which=f"% {EVERY} = 0", k=TOP))
def knn_join(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return retrieval.in_blocks(e.where(F.col("vec_id") % EVERY == 0).select("vec_id", "embedding"), lambda q: retrieval.vector_search(e, q, TOP))


@query(KNN.format(which=f"% {EVERY} = 0 and q.label = e.label", k=TOP).replace("select query_id, record_id, score, rank from", "select query_id, record_id, e2.label as scope, len(e2.embedding)::bigint as dims, rank from", 1).replace(f") where rank <= {TOP}", f") h join embeddings e2 on e2.vec_id = h.record_id where rank <= {TOP}"))
def search_in_scope(spark, sf_dir):
    """Every twentieth vector against those of its own label, of which only the stored partitions are read."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where(F.col("vec_id") % EVERY == 0).select("vec_id", "embedding", "label")
    found = small(retrieval.in_blocks(asked, lambda q: vector_store.search(embedding_store(spark, sf_dir), q, TOP, scoped=True)), "found")
    rows = e.select(F.col("vec_id").alias("record_id"), F.col("label").alias("scope"), F.size("embedding").cast("bigint").alias("dims"))
    return rows.join(found, "record_id").select("query_id", "record_id", "scope", "dims", F.col("rank").cast("bigint").alias("rank"))


# ---- answers

HITS = f"""qb as ({BUCKETS.format(id='item_id', t='benchmark')}), db as ({BUCKETS.format(id='doc_id', t='documents')}),
    qn as (select item_id, sqrt(sum(tf * tf)::double) as n from qb group by 1), dn as (select doc_id, sqrt(sum(tf * tf)::double) as n from db group by 1),
    dots as (select item_id, doc_id, sum(qb.tf * db.tf)::double as d from qb join db using (bucket) group by all),
    scored as (select item_id as query_id, doc_id as record_id, round(d / (dn.n * qn.n), 6) as score from dots join qn using (item_id) join dn using (doc_id)),
    hits as (select *, row_number() over (partition by query_id order by score desc, record_id) as rank from scored qualify rank <= {FETCH})"""


def counted(df, text):
    """df with the token counts of a text by hash bucket, as vector."""
    return embedding.embedded(df, text, "counts", {"counts": embedding.token_counts})


def hits(spark, sf_dir, k=FETCH):
    """The questions' nearest documents; these are hashed once a session."""
    store = vector_store.indexed(spark, sf_dir, "documents", lambda: vector_store.hashed(table(spark, sf_dir, "documents"), "doc_id"))
    asked = counted(table(spark, sf_dir, "benchmark").select("item_id", "text"), "text").select("item_id", "vector")
    return retrieval.in_blocks(asked, lambda q: vector_store.search(store, q, k))


def answered(spark, sf_dir):
    """The reranked hits of every question, with path and content."""
    f = files(spark, sf_dir).select(F.col("doc_id").alias("record_id"), "path", "language", F.col("content").alias("snippet"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return retrieval.reranked(f.join(small(hits(spark, sf_dir).join(b, "query_id"), "asked"), "record_id"), TOP)


QT = TOK.format("lower(b.text)")
RERANK = f"""with {HITS}, o as (select query_id, record_id, rank, round(case when len({QT}) = 0 then 0.0 else len(list_intersect(list_distinct({QT}), list_distinct({TOK.format('lower(d.text)')}))) / len(list_distinct({QT})) end, 6) as overlap
    from hits join documents d on d.doc_id = record_id join benchmark b on b.item_id = query_id),
    r as (select *, row_number() over (partition by query_id order by overlap desc, rank) as position from o qualify position <= {TOP})"""
TWO = r"regexp_replace(array_to_string(case when list_last(ls) = '' then ls[1:len(ls) - 1] else ls end[1:2], ' '), '^\s+|\s+$', '', 'g')"
CITED = RERANK + f""", c as (select query_id, position, path, {TWO} as two, language from r join (select doc_id, source || '/' || doc_id as path, string_split(text, chr(10)) as ls, lang as language from documents) on doc_id = record_id),
    cited as (select query_id, position, language, path, path || case when two = '' then '' when length(two) > 200 then ' | ' || left(two, 200) || '...' else ' | ' || two end as citation from c)"""


@query(f"with {HITS} select query_id, record_id, rank, round(case when len({QT}) = 0 then 0.0 else len(list_intersect(list_distinct({QT}), list_distinct({TOK.format('lower(d.text)')}))) / len(list_distinct({QT})) end, 6) as overlap from hits join documents d on d.doc_id = record_id join benchmark b on b.item_id = query_id")
def overlap_score(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), "text")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    j = d.join(small(hits(spark, sf_dir).join(b, "query_id"), "asked"), "record_id")
    return j.select("query_id", "record_id", F.col("rank").cast("bigint").alias("rank"), F.round(retrieval.overlap(F.col("question"), F.col("text")), 6).alias("overlap"))


@query(RERANK + " select query_id, record_id, overlap, position from r")
def rerank_overlap(spark, sf_dir):
    return answered(spark, sf_dir).select("query_id", "record_id", "overlap", F.col("position").cast("bigint").alias("position"))


@query(CITED + " select query_id, position, citation from cited")
def citations(spark, sf_dir):
    return answered(spark, sf_dir).select("query_id", F.col("position").cast("bigint").alias("position"), retrieval.citation(F.col("path"), F.col("snippet")).alias("citation"))


@query(CITED + " select query_id, position, case when language is null then '- file: ' || path else '- ' || language || ' file: ' || path end as line from cited")
def answer_lines(spark, sf_dir):
    return answered(spark, sf_dir).select("query_id", F.col("position").cast("bigint").alias("position"), retrieval.record_line(F.col("path"), F.col("language"), F.lit(None)).alias("line"))


@query(RERANK + " select query_id, string_agg('[' || path || ']' || chr(10) || content, chr(10) || chr(10) order by position) as block from r join (select doc_id, source || '/' || doc_id as path, coalesce(text, '') as content from documents) on doc_id = record_id group by query_id")
def context_block(spark, sf_dir):
    """The context of every question: path and whole content of each of its TOP documents."""
    item = F.concat(F.lit("["), "path", F.lit("]\n"), F.coalesce("snippet", F.lit("")))
    got = answered(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", item.alias("x")))).alias("xs"))
    return got.select("query_id", F.array_join(F.col("xs.x"), "\n\n").alias("block"))


@query("select conv_id, string_agg(role, '|' order by first, role) as roles from (select conv_id, role, min(turn) as first from conversations where role <> '' group by all) group by conv_id")
def citation_dedupe(spark, sf_dir):
    """Each role of a conversation once, where it first occurs; only these few reach one row."""
    g = table(spark, sf_dir, "conversations").where("role <> ''").groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    return g.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("first", "role"))).alias("r")).select("conv_id", F.array_join("r.role", "|").alias("roles"))


@query(CITED + " select query_id, position, string_split(citation, ' | ')[1] as file, case when len(string_split(citation, ' | ')) > 1 then 'cited' else '-' end as score from cited")
def context_entries(spark, sf_dir):
    parts = F.split(retrieval.citation(F.col("path"), F.col("snippet")), r" \| ")
    return answered(spark, sf_dir).select("query_id", F.col("position").cast("bigint").alias("position"), F.get(parts, 0).alias("file"), F.when(F.size(parts) > 1, "cited").otherwise("-").alias("score"))


@query("select conv_id, turn, role || '|' || 'doc ' || turn as cites, 2::bigint as n from conversations")
def parse_citations(spark, sf_dir):
    """Formats an answer with its citations as text and reads them back."""
    said = F.concat_ws("\n", F.concat(F.lit("Answer: "), F.replace("text", F.lit("\n"), F.lit(" "))), F.lit("Citations:"), F.concat(F.lit("- "), "role"), F.concat(F.lit("-  doc "), "turn"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.citations_in(said).alias("c"))
    return c.select("conv_id", "turn", F.array_join("c", "|").alias("cites"), F.size("c").cast("bigint").alias("n"))


RECORDS = f"""select path as record_id, path, language, content as snippet, null::bigint as s from ({FILES}) union all
    select w.path || ':' || w.s || '-' || w.s, w.path, null, w.x, w.s from ({WHOLE_LINES}) w"""
MIXED = f"""with rec as ({RECORDS}), qb as ({BUCKETS.format(id='item_id', t='benchmark')}),
    rb as (select record_id, bucket, sum(n) as tf from (select record_id, tok, ({BUCKET})::bigint as bucket, count(*) as n from (select record_id, unnest({TOK.format('snippet')}) as tok from rec) group by all) group by all),
    qn as (select item_id, sqrt(sum(tf * tf)::double) as n from qb group by 1), rn as (select record_id, sqrt(sum(tf * tf)::double) as n from rb group by 1),
    scored as (select item_id as query_id, record_id, round(d / (rn.n * qn.n), 6) as score from (select item_id, record_id, sum(qb.tf * rb.tf)::double as d from qb join rb using (bucket) group by all) join qn using (item_id) join rn using (record_id)),
    hits as (select *, row_number() over (partition by query_id order by score desc, record_id) as rank from scored qualify rank <= {FETCH}),
    o as (select h.query_id, h.rank, rec.*, round(case when len({QT}) = 0 then 0.0 else len(list_intersect(list_distinct({QT}), list_distinct({TOK.format('lower(rec.snippet)')}))) / len(list_distinct({QT})) end, 6) as overlap
        from hits h join rec using (record_id) join benchmark b on b.item_id = h.query_id),
    r as (select *, row_number() over (partition by query_id order by overlap desc, rank) as position from o qualify position <= {TOP}),
    c as (select *, {TWO} as two from (select *, string_split(snippet, chr(10)) as ls from r))"""


@query(MIXED + r""" select query_id, position, path || case when s is null then '' else ' (lines ' || s || '-' || s || ')' end || case when two = '' then '' when length(two) > 200 then ' | ' || left(two, 200) || '...' else ' | ' || two end as citation,
    case when s is not null then '- function: ' || path || ' :: ' || left(regexp_replace(snippet, '^\s+|\s+$', '', 'g'), 200) when coalesce(language, '') = '' then '- file: ' || path else '- ' || language || ' file: ' || path end as line from c""")
def answer_records(spark, sf_dir):
    """Answers from file and function records: citations with their lines, and a line for each record."""
    whole = files(spark, sf_dir).select(F.col("path").alias("record_id"), "path", "language", F.col("content").alias("snippet"), F.lit(None).cast("int").alias("s"))
    part = files(spark, sf_dir).select("path", F.posexplode(T.lines(F.col("content"))).alias("i", "snippet")).where("snippet <> ''").withColumn("s", F.col("i") + 1)
    records = whole.unionByName(part.select(F.concat("path", F.lit(":"), "s", F.lit("-"), "s").alias("record_id"), "path", F.lit(None).cast("string").alias("language"), "snippet", "s"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    store = vector_store.indexed(spark, sf_dir, "records", lambda: vector_store.hashed(records, "record_id", "snippet"))
    found = retrieval.in_blocks(counted(b, "question").select("query_id", "vector"), lambda q: vector_store.search(store, q, FETCH))
    top = retrieval.reranked(records.join(small(found.join(b, "query_id"), "asked"), "record_id"), TOP)
    return top.select("query_id", F.col("position").cast("bigint").alias("position"), retrieval.citation(F.col("path"), F.col("snippet"), F.col("s"), F.col("s")).alias("citation"), retrieval.record_line(F.col("path"), F.col("language"), F.when(F.col("s").isNotNull(), T.signature(F.col("snippet")))).alias("line"))


# ---- evaluation

TRUTH = "truth as (select item_id as query_id, min(doc_id) as expected from benchmark b join documents d on contains(d.text, b.text) group by 1)"
EVAL = f"with {HITS}, {TRUTH}, e as (select t.*, exists (select 1 from hits h where h.query_id = t.query_id and h.record_id = t.expected and rank <= {TOP}) as hit from truth t)"


def truth(spark, sf_dir):
    """Each question that some document quotes, and the first such document."""
    d = table(spark, sf_dir, "documents")
    return retrieval.in_blocks(table(spark, sf_dir, "benchmark").select("item_id", "text"), lambda q: retrieval.quoting(d, q)).withColumnRenamed("record_id", "expected")


def found(spark, sf_dir):
    return hits(spark, sf_dir, TOP).select("query_id", F.col("record_id").alias("expected"))


@query(EVAL + " select query_id, expected from e where hit")
def eval_hits(spark, sf_dir):
    return truth(spark, sf_dir).join(found(spark, sf_dir), ["query_id", "expected"], "left_semi")


@query(EVAL + " select query_id, expected from e where not hit")
def eval_misses(spark, sf_dir):
    return truth(spark, sf_dir).join(found(spark, sf_dir), ["query_id", "expected"], "left_anti")


@query(EVAL + " select count(*) as total, count_if(hit)::bigint as hits, coalesce(round(count_if(hit) / count(*), 6), 0.0) as accuracy from e")
def eval_accuracy(spark, sf_dir):
    f = found(spark, sf_dir).withColumn("hit", F.lit(1))
    e = truth(spark, sf_dir).join(f, ["query_id", "expected"], "left")
    return e.agg(F.count("*").alias("total"), F.count("hit").alias("hits")).select("total", "hits", F.coalesce(F.round(F.try_divide("hits", "total"), 6), F.lit(0.0)).alias("accuracy"))


# ---- graph


def page_edges(spark, sf_dir):
    return graph.edges(graph.links(table(spark, sf_dir, "pages")))


@query("select distinct page_id, target from (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) as target from pages)")
def extract_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(graph.HREF), F.lit(1)))).alias("target"))


@query(f"with e as ({EDGES}) select source as node from e union select target from e")
def graph_nodes(spark, sf_dir):
    return graph.nodes(page_edges(spark, sf_dir))


@query(EDGES)
def graph_edges(spark, sf_dir):
    return page_edges(spark, sf_dir)


DEGREES = f"with e as ({EDGES}), d as (select node, sum(o)::bigint as out_degree, sum(i)::bigint as in_degree from (select source as node, 1 as o, 0 as i from e union all select target, 0, 1 from e) group by node)"


@query(DEGREES + " select * from d")
def node_degrees(spark, sf_dir):
    return graph.degrees(page_edges(spark, sf_dir))


@query(DEGREES + " select node, in_degree from d order by in_degree desc, node limit 5")
def top_modules(spark, sf_dir):
    return graph.degrees(page_edges(spark, sf_dir)).select("node", "in_degree").orderBy(F.desc("in_degree"), "node").limit(5)


@query(f"select distinct source as neighbour from ({EDGES}) where target = '/the'")
def neighbors_inbound(spark, sf_dir):
    return graph.neighbours(page_edges(spark, sf_dir), "/the")


FIRST_URL = "(select min(url) from pages)"


@query(f"select distinct target as neighbour from ({EDGES}) where source = {FIRST_URL}")
def neighbors_outbound(spark, sf_dir):
    first = table(spark, sf_dir, "pages").agg(F.min("url")).first()[0]
    return graph.neighbours(page_edges(spark, sf_dir), first, "outbound")


#: The layers and their words, written out for SQL.
LAYER_SQL = """case
    when regexp_matches(lower({0}), 'main|app\\.py|index|manage|wsgi|asgi|__main__') then 'entry'
    when regexp_matches(lower({0}), 'controller|route|router|endpoint|api|views') then 'api'
    when regexp_matches(lower({0}), 'middleware|auth|security|permission|guard') then 'middleware'
    when regexp_matches(lower({0}), 'service|services|agent|orchestrat|pipeline|trainer|engine') then 'services'
    when regexp_matches(lower({0}), 'model|schema|entity|dataclass|type') then 'models'
    when regexp_matches(lower({0}), 'database|db|store|repository|retriev|faiss|embed|index') then 'data'
    when regexp_matches(lower({0}), 'config|setting|env|constant') then 'config'
    when regexp_matches(lower({0}), 'util|helper|common|lib|tool|logger|metric|observ') then 'utils'
    when regexp_matches(lower({0}), 'frontend|component|page|layout|ui|view|template|dashboard') then 'frontend'
    when regexp_matches(lower({0}), 'test|spec|fixture|conftest|mock') then 'tests'
    else 'utils' end"""


def sql_layer(c: str) -> str:
    return LAYER_SQL.format(c)


@query(f"select doc_id, path, {sql_layer('path')} as layer from ({PATHS})")
def layer_classify(spark, sf_dir):
    return paths(spark, sf_dir).select("doc_id", "path", T.layer(F.col("path")).alias("layer"))


@query(f"select layer, path, count(*) over (partition by layer) as files from (select distinct {sql_layer('path')} as layer, path from ({PATHS}))")
def layer_files(spark, sf_dir):
    """The files of each layer, a row each, and how many the layer has; there are few layers, so counts are broadcast."""
    p = paths(spark, sf_dir).select(T.layer(F.col("path")).alias("layer"), "path").distinct()
    return p.join(F.broadcast(p.groupBy("layer").agg(F.count("*").alias("files"))), "layer").select("layer", "path", "files")


LAYERED = f"select source, target, {sql_layer('source')} as sl, {sql_layer('target')} as tl from ({EDGES})"


@query(f"select sl as source_layer, tl as target_layer, count(*) as n from ({LAYERED}) where sl <> tl group by all")
def layer_edges(spark, sf_dir):
    return graph.layered(page_edges(spark, sf_dir)).where("source_layer <> target_layer").groupBy("source_layer", "target_layer").agg(F.count("*").alias("n"))


@query(f"select layer, string_agg(distinct o, '|' order by o) as outgoing, string_agg(distinct i, '|' order by i) as incoming from (select sl as layer, tl as o, null as i from ({LAYERED}) where sl <> tl union all select tl, null, sl from ({LAYERED}) where sl <> tl) group by layer")
def layer_in_out(spark, sf_dir):
    pairs = graph.layered(page_edges(spark, sf_dir)).where("source_layer <> target_layer").select("source_layer", "target_layer").distinct()
    ends = pairs.select(F.col("source_layer").alias("layer"), F.col("target_layer").alias("o"), F.lit(None).cast("string").alias("i")).union(pairs.select("target_layer", F.lit(None).cast("string"), "source_layer"))
    join = lambda c: F.nullif(F.array_join(F.array_sort(F.collect_set(c)), "|"), F.lit(""))
    return ends.groupBy("layer").agg(join("o").alias("outgoing"), join("i").alias("incoming"))


@query(f"select distinct sl as source_layer, tl as target_layer, list_last(string_split(source, '/')) as a, list_last(string_split(target, '/')) as b from ({LAYERED}) where sl <> tl")
def layer_connections(spark, sf_dir):
    base = lambda c: F.substring_index(c, "/", -1)
    return graph.layered(page_edges(spark, sf_dir)).where("source_layer <> target_layer").select("source_layer", "target_layer", base("source").alias("a"), base("target").alias("b")).distinct()


@query(f"select distinct array_to_string(p[1:i], '/') as path, array_to_string(p[1:i - 1], '/') as parent, p[i] as name, case when i = len(p) then 'file' else 'folder' end as kind, i - 1 as depth from (select string_split(path, '/') as p from ({PATHS})), unnest(range(1, len(p) + 1)) t(i)")
def path_tree(spark, sf_dir):
    return graph.path_tree(paths(spark, sf_dir)).orderBy(F.col("kind") == "file", "name")


# ---- aggregates


@query(f"select repo_id, language, count(*) as n from ({FILES}) group by all")
def language_counts(spark, sf_dir):
    return files(spark, sf_dir).groupBy("repo_id", "language").agg(F.count("*").alias("n"))


FUNCTIONS = f"select repo_id, sum(len(list_filter(ls, lambda x: x <> '')))::bigint as function_count from ({LINES}) where content is not null group by repo_id"
PAGE_REPO = f"select distinct 'src' || (page_id % {EVERY}) as repo_id, url as source, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) as target from pages"
OVERVIEW = f"""select c.repo_id, c.name, coalesce(file_count, 0) as file_count, coalesce(function_count, 0) as function_count, coalesce(dependency_edges, 0) as dependency_edges, languages
    from ({NAMED}) c left join (select repo_id, sum(n)::bigint as file_count, string_agg(language || ':' || n, '|' order by language) as languages from (select repo_id, language, count(*) as n from ({FILES}) group by all) group by repo_id) using (repo_id)
    left join ({FUNCTIONS}) using (repo_id) left join (select repo_id, count(*) as dependency_edges from ({PAGE_REPO}) group by 1) using (repo_id)"""


@query(FUNCTIONS)
def repo_functions(spark, sf_dir):
    """Lines that aren't empty, which stand for functions, of every repository."""
    n = F.size(F.filter(T.lines(F.col("content")), lambda x: x != ""))
    return files(spark, sf_dir).where("content is not null").groupBy("repo_id").agg(F.sum(n).cast("bigint").alias("function_count"))


@query(f"select repo_id, source, target from ({PAGE_REPO})")
def repo_edges(spark, sf_dir):
    """The edges of every repository; each page belongs to one of EVERY repositories, by its id."""
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("src"), F.col("page_id") % EVERY).alias("repo_id"), "url", "html")
    return p.select("repo_id", F.col("url").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(graph.HREF), F.lit(1)))).alias("target")).distinct()


def overview(spark, sf_dir):
    """The catalogue with the counts of every repository; they are added up before they are joined."""
    by = language_counts(spark, sf_dir)
    counted = by.groupBy("repo_id").agg(F.sum("n").alias("file_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("language", "n"))), lambda x: F.concat(x["language"], F.lit(":"), x["n"])), "|").alias("languages"))
    edges = repo_edges(spark, sf_dir).groupBy("repo_id").agg(F.count("*").alias("dependency_edges"))
    got = list_repos(spark, sf_dir).join(counted, "repo_id", "left").join(repo_functions(spark, sf_dir), "repo_id", "left").join(edges, "repo_id", "left")
    return got.select("repo_id", "name", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("file_count", "function_count", "dependency_edges")], "languages")


@query(OVERVIEW + " where c.repo_id = 'src1'")
def repo_overview(spark, sf_dir):
    """The counts of one repository; no row where there is none of this id."""
    return overview(spark, sf_dir).where("repo_id = 'src1'")


@query(OVERVIEW)
def repo_stats(spark, sf_dir):
    return overview(spark, sf_dir)


@query(f"select count(*) as total_queries, coalesce(round(avg(latency_ms), 1), 0.0) as avg_latency_ms, coalesce(round(avg(citations), 1), 0.0) as avg_citations from ({LOG})")
def session_stats(spark, sf_dir):
    return stats.session(query_log(spark, sf_dir))


@query(f"select agent, latency_ms as p95_ms, n from (select agent, latency_ms, row_number() over (partition by agent order by latency_ms) as i, count(*) over (partition by agent) as n from ({LOG})) where i = least(floor(n * 0.95), n - 1) + 1")
def latency_p95(spark, sf_dir):
    return stats.p95(query_log(spark, sf_dir), "agent")


USAGE = f"select agent, count(*) as invocations, round(sum(share) / count(*), 1) as avg_ms from (select unnest([agent, 'mentor']) as agent, latency_ms / 2 as share from ({LOG})) group by agent"


@query(USAGE)
def agent_usage(spark, sf_dir):
    return stats.agent_usage(query_log(spark, sf_dir))


@query(f"select agent, invocations, round(greatest(invocations / max(invocations) over () * 100, 2.0), 6) as pct from ({USAGE})")
def agent_bar_pct(spark, sf_dir):
    u = stats.agent_usage(query_log(spark, sf_dir)).select("agent", "invocations")
    most = u.agg(F.max("invocations").alias("m"))
    return u.join(F.broadcast(most)).select("agent", "invocations", F.round(F.greatest(F.col("invocations") / F.col("m") * 100, F.lit(2.0)), 6).alias("pct"))


@query(f"select case when latency_ms * 50 < 2000 then 'green' when latency_ms * 50 < 5000 then 'yellow' else 'red' end as band, count(*) as n from ({LOG}) group by 1")
def latency_bands(spark, sf_dir):
    return query_log(spark, sf_dir).groupBy(T.latency_band(F.col("latency_ms") * 50).alias("band")).agg(F.count("*").alias("n"))


@query(f"select event_id, ts, left(agent, 120) as question, latency_ms from ({LOG}) order by ts desc, event_id desc limit 20")
def recent_queries(spark, sf_dir):
    return stats.latest(query_log(spark, sf_dir), 20, "ts", "event_id").select("event_id", "ts", F.substring("agent", 1, 120).alias("question"), "latency_ms")


@query(f"select repo_id, event_id, i from (select repo_id, event_id, row_number() over (partition by repo_id order by ts desc, event_id desc) as i from ({LOG})) where i <= 50")
def query_history(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("repo_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return query_log(spark, sf_dir).withColumn("i", F.row_number().over(w)).where("i <= 50").select("repo_id", "event_id", F.col("i").cast("bigint").alias("i"))


@query(f"select agent as method, repo_id as path, case when agent = 'error' then 500 else 200 end as status, count(*) as n from ({LOG}) group by all")
def request_counter(spark, sf_dir):
    return query_log(spark, sf_dir).groupBy(F.col("agent").alias("method"), F.col("repo_id").alias("path"), F.when(F.col("agent") == "error", 500).otherwise(200).alias("status")).agg(F.count("*").alias("n"))


@query(f"select agent, le, count_if(latency_ms / 100 <= bound)::bigint as count from ({LOG}), (select unnest(['0.005', '0.01', '0.025', '0.05', '0.075', '0.1', '0.25', '0.5', '0.75', '1.0', '2.5', '5.0', '7.5', '10.0', '+Inf']) as le, unnest([0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0, 'inf'::double]::double[]) as bound) group by all")
def request_latency_histogram(spark, sf_dir):
    return stats.histogram(query_log(spark, sf_dir).withColumn("seconds", F.col("latency_ms") / 100), "agent", "seconds")


# ---- scalars and control

URLS = "select page_id, ' ' || url || case page_id % 3 when 0 then '/' when 1 then '/tree/main/x' else '.git' end || ' ' as u from pages"


def urls(spark, sf_dir):
    k = F.col("page_id") % 3
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit(" "), "url", F.when(k == 0, "/").when(k == 1, "/tree/main/x").otherwise(".git"), F.lit(" ")).alias("u"))


@query(rf"select page_id, regexp_replace(regexp_replace(regexp_replace(u, '^\s+|\s+$', '', 'g'), '/+$', ''), '/(tree|blob)/[^/]+(/.*)?$', '') as url from ({URLS})")
def normalize_url(spark, sf_dir):
    return urls(spark, sf_dir).select("page_id", T.normalized_url(F.col("u")).alias("url"))


@query(f"select page_id, list_last(string_split(rtrim(rtrim(trim(u), '/'), '.git'), '/')) as name from ({URLS})")
def repo_name(spark, sf_dir):
    return urls(spark, sf_dir).select("page_id", T.repo_name(F.trim("u")).alias("name"))


RAW = f"select doc_id, case doc_id % 3 when 0 then path when 1 then '/srv/{FOLDER}/repos/0a1b/' || path else 'C:\\{FOLDER}\\repos\\0a1b\\' || replace(path, '/', '\\') end as raw from ({PATHS})"


def raw_paths(spark, sf_dir):
    k = F.col("doc_id") % 3
    back = F.concat(F.lit(f"C:\\{FOLDER}\\repos\\0a1b\\"), F.replace("path", F.lit("/"), F.lit("\\")))
    return paths(spark, sf_dir).select("doc_id", F.when(k == 0, F.col("path")).when(k == 1, F.concat(F.lit(f"/srv/{FOLDER}/repos/0a1b/"), "path")).otherwise(back).alias("raw"))


@query(f"select doc_id, path from ({PATHS})")
def clean_display_path(spark, sf_dir):
    return raw_paths(spark, sf_dir).select("doc_id", T.display_path(F.col("raw"), r"\.engine").alias("path"))


@query(f"select doc_id, path from ({PATHS})")
def clean_graph_path(spark, sf_dir):
    return raw_paths(spark, sf_dir).select("doc_id", T.graph_path(F.col("raw"), r"\.engine").alias("path"))


@query(f"select doc_id, path, case when doc_id % 2 = 0 then doc_id end as first, case when doc_id % 2 = 0 then doc_id + 3 end as last from ({PATHS})")
def parse_node_id(spark, sf_dir):
    node = F.when(F.col("doc_id") % 2 == 0, F.concat("path", F.lit(":"), "doc_id", F.lit("-"), F.col("doc_id") + 3)).otherwise(F.col("path"))
    p = paths(spark, sf_dir).select("doc_id", node.alias("node"))
    return p.select("doc_id", T.node_path(F.col("node")).alias("path"), T.node_line(F.col("node"), 1).alias("first"), T.node_line(F.col("node"), 2).alias("last"))


@query("select conv_id, turn, i as step, case turn % 3 when 0 then 'retrieval' else case i when 0 then 'retrieval' else 'mentor' end end as agent, case i when 0 then text else role end as instruction from conversations, unnest([0, 1]) t(i) where turn % 3 <> 0 or i = 0")
def plan_steps(spark, sf_dir):
    """Plans as JSON, fenced or not; what isn't JSON becomes one retrieval step."""
    from corvane.plans.steps import plan_of

    k = F.col("turn") % 3
    step = lambda agent, words: F.struct(F.lit(agent).alias("agent"), F.col(words).alias("instruction"))
    body = F.to_json(F.struct(F.array(step("retrieval", "text"), step("mentor", "role")).alias("steps")))
    said = F.when(k == 0, "no plan").when(k == 1, body).otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    steps = plan_of(said, F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(steps).alias("step", "s")).select("conv_id", "turn", F.col("step").cast("bigint").alias("step"), "s.agent", "s.instruction")


@query("select conv_id, turn, case when contains(lower(text), 'explain') or contains(lower(text), 'overview') then 'analyst' else 'retrieval' end as agent from conversations")
def intent_routing(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.intent(F.col("text")).alias("agent"))


@query("""select item_id, case
    when contains(lower(text), 'explain') then 'explain'
    when contains(lower(text), 'repository') then 'repository'
    when contains(lower(text), 'structure') then 'structure'
    when contains(lower(text), 'entry') then 'entry'
    when contains(lower(text), 'import') then 'import'
    when contains(lower(text), 'dependency') then 'dependency'
    when contains(lower(text), 'palindrome') then 'palindrome'
    when contains(lower(text), 'decorator') then 'decorator'
    when contains(lower(text), 'big-o') then 'big-o'
    when contains(lower(text), 'api') then 'api'
    when contains(lower(text), 'sql') then 'sql'
    when contains(lower(text), 'async') then 'async'
    when contains(lower(text), 'sort') then 'sort'
    when contains(lower(text), 'auth') then 'auth'
    when contains(lower(text), 'pattern') then 'pattern'
    when contains(lower(text), 'test') then 'test'
    when contains(lower(text), 'error') then 'error'
    when contains(lower(text), 'function') then 'function'
    when contains(lower(text), 'refactor') then 'refactor'
    when contains(lower(text), 'class') then 'class'
    when contains(lower(text), 'database') then 'database'
    when contains(lower(text), 'config') then 'config'
    when contains(lower(text), 'pipeline') then 'pipeline'
    when contains(lower(text), 'model') then 'model'
    else 'fallback' end as topic from benchmark""")
def followup_topic(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.followup(F.col("text")).alias("topic"))


@query(r"select conv_id, turn, case turn % 3 when 0 then 'save' when 1 then 'list' else 'help' end as action, case when turn % 3 = 0 then regexp_replace(text, '^\s+|\s+$', '', 'g') end as content from conversations")
def memory_commands(spark, sf_dir):
    k = F.col("turn") % 3
    said = F.when(k == 0, F.concat(F.lit("save: "), "text")).when(k == 1, " list ").otherwise("what?")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.memory_action(said).alias("action"), T.memory_content(said).alias("content"))


@query("select conv_id as scope, turn, '[' || turn || '] ' || text as line from conversations where conv_id = 1")
def memory_by_scope(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("conv_id = 1").select(F.col("conv_id").alias("scope"), "turn", F.concat(F.lit("["), "turn", F.lit("] "), "text").alias("line"))


@query("select event_id, 'repo:' || user_id as scope, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || case when extract('microseconds' from ts) % 1000000 = 0 then '' else strftime(ts, '.%f') end || '] ' || event_type as line from events")
def memory_lines(spark, sf_dir):
    """Lines of entries with a time, each in the scope of its user."""
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("repo:"), "user_id").alias("scope"), T.memory_line(F.col("ts"), F.col("event_type")).alias("line"))


@query(r"""select conv_id, turn, case when turn % 4 = 0 then turn when turn % 4 = 1 then -turn end as number, case when turn % 2 = 0 then role else '' end as language,
    left(role, 3) as bytes, case when turn % 5 > 3 then 'p0, p1, p2 +' || (turn % 5 - 3) || ' more' else array_to_string(list_transform(range(turn % 5), lambda i: 'p' || i), ', ') end as listed,
    turn % 2 = 0 or turn % 3 <> 0 as offered, role as label from conversations""")
def small_functions(spark, sf_dir):
    """Safe whole numbers, the language of a code block, byte ranges, shortened lists, offers and labels."""
    k = F.col("turn")
    said = F.when(k % 4 == 0, F.concat(F.lit(" "), k)).when(k % 4 == 1, F.concat(F.lit("-"), k)).when(k % 4 == 2, "").otherwise(F.concat(k, F.lit(" lines")))
    items = F.transform(F.slice(F.array(*[F.lit(i) for i in range(5)]), F.lit(1), (k % 5).cast("int")), lambda i: F.concat(F.lit("p"), i))
    css = F.when(k % 2 == 0, F.concat(F.lit("hljs language-"), "role", F.lit(" wide"))).otherwise("plain")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", T.safe_int(said).alias("number"), T.code_language(css).alias("language"), T.byte_slice(F.concat(F.lit("é"), "role"), F.lit(2), F.lit(5)).alias("bytes"),
        T.more(items, 3).alias("listed"), T.offered(k % 2 == 0, k % 3 == 0).alias("offered"), T.last_part(F.concat(F.lit("https://example.org/a/"), "role", F.lit("//"))).alias("label"),
    )
