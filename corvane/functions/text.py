"""Scalar text, path and protocol functions as Column expressions (all inside whole-stage plans, no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[A-Za-z_][A-Za-z0-9_]+"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"

# File suffixes and the languages they stand for, in the scan and in the file view.
SCAN_LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".java": "java", ".go": "go", ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".rb": "ruby", ".cs": "c_sharp", ".php": "php", ".kt": "kotlin", ".swift": "swift", ".scala": "scala"}
VIEW_LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "rb": "ruby", "cs": "csharp", "php": "php", "kt": "kotlin", "swift": "swift", "json": "json", "yaml": "yaml", "yml": "yaml", "md": "markdown", "txt": "text", "toml": "toml", "cfg": "ini", "ini": "ini", "sh": "bash", "bat": "batch"}
# Architecture layers in the order they are tried, and the words that mark them.
LAYERS = {
    "entry": ["main", "app.py", "index", "manage", "wsgi", "asgi", "__main__"],
    "api": ["controller", "route", "router", "endpoint", "api", "views"],
    "middleware": ["middleware", "auth", "security", "permission", "guard"],
    "services": ["service", "services", "agent", "orchestrat", "pipeline", "trainer", "engine"],
    "models": ["model", "schema", "entity", "dataclass", "type"],
    "data": ["database", "db", "store", "repository", "retriev", "faiss", "embed", "index"],
    "config": ["config", "setting", "env", "constant"],
    "utils": ["util", "helper", "common", "lib", "tool", "logger", "metric", "observ"],
    "frontend": ["frontend", "component", "page", "layout", "ui", "view", "template", "dashboard"],
    "tests": ["test", "spec", "fixture", "conftest", "mock"],
}
# Words of a question that choose a follow-up, in the order they are tried.
FOLLOWUPS = ["explain", "repository", "structure", "entry", "import", "dependency", "palindrome", "decorator", "big-o", "api", "sql", "async", "sort", "auth", "pattern", "test", "error", "function", "refactor", "class", "database", "config", "pipeline", "model"]
IGNORED_PARTS = ["__pycache__", ".git", ".pytest_cache", ".venv", "node_modules"]


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def strip(c: Column) -> Column:
    """All white space off both ends (SQL's trim removes blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({TOKEN})"), F.lit(1))


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(F.lower(c)))


def lines(c: Column) -> Column:
    """Lines at every line boundary; a last empty one isn't a line."""
    parts = F.split(c, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_range(c: Column, start: Column, end: Column) -> Column:
    """Lines start to end, counted from 1, both included; empty where there are none."""
    first = F.greatest(start, F.lit(1))
    return F.array_join(F.slice(lines(c), first, F.greatest(end - first + 1, F.lit(0))), "\n")


def signature(c: Column, most: int = 200) -> Column:
    """The first line of a definition, trimmed and shortened."""
    return F.substring(strip(F.get(F.split(c, LINE_BREAK, -1), 0)), 1, most)


def suffix(path: Column) -> Column:
    """The last dot and what follows it in the file name; none for names that begin with their only dot."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def scan_language(path: Column) -> Column:
    return lookup(SCAN_LANGUAGES, suffix(path))


def view_language(path: Column) -> Column:
    """The language of the file name's suffix, letter case kept; an unknown suffix names itself, none the empty string."""
    ext = F.ltrim(suffix(path), F.lit("."))
    return F.coalesce(lookup(VIEW_LANGUAGES, ext), ext)


def import_grammar(path: Column) -> Column:
    s = suffix(path)
    return F.when(s == ".py", "python").when(s.isin(".js", ".jsx", ".ts", ".tsx"), "javascript")


def visible(path: Column) -> Column:
    """Whether no part of the path is an ignored folder."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in IGNORED_PARTS]))


def relative_path(path: Column, root: Column) -> Column:
    """The path below an absolute root, else the file name; with no such root what follows `repos` and an id, else the name.

    The root itself is `.`; an empty result is null, for a path that ends with the id.
    """
    name, parts = F.substring_index(path, "/", -1), F.split(path, "/")
    below = F.when(path == root, ".").when(F.startswith(path, F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))), F.substring(path, F.length(F.rtrim(root, F.lit("/"))) + 2, F.length(path))).otherwise(name)
    at = F.array_position(parts, "repos")
    after = F.array_join(F.slice(parts, at.cast("int") + 2, F.size(parts)), "/")
    return F.nullif(F.when(F.coalesce(F.startswith(root, F.lit("/")), F.lit(False)), below).when(at > 0, after).otherwise(name), F.lit(""))


def display_path(path: Column, folder: str) -> Column:
    """What follows `<folder>/repos/<id>/`, with slashes made forward; other paths stay."""
    pattern = rf"^.*?{folder}[/\\]repos[/\\][^/\\]+[/\\](.+)$"
    return F.when(path.rlike(pattern), F.replace(F.regexp_extract(path, pattern, 1), F.lit("\\"), F.lit("/"))).otherwise(path)


def graph_path(path: Column, folder: str) -> Column:
    """As display_path, with slashes made forward in any case."""
    return F.replace(display_path(path, folder), F.lit("\\"), F.lit("/"))


def normalized_url(url: Column) -> Column:
    """Trimmed, no slash at the end, no /tree/... or /blob/... part."""
    return F.regexp_replace(F.regexp_replace(strip(url), "/+$", ""), "/(tree|blob)/[^/]+(/.*)?$", "")


def repo_name(url: Column) -> Column:
    """The last part of the address; trailing characters out of `.git` go, one by one, as a set."""
    return F.element_at(F.split(F.regexp_replace(F.regexp_replace(url, "/+$", ""), "[.git]+$", ""), "/"), -1)


def node_path(node: Column) -> Column:
    return F.when(node.rlike(r"^.*?:\d+-\d+$"), F.regexp_extract(node, r"^(.*?):(\d+)-(\d+)$", 1)).otherwise(node)


def node_line(node: Column, which: int) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(node, r"^(.*?):(\d+)-(\d+)$", which + 1), F.lit("")), F.lit("9999999999")).cast("bigint")


def layer(path: Column) -> Column:
    """The first layer that has a word inside a part of the lower-cased path."""
    low, out = F.lower(path), None
    for k, words in LAYERS.items():
        hit = low.rlike("|".join(w.replace(".", r"\.") for w in words))
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return out.otherwise("utils")


def followup(question: Column) -> Column:
    out, low = None, F.lower(question)
    for k in FOLLOWUPS:
        out = (F.when if out is None else out.when)(F.contains(low, F.lit(k)), k)
    return out.otherwise("fallback")


def intent(question: Column) -> Column:
    low = F.lower(question)
    return F.when(F.contains(low, F.lit("explain")) | F.contains(low, F.lit("overview")), "analyst").otherwise("retrieval")


def chunks(c: Column, words: int = 4) -> Column:
    """Groups of words as they are streamed; each but the last ends in a blank."""
    parts = F.split(c, " ", -1)
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(0), n - 1, F.lit(words)), lambda i: F.concat(F.array_join(F.slice(parts, i + 1, F.lit(words)), " "), F.when(i + words < n, " ").otherwise("")))


def memory_action(c: Column) -> Column:
    text = strip(c)
    return F.when(F.startswith(F.lower(text), F.lit("save:")), "save").when(F.lower(text) == "list", "list").otherwise("help")


def memory_content(c: Column) -> Column:
    return F.when(memory_action(c) == "save", strip(F.substring(strip(c), F.lit(6), F.length(c))))


def unquoted(c: Column) -> Column:
    """Without one matching pair of quotes."""
    return F.regexp_replace(c, r"""^(['"])(.*)\1$""", "$2")


def unfenced(c: Column) -> Column:
    """Without a Markdown code fence."""
    t = strip(c)
    return F.when(F.startswith(t, F.lit("```json")), F.substring(t, F.lit(8), F.length(t) - 10)).when(F.startswith(t, F.lit("```")), F.substring(t, F.lit(4), F.length(t) - 6)).otherwise(t)


def citations_in(answer: Column) -> Column:
    """Lines that begin with `- ` after the first `Citations:`."""
    rest = F.when(F.contains(answer, F.lit("Citations:")), F.substring(answer, F.instr(answer, "Citations:") + 10, F.length(answer))).otherwise("")
    return F.transform(F.filter(F.transform(F.split(rest, "\n"), strip), lambda x: F.startswith(x, F.lit("- "))), lambda x: strip(F.substring(x, F.lit(3), F.length(x))))


def latency_band(ms: Column) -> Column:
    return F.when(ms < 2000, "green").when(ms < 5000, "yellow").otherwise("red")


def sse(event: Column) -> Column:
    return F.concat(F.lit("data: "), F.to_json(event), F.lit("\n\n"))


def repo_label(name: Column, remote: Column, repo_id: Column) -> Column:
    """The stored name; else the last part of the remote address, without its `.git`; else the id's first 8 characters."""
    last = F.regexp_replace(F.substring_index(F.regexp_replace(remote, "/+$", ""), "/", -1), r"\.git$", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(last, F.lit("")), F.substring(repo_id, 1, 8))


def last_part(url: Column) -> Column:
    """What follows the last slash, slashes at the end aside."""
    return F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1)


def memory_line(at: Column, content: Column) -> Column:
    """`[time] content`; a fraction of a second has six digits, or isn't there if it is 0."""
    micros = F.date_format(at, "SSSSSS")
    fraction = F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise("")
    return F.concat(F.lit("["), F.date_format(at, "yyyy-MM-dd HH:mm:ss"), fraction, F.lit("] "), content)


def snippet(c: Column, start: Column, end: Column) -> Column:
    """Lines start to end of a file; its first 200 where either is missing; empty for a null file."""
    head = F.array_join(F.slice(lines(c), 1, 200), "\n")
    return F.coalesce(F.when(start.isNull() | end.isNull(), head).otherwise(line_range(c, start, end)), F.lit(""))


def snippet_summary(path: Column, start: Column, end: Column, part: Column) -> Column:
    """One sentence on where a snippet is from and how many lines it has."""
    span = F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lit(" (lines "), start, F.lit("-"), end, F.lit(")"))).otherwise("")
    return F.concat(F.lit("Snippet from "), path, span, F.lit(", "), F.size(lines(part)), F.lit(" lines."))


def byte_slice(source: Column, start: Column, end: Column) -> Column:
    """Bytes start to end (from 0, end not included) of a text's UTF-8; broken characters are replaced."""
    raw = F.substring(source.cast("binary"), start + 1, F.greatest(end - start, F.lit(0)))
    return F.make_valid_utf8(raw.cast("string"))


def safe_int(c: Column) -> Column:
    """A whole number, spaces around it allowed; null for anything else."""
    t = strip(c)
    return F.when(t.rlike(r"^[+-]?\d+(_\d+)*$"), F.replace(t, F.lit("_"), F.lit("")).try_cast("bigint"))


def code_language(css_class: Column) -> Column:
    """The language that a code block's class names; empty if it names none."""
    return F.regexp_extract(css_class, r"language-(\w+)", 1)


def more(items: Column, shown: int) -> Column:
    """The first `shown` items, comma-joined, and how many more there are."""
    rest = F.size(items) - shown
    return F.concat(F.array_join(F.slice(items, 1, shown), ", "), F.when(rest > 0, F.concat(F.lit(" +"), rest, F.lit(" more"))).otherwise(""))


def offered(has_repo: Column, repo_only: Column) -> Column:
    """Whether a capability is shown: those for repositories need one."""
    return has_repo | ~repo_only
