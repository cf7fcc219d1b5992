"""Tokens of a source file, in one pass: comments go, strings are single tokens, brackets know their partners.

A language is a list of rules for comments and strings; code inside a string's holes (`${...}` and the like) is scanned as
code. States are a stack, so holes nest. Every character is read a bounded number of times: what isn't closed runs to its
line's or the file's end.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Quote:
    """A kind of string: what opens it, what ends a stretch of it (closing or opening a hole), the hole's openers."""

    opens: str
    closes: str
    hole: str = ""
    lines: bool = False
    escape: bool = True


@dataclass(frozen=True)
class Language:
    quotes: tuple[Quote, ...]
    line: str = "//"
    block: tuple[str, str] | None = ("/*", "*/")
    nested: bool = False
    name: str = r"[^\W\d]\w*"
    slash: bool = False  # /.../ may be a pattern
    raw: str = ""  # strings whose end repeats what opened them, and other whole tokens: (pattern)
    skip: str = ""  # what is no code beside comments


PLAIN, CHAR = Quote('"', '"'), Quote("'", "'")
TRIPLE = Quote('"""', '"""', lines=True)
LANGUAGES = {
    "javascript": Language((PLAIN, CHAR, Quote("`", "`", "${", True)), name=r"[#@]?[^\W\d][\w$]*|[#@]?\$[\w$]*", slash=True, skip=r"\A#!.*"),
    "java": Language((TRIPLE, PLAIN, CHAR)),
    "c_sharp": Language((TRIPLE, Quote('$@"', '"', "{", True, False), Quote('@$"', '"', "{", True, False), Quote('@"', '"', "", True, False), Quote('$"', '"', "{"), PLAIN, CHAR), name=r"@?[^\W\d]\w*", skip=r"^[ \t]*#.*"),
    "go": Language((Quote("`", "`", "", True, False), PLAIN, CHAR)),
    "rust": Language((Quote('b"', '"', "", True), Quote('"', '"', "", True)), nested=True, raw=r"""b?r(\#*)"(?s:.*?)(?:"\1|\Z)|b?'(?:\\(?:u\{[^}]*\}|.)[^'\n]{0,3}|[^'\\\n])'|'[^\W\d]\w*(?!')"""),
    "c": Language((PLAIN, CHAR), skip=r"^[ \t]*\#(?:[^\\\n]|\\[\s\S]?)*", raw=r"""(?:u8|[uUL])?R"(\w*)\((?s:.*?)(?:\)\1"|\Z)"""),
    "ruby": Language((Quote('"', '"', "#{", True), Quote("'", "'", "", True), Quote("`", "`", "#{", True)), line="#", block=None, name=r"(?:[@$]{0,2}[^\W\d]\w*[?!]?(?:(?<![?!]):(?!:))?)|:[^\W\d]\w*[?!=]?", slash=True, skip=r"^=begin\b(?s:.*?)(?:^=end\b.*|\Z)|^__END__(?s:.*)"),
    "php": Language((Quote('"', '"', "{$", True), Quote("'", "'", "", True)), name=r"\$?[^\W\d]\w*", raw=r"""<<<[ \t]*(["']?)(\w+)\1(?s:.*?)(?:^[ \t]*\2\b|\Z)""", skip=r"\A(?s:.*?)(?:<\?(?:php\b|=)|\Z)|\?>(?s:.*?)(?:<\?(?:php\b|=)|\Z)|(?:\#(?!\[)).*"),
    "kotlin": Language((Quote('"""', '"""', "${", True, False), Quote('"', '"', "${"), CHAR), nested=True, name=r"@?[^\W\d]\w*|`[^`\n]*`"),
    "swift": Language((Quote('"""', '"""', "\\(", True), Quote('"', '"', "\\(")), nested=True, name=r"[@#]?[^\W\d]\w*|`[^`\n]*`", raw=r"""(\#+)"(?s:.*?)(?:"\1|\Z)"""),
    "scala": Language((Quote('"""', '"""', "${", True, False), Quote('"', '"', "${")), nested=True, raw=r"'(?:\\.|[^'\\\n])'"),
    "python": Language((Quote('"""', '"""', "", True), Quote("'''", "'''", "", True), PLAIN, CHAR), line="#", block=None),
}
CLOSERS, PARTNER = {")": "(", "]": "[", "}": "{"}, {"(": ")", "[": "]", "{": "}"}
PUNCTUATION = r"=>|->|::|\?\.|\?\?|\.\.\.|&&|\|\||[=!]==?|<=|[^\w\s]"
BEFORE_PATTERN = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "and", "or", "not", "if", "unless", "while", "until", "when", "yield"}


@dataclass
class Tokens:
    """kind: n for names, s for strings, d for numbers, p for others. partner: of a bracket, the place of the other one."""

    source: str
    kind: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    partner: list[int] = field(default_factory=list)
    breaks: list[int] = field(default_factory=list)

    def line(self, offset: int) -> int:
        return bisect_right(self.breaks, offset) + 1

    def at(self, i: int) -> str:
        """The text of token i; empty outside and for strings, so that no string is taken for code."""
        return self.text[i] if 0 <= i < len(self.text) and self.kind[i] != "s" else ""

    def named(self, i: int) -> bool:
        return 0 <= i < len(self.kind) and self.kind[i] == "n"

    def fresh(self, i: int) -> bool:
        """Whether token i is the first of its line."""
        return i <= 0 or self.line(self.start[i]) > self.line(self.end[i - 1] - 1)


def tokens(source: str, language: str) -> Tokens:
    rules = LANGUAGES[language]
    out = Tokens(source, breaks=[m.start() + 1 for m in re.finditer("\n", source)])
    quotes = [(q, re.compile(_stretch(q))) for q in rules.quotes]
    parts = [f"(?P<skip>{rules.skip})"] if rules.skip else []
    parts.append(f"(?P<comment>{re.escape(rules.line)}.*)")
    if rules.block:
        parts.append(f"(?P<block>{re.escape(rules.block[0])})")
    if rules.raw:
        parts.append(f"(?P<raw>{rules.raw})")
    parts.append("(?P<quote>" + "|".join(re.escape(q.opens) for q, _ in quotes) + ")")
    parts.append(f"(?P<name>{rules.name})")
    parts += [r"(?P<number>\d[\w.]*)", f"(?P<other>{PUNCTUATION})", r"(?P<space>\s+)"]
    scan = re.compile("|".join(_unshared(p, i) for i, p in enumerate(parts)), re.M)
    by_open = {q.opens: (q, stretch) for q, stretch in quotes}
    block = re.compile("|".join(map(re.escape, rules.block))) if rules.block else None
    opened: list[int] = []  # open brackets
    count = dict.fromkeys("([{", 0)
    holes: list[tuple] = []  # of strings left for a hole: their rule, their begin, how deep brackets were
    heredocs: list[str] = []
    pos, plain, size = 0, 0, len(source)

    def put(kind: str, s: int, e: int) -> None:
        out.kind.append(kind), out.text.append(source[s:e] if e - s < 200 else source[s : s + 200]), out.start.append(s), out.end.append(e), out.partner.append(-1)

    def string(q: Quote, stretch: re.Pattern, begin: int, at: int) -> int:
        """Goes on in a string from `at`; returns where code goes on."""
        m = stretch.match(source, at)
        if m["hole"]:
            put("s", begin, m.end())
            holes.append((q, stretch, m.end(), len(opened)))
        else:
            put("s", begin, m.end())
        return m.end()

    while pos < size:
        m = scan.match(source, pos)
        if not m:
            pos += 1
            continue
        kind, s, pos = m.lastgroup if m.lastgroup in KINDS else _kind(m), m.start(), max(m.end(), pos + 1)
        if kind in ("skip", "comment"):
            continue
        if kind == "space":
            if heredocs and "\n" in m[0]:
                pos = _after_heredocs(source, s + m[0].index("\n") + 1, heredocs)
            continue
        if kind == "block":
            pos = _after_block(source, pos, block, rules)
        elif kind == "raw":
            put("s", s, pos)
        elif kind == "quote":
            pos = string(*by_open[m["quote"]], s, pos)
        elif kind == "name":
            put("s" if language == "ruby" and (m[0][0] == ":" or m[0][-1] == ":") else "n", s, pos)
        elif kind == "number":
            put("d", s, pos)
        else:
            c = m[0]
            if c == "/" and rules.slash and s >= plain and _pattern_here(out):
                p = _PATTERN.match(source, s)
                if p:
                    pos = p.end()
                    put("s", s, pos)
                    continue
                plain = source.find("\n", s) + 1 or size  # no pattern in the rest of this line
            if c == "<" and language == "ruby" and (h := _HEREDOC.match(source, s)):
                heredocs.append(h["word"])
                pos = h.end()
                put("s", s, pos)
                continue
            if c in CLOSERS:
                if holes and c == PARTNER["(" if holes[-1][0].hole.endswith("(") else "{"] and holes[-1][3] == len(opened):
                    q, stretch, _, _ = holes.pop()
                    pos = string(q, stretch, s, pos)
                    continue
                put("p", s, pos)
                if count[CLOSERS[c]]:
                    while out.text[opened[-1]] != CLOSERS[c]:
                        count[out.text[opened.pop()]] -= 1
                    count[CLOSERS[c]] -= 1
                    begin = opened.pop()
                    out.partner[begin], out.partner[-1] = len(out.kind) - 1, begin
                continue
            put("p", s, pos)
            if c in count:
                count[c] += 1
                opened.append(len(out.kind) - 1)
    return out


KINDS = ("skip", "comment", "block", "raw", "quote", "name", "number", "other", "space")
_PATTERN = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_HEREDOC = re.compile(r"<<[~-]?(?P<q>['\"]?)(?P<word>[A-Z_]\w*)(?P=q)")


def _unshared(part: str, i: int) -> str:
    """References to groups by number become references by name, as parts are put together."""
    seen = 0

    def named(m: re.Match) -> str:
        nonlocal seen
        seen += 1
        return f"(?P<g{i}_{seen}>"

    part = re.sub(r"(?<!\\)\((?!\?)", named, part)
    return re.sub(r"\\([12])", lambda m: f"(?P=g{i}_{m[1]})", part)


def _kind(m: re.Match) -> str:
    return next(k for k in KINDS if k in m.re.groupindex and m[k] is not None)


def _stretch(q: Quote) -> str:
    """From inside a string to its end, a hole, the line's end (unless it may span lines) or the file's end."""
    ends = re.escape(q.closes)
    hole = re.escape(q.hole) if q.hole else r"(?!)"
    stop = "".join(re.escape(c) for c in dict.fromkeys(q.closes[0] + q.hole[:1] + ("\\" if q.escape else "")))
    parts = [f"[^{stop}{'' if q.lines else chr(10)}]+"]
    if not q.escape and len(q.closes) == 1 and q.closes == '"':
        parts.append('""')
    parts.append(rf"(?!{ends}|{hole})[{stop}]" if not q.escape else rf"(?!{ends}|{hole})(?:\\[\s\S]?|[{stop}])")
    return rf"(?:{'|'.join(parts)})*+(?:(?P<hole>{hole})|{ends}|(?=\n)|\Z)"


def _after_block(source: str, pos: int, block: re.Pattern, rules: Language) -> int:
    depth = 1
    while depth:
        m = block.search(source, pos)
        if not m:
            return len(source)
        pos = m.end()
        depth += -1 if m[0] == rules.block[1] else int(rules.nested)
    return pos


def _after_heredocs(source: str, pos: int, words: list[str]) -> int:
    """Behind the lines that end the pending here-documents."""
    for w in words:
        m = re.compile(rf"^[ \t]*{w}[ \t]*$\n?", re.M).search(source, pos)
        pos = m.end() if m else len(source)
    words.clear()
    return pos


def _pattern_here(out: Tokens) -> bool:
    """Whether a slash begins a pattern: not after a value."""
    if not out.kind:
        return True
    if out.kind[-1] == "n":
        return out.text[-1] in BEFORE_PATTERN
    return out.kind[-1] == "p" and out.text[-1] not in (")", "]", "}")
