"""Definitions in the tokens of a file: what counts as one in each language, where it begins and ends, and its name.

A statement begins after the last `;`, `{` or `}` of its block. Every block is of a kind: `type` (its statements are members),
`body` (code) or `other`. All walks go over the tokens once, or over statements once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

from corvane.operators.lexer import Tokens, tokens

ANONYMOUS = "<anonymous>"
#: Languages of one grammar.
SAME = {"typescript": "javascript", "tsx": "javascript", "cpp": "c"}
MODIFIERS = {
    "rust": {"pub", "async", "unsafe", "const", "extern", "default"},
    "kotlin": {"public", "private", "protected", "internal", "open", "abstract", "final", "sealed", "data", "enum", "annotation", "inner", "value", "inline", "fun", "expect", "actual"},
    "swift": {"public", "private", "fileprivate", "internal", "open", "package", "final", "static", "class", "override", "mutating", "nonmutating", "required", "convenience", "indirect", "nonisolated", "prefix", "postfix", "infix", "dynamic", "async", "distributed"},
    "scala": {"private", "protected", "override", "final", "implicit", "lazy", "inline", "abstract", "sealed", "case", "open", "infix", "transparent"},
    "php": {"public", "private", "protected", "static", "final", "abstract", "readonly", "var"},
}
CONTROL = {"if", "for", "while", "switch", "catch", "return", "sizeof", "else", "do", "throw", "new", "delete", "using", "lock", "fixed", "foreach", "synchronized", "super", "this", "with", "function", "await", "typeof", "import", "yield", "case", "assert"}
Found = Iterator[tuple[int, int, str]]  # first and last token, name


def definitions_of(source: str, language: str, typed: bool = False) -> list[tuple]:
    """(name, start_line, end_line, signature) in order of place; nothing for other languages. typed: of TypeScript."""
    find = FINDERS.get(language)
    if not find:
        return []
    t = tokens(source, language)
    out = []
    for first, last, name in find(t, typed) if language == "javascript" else find(t):
        begin, end = t.start[first], t.end[min(max(first, last), len(t.end) - 1)]
        stop = source.find("\n", begin, end)
        out.append((begin, -end, name or ANONYMOUS, t.line(begin), t.line(max(begin, end - 1)), source[begin : end if stop < 0 else stop].strip()[:200]))
    return [x[2:] for x in sorted(out)]


def closing(t: Tokens, i: int) -> int:
    """The partner of the bracket at i, or the last token."""
    return t.partner[i] if t.partner[i] >= 0 else len(t.kind) - 1


#: Tokens outside brackets that a definition's head has at most; keeps all walks linear.
HEAD = 400


def until(t: Tokens, j: int, stops: tuple, over: tuple = ("(", "[")) -> int:
    """The first of `stops` from j on, passing over brackets of the kinds `over`; beyond HEAD tokens, where that is."""
    for _ in range(HEAD):
        if j >= len(t.kind) or t.at(j) in stops:
            break
        j = closing(t, j) + 1 if t.at(j) in over else j + 1
    return j


def after_angles(t: Tokens, i: int) -> int:
    """Behind <...> at i, if it is balanced; else i."""
    if t.at(i) != "<":
        return i
    depth, j = 0, i
    while j < min(len(t.kind), i + 400):
        c = t.at(j)
        if c == "<":
            depth += 1
        elif c == ">":
            depth -= 1
            if not depth:
                return j + 1
        elif c in ("(", "[", "{"):
            j = closing(t, j)
        elif c in (";", ")", "]", "}"):
            return i
        j += 1
    return i


def before_angles(t: Tokens, i: int) -> int:
    """The token before <...> that ends at i; i itself if it doesn't end one."""
    if t.at(i) != ">":
        return i
    depth = 0
    for j in range(i, max(-1, i - 400), -1):
        c = t.at(j)
        depth += (c == ">") - (c == "<")
        if not depth:
            return j - 1
        if c in (";", "{", "}"):
            return i
    return i


def line_end(t: Tokens, i: int, go_on: Callable[[int], bool] = lambda j: False) -> int:
    """The last token of the statement at i, which ends with its line, a `;` or its block; brackets are passed over."""
    j = i
    for _ in range(HEAD):
        if t.at(j) in ("(", "[", "{"):
            j = closing(t, j)
        if j + 1 >= len(t.kind) or t.at(j + 1) in (";", "}", ")") or (t.fresh(j + 1) and not go_on(j + 1)):
            return j
        j += 1
    return j


def backward(t: Tokens, i: int, words: set, attributes: bool = True) -> int:
    """The first of the modifiers (words, `pub(...)`, attributes @x and @x(...)) right before i."""
    while i > 0:
        j = i - 1
        if t.at(j) == ")" and t.partner[j] > 0:
            j = t.partner[j] - 1
            if not (t.at(j) in words or (attributes and t.at(j)[:1] == "@")):
                return i
        if not (t.kind[j] != "s" and (t.at(j) in words or (attributes and t.at(j)[:1] == "@")) or (t.kind[j] == "s" and t.at(j - 1) == "extern")):
            return i
        i = j
    return i


def blocks(t: Tokens, kind_of: Callable[[int, int, str], str]) -> Iterator[tuple[int, int, str, str]]:
    """(place, its statement's first token, its block's kind and type's name) of every token; brackets without blocks are passed.

    kind_of(place of `{`, statement's begin, kind around) tells a block's kind: `type:Name` names the type, `part` goes on
    with the statement behind it.
    """
    stack: list[tuple] = []
    braces = [0, *accumulate(x == "{" for x in t.text)]
    begin, kind, i = 0, "type:", 0
    while i < len(t.kind):
        c = t.at(i)
        yield i, begin, kind.split(":")[0], kind.partition(":")[2]
        if c in ("(", "["):
            if braces[i] == braces[closing(t, i)]:
                i = closing(t, i)
        elif c == "{":
            new = kind_of(i, begin, kind)
            stack.append((kind, begin if new == "part" else -1))
            kind, begin = new, i + 1
        elif c == "}" and stack:
            kind, before = stack.pop()
            begin = i + 1 if before < 0 else before
        elif c == ";":
            begin = i + 1
        i += 1


def java(t: Tokens) -> Found:
    return members(t, {"class", "interface"}, {"class", "interface", "enum", "record"})


def c_sharp(t: Tokens) -> Found:
    return members(t, {"class", "interface"}, {"class", "interface", "enum", "record", "struct", "namespace"})


def type_word(t: Tokens, begin: int, i: int, words: set) -> int:
    """The place of the word that makes the statement begin..i a type's; -1 if none."""
    j = begin
    while j < i:
        if t.at(j) in ("(", "["):
            j = closing(t, j)
        elif t.at(j) in ("=", "=>", "new"):
            return -1
        elif t.at(j) in words and t.named(j + 1) and t.at(j - 1) not in (".", "::") and (t.at(j) != "record" or t.at(j + 2) in ("(", "{", "<", ":") or t.at(j + 1) in ("class", "struct")):
            return j
        j += 1
    return -1


def members(t: Tokens, own: set, types: set) -> Found:
    """Classes, interfaces, methods and constructors of languages whose members stand in type blocks."""

    def kind_of(i: int, begin: int, around: str) -> str:
        j = type_word(t, begin, i, types)
        if j >= 0:
            return "body" if t.at(j - 1) == "@" else "type:" + t.at(j + 1)
        k = t.partner[i - 1] - 1 if t.at(i - 1) == ")" and t.partner[i - 1] > 0 else -1  # new X(...) { members }
        k = before_angles(t, k)
        while k > 0 and (t.named(k) and t.at(k) != "new" or t.at(k) == "."):
            k -= 1
        return "type:" if k >= 0 and t.at(k) == "new" else "body"

    done = -1
    for i, begin, kind, name in blocks(t, kind_of):
        c = t.at(i)
        if c in own and t.named(i + 1) and t.at(i - 1) not in (".", "@", "::") and begin > done and t.at(begin) != "where" and type_word(t, begin, i + 1, types) == i:
            j = until(t, i + 2, ("{", ";", "}"))
            yield begin, closing(t, j) if t.at(j) == "{" else j, t.text[i + 1]
            done = begin
        elif c == "(" and kind == "type" and begin > done:
            k = before_angles(t, i - 1)
            if not t.named(k) or t.at(k) in CONTROL or t.at(k)[:1] == "@" or t.at(k - 1) in ("@", ".") and not _explicit(t, begin, k) or k <= begin and t.at(k) != name:
                continue
            before = {t.at(j) for j in range(begin, k)}
            if before & {"=", "=>", "delegate", "operator"} or k - begin > HEAD or type_word(t, begin, k, types) >= 0:
                done = begin  # no member begins later in this statement
                continue
            if t.at(k - 1) in (",", "~"):
                continue
            j = until(t, closing(t, i) + 1, ("{", ";", "}", "=>", "=", ","))
            if t.at(j) == "=>":
                j = until(t, j, (";",), ("(", "[", "{"))
            elif t.at(j) not in ("{", ";"):
                continue
            typed = any(t.named(x) for x in range(begin, k) if t.at(x - 1) != "@" and t.at(x)[:1] != "@" and t.at(x) not in WORDS)
            typed |= any(t.at(x) in ("]", ">", "?") for x in range(begin, k))
            if typed or (t.at(k) == name and t.at(j) in ("{", "=>")):
                yield begin, closing(t, j) if t.at(j) == "{" else j, t.text[k]
                done = begin


WORDS = {"public", "private", "protected", "internal", "static", "final", "abstract", "synchronized", "native", "strictfp", "default", "virtual", "override", "sealed", "async", "unsafe", "extern", "new", "partial", "readonly"}


def _explicit(t: Tokens, begin: int, k: int) -> bool:
    """Whether the dots before the name at k are of an explicitly implemented interface: a type stands before them."""
    while k > begin and (t.at(k - 1) == "." or t.at(k) == "." or t.at(k) == ">"):
        k = before_angles(t, k - 1)
    return k > begin and t.at(k)[:1] != "@" and t.at(k - 1) != "@"


def kotlin(t: Tokens) -> Found:
    for i in range(len(t.kind)):
        if t.at(i) in ("class", "interface") and t.named(i + 1) and t.at(i - 1) not in (".", "::", "@"):
            yield backward(t, i, MODIFIERS["kotlin"]), line_end(t, i + 1, lambda j: t.at(j) in ("{", ":", "(", "where", "constructor") or t.at(j - 1) in (":", ",")), t.text[i + 1].strip("`")


def swift(t: Tokens) -> Found:
    protocol = -1
    for i in range(len(t.kind)):
        c = t.at(i)
        if c == "protocol" and t.named(i + 1):
            j = until(t, i, ("{", "}", ";"))
            if t.at(j) == "{":
                protocol = closing(t, j)
        elif c in ("class", "struct", "enum", "extension", "actor") and t.named(i + 1) and t.at(i - 1) not in (".", ":") and t.at(i + 1) not in MODIFIERS["swift"] | {"func", "var", "let", "subscript", "init", "typealias"}:
            j = i + 2
            while t.at(j) == "." and t.named(j + 1):
                j += 2
            name = t.source[t.start[i + 1] : t.end[j - 1]]
            j = until(t, j, ("{", "}", ";"))
            if t.at(j) == "{":
                yield backward(t, i, MODIFIERS["swift"]), closing(t, j), name
        elif c == "func" and i > protocol and i + 1 < len(t.kind) and t.at(i - 1) != ".":
            j = i + 1
            while j < len(t.kind) and t.at(j) != "(" and not (j > i + 1 and t.at(j) == "<" and t.named(j - 1)):
                j += 1
            name = t.source[t.start[i + 1] : t.end[j - 1]] if j > i + 1 else ""
            yield backward(t, i, MODIFIERS["swift"]), line_end(t, i, lambda j: t.at(j) in ("{", "-", "->", "where", "throws", "rethrows", "async") or t.at(j - 1) in (">", ",", "->")), name.strip("`")


def scala(t: Tokens) -> Found:
    """Methods that are declared only."""
    for i in range(len(t.kind)):
        if t.at(i) == "def" and (t.named(i + 1) or t.at(i + 1) in ("+", "-", "*", "/")):
            j = i + 2
            while t.at(j) in ("[", "("):
                j = closing(t, j) + 1
            if t.at(j) == ":":
                j = line_end(t, j) + 1
                if "=" in (x for x in (t.at(k) for k in range(i, j))):
                    continue
            if t.at(j) not in ("=", "{"):
                yield backward(t, i, MODIFIERS["scala"]), j - 1, t.text[i + 1]


def go(t: Tokens) -> Found:
    depth = 0
    for i in range(len(t.kind)):
        c = t.at(i)
        depth += (c in ("{", "(")) - (c in ("}", ")"))
        if c == "func" and not depth and t.fresh(i):
            k = closing(t, i + 1) + 1 if t.at(i + 1) == "(" else i + 1
            if t.named(k):
                yield i, line_end(t, k), t.text[k]
        elif c == "type" and (t.fresh(i) or t.at(i - 1) in (";", "{")) and (t.named(i + 1) or t.at(i + 1) == "("):
            yield i, line_end(t, i + 1), ""


def rust(t: Tokens) -> Found:
    i = 0
    while i < len(t.kind):
        c = t.at(i)
        if t.named(i) and t.at(i + 1) == "!" and t.kind[i + 1] == "p":  # macros hold no definitions
            j = i + 3 if t.named(i + 2) else i + 2
            if t.at(j) in ("(", "[", "{"):
                i = closing(t, j)
        elif c in ("fn", "struct", "enum", "trait") and t.named(i + 1) or c == "impl" and (i == 0 or t.at(i - 1) in ("}", ";", "{", "]", "unsafe", "default")):
            j = until(t, i + 1, ("{", ";", "}"))
            if t.at(j) == "{" or c == "struct" and t.at(j) == ";":
                yield backward(t, i, MODIFIERS["rust"], False), closing(t, j) if t.at(j) == "{" else j, "" if c == "impl" else t.text[i + 1]
        i += 1


def c_family(t: Tokens) -> Found:
    """Functions with a body, which have no name of their own; structs and, of C++, classes wherever they are named."""

    def head(begin: int, i: int) -> int:
        """Behind templates at the statement's begin."""
        while t.at(begin) == "template" and t.at(begin + 1) == "<":
            j = after_angles(t, begin + 1)
            if j == begin + 1:
                return begin
            begin = j
        return begin

    def function(begin: int, i: int) -> bool:
        j, call = begin, False
        while j < i:
            c = t.at(j)
            if c == "operator":
                j += 2
                continue
            if c == "(":
                call |= t.named(j - 1) and t.at(j - 1) not in CONTROL | {"alignas", "decltype", "__attribute__"} or t.at(j - 1) in (")", ">") or t.at(j - 2) == "operator"
                j = closing(t, j)
            elif c == "=" or not call and c in ("namespace", "enum", "union"):
                return False
            j += 1
        return call and (t.at(i - 1) != ":" and t.at(begin) not in CONTROL)

    def kind_of(i: int, begin: int, around: str) -> str:
        begin = head(begin, i)
        if around != "body" and function(begin, i):
            return "part" if _initialiser(t, begin, i) else "body"
        words = [t.at(j) for j in range(begin, min(i, begin + 40))]
        if "=" in words:
            return "body"
        return "type" if {"struct", "class", "union", "namespace"} & set(words) or words[:1] == ["extern"] or i == begin and around != "body" else "body"

    labelled = -1
    for i, begin, kind, _ in blocks(t, kind_of):
        c = t.at(i)
        if c == ":" and t.at(i - 1) in ("public", "private", "protected", "signals", "slots"):
            labelled = i + 1
        begin = head(max(begin, labelled), i)
        if c == "{" and kind != "body" and function(begin, i) and not _initialiser(t, begin, i):
            yield begin, closing(t, i), ""
    for i in range(len(t.kind)):
        c = t.at(i)
        if c in ("struct", "class") and t.at(i - 1) not in ("enum", "<", ",", ".") and (t.named(i + 1) or t.at(i + 1) == "{"):
            j = i + 1
            while t.named(j) or t.at(j) == "::":
                if t.at(j + 1) == "(" and t.at(j) in ("alignas", "__attribute__", "__declspec"):
                    j = closing(t, j + 1)
                elif t.named(j) and t.at(j + 1) not in ("::", "final") and not (t.at(j).isupper() and t.named(j + 1) and t.at(j + 2) in ("{", ":", "final")):
                    j += 1  # the name; before it only a macro in capitals
                    break
                j += 1
            last = j - 1
            name = t.text[last]
            last += t.at(last + 1) == "final"
            j = last + 1
            last = max(last, after_angles(t, j) - 1) if t.at(j) == "<" else last
            k = last + 1
            if t.at(k) == ":":
                k = until(t, k, ("{", ";", "}", ")"))
            yield i, closing(t, k) if t.at(k) == "{" else last, "" if t.at(i + 1) == "{" else name


def _initialiser(t: Tokens, begin: int, i: int) -> bool:
    """Whether the brace at i belongs to a member's initialiser between a constructor's head and body."""
    if not (t.named(i - 1) or t.at(i - 1) == ">") or t.at(i - 1) in ("const", "noexcept", "override", "final", "try", "mutable"):
        return False
    return t.at(closing(t, i) + 1) in (",", "{") and any(t.at(j) == ":" for j in range(begin, i))


OPENERS = {"def", "class", "module", "begin", "case", "if", "unless", "while", "until", "for", "do"}


def ruby(t: Tokens) -> Found:
    stack: list[tuple] = []
    loop = -1  # the line of a loop whose `do` opens nothing of its own
    for i in range(len(t.kind)):
        c = t.at(i)
        if not t.named(i) or t.at(i - 1) in (".", "?.", "&.") or t.at(i - 1) == "::":
            continue
        if c in ("if", "unless", "while", "until", "rescue") and not (t.fresh(i) or t.at(i - 1) in ("=", "(", ",", "[", "{", ";", "|", "||", "&&", "then", "else", "do", "return", "and", "or", "not", "+", "<<", "=>")):
            continue  # after its statement
        if c == "do" and loop == t.line(t.start[i]):
            loop = -1
        elif c == "def":
            j = i + 1
            single = t.at(j + 1) == "." and (t.named(j) or t.at(j) == ")")
            k = j + 2 if single else j
            name = t.text[k] if k < len(t.kind) else ""
            while name and not t.named(k) and k + 1 < len(t.kind) and t.at(k + 1) not in ("(", "") and t.start[k + 1] == t.end[k]:
                k += 1
                name += t.text[k]
            if t.at(k + 1) == "=" and t.start[k + 1] == t.end[k] and t.at(k + 2) == "(":
                name, k = name + "=", k + 1
            p = closing(t, k + 1) + 1 if t.at(k + 1) == "(" else k + 1
            if t.at(p) == "=" and not t.fresh(p):
                yield i, line_end(t, p), name
            else:
                stack.append((i, name))
        elif c in ("class", "module"):
            j = i + 1
            while t.at(j + 1) == "::":
                j += 2
            stack.append((i, t.source[t.start[i + 1] : t.end[j]] if t.named(i + 1) else None))
        elif c in OPENERS:
            if c in ("while", "until", "for"):
                loop = t.line(t.start[i])
            stack.append((i, None))
        elif c == "end" and stack:
            begin, name = stack.pop()
            if name is not None:
                yield begin, i, name
    yield from ((begin, len(t.kind) - 1, name) for begin, name in stack if name is not None)


def php(t: Tokens) -> Found:
    def kind_of(i: int, begin: int, around: str) -> str:
        j = begin
        while j < i and not (t.at(j) in ("class", "interface", "trait", "enum") and t.at(j - 1) not in ("::", "->", "?->")):
            j += 1
        return "type" if j < i and t.at(j + 1) != "(" or j < i and t.at(j - 1) == "new" else "body"

    for i, _, kind, _ in blocks(t, kind_of):
        c = t.at(i).lower()
        if c == "function":
            k = i + 2 if t.at(i + 1) == "&" else i + 1
            if not t.named(k) or t.at(k)[:1] == "$" or t.at(k + 1) != "(" or t.at(i - 1) in ("->", "::", "use"):
                continue
            j = until(t, closing(t, k + 1) + 1, ("{", ";", "}"))
            if t.at(j) == "{" or kind == "type" and t.at(j) == ";":
                yield backward(t, i, MODIFIERS["php"], False), closing(t, j) if t.at(j) == "{" else j, t.text[k]
        elif c == "class" and t.named(i + 1) and t.at(i - 1) not in ("::", "new", "->") and t.at(i + 1) not in ("extends", "implements"):
            j = until(t, i + 1, ("{", ";", "}"))
            yield backward(t, i, MODIFIERS["php"], False), closing(t, j), t.text[i + 1]


VALUE_BEFORE = {"=", "(", ",", "[", ":", "?", "=>", "return", "&&", "||", "??", "+", "!", "default", "yield", "await", "...", "new", "typeof", "of", "in", "case"}
METHOD_WORDS = {"static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "declare", "accessor"}


def javascript(t: Tokens, typed: bool) -> Found:
    members: set[int] = set()  # braces of class bodies
    objects: set[int] = set()  # braces of object literals
    types: set[int] = set()  # braces and brackets inside which all is types
    inside: list[int] = []
    ternary = [0]
    alias = -1  # the last token of a type alias
    ends: dict[int, tuple] = {}  # of the last expression in each bracket
    for i in range(len(t.kind)):
        c = t.at(i)
        around = inside[-1] if inside else -1
        in_type = typed and (i <= alias or around in types)
        if t.kind[i] == "n":
            statement = i == 0 or t.at(i - 1) in (";", "{", "}", "export", "default", "declare", "abstract") or t.at(i - 1) == "async" or t.at(i - 1) == ")" or (t.fresh(i) and t.at(i - 1) not in VALUE_BEFORE)
            if c == "function" and t.at(i - 1) != "." and t.at(i + 1) != ":" and around not in members:
                star = t.at(i + 1) == "*"
                k = i + 1 + star
                named = t.named(k)
                p = after_angles(t, k + named)
                if t.at(p) == "(" and not in_type:
                    body = after_type(t, closing(t, p) + 1) if typed else closing(t, p) + 1
                    begin = i - (t.at(i - 1) == "async")
                    if t.at(body) == "{" and not (star and statement and t.at(i - 1) not in VALUE_BEFORE):
                        yield begin, closing(t, body), t.text[k] if named else ""
            elif c == "class" and t.at(i - 1) not in (".",) and t.at(i + 1) not in (":", "=", ")", ","):
                j = until(t, max(i + 1, after_angles(t, i + 1 + t.named(i + 1))), ("{", ";", "}"))
                while t.at(j) == "{" and t.at(j - 1) in ("<", ",", "|", "&") and j < i + HEAD:  # of a type
                    j = until(t, closing(t, j) + 1, ("{", ";", "}"))
                if t.at(j) == "{":
                    members.add(j)
                    if statement and t.named(i + 1) and t.at(i - 1) != "abstract" and (t.at(i - 1) not in VALUE_BEFORE or t.at(i - 1) == "default"):
                        yield i, closing(t, j), t.text[i + 1]
            elif typed and c in ("interface", "enum", "namespace", "module") and t.named(i + 1) and statement:
                j = until(t, i + 1, ("{", ";", "}"))
                if t.at(j) == "{" and c == "interface":
                    types.add(j)
            elif typed and c == "type" and t.named(i + 1) and statement and t.at(after_angles(t, i + 2)) == "=":
                alias = max(alias, line_end(t, after_angles(t, i + 2), lambda j: t.at(j) in ("|", "&", "=>", "?", ":") or t.at(j - 1) in ("|", "&", "=", "=>", "?", ":")))
        if (around in members or around in objects) and not in_type and (found := method(t, i, around, typed)):
            yield found
        if c == "=>" and not in_type:
            begin = arrow(t, i, typed, around in types)
            if begin is not None:
                body = i + 1
                if t.at(body) == "{":
                    last = closing(t, body)
                else:
                    of, last = ends.get(around, (0, -1))
                    if not of <= body <= last:  # an arrow's body may be an arrow, and ends where that does
                        last = expression_end(t, body)
                        ends[around] = body, last
                yield begin, last, ""
        if c in ("(", "[", "{"):
            if c == "{" and i not in members and i not in types:
                before = t.at(i - 1)
                value = before in VALUE_BEFORE and before not in ("=>", "default", "in", "of", ":") or before == "default" or (before == ":" and (ternary[-1] > 0 or around in objects))
                if in_type or typed and before in ("|", "&") or typed and before == ":" and not value:
                    types.add(i)
                elif value and not (before == "(" and t.at(i - 2) == "=>"):
                    objects.add(i)
            elif in_type or typed and c in ("(", "[") and around in types:
                types.add(i)
            inside.append(i)
            ternary.append(0)
        elif c in (")", "]", "}"):
            while inside and (t.partner[i] >= 0 and inside[-1] >= t.partner[i]):
                inside.pop()
                ternary.pop()
            if not ternary:
                ternary.append(0)
        elif c == "?" and t.at(i + 1) not in (":", ")", ",", "=", ";", "(", ">") :
            ternary[-1] += 1
        elif c == ":" and ternary[-1]:
            ternary[-1] -= 1
        elif c == ";":
            ternary[-1] = 0


def after_type(t: Tokens, i: int) -> int:
    """Behind a `: type` at i, up to the body, `=>`, or what can't be of a type; i if there is none."""
    if t.at(i) != ":":
        return i
    j, value = i + 1, False  # value: a part of the type stands before j, so a brace would be a body
    while j < min(len(t.kind), i + 400):
        c = t.at(j)
        if c == "{" and value:
            return j
        if c in ("(", "[", "{"):
            end = closing(t, j)
            value, j = True, end + 1
            if c == "(" and t.at(j) == "=>":
                j, value = j + 1, False
        elif c == "<" and after_angles(t, j) > j:
            j, value = after_angles(t, j), True
        elif c in ("|", "&", ".", "?", ":") or t.at(j) in ("is", "keyof", "typeof", "extends", "infer", "readonly", "asserts", "unique", "new", "in"):
            j, value = j + 1, False
        elif t.kind[j] in "nsd" and not value:
            j, value = j + 1, True
        else:
            return j
    return j


def method(t: Tokens, i: int, around: int, typed: bool) -> tuple[int, int, str] | None:
    """The method whose first token is i, in the class body or object literal that opens at `around`."""
    before = t.at(i - 1)
    if i - 1 != around and before not in (";", "}", ",") and not (t.fresh(i) and before not in VALUE_BEFORE | {".", "|", "&"}) and not (before == ")" and t.partner[i - 1] > 0 and t.at(t.partner[i - 1] - 1)[:1] == "@"):
        return None
    if t.at(i)[:1] == "@" or t.at(i) in (")", "]", "}", "("):
        return None
    k = i
    while (t.at(k) in METHOD_WORDS and t.at(k + 1) not in ("(", "=", ":", ";", ",", "?", "!", "<", "}")) or t.at(k) == "*":
        k += 1
    first = k
    if t.at(k) == "[":
        k = closing(t, k)
    elif not (k < len(t.kind) and t.kind[k] in "nsd") or t.at(k) in CONTROL | {"catch", "function"} and t.at(k + 1) != "(":
        return None
    if t.at(k) in ("if", "for", "while", "switch", "catch", "with", "function", "return") and around < 0:
        return None
    name = t.source[t.start[first] : t.end[k]]
    p = k + 2 if t.at(k + 1) == "?" else k + 1
    p = after_angles(t, p)
    if t.at(p) != "(":
        return None
    body = closing(t, p) + 1
    body = after_type(t, body) if typed else body
    return (i, closing(t, body), name) if t.at(body) == "{" else None


def arrow(t: Tokens, i: int, typed: bool, in_types: bool) -> int | None:
    """The first token of the arrow function whose arrow is at i; None if it is a type's arrow."""
    j = i - 1
    if t.at(j) == ")":
        j = t.partner[j]
        if j < 0:
            return None
    elif t.named(j) and (t.at(j - 1) in VALUE_BEFORE | {"async", ";", "{", "}", ")"} or j == 0 or t.fresh(j)) and t.at(j - 1) != ":":
        return j - (t.at(j - 1) == "async")
    elif typed or t.at(j) in ("]", "}", ">"):
        # a result's type stands before the arrow: back over it to `) :`
        low = max(0, j - 300)
        while j > low and not (t.at(j) == ":" and t.at(j - 1) == ")") and t.at(j) not in (";", "=", ",", "(", "=>"):
            j = t.partner[j] - 1 if t.at(j) in (")", "]", "}") and t.partner[j] > 0 else j - 1
        if t.at(j) != ":":
            return (i - 1) - (t.at(i - 2) == "async") if t.named(i - 1) else None
        j = t.partner[j - 1]
        if j < 0:
            return None
        if t.at(j - 1) == "?" and t.named(i - 1):
            return i - 1
    k = before_angles(t, j - 1) + 1 if t.at(j - 1) == ">" and t.at(j - 2) != "=" else j
    k = min(k, j)
    before = t.at(k - 1)
    if before == "async":
        return k - 1
    if typed and (in_types or before in (":", "|", "&", "<", "as", "extends") and not _value_colon(t, k - 1)):
        return None
    return k


def _value_colon(t: Tokens, i: int) -> bool:
    """Whether the colon at i stands before a value: of an object literal's key or of a choice, not before a type."""
    if t.at(i) != ":":
        return False
    j, steps = i - 1, 0
    while j >= 0 and steps < 300:
        c = t.at(j)
        if c in (")", "]", "}") and t.partner[j] >= 0:
            j = t.partner[j]
        elif c == "?" and t.at(j + 1) != ":":
            return True
        elif c == "{":
            return t.at(j - 1) in VALUE_BEFORE and t.at(j - 1) != "=>"
        elif c in ("(", "[", ";", "=", "let", "const", "var"):
            return False
        j -= 1
        steps += 1
    return False


def expression_end(t: Tokens, i: int) -> int:
    """The last token of the expression at i."""
    j = i
    while j < len(t.kind):
        c = t.at(j)
        if c in ("(", "[", "{"):
            j = closing(t, j)
        elif c in (")", "]", "}", ",", ";") or t.kind[j] == "s" and t.text[j][0] in "})":  # the string around a hole goes on
            return j - 1
        if j + 1 < len(t.kind) and t.fresh(j + 1) and t.at(j + 1) not in (".", "?.", "?", ":", "&&", "||", "??", "+", "-", "*", "/", "=>", "(", "[", "|", "=") and (t.at(j) in (")", "]", "}") or t.kind[j] in "nsd"):
            return j
        j += 1
    return len(t.kind) - 1


def python(t: Tokens) -> Found:
    """Of files that don't parse: def and class at the begin of a line, with all lines indented further."""
    margins = [(t.line(s), s - t.source.rfind("\n", 0, s) - 1, i) for i, s in enumerate(t.start) if t.fresh(i)]
    open_: list[tuple] = []
    for _, margin, i in margins:
        while open_ and open_[-1][0] >= margin:
            _, begin, name = open_.pop()
            yield begin, i - 1, name
        k = i + 1 if t.at(i) == "async" else i
        if t.at(k) in ("def", "class") and t.named(k + 1):
            open_.append((margin, i, t.text[k + 1]))
    yield from ((begin, len(t.kind) - 1, name) for _, begin, name in open_)


FINDERS: dict = {"javascript": javascript, "java": java, "c_sharp": c_sharp, "go": go, "rust": rust, "c": c_family, "ruby": ruby, "php": php, "kotlin": kotlin, "swift": swift, "scala": scala, "python": python}


def script_imports(source: str) -> list[str]:
    """Sources of import and export ... from statements, sorted, each once."""
    t, out = tokens(source, "javascript"), set()
    for i in range(len(t.kind)):
        if t.at(i) not in ("import", "export") or t.at(i - 1) in (".", "?.") or t.at(i + 1) in ("(", ":", "=", ".") or t.fresh(i) == 0 and t.at(i - 1) not in (";", "}"):
            continue
        j = i + 1
        if t.at(i) == "export" and t.at(j) not in ("{", "*", "type"):
            continue
        while j < min(len(t.kind), i + HEAD) and t.kind[j] != "s" and t.at(j) not in (";", "=", "("):
            j = closing(t, j) + 1 if t.at(j) == "{" else j + 1
        if j < len(t.kind) and t.kind[j] == "s" and (t.at(j - 1) == "from" or j == i + 1 and t.at(i) == "import"):
            text = t.source[t.start[j] : t.end[j]]
            out.add(text[1:-1] if len(text) > 1 and text[0] == text[-1] else text)
    return sorted(out)
