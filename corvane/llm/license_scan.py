"""License scans by template markup: optional and replaceable regions compiled into token automata.

A template is wording with regions `<<opt>> ... <</opt>>` (may be absent, may nest) and `<<var a-b>>` (any a to b
words). It compiles to a nondeterministic automaton over words. A text carries the template's label where the automaton
accepts a run of consecutive words: all mandatory wording is there, exactly and in order.

Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased over A-Z. Defined cases: a null text is
empty; no word gives n_words 0, null first and last words, empty labels, score 0; overlapping and repeated places all
count; repeated rows are scanned alike; input columns are carried in `row`.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from corvane.llm.rows import map_text

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Fixed values of the contract.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label and template: notices of a line, then whole licences and headers. Wording is fixed by the licences.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license <<opt>>version<</opt>> 2 0",
    "cc-by-family": "<<opt>>this work is<</opt>> licensed under <<opt>>the<</opt>> <<opt>>creative commons<</opt>> cc by <<var 0-3>> <<opt>>international<</opt>> 4 0",
    "gpl-notice": "licensed under the <<opt>>gnu<</opt>> <<opt>>lesser<</opt>> general public license <<opt>>version <<var 1-1>><</opt>>",
    "mit": "<<opt>>released<</opt>> <<opt>>licensed<</opt>> under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that",
    "reserved-notice": "<<opt>>copyright <<var 1-8>><</opt>> all rights reserved",
    "apache-2.0-header": """licensed under the apache license version 2 0 the license you may not use this file except in compliance
        with the license you may obtain a copy of the license at <<var 1-1>> www apache org licenses license 2 0 unless
        required by applicable law or agreed to in writing software distributed under the license is distributed on an
        as is basis without warranties or conditions of any kind either express or implied see the license for the
        specific language governing permissions and limitations under the license""",
    "bsd-2-clause": """redistribution and use in source and binary forms with or without modification are permitted provided that
        the following conditions are met <<opt>>1<</opt>> redistributions of source code must retain the above copyright
        notice this list of conditions and the following disclaimer <<opt>>2<</opt>> redistributions in binary form must
        reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
        and or other materials provided with the distribution this software is provided by <<var 1-12>> as is and any
        express or implied warranties including but not limited to the implied warranties of merchantability and fitness
        for a particular purpose are disclaimed in no event shall <<var 1-12>> be liable for any direct indirect incidental special exemplary or
        consequential damages including but not limited to procurement of substitute goods or services loss of use data or
        profits or business interruption however caused and on any theory of liability whether in contract strict liability
        or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the
        possibility of such damage""",
    "bsd-3-clause": """redistribution and use in source and binary forms with or without modification are permitted provided that
        the following conditions are met <<opt>>1<</opt>> redistributions of source code must retain the above copyright
        notice this list of conditions and the following disclaimer <<opt>>2<</opt>> redistributions in binary form must
        reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
        and or other materials provided with the distribution <<opt>>3<</opt>> neither the name of <<var 1-12>> nor the
        names of its contributors may be used to endorse or promote products derived from this software without
        specific prior written permission this software is provided by <<var 1-12>> as is and any express or implied
        warranties including but not limited to the implied warranties of merchantability and fitness for a particular
        purpose are disclaimed in no event shall <<var 1-12>> be liable for any direct indirect incidental special exemplary or
        consequential damages including but not limited to procurement of substitute goods or services loss of use data or
        profits or business interruption however caused and on any theory of liability whether in contract strict liability
        or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the
        possibility of such damage""",
    "isc-text": """permission to use copy modify and <<opt>>or<</opt>> distribute this software for any purpose with or without
        fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
        the software is provided as is and <<var 1-6>> disclaims all warranties with regard to this software including
        all implied warranties of merchantability and fitness in no event shall <<var 1-6>> be liable for any special direct
        indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in
        an action of contract negligence or other tortious action arising out of or in connection with the use or
        performance of this software""",
    "mit-text": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the
        rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
        persons to whom the software is furnished to do so subject to the following conditions the above copyright
        notice and this permission notice <<opt>>including the next paragraph<</opt>> shall be included in all copies or
        substantial portions of the software the software is provided as is without warranty of any kind express or implied including
        but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no
        event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action
        of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings
        in the software""",
}
FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def parse(template: str) -> list:
    """Nested parts: word, ("opt", parts) or ("var", least, most)."""
    stack: list[list] = [[]]
    for m in re.finditer(r"<<opt>>|<</opt>>|<<var (\d+)-(\d+)>>|[^\s<]+", template):
        if m[0] == "<<opt>>":
            stack.append([])
        elif m[0] == "<</opt>>":
            inner = stack.pop()
            stack[-1].append(("opt", inner))
        elif m[1]:
            stack[-1].append(("var", int(m[1]), int(m[2])))
        else:
            stack[-1].append(m[0])
    if len(stack) != 1:
        raise ValueError(f"regions don't balance: {template}")
    return stack[0]


class Automaton:
    """States 0..accept; `step[state]` lists (word or None for any, next); `skip[state]` lists next states for no word."""

    def __init__(self, template: str):
        self.step: list[list] = [[]]
        self.skip: list[list] = [[]]
        self.accept = self._add(0, parse(template))
        self.words = {w for arcs in self.step for w, _ in arcs}
        self.starts = {w for s in self._closed({0}) for w, _ in self.step[s]}
        if None in self.starts or self.accept in self._closed({0}):
            raise ValueError("a template must begin with wording")

    def _new(self) -> int:
        self.step.append([])
        self.skip.append([])
        return len(self.step) - 1

    def _add(self, at: int, parts: list) -> int:
        for p in parts:
            if isinstance(p, str):
                to = self._new()
                self.step[at].append((p.encode(), to))
                at = to
            elif p[0] == "opt":
                end, to = self._add(at, p[1]), self._new()
                self.skip[at].append(to)
                self.skip[end].append(to)
                at = to
            else:
                for i in range(p[2]):
                    to = self._new()
                    self.step[at].append((None, to))
                    if i >= p[1]:
                        self.skip[at].append(to)
                    at = to
        return at

    def _closed(self, states: set) -> set:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.skip[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen


class Matcher:
    """All templates as one automaton that reads a text's words once: a set of states, begun anew at every word.

    A word costs as much as there are states alive, at most those of the templates, whatever stands in the text.
    """

    def __init__(self, templates: dict):
        self.first: dict[bytes, set] = {}  # word: states after it, from any template's begin
        self.step: list[dict] = []  # state: word: states
        self.any: list[set] = []  # state: states after any word
        self.accepts: dict[int, str] = {}
        for label, template in templates.items():
            a, base = Automaton(template), len(self.step)
            after = [{base + t for t in a._closed({s})} for s in range(len(a.step))]
            for arcs in a.step:
                by, free = {}, set()
                for w, t in arcs:
                    if w is None:
                        free |= after[t]
                    else:
                        by[w] = by.get(w, set()) | after[t]
                self.step.append(by)
                self.any.append(free)
            for s in a._closed({0}):
                for w, t in a.step[s]:
                    self.first[w] = self.first.get(w, set()) | after[t]
            self.accepts[base + a.accept] = label

    def labels(self, words: list) -> set:
        """The labels of templates that accept some run of the words."""
        found: set = set()
        done = -1
        for i in [i for i, w in enumerate(words) if w in self.first]:
            if i <= done:
                continue  # already begun on the way
            alive: set = set()
            for done in range(i, len(words)):
                w = words[done]
                now = set(self.first.get(w, ()))
                for s in alive:
                    if w in self.step[s]:
                        now |= self.step[s][w]
                    now |= self.any[s]
                alive = now
                if not alive:
                    break
                found.update(self.accepts[s] for s in alive & self.accepts.keys())
        return found


def scanner(templates: dict = TEMPLATES, phrases: dict = PHRASES):
    """make() for map_text."""

    def make():
        matcher = Matcher(templates)
        plain = [(tuple(p.encode().split()), label) for p, label in phrases.items()]

        def scan(texts: list) -> list:
            out = [[] for _ in range(7)]
            for b in texts:
                words = WORD.findall((b or b"").lower())  # bytes.lower() folds A-Z only
                places, base, labels = [], set(), set()
                known = set(words)
                for need, label in plain:
                    if known.issuperset(need):
                        own = [i for i, w in enumerate(words) if w == need[0] and tuple(words[i : i + len(need)]) == need]
                        places += own
                        base |= {label} if own else set()
                if not known.isdisjoint(matcher.first):
                    labels = matcher.labels(words)
                row = (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if labels else 0.5 if base else 0.0)
                for col, v in zip(out, row, strict=True):
                    col.append(v)
            return out

        return scan

    return make


def license_scan(docs: DataFrame, text: str = "text", carry: list[str] | None = None, templates: dict = TEMPLATES) -> DataFrame:
    """`row` and the columns of FIELDS. score: 1 where a template accepts, 0.5 where only a base phrase stands, else 0."""
    return map_text(docs, scanner(templates), FIELDS, text, carry)
