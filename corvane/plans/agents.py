"""The question loop on the driver: plan, dispatch, validate. Data work is done by the callables it is given.

llm(prompt) -> text may raise; retrieve(question, k) gives (answer text, citations); overview() gives counts and the
most imported modules as text; memory has save(content) and listing().
"""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Callable
from dataclasses import dataclass, field

OFFLINE = "No language model is configured."
#: Who counts as having worked on a question, by the way it took.
USED = {"ask": ["planner", "retrieval", "mentor", "validator"], "fast": ["retrieval", "mentor"], "general": ["mentor"], "generate": ["retrieval", "mentor"]}


def offline(prompt: str) -> str:
    return OFFLINE


@dataclass
class State:
    question: str
    repo_id: str | None = None
    plan: dict = field(default_factory=dict)
    step: int = 0
    results: list[str] = field(default_factory=list)
    citations: list[str] = field(default_factory=list)
    answer: str = ""
    validated: bool = False


def keyword_plan(question: str) -> dict:
    low = question.lower()
    agent = "analyst" if "explain" in low or "overview" in low else "retrieval"
    return {"steps": [{"agent": agent, "instruction": question}]}


def unfenced(text: str) -> str:
    t = text.strip()
    return t[7:-3] if t.startswith("```json") else t[3:-3] if t.startswith("```") else t


def citations_in(text: str) -> list[str]:
    _, _, rest = text.partition("Citations:")
    return [x.strip()[2:].strip() for x in rest.splitlines() if x.strip().startswith("- ")]


def authorized(enabled: bool, expected: str | None, given: str | None) -> int:
    """200; 500 where a key is needed and none is set; 401 for another one."""
    return 200 if not enabled or expected and given == expected else 401 if expected else 500


@dataclass
class Engine:
    retrieve: Callable[[str, int], tuple[str, list[str]]]
    overview: Callable[[], str] = lambda: ""
    memory: object | None = None
    llm: Callable[[str], str] | None = None

    def plan(self, question: str) -> dict:
        """By keywords without a model; with one its own plan, or one retrieval step where it fails or gives no plan."""
        if self.llm is None:
            return keyword_plan(question)
        try:
            plan = json.loads(unfenced(self.llm(f"Plan the steps, as JSON, to answer: {question}")))
            if isinstance(plan, dict):
                return plan
        except Exception as e:
            logging.getLogger(__name__).warning("no plan from the model: %s", e)
        return {"steps": [{"agent": "retrieval", "instruction": question}]}

    def say(self, prompt: str) -> str:
        return (self.llm or offline)(prompt)

    def search(self, question: str, k: int = 5) -> str:
        answer, cited = self.retrieve(question, k)
        return "\n".join([f"Answer: {answer}", "Citations:", *[f"- {c}" for c in cited]])

    def mentor(self, prompt: str) -> str:
        answer, _ = self.retrieve(prompt, 3)
        return self.say(f"{prompt}\n\nContext: {answer}")

    def remember(self, text: str) -> str:
        t = text.strip()
        if self.memory is not None and t.lower().startswith("save:"):
            self.memory.save(t[5:].strip())
            return "Saved."
        if self.memory is not None and t.lower() == "list":
            return "\n".join(self.memory.listing()) or "Nothing saved."
        return "Use `save: text` or `list`."

    def agent(self, name: str) -> Callable[[str], str] | None:
        return {"retrieval": self.search, "analyst": lambda p: self.say(f"{p}\n\n{self.overview()}"), "mentor": self.mentor, "memory": self.remember}.get(name)

    def route(self, s: State) -> str:
        """The next agent; `validator` once after the last step; `end` then, and for an unknown agent. A step without
        an agent is one of retrieval; letter case doesn't matter."""
        steps = s.plan.get("steps") or []
        if s.step >= len(steps):
            return "end" if s.validated else "validator"
        name = str(steps[s.step].get("agent") or "retrieval").lower()
        return name if self.agent(name) else "end"

    def execute(self, s: State, name: str) -> None:
        instruction = s.plan["steps"][s.step].get("instruction", s.question)
        prompt = instruction + ("\n\nContext so far:\n" + "\n".join(s.results) if s.results else "")
        try:
            out = self.agent(name)(prompt)
        except Exception as e:
            out = f"Error in {name}: {e}"
        if name == "retrieval":
            s.citations += citations_in(out)
        s.step += 1
        s.results.append(f"Step {s.step} ({name}): {out}")
        s.answer = out

    def validate(self, s: State) -> None:
        s.validated = True
        if s.answer:
            try:
                s.answer = self.mentor(f"Check and finish this answer to: {s.question}\n\n{s.answer}")
            except Exception as e:
                logging.getLogger(__name__).warning("the answer stays as it is: %s", e)
            s.results.append("Validation: the answer was gone over.")

    def ask(self, question: str, repo_id: str | None = None) -> dict:
        s = State(question, repo_id, self.plan(question))
        while (name := self.route(s)) != "end":
            self.validate(s) if name == "validator" else self.execute(s, name)
        return {"answer": s.answer or "No answer.", "citations": s.citations, "reasoning_steps": [json.dumps(s.plan), *s.results]}

    def fast(self, question: str) -> dict:
        found = self.search(question)
        return {"answer": self.mentor(f"{question}\n\n{found}"), "citations": citations_in(found), "reasoning_steps": [found]}

    def generate(self, request: str) -> dict:
        found = self.search(request)
        cited = citations_in(found)
        return {"diff": self.mentor(f"Write the change for: {request}\n\n{found}"), "notes": ["Based on the cited places."] if cited else [], "citations": cited}

    def explain(self, node: str, lines_of: Callable[[str, int | None, int | None], list[str] | None]) -> dict:
        """A node id is path or path:start-end; without a range the first 200 lines."""
        m = re.match(r"^(.*?):(\d+)-(\d+)$", node)
        path, a, b = (m[1], int(m[2]), int(m[3])) if m else (node, None, None)
        lines = lines_of(path, a, b)
        if lines is None:
            return {"node_id": node, "summary": "Not found.", "snippet": ""}
        snippet = "\n".join(lines[max(a - 1, 0) : max(b, a)] if m else lines[:200])
        try:
            summary = self.say(f"Explain:\n{snippet}")
        except Exception as e:
            summary = f"Explanation failed: {e}"
        return {"node_id": node, "summary": summary, "snippet": snippet}


def overview_text(counts: dict, top: list[tuple[str, int]]) -> str:
    """What the analyst is told: counts of a repository (as a row of the overview) and its most used modules."""
    return "\n".join([f"Files: {counts['file_count']}", f"Functions: {counts['function_count']}", f"Dependency edges: {counts['dependency_edges']}", f"Most used modules: {', '.join(f'{m} ({n})' for m, n in top)}"])


def model_of(provider: str, models: dict[str, Callable[[str], str]]) -> Callable[[str], str]:
    """The configured provider's model; of an unknown one the model that says none is configured."""
    return models.get(provider, offline)


class NotFound(KeyError):
    """An unknown repository or node."""


class Requests:
    """The requests a client makes, over an engine's tables; `repo` of an unknown repository raises NotFound.

    overview: (repo_id, name, file_count, function_count, dependency_edges, ...); edges: (repo_id, source, target);
    search(repo_id, question, k) gives a DataFrame of record_id, scope and metadata, k rows at most.
    """

    def __init__(self, overview, edges, search, files=None):
        self.overview, self.edges, self.search_in, self.files = overview, edges, search, files

    def content(self, repo_id: str, path: str) -> dict:
        """A file's content, lines and the language of its suffix; files: (repo_id, path, content)."""
        from pyspark.sql import functions as F

        from corvane.functions.text import view_language

        self.repo(repo_id)
        row = self.files.where((F.col("repo_id") == repo_id) & (F.col("path") == path)).select("content", view_language(F.col("path")).alias("language")).first()
        if row is None or row["content"] is None:
            raise NotFound(f"File not found: {path}")
        return {"path": path, "content": row["content"], "language": row["language"], "line_count": row["content"].count("\n") + 1}

    def repos(self) -> list[dict]:
        return [r.asDict() for r in self.overview.select("repo_id", "name").orderBy("repo_id").toLocalIterator()]

    def repo(self, repo_id: str) -> dict:
        row = self.overview.where(self.overview["repo_id"] == repo_id).first()
        if row is None:
            raise NotFound(f"Repository not found: {repo_id}")
        return row.asDict()

    def neighbours(self, repo_id: str, node: str, direction: str = "inbound") -> list[str]:
        """Sorted neighbours of a node that some edge of the repository has."""
        from corvane.operators import graph

        self.repo(repo_id)
        e = self.edges.where(self.edges["repo_id"] == repo_id)
        if not e.where((e["source"] == node) | (e["target"] == node)).limit(1).count():
            raise NotFound(f"Node not found: {node}")
        return sorted(r["neighbour"] for r in graph.neighbours(e, node, direction).toLocalIterator())

    def analysed(self, repo_id: str, k: int = 5) -> str:
        """The analyst's overview of a repository; ties of modules by name."""
        from pyspark.sql import functions as F

        e = self.edges.where(self.edges["repo_id"] == repo_id)
        top = e.groupBy("target").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target").limit(k).collect()
        return overview_text(self.repo(repo_id), [(r["target"], r["n"]) for r in top])

    def search(self, repo_id: str, question: str, k: int = 5) -> list[dict]:
        self.repo(repo_id)
        return [r.asDict() for r in self.search_in(repo_id, question, k).toLocalIterator()]
