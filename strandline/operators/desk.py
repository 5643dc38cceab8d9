"""Tools by name over a graph in a log: what each takes, its answer, and a row kept of every question without one.

A tool is a function of a Desk and checked arguments that returns an Answer; `Desk.add` takes more of them. An answer of
no rows is an answer; one that was not found is appended to the table `misses` of the log, with the few keys that were
suggested instead. What a tool finds stays a DataFrame (`ask`); `envelope` brings a page of it to the driver."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import builds, lookup, membership, models, summaries, tools
from strandline.operators.lookup import PAGE, Answer
from strandline.operators.versions import Delta, Log

MISS = "tool string, args string, suggested array<string>, asked_at string"
REQUIRED = object()


@dataclass(frozen=True)
class Argument:
    kind: type
    default: object = REQUIRED
    least: float | None = None
    most: float | None = None

    def take(self, name: str, value: object):
        """The value as the tool gets it: numbers are brought into their bounds, other kinds are refused."""
        if value is None and self.default is None:
            return None
        number = self.kind in (int, float) and isinstance(value, int | float) and not isinstance(value, bool)
        if not (isinstance(value, self.kind) and isinstance(value, bool) == (self.kind is bool)) and not (self.kind is float and number):
            raise TypeError(f"{name} has to be of type {self.kind.__name__}")
        if number:
            value = self.kind(value if self.least is None else max(value, self.least))
            value = self.kind(value if self.most is None else min(value, self.most))
        return value


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    arguments: dict[str, Argument]
    handle: Callable[..., Answer]

    def checked(self, given: dict) -> dict:
        """All arguments, defaults among them. Unknown and missing ones raise TypeError."""
        if unknown := sorted(set(given) - set(self.arguments)):
            raise TypeError(f"{self.name} takes no {', '.join(unknown)}")
        if missing := [n for n, a in self.arguments.items() if a.default is REQUIRED and n not in given]:
            raise TypeError(f"{self.name} needs {', '.join(missing)}")
        return {n: a.take(n, given[n]) if n in given else a.default for n, a in self.arguments.items()}

    def schema(self) -> dict:
        """What it takes, as JSON Schema."""
        kinds = {str: "string", int: "integer", float: "number", bool: "boolean", list: "array"}
        bounds = lambda a: {k: v for k, v in (("minimum", a.least), ("maximum", a.most)) if v is not None}
        said = {n: {"type": kinds[a.kind], **bounds(a), **({} if a.default in (REQUIRED, None) else {"default": a.default})} for n, a in self.arguments.items()}
        return {"type": "object", "properties": said, "required": [n for n, a in self.arguments.items() if a.default is REQUIRED]}


def _keyed(desk: Desk, key: str, rows: Callable[[], DataFrame]) -> Answer:
    if desk.nodes.where(F.col("key") == key).isEmpty():
        return Answer(False, suggestions=lookup.suggestions(desk.nodes, key, desk.index))
    return Answer(True, rows())


def _route(desk: Desk, name: str) -> Answer:
    found = summaries.route_detail(desk.nodes, desk.edges, name)
    return Answer(False) if found.isEmpty() else Answer(True, found)


def _path(desk: Desk, start: str, end: str, depth: int) -> Answer:
    found = tools.path(desk.nodes, desk.edges, start, end, depth)
    return Answer(False) if found.found and found.rows is None else found


_KEY, _DEPTH, _SURE = Argument(str), Argument(int, 1, 1, 10), Argument(float, 0.0, 0.0, 1.0)

TOOLS = (
    Tool("find", "Nodes by key or name", {"name": Argument(str), "type": Argument(str, None), "fuzzy": Argument(bool, False)}, lambda d, name, type, fuzzy: lookup.find(d.nodes, name, type, fuzzy, d.index)),
    Tool("node", "A node with its numbers of edges", {"key": _KEY}, lambda d, key: _keyed(d, key, lambda: lookup.node(d.nodes, d.edges, key))),
    Tool("callers", "What leads to a node", {"key": _KEY, "depth": _DEPTH, "min_confidence": _SURE}, lambda d, **a: tools.callers(d.nodes, d.edges_in, **a)),
    Tool("callees", "What a node leads to", {"key": _KEY, "depth": _DEPTH}, lambda d, **a: tools.callees(d.nodes, d.edges, **a)),
    Tool("impact", "What depends on a node", {"key": _KEY, "depth": replace(_DEPTH, default=3), "min_confidence": _SURE}, lambda d, **a: tools.impact(d.nodes, d.edges_in, **a)),
    Tool("path", "A shortest path between two nodes", {"start": _KEY, "end": _KEY, "depth": replace(_DEPTH, default=6)}, _path),
    Tool("route", "A route by name or address", {"name": Argument(str)}, _route),
    Tool("view", "Who renders a view, and what it uses", {"name": Argument(str)}, lambda d, name: _keyed(d, f"view:{name}", lambda: summaries.view(d.edges, name))),
    Tool("model", "A model with its table and relations", {"name": Argument(str)}, lambda d, name: models.model(d.nodes, d.edges, name)),
    Tool("docs", "Sections that document a node, and what it documents", {"key": _KEY}, lambda d, key: _keyed(d, key, lambda: summaries.docs(d.edges, key))),
    Tool("hubs", "Nodes of largest degree", {"limit": Argument(int, 20, 1, 1000), "types": Argument(list, None)}, lambda d, limit, types: Answer(True, membership.hubs(d.log, d.nodes, d.edges, limit, types).orderBy(F.desc("degree"), "key"))),
    Tool("communities", "Communities as they are stored", {}, lambda d: membership.summary(d.log)),
    Tool("unresolved", "The newest references that nothing stands for", {"file": Argument(str, None), "member": Argument(str, None), "limit": Argument(int, 50, 1, 1000)}, lambda d, **a: Answer(True, lookup.unresolved(d.unresolved, **a))),
    Tool("stats", "Numbers of nodes and edges by type", {}, lambda d: Answer(True, lookup.stats(d.nodes, d.edges).orderBy("what", "type"))),
)


class Desk:
    """Answers questions about nodes and edges. `edges_in` may be the same edges sorted by their end. Columns that a tool
    wants and a graph lacks (meta, file, unresolved references) count as empty."""

    def __init__(self, log: Log, nodes: DataFrame, edges: DataFrame, edges_in: DataFrame | None = None, index: lookup.Index | None = None, unresolved: DataFrame | None = None, clock: Callable[[], str] | None = None):
        filled = lambda df, **more: df.withColumns({k: v for k, v in more.items() if k not in df.columns})
        self.log, self.index = log, index
        self.nodes, self.edges = filled(nodes, meta=F.parse_json(F.lit("{}"))), filled(edges, meta=F.parse_json(F.lit("{}")), file=F.lit(None).cast("string"))
        self.edges_in = self.edges if edges_in is None else edges_in
        self.unresolved = log.spark.createDataFrame([], "id long, file string, member string") if unresolved is None else unresolved
        self.clock = clock or (lambda: datetime.now(timezone.utc).isoformat(timespec="seconds"))
        self.tools = {t.name: t for t in TOOLS}

    def add(self, tool: Tool) -> Desk:
        """One more tool, or another one of that name."""
        self.tools[tool.name] = tool
        return self

    def _asked(self, name: str, given: dict) -> tuple[Answer, list[str]]:
        tool = self.tools[name]
        found = tool.handle(self, **tool.checked(given))
        if found.found:
            return found, []
        likely = [] if found.suggestions is None else [r.key for r in found.suggestions.limit(2 * lookup.SUGGESTIONS).collect()]
        row = self.log.spark.createDataFrame([(name, json.dumps(given, sort_keys=True), likely, self.clock())], MISS)
        self.log.change(lambda at: {"misses": Delta(row)}, kind="miss")
        return found, likely

    def ask(self, name: str, /, **given) -> Answer:
        """The tool's answer. KeyError for an unknown tool, TypeError for arguments that it does not take: these are no
        misses, and nothing is kept of them."""
        return self._asked(name, given)[0]

    def misses(self) -> DataFrame:
        return self.log.read("misses") if "misses" in self.log.tables() else self.log.spark.createDataFrame([], MISS)

    def graph(self) -> dict:
        """What answers rest on: the version of the log and its last build."""
        newest = builds.last(self.log)
        return {"version": self.log.version(), "build": None if newest is None else newest.first().asDict()}

    def envelope(self, name: str, given: dict, page: int = PAGE, offset: int = 0) -> dict:
        """A page of the answer as a plain dictionary, with the state of the graph that it was asked of."""
        graph = self.graph()
        found, likely = self._asked(name, given)
        if not found.found:
            return {"found": False, "query": {"tool": name, **given}, "suggestions": [{"key": k, "score": lookup.SUGGESTION_SCORE} for k in likely], "graph": graph}
        return found.envelope(name, given, page, offset, graph)
