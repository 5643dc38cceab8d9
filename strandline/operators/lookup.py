"""Lookups: search with ranking, exact matches, suggestions, one node's detail, listings and counts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import ascii_lower, short_name

CANDIDATES = 25
SUGGESTIONS = 5
#: Rows of an answer that come to the driver at once.
PAGE = 1000
SUGGESTION_SCORE = 0.6


#: Letters of a gram: a search for fewer letters in a row than these reads all nodes.
GRAM = 3


def lower(text: str) -> str:
    """A-Z in lower case, all other letters as they are."""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@dataclass
class Index:
    """Grams of all keys (gram, key), sorted by gram, and names (name, key), sorted by name: a search reads the row
    groups of its own grams and name."""

    grams: DataFrame
    names: DataFrame

    @staticmethod
    def tables(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The two tables, to be sorted and stored. A gram that very many keys hold fills as many ranges as it needs."""
        folded = ascii_lower(F.col("key"))
        at = F.sequence(F.lit(1), F.length(folded) - GRAM + 1)
        grams = nodes.where(F.length("key") >= GRAM).select(F.explode(F.array_distinct(F.transform(at, lambda i: F.substr(folded, i, F.lit(GRAM))))).alias("gram"), "key")
        return grams.repartitionByRange("gram", "key").sortWithinPartitions("gram"), nodes.select("name", "key").repartitionByRange("name", "key").sortWithinPartitions("name")

    def keys(self, name: str) -> DataFrame | None:
        """(key) of all nodes that can match; None if the name has no gram, and all nodes can."""
        wanted = sorted({part[i : i + GRAM] for part in re.split("[%_]", lower(name)) for i in range(len(part) - GRAM + 1)})
        if not wanted:
            return None
        holding = self.grams.where(F.col("gram").isin(wanted)).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("key")
        return holding.unionByName(self.names.where(F.col("name") == name).select("key")).distinct()


def candidates(nodes: DataFrame, name: str, type_: str | None = None, limit: int = CANDIDATES, index: Index | None = None) -> DataFrame:
    """Nodes whose key or name is `name` or whose key holds it (% and _ are wildcards, case is ignored for
    A-Z), the likeliest first: same key, same name, a name that ends in a backslash and `name`; then by key. With an
    index only nodes that can match are read."""
    same_key, same_name = F.col("key") == name, F.col("name") == name
    tail = ascii_lower(F.col("name")).endswith(lower("\\" + name))
    if index is not None and (keys := index.keys(name)) is not None:
        nodes = nodes.join(keys, "key", "left_semi")
    found = nodes.where(same_key | same_name | ascii_lower(F.col("key")).like("%" + lower(name).replace("\\", "\\\\") + "%"))
    if type_ is not None:
        found = found.where(F.col("type") == type_)
    rank = lambda c: c.cast("int").desc()
    return found.orderBy(rank(same_key), rank(same_name), rank(tail), "key").limit(limit)


def routes_by_uri(nodes: DataFrame, uri: str) -> DataFrame:
    """Routes of one URI under any verb, with or without its first slash; A-Z are compared without case, and % and _
    stand for themselves."""
    path = lower("/" + uri.lstrip("/"))
    return nodes.where((F.col("type") == "route") & F.col("key").startswith("route:") & ascii_lower(F.col("key")).endswith(" " + path))


def is_exact(name: str) -> Column:
    """Same key, same name, or same name behind the last backslash; case counts."""
    return (F.col("key") == name) | (F.col("name") == name) | (short_name(F.col("name")) == name)


@dataclass
class Answer:
    """What a tool found: rows with a confidence, or suggestions when there is no exact answer."""

    found: bool
    rows: DataFrame | None = None
    confidence: float | None = None
    suggestions: DataFrame | None = None

    def envelope(self, tool: str, args: dict, page: int = PAGE, offset: int = 0, graph: dict | None = None) -> dict:
        """The answer as a plain dictionary: no more than `page` of its rows from `offset` on, with `next` where more
        follow (rows keep the order that the tool gave them), and what is known of the graph."""
        out: dict = {"found": self.found, "query": {"tool": tool, **args}}
        if graph is not None:
            out["graph"] = graph
        rows = lambda df: [x.asDict(recursive=True) for x in df.offset(offset).limit(page + 1).collect()]
        if self.found:
            out["result"] = rows(self.rows)
            if len(out["result"]) > page:
                out["result"], out["next"] = out["result"][:page], offset + page
            if self.confidence is not None:
                out["confidence"] = self.confidence
        elif self.suggestions is not None:
            out["suggestions"] = rows(self.suggestions)
        return out


def suggestions(nodes: DataFrame, name: str, index: Index | None = None) -> DataFrame:
    return candidates(nodes, name, index=index).limit(SUGGESTIONS).select("key", "name", "type", F.lit(SUGGESTION_SCORE).alias("score"))


def find(nodes: DataFrame, name: str, type_: str | None = None, fuzzy: bool = False, index: Index | None = None) -> Answer:
    """Exact matches with confidence 1; with `fuzzy` and no exact one, all candidates with 0.6."""
    some = candidates(nodes, name, type_, index=index)
    exact = some.where(is_exact(name))
    if not exact.isEmpty():
        return Answer(True, exact, 1.0)
    if not fuzzy:
        return Answer(False, suggestions=suggestions(nodes, name, index))
    return Answer(False) if some.isEmpty() else Answer(True, some, SUGGESTION_SCORE)


def node(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """A node with its numbers of outgoing and incoming edges by type: (key, name, node_type, file, direction, edge_type,
    n), and its `line` and `meta` where nodes have these."""
    out = edges.where(F.col("from_key") == key).groupBy("type").agg(F.count("*").alias("n")).select(F.lit("out").alias("direction"), F.col("type").alias("edge_type"), "n")
    into = edges.where(F.col("to_key") == key).groupBy("type").agg(F.count("*").alias("n")).select(F.lit("in").alias("direction"), F.col("type").alias("edge_type"), "n")
    one = nodes.where(F.col("key") == key)
    counts = out.unionByName(into).withColumn("key", F.lit(key))
    return one.join(counts, "key", "left").select("key", "name", F.col("type").alias("node_type"), "file", *[c for c in ("line", "meta") if c in nodes.columns], "direction", "edge_type", "n")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, type, n): numbers of nodes and edges by type."""
    count = lambda df, what: df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "type", "n")
    return count(nodes, "node").unionByName(count(edges, "edge"))


def unresolved(rows: DataFrame, file: str | None = None, member: str | None = None, limit: int = 50) -> DataFrame:
    """The newest unresolved references (by id), of files whose path holds `file` and of one member."""
    if file is not None:
        rows = rows.where(F.col("file").ilike(f"%{file}%"))
    if member is not None:
        rows = rows.where(F.col("member") == member)
    return rows.orderBy(F.desc("id")).limit(max(1, limit))


def unresolved_ratio(edges: DataFrame, n_unresolved: DataFrame) -> DataFrame:
    """(edges, unresolved, ratio, healthy): the share of references that no edge stands for."""
    both = edges.agg(F.count("*").alias("edges")).crossJoin(n_unresolved.agg(F.count("*").alias("unresolved")))  # one row each
    ratio = F.round(F.col("unresolved") / F.greatest(F.col("edges") + F.col("unresolved"), F.lit(1)), 3)
    return both.withColumn("ratio", ratio).withColumn("healthy", F.col("ratio") < 0.5)


def resolution_histogram(edges: DataFrame) -> DataFrame:
    return edges.where("type = 'calls'").groupBy("resolution").agg(F.count("*").alias("n"), F.sum((F.col("confidence") >= 0.8).cast("long")).alias("sure"))
