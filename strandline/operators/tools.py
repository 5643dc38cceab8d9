"""Walks asked for by key: what they find, or suggestions for a key that is no node's.

A key is looked up exactly; a missing one is answered with the likeliest nodes (lookup.suggestions), and that miss
may be kept as a row. Impact alone goes on with the likeliest node instead, and has suggestions only where no node
is like the key at all. The lookups read one node, or a handful."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import lookup, traverse
from strandline.operators.lookup import Answer


def _missing(nodes: DataFrame, key: str) -> bool:
    return nodes.where(F.col("key") == key).isEmpty()


def callers(nodes: DataFrame, edges: DataFrame, key: str, depth: int = 1, min_confidence: float = 0.0) -> Answer:
    if _missing(nodes, key):
        return Answer(False, suggestions=lookup.suggestions(nodes, key))
    return Answer(True, traverse.callers(edges, key, depth, min_confidence))


def callees(nodes: DataFrame, edges: DataFrame, key: str, depth: int = 1) -> Answer:
    if _missing(nodes, key):
        return Answer(False, suggestions=lookup.suggestions(nodes, key))
    return Answer(True, traverse.callees(edges, key, depth))


def impact(nodes: DataFrame, edges: DataFrame, key: str, depth: int = 3, min_confidence: float = 0.0) -> Answer:
    if _missing(nodes, key):
        likeliest = lookup.candidates(nodes, key).select("key").first()
        if likeliest is None:
            return Answer(False, suggestions=lookup.suggestions(nodes, key))
        key = likeliest.key
    return Answer(True, traverse.impact(nodes, edges, key, depth, min_confidence))


def path(nodes: DataFrame, edges: DataFrame, start: str, end: str, max_depth: int = 6) -> Answer:
    """Suggestions for either end that is missing; no rows (None) where no path is short enough."""
    missing = [k for k in (start, end) if _missing(nodes, k)]
    if missing:
        found = [lookup.suggestions(nodes, k) for k in missing]
        return Answer(False, suggestions=found[0] if len(found) == 1 else found[0].unionByName(found[1]))
    return Answer(True, traverse.path(edges, start, end, max_depth))


def miss(answer: Answer, tool: str, key: str, now: Column) -> DataFrame | None:
    """The row (tool, key, suggested, at) of a question without an answer, to be added to a table of misses."""
    if answer.found or answer.suggestions is None:
        return None
    return answer.suggestions.agg(F.sort_array(F.collect_list("key")).alias("suggested")).select(F.lit(tool).alias("tool"), F.lit(key).alias("key"), "suggested", now.alias("at"))
