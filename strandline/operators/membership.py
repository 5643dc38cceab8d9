"""Communities that were computed once and are read from then on: memberships, summaries, and when they were made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import analysis
from strandline.operators.builds import value
from strandline.operators.lookup import Answer
from strandline.operators.versions import Commit, Delta, Log
from strandline.plans.runtime import cut

SUMMARY = "communities"


def store(log: Log, found: DataFrame, nodes: DataFrame, edges: DataFrame, now: str, resolution: float = 1.0) -> Commit:
    """Write memberships (key, community), their summaries, time and resolution in one commit: all old ones go."""
    degree = analysis.degrees(nodes, analysis.projection(nodes, edges))
    found = cut(found.select("key", "community"))
    new = {"membership": found, SUMMARY: analysis.community_summary(found, degree), "meta": log.spark.createDataFrame([("communities_computed_at", now), ("communities_resolution", str(resolution))], "key string, value string")}

    def deltas(at: int) -> dict[str, Delta]:
        there = log.tables(at) if at else []
        whole = lambda name: Delta(new[name], log.rows(name, at) if name in there else None)
        return {"membership": whole("membership"), SUMMARY: whole(SUMMARY), "meta": log.put("meta", new["meta"], ["key"], at)}

    return log.change(deltas, kind="communities")


def membership(log: Log) -> DataFrame | None:
    """(key, community) as stored; None before they are."""
    return log.read("membership") if "membership" in log.tables() else None


def summary(log: Log) -> Answer:
    """The stored communities, the largest first, with their time and resolution; not found before they are stored."""
    if SUMMARY not in log.tables():
        return Answer(False)
    rows = log.read(SUMMARY).withColumns({"computed_at": F.lit(value(log, "communities_computed_at")), "resolution": F.lit(value(log, "communities_resolution"))})
    return Answer(True, rows.orderBy(F.desc("size"), "community"))


def hubs(log: Log, nodes: DataFrame, edges: DataFrame, limit: int = 20, types: list[str] | None = None) -> DataFrame:
    """(key, type, degree, bridges) of the nodes of largest degree; bridges is null while no communities are stored."""
    weights = cut(analysis.projection(nodes, edges))
    top = analysis.hubs(analysis.degrees(nodes, weights), limit, types)
    found = membership(log)
    if found is None:
        return top.withColumn("bridges", F.lit(None).cast("long"))
    return top.join(analysis.bridges(weights, found), "key", "left").select("key", "type", "degree", "bridges")
