"""Bounded breadth-first walks: callers, callees, impact, shortest path. One join a level, for all nodes of it.

A level joins the frontier with the edges. Callers and callees show the hundred best edges of a node: a ranked
window, whose limit Spark applies before the shuffle as well, so a node with very many edges does not gather them in
one task. Impact and path go over all edges, grouped by the node that they lead to; partial groups are made before
the shuffle. A frontier of FEW keys at most is looked up in the table by their values, which a table that is sorted by
its end answers from the row groups that hold them; a larger one is joined, and broadcast by Spark when it is small
enough. Every level is checkpointed: plans stay short."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.plans.runtime import cut

EDGES_PER_NODE = 100
#: Keys that are looked up by value; more are joined.
FEW = 500
#: Values of one pushed list: Spark hands lists up to this length to the scan value by value, longer ones as a range.
_LIST = 10

STEP = "step int, from_key string, to_key string, edge_type string, confidence double"

#: Types that carry impact backwards.
IMPACT_TYPES = (
    "calls", "routes_to", "renders", "dispatches", "schedules", "listens", "observes", "injects",
    "instantiates", "resolves", "links_route", "includes", "uses_component", "documents", "requests",
)


def few(keys: DataFrame) -> list[str] | None:
    """The values of a table of one column, or None where it has more than FEW rows. Never more than these reach the driver."""
    rows = keys.limit(FEW + 1).collect()
    return [x[0] for x in rows] if len(rows) <= FEW else None


def at_keys(rows: DataFrame, column: str, keys: DataFrame, values: list[str] | None) -> DataFrame:
    """The rows whose column is one of the keys (one column, known as `values` if few). Null is no key."""
    if values is None:
        return rows.join(keys.toDF("at"), F.col(column) == F.col("at"), "left_semi")
    known = sorted({v for v in values if v is not None})
    wanted = F.lit(False)
    for k in range(0, len(known), _LIST):
        wanted = wanted | F.col(column).isin(known[k : k + _LIST])
    return rows.where(wanted)


def _best(rows: DataFrame, near: str, far: str) -> DataFrame:
    order = Window.partitionBy(near).orderBy(F.desc_nulls_last("confidence"), "type", far)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= EDGES_PER_NODE)


def _walk(edges: DataFrame, key: str, depth: int, near: str, far: str, keep: Column | None) -> DataFrame:
    frontier, values = edges.sparkSession.createDataFrame([(key,)], "at string"), [key]
    visited, out = frontier, None
    for level in range(1, max(1, depth) + 1):
        best = _best(at_keys(edges, near, frontier, values), near, far)
        step = best.where(keep) if keep is not None else best
        step = cut(step.select(F.lit(level).alias("depth"), "from_key", "to_key", F.col("type").alias("edge_type"), "confidence"))
        out = step if out is None else out.unionByName(step)
        if level == depth:
            break
        frontier = cut(step.select(F.col(far).alias("at")).distinct().join(visited, "at", "left_anti"))
        values = few(frontier)
        if values == []:
            break
        visited = visited.unionByName(frontier)
    return out


def callers(edges: DataFrame, key: str, depth: int = 1, min_confidence: float = 0.0) -> DataFrame:
    """A row for each incoming edge met (any type), the hundred best of a node before the confidence filter;
    a null confidence counts as 0. Nodes met before are shown again, but walked through once."""
    return _walk(edges, key, depth, "to_key", "from_key", F.coalesce("confidence", F.lit(0.0)) >= min_confidence)


def callees(edges: DataFrame, key: str, depth: int = 1) -> DataFrame:
    return _walk(edges, key, depth, "from_key", "to_key", None)


def impact(nodes: DataFrame, edges: DataFrame, key: str, depth: int = 3, min_confidence: float = 0.0) -> DataFrame:
    """What depends on a node (for a class, on its methods too): each key once, at its least depth, with the
    edge type it was met by (the first in order of name). Edges without confidence always count."""
    spark = edges.sparkSession
    used = edges.where(F.col("type").isin(*IMPACT_TYPES) & (F.col("confidence").isNull() | (F.col("confidence") >= min_confidence)))
    start = spark.createDataFrame([(key,)], "at string")
    owned = edges.where((F.col("type") == "declares") & (F.col("from_key") == key))
    frontier, values = start, [key]
    if key.startswith("class:"):
        declared = cut(owned.select("to_key").distinct())
        methods = at_keys(nodes.where("type = 'method'"), "key", declared, few(declared)).select(F.col("key").alias("at"))
        frontier = cut(start.unionByName(methods).distinct())
        values = few(frontier)
    walked, found = frontier, None
    for level in range(1, max(1, depth) + 1):
        met = at_keys(used, "to_key", frontier, values).groupBy(F.col("from_key").alias("key")).agg(F.min("type").alias("via"))
        if found is not None:
            met = met.join(found.select("key"), "key", "left_anti")
        met = cut(met.withColumn("depth", F.lit(level)))
        found = met if found is None else found.unionByName(met)
        if level == depth:
            break
        frontier = cut(met.select(F.col("key").alias("at")).join(walked, "at", "left_anti"))
        values = few(frontier)
        if values == []:
            break
        walked = walked.unionByName(frontier)
    kind = F.col("kind")
    bucket = (
        F.when(F.col("type") == "class", F.when(kind == "job", "jobs").when(kind == "command", "commands").otherwise("classes"))
        .when(F.col("type") == "route", "routes").when(F.col("type") == "view", "views").when(F.col("type") == "method", "methods")
        .when(F.col("type") == "section", "docs").when(F.col("type") == "file", "js_files").otherwise("classes")
    )
    keys = found.select("key")
    return found.join(at_keys(nodes, "key", keys, few(keys)), "key").select("key", "name", "depth", "via", bucket.alias("bucket"))


def path(edges: DataFrame, start: str, end: str, max_depth: int = 6) -> DataFrame | None:
    """Steps (step, from_key, to_key, edge_type, confidence) of a shortest path over all edges; no rows if start is
    end, None if `end` is not met. Of several parents the least key wins, of its edges to a node the best."""
    spark = edges.sparkSession
    if start == end:
        return spark.createDataFrame([], STEP)
    frontier, values = spark.createDataFrame([(start,)], "at string"), [start]
    visited, levels = frontier, []
    sure = F.col("confidence")
    order = F.struct("from_key", sure.isNull(), ~F.isnan(sure), -sure, "type")  # of confidences the highest first, as in _best
    parent = F.min_by(F.struct("from_key", "type", "confidence"), order)
    for level in range(1, max_depth + 1):
        reached = at_keys(edges, "from_key", frontier, values)
        if level == max_depth:
            reached = reached.where(F.col("to_key") == end)  # nothing goes on from the others
        found = reached.groupBy(F.col("to_key").alias("at")).agg(parent.alias("p")).join(visited, "at", "left_anti")
        met = cut(found.select("at", "p.from_key", "p.type", "p.confidence"))
        levels.append(met)
        if not met.where(F.col("at") == end).isEmpty():
            break
        frontier = met.select("at")
        values = few(frontier)
        if values == []:
            return None
        visited = visited.unionByName(frontier)
    else:
        return None
    at, steps = end, []
    for n in range(len(levels), 0, -1):  # one row a level
        row = levels[n - 1].where(F.col("at") == at).first()
        steps.append((n, row.from_key, at, row.type, row.confidence))
        at = row.from_key
    return spark.createDataFrame(steps[::-1], STEP)
