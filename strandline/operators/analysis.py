"""Graph analysis: the weighted projection, degrees, hubs by percentile, bridges, and summaries of communities.

Weights are whole numbers, so sums do not depend on their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import namespace

#: Edge types of the projection, and node types that can be an end of them.
PROJECTED = ("calls", "injects", "instantiates", "routes_to", "renders", "includes", "relates", "dispatches", "listens")
ELIGIBLE = ("class", "method", "route", "view", "function")

PERCENTILE = 0.99


def eligible(nodes: DataFrame) -> DataFrame:
    own = F.coalesce("is_project", F.lit(True)) | ~F.col("type").isin("class", "method")
    return nodes.where(F.col("type").isin(*ELIGIBLE) & own).select("key", "type")


def projection(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected weights (a, b, w), a < b: the number of edges between two eligible nodes."""
    some = eligible(nodes).select("key")
    rows = edges.where(F.col("type").isin(*PROJECTED) & (F.col("from_key") != F.col("to_key")))
    rows = rows.groupBy(F.least("from_key", "to_key").alias("a"), F.greatest("from_key", "to_key").alias("b")).agg(F.count("*").alias("w"))
    return rows.join(some.withColumnRenamed("key", "a"), "a", "left_semi").join(some.withColumnRenamed("key", "b"), "b", "left_semi").select("a", "b", "w")


def both_ways(weights: DataFrame) -> DataFrame:
    """(src, dst, w): each weight from both of its ends."""
    return weights.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"), "w").select("e.src", "e.dst", "w")


def degrees(nodes: DataFrame, weights: DataFrame) -> DataFrame:
    """(key, type, degree) of all eligible nodes, 0 without a neighbour."""
    sums = both_ways(weights).groupBy(F.col("src").alias("key")).agg(F.sum("w").alias("degree"))
    return eligible(nodes).join(sums, "key", "left").select("key", "type", F.coalesce("degree", F.lit(0)).alias("degree"))


def hub_threshold(degree: DataFrame, percentile: float = PERCENTILE) -> int | None:
    """The degree at place floor(p * n) of the ascending order, from counts of equal degrees: exact, and no
    sort of the nodes. None if there is no such place."""
    counts = degree.groupBy("degree").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    place = int(percentile * total)
    if place >= total:
        return None
    upto = F.sum("n").over(Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0))  # one row a distinct degree
    return counts.withColumn("upto", upto).where(F.col("upto") > place).agg(F.min("degree")).first()[0]


def hub_set(degree: DataFrame, percentile: float = PERCENTILE) -> DataFrame:
    """Nodes with a degree above 0 and at least that of the percentile."""
    least = hub_threshold(degree, percentile)
    return degree.where(F.lit(least is not None) & (F.col("degree") > 0) & (F.col("degree") >= F.lit(least or 0)))


def hubs(degree: DataFrame, limit: int = 20, types: list[str] | None = None) -> DataFrame:
    some = degree if types is None else degree.where(F.col("type").isin(*types))
    return some.orderBy(F.desc("degree"), "key").limit(max(1, limit))


def bridges(weights: DataFrame, membership: DataFrame) -> DataFrame:
    """(key, bridges): how many communities other than its own a node's neighbours are in."""
    own = membership.select(F.col("key").alias("src"), F.col("community").alias("mine"))
    far = membership.select(F.col("key").alias("dst"), F.col("community").alias("theirs"))
    rows = both_ways(weights).join(far, "dst").select("src", "theirs").distinct().join(own, "src", "left").where(~F.col("theirs").eqNullSafe(F.col("mine")))
    counted = rows.groupBy(F.col("src").alias("key")).agg(F.count("*").alias("n"))
    return membership.select("key").join(counted, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("bridges"))


def community_summary(membership: DataFrame, degree: DataFrame, top: int = 5) -> DataFrame:
    """(community, size, members, namespaces): the members of largest degree, and the namespaces of most classes."""
    rows = membership.join(degree, "key")
    order = Window.partitionBy("community").orderBy(F.desc("degree"), "key")
    first = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top).groupBy("community").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "key"))), lambda x: x["key"]).alias("members"))
    spaces = rows.where("type = 'class'").groupBy("community", namespace(F.regexp_replace("key", "^class:", "")).alias("space")).agg(F.count("*").alias("n"), F.min("key").alias("least"))
    order = Window.partitionBy("community").orderBy(F.desc("n"), "least")
    spaces = spaces.withColumn("r", F.row_number().over(order)).where("r <= 3").groupBy("community").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "space"))), lambda x: x["space"]).alias("namespaces"))
    return rows.groupBy("community").agg(F.count("*").alias("size")).join(first, "community").join(spaces, "community", "left")
