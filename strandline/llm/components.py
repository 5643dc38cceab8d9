"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before it is shuffled) and a join on the same key, whose hot keys
Spark splits; edges are written to the shared folder after each round. The number of rounds grows with the
logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import drop_path, fresh_path


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), both directions present for the large star; u > v for the small star."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = edges.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of an edge (a, b); component is the smallest id reachable.

    Rows with a null end and loops are ignored, repeated edges count once, an empty table gives an empty one."""
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    state, old = None, None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = _star(both, large=True).where("u <> v").distinct()
        step = _star(step.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), large=False).where("u <> v").distinct()
        path = fresh_path(spark, "star")
        step.write.parquet(path)
        now = spark.read.schema(step.schema).parquet(path)
        got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if old:
            drop_path(spark, old)
        old = path
        if tuple(got) == state:
            break
        state = tuple(got)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
