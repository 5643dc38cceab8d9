"""Routes, middleware and container bindings from tables that an application exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.keys import key


def route_nodes(routes: DataFrame) -> DataFrame:
    """(key, type, name, route_name, action, middleware, domain) of routes (methods, uri, name, action,
    middleware, domain); the first method other than HEAD counts, and a uri starts with one slash."""
    verb = F.coalesce(F.get(F.filter("methods", lambda m: m != "HEAD"), F.lit(0)), F.get("methods", F.lit(0)))
    full = F.concat(F.upper(verb), F.lit(" /"), F.ltrim(F.col("uri"), F.lit("/")))
    return routes.select(key("route", full).alias("key"), F.lit("route").alias("type"), full.alias("name"), F.col("name").alias("route_name"), "action", F.coalesce("middleware", F.array()).alias("middleware"), "domain").dropDuplicates(["key"])


def handlers(nodes: DataFrame, inherited: DataFrame) -> DataFrame:
    """routes_to edges (type, from_key, to_key): "Class@method", or a class alone for its __invoke; closures and
    methods that no class of the project has or inherits have none. inherited: (class, method, owner)."""
    parts = F.split("action", "@")
    cls, method = F.ltrim(F.get(parts, F.lit(0)), F.lit("\\")), F.coalesce(F.get(parts, F.lit(1)), F.lit("__invoke"))
    some = nodes.where("action is not null and action <> 'Closure'").select("key", F.lower(cls).alias("class"), F.lower(method).alias("method"), method.alias("named"))
    return some.join(inherited, ["class", "method"]).select(F.lit("routes_to").alias("type"), F.col("key").alias("from_key"), key("method", F.col("owner"), "::", F.col("named")).alias("to_key"))


def middleware(nodes: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Middleware nodes (key, type, name, class), each alias once, and uses_middleware edges. The class is the
    alias's, or that of the part before a colon."""
    used = nodes.select("key", F.explode("middleware").alias("alias"))
    bare = F.substring_index("alias", ":", 1)
    whole, part = aliases.select(F.col("alias").alias("w"), F.col("class").alias("cw")), aliases.select(F.col("alias").alias("p"), F.col("class").alias("cp"))
    found = used.select("alias").distinct().withColumn("bare", bare).join(whole, F.col("alias") == F.col("w"), "left").join(part, F.col("bare") == F.col("p"), "left")
    made = found.select(key("middleware", F.col("alias")).alias("key"), F.lit("middleware").alias("type"), F.col("alias").alias("name"), F.coalesce("cw", "cp").alias("class")).dropDuplicates(["key"])
    return made, used.select(F.lit("uses_middleware").alias("type"), F.col("key").alias("from_key"), key("middleware", F.col("alias")).alias("to_key"))


def binds(bindings: DataFrame, classes: DataFrame) -> DataFrame:
    """binds edges (type, from_key, to_key, singleton) of bindings (abstract, concrete, shared): not to itself, not
    null, both ends known classes."""
    name = lambda c: classes.select(F.lower("class").alias(f"k_{c}"), F.col("class").alias(f"n_{c}")).dropDuplicates([f"k_{c}"])
    rows = bindings.where("abstract is not null and concrete is not null and lower(abstract) <> lower(concrete)")
    rows = rows.join(name("a"), F.lower("abstract") == F.col("k_a")).join(name("c"), F.lower("concrete") == F.col("k_c"))
    return rows.select(F.lit("binds").alias("type"), key("class", F.col("n_a")).alias("from_key"), key("class", F.col("n_c")).alias("to_key"), F.col("shared").alias("singleton"))
