"""Summaries of routes, views, models and documents: joins over the edges of one node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.lookup import is_exact


def _ends(edges: DataFrame, key: str, types: list[str], incoming: bool) -> DataFrame:
    mine, other = ("to_key", "from_key") if incoming else ("from_key", "to_key")
    return edges.where((F.col(mine) == key) & F.col("type").isin(*types)).select(F.col("type").alias("edge_type"), F.col(other).alias("other"))


def route(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """A route by "VERB /uri": its handlers and the views they render (route, handler, view)."""
    verb, _, uri = name.partition(" ")
    key = f"route:{verb.upper()} /{uri.lstrip('/')}"
    handlers = edges.where((F.col("type") == "routes_to") & (F.col("from_key") == key)).select(F.col("from_key").alias("route"), F.col("to_key").alias("handler"))
    views = edges.where("type = 'renders'").select(F.col("from_key").alias("handler"), F.col("to_key").alias("view"))
    return nodes.where(F.col("key") == key).select(F.col("key").alias("route")).join(handlers, "route", "left").join(views, "handler", "left").select("route", "handler", "view")


def route_names(nodes: DataFrame, order: str = "key") -> DataFrame:
    """(name, key) of the routes with a name in their meta (a variant); the last one in `order` wins."""
    name = F.try_variant_get("meta", "$.name", "string")
    return nodes.where("type = 'route'").select(name.alias("name"), "key", F.col(order).alias("o")).where("name is not null").groupBy("name").agg(F.max_by("key", "o").alias("key"))


def route_detail(nodes: DataFrame, edges: DataFrame, asked: str) -> DataFrame:
    """(key, name, action, middleware, domain, views) of one route, by "VERB /uri" or by name (the least key of several);
    no row for an unknown one. Nodes have a variant `meta`; views are names, repeated as often as handlers render them."""
    verb, space, uri = asked.partition(" ")
    routes = nodes.where("type = 'route'")
    some = routes.where(F.col("key") == f"route:{verb.upper()} /{uri.lstrip('/')}") if space else routes.where(F.try_variant_get("meta", "$.name", "string") == asked).orderBy("key").limit(1)
    get = lambda path, kind: F.try_variant_get("meta", path, kind)
    one = some.select("key", get("$.name", "string").alias("name"), get("$.action", "string").alias("action"), F.coalesce(get("$.middleware", "array<string>"), F.array()).alias("middleware"), get("$.domain", "string").alias("domain"))
    handlers = edges.where("type = 'routes_to'").select(F.col("from_key").alias("key"), F.col("to_key").alias("handler")).join(one.select("key"), "key", "left_semi").distinct()
    views = edges.where("type = 'renders'").select(F.col("from_key").alias("handler"), F.regexp_replace("to_key", "^view:", "").alias("view")).join(handlers, "handler")
    return one.join(views.groupBy("key").agg(F.sort_array(F.collect_list("view")).alias("views")), "key", "left").withColumn("views", F.coalesce("views", F.array().cast("array<string>")))


def migrations(edges: DataFrame, table: str) -> DataFrame:
    """(file): the distinct files that touch a table, of edges with a file."""
    return edges.where((F.col("type") == "touches_table") & (F.col("to_key") == table) & F.col("file").isNotNull()).select("file").distinct()


def view(edges: DataFrame, name: str) -> DataFrame:
    """(role, other) of a view: who renders or includes it, what it includes, uses and links to."""
    key = f"view:{name}"
    into = _ends(edges, key, ["renders", "includes"], True).select(F.when(F.col("edge_type") == "renders", "rendered_by").otherwise("included_by").alias("role"), "other")
    role = F.when(F.col("edge_type") == "includes", "includes").when(F.col("edge_type") == "uses_component", "components").otherwise("links_to_routes")
    return into.unionByName(_ends(edges, key, ["includes", "uses_component", "links_route"], False).select(role.alias("role"), "other"))


def model(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(key, role, other, n) of the one class of that name: its table, relations, observers and call sites; no
    rows unless exactly one class has the name."""
    some = nodes.where((F.col("type") == "class") & is_exact(name)).select("key").limit(2).collect()
    if len(some) != 1:
        return edges.sparkSession.createDataFrame([], "key string, role string, other string, n long")
    key = some[0].key
    role = F.when(F.col("type") == "calls", "call_sites").when(F.col("type") == "observes", "observers").when(F.col("type") == "maps_table", "table").when(F.col("type") == "relates", "relations").when(F.col("type") == "instantiates", "instantiates").otherwise("declares")
    out = edges.where((F.col("from_key") == key) & F.col("type").isin("maps_table", "relates", "instantiates", "declares")).select(role.alias("role"), F.col("to_key").alias("other"))
    into = edges.where((F.col("to_key") == key) & F.col("type").isin("calls", "observes")).select(role.alias("role"), F.col("from_key").alias("other"))
    return out.unionByName(into).groupBy("role", "other").agg(F.count("*").alias("n")).select(F.lit(key).alias("key"), "role", "other", "n")


#: What is counted of documents, by table and types.
DOCS_COUNTS = {
    "docs": ("node", ("doc",)), "sections": ("node", ("section",)), "documents_edges": ("edge", ("documents",)), "links_doc_edges": ("edge", ("links_doc",)),
    "unresolved": ("unresolved", ("documents", "links_doc")), "concepts": ("node", ("concept",)), "mentions_edges": ("edge", ("mentions",)), "relates_concept_edges": ("edge", ("relates_concept",)),
}


def docs_counts(nodes: DataFrame, edges: DataFrame, unresolved: DataFrame) -> DataFrame:
    """One row of DOCS_COUNTS over nodes (type), edges (type) and unresolved references (kind); zeros where nothing is."""
    typed = lambda df, type_, what: df.select(F.lit(what).alias("what"), F.col(type_).alias("type"))
    every = typed(nodes, "type", "node").unionByName(typed(edges, "type", "edge")).unionByName(typed(unresolved, "kind", "unresolved"))
    return every.agg(*[F.count_if((F.col("what") == what) & F.col("type").isin(*types)).alias(name) for name, (what, types) in DOCS_COUNTS.items()])


def doc_files(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """The nodes of documents that have a stored file, with the columns of files (path, ...) beside their own."""
    docs_ = nodes.where("type = 'doc'")
    return docs_.join(files.select(F.col("path").alias("file"), *[F.col(c).alias(f"file_{c}") for c in files.columns if c != "path"]), "file")


def docs(edges: DataFrame, key: str) -> DataFrame:
    """(role, other): sections that document a node, and nodes that it documents."""
    into = _ends(edges, key, ["documents"], True).select(F.lit("documented_by").alias("role"), "other")
    return into.unionByName(_ends(edges, key, ["documents"], False).select(F.lit("documents").alias("role"), "other"))
