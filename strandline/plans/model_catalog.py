"""Queries of models, their properties and tables, and of parts of a stored graph that are replaced as one.

Suppliers stand for classes again: the parent of class n is class n / 3, the first one's is the base class of models,
every fourth uses the next class as a trait, every fifth keeps deleted rows. Parts declare their properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import lookup, models, scopes, summaries, tools, traverse
from strandline.operators.desk import Desk
from strandline.operators.versions import Delta
from strandline.plans.build_catalog import new_log
from strandline.plans.code_catalog import numbered
from strandline.plans.registry import query
from strandline.plans.catalog import FUNCTION, _impact_sql
from strandline.plans.runtime import cut
from strandline.plans.testbed import edges, nodes, table

c, lit = F.col, F.lit

#: Short names of classes, and their tables by convention.
NAMES = ("Category", "Person", "Box", "StatusLog", "OrderItem", "Bus", "Series", "HTTPRequest")
TABLES = ("categories", "people", "boxes", "status_logs", "order_items", "buses", "series", "h_t_t_p_requests")


def _class(k) -> F.Column:
    return F.concat(numbered("App\\M", k), lit("\\"), F.element_at(F.array(*[lit(n) for n in NAMES]), (k % len(NAMES) + 1).cast("int")))


def classes(spark: SparkSession, sf: str) -> DataFrame:
    k = c("s_suppkey").cast("long")
    up = F.floor(k / 3)
    return table(spark, sf, "supplier").select(
        _class(k).alias("class"), F.when(up >= 1, _class(up)).when(k == 1, "Illuminate\\Database\\Eloquent\\Model").alias("parent"),
        F.array_compact(F.array(F.when(k % 4 == 0, _class(k + 1)), F.when(k % 5 == 0, "Any\\SoftDeletes"))).alias("traits"), F.array().cast("array<string>").alias("interfaces"),
        F.when(k % 6 == 0, numbered("tbl_", k)).alias("table"), numbered("src/", k).alias("file"),
    )


def properties(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(c("p_size") == 7, "created_at").otherwise(numbered("p", c("p_size")))
    rows = table(spark, sf, "part").select(_class(c("p_partkey") % 40).alias("class"), name.alias("property"), "p_brand")
    return rows.groupBy("class", "property").agg(F.min("p_brand").alias("type")).withColumn("source", lit("declared"))


def _sql_class(k: str) -> str:
    return f"'App\\M' || ({k}) || '\\' || {list(NAMES)}[({k}) % {len(NAMES)} + 1]"


_CLASSES = f"""WITH RECURSIVE cls AS (SELECT s_suppkey AS k, {_sql_class("s_suppkey")} AS class FROM supplier),
up AS (SELECT k, k // 3 AS other, [1, 0] AS step, true AS by_parent FROM cls WHERE k // 3 >= 1 UNION ALL SELECT k, k + 1, [0, 0], false FROM cls WHERE k % 4 = 0),
walk AS (SELECT k, k AS spot, CAST([] AS INTEGER[]) AS rank, true AS straight FROM cls UNION ALL SELECT walk.k, other, rank || step, straight AND by_parent FROM walk JOIN up ON walk.spot = up.k),
mod AS (SELECT DISTINCT k FROM walk WHERE straight AND spot = 1), soft AS (SELECT DISTINCT walk.k FROM walk JOIN cls ON cls.k = spot WHERE straight AND spot % 5 = 0),
prop AS (SELECT p_partkey % 40 AS k, CASE p_size WHEN 7 THEN 'created_at' ELSE 'p' || p_size END AS property, min(p_brand) AS type FROM part GROUP BY ALL),
inh AS (SELECT walk.k, property, prop.k AS owner, type, row_number() OVER (PARTITION BY walk.k, property ORDER BY rank) AS r FROM walk JOIN prop ON prop.k = spot),
times AS (SELECT k, unnest(['created_at', 'updated_at']) AS property FROM mod UNION ALL SELECT k, 'deleted_at' FROM mod JOIN soft USING (k))"""


@query(f"""{_CLASSES} SELECT lower(class) AS class, property, {_sql_class("owner")} AS owner, type, 'declared' AS source FROM inh JOIN cls USING (k) WHERE r = 1
UNION ALL SELECT lower(class), property, NULL, 'Carbon\\Carbon', 'cast' FROM times JOIN cls USING (k) WHERE (k, property) NOT IN (SELECT (k, property) FROM inh)""")
def inherited_properties(spark: SparkSession, sf: str) -> DataFrame:
    return models.inherited_properties(classes(spark, sf), properties(spark, sf))


@query(f"{_CLASSES} SELECT lower(class) AS class, k IN (SELECT k FROM soft) AS soft FROM cls WHERE k IN (SELECT k FROM mod)")
def models_soft(spark: SparkSession, sf: str) -> DataFrame:
    """The models, and which of them keep deleted rows."""
    given = classes(spark, sf)
    soft = models.soft_deleting(given).withColumn("soft", lit(True))
    return models.models(given).join(soft, "class", "left").select("class", F.coalesce("soft", lit(False)).alias("soft"))


@query(f"""{_CLASSES} SELECT 'maps_table' AS type, 'class:' || class AS from_key, 'table:' || CASE WHEN k % 6 = 0 THEN 'tbl_' || k ELSE {list(TABLES)}[k % 8 + 1] END AS to_key, 'src/' || k AS file,
CASE WHEN k % 6 = 0 THEN 'declared' ELSE 'convention' END AS source FROM cls WHERE k IN (SELECT k FROM mod)""")
def model_tables(spark: SparkSession, sf: str) -> DataFrame:
    found = models.table_edges(classes(spark, sf))
    return found.withColumn("source", F.try_variant_get("meta", "$.source", "string")).drop("meta")


# summaries of models: nations as models, with links that suppliers and orders stand for


def _model_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The testbed's edges with the file of their start and a variant of what they carry, and edges of models."""
    e, n = edges(spark, sf), nodes(spark, sf)
    own = e.join(n.select(c("key").alias("from_key"), "file"), "from_key", "left").select("type", "from_key", "to_key", "file", F.parse_json(lit("{}")).alias("meta"))
    nation = lambda k: F.concat(lit("class:Geo\\NATION_"), k.cast("string"))
    more = lambda df, type_, a, b, meta="{}": df.select(lit(type_).alias("type"), a.alias("from_key"), b.alias("to_key"), lit(None).cast("string").alias("file"), F.parse_json(lit(meta) if isinstance(meta, str) else meta).alias("meta"))
    nations, suppliers, customers = table(spark, sf, "nation"), table(spark, sf, "supplier"), table(spark, sf, "customer")
    said = F.to_json(F.struct(F.when(c("s_suppkey") % 3 == 0, "hasMany").when(c("s_suppkey") % 3 == 1, "belongsTo").alias("relation")))
    return (
        own.unionByName(more(nations.where("n_nationkey % 5 <> 4"), "maps_table", nation(c("n_nationkey")), F.concat(lit("table:part_"), c("n_nationkey").cast("string"))))
        .unionByName(more(suppliers, "relates", nation(c("s_nationkey")), nation(c("s_suppkey") % 25), said))
        .unionByName(more(suppliers.where("s_suppkey % 4 = 0"), "observes", F.concat(lit("function:"), c("s_name")), nation(c("s_nationkey"))))
        .unionByName(more(customers, "calls", F.concat(lit("function:"), c("c_name")), nation(F.floor(c("c_nationkey") / 2))))
    )


_DETAILS = """, own AS (SELECT 'class:Geo\\NATION_' || n_nationkey AS key, n_nationkey AS k FROM nation), has AS (SELECT key, 'table:part_' || k AS tab FROM own WHERE k % 5 <> 4),
facts AS (SELECT key, 'table' AS role, tab AS other, NULL AS relation FROM has
UNION ALL SELECT 'class:Geo\\NATION_' || s_nationkey, 'relations', 'class:Geo\\NATION_' || (s_suppkey % 25), CASE s_suppkey % 3 WHEN 0 THEN 'hasMany' WHEN 1 THEN 'belongsTo' END FROM supplier
UNION ALL SELECT 'class:Geo\\NATION_' || s_nationkey, 'observers', 'function:' || s_name, NULL FROM supplier WHERE s_suppkey % 4 = 0
UNION ALL SELECT DISTINCT has.key, 'migrations', n.file, NULL FROM has JOIN edges e ON e.type = 'touches_table' AND e.to_key = tab JOIN nodes n ON n.key = e.from_key),
det AS (SELECT key, role, other, relation, count(*) AS n FROM facts GROUP BY ALL
UNION ALL SELECT key, 'call_sites', NULL, NULL, (SELECT count(*) FROM customer WHERE c_nationkey // 2 = k) FROM own)"""


@query(_DETAILS + " SELECT * FROM det", graph=True)
def model_details(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries of all models at once."""
    return models.details(_model_edges(spark, sf), nodes(spark, sf).where("type = 'class'"))


@query(_DETAILS + " SELECT * FROM det WHERE key = 'class:Geo\\NATION_7'", graph=True)
def model_by_name(spark: SparkSession, sf: str) -> DataFrame:
    return models.model(nodes(spark, sf), _model_edges(spark, sf), "NATION_7").rows


@query(" SELECT key, name, type, 0.6::DOUBLE AS score FROM nodes WHERE type = 'class' AND key ILIKE '%nation\\_1%' ESCAPE '\\' ORDER BY key LIMIT 5", graph=True)
def model_missing(spark: SparkSession, sf: str) -> DataFrame:
    """A name that only parts of several classes' keys hold: suggestions."""
    return models.model(nodes(spark, sf), _model_edges(spark, sf), "nation_1").suggestions


# what is read and replaced as one


@query(r""", gone AS (SELECT DISTINCT file FROM nodes WHERE type = 'file' AND file LIKE '%1.php'), part_ AS (SELECT * FROM nodes WHERE file NOT IN (SELECT file FROM gone))
SELECT 'class' AS what, key AS class_key, key FROM part_ WHERE type = 'class' UNION ALL SELECT 'method', regexp_replace(key, '^method:(.*)::.*$', 'class:\1'), key FROM part_ WHERE type = 'method'""", graph=True)
def hydrated_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols of stored classes and methods, less those of files that a build reads again."""
    n = nodes(spark, sf)
    again = n.where("type = 'file' and file like '%1.php'").select(c("file").alias("path"))
    cls, methods = scopes.hydrate(n, again)
    return cls.select(lit("class").alias("what"), c("key").alias("class_key"), "key").unionByName(methods.select(lit("method").alias("what"), "class_key", "key"))


@query(r""" SELECT 'stored' AS what, 'geo/' || n_name || '.php' AS a, md5(n_name) AS b FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 0)
UNION ALL SELECT 'node', n.key, n.type FROM nodes n WHERE n.key IN (SELECT 'function:' || s_name FROM supplier WHERE s_acctbal < 0) UNION ALL SELECT 'of file', key, file FROM nodes WHERE file = 'geo/NATION_7.php'""", graph=True)
def stored_lookups(spark: SparkSession, sf: str) -> DataFrame:
    """Files by path (some asked for again and again, some never stored), nodes by key, keys of one file."""
    nation, n = table(spark, sf, "nation"), nodes(spark, sf)
    path = lambda name: F.concat(lit("geo/"), name, lit(".php"))
    files = nation.select(path(c("n_name")).alias("path"), F.md5(c("n_name").cast("binary")).alias("hash"))
    poor = table(spark, sf, "customer").where("c_acctbal < 0").select("c_nationkey")
    asked = nation.join(poor, c("n_nationkey") == c("c_nationkey")).select(path(c("n_name")).alias("path")).unionByName(poor.select(lit("geo/none.php").alias("path")))
    keys = cut(table(spark, sf, "supplier").where("s_acctbal < 0").select(F.concat(lit("function:"), c("s_name")).alias("key")).unionByName(nation.select(F.concat(lit("none:"), "n_name").alias("key"))))
    rows = scopes.stored_files(files, asked).select(lit("stored").alias("what"), c("path").alias("a"), c("hash").alias("b"))
    found = traverse.at_keys(n, "key", keys, traverse.few(keys)).select(lit("node").alias("what"), c("key").alias("a"), c("type").alias("b"))
    own = scopes.keys_of(n, "geo/NATION_7.php").select(lit("of file").alias("what"), c("key").alias("a"), lit("geo/NATION_7.php").alias("b"))
    return rows.unionByName(found).unionByName(own)


@query(" SELECT key FROM nodes WHERE key = 'route:GET /europe'", graph=True)
def routes_of_uri(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.routes_by_uri(nodes(spark, sf), "Europe").select("key")


_KINDS = "CASE event_id % 4 WHEN 0 THEN 'documents' WHEN 1 THEN 'links_doc' ELSE event_type END"


@query(f""", n AS (SELECT type FROM nodes UNION ALL SELECT 'doc' FROM pages UNION ALL SELECT 'concept' FROM documents WHERE doc_id % 3 = 0), e AS (SELECT type FROM edges UNION ALL SELECT 'links_doc' FROM pages UNION ALL SELECT 'mentions' FROM documents)
SELECT (SELECT count(*) FROM n WHERE type = 'doc') AS docs, (SELECT count(*) FROM n WHERE type = 'section') AS sections, (SELECT count(*) FROM e WHERE type = 'documents') AS documents_edges, (SELECT count(*) FROM e WHERE type = 'links_doc') AS links_doc_edges,
(SELECT count(*) FROM events WHERE {_KINDS} IN ('documents', 'links_doc')) AS unresolved, (SELECT count(*) FROM n WHERE type = 'concept') AS concepts, (SELECT count(*) FROM e WHERE type = 'mentions') AS mentions_edges, (SELECT count(*) FROM e WHERE type = 'relates_concept') AS relates_concept_edges""", graph=True)
def docs_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda name, type_, where="true": table(spark, sf, name).where(where).select(lit(type_).alias("type"))
    n = nodes(spark, sf).select("type").unionByName(t("pages", "doc")).unionByName(t("documents", "concept", "doc_id % 3 = 0"))
    e = edges(spark, sf).select("type").unionByName(t("pages", "links_doc")).unionByName(t("documents", "mentions"))
    return summaries.docs_counts(n, e, table(spark, sf, "events").select(F.expr(_KINDS).alias("kind")))


@query("SELECT 'doc:p/' || p.page_id AS key, 'p/' || p.page_id AS file, md5(p.html) AS file_hash FROM pages p WHERE page_id % 3 <> 0 AND page_id % 4 <> 0")
def docs_of_files(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").withColumn("path", F.concat(lit("p/"), "page_id"))
    docs = pages.where("page_id % 4 <> 0").select(F.concat(lit("doc:"), "path").alias("key"), lit("doc").alias("type"), c("path").alias("file"))
    files = pages.where("page_id % 3 <> 0").select("path", F.md5(c("html").cast("binary")).alias("hash"))
    return summaries.doc_files(docs, files).select("key", "file", "file_hash")


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag FROM lineitem)
SELECT 'route' AS what, 'orders/' || o_orderkey AS a, 'second' AS b FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT 'binds', 'order' || o_orderkey, 'second' FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT 'mentions', 'f' || l_orderkey || ':' || coalesce(CAST(CASE WHEN l_linenumber <= 3 THEN l_linenumber END AS VARCHAR), ''), 'first' FROM f WHERE NOT (l_returnflag = 'A' AND l_linenumber <= 3)
  AND NOT (l_linenumber <= 3 AND EXISTS (SELECT 1 FROM f g WHERE g.l_orderkey = f.l_orderkey AND g.l_linenumber = f.l_linenumber AND g.l_returnflag = 'A'))
UNION ALL SELECT DISTINCT 'mentions', 'f' || l_orderkey || ':' || l_linenumber, 'second' FROM f WHERE l_returnflag = 'A' AND l_linenumber <= 3
UNION ALL SELECT 'unresolved', 'f' || l_orderkey, 'm' || l_suppkey FROM f WHERE l_returnflag = 'N'""")
def scopes_replaced(spark: SparkSession, sf: str) -> DataFrame:
    """A graph whose routes, bindings and some sections' concepts a second build replaces, and what it could not resolve:
    orders are routes and bindings, line items are mentions, with a line that may be null."""
    log, orders, lines = new_log(spark), table(spark, sf, "orders"), table(spark, sf, "lineitem")
    file = F.concat(lit("f"), c("l_orderkey").cast("string"))
    line = F.when(c("l_linenumber") <= 3, c("l_linenumber"))
    route = lambda where, by: orders.where(where).select(F.concat(lit("orders/"), c("o_orderkey").cast("string")).alias("key"), lit("route").alias("type"), lit(by).alias("by"))
    edge = lambda df, type_, key, by, at=(lit(None).cast("string"), lit(None).cast("int")): df.select(lit(type_).alias("type"), key.alias("from_key"), lit(by).alias("by"), at[0].alias("file"), at[1].alias("line"))
    binds = lambda where, by: edge(orders.where(where), "binds", F.concat(lit("order"), c("o_orderkey").cast("string")), by)
    said = lambda df, by: edge(df, "mentions", F.concat(file, lit(":"), F.coalesce(line.cast("string"), lit(""))), by, (file, line))
    routed = edge(orders, "routes_to", c("o_orderkey").cast("string"), "first")
    first = binds("o_orderkey % 2 = 0", "first").unionByName(said(lines, "first")).unionByName(routed)
    log.commit({"files": Delta(lines.select(file.alias("path")).distinct()), "nodes": Delta(route("true", "first")), "edges": Delta(first)})
    log.change(lambda at: scopes.replace_routes(log, at, route("o_orderkey % 3 <> 0", "second"), routed.limit(0)))
    log.change(lambda at: scopes.replace_bindings(log, at, binds("o_orderkey % 5 = 0", "second")))
    changed = lines.where("l_returnflag = 'A' and l_linenumber <= 3")
    fresh = said(changed, "second").distinct()
    log.change(lambda at: scopes.replace_concepts(log, at, changed.select(file.alias("file"), line.alias("line")), fresh))
    log.change(lambda at: scopes.append_unresolved(log, at, lines.where("l_returnflag = 'N'").select(file.alias("path"), F.concat(lit("m"), c("l_suppkey").cast("string")).alias("member"))))
    rows = lambda name, what, a, b: log.read(name).select(what.alias("what"), c(a).alias("a"), c(b).alias("b"))
    return rows("nodes", c("type"), "key", "by").unionByName(rows("edges", c("type"), "from_key", "by")).unionByName(rows("unresolved", lit("unresolved"), "path", "member"))


# tools


@query(r""", n AS (SELECT *, CAST(CASE WHEN file IS NOT NULL THEN length(key) END AS INTEGER) AS line FROM nodes), x AS (SELECT from_key AS key, 'out' AS direction, type AS edge_type, count(*) AS n FROM edges GROUP BY ALL UNION ALL SELECT to_key, 'in', type, count(*) FROM edges GROUP BY ALL)
SELECT n.key, name, n.type AS node_type, file, line, kind, direction, edge_type, x.n FROM n LEFT JOIN x USING (key) WHERE n.key = 'class:Geo\NATION_5'""", graph=True)
def node_with_meta(spark: SparkSession, sf: str) -> DataFrame:
    """A node with its line and meta, which say more of it than its type."""
    n = nodes(spark, sf).withColumn("line", F.when(c("file").isNotNull(), F.length("key"))).withColumn("meta", F.parse_json(F.to_json(F.struct("kind"))))
    found = lookup.node(n, edges(spark, sf), "class:Geo\\NATION_5")
    return found.withColumn("kind", F.try_variant_get("meta", "$.kind", "string")).drop("meta")


@query(_impact_sql(FUNCTION, 2, 0.0, "SELECT key, depth, via FROM named"), graph=True)
def impact_likeliest(spark: SparkSession, sf: str) -> DataFrame:
    """Impact of a key that no node has goes on with the likeliest one: here the function of that name."""
    return tools.impact(nodes(spark, sf), edges(spark, sf, "to_key"), FUNCTION.removeprefix("function:"), 2).rows.select("key", "depth", "via")


@query(r""", asked AS (SELECT 'node' AS tool, '{"key": "class:Geo\\nation_' || n_nationkey || '"}' AS args, 'class:Geo\nation_' || n_nationkey AS part FROM nation WHERE n_nationkey % 8 = 1),
near AS (SELECT tool, args, key, row_number() OVER (PARTITION BY args ORDER BY key) AS r FROM asked LEFT JOIN nodes ON contains(lower(key), lower(part)))
SELECT tool, args, string_agg(key, ' ' ORDER BY key) AS suggested FROM near WHERE r <= 5 GROUP BY tool, args
UNION ALL SELECT 'route', '{"name": "GET /' || lower(r_name) || '/none"}', '' FROM region WHERE r_regionkey < 2 UNION ALL SELECT 'communities', '{}', ''""", graph=True)
def misses_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Questions to a desk, some without an answer: these are kept with what was suggested."""
    desk = Desk(new_log(spark), nodes(spark, sf), edges(spark, sf), clock=lambda: "2024-01-01T00:00:00+00:00")
    for row in table(spark, sf, "nation").where("n_nationkey % 8 = 1").collect():  # a few keys that people ask for
        desk.ask("node", key=f"class:Geo\\nation_{row.n_nationkey}")
        desk.ask("node", key=f"class:Geo\\{row.n_name}")
    for row in table(spark, sf, "region").where("r_regionkey < 2").collect():
        desk.ask("route", name=f"GET /{row.r_name.lower()}/none")
        desk.ask("route", name=f"get {row.r_name.lower()}")
    desk.ask("communities")
    return desk.misses().select("tool", "args", F.array_join("suggested", " ").alias("suggested"))
