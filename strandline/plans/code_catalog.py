"""Queries of symbol tables, routes, files and texts, over classes, routes and files that are made of whole tables.

Suppliers stand for classes: the parent of S<n> is S<n / 3>, every seventh is an interface that the six after it
implement. Parts declare their methods, line items call them, customers are routes, pages and parts are files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import analysis, store, symbols
from strandline.plans.registry import query
from strandline.plans.testbed import edges, nodes, table
from strandline.sources import markdown, routes, scripts, templates, tree

c, lit = F.col, F.lit


def numbered(prefix: str, n) -> F.Column:
    return F.concat(lit(prefix), n.cast("long").cast("string"))


# symbols


def classes(spark: SparkSession, sf: str) -> DataFrame:
    k = c("s_suppkey").cast("long")
    parent, base = F.floor(k / 3), F.floor(k / 7) * 7
    return table(spark, sf, "supplier").select(
        numbered("S", k).alias("class"), F.when(k % 7 == 0, "interface").otherwise("class").alias("kind"), F.when(parent >= 1, numbered("S", parent)).alias("parent"),
        F.when((k % 7 != 0) & (k >= 7), F.array(numbered("S", base))).otherwise(F.array().cast("array<string>")).alias("interfaces"),
        lit(None).cast("array<string>").alias("traits"), ((k % 7 == 1) | (k % 14 == 2)).alias("is_project"), numbered("src/", k % 10).alias("file"),
    )


def methods(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(numbered("S", c("p_partkey") % 40).alias("class"), numbered("m", c("p_size")).alias("method"), "p_brand")
    return rows.groupBy("class", "method").agg(F.min("p_brand").alias("return_type"))


def bindings(spark: SparkSession, sf: str) -> DataFrame:
    k = c("s_suppkey").cast("long")
    return table(spark, sf, "supplier").where(k % 21 == 0).select(numbered("s", k).alias("abstract"), numbered("S", k + 5).alias("concrete"), (k % 2 == 0).alias("shared"))


_CLASSES = """cls AS (SELECT s_suppkey AS k, 'S' || s_suppkey AS class, CASE WHEN s_suppkey // 3 >= 1 THEN 'S' || (s_suppkey // 3) END AS parent,
  CASE WHEN s_suppkey % 7 <> 0 AND s_suppkey >= 7 THEN 'S' || (s_suppkey // 7 * 7) END AS interface, s_suppkey % 7 = 1 OR s_suppkey % 14 = 2 AS is_project FROM supplier),
up AS (SELECT lower(class) AS low, lower(parent) AS up, [1, 0] AS step FROM cls WHERE parent IS NOT NULL UNION ALL SELECT lower(class), lower(interface), [2, 0] FROM cls WHERE interface IS NOT NULL),
path AS (SELECT lower(class) AS class, lower(class) AS ancestor, CAST([] AS INTEGER[]) AS rank FROM cls UNION ALL SELECT class, up, rank || step FROM path JOIN up ON ancestor = low),
anc AS (SELECT class, ancestor, min(rank) AS rank FROM path GROUP BY ALL),
meth AS (SELECT 'S' || (p_partkey % 40) AS class, 'm' || p_size AS method, min(p_brand) AS return_type FROM part GROUP BY ALL),
inh AS (SELECT anc.class, meth.method, meth.class AS owner, return_type, row_number() OVER (PARTITION BY anc.class, meth.method ORDER BY rank) AS r FROM anc JOIN meth ON ancestor = lower(meth.class)),
bind AS (SELECT lower('S' || s_suppkey) AS k, 'S' || (s_suppkey + 5) AS bound FROM supplier WHERE s_suppkey % 21 = 0),
sole AS (SELECT lower(interface) AS k, min(class) AS one FROM cls WHERE is_project AND k % 7 <> 0 AND interface IS NOT NULL GROUP BY ALL HAVING count(*) = 1),
sub AS (SELECT class AS type, coalesce(bound, one, class) AS concrete, CASE WHEN bound IS NOT NULL THEN 'container' WHEN one IS NOT NULL THEN 'interface' END AS kind FROM cls LEFT JOIN bind ON bind.k = lower(class) LEFT JOIN sole ON sole.k = lower(class))"""
_SYMBOLS = f"WITH RECURSIVE {_CLASSES}"


@query(f"{_SYMBOLS} SELECT class, ancestor, array_to_string(rank, '.') AS rank FROM anc")
def class_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.ancestors(classes(spark, sf)).withColumn("rank", F.array_join("rank", "."))


@query(f"{_SYMBOLS} SELECT class, method, owner, return_type FROM inh WHERE r = 1")
def inherited_methods(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.inherited_methods(classes(spark, sf), methods(spark, sf))


@query("WITH RECURSIVE d AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey // 3 = 2 UNION SELECT s_suppkey FROM supplier JOIN d ON s_suppkey // 3 = d.k) SELECT 's' || k AS class FROM d")
def descends_from(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.descends_from(classes(spark, sf), ["S2"])


@query(f"{_SYMBOLS} SELECT type, concrete, kind, CAST(CASE kind WHEN 'interface' THEN 0.6 ELSE 1 END AS DOUBLE) AS cap FROM sub")
def interface_substitution(spark: SparkSession, sf: str) -> DataFrame:
    all_classes = classes(spark, sf)
    return symbols.substitute_interfaces(all_classes.select(c("class").alias("type")), all_classes, bindings(spark, sf))


_SHORT = ("DB", "log", "Str", "App\\Log", "Own", "Schema", "app", "RATELIMITER")
_FULL = ("Illuminate\\Support\\Facades\\DB", "Illuminate\\Support\\Facades\\Log", "Illuminate\\Support\\Str", "App\\Log", "Own", "Schema", "Illuminate\\Foundation\\Application", "Illuminate\\Support\\Facades\\RateLimiter")


@query(f"SELECT p_partkey, {list(_FULL)}[p_partkey % 8 + 1] AS type FROM part".replace("\\\\", "\\"))
def alias_types(spark: SparkSession, sf: str) -> DataFrame:
    """Short names of parts' types as classes; one of them is a class of its own."""
    types = table(spark, sf, "part").select("p_partkey", F.element_at(F.array(*[lit(n) for n in _SHORT]), (c("p_partkey") % 8 + 1).cast("int")).alias("type"))
    own = classes(spark, sf).select("class").unionByName(spark.createDataFrame([("schema",)], "class string"))
    return symbols.expand_aliases(types, own)


_CALLS = "calls AS (SELECT 'o' || l_orderkey AS from_key, CASE WHEN l_linenumber > 1 THEN 'S' || l_suppkey END AS type, 'm' || CAST(l_quantity AS BIGINT) AS member, CASE l_returnflag WHEN 'A' THEN 'static' WHEN 'N' THEN 'return_type' ELSE 'eloquent' END AS resolution FROM lineitem)"


def _calls(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    flag = c("l_returnflag")
    rows = table(spark, sf, "lineitem").select(
        numbered("o", c("l_orderkey")).alias("from_key"), F.when(c("l_linenumber") > 1, numbered("S", c("l_suppkey"))).alias("type"), numbered("m", c("l_quantity")).alias("member"),
        F.when(flag == "A", "static").when(flag == "N", "return_type").otherwise("eloquent").alias("resolution"), lit(1.0).alias("confidence"),
    )
    return symbols.resolve_calls(rows, classes(spark, sf), methods(spark, sf), bindings(spark, sf))


@query(f"""{_SYMBOLS}, {_CALLS} SELECT 'calls' AS type, from_key, member, CASE WHEN owner IS NOT NULL THEN 'method:' || owner || '::' || member WHEN cls.class IS NOT NULL THEN 'class:' || cls.class ELSE 'external:' || concrete END AS to_key,
coalesce(kind, resolution) AS resolution, CAST(least(CASE kind WHEN 'interface' THEN 0.6 ELSE 1 END, CASE resolution WHEN 'return_type' THEN 0.8 WHEN 'eloquent' THEN 0.7 ELSE 1 END) AS DOUBLE) AS confidence
FROM calls JOIN sub USING (type) LEFT JOIN cls ON cls.class = concrete LEFT JOIN inh ON inh.r = 1 AND inh.class = lower(concrete) AND inh.method = member""")
def resolved_calls(spark: SparkSession, sf: str) -> DataFrame:
    return _calls(spark, sf)[0]


@query(f"WITH {_CALLS} SELECT from_key, 'calls' AS kind, member FROM calls WHERE type IS NULL")
def unresolved_calls(spark: SparkSession, sf: str) -> DataFrame:
    return _calls(spark, sf)[1]


@query("SELECT DISTINCT 'src/' || (s_suppkey % 10) AS file, unnest(['s' || s_suppkey, CASE WHEN s_suppkey % 7 <> 0 AND s_suppkey >= 7 THEN 's' || (s_suppkey // 7 * 7) ELSE 's' || s_suppkey END, 'function:' || lower(s_name)]) AS symbol FROM supplier")
def declared_symbols(spark: SparkSession, sf: str) -> DataFrame:
    functions = table(spark, sf, "supplier").select(numbered("src/", c("s_suppkey") % 10).alias("file"), c("s_name").alias("name"))
    return symbols.declared_symbols(classes(spark, sf), functions)


# routes, middleware, bindings


def _routes(spark: SparkSession, sf: str) -> DataFrame:
    k = c("c_custkey").cast("long")
    action = F.when(k % 5 == 0, "Closure").when(k % 5 == 1, "\\S1").otherwise(F.concat(numbered("S", k % 40), lit("@"), numbered("M", k % 50 + 1)))
    return routes.route_nodes(table(spark, sf, "customer").select(
        F.when(k % 2 == 0, F.array(lit("HEAD"), lit("get"))).otherwise(F.array(lit("POST"))).alias("methods"), F.concat(F.when(k % 3 == 0, "//").otherwise(""), numbered("c/", k)).alias("uri"), numbered("r", k).alias("name"), action.alias("action"),
        F.when(k % 4 == 0, F.array(lit("auth"), lit("can:edit"))).when(k % 4 == 1, F.array(numbered("throttle:", k % 3))).alias("middleware"), lit(None).cast("string").alias("domain"),
    ))


_ROUTES = """rt AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'GET' ELSE 'POST' END || ' /c/' || c_custkey AS name, CASE c_custkey % 5 WHEN 0 THEN 'Closure' WHEN 1 THEN '\\S1' ELSE 'S' || (c_custkey % 40) || '@M' || (c_custkey % 50 + 1) END AS action,
  CASE c_custkey % 4 WHEN 0 THEN ['auth', 'can:edit'] WHEN 1 THEN ['throttle:' || (c_custkey % 3)] ELSE [] END AS middleware FROM customer)"""


@query(f"WITH {_ROUTES} SELECT 'route:' || name AS key, 'route' AS type, name, 'r' || k AS route_name, action, array_to_string(middleware, ',') AS middleware FROM rt")
def routes_table(spark: SparkSession, sf: str) -> DataFrame:
    return _routes(spark, sf).withColumn("middleware", F.array_join("middleware", ",")).drop("domain")


@query(f"{_SYMBOLS}, {_ROUTES} SELECT 'routes_to' AS type, 'route:' || name AS from_key, 'method:' || owner || '::M' || (rt.k % 50 + 1) AS to_key FROM rt JOIN inh ON r = 1 AND class = 's' || (rt.k % 40) AND method = 'm' || (rt.k % 50 + 1) WHERE rt.k % 5 > 1")
def route_handlers(spark: SparkSession, sf: str) -> DataFrame:
    return routes.handlers(_routes(spark, sf), symbols.inherited_methods(classes(spark, sf), methods(spark, sf)))


def _aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("auth", "App\\Auth"), ("throttle", "App\\Throttle"), ("throttle:1", "App\\Once")], "alias string, class string")


@query(f"WITH {_ROUTES} SELECT DISTINCT 'middleware:' || m AS key, 'middleware' AS type, m AS name, CASE WHEN m = 'auth' THEN 'App\\Auth' WHEN m = 'throttle:1' THEN 'App\\Once' WHEN m LIKE 'throttle%' THEN 'App\\Throttle' END AS class FROM (SELECT unnest(middleware) AS m FROM rt)")
def middleware_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return routes.middleware(_routes(spark, sf), _aliases(spark))[0]


@query(f"WITH {_ROUTES} SELECT 'uses_middleware' AS type, 'route:' || name AS from_key, 'middleware:' || unnest(middleware) AS to_key FROM rt")
def middleware_edges(spark: SparkSession, sf: str) -> DataFrame:
    return routes.middleware(_routes(spark, sf), _aliases(spark))[1]


@query("SELECT 'binds' AS type, 'class:S' || a.s_suppkey AS from_key, 'class:S' || b.s_suppkey AS to_key, a.s_suppkey % 2 = 0 AS singleton FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 5 WHERE a.s_suppkey % 21 = 0")
def container_bindings(spark: SparkSession, sf: str) -> DataFrame:
    return routes.binds(bindings(spark, sf), classes(spark, sf))


# stored graph


@query(" SELECT type, from_key, to_key FROM edges WHERE from_key IN (SELECT key FROM nodes WHERE type <> 'view') AND to_key IN (SELECT key FROM nodes WHERE type <> 'view')", graph=True)
def edges_known_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of the graph whose views were not stored."""
    return store.known_ends(edges(spark, sf), nodes(spark, sf).where("type <> 'view'")).select("type", "from_key", "to_key")


_GONE = "gone AS (SELECT 'geo/' || n_name || '.php' AS path FROM nation WHERE n_nationkey % 3 = 0), stay AS (SELECT key FROM nodes WHERE file IS NULL OR file NOT IN (SELECT path FROM gone))"


@query(f", {_GONE} SELECT 'file' AS what, 'geo/' || n_name || '.php' AS a, NULL::VARCHAR AS b FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT 'node', key, NULL FROM stay UNION ALL SELECT 'edge', from_key, to_key FROM edges WHERE from_key IN (SELECT key FROM stay) AND to_key IN (SELECT key FROM stay)", graph=True)
def delete_files_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of files, nodes and edges when every third nation's file goes."""
    path = F.concat(lit("geo/"), c("n_name"), lit(".php")).alias("path")
    nation = table(spark, sf, "nation")
    files, left, kept = store.delete_files(nation.select(path), nodes(spark, sf), edges(spark, sf), nation.where("n_nationkey % 3 = 0").select(path))
    none = lit(None).cast("string").alias("b")
    return files.select(lit("file").alias("what"), c("path").alias("a"), none).unionByName(left.select(lit("node").alias("what"), c("key").alias("a"), none)).unionByName(kept.select(lit("edge").alias("what"), c("from_key").alias("a"), c("to_key").alias("b")))


_ELIGIBLE = ", ".join(f"'{t}'" for t in analysis.PROJECTED)


@query(f""", ok AS (SELECT key, type, coalesce(file, type) AS community FROM nodes WHERE type IN ('class', 'method', 'route', 'view', 'function') AND (type NOT IN ('class', 'method') OR coalesce(is_project, true))),
e AS (SELECT from_key, to_key FROM edges WHERE type IN ({_ELIGIBLE}) AND from_key <> to_key AND from_key IN (SELECT key FROM ok) AND to_key IN (SELECT key FROM ok)),
deg AS (SELECT key, community, type, count(x.k) AS degree FROM ok LEFT JOIN (SELECT from_key AS k FROM e UNION ALL SELECT to_key FROM e) x ON x.k = key GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY degree DESC, key) AS r FROM deg)
SELECT community, count(*) AS size, string_agg(key, ' ' ORDER BY r) FILTER (r <= 5) AS members, CASE WHEN bool_or(type = 'class') THEN 'Geo' END AS namespaces FROM r GROUP BY community""", graph=True)
def community_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Size, members of largest degree and namespaces of given communities: here the file of a node, else its type."""
    n = nodes(spark, sf)
    given = n.join(analysis.eligible(n).select("key"), "key", "left_semi").select("key", F.coalesce("file", "type").alias("community"))
    found = analysis.community_summary(given, analysis.degrees(n, analysis.projection(n, edges(spark, sf, None))))
    return found.withColumns({"members": F.array_join("members", " "), "namespaces": F.array_join("namespaces", " ")})


# files and texts


@query("""WITH f AS (SELECT page_id, html, CASE page_id % 6 WHEN 0 THEN 'src/P' || page_id || '.PHP' WHEN 1 THEN 'vendor/v' || page_id || '.php' WHEN 2 THEN 'docs/d' || page_id || '.md' WHEN 3 THEN 'views/v' || page_id || '.blade.php' WHEN 4 THEN 'js/' || page_id || '.min.js' ELSE 'a' || page_id || '.txt' END AS path FROM pages)
SELECT path, CASE page_id % 6 WHEN 0 THEN 'php' WHEN 2 THEN 'md' ELSE 'blade' END AS lang, true AS is_project, CAST(strlen(html) AS BIGINT) AS size, sha256(html) AS hash FROM f WHERE page_id % 6 IN (0, 2, 3)""")
def tree_files(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as files of a project: languages, excluded folders, a glob."""
    k = c("page_id")
    ends = ((0, "src/P", ".PHP"), (1, "vendor/v", ".php"), (2, "docs/d", ".md"), (3, "views/v", ".blade.php"), (4, "js/", ".min.js"), (5, "a", ".txt"))
    path = F.coalesce(*[F.when(k % 6 == n, F.concat(lit(a), k.cast("string"), lit(z))) for n, a, z in ends])
    return tree.select_files(table(spark, sf, "pages").select(path.alias("path"), c("html").alias("content")), globs=("js*.min.js",)).drop("content")


def _markdown(spark: SparkSession, sf: str) -> DataFrame:
    title, k = F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1), c("page_id").cast("string")
    text = F.concat(lit("intro\n# T "), title, lit("\nsee [a](../x/p"), k, lit(".md#top), [w](https://a.b/c.md)\n## Part ##\n`order."), k, lit("` and Geo\\NATION_"), (c("page_id") % 25).cast("string"), lit("\n## Part\n[me](#part) /europe\n"))
    return markdown.sections(table(spark, sf, "pages").select(F.concat(lit("pages/"), k, lit(".md")).alias("path"), text.alias("content")))


_SLUG = r"regexp_replace(trim(regexp_replace(translate('T ' || title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\s_-]', '', 'g')), '\s+', '-', 'g')"
_PAGES = rf"pg AS (SELECT page_id AS k, 'pages/' || page_id || '.md' AS path, regexp_replace(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1), '\s*#*\s*$', '') AS title, {_SLUG} AS slug FROM pages)"


@query(f"WITH {_PAGES} SELECT path, 2 AS line, 1 AS level, trim('T ' || title) AS title, slug AS anchor, 'see [a](../x/p' || k || '.md#top), [w](https://a.b/c.md)' AS body FROM pg UNION ALL SELECT path, 4, 2, 'Part', 'part', '`order.' || k || '` and Geo\\NATION_' || (k % 25) FROM pg UNION ALL SELECT path, 6, 2, 'Part', 'part-1', '[me](#part) /europe' || chr(10) FROM pg")
def markdown_sections(spark: SparkSession, sf: str) -> DataFrame:
    return _markdown(spark, sf)


@query(f"WITH {_PAGES} SELECT path, slug AS anchor, 'x/p' || k || '.md' AS target, 'top' AS target_anchor FROM pg UNION ALL SELECT path, 'part-1', path, 'part' FROM pg")
def markdown_links(spark: SparkSession, sf: str) -> DataFrame:
    return markdown.links(_markdown(spark, sf))


@query(f"""WITH {_PAGES} SELECT path, 'part' AS anchor, 'order.' || k AS text, true AS backticked FROM pg
UNION ALL SELECT path, 'part-1', '/europe', false FROM pg UNION ALL SELECT path, 'part', 'Geo', false FROM pg
UNION ALL SELECT path, slug, unnest(['p' || k || '.md', 'a.b', 'c.md']), false FROM pg""")
def markdown_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Code spans, URIs, and what looks like the name of a class or view, in links too."""
    return markdown.mentions(_markdown(spark, sf))


@query(", m AS (SELECT 'pages/' || page_id || '.md' AS path, page_id AS k FROM pages) SELECT path, 'part-1' AS anchor, '/europe' AS text, 'route:GET /europe' AS keys, 'route_uri' AS matches FROM m", graph=True)
def mention_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes that the pages' mentions mean; most of them mean none."""
    found = markdown.resolve_mentions(markdown.mentions(_markdown(spark, sf)), nodes(spark, sf))
    return found.withColumns({"keys": F.array_join("keys", " "), "matches": F.array_join("matches", " ")})


def _mentioning(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with a mention for every lookup: table, file, class by its name and by its short name, view, route."""
    k, j = c("page_id").cast("string"), (c("page_id") % 10 + 1).cast("string")
    text = F.concat(lit("# All\n`part_"), k, lit("` and `geo/NATION_"), (c("page_id") % 25).cast("string"), lit(".php`, Sup\\S"), j, lit(" or S"), j, lit(" with page.p"), j, lit("\nat /europe\n"))
    return markdown.mentions(markdown.sections(table(spark, sf, "pages").select(F.concat(lit("pages/"), k, lit(".md")).alias("path"), text.alias("content"))))


def _mentioned(spark: SparkSession, sf: str) -> DataFrame:
    """The graph, classes whose names are words, every second short name twice, and views."""
    k = c("s_suppkey").cast("long")
    extra = lambda rows, type_, prefix: rows.select(numbered(f"{type_}:{prefix}", k).alias("key"), lit(type_).alias("type"), numbered(prefix, k).alias("name"), *[lit(None).cast(t).alias(x) for x, t in (("file", "string"), ("is_project", "boolean"), ("kind", "string"))])
    rows = table(spark, sf, "supplier")
    return nodes(spark, sf).unionByName(extra(rows, "class", "Sup\\S")).unionByName(extra(rows.where(k % 2 == 0), "class", "Alt\\S")).unionByName(extra(rows, "view", "page.p"))


_MENTIONS = r"""pg AS (SELECT 'pages/' || page_id || '.md' AS path, page_id AS k, page_id % 10 + 1 AS j FROM pages),
said AS (SELECT path, 'part_' || k AS text, true AS backticked, 'table' AS match, 'table:part_' || k AS key FROM pg
  UNION ALL SELECT path, 'geo/NATION_' || (k % 25) || '.php', true, 'file', 'file:geo/NATION_' || (k % 25) || '.php' FROM pg
  UNION ALL SELECT path, 'Sup\S' || j, false, 'class', 'class:Sup\S' || j FROM pg UNION ALL SELECT path, 'S' || j, false, 'class', 'class:Sup\S' || j FROM pg UNION ALL SELECT path, 'S' || j, false, 'class', 'class:Alt\S' || j FROM pg
  UNION ALL SELECT path, 'page.p' || j, false, 'view', 'view:page.p' || j FROM pg UNION ALL SELECT path, '/europe', false, 'route_uri', 'route:GET /europe' FROM pg)"""


@query(f"WITH {_MENTIONS} SELECT DISTINCT path, 'all' AS anchor, text, backticked FROM said")
def markdown_mentions_all(spark: SparkSession, sf: str) -> DataFrame:
    """All mentions of every kind."""
    return _mentioning(spark, sf)


@query(rf""", {_MENTIONS}, known AS (SELECT key FROM nodes UNION ALL SELECT 'class:Sup\S' || s_suppkey FROM supplier UNION ALL SELECT 'class:Alt\S' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'view:page.p' || s_suppkey FROM supplier)
SELECT path, 'all' AS anchor, text, string_agg(key, ' ' ORDER BY key) AS keys, min(match) AS matches FROM said WHERE key IN (SELECT key FROM known) GROUP BY path, text""", graph=True)
def mention_targets_all(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes that all mentions mean, by every lookup."""
    found = markdown.resolve_mentions(_mentioning(spark, sf), _mentioned(spark, sf))
    return found.withColumns({"keys": F.array_join("keys", " "), "matches": F.array_join("matches", " ")})


@query("SELECT 'js/' || page_id || '.js' AS path, x.line, x.verb, x.u || page_id AS url FROM pages, (VALUES (1, 'GET', '/a/'), (2, 'PUT', '/b/'), (3, 'DELETE', '/c/'), (3, 'POST', '/d/'), (4, 'PATCH', '/e/'), (5, 'POST', '/g/'), (6, 'PUT', '/h/'), (7, 'DELETE', '/i/'), (8, 'GET', '/j/')) x(line, verb, u)")
def script_requests(spark: SparkSession, sf: str) -> DataFrame:
    k = c("page_id").cast("string")
    text = F.concat(lit("axios.get('/a/"), k, lit("');\nfetch(\"/b/"), k, lit("\", {method: 'put'})\n$.ajax({url: '/c/"), k, lit("', type: 'DELETE'}); $.post('/d/"), k, lit("')\naxios({method: 'patch', url: '/e/"), k, lit("'}); fetch(`/f/${id}`)\n$.ajax({data: {a: {b: 1}}, url: '/g/"), k, lit("', type: 'POST'})\nfetch('/h/"), k, lit("', {headers: {A: '}'}, method: 'PUT'})\naxios.request({url: '/i/"), k, lit("', method: `delete`})\nfetch('/j/"), k, lit("', {headers: f({A: 'b'})})"))
    return scripts.requests(table(spark, sf, "pages").select(F.concat(lit("js/"), k, lit(".js")).alias("path"), text.alias("content")))


def _templates(spark: SparkSession, sf: str) -> DataFrame:
    k, size = c("p_partkey").cast("string"), c("p_size").cast("string")
    text = F.concat(lit("@extends('layouts."), c("p_brand"), lit("') @include('p."), size, lit("') @each('p."), size, lit("', $x) @includeWhen(f($a, [1, 2]), 'w."), k, lit("') @includeUnless($a, 'u."), k, lit("') @includeWhen($a, 'u."), k, lit("') @includeWhen($b, 't."), k, lit("') @includeUnless($b, 't."), k, lit("') @extends('second') @includeFirst(['f."), k, lit("', 'p."), size, lit("']) @include($dynamic) <x-c"), size, lit("/> <x:c"), size, lit("> @component('modal')"))
    return table(spark, sf, "part").select(F.concat(lit("resources/views/part/p"), k, lit(".blade.php")).alias("path"), text.alias("content"))


@query("SELECT 'part.p' || p_partkey AS view, x.t AS target, x.d AS directive FROM (SELECT p_partkey, unnest([{'t': 'layouts.' || p_brand, 'd': 'extends'}, {'t': 'p.' || p_size, 'd': 'includeFirst'}, {'t': 'w.' || p_partkey, 'd': 'includeWhen'}, {'t': 'u.' || p_partkey, 'd': 'includeWhen'}, {'t': 't.' || p_partkey, 'd': 'includeUnless'}, {'t': 'f.' || p_partkey, 'd': 'includeFirst'}]) AS x FROM part)")
def template_includes(spark: SparkSession, sf: str) -> DataFrame:
    return templates.includes(_templates(spark, sf))


@query("SELECT 'part.p' || p_partkey AS view, unnest(['c' || p_size, 'modal']) AS component FROM part")
def template_components(spark: SparkSession, sf: str) -> DataFrame:
    return templates.components(_templates(spark, sf))
