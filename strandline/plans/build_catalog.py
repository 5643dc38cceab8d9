"""Queries of stored state: rebuilds to a fixed point, versions as deltas, builds, misses, exports, communities."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import analysis, builds, extractors, membership, summaries
from strandline.operators.invalidate import rebuild
from strandline.operators.versions import Conflict, Delta, Log
from strandline.plans.catalog import _MEMBER, _WEIGHTS
from strandline.plans.registry import query
from strandline.plans.runtime import cut, run_folder
from strandline.plans.testbed import edges, nodes, table
from strandline.sources import literals, markdown
from strandline.streaming import watch


def new_log(spark: SparkSession) -> Log:
    return Log(spark, f"{run_folder(spark)}/log-{uuid.uuid4().hex}")


# the documents as files, in two snapshots: some go, some come, some change

_S1 = "SELECT doc_id, 'doc/' || doc_id AS path, md5(text) AS hash FROM documents WHERE doc_id % 10 <> 0"
_S2 = "SELECT doc_id, 'doc/' || doc_id AS path, md5(text || CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE '' END) AS hash FROM documents WHERE doc_id % 7 <> 0"


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents")
    path = F.concat(F.lit("doc/"), F.col("doc_id"))
    later = F.concat("text", F.when(F.col("doc_id") % 13 == 0, "x").otherwise(""))
    one = docs.where("doc_id % 10 <> 0").select("doc_id", path.alias("path"), F.md5(F.col("text").cast("binary")).alias("hash"))
    return one, docs.where("doc_id % 7 <> 0").select("doc_id", path.alias("path"), F.md5(later.cast("binary")).alias("hash"))


def typed_documents(files: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A document declares itself. Every third one has a shape of its own, its hash; the others look up the document of
    a quarter of their number and take its shape, or none if it is missing."""
    own = files.select("path", "hash", F.concat(F.lit("doc:"), "doc_id").alias("symbol"), F.when(F.col("doc_id") % 3 != 0, F.expr("concat('doc:', doc_id div 4)")).alias("other"))
    found = own.join(known.select(F.col("symbol").alias("other"), F.col("shape").alias("theirs"), F.lit(True).alias("hit")).hint("merge"), "other", "left")
    shape = F.when(F.col("other").isNull(), F.col("hash")).otherwise(F.coalesce("theirs", F.lit("none")))
    return found.select("path", "symbol", shape.alias("shape")), found.where("other is not null").select("path", F.col("other").alias("symbol"), F.coalesce("hit", F.lit(False)).alias("hit"))


def typed_outputs(files: DataFrame, known: DataFrame) -> dict[str, DataFrame]:
    """An edge to each document that is looked up and found, a row of what is missing for each that is not."""
    _, looked = typed_documents(files, known)
    own = F.concat(F.lit("doc:"), F.substring("path", 5, 20))
    return {
        "edges": looked.where("hit").select("path", own.alias("from_key"), F.col("symbol").alias("to_key")),
        "unresolved": looked.where("not hit").select("path", F.col("symbol").alias("expression")),
    }


_TYPED = f"""WITH RECURSIVE s1 AS ({_S1}), s2 AS ({_S2}),
up(snap, doc_id, spot, hops) AS (SELECT 1, doc_id, doc_id, 0 FROM s1 UNION ALL SELECT 2, doc_id, doc_id, 0 FROM s2
  UNION ALL SELECT snap, doc_id, spot // 4, hops + 1 FROM up WHERE spot % 3 <> 0 AND (CASE WHEN snap = 1 THEN spot IN (SELECT doc_id FROM s1) ELSE spot IN (SELECT doc_id FROM s2) END)),
top AS (SELECT snap, doc_id, arg_max(spot, hops) AS spot FROM up GROUP BY ALL),
shape AS (SELECT snap, top.doc_id, coalesce(CASE WHEN snap = 1 THEN a.hash ELSE b.hash END, 'none') AS shape FROM top LEFT JOIN s1 a ON a.doc_id = spot LEFT JOIN s2 b ON b.doc_id = spot),
st AS (SELECT coalesce(s1.doc_id, s2.doc_id) AS doc_id, CASE WHEN s1.doc_id IS NULL THEN 'new' WHEN s2.doc_id IS NULL THEN 'deleted' WHEN s1.hash <> s2.hash THEN 'changed' END AS status FROM s1 FULL JOIN s2 USING (doc_id)),
aff AS (SELECT s2.doc_id FROM s2 LEFT JOIN shape p ON p.snap = 1 AND p.doc_id = s2.doc_id // 4 LEFT JOIN shape q ON q.snap = 2 AND q.doc_id = s2.doc_id // 4 WHERE s2.doc_id % 3 <> 0 AND p.shape IS DISTINCT FROM q.shape),
t AS (SELECT doc_id, coalesce(status, 'affected') AS status FROM st WHERE status IS NOT NULL OR doc_id IN (SELECT doc_id FROM aff))"""


def _typed(spark: SparkSession, sf: str):
    one, two = snapshots(spark, sf)
    log = new_log(spark)
    rebuild(log, one, typed_documents, typed_outputs)
    return log, rebuild(log, two, typed_documents, typed_outputs)


@query(_TYPED + " SELECT 'doc/' || doc_id AS path, status, s.shape FROM t LEFT JOIN (SELECT * FROM shape WHERE snap = 2) s USING (doc_id)")
def rebuild_touched(spark: SparkSession, sf: str) -> DataFrame:
    """Files that the second snapshot's rebuild touches, through chains of documents that take over shapes, with the
    shape that each declares in the end."""
    log, done = _typed(spark, sf)
    return done.touched.join(log.read("declared").hint("merge"), "path", "left").select("path", "status", "shape")


@query(_TYPED + """ SELECT 'edges' AS what, 'doc:' || doc_id AS a, 'doc:' || doc_id // 4 AS b FROM s2 WHERE doc_id % 3 <> 0 AND doc_id // 4 IN (SELECT doc_id FROM s2)
UNION ALL SELECT 'unresolved', 'doc/' || doc_id, 'doc:' || doc_id // 4 FROM s2 WHERE doc_id % 3 <> 0 AND doc_id // 4 NOT IN (SELECT doc_id FROM s2)
UNION ALL SELECT 'consulted', 'doc/' || doc_id, 'doc:' || doc_id // 4 FROM s2 WHERE doc_id % 3 <> 0 UNION ALL SELECT 'files', path, hash FROM s2""")
def rebuild_state(spark: SparkSession, sf: str) -> DataFrame:
    """The stored tables after two incremental rebuilds: the same as built from the second snapshot alone."""
    log, _ = _typed(spark, sf)
    rows = lambda name, a, b: log.read(name).select(F.lit(name).alias("what"), F.col(a).alias("a"), F.col(b).alias("b"))
    return rows("edges", "from_key", "to_key").unionByName(rows("unresolved", "path", "expression")).unionByName(rows("consulted", "path", "symbol")).unionByName(rows("files", "path", "hash"))


_CALLS = "SELECT l_suppkey AS supplier, l_partkey AS part, l_orderkey AS file, CASE WHEN l_linenumber <= 3 THEN l_linenumber END AS line, l_quantity AS weight FROM lineitem"


@query(f"""WITH a AS ({_CALLS} WHERE l_returnflag = 'A'), b AS (SELECT supplier, part, file, line, weight + 1 AS weight FROM ({_CALLS} WHERE l_returnflag <> 'R' AND l_orderkey % 4 <> 1) x),
one AS (SELECT supplier, part, file, line, max(weight) AS weight FROM a WHERE line IS NOT NULL GROUP BY ALL), two AS (SELECT supplier, part, file, line, max(weight) AS weight FROM b WHERE line IS NOT NULL GROUP BY ALL),
loose AS (SELECT (SELECT count(*) FROM a WHERE line IS NULL) AS a, (SELECT count(*) FROM b WHERE line IS NULL) AS b),
m AS (SELECT count(*) AS new, count(o.weight) AS both, count(*) FILTER (o.weight = t.weight) AS same FROM two t LEFT JOIN one o USING (supplier, part, file, line)),
gone AS (SELECT count(*) AS n FROM (SELECT file FROM one UNION ALL SELECT file FROM a WHERE line IS NULL) WHERE file % 5 = 0)
SELECT 1 AS version, 'base' AS writer, (SELECT count(*) FROM one) + a AS added, 0::BIGINT AS removed, (SELECT count(*) FROM one) + a AS rows FROM loose
UNION ALL SELECT 2, 'second', 0, (SELECT n FROM gone), (SELECT count(*) FROM one) + a - (SELECT n FROM gone) FROM loose
UNION ALL SELECT 3, 'first', x.added, x.removed, (SELECT count(*) FROM one) + a - (SELECT n FROM gone) + x.added - x.removed FROM loose,
  (SELECT count(*) FILTER (o.weight IS NULL OR o.weight <> t.weight) + (SELECT b FROM loose) AS added, count(*) FILTER (o.weight <> t.weight) AS removed FROM two t LEFT JOIN (SELECT * FROM one WHERE file % 5 <> 0) o USING (supplier, part, file, line)) x""")
def edge_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as edges with a place that may be null. Two writers start from the first version: one replaces
    edges by place, the other removes those of some files and is first; the slower one has a conflict and works anew
    from the newer version. Rows that each version added and removed, and rows that a reader of it finds."""
    lines = table(spark, sf, "lineitem")
    calls = lambda where: lines.where(where).select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("file"), F.when(F.col("l_linenumber") <= 3, F.col("l_linenumber")).alias("line"), F.col("l_quantity").alias("weight"))
    keys, log = ["supplier", "part", "file", "line"], new_log(spark)
    put = lambda df: lambda at: {"edges": log.put("edges", df, keys, at)}
    log.change(put(calls("l_returnflag = 'A'")), writer="base")
    later = put(calls("l_returnflag <> 'R' and l_orderkey % 4 <> 1").withColumn("weight", F.col("weight") + 1))
    slow = later(1)  # worked out from version 1 before the other writer commits
    files = lines.where("l_orderkey % 5 = 0").select(F.col("l_orderkey").alias("file"))
    log.commit({"edges": log.without("edges", files, ["file"], 1)}, 1, writer="second")
    try:
        log.commit(slow, 1, writer="first")
    except Conflict:
        log.change(later, writer="first")
    counts = [log.read("edges", v).agg(F.count("*").alias("rows")).withColumn("version", F.lit(v)) for v in (1, 2, 3)]
    writers = spark.createDataFrame([(1, "base"), (2, "second"), (3, "first")], "version int, writer string")
    rows = counts[0].unionByName(counts[1]).unionByName(counts[2])
    return log.history().join(writers, "version").join(rows, "version").select("version", "writer", "added", "removed", "rows")


@query(f"""WITH one AS (SELECT DISTINCT supplier, part FROM ({_CALLS} WHERE l_returnflag = 'A')), two AS (SELECT DISTINCT supplier, part FROM ({_CALLS} WHERE l_returnflag = 'N'))
SELECT supplier, part, 'added' AS change FROM two WHERE (supplier, part) NOT IN (SELECT (supplier, part) FROM one) UNION ALL SELECT supplier, part, 'removed' FROM one WHERE supplier % 3 = 0 AND (supplier, part) NOT IN (SELECT (supplier, part) FROM two)""")
def edge_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What two later versions changed for a reader of the first: an upsert, and a removal of what it left alone."""
    calls = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"), "l_returnflag")
    one, two = (calls.where(F.col("l_returnflag") == x).select("supplier", "part").distinct() for x in "AN")
    log = new_log(spark)
    for df in (one, two):
        log.change(lambda at, df=df: {"pairs": log.put("pairs", df, ["supplier", "part"], at)})
    some = one.where("supplier % 3 = 0").join(two, ["supplier", "part"], "left_anti")
    log.change(lambda at: {"pairs": log.without("pairs", some, ["supplier", "part"], at)})
    return log.changes("pairs", 1)


# a stream of files


@query(f"""WITH one AS ({_S1}), two AS ({_S2}) SELECT coalesce(one.path, two.path) AS path, coalesce(two.hash, one.hash) AS hash,
CASE WHEN one.path IS NULL OR one.hash <> two.hash THEN 2 ELSE 1 END AS batch, CAST(CASE WHEN one.path IS NOT NULL AND one.hash <> two.hash THEN 2 ELSE 1 END AS BIGINT) AS times FROM one FULL JOIN two USING (path)""")
def files_followed(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of files that stops and goes on: its table, the run that has last changed a file, and how often each was
    handed on. Rows that tell nothing new are neither written nor handed on."""
    log, inbox, state = new_log(spark), f"{run_folder(spark)}/inbox-{uuid.uuid4().hex}", f"{run_folder(spark)}/stream-{uuid.uuid4().hex}"
    told: list[DataFrame] = []
    for n, seen in enumerate(snapshots(spark, sf), 1):
        rows = seen.select("path", "hash", F.lit(n).alias("seen"))
        rows.write.mode("append").parquet(inbox)
        hand_on = lambda changed, number, n=n: told.append(cut(changed.withColumn("batch", F.lit(n))))
        watch.follow(spark.readStream.schema(rows.schema).parquet(inbox), log, state, hand_on).awaitTermination()
    calls = reduce(DataFrame.unionByName, told).groupBy("path").agg(F.max("batch").alias("batch"), F.count("*").alias("times"))
    return log.read("files").join(calls, "path").select("path", "hash", "batch", "times")


# builds, misses, communities


@query(f"""WITH one AS ({_S1}), two AS ({_S2}) SELECT 1 AS id, 'full' AS kind, count(*) AS new_nodes, 0::BIGINT AS changed_nodes, count(*) FILTER (doc_id % 3 = 1) AS edges, false AS last FROM one
UNION ALL SELECT 3, 'incremental', count(*) FILTER (one.hash IS NULL), count(*) FILTER (one.hash <> two.hash), count(*) FILTER (two.doc_id % 3 = 2), true FROM two LEFT JOIN one USING (path)""")
def build_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Two builds over documents as nodes: what each wrote, counted while it was written, and which is the last."""
    log, (one, two) = new_log(spark), snapshots(spark, sf)
    for kind, docs, rest in (("full", one, 1), ("incremental", two, 2)):
        edges = docs.where(docs.doc_id % 3 == rest).select(F.col("path").alias("from_key"), F.lit("x").alias("to_key"))
        builds.record(log, kind, lambda at, docs=docs, edges=edges: {"nodes": log.put("nodes", docs.select(F.col("path").alias("key"), "hash"), ["key"], at), "edges": Delta(edges)}, 0.0, lambda: 1.0)
    newest = builds.last(log).select("id", F.lit(True).alias("last"))
    return log.read("builds").join(newest, "id", "left").select("id", "kind", "new_nodes", "changed_nodes", "edges", F.coalesce("last", F.lit(False)).alias("last"))


@query("SELECT 1 AS batch, event_type, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY event_type UNION ALL SELECT 2, event_type, count(*) FROM events WHERE event_id % 3 = 1 GROUP BY event_type")
def misses_exported(spark: SparkSession, sf: str) -> DataFrame:
    """Events as rows of questions without an answer, appended in two commits and exported after each: rows of every
    batch as the files have them."""
    log, events, folder = new_log(spark), table(spark, sf, "events"), f"{run_folder(spark)}/export-{uuid.uuid4().hex}"
    for k in (0, 1):
        log.commit({"misses": Delta(events.where(F.col("event_id") % 3 == k).select("event_id", "event_type"))})
        builds.export(log, "misses", folder)
    return spark.read.json(folder).groupBy("batch", "event_type").agg(F.count("*").alias("n"))


def _given(spark: SparkSession, sf: str) -> DataFrame:
    n = nodes(spark, sf)
    return n.join(analysis.eligible(n).select("key"), "key", "left_semi").select("key", F.coalesce("file", "type").alias("community"))


@query(_WEIGHTS + _MEMBER + """, far AS (SELECT DISTINCT x.key, m.community FROM (SELECT a AS key, b AS other FROM w UNION ALL SELECT b, a FROM w) x JOIN mem m ON m.key = x.other)
SELECT deg.key, deg.type, degree, (SELECT count(*) FROM far WHERE far.key = deg.key AND far.community IS DISTINCT FROM (SELECT community FROM mem WHERE mem.key = deg.key)) AS bridges FROM deg ORDER BY degree DESC, deg.key LIMIT 20""", graph=True)
def hubs_with_bridges(spark: SparkSession, sf: str) -> DataFrame:
    """The largest hubs with the communities they bridge, from stored communities: here the file of a node, else its
    type."""
    log, n, e = new_log(spark), nodes(spark, sf), edges(spark, sf, None)
    membership.store(log, _given(spark, sf), n, e, "2024-01-01T00:00:00+00:00")
    return membership.hubs(log, n, e)


@query(_WEIGHTS + _MEMBER + " SELECT community, count(*) AS size, '2024-01-01T00:00:00+00:00' AS computed_at, '1.0' AS resolution FROM mem GROUP BY community", graph=True)
def communities_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Stored communities as they are read back, with their time."""
    log = new_log(spark)
    membership.store(log, _given(spark, sf), nodes(spark, sf), edges(spark, sf, None), "2024-01-01T00:00:00+00:00")
    return membership.summary(log).rows.select("community", "size", "computed_at", "resolution")


# routes by name, literal names


def _routes(spark: SparkSession, sf: str) -> DataFrame:
    """All nodes with a variant of what routes carry."""
    name = F.concat(F.lit("region."), F.element_at(F.split("key", "/"), -1))
    said = F.to_json(F.struct(name.alias("name"), F.lit("GeoController@show").alias("action"), F.array(F.lit("web"), name).alias("middleware"), F.when(F.col("key").endswith("europe"), "eu.test").alias("domain")))
    return nodes(spark, sf).withColumn("meta", F.parse_json(F.when(F.col("type") == "route", said).otherwise("{}")))


@query(""" SELECT 'route:GET /europe' AS key, 'region.europe' AS name, 'GeoController@show' AS action, 'web region.europe' AS middleware, 'eu.test' AS domain,
coalesce((SELECT string_agg(substr(v.to_key, 6), ' ' ORDER BY v.to_key) FROM (SELECT DISTINCT to_key FROM edges WHERE type = 'routes_to' AND from_key = 'route:GET /europe') h JOIN edges v ON v.type = 'renders' AND v.from_key = h.to_key), '') AS views""", graph=True)
def route_by_name(spark: SparkSession, sf: str) -> DataFrame:
    found = summaries.route_detail(_routes(spark, sf), edges(spark, sf), "region.europe")
    return found.withColumns({"middleware": F.array_join("middleware", " "), "views": F.array_join("views", " ")})


@query(""" SELECT 'p/' || page_id AS path, 'region.' || lower(r_name) AS text, 'route:GET /' || lower(r_name) AS keys, 'route_name' AS matches FROM pages JOIN region ON page_id % 7 = r_regionkey""", graph=True)
def mentions_by_route_name(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions of routes by their names, which no other lookup knows."""
    pages, region = table(spark, sf, "pages"), table(spark, sf, "region")
    said = pages.join(F.broadcast(region.select("r_regionkey", "r_name")), F.expr("page_id % 7 = r_regionkey"))
    mentions = said.select(F.concat(F.lit("p/"), "page_id").alias("path"), F.lit("all").alias("anchor"), F.concat(F.lit("region."), F.lower("r_name")).alias("text"), F.lit(False).alias("backticked"))
    found = markdown.resolve_mentions(mentions, nodes(spark, sf), summaries.route_names(_routes(spark, sf)))
    return found.select("path", "text", F.array_join("keys", " ").alias("keys"), F.array_join("matches", " ").alias("matches"))


@query(""", p AS (SELECT page_id AS k, 'src/' || page_id || '.php' AS path FROM pages), names AS (SELECT 'region.' || lower(r_name) AS name, 'route:GET /' || lower(r_name) AS key FROM region)
SELECT 'renders' AS what, path, 2 AS line, 'view:page.p' || k AS other, NULL AS candidates FROM p UNION ALL SELECT 'renders', path, 6, 'view:made', NULL FROM p
UNION ALL SELECT 'links_route', path, 3, 'route:GET /europe', NULL FROM p UNION ALL SELECT 'links_route', path, 3, 'route:GET /asia', NULL FROM p WHERE k % 2 = 0
UNION ALL SELECT 'unresolved links_route', path, 3, 'gone' || k, 'route name ''gone' || k || ''' not found' FROM p WHERE k % 2 = 1
UNION ALL SELECT 'unresolved view', path, 4, 'view($name)', NULL FROM p UNION ALL SELECT 'unresolved route', path, 5, 'route("a.$x")', NULL FROM p""", graph=True)
def literal_names(spark: SparkSession, sf: str) -> DataFrame:
    """Scripts made of the pages' numbers: views and routes by literal names, names that are put together, unknown
    routes, and calls that only look alike."""
    k = F.col("page_id").cast("string")
    lit, other = F.lit, F.when(F.col("page_id") % 2 == 0, "region.asia").otherwise(F.concat(F.lit("gone"), k))
    text = F.concat(lit("<?php // preview('no'), $view('no'), $a->view('no'), X::route('no'), view()\nreturn view('page.p"), k, lit("', []);\nroute('region.europe'); TO_ROUTE( '"), other, lit("' );\nview($name);\nroute(\"a.$x\");\nView::make(\n\"made\"); View::make($x);"))
    found = literals.scan(table(spark, sf, "pages").select(F.concat(lit("src/"), k, lit(".php")).alias("path"), text.alias("content")))
    edges_, open_ = literals.resolve(found, summaries.route_names(_routes(spark, sf)))
    done = edges_.select(F.col("type").alias("what"), "path", "line", F.col("to_key").alias("other"), lit(None).cast("string").alias("candidates"))
    return done.unionByName(literals.without_noise(open_).select(F.concat(lit("unresolved "), "kind").alias("what"), "path", "line", F.col("expression").alias("other"), F.array_join("candidates", " ").alias("candidates")))


# extractors


def _title(path: str, content: str):
    if found := re.search("<h1[^>]*>([^<]*)</h1>", content):
        yield "nodes", {"key": f"page:{path}", "type": "page", "name": found[1], "line": 1}


def _hrefs(path: str, content: str):
    for target in re.findall('href="([^"]*)"', content):
        if target.startswith("/"):
            yield "edges", {"type": "links", "from_key": f"page:{path}", "to_key": f"uri:{target}"}
        else:
            yield "unresolved", {"kind": "href", "expression": target, "candidates": [f"/{target}"]}


@query("""WITH p AS (SELECT CAST(page_id AS VARCHAR) AS path, html FROM pages), h AS (SELECT path, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM p)
SELECT 'titles nodes' AS what, path, 'page:' || path AS a, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS b FROM p WHERE regexp_matches(html, '<h1[^>]*>[^<]*</h1>')
UNION ALL SELECT 'hrefs edges', path, 'page:' || path, 'uri:' || target FROM h WHERE starts_with(target, '/') UNION ALL SELECT 'hrefs unresolved', path, target, '/' || target FROM h WHERE NOT starts_with(target, '/')""")
def extractor_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Two extractors over the pages, read once: titles as nodes, links as edges or unresolved."""
    registry = extractors.Registry().add(extractors.Extractor("titles", ("html",), _title)).add(extractors.Extractor("hrefs", ("html", "md"), _hrefs))
    out = registry.run(table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("path"), F.lit("html").alias("lang"), F.col("html").alias("content")))
    rows = lambda name, a, b: out[name].select(F.concat_ws(" ", "extractor", F.lit(name)).alias("what"), "path", F.col(a).alias("a"), b.alias("b"))
    return rows("nodes", "key", F.col("name")).unionByName(rows("edges", "from_key", F.col("to_key"))).unionByName(rows("unresolved", "expression", F.col("candidates")[0]))


@query(" , m AS (SELECT t.to_key, from_key FROM edges t WHERE t.type = 'touches_table') SELECT DISTINCT to_key AS table_key, n.file FROM m JOIN nodes n ON n.key = m.from_key WHERE m.to_key = (SELECT min(to_key) FROM m)", graph=True)
def table_migrations(spark: SparkSession, sf: str) -> DataFrame:
    """Files that touch one table: here an edge's file is the one of its start."""
    e, n = edges(spark, sf), nodes(spark, sf)
    first = e.where("type = 'touches_table'").agg(F.min("to_key")).first()[0]
    placed = e.where(F.col("to_key") == first).join(n.select(F.col("key").alias("from_key"), "file"), "from_key")
    return summaries.migrations(placed, first).select(F.lit(first).alias("table_key"), "file")
