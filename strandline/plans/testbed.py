"""A property graph over the star schema: every node and edge type that the queries need.

nodes(key, type, name, file, is_project, kind); edges(type, from_key, to_key, resolution, confidence).
Keys are unique, so they order ties; no surrogate numbers are needed and no global sort."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.keys import key
from strandline.operators.lookup import Index
from strandline.plans.runtime import exists, run_folder

NODES = ("key", "type", "name", "file", "is_project", "kind")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(df: DataFrame, type_: str, name, k, file=None, project=None, kind=None) -> DataFrame:
    none = F.lit(None)
    return df.select(
        k.alias("key"), F.lit(type_).alias("type"), name.alias("name"), (none if file is None else file).cast("string").alias("file"),
        (none if project is None else project).cast("boolean").alias("is_project"), (none if kind is None else kind).cast("string").alias("kind"),
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def class_name() -> F.col:
    return F.concat(F.lit("Geo\\"), F.col("n_name"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the key of their method: c_custkey, m, c_name and their nation's columns."""
    nation = F.broadcast(table(spark, sf_dir, "nation"))
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.withColumn("m", key("method", class_name(), "::", F.col("c_name")))


def build_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    nation, c = t("nation"), F.col
    file, project = F.concat(F.lit("geo/"), c("n_name"), F.lit(".php")), c("n_regionkey") != 4
    kind = F.when(c("n_nationkey") % 5 == 0, "job").when(c("n_nationkey") % 5 == 1, "command")
    route = F.concat(F.lit("GET /"), F.lower("r_name"))
    view, part, page = F.concat(F.lit("order."), c("o_orderkey")), F.concat(F.lit("part_"), c("p_partkey")), F.concat(F.lit("page "), c("page_id"))
    return _union([
        _node(t("region"), "route", route, key("route", route)),
        _node(nation, "class", class_name(), key("class", class_name()), file, project, kind),
        _node(nation, "file", file, key("file", file), file, project),
        _node(people(spark, sf_dir), "method", c("c_name"), c("m"), file, project),
        _node(t("supplier"), "function", c("s_name"), key("function", c("s_name"))),
        _node(t("orders").where("o_orderpriority = '1-URGENT'"), "view", view, key("view", view)),
        _node(t("part"), "table", part, key("table", part)),
        _node(t("pages"), "section", page, key("section", "pages/", c("page_id").cast("string"), ".md#top")),
        _node(t("orders").select("o_orderpriority").distinct(), "external", c("o_orderpriority"), key("external", c("o_orderpriority"))),
    ])


def build_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    c = F.col

    def edge(df: DataFrame, type_: str, a, b, resolution=None, confidence=None) -> DataFrame:
        none = F.lit(None)
        return df.select(
            F.lit(type_).alias("type"), a.alias("from_key"), b.alias("to_key"),
            (none if resolution is None else resolution).cast("string").alias("resolution"), (none if confidence is None else confidence).cast("double").alias("confidence"),
        )

    nation, who = t("nation"), people(spark, sf_dir)
    cls, file = key("class", class_name()), key("file", "geo/", c("n_name"), ".php")
    orders = t("orders").join(who.select("c_custkey", "m"), c("o_custkey") == c("c_custkey"))
    lines = t("lineitem").join(orders.select("o_orderkey", "m"), c("l_orderkey") == c("o_orderkey"))
    flag = lambda a, n, r: F.when(c("l_returnflag") == "A", a).when(c("l_returnflag") == "N", n).otherwise(r)
    calls = lines.where("l_linenumber = 1").join(t("supplier"), c("l_suppkey") == c("s_suppkey")).select("m", "s_name", "l_returnflag").distinct()
    nxt = orders.select((c("o_orderkey") - 1).alias("before"), c("m").alias("m2"))
    pairs = orders.where("o_orderstatus = 'F' and o_orderkey % 10 = 0").join(nxt, c("o_orderkey") == c("before")).where("m <> m2").select("m", "m2").distinct()
    urgent = orders.where("o_orderpriority = '1-URGENT'")
    return _union([
        edge(nation, "declares", file, cls),
        edge(who, "declares", cls, c("m")),
        edge(who.where("c_custkey % 50 = 0").join(F.broadcast(t("region")), c("n_regionkey") == c("r_regionkey")), "routes_to", key("route", "GET /", F.lower("r_name")), c("m")),
        edge(t("supplier").join(F.broadcast(nation), c("s_nationkey") == c("n_nationkey")), "instantiates", cls, key("function", c("s_name")), F.lit("new"), F.lit(1.0)),
        edge(calls, "calls", c("m"), key("function", c("s_name")), flag("static", "return_type", "eloquent"), flag(1.0, 0.8, 0.7)),
        edge(pairs, "calls", c("m"), c("m2"), F.lit("local_assign"), F.lit(0.8)),
        edge(urgent, "renders", c("m"), key("view", "order.", c("o_orderkey").cast("string"))),
        edge(lines.where("l_linenumber = 2 and l_returnflag = 'R'").select("m", "l_partkey").distinct(), "touches_table", c("m"), key("table", "part_", c("l_partkey").cast("string"))),
        edge(orders.where("o_orderstatus = 'P'").select("m", "o_orderpriority").distinct(), "resolves", c("m"), key("external", c("o_orderpriority")), F.lit("interface"), F.lit(0.6)),
        edge(t("pages").join(F.broadcast(nation), c("page_id") % 25 == c("n_nationkey")), "documents", key("section", "pages/", c("page_id").cast("string"), ".md#top"), cls),
    ])


#: Folders of the graphs that this process has stored, by application and state of the tables.
_STORED: dict[tuple, str] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the tables' files."""
    out = []
    for name in ("nation", "region", "customer", "supplier", "orders", "lineitem", "part", "pages"):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
        out += sorted((str(x.getPath()), x.getLen(), x.getModificationTime()) for x in found)
    return spark.sparkContext.applicationId, sf_dir, *out


def stored(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the graph's tables, one for an application and a state of the input tables."""
    state = _state(spark, sf_dir)
    if state not in _STORED or not exists(spark, _STORED[state]):
        _STORED[state] = f"{run_folder(spark)}/graph-{uuid.uuid4().hex}"
    return _STORED[state]


def _part(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table of the graph, written when it is first asked for: a query pays for no order that it does not read."""
    at = f"{stored(spark, sf_dir)}/{name}"
    if not exists(spark, f"{at}/_SUCCESS"):
        build().write.mode("overwrite").parquet(at)
    return spark.read.schema((build_nodes if name == "nodes" else build_edges)(spark, sf_dir).schema).parquet(at)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes sorted by key, so that a lookup of a key reads few row groups."""
    return _part(spark, sf_dir, "nodes", lambda: build_nodes(spark, sf_dir).repartitionByRange("key").sortWithinPartitions("key"))


def edges(spark: SparkSession, sf_dir: str, by: str | None = "from_key") -> DataFrame:
    """The edges, from the table that is sorted by from_key or to_key; by None: in no order, for those who read them all."""
    whole = _part(spark, sf_dir, "edges", lambda: build_edges(spark, sf_dir))
    if by is None:
        return whole
    other = "to_key" if by == "from_key" else "from_key"  # a hub's edges fill as many ranges as they need
    return _part(spark, sf_dir, by, lambda: whole.repartitionByRange(by, other).sortWithinPartitions(by))


def search_index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of keys and names, stored beside the graph when it is first asked for."""
    folder = stored(spark, sf_dir)
    if not exists(spark, f"{folder}/names/_SUCCESS"):
        grams, names = Index.tables(nodes(spark, sf_dir))
        grams.write.mode("overwrite").parquet(f"{folder}/grams")
        names.write.mode("overwrite").parquet(f"{folder}/names")
    return Index(spark.read.parquet(f"{folder}/grams"), spark.read.parquet(f"{folder}/names"))


#: The same graph for DuckDB.
SQL = r"""people AS (SELECT c_custkey, c_name, n_name, n_nationkey, n_regionkey, 'method:Geo\' || n_name || '::' || c_name AS m FROM customer JOIN nation ON c_nationkey = n_nationkey),
mine AS (SELECT orders.*, m FROM orders JOIN people ON o_custkey = c_custkey),
line AS (SELECT lineitem.*, m FROM lineitem JOIN mine ON l_orderkey = o_orderkey),
nodes AS (
  SELECT 'route:GET /' || lower(r_name) AS key, 'route' AS type, 'GET /' || lower(r_name) AS name, NULL::VARCHAR AS file, NULL::BOOLEAN AS is_project, NULL::VARCHAR AS kind FROM region
  UNION ALL SELECT 'class:Geo\' || n_name, 'class', 'Geo\' || n_name, 'geo/' || n_name || '.php', n_regionkey <> 4, CASE WHEN n_nationkey % 5 = 0 THEN 'job' WHEN n_nationkey % 5 = 1 THEN 'command' END FROM nation
  UNION ALL SELECT 'file:geo/' || n_name || '.php', 'file', 'geo/' || n_name || '.php', 'geo/' || n_name || '.php', n_regionkey <> 4, NULL FROM nation
  UNION ALL SELECT m, 'method', c_name, 'geo/' || n_name || '.php', n_regionkey <> 4, NULL FROM people
  UNION ALL SELECT 'function:' || s_name, 'function', s_name, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 'view:order.' || o_orderkey, 'view', 'order.' || o_orderkey, NULL, NULL, NULL FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT 'table:part_' || p_partkey, 'table', 'part_' || p_partkey, NULL, NULL, NULL FROM part
  UNION ALL SELECT 'section:pages/' || page_id || '.md#top', 'section', 'page ' || page_id, NULL, NULL, NULL FROM pages
  UNION ALL SELECT DISTINCT 'external:' || o_orderpriority, 'external', o_orderpriority, NULL, NULL, NULL FROM orders),
edges AS (
  SELECT 'declares' AS type, 'file:geo/' || n_name || '.php' AS from_key, 'class:Geo\' || n_name AS to_key, NULL::VARCHAR AS resolution, NULL::DOUBLE AS confidence FROM nation
  UNION ALL SELECT 'declares', 'class:Geo\' || n_name, m, NULL, NULL FROM people
  UNION ALL SELECT 'routes_to', 'route:GET /' || lower(r_name), m, NULL, NULL FROM people JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 50 = 0
  UNION ALL SELECT 'instantiates', 'class:Geo\' || n_name, 'function:' || s_name, 'new', 1.0 FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT DISTINCT 'calls', m, 'function:' || s_name, CASE l_returnflag WHEN 'A' THEN 'static' WHEN 'N' THEN 'return_type' ELSE 'eloquent' END,
    CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.8 ELSE 0.7 END FROM line JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber = 1
  UNION ALL SELECT DISTINCT 'calls', a.m, b.m, 'local_assign', 0.8 FROM mine a JOIN mine b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderstatus = 'F' AND a.o_orderkey % 10 = 0 AND a.m <> b.m
  UNION ALL SELECT 'renders', m, 'view:order.' || o_orderkey, NULL, NULL FROM mine WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT DISTINCT 'touches_table', m, 'table:part_' || l_partkey, NULL, NULL FROM line WHERE l_linenumber = 2 AND l_returnflag = 'R'
  UNION ALL SELECT DISTINCT 'resolves', m, 'external:' || o_orderpriority, 'interface', 0.6 FROM mine WHERE o_orderstatus = 'P'
  UNION ALL SELECT 'documents', 'section:pages/' || page_id || '.md#top', 'class:Geo\' || n_name, NULL, NULL FROM pages JOIN nation ON page_id % 25 = n_nationkey)"""
