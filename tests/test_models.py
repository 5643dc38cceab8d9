"""Models with their properties and tables, and parts of a stored graph that are replaced as one."""

import uuid

import pytest
from pyspark.sql import functions as F

from strandline.operators import lookup, models, scopes, summaries
from strandline.operators.versions import Delta, Log
from strandline.sources import markdown

CLASS = "class string, parent string, traits array<string>, interfaces array<string>, table string, file string"


@pytest.fixture(scope="module")
def classes(spark):
    base = "Illuminate\\Database\\Eloquent\\Model"
    return spark.createDataFrame([
        ("App\\Order", base.upper(), ["Kit\\SoftDeletes"], ["I"], None, "o"), ("App\\BigOrder", "app\\order", None, [], "big", "b"), ("App\\Plain", None, ["App\\T"], [], None, "p"),
        ("App\\T", None, ["Deep\\SoftDeletes"], [], None, "t"), ("I", None, None, None, None, "i"), ("Loop", "Loop", [], [], None, "l"), ("App\\ViaTrait", None, [base], [], None, "v"), ("App\\Bare", "App\\Plain", [], [], None, "q"),
    ], CLASS)


def rows(df):
    return sorted((tuple(x) for x in df.collect()), key=str)


def test_models_go_by_parents_alone(classes):
    assert rows(models.models(classes)) == [("app\\bigorder",), ("app\\order",)]
    # a trait of a trait does not count, one of a parent does
    assert rows(models.soft_deleting(classes)) == [("app\\bigorder",), ("app\\order",), ("app\\t",)]


def test_properties_and_times_of_models(spark, classes):
    given = spark.createDataFrame([("app\\ORDER", "total", "int", "declared"), ("App\\BigOrder", "updated_at", "string", "cast"), ("App\\T", "total", None, "docblock"), ("I", "never", "int", "declared"), ("App\\Order", "Total", "float", "declared"), ("App\\Order", "Total", "float", "declared")], "class string, property string, type string, source string")
    got = {(r["class"], r.property): (r.owner, r.type, r.source) for r in models.inherited_properties(classes, given).collect()}
    assert got[("app\\bigorder", "total")] == ("app\\ORDER", "int", "declared") and got[("app\\bigorder", "Total")][1] == "float"
    assert got[("app\\bigorder", "updated_at")] == ("App\\BigOrder", "string", "cast") and got[("app\\order", "updated_at")] == (None, "Carbon\\Carbon", "cast")
    assert got[("app\\bigorder", "deleted_at")] == got[("app\\order", "created_at")] == (None, "Carbon\\Carbon", "cast")
    assert got[("app\\bare", "total")] == ("App\\T", None, "docblock") and ("app\\plain", "created_at") not in got
    assert ("app\\order", "never") not in got and ("loop", "total") not in got
    assert models.inherited_properties(classes.limit(0), given).isEmpty()


NAMES = {
    "Order": "orders", "OrderItem": "order_items", "App\\Category": "categories", "Day": "days", "Box": "boxes", "Match": "matches", "Person": "people", "SalesPerson": "sales_people", "user": "users", "Knife": "knives",
    "Wolf": "wolves", "Analysis": "analyses", "Medium": "media", "Hero": "heroes", "Photo": "photos", "Status": "statuses", "Series": "series", "HTTPRequest": "h_t_t_p_requests", "Matrix": "matrices", "Mouse": "mice", "Quiz": "quizzes",
    "House": "houses", "Human": "humans", "Axis": "axes", "Roof": "roofs", "Oasis": "oases", "": "s",
}


def test_table_names(spark):
    got = dict(rows(spark.createDataFrame([(n,) for n in NAMES], "name string").select("name", models.table_name(F.col("name")))))
    assert got == NAMES


def test_tables_of_models(classes):
    found = models.table_edges(classes).select("from_key", "to_key", F.try_variant_get("meta", "$.source", "string"))
    assert rows(found) == [("class:App\\BigOrder", "table:big", "declared"), ("class:App\\Order", "table:orders", "convention")]


def test_summary_of_a_model(spark):
    nodes = spark.createDataFrame([("class:A\\X", "class", "A\\X"), ("class:A\\Y", "class", "A\\Y"), ("class:B\\Y", "class", "B\\Y"), ("class:A\\XL", "class", "A\\XL")], "key string, type string, name string")
    edges = spark.createDataFrame([
        ("maps_table", "class:A\\X", "table:b", None, "{}"), ("maps_table", "class:A\\X", "table:a", None, "{}"), ("relates", "class:A\\X", "class:A\\Y", None, '{"relation": "hasMany"}'), ("relates", "class:A\\X", "class:A\\Y", None, '{"relation": "hasMany"}'),
        ("observes", "class:O", "class:A\\X", None, "{}"), ("touches_table", "m", "table:a", "f1", "{}"), ("touches_table", "n", "table:a", "f1", "{}"), ("touches_table", "n", "table:a", None, "{}"), ("touches_table", "n", "table:b", "f2", "{}"), ("calls", "m", "class:A\\X", None, None),
    ], "type string, from_key string, to_key string, file string, meta string").withColumn("meta", F.parse_json("meta"))
    got = models.model(nodes, edges, "X")
    assert got.found and rows(got.rows.drop("key")) == sorted([("table", "table:a", None, 1), ("relations", "class:A\\Y", "hasMany", 2), ("observers", "class:O", None, 1), ("migrations", "f1", None, 1), ("call_sites", None, None, 1)], key=str)
    assert rows(models.model(nodes, edges, "A\\XL").rows.drop("key")) == [("call_sites", None, None, 0)]
    several, none = models.model(nodes, edges, "Y"), models.model(nodes, edges, "Z")
    assert not several.found and [r.key for r in several.suggestions.collect()] == ["class:A\\Y", "class:B\\Y"] and not none.found and none.suggestions.isEmpty()
    assert rows(models.details(edges, nodes.unionByName(nodes)).where("role = 'call_sites'").select("key", "n")) == [("class:A\\X", 1), ("class:A\\XL", 0), ("class:A\\Y", 0), ("class:B\\Y", 0)]


def test_routes_by_uri(spark):
    nodes = spark.createDataFrame([("route:GET /a_b", "route"), ("route:POST /A_B", "route"), ("route:GET /axb", "route"), ("route:GET /x/a_b", "route"), ("section:GET /a_b", "section")], "key string, type string")
    assert rows(lookup.routes_by_uri(nodes, "a_b").select("key")) == [("route:GET /a_b",), ("route:POST /A_B",)]
    assert lookup.routes_by_uri(nodes, "%").isEmpty()
    said = spark.createDataFrame([("p", "x", "/A_b", False)], "path string, anchor string, text string, backticked boolean")
    found = markdown.resolve_mentions(said, nodes.withColumn("name", F.col("key"))).first()
    assert found["keys"] == ["route:GET /a_b", "route:POST /A_B"] and found.matches == ["route_uri"]


def test_counts_of_nothing(spark):
    none = spark.createDataFrame([], "type string, kind string")
    assert [tuple(r) for r in summaries.docs_counts(none, none, none).collect()] == [(0,) * 8]
    docs = spark.createDataFrame([("doc:a", "doc", "a"), ("doc:b", "doc", None), ("section:a", "section", "a")], "key string, type string, file string")
    assert rows(summaries.doc_files(docs, spark.createDataFrame([("a", "h")], "path string, hash string")).select("key", "file_hash")) == [("doc:a", "h")]


def test_hydrate_leaves_out_files_and_nodes_without_one(spark):
    nodes = spark.createDataFrame([("class:A", "class", "A", "a"), ("class:B", "class", "B", "b"), ("class:N", "class", "N", None), ("method:A::x::y", "method", "y", "a"), ("method:A::x", "method", "x", "a"), ("method:B::x", "method", "x", "b"), ("method:Q::x", "method", "x", "a"), ("method:bad", "method", "bad", "a")], "key string, type string, name string, file string")
    none = spark.createDataFrame([], "path string")
    cls, methods = scopes.hydrate(nodes, none)
    assert cls.count() == 3 and rows(methods.select("key")) == [("method:A::x",), ("method:B::x",)]
    cls, methods = scopes.hydrate(nodes, spark.createDataFrame([("b",), ("b",)], "path string"))
    assert rows(cls.select("key")) == [("class:A",)] and rows(methods.select("class_key", "name")) == [("class:A", "x")] and cls.columns == nodes.columns
    assert rows(scopes.keys_of(nodes, "b")) == [("class:B",), ("method:B::x",)]


def test_replaced_scopes(spark, tmp_path):
    log = Log(spark, str(tmp_path / uuid.uuid4().hex))
    node, edge = "key string, type string", "type string, from_key string, file string, line int"
    routes = spark.createDataFrame([("r1", "route")], node)
    links = spark.createDataFrame([("routes_to", "r1", None, None)], edge)
    log.change(lambda at: scopes.replace_routes(log, at, routes, links))  # nothing is stored yet
    rest = spark.createDataFrame([("binds", "b", None, None), ("mentions", "s", "f", 3), ("mentions", "s", "f", 4), ("mentions", "s", "f", None), ("documents", "s", "f", 3)], edge)
    log.commit({"files": Delta(spark.createDataFrame([("f", "h"), ("g", "h")], "path string, hash string")), "edges": Delta(rest)})
    done = log.change(lambda at: scopes.replace_routes(log, at, spark.createDataFrame([("r2", "route"), ("m", "middleware")], node), links.limit(0)))
    assert done.rows == {"nodes": (2, 1), "edges": (0, 1)} and rows(log.read("nodes").select("key")) == [("m",), ("r2",)]
    log.change(lambda at: scopes.replace_bindings(log, at, spark.createDataFrame([("binds", "c", None, None)], edge)))
    places = spark.createDataFrame([("f", 3), ("f", 3), (None, None)], "file string, line int")
    log.change(lambda at: scopes.replace_concepts(log, at, places))
    assert rows(log.read("edges").select("type", "from_key", "line")) == [("binds", "c", None), ("documents", "s", 3), ("mentions", "s", 4), ("mentions", "s", None)]
    lost = spark.createDataFrame([("f", "x"), ("f", "x")], "path string, member string")
    assert log.change(lambda at: scopes.append_unresolved(log, at, lost)).rows == {"unresolved": (2, 0)}
    with pytest.raises(KeyError, match="nowhere"):
        log.change(lambda at: scopes.append_unresolved(log, at, spark.createDataFrame([("nowhere", "x")], "path string, member string")))
    assert rows(scopes.stored_files(log.read("files"), spark.createDataFrame([("g",), ("g",), ("q",)], "path string"))) == [("g", "h")]


def test_the_fifteenth_parent_is_the_last(spark):
    chain = spark.createDataFrame([(f"C{k}", f"C{k + 1}") for k in range(40)], "class string, parent string")
    got = set(rows(models.lineage(chain)))
    assert got == {(f"c{k}", f"c{k + d}") for k in range(40) for d in range(16) if k + d <= 40}
    ring = spark.createDataFrame([("A", "b"), ("B", "A"), ("B", "A")], "class string, parent string")
    assert rows(models.lineage(ring)) == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")]
