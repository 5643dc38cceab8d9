"""Inheritance, interface substitution, call resolution, and routes from tables."""

import pytest

from strandline.operators import symbols
from strandline.sources import routes

CLASS = "class string, kind string, parent string, interfaces array<string>, traits array<string>, is_project boolean, file string"


@pytest.fixture(scope="module")
def classes(spark):
    return spark.createDataFrame([
        ("A", "class", "B", ["I"], ["T"], True, "a"), ("B", "class", "C", [], None, True, "b"), ("C", "class", None, ["J"], [], False, "c"),
        ("T", "trait", None, [], [], True, "t"), ("I", "interface", None, [], [], True, "i"), ("J", "interface", None, [], [], True, "j"), ("L", "class", "L", [], [], True, "l"),
    ], CLASS)


@pytest.fixture(scope="module")
def methods(spark):
    return spark.createDataFrame([("T", "run", "int"), ("B", "Run", "string"), ("C", "stop", None), ("I", "go", None), ("A", "own", None)], "class string, method string, return_type string")


def rows(df):
    return sorted((tuple(x) for x in df.collect()), key=str)


def test_lookup_order(classes, methods):
    got = {(x["class"], x.method): x.owner for x in symbols.inherited_methods(classes, methods).collect()}
    assert got[("a", "run")] == "T" and got[("b", "run")] == "B" and got[("a", "stop")] == "C" and got[("a", "go")] == "I" and ("l", "run") not in got
    assert rows(symbols.descends_from(classes, ["C"])) == [("a",), ("b",)]


def test_calls(spark, classes, methods):
    bindings = spark.createDataFrame([("J", "B", True)], "abstract string, concrete string, shared boolean")
    calls = spark.createDataFrame([("f", "I", "own", "param", 1.0), ("f", "J", "run", "param", 1.0), ("f", "Z\\X", "q", "static", 1.0), ("f", "A", "none", "return_type", 1.0), ("f", None, "lost", None, None)], "from_key string, type string, member string, resolution string, confidence double")
    edges, left = symbols.resolve_calls(calls, classes, methods, bindings)
    assert rows(edges.select("to_key", "resolution", "confidence")) == [("class:A", "return_type", 0.8), ("external:Z\\X", "static", 1.0), ("method:A::own", "interface", 0.6), ("method:B::run", "container", 1.0)]
    assert rows(left) == [("f", "calls", "lost")]


def test_routes(spark, classes, methods):
    table = spark.createDataFrame([(["HEAD", "GET"], "x/{id}", "x.show", "A@own", ["auth", "can:edit"], None), (["POST"], "/y", None, "Closure", None, None), (["GET"], "z", None, "\\A", [], None)], "methods array<string>, uri string, name string, action string, middleware array<string>, domain string")
    nodes = routes.route_nodes(table)
    assert rows(nodes.select("key")) == [("route:GET /x/{id}",), ("route:GET /z",), ("route:POST /y",)]
    assert rows(routes.handlers(nodes, symbols.inherited_methods(classes, methods))) == [("routes_to", "route:GET /x/{id}", "method:A::own")]
    made, used = routes.middleware(nodes, spark.createDataFrame([("can", "App\\Can")], "alias string, class string"))
    assert rows(made.select("name", "class")) == [("auth", None), ("can:edit", "App\\Can")] and used.count() == 2
    b = spark.createDataFrame([("i", "A", True), ("I", "I", False), ("I", None, False), ("I", "Q", False)], "abstract string, concrete string, shared boolean")
    assert rows(routes.binds(b, classes)) == [("binds", "class:I", "class:A", True)]


def test_aliases(spark, classes):
    types = spark.createDataFrame([("a", 1), ("A", 2), ("db", 3), ("My\\DB", 4), (None, 5), ("arr", 6), ("Arr", 6)], "type string, k int")
    own = classes.select("class").unionByName(spark.createDataFrame([("ARR",), ("arr",)], "class string"))
    assert rows(symbols.expand_aliases(types, own)) == sorted([("a", 1), ("A", 2), ("Illuminate\\Support\\Facades\\DB", 3), ("My\\DB", 4), (None, 5), ("arr", 6), ("Arr", 6)], key=str)
    assert rows(symbols.expand_aliases(types, own, {"A": "X\\A", "Q": "X\\Q"})) == rows(types) and rows(symbols.expand_aliases(types, own, {})) == rows(types)
