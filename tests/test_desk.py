"""Tools by name: their arguments, answers, and the questions without one."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from strandline.operators.builds import record
from strandline.operators.desk import TOOLS, Argument, Desk, Tool
from strandline.operators.lookup import Answer
from strandline.operators.versions import Delta, Log


@pytest.fixture
def desk(spark, tmp_path):
    nodes = spark.createDataFrame([("class:A", "class", "A", "a", None), ("class:AB", "class", "AB", None, None), ("view:v", "view", "v", None, None), ("view:alone", "view", "alone", None, None), ("route:GET /x", "route", "GET /x", None, None)], "key string, type string, name string, file string, kind string").withColumn("is_project", F.lit(True))
    edges = spark.createDataFrame([("calls", "class:A", "class:AB", "new", 1.0), ("routes_to", "route:GET /x", "class:A", None, None), ("renders", "class:A", "view:v", None, None)], "type string, from_key string, to_key string, resolution string, confidence double")
    log = Log(spark, str(tmp_path / uuid.uuid4().hex))
    return Desk(log, nodes, edges, clock=lambda: "now")


def rows(df):
    return sorted((tuple(x) for x in df.collect()), key=str)


def test_answers_and_misses(desk):
    assert desk.misses().isEmpty()
    assert rows(desk.ask("callers", key="class:AB").rows.select("from_key")) == [("class:A",)]
    assert desk.ask("view", name="alone").rows.isEmpty() and desk.ask("view", name="v").rows.first().other == "class:A"
    assert desk.ask("route", name="get x").rows.first().views == ["v"]
    assert desk.ask("path", start="route:GET /x", end="view:v").rows.count() == 2
    assert desk.ask("stats").rows.first().n == 1 and desk.ask("unresolved").rows.isEmpty()
    assert desk.misses().isEmpty()  # an answer of no rows is one
    assert not desk.ask("docs", key="class:").found and not desk.ask("route", name="none").found and not desk.ask("communities").found
    assert not desk.ask("path", start="view:v", end="class:A").found
    assert rows(desk.misses().select("tool", "args", "suggested", "asked_at")) == [
        ("communities", "{}", [], "now"), ("docs", '{"key": "class:"}', ["class:A", "class:AB"], "now"), ("path", '{"end": "class:A", "start": "view:v"}', [], "now"), ("route", '{"name": "none"}', [], "now")]


def test_envelopes(desk, spark):
    assert desk.graph() == {"version": 0, "build": None}
    record(desk.log, "full", lambda at: {"nodes": Delta(desk.nodes.select("key"))}, 0.0, lambda: 2.0)
    out = desk.envelope("find", {"name": "A", "fuzzy": True}, page=1)
    assert out["found"] and out["query"] == {"tool": "find", "name": "A", "fuzzy": True} and [r["key"] for r in out["result"]] == ["class:A"] and out["confidence"] == 1.0
    assert out["graph"]["build"]["new_nodes"] == 5 and out["graph"]["build"]["seconds"] == 2.0
    first = desk.envelope("stats", {}, page=2)
    rest = desk.envelope("stats", {}, page=10, offset=first["next"])
    assert len(first["result"]) == 2 and "next" not in rest and len(first["result"]) + len(rest["result"]) == 6
    lost = desk.envelope("node", {"key": "lass:A"})
    assert not lost["found"] and lost["suggestions"] == [{"key": "class:A", "score": 0.6}, {"key": "class:AB", "score": 0.6}] and json.loads(desk.misses().first().args) == {"key": "lass:A"}


def test_arguments(desk):
    with pytest.raises(KeyError):
        desk.ask("nothing")
    for wrong in ({}, {"key": 3}, {"key": "a", "deep": 1}, {"key": None}, {"key": "a", "depth": True}, {"key": "a", "min_confidence": "high"}):
        with pytest.raises(TypeError):
            desk.ask("callers", **wrong)
    callers = next(t for t in TOOLS if t.name == "callers")
    assert callers.checked({"key": "a", "depth": 99, "min_confidence": 1}) == {"key": "a", "depth": 10, "min_confidence": 1.0}
    assert callers.checked({"key": "a", "depth": -1})["depth"] == 1
    assert callers.schema()["required"] == ["key"] and callers.schema()["properties"]["depth"] == {"type": "integer", "minimum": 1, "maximum": 10, "default": 1}
    assert desk.misses().isEmpty()


def test_a_tool_of_ones_own(desk):
    files = Tool("files", "Files of a type", {"type": Argument(str)}, lambda d, type: Answer(True, d.nodes.where(F.col("type") == type).select("file").where("file is not null")))
    assert rows(desk.add(files).ask("files", type="class").rows) == [("a",)]
