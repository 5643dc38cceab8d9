"""The log of deltas and rebuilds to a fixed point."""

import pytest
from pyspark.sql import functions as F

from strandline.operators import builds, membership
from strandline.operators.invalidate import changed_symbols, dependents, rebuild, replaced, stale
from strandline.operators.versions import Conflict, Delta, Log

ROW = "k string, place int, v int"


@pytest.fixture
def log(spark, tmp_path):
    return Log(spark, str(tmp_path / "log"))


def table(spark, *rows, schema=ROW):
    return spark.createDataFrame(list(rows), schema)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_two_writers_and_a_reader_between(spark, log):
    put = lambda *r: lambda at: {"t": log.put("t", table(spark, *r), ["k", "place"], at)}
    first = log.change(put(("a", 1, 1), ("b", 1, 1), ("c", None, 1), ("c", None, 1)))
    assert (first.version, first.rows) == (1, {"t": (4, 0)})
    reader = log.rows("t", 1)
    slow, quick = put(("a", 1, 2), ("d", 1, 1))(1), put(("a", 1, 3), ("b", 1, 1), ("c", None, 1))(1)
    assert log.commit(quick, 1).rows == {"t": (2, 1)}  # b is stored as it is, c has a null place and never equals
    with pytest.raises(Conflict):
        log.commit(slow, 1)
    assert log.version() == 2 and rows(log.read("t")) == [("a", 1, 3), ("b", 1, 1), ("c", None, 1), ("c", None, 1), ("c", None, 1)]
    assert log.change(put(("a", 1, 2), ("d", 1, 1))).rows == {"t": (2, 1)}
    assert reader.count() == 4 and rows(log.read("t", 1))[0] == ("a", 1, 1)
    assert rows(log.changes("t", 2)) == [("a", 1, 2, "added"), ("a", 1, 3, "removed"), ("d", 1, 1, "added")]
    assert rows(log.changes("t", 0, 1))[0] == ("a", 1, 1, "added")


def test_compaction_keeps_rows_and_old_readers(spark, log):
    for k in range(4):
        log.change(lambda at, k=k: {"t": log.put("t", table(spark, ("a", 1, k), (str(k), 1, k)), ["k", "place"], at)})
    old, want = log.rows("t", 2), rows(log.read("t"))
    assert log.compact().version == 5 and rows(log.read("t")) == want and len(log._since_base(5)) == 1
    assert rows(log.read("t", 2)) == [("0", 1, 0), ("1", 1, 1), ("a", 1, 1)] and old.count() == 3
    assert log.change(lambda at: {"t": log.without("t", table(spark, ("a", 1, 0)), ["k"], at)}).rows == {"t": (0, 1)}
    assert rows(log.read("t")) == want[:-1]
    assert rows(log.changes("t", 3)) == [("3", 1, 3, "added"), ("a", 1, 2, "removed")]


def test_a_writer_that_breaks_off_and_another_schema(spark, log, monkeypatch):
    log.commit({"t": Delta(table(spark, ("a", 1, 1)))})
    monkeypatch.setattr(Log, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        log.commit({"t": Delta(table(spark, ("b", 1, 1)))})
    monkeypatch.undo()
    assert log.version() == 1 and rows(log.read("t")) == [("a", 1, 1)]
    newer = Log(spark, log.root, schema=2)
    assert newer.version() == 0 and newer.tables() == []
    assert newer.commit({"t": Delta(table(spark, ("c", 1, 1)))}).version == 2
    assert rows(newer.read("t")) == [("c", 1, 1)] and newer.version() == 2 and log.version() == 0
    with pytest.raises(FileNotFoundError):
        newer.read("u")


def test_history_counts_rows(spark, log):
    log.commit({"t": Delta(table(spark, ("a", 1, 1))), "u": Delta(table(spark))})
    log.change(lambda at: {"t": log.put("t", table(spark, ("a", 1, 2)), ["k"], at)})
    assert rows(log.history()) == [(1, "t", 1, 0), (1, "u", 0, 0), (2, "t", 1, 1)]
    assert rows(log.history(1)) == [(2, "t", 1, 1)]


# rebuilds: a file's content is "name uses... = shape", or without a shape the one of what it uses first


def symbols(files, known):
    parts = files.select("path", F.split("content", " ").alias("p"), F.regexp_extract("content", "= (.*)", 1).alias("own"))
    parts = parts.select("path", F.col("p")[0].alias("symbol"), F.filter(F.slice("p", 2, 9), lambda x: x.rlike("^[a-z]")).alias("uses"), "own")
    looked = parts.select("path", F.explode("uses").alias("symbol")).join(known, "symbol", "left").select("path", "symbol", F.col("shape").isNotNull().alias("hit"))
    taken = parts.select("path", "symbol", "own", F.try_element_at("uses", F.lit(1)).alias("use")).join(known.select(F.col("symbol").alias("use"), "shape"), "use", "left")
    return taken.select("path", "symbol", F.when(F.col("own") != "", F.col("own")).otherwise(F.coalesce("shape", F.lit("?"))).alias("shape")), looked


def outputs(files, known):
    return {"nodes": symbols(files, known)[0].select("path", F.col("symbol").alias("key"))}


def build(spark, log, **files):
    seen = spark.createDataFrame([(k, str(hash(v)), v) for k, v in files.items()], "path string, hash string, content string")
    done = rebuild(log, seen, symbols, outputs)
    return {r.path: r.status for r in done.touched.collect()}, done


def shapes(log):
    return {r.symbol: r.shape for r in log.read("declared").collect()}


def test_a_shape_runs_down_a_chain_and_stops(spark, log):
    files = {"A": "a = Int", "B": "b a", "C": "c b", "D": "d c = Own", "E": "e d", "F": "f"}
    touched, done = build(spark, log, **files)
    assert set(touched.values()) == {"new"} and shapes(log) == {"a": "Int", "b": "Int", "c": "Int", "d": "Own", "e": "Own", "f": "?"}
    files["A"] = "a = Str"
    touched, done = build(spark, log, **files)
    assert touched == {"A": "changed", "B": "affected", "C": "affected", "D": "affected"}  # D looks c up but keeps its shape, so E rests
    assert shapes(log) == {"a": "Str", "b": "Str", "c": "Str", "d": "Own", "e": "Own", "f": "?"} and done.rounds == 4
    touched, done = build(spark, log, **files)
    assert touched == {} and done.commit is None and log.version() == 2


def test_misses_come_and_go(spark, log):
    files = {"B": "b a", "C": "c = X"}
    build(spark, log, **files)
    assert shapes(log) == {"b": "?", "c": "X"} and rows(log.read("consulted")) == [("B", "a", False)]
    touched, _ = build(spark, log, **files, A="a = New")
    assert touched == {"A": "new", "B": "affected"} and rows(log.read("consulted")) == [("B", "a", True)] and shapes(log)["b"] == "New"
    touched, done = build(spark, log, **files)
    assert touched == {"A": "deleted", "B": "affected"} and rows(log.read("consulted")) == [("B", "a", False)] and shapes(log) == {"b": "?", "c": "X"}
    assert rows(log.read("nodes")) == [("B", "b"), ("C", "c")] and rows(log.read("files").select("path")) == [("B",), ("C",)]
    assert done.commit.rows["files"] == (0, 1)


def test_files_that_use_each_other_come_to_rest(spark, log):
    build(spark, log, A="a b", B="b a", C="c a")
    touched, _ = build(spark, log, A="a b = Fixed", B="b a", C="c a")
    assert touched == {"A": "changed", "B": "affected", "C": "affected"} and set(shapes(log).values()) == {"Fixed"}


def test_a_shape_that_is_taken_back_touches_nothing(spark, log):
    build(spark, log, U="u = Int", W="w u", X="x y", V="v x")
    assert shapes(log) == {"u": "Int", "w": "Int", "x": "?", "v": "?"}
    # Y reads what w was before U went, X takes it over for a round, and V looks x up
    touched, _ = build(spark, log, W="w u", Y="y w", X="x y", V="v x")
    assert touched == {"U": "deleted", "Y": "new", "W": "affected", "X": "affected"}
    assert shapes(log) == {"w": "?", "y": "?", "x": "?", "v": "?"} and rows(log.read("consulted")) == [("V", "x", True), ("W", "u", False), ("X", "y", True), ("Y", "w", True)]


def test_joins_of_a_rebuild_send_no_table_through_the_driver(spark):
    known, looked = spark.createDataFrame([("s", "x")], "symbol string, shape string"), spark.createDataFrame([("p", "s")], "path string, symbol string")
    for found in (changed_symbols(known, known), dependents(looked, known), replaced(looked, looked)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_stale_nodes(spark):
    old, new = table(spark, ("A", "x"), ("A", "y"), ("B", "z"), schema="path string, key string"), table(spark, ("A", "x"), schema="path string, key string")
    assert rows(stale(old, new, table(spark, ("A",), schema="path string"))) == [("A", "y")]


# builds, misses, exports, communities


def test_builds_count_new_nodes_while_they_are_written(spark, log):
    node = lambda *r: table(spark, *r, schema="key string, file string")
    one = builds.record(log, "full", lambda at: {"nodes": log.put("nodes", node(("a", "f"), ("b", "f")), ["key"], at)}, 10.0, lambda: 12.5)
    two = builds.record(log, "incremental", lambda at: {"nodes": log.put("nodes", node(("b", "g"), ("c", "g"), ("c", "g")), ["key"], at)}, 20.0, lambda: 21.0)
    assert (one.version, two.version) == (1, 3)
    assert rows(log.read("builds").select("id", "kind", "seconds", "new_nodes", "changed_nodes")) == [(1, "full", 2.5, 2, 0), (3, "incremental", 1.0, 1, 1)]
    assert builds.last(log).first().id == 3 and builds.last(Log(spark, log.root + "x")) is None


def test_values_are_set_and_read(spark, log):
    assert builds.value(log, "a") is None
    builds.set_values(log, {"a": "1", "b": None})
    builds.set_values(log, {"a": "2"})
    assert builds.value(log, "a") == "2" and builds.value(log, "b") is None and log.read("meta").count() == 2


def test_an_export_that_breaks_off_gives_each_row_once(spark, log, tmp_path, monkeypatch):
    folder, row = str(tmp_path / "out"), lambda *k: {"misses": Delta(table(spark, *[(x,) for x in k], schema="key string"))}
    read = lambda: sorted((r.batch, r.key) for r in spark.read.json(folder).collect())
    assert builds.export(log, "misses", folder) == []
    log.commit(row("a", "b", "b"))
    assert builds.export(log, "misses", folder) == [1] and builds.export(log, "misses", folder) == []
    log.commit(row("c"))
    monkeypatch.setattr(builds, "_move", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        builds.export(log, "misses", folder)
    monkeypatch.undo()
    log.commit(row("d"))
    log.compact()
    assert builds.export(log, "misses", folder) == [2, 3]
    assert read() == [(1, "a"), (1, "b"), (1, "b"), (2, "c"), (3, "d")] and builds.waiting(log, "misses").count() == 0


def test_communities_are_stored_and_never_computed_by_a_question(spark, log):
    n = spark.createDataFrame([(f"class:N\\{k}", "class", f"N\\{k}", None, True, None) for k in ("A", "B", "C", "D")], "key string, type string, name string, file string, is_project boolean, kind string")
    e = spark.createDataFrame([("calls", f"class:N\\{a}", f"class:N\\{b}", "new", 1.0) for a, b in (("A", "B"), ("C", "D"), ("B", "C"), ("A", "B"), ("C", "D"))], "type string, from_key string, to_key string, resolution string, confidence double")
    assert not membership.summary(log).found and [r.bridges for r in membership.hubs(log, n, e).collect()] == [None] * 4
    found = spark.createDataFrame([("class:N\\A", "x"), ("class:N\\B", "x"), ("class:N\\C", "y"), ("class:N\\D", "y")], "key string, community string")
    membership.store(log, found, n, e, "2024-01-01T00:00:00+00:00", 1.0)
    answer = membership.summary(log)
    assert [tuple(r) for r in answer.rows.select("community", "size").collect()] == [("x", 2), ("y", 2)] and answer.rows.first().computed_at == "2024-01-01T00:00:00+00:00"
    assert {r.key[-1]: r.bridges for r in membership.hubs(log, n, e).collect()} == {"A": 0, "B": 1, "C": 1, "D": 0}
    membership.store(log, found.where("community = 'x'"), n, e, "2024-01-02T00:00:00+00:00", 1.0)
    assert rows(membership.membership(log)) == [("class:N\\A", "x"), ("class:N\\B", "x")] and membership.summary(log).rows.count() == 1
