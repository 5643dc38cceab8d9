"""Every query of the library against its SQL, over the smallest tables."""

import math
import random
from pathlib import Path

import pytest

from strandline.operators import traverse
from strandline.plans import build_catalog, catalog, code_catalog, model_catalog, registry, runtime, testbed  # noqa: F401

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return [plain(y) for y in x] if isinstance(x, list | tuple) else x


def rows(records, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr([plain(r[k]) for k in order]) for r in records)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, str(DATA))
    want = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(found.columns) == sorted(names)
    assert rows([tuple(x) for x in found.collect()], found.columns) == rows(want.fetchall(), names)


def test_a_path_that_is_not_there_has_no_steps(spark, monkeypatch):
    monkeypatch.setattr(traverse, "path", lambda *a: None)
    found = catalog.path_shortest(spark, str(DATA))
    assert found.collect() == [] and found.columns == ["step", "from_key", "to_key", "edge_type", "confidence"]


def test_a_path_past_hubs_is_that_of_its_sql(spark, duck, monkeypatch):
    rng, sure = random.Random(3), [None, 0.6, 0.7, 0.8, 1.0]
    made = lambda a, b: (rng.choice(["calls", "declares", "resolves"]), a, b, None, rng.choice(sure))
    graph = [made("start", f"hub{k}") for k in range(3)] + [("calls", f"hub{k}", f"leaf{i:03}", None, 1.0) for k in range(3) for i in range(120)]
    graph += [made(f"hub{rng.randrange(3)}", f"m{rng.randrange(40):02}") for _ in range(200)] + [made(f"m{rng.randrange(40):02}", f"n{rng.randrange(20):02}") for _ in range(200)]
    graph += [made(f"n{rng.randrange(20):02}", "end") for _ in range(8)] + [made("end", "beyond")]
    e = spark.createDataFrame(graph, "type string, from_key string, to_key string, resolution string, confidence double").repartition(5)
    duck.execute("CREATE TEMP TABLE made (type VARCHAR, from_key VARCHAR, to_key VARCHAR, resolution VARCHAR, confidence DOUBLE)")
    duck.executemany("INSERT INTO made VALUES (?, ?, ?, ?, ?)", graph)
    for few in (500, 0):
        monkeypatch.setattr(traverse, "FEW", few)
        for end, steps in (("hub2", 1), ("m07", 2), ("n11", 3), ("end", 4), ("beyond", 0)):
            want = duck.execute(f"WITH RECURSIVE edges AS (FROM made){catalog._path_sql('start', end, 4)}").fetchall()
            found = traverse.path(e, "start", end, 4)
            assert sorted(want) == sorted(map(tuple, [] if found is None else found.collect())) and len(want) == steps


def test_a_query_pays_for_no_order_that_it_does_not_read(spark, monkeypatch):
    monkeypatch.setattr(testbed, "_STORED", {})
    for name in ("hub_percentile_set", "hubs_attached", "hubs_with_bridges"):
        registry.queries()[name](spark, str(DATA)).collect()
    folder = testbed.stored(spark, str(DATA))
    assert [runtime.exists(spark, f"{folder}/{x}") for x in ("nodes", "edges", "from_key", "to_key")] == [True, True, False, False]


def test_one_search_builds_no_index(spark, monkeypatch):
    monkeypatch.setattr(testbed, "_STORED", {})
    for name in ("find_exact", "find_short_name", "find_fuzzy_top25", "misses_kept"):
        registry.queries()[name](spark, str(DATA)).collect()
    folder = testbed.stored(spark, str(DATA))
    assert [runtime.exists(spark, f"{folder}/{x}") for x in ("nodes", "grams", "names", "to_key")] == [True, False, False, False]
