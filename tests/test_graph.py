"""Walks, lookups, store and analysis on small graphs with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import analysis, communities, extractors, lookup, store, traverse
from strandline.plans import runtime, testbed

NODE = "key string, type string, name string, file string, is_project boolean, kind string"
EDGE = "type string, from_key string, to_key string, resolution string, confidence double"


def graph(spark, pairs, type_="calls", confidence=1.0):
    return spark.createDataFrame([(type_, a, b, None, confidence) for a, b in pairs], EDGE)


def rows(df):
    return sorted(tuple(x) for x in df.collect())


def test_callers_repeat_edges_and_cut_before_the_filter(spark):
    e = graph(spark, [(f"m{i:03}", "f") for i in range(120)], confidence=0.9).unionByName(graph(spark, [("z", "f")], confidence=None))
    assert traverse.callers(e, "f").count() == 100
    assert traverse.callers(e, "f", min_confidence=0.95).count() == 0
    loop = graph(spark, [("a", "b"), ("b", "a")])
    got = traverse.callers(loop, "a", depth=3).select("depth", "from_key", "to_key")
    assert rows(got) == [(1, "b", "a"), (2, "a", "b")]  # the seed is shown again, but not walked again


def test_null_confidence_counts_for_impact_only(spark):
    e = graph(spark, [("a", "f")], confidence=None)
    n = spark.createDataFrame([("a", "method", "a", None, None, None), ("f", "function", "f", None, None, None)], NODE)
    assert traverse.callers(e, "f", min_confidence=0.1).count() == 0
    assert rows(traverse.impact(n, e, "f", min_confidence=0.9).select("key", "bucket")) == [("a", "methods")]


def test_impact_starts_from_a_class_and_its_methods(spark):
    e = graph(spark, [("class:A", "method:A::x")], "declares").unionByName(graph(spark, [("m", "method:A::x"), ("n", "m"), ("method:A::x", "n")]))
    n = spark.createDataFrame([("method:A::x", "method", "x", None, None, None), ("m", "method", "m", None, None, None), ("n", "class", "n", None, None, "job")], NODE)
    got = traverse.impact(n, e, "class:A").select("key", "depth", "via", "bucket")
    assert rows(got) == [("m", 1, "calls", "methods"), ("method:A::x", 3, "calls", "methods"), ("n", 2, "calls", "jobs")]


def test_path(spark):
    e = graph(spark, [("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e")])
    assert rows(traverse.path(e, "a", "e").select("step", "from_key", "to_key")) == [(1, "a", "b"), (2, "b", "c"), (3, "c", "e")]
    assert traverse.path(e, "a", "a").count() == 0
    assert traverse.path(e, "e", "a") is None


def test_a_path_goes_over_all_edges_of_a_node(spark):
    sure = graph(spark, [("hub", f"f{i:03}") for i in range(150)], "instantiates")
    unsure = graph(spark, [("a", "hub"), ("hub", "m")], "declares", None)
    e = sure.unionByName(unsure).unionByName(graph(spark, [("m", "end")], "resolves", 0.6))
    want = [(1, "a", "hub", "declares", None), (2, "hub", "m", "declares", None), (3, "m", "end", "resolves", 0.6)]
    assert rows(traverse.path(e, "a", "end", 4)) == want  # the last of the hub's 151 edges
    assert rows(traverse.path(e, "a", "end", 3)) == want  # at the last level
    assert traverse.path(e, "a", "end", 2) is None


def test_a_level_is_looked_up_by_value_while_it_is_small(spark, tmp_path, monkeypatch, capsys):
    rng = random.Random(5)
    pairs = {(f"m{rng.randrange(300):03}", f"m{rng.randrange(300):03}") for _ in range(900)} | {("m000", None), (None, "m001")}
    graph(spark, sorted(pairs, key=repr)).repartitionByRange(6, "from_key").sortWithinPartitions("from_key").write.parquet(str(tmp_path / "e"))
    e = spark.read.schema(EDGE).parquet(str(tmp_path / "e"))
    n = spark.createDataFrame([(f"m{k:03}", "method", str(k), None, None, None) for k in range(300)], NODE)

    def answers():
        way = traverse.path(e, "m000", "m123", 6)
        return [rows(x.na.fill("-")) for x in (traverse.callees(e, "m000", 3), traverse.callers(e, "m005", 3), traverse.impact(n, e, "m009"), way)]

    want = answers()
    monkeypatch.setattr(traverse, "FEW", 0)  # every level joined
    assert answers() == want
    monkeypatch.setattr(traverse, "FEW", 12)  # some levels
    assert answers() == want
    keys = spark.createDataFrame([(f"m{k:03}",) for k in range(0, 24, 2)] + [(None,)], "at string")
    assert traverse.few(keys) is None
    monkeypatch.setattr(traverse, "FEW", 500)
    met = traverse.at_keys(e, "from_key", keys, traverse.few(keys))
    met.explain("formatted")
    plan = capsys.readouterr().out
    assert "Or(In(from_key" in plan.split("PushedFilters")[1].split("ReadSchema")[0] and "Join" not in plan
    assert rows(met.na.fill("-")) == rows(traverse.at_keys(e, "from_key", keys, None).na.fill("-"))
    assert traverse.at_keys(e, "from_key", keys, []).count() == 0


def test_short_name_is_found_among_many(spark):
    names = [f"App\\Models\\ServiceOrder{i}" for i in range(30)] + ["App\\Models\\ServiceOrder"]
    n = spark.createDataFrame([(f"class:{x}", "class", x, None, True, None) for x in names], NODE)
    found = lookup.find(n, "ServiceOrder")
    assert found.found and found.confidence == 1.0 and rows(found.rows.select("name")) == [("App\\Models\\ServiceOrder",)]
    missed = lookup.find(n, "serviceorder")
    assert not missed.found and missed.suggestions.count() == 5
    assert lookup.find(n, "serviceorder", fuzzy=True).confidence == 0.6
    assert lookup.find(n, "nothing").envelope("find", {"name": "nothing"})["found"] is False


def test_an_index_finds_what_a_scan_finds(spark, tmp_path):
    names = ["App\\Models\\Order", "App\\order", "Ördner", "ab", "x%y", "x_y", "xzy", "Order", "a_very_long_name"]
    n = spark.createDataFrame([(f"class:{i}{x}", "class", x, None, True, None) for i in range(3) for x in names] + [("section:z", "section", "Page One", None, None, None)], NODE)
    for df, name in zip(lookup.Index.tables(n), ("g", "n")):
        df.write.parquet(str(tmp_path / name))
    index = lookup.Index(spark.read.parquet(str(tmp_path / "g")), spark.read.parquet(str(tmp_path / "n")))
    for asked in ("order", "ORDER", "App\\order", "x%y", "x_y", "ab", "a", "", "Page One", "ördner", "Ördner", "long", "class:1Order", "very%name", "nothing"):
        for type_ in (None, "class"):
            want = [r.key for r in lookup.candidates(n, asked, type_).collect()]
            assert [r.key for r in lookup.candidates(n, asked, type_, index=index).collect()] == want, asked
    assert index.keys("ab") is None and "PushedFilters: [In(gram" in index.keys("orde")._jdf.queryExecution().executedPlan().toString()


def test_an_answer_comes_in_pages(spark):
    answer = lookup.Answer(True, spark.range(5).orderBy("id"))
    one = answer.envelope("list", {}, page=2, graph={"nodes": 5})
    assert [r["id"] for r in one["result"]] == [0, 1] and one["next"] == 2 and one["graph"] == {"nodes": 5}
    last = answer.envelope("list", {}, page=2, offset=4)
    assert [r["id"] for r in last["result"]] == [4] and "next" not in last


def test_extractors_share_one_read_and_fail_alone(spark):
    def words(path, content):
        yield from (("nodes", {"key": f"w:{w}", "type": "word", "name": w}) for w in content.split())

    registry = extractors.Registry({"sizes": "n int"}).add(extractors.Extractor("words", ("md",), words)).add(extractors.Extractor("sizes", ("md", "js"), lambda p, c: [("sizes", {"n": len(c)})]))
    registry.add(extractors.Extractor("strict", ("js",), lambda p, c: [("nodes", {}), ("other", {})]))
    with pytest.raises(ValueError):
        registry.add(extractors.Extractor("words", (), words))
    files = spark.createDataFrame([("a", "md", "x y"), ("b", "js", "bad"), ("c", "css", "z"), ("d", "md", None)], "path string, lang string, content string")
    out = registry.run(files)
    assert rows(out["nodes"].select("path", "name")) == [("a", "x"), ("a", "y")] and rows(out["sizes"]) == [("a", "sizes", 3), ("b", "sizes", 3), ("d", "sizes", 0)]
    assert [r.warning for r in out["warnings"].collect()] == ["strict: b: unknown outputs ['other']"] and out["unresolved"].count() == 0


def test_edges_with_nulls_stay_apart(spark):
    kind = EDGE + ", file string, line int"
    old = spark.createDataFrame([], kind)
    twice = [("calls", "a", "b", None, 0.5, None, None)] * 2 + [("calls", "a", "b", None, 0.5, "f", 10)] * 2
    assert store.insert_edges(old, spark.createDataFrame(twice, kind)).count() == 3


def test_warnings_and_meta(spark):
    old = spark.createDataFrame([("w", 1, 1)], "warning string, first_seen int, last_seen int")
    seen = spark.createDataFrame([("w",), ("v",)], "warning string")
    assert rows(store.upsert_warnings(old, seen, F.lit(2))) == [("v", 2, 2), ("w", 1, 2)]
    m = spark.range(1).select(store.merge_meta(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2"))).alias("m"))
    assert m.first().m == {"a": "2"}
    assert m.select(store.without_key(F.col("m"), "a").alias("m")).first().m is None


def test_snapshots_and_diff(spark, tmp_path):
    files = lambda *r: spark.createDataFrame(r, "path string, hash string")
    s = store.Snapshots(spark, str(tmp_path / "g"))
    assert s.version() == 0
    s.write({"files": files(("a", "1"), ("b", "1"))})
    assert s.write({"files": store.upsert(s.read("files"), files(("a", "2"),), "path")}) == 2
    assert rows(s.read("files")) == [("a", "2"), ("b", "1")]
    assert rows(store.changed_files(s.read("files"), files(("a", "2"), ("c", "1")))) == [("b", "deleted"), ("c", "new")]


def test_communities(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    weights = lambda *x: spark.createDataFrame([(a, b, 1) for a, b in x], "a long, b long, w long")
    got = dict(communities.communities(ids(*range(1, 7)), weights((1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4))).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    assert dict(communities.communities(ids(99), weights()).collect()) == {99: 99}


def sequential(n, pairs):
    """Communities of nodes 0 to n - 1 one node at a time, without a cap."""
    own, links = list(range(n)), {}
    for a, b in pairs:
        for x, y in ((a, b), (b, a)):
            links.setdefault(x, {})[y] = links.get(x, {}).get(y, 0) + 1
    m = len(pairs)
    while True:
        c, k = {x: x for x in links}, {x: sum(w for w in links[x].values()) for x in links}
        tot, moved = dict(k), True
        while moved:
            moved = False
            for x in sorted(links):
                near = {c[x]: 0}
                for y, w in links[x].items():
                    if y != x:
                        near[c[y]] = near.get(c[y], 0) + w
                tot[c[x]] -= k[x]
                best = min(near, key=lambda y: (-round(near[y] / m - tot[y] * k[x] / (2 * m * m), 9), y))
                tot[best] += k[x]
                moved, c[x] = moved or best != c[x], best
        own = [c.get(x, x) for x in own]
        if len(set(c.values())) == len(c):
            return own
        merged = {}
        for x, near in links.items():
            for y, w in near.items():
                row = merged.setdefault(c[x], {})
                row[c[y]] = row.get(c[y], 0) + w
        links = merged


def modularity(found, pairs):
    inside, tot = sum(found[a] == found[b] for a, b in pairs), {}
    for x in (x for p in pairs for x in p):
        tot[found[x]] = tot.get(found[x], 0) + 1
    return inside / len(pairs) - sum(t * t for t in tot.values()) / (4 * len(pairs) ** 2)


def gaining_merges(found, pairs):
    """Pairs of communities that would gain by becoming one: none where no level is left out."""
    between, tot, m = {}, {}, len(pairs)
    for a, b in pairs:
        a, b = found[a], found[b]
        for x in (a, b):
            tot[x] = tot.get(x, 0) + 1
        if a != b:
            between[min(a, b), max(a, b)] = between.get((min(a, b), max(a, b)), 0) + 1
    return [p for p, w in between.items() if w / m - tot[p[0]] * tot[p[1]] / (2 * m * m) > 2e-9]


@pytest.mark.parametrize("kind,small", [("chain", 1 << 18), ("groups", 1 << 18), ("groups", 0), ("chain", 300)])
def test_communities_come_to_rest(spark, monkeypatch, kind, small):
    """All levels in a task, all by turns of joins, and large levels by turns with small ones in a task."""
    monkeypatch.setattr(communities, "SMALL", small)
    n, rng = {"chain": 800, "groups": 150}[kind], random.Random(5)
    pairs = [(i, i + 1) for i in range(n - 1)]
    if kind == "groups":
        pairs = sorted({(min(p), max(p)) for i in range(n) for j in range(4) if (p := (i, i // 30 * 30 + rng.randrange(30) if j else rng.randrange(n))) and p[0] != p[1]})
    ids, weights = spark.range(n), spark.createDataFrame([(a, b, 1) for a, b in pairs], "a long, b long, w long")
    found = dict(communities.communities(ids, weights).collect())
    plain = sequential(n, pairs)
    assert gaining_merges(plain, pairs) == [] and gaining_merges(found, pairs) == []
    assert len(found) == n and modularity(found, pairs) > modularity(plain, pairs) - 0.02
    assert len(set(found.values())) < 1.5 * len(set(plain))


def test_large_levels_are_swept_in_blocks(spark, monkeypatch):
    """A level of more than SMALL links is no sequence of turns: blocks of bounded size, each in a task."""
    rng, n, sizes, turns = random.Random(8), 400, [], []
    pairs = sorted({(min(p), max(p)) for i in range(n) for j in range(6) if (p := (i, i // 40 * 40 + rng.randrange(40) if j else rng.randrange(n))) and p[0] != p[1]})
    pairs += [(rng.randrange(n), i) for i in range(n, 2 * n)]  # nodes with one neighbour
    monkeypatch.setattr(communities, "SMALL", 700)
    blocks = communities._blocks
    monkeypatch.setattr(communities, "_blocks", lambda *a: (found := blocks(*a), sizes.append([r["count"] for r in found.groupBy("block").count().collect()]))[0])
    ids, weights = spark.range(2 * n), spark.createDataFrame([(a, b, 1) for a, b in pairs], "a long, b long, w long")
    found, plain = dict(communities.communities(ids, weights, seen=turns.append).collect()), sequential(2 * n, pairs)
    assert turns == [] and sizes and max(map(len, sizes)) > 1 and max(map(max, sizes)) <= 1400
    assert len(found) == 2 * n and gaining_merges(found, pairs) == [] and modularity(found, pairs) > modularity(plain, pairs) - 0.03  # blocks hide two links of three at first
    assert all(found[c] == c <= k for k, c in found.items())


def test_nodes_with_one_neighbour_join_it_at_once_where_all_gain(spark):
    pairs = [(0, 1), (0, 2), (1, 2), *((0, k) for k in range(3, 40)), (40, 41)]
    n, total = {x: [] for x in range(42)}, 2.0 * len(pairs)
    for a, b in pairs:
        n[a].append(b), n[b].append(a)

    def moves(resolution):
        gain = lambda x, t: total - resolution * len(n[t]) * len(n[x])
        best = [(x, len(y), len(y), gain(x, t), t) for x, y in n.items() for t in [max(y, key=lambda t: (gain(x, t), t))]]
        return dict(communities._lone(spark.createDataFrame(best, "id long, n long, k long, gain double, to long"), 1e-9 * total * total, resolution).collect())

    found = moves(1.0)
    assert set(found) == {*range(3, 40), 41} and modularity({x: found.get(x, x) for x in n}, pairs) > modularity({x: x for x in n}, pairs)
    assert set(moves(2.0)) == {41}  # 37 at once would cost more than each alone gains


def test_modularity_rises_with_every_turn(spark, monkeypatch):
    monkeypatch.setattr(communities, "SMALL", 0)
    data = "/root/testdata/sf0.001"
    n, e = testbed.nodes(spark, data), testbed.edges(spark, data)
    weights = analysis.projection(n, e).cache()
    pairs = [(r.a, r.b) for r in weights.collect() for _ in range(r.w)]
    names = sorted({x for p in pairs for x in p})
    place, seen = {k: i for i, k in enumerate(names)}, []
    ids = spark.createDataFrame([(k,) for k in names], "id string")
    found = dict(communities.communities(ids, weights, seen=lambda state: seen.append(state)).collect())
    plain = sequential(len(names), [(place[a], place[b]) for a, b in pairs])
    assert gaining_merges(found, pairs) == [] and modularity(found, pairs) > modularity({k: plain[i] for k, i in place.items()}, pairs) - 0.02
    assert abs(communities.modularity(spark.createDataFrame(list(found.items()), "id string, community string"), weights) - modularity(found, pairs)) < 1e-9
    assert 5 < len(seen) < 100


def test_every_move_that_is_made_gains(spark):
    """Turn by turn on graphs with hubs, where nodes of equal wishes would overfill a community together."""
    rng = random.Random(3)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in ((rng.randrange(60), rng.choice((0, 1, 2, rng.randrange(60)))) for _ in range(400)) if a != b})
    ids, weights = spark.range(60), spark.createDataFrame([(a, b, 1) for a, b in pairs], "a long, b long, w long")
    links = analysis.both_ways(weights).cache()
    strength = {r.id: r.k for r in links.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")).collect()}
    state, last = {i: i for i in range(60)}, -1.0
    for turn in range(60):
        df = spark.createDataFrame([(i, c, strength.get(i, 0), hash((turn, i))) for i, c in state.items()], "id long, c long, k long, luck long")
        wishes = communities._wishes(df, links, 2.0 * len(pairs), 1.0).cache()
        moves = dict(communities._sound(wishes, 1.0).collect())
        if not wishes.count():
            break
        assert moves
        state |= moves
        now = modularity(state, pairs)
        assert now > last + 1e-9
        last = now
    else:
        raise AssertionError("no rest")


def test_hubs_follow_lower_hubs(spark):
    weights = spark.createDataFrame([("h1", "x", 1), ("h1", "y", 1), ("h1", "h2", 9), ("h2", "y", 1), ("h2", "h3", 5), ("h3", "x", 4), ("h4", "h5", 3)], "a string, b string, w long")
    hubs = spark.createDataFrame([("h1",), ("h2",), ("h3",), ("h4",), ("h5",), ("h6",)], "key string")
    given = spark.createDataFrame([("x", "X"), ("y", "Y")], "key string, community string")
    assert dict(communities.attach_hubs(hubs, weights, given).collect()) == {"h1": "X", "h2": "X", "h3": "X", "h4": "h4", "h5": "h4", "h6": "h6"}


def test_the_hub_joins_its_strongest_neighbour(spark):
    node = lambda k: (f"class:{k}", "class", k, None, True, None)
    n = spark.createDataFrame([node(k) for k in ("A1", "A2", "A3", "B1", "B2", "B3", "Hub")], "key string, type string, name string, file string, is_project boolean, kind string")
    pairs = [("A1", "A2"), ("A2", "A3"), ("A1", "A3"), ("B1", "B2"), ("B2", "B3"), ("B1", "B3"), *[("Hub", k) for k in ("A1", "A1", "A2", "A3", "B1", "B2", "B3")]]
    e = spark.createDataFrame([("calls", f"class:{a}", f"class:{b}", "new", 1.0) for a, b in pairs], "type string, from_key string, to_key string, resolution string, confidence double")
    found = dict(communities.detect(n, e).collect())
    assert found == {f"class:{k}": f"class:{'B' if k[0] == 'B' else 'A'}1" for k in ("A1", "A2", "A3", "B1", "B2", "B3", "Hub")}


def test_a_cleaned_session_goes_on(spark):
    data = "/root/testdata/sf0.001"
    n = testbed.nodes(spark, data).count()
    runtime.clean(spark)
    assert testbed.nodes(spark, data).count() == n


def test_hub_threshold(spark):
    d = spark.createDataFrame([(str(i), "class", i) for i in range(100)], "key string, type string, degree long")
    assert analysis.hub_threshold(d, 0.99) == 99
    assert analysis.hub_threshold(d, 1.0) is None
    assert rows(analysis.hub_set(d, 0.98).select("degree")) == [(98,), (99,)]


def test_hashes_that_are_null(spark):
    files = lambda *x: spark.createDataFrame(list(x), "path string, hash string")
    old, new = files(("a", None), ("b", None), ("c", "1"), ("d", None)), files(("a", None), ("b", "1"), ("c", None), ("e", None))
    assert rows(store.changed_files(old, new)) == [("b", "changed"), ("c", "changed"), ("d", "deleted"), ("e", "new")]


def test_edges_inserted_into_a_table_that_has_some(spark):
    kind = "type string, from_key string, to_key string, file string, line int, resolution string, confidence double"
    old = spark.createDataFrame([("calls", "a", "b", "f", 1, "exact", 1.0), ("calls", "a", "b", None, 1, "exact", 1.0), ("calls", "a", "c", "f", 2, "exact", 0.9)], kind)
    new = spark.createDataFrame([("calls", "a", "b", "f", 1, "guess", 0.4), ("calls", "a", "b", None, 1, "guess", 0.4)], kind)
    got = sorted((r.to_key, str(r.file), r.line, r.confidence) for r in store.insert_edges(old, new).collect())
    assert got == [("b", "None", 1, 0.4), ("b", "None", 1, 1.0), ("b", "f", 1, 0.4), ("c", "f", 2, 0.9)]


def test_a_writer_that_breaks_off_leaves_the_old_version(spark, tmp_path, monkeypatch):
    s, table = store.Snapshots(spark, str(tmp_path / "g")), lambda x: {"t": spark.createDataFrame([(x,)], "x string")}
    assert s.version() == 0 and s.write(table("one")) == 1
    real = store.Snapshots._create

    def broken(self, name):
        if name.startswith("CURRENT"):
            raise OSError("lost")
        real(self, name)

    monkeypatch.setattr(store.Snapshots, "_create", broken)
    with pytest.raises(OSError):
        s.write(table("two"))
    assert s.version() == 1 and rows(s.read("t")) == [("one",)]
    monkeypatch.setattr(store.Snapshots, "_create", real)
    assert s.write(table("three")) == 3 and rows(s.read("t")) == [("three",)]
    with pytest.raises(Exception):  # a number that another writer has claimed
        s._create("CLAIM-3")
    monkeypatch.setattr(store, "SCHEMA_VERSION", store.SCHEMA_VERSION + 1)
    assert s.version() == 0 and s.write(table("four")) == 4 and rows(s.read("t")) == [("four",)]


def test_keys_that_are_missing(spark):
    from strandline.operators import tools

    n = spark.createDataFrame([(f"class:A\\{x}", "class", f"A\\{x}", None, True, None) for x in ("Foo", "FooBar", "Qux")], "key string, type string, name string, file string, is_project boolean, kind string")
    e = spark.createDataFrame([("calls", "class:A\\Qux", "class:A\\Foo", "new", 1.0)], "type string, from_key string, to_key string, resolution string, confidence double")
    keys = lambda a: [r.key for r in a.suggestions.collect()]
    assert keys(tools.callers(n, e, "Foo")) == ["class:A\\Foo", "class:A\\FooBar"] and tools.callers(n, e, "class:A\\Foo").rows.count() == 1
    assert keys(tools.callees(n, e, "nothing")) == [] and tools.callees(n, e, "class:A\\Qux").rows.count() == 1
    assert [r.key for r in tools.impact(n, e, "Foo").rows.collect()] == ["class:A\\Qux"] and not tools.impact(n, e, "nothing").found
    assert keys(tools.path(n, e, "Qux", "Foo")) == ["class:A\\Qux", "class:A\\Foo", "class:A\\FooBar"] and tools.path(n, e, "class:A\\Qux", "class:A\\Foo").rows.count() == 1
    row = tools.miss(tools.callers(n, e, "Foo"), "callers", "Foo", F.lit(7)).first()
    assert tuple(row) == ("callers", "Foo", ["class:A\\Foo", "class:A\\FooBar"], 7) and tools.miss(tools.callers(n, e, "class:A\\Foo"), "callers", "x", F.lit(7)) is None
