"""Text sources on small inline files."""

import random
import time

from pyspark.sql import functions as F

from strandline.functions.text import normalise_path, slugify, view_name
from strandline.operators.versions import Log
from strandline.sources import markdown, scripts, templates, tree
from strandline.streaming.watch import follow


def files(spark, **named):
    return spark.createDataFrame(list(named.items()), "path string, content string")


def rows(df):
    return sorted(tuple(x) for x in df.collect())


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(slugify(F.lit("  Hello, World: the_API \t"))) == "hello-world-the_api"
    assert one(normalise_path(F.lit("a/./b/../../../c//d"))) == "c/d"
    assert one(view_name(F.lit("resources/views/admin/home.blade.php"))) == "admin.home"


def test_sections_anchors_and_links(spark):
    text = "intro\n# One\nsee [b](b.md#x) and [web](https://x.y/z.md)\n## One\n`App\\Thing` and Foo\\Bar, a.b /home\n# One #\n[me](#one)\n"
    f = spark.createDataFrame([("docs/a.md", text)], "path string, content string")
    s = markdown.sections(f)
    assert rows(s.select("line", "level", "title", "anchor")) == [(2, 1, "One", "one"), (4, 2, "One", "one-1"), (6, 1, "One", "one-2")]
    assert rows(markdown.links(s)) == [("docs/a.md", "one", "docs/b.md", "x"), ("docs/a.md", "one-2", "docs/a.md", "one")]
    m = markdown.mentions(s).where("anchor = 'one-1'")
    assert rows(m.select("text", "backticked")) == [("/home", False), ("App\\Thing", True), ("Foo\\Bar", False), ("a.b", False)]
    kind = "key string, type string, name string"
    n = spark.createDataFrame([("class:X\\Foo\\Bar", "class", "Foo\\Bar"), ("class:App\\Thing", "class", "App\\Thing"), ("route:GET /home", "route", "GET /home")], kind)
    found = {x.text: x["keys"] for x in markdown.resolve_mentions(m, n).collect()}
    assert found == {"Foo\\Bar": ["class:X\\Foo\\Bar"], "App\\Thing": ["class:App\\Thing"], "/home": ["route:GET /home"]}


def test_requests_and_routes(spark):
    js = "axios.get('/a');\naxios.post(\"/a\", x)\nfetch('/b')\nfetch('/c', {method: 'PUT'})\n$.ajax({url: '/d', type: 'DELETE'})\n$.get('/e')\naxios({method: 'patch', url: '/f'})\nfetch(`/g/${id}`)\nfetch('http://x/y')\n"
    got = scripts.requests(spark.createDataFrame([("r.js", js)], "path string, content string"))
    want = [(1, "GET", "/a"), (2, "POST", "/a"), (3, "GET", "/b"), (4, "PUT", "/c"), (5, "DELETE", "/d"), (6, "GET", "/e"), (7, "PATCH", "/f"), (9, "GET", "http://x/y")]
    assert rows(got.select("line", "verb", "url")) == want
    routes = spark.createDataFrame([("GET", "/a", "route:GET /a"), ("PUT", "/b", "route:PUT /b"), ("PUT", "/d", "route:PUT /d"), ("POST", "/d", "route:POST /d")], "verb string, uri string, key string")
    m = {(x.verb, x.url): (x.key, len(x.candidates)) for x in scripts.match_requests(got, routes).collect()}
    assert m == {("GET", "/a"): ("route:GET /a", 1), ("POST", "/a"): ("route:GET /a", 1), ("GET", "/b"): ("route:PUT /b", 1), ("DELETE", "/d"): (None, 2)}


def test_templates(spark):
    blade = "@extends('layouts.app') @include('p.a') @each('p.a', $x) @includeWhen($c, 'p.w') @includeFirst(['p.x', \"p.y\"]) <x-alert/> <x:card.body> @component('modal') <x-alert>"
    f = spark.createDataFrame([("resources/views/home.blade.php", blade)], "path string, content string")
    got = rows(templates.includes(f))
    assert got == [("home", "layouts.app", "extends"), ("home", "p.a", "each"), ("home", "p.w", "includeWhen"), ("home", "p.x", "includeFirst"), ("home", "p.y", "includeFirst")]
    assert rows(templates.components(f)) == [("home", "alert"), ("home", "card.body"), ("home", "modal")]


def test_templates_later_place_wins_and_arguments_nest(spark):
    blade = "@extends('a') @extends('b') @includeUnless($x, 'v') @includeWhen(f($x, ['k' => 1]), 'v') @includeWhen($x, 'u') @includeUnless($x, \"u\") @include($no) @includeFirst(['m', 'n'], []) @includeFirst(['o']) a@b.c(x) @include ( 'p', ['q' => 'r'] )"
    f = spark.createDataFrame([("resources/views/home.blade.php", blade), ("e.blade.php", None), ("f.blade.php", "")], "path string, content string")
    assert rows(templates.includes(f)) == [("home", "a", "extends"), ("home", "m", "includeFirst"), ("home", "n", "includeFirst"), ("home", "p", "include"), ("home", "u", "includeUnless"), ("home", "v", "includeWhen")]
    assert rows(templates.components(f)) == []


def test_includes_join_no_tables_of_directives(spark):
    f = spark.range(1000).selectExpr("concat('resources/views/v', id, '.blade.php') AS path", "'@extends(\\'a\\') @include(\\'b\\') @extends(\\'c\\')' AS content")
    found = templates.includes(f)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # a side taken for small would go through the driver
    assert rows(found.groupBy("target", "directive").count()) == [("a", "extends", 1000), ("b", "include", 1000)]


def test_requests_with_nested_options():
    js = "$.ajax({data: {a: 1}, url: '/x', type: 'POST'})\nfetch('/z', {headers: {A: 'b)'}, method: 'POST'})\naxios.request({method: \"put\", url: \"/r\"})\naxios.create({url: '/no'}); my.fetch('/no'); fetch(url); $.ajax({url: "
    assert scripts.calls(js) == [(1, "POST", "/x"), (2, "POST", "/z"), (3, "PUT", "/r")]
    assert scripts.calls("") == [] and scripts.calls("fetch('/a\n')") == []


def test_mentions_are_split_at_their_separators(spark):
    body = "x A\\B foo\\Bar\\Baz 9Z a.b.c x.Y.z a..b (/u/{id}). http://h/p a/b `Code\\Span` Ab_c /"
    s = spark.createDataFrame([("p", "a", body), ("p", "n", None)], "path string, anchor string, body string")
    got = rows(markdown.mentions(s).select("text", "backticked"))
    assert got == [("/u/{id}", False), ("A\\B", False), ("Bar\\Baz", False), ("Code\\Span", True), ("Y", False), ("a.b.c", False)]


def test_many_equal_titles(spark):
    assert markdown._unique(["a", "a-1", "a", "a", "b", "a"]) == ["a", "a-1", "a-2", "a-3", "b", "a-4"]


def test_tree(spark, tmp_path):
    for name in ("a.php", "b.blade.php", "vendor/c.php", "d.txt", "docs/e.md", "docs/skip/f.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    got = tree.read_tree(spark, str(tmp_path), globs=("docs/skip*",))
    assert rows(got.select("path", "lang")) == [("a.php", "php"), ("b.blade.php", "blade"), ("docs/e.md", "md")]


def test_stream_of_files(spark, tmp_path):
    source, s, seen = tmp_path / "in", Log(spark, str(tmp_path / "g")), []
    for n, batch in enumerate(([("a", "1", 1), ("b", "1", 1)], [("a", "1", 2), ("b", "2", 2), ("b", "3", 3)])):
        spark.createDataFrame(batch, "path string, hash string, seen int").coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema("path string, hash string, seen int").json(str(source))
        follow(stream, s, str(tmp_path / "c"), lambda c, k: seen.append(rows(c))).awaitTermination()
    assert seen == [[("a",), ("b",)], [("b",)]] and rows(s.read("files")) == [("a", "1"), ("b", "3")]
    assert rows(s.history()) == [(1, "files", 2, 0), (2, "files", 1, 1)] and spark.read.parquet(s._record(2)["tables"]["files"]["added"][0]).count() == 1


def test_mentions_resolve_without_a_nested_loop(spark):
    said = spark.createDataFrame([("p", "a", t, False) for t in ("A\\B", "B", "C", "Z")], "path string, anchor string, text string, backticked boolean")
    known = spark.createDataFrame([("class:A\\B", "class", "A\\B"), ("class:D\\B", "class", "D\\B"), ("class:C", "class", "C")], "key string, type string, name string")
    found = markdown.resolve_mentions(said, known)
    assert sorted((r["text"], r["keys"]) for r in found.collect()) == [("A\\B", ["class:A\\B"]), ("B", ["class:A\\B", "class:D\\B"]), ("C", ["class:C"])]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def closing_one_by_one(content, at):
    """The bracket that closes what is open at a place, from that place on."""
    depth = 0
    while at < len(content):
        skip = scripts._literal(content, at)
        depth += (content[at] in "([{") - (content[at] in ")]}")
        if depth < 0:
            return at
        at = skip[1] if skip else at + 1
    return at


def test_closings_of_any_place():
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice("()[]{}'\"`a\n") for _ in range(rng.randrange(40)))
        found = scripts._closings(text)
        assert [found(at) for at in range(len(text) + 1)] == [closing_one_by_one(text, at) for at in range(len(text) + 1)], text


def test_nested_calls_without_an_end():
    start = time.time()
    assert len(scripts.calls("fetch('/a', {x: $.get(\n" * 20000)) == 20000
    assert scripts.calls("fetch(" * 50000 + "type: 'post'") == []
    assert time.time() - start < 5


def test_sections_of_a_file_with_many_headings(spark):
    text = "".join(f"# T\nline {k}\n\n" for k in range(3000))
    got = markdown.sections(spark.createDataFrame([("a.md", text), ("b.md", "no heading"), ("c.md", None), ("d.md", "# Last")], "path string, content string")).orderBy("path", "line").collect()
    assert len(got) == 3001 and got[2999].anchor == "t-2999" and got[7].body == "line 7\n" and got[2999].body == "line 2999\n\n" and (got[3000].path, got[3000].body) == ("d.md", "")
