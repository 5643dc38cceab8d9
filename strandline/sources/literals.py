"""Calls that name a view or a route: literal names become edges, all else stays unresolved with its reason."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.keys import key

#: What a template's own runtime calls, which is no reference of the application.
RUNTIME = ("$__env->", "$attributes->", "$component->", "$errors->", "$__bag->")

_CALL = re.compile(r"(?<![\w$>:\\])(?:(view|route|to_route)|(View\s*::\s*make))\s*\(\s*", re.IGNORECASE)
_LITERAL = re.compile(r"""'((?:[^'\\]|\\.)*)'\s*[,)]|"((?:[^"\\$]|\\.)*)"\s*[,)]""", re.DOTALL)
ROWS = "path string, line int, call string, literal string, expression string"


def calls(content: str) -> list[tuple[int, str, str | None, str]]:
    """(line, call, literal or None, expression up to its line's end or bracket); calls without an argument are none."""
    ends = [m.start() for m in re.finditer("\n", content)]
    out = []
    for m in _CALL.finditer(content):
        rest = content[m.end() : m.end() + 1]
        if rest in ("", ")"):
            continue
        said = _LITERAL.match(content, m.end())
        literal = None if said is None else re.sub(r"\\(['\"\\])", r"\1", said[1] if said[1] is not None else said[2])
        stop = re.compile(r"[)\n]").search(content, m.end())
        out.append((bisect_right(ends, m.start() - 1) + 1, (m[1] or "view::make").lower(), literal, content[m.start() : stop.end() if stop else len(content)].strip()))
    return out


def scan(files: DataFrame) -> DataFrame:
    """(path, line, call, literal, expression) of view(), route(), to_route() and View::make() in files (path, content).
    Null content has none. A name that is put together, or a variable, is no literal: it is null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(p, *x) for p, c in zip(f.path, f.content) for x in calls(c or "")], columns=["path", "line", "call", "literal", "expression"])

    return files.select("path", "content").mapInPandas(run, ROWS)


def resolve(found: DataFrame, route_names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (type, path, line, to_key), and unresolved rows (path, line, kind, expression, candidates). A view's name is
    its node; a route's is looked up (name, key), and a name that no route has says so among its candidates. Calls
    without a literal stay open without candidates, but View::make(), which is passed over."""
    view = F.col("call").isin("view", "view::make")
    known = found.where("literal is not null")
    views = known.where(view).select(F.lit("renders").alias("type"), "path", "line", key("view", F.col("literal")).alias("to_key"))
    routes = known.where(~view).join(route_names.select(F.col("name").alias("literal"), F.col("key").alias("to_key")), "literal", "left")
    links = routes.where("to_key is not null").select(F.lit("links_route").alias("type"), "path", "line", "to_key")
    said = F.array(F.concat(F.lit("route name '"), F.col("literal"), F.lit("' not found")))
    lost = routes.where("to_key is null").select("path", "line", F.lit("links_route").alias("kind"), F.col("literal").alias("expression"), said.alias("candidates"))
    other = found.where("literal is null and call <> 'view::make'").select("path", "line", F.col("call").alias("kind"), "expression", F.lit(None).cast("array<string>").alias("candidates"))
    return views.unionByName(links), lost.unionByName(other)


def without_noise(unresolved: DataFrame) -> DataFrame:
    """Unresolved rows whose expression is not a call of the template runtime."""
    noise = F.lit(False)
    for prefix in RUNTIME:
        noise = noise | F.col("expression").startswith(prefix)
    return unresolved.where(~F.coalesce(noise, F.lit(False)))
