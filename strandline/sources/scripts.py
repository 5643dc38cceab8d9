"""Requests in JavaScript files, and the routes they mean."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Calls that name the verb, by object; calls with an options object; what options say the verb and the URL.
_VERBS = {"axios": ("get", "post", "put", "patch", "delete", "head"), "$": ("get", "post")}
_WITH_OPTIONS = ("axios", "axios.request", "$.ajax")
_CALL = re.compile(r"(?<![\w$.])(axios|\$|fetch)\s*(?:\.\s*(\w+)\s*)?\(\s*", re.I)
_SAID = re.compile(r"(?<!\w)(method|type)\s*:\s*(['\"`])(\w+)\2", re.I)
_URL = re.compile(r"(?<!\w)url\s*:\s*(?=['\"`])", re.I)
_SIGN = re.compile(r"[()\[\]{}'\"`]")


def _literal(content: str, at: int) -> tuple[str, int] | None:
    """The string literal that starts at a place, and the place behind it."""
    end = content.find(content[at], at + 1) if content[at : at + 1] in ("'", '"', "`") else -1
    return (content[at + 1 : end], end + 1) if end >= 0 and "\n" not in content[at:end] else None


def _closings(content: str) -> Callable[[int], int]:
    """For any place, the one of the bracket that closes what is open there (the end where none does), brackets inside
    literals not counted. Brackets and quotes are looked at once, from the last to the first: what closes behind an
    opening bracket closes it, and goes on behind that."""
    spots = [m.start() for m in _SIGN.finditer(content)]
    ends = [len(content)] * (len(spots) + 1)
    behind = lambda at: ends[bisect_left(spots, at)]
    for k in range(len(spots) - 1, -1, -1):
        at = spots[k]
        if content[at] in ")]}":
            ends[k] = at
        elif content[at] in "([{":
            ends[k] = behind(ends[k + 1] + 1)
        else:
            skip = _literal(content, at)
            ends[k] = behind(skip[1]) if skip else ends[k + 1]
    return behind


def _firsts(found: list[re.Match]) -> Callable[[int], re.Match | None]:
    """For any place, the first of some matches that starts there or behind it."""
    starts = [m.start() for m in found]
    return lambda at: found[k] if (k := bisect_left(starts, at)) < len(found) else None


def calls(content: str) -> list[tuple[int, str, str]]:
    """(line, verb, url) of the calls in one script. Time grows with its length, however calls nest."""
    out: list[tuple[int, str, str]] = []
    closing, said_at, url_at = _closings(content), _firsts(list(_SAID.finditer(content))), _firsts(list(_URL.finditer(content)))
    breaks = [m.start() for m in re.finditer("\n", content)]
    for m in _CALL.finditer(content):
        of, verb, at = m[1].lower(), (m[2] or "").lower(), m.end()
        end = closing(at)
        said, inside, literal = said_at(at), url_at(at), None
        by_option = said[3] if said and said.end() <= end else "GET"
        if of == "fetch" and not verb:
            literal, verb = _literal(content, at), by_option
        elif verb in _VERBS.get(of, ()):
            literal = _literal(content, at)
        elif (f"{of}.{verb}" if verb else of) in _WITH_OPTIONS and at < end and content[at] == "{" and inside and inside.end() < end:
            literal, verb = _literal(content, inside.end()), by_option
            literal = literal if literal and literal[1] <= end else None
        if literal and "${" not in literal[0]:
            out.append((bisect_left(breaks, m.start()) + 1, verb.upper(), literal[0]))
    return sorted(out)


def requests(files: DataFrame) -> DataFrame:
    """(path, line, verb, url) of calls with a literal URL: axios.verb(), $.get(), $.post(), fetch(), and the
    option objects of axios(), axios.request(), fetch() and $.ajax(), with whatever they nest. The verb is GET where none is said. Null content has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(p, *x) for p, c in zip(f.path, f.content) for x in calls(c or "")], columns=["path", "line", "verb", "url"])

    return files.select("path", "content").mapInPandas(run, "path string, line int, verb string, url string")


def match_requests(found: DataFrame, routes: DataFrame) -> DataFrame:
    """Root-relative requests (path, line, verb, url) with their routes (key, verb, uri): the one of that verb and
    URL, else the only one of that URL; several stay open with all `candidates`, none is no row."""
    found = found.where(F.col("url").startswith("/"))
    exact = found.join(routes.select("verb", F.col("uri").alias("url"), "key"), ["verb", "url"])
    rest = found.join(exact.select(*found.columns), found.columns, "left_anti")
    near = rest.join(routes.select(F.col("uri").alias("url"), "key"), "url").groupBy(*found.columns).agg(F.sort_array(F.collect_set("key")).alias("candidates"))
    one = F.when(F.size("candidates") == 1, F.get("candidates", F.lit(0)))
    return exact.select(*found.columns, "key", F.array("key").alias("candidates")).unionByName(near.select(*found.columns, one.alias("key"), "candidates"))
