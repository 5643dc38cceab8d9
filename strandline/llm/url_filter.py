"""URL filter: host and path rules, and a weighted vocabulary matched by an Aho-Corasick automaton.

A url's host is what follows the first "://" up to "/", "?", "#" or the end, with A-Z lower-cased; its
path runs from there to "?", "#" or the end. Null, or no "://": both are empty.

A rule (action, host, path) fits its host and every subdomain of it, if the url's path starts with the
rule's path; of the rules that fit, the longest host + path wins (listed first on a tie).

Without a rule, the method decides: one automaton pass finds all vocabulary terms in the lower-cased url;
a hit counts only between characters that are no ASCII letters or digits. A strict term weighs 1, a soft
term 1/soft_hits, each term counts once; a sum of 1 or more blocks. So one strict term, or `soft_hits`
distinct soft ones, reject a url.

Null urls are allowed (no term occurs in them), repeated rows are judged each, extra columns are ignored.
Rules and vocabulary are arguments that go to every task; RULE_LIMIT bounds their number."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

STRICT = ("casino", "porn", "xxx", "viagra", "cialis", "escort", "escorts", "hentai", "jackpot", "camgirls", "warez")
SOFT = ("free", "bet", "bets", "win", "cheap", "pill", "pills", "ads", "track", "tracker", "poker", "slots", "loan", "loans", "dating", "adult", "crack", "keygen", "torrent", "prize")
SOFT_HITS = 2

#: At most so many rules and terms are sent to the tasks (some tens of MB).
RULE_LIMIT = 500_000

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_INSIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    if url is None:
        return "", ""
    _, sep, rest = url.partition("://")
    if not sep:
        return "", ""
    end = min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))
    rest = rest[:end]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def automaton(strict: Sequence[str], soft: Sequence[str], soft_hits: int) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for weight, terms in ((1 / soft_hits, soft), (1.0, strict)):
        for term in terms:
            found.add_word(term.translate(_LOWER), (term.translate(_LOWER), weight))
    found.make_automaton()
    return found


def term_weight(url: str | None, terms: ahocorasick.Automaton) -> float:
    """The summed weight of the distinct terms that stand between boundaries."""
    if not url or not len(terms):
        return 0.0
    low, hits = url.translate(_LOWER), {}
    for end, (term, weight) in terms.iter(low):
        start = end - len(term) + 1
        if (start == 0 or low[start - 1] not in _INSIDE) and (end + 1 == len(low) or low[end + 1] not in _INSIDE):
            hits[term] = weight
    return sum(hits.values())


def rule_index(rules: Sequence[tuple[str, str, str]]) -> dict[str, list[tuple[str, str, tuple[int, int], str]]]:
    """By host: (path, action, (length, minus its place in the list), name), longest path first."""
    index: dict[str, list[tuple[str, str, tuple[int, int], str]]] = {}
    for k, (action, host, path) in enumerate(rules):
        index.setdefault(host, []).append((path, action, (len(host + path), -k), host + path))
    for host in index:
        index[host].sort(key=lambda r: r[2], reverse=True)
    return index


def best_rule(host: str, path: str, index: dict[str, list[tuple[str, str, tuple[int, int], str]]]) -> tuple[str, str] | None:
    """(action, name) of the longest rule that fits, the first in the list on a tie."""
    best, at = None, 0
    while host:
        suffix = host[at:]
        for rule in index.get(suffix, ()):
            if path.startswith(rule[0]):
                if best is None or rule[2] > best[2]:
                    best = rule
                break
        dot = host.find(".", at)
        if dot < 0:
            break
        at = dot + 1
    return (best[1], best[3]) if best else None


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = (), strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_hits: int = SOFT_HITS, key: str = "page_id", url: str = "url") -> DataFrame:
    """Rows (key, host, path, rule, verdict, weight) for every row of `pages`; a map without shuffle that
    reads two columns. See the module's text for what nulls, ties and rules mean."""
    if len(rules) + len(strict) + len(soft) > RULE_LIMIT:
        raise ValueError(f"over {RULE_LIMIT} rules and terms")
    rules, strict, soft = list(rules), list(strict), list(soft)
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, index = automaton(strict, soft, soft_hits), rule_index(rules)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for value in batch.column(1).to_pylist():
                host, path = split_url(value)
                rule = best_rule(host, path, index)
                weight = term_weight(value, terms)
                verdict = rule[0] if rule else "block" if weight >= 1 - 1e-9 else "allow"
                for column, x in zip(out, (host, path, rule and rule[1], verdict, weight)):
                    column.append(x)
            arrays = [pa.array(x, t) for x, t in zip(out, (pa.string(), pa.string(), pa.string(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[key, "host", "path", "rule", "verdict", "weight"])

    return pages.select(key, url).mapInArrow(run, f"`{key}` {kind}, host string, path string, rule string, verdict string, weight double")


#: The rules of the query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def oracle(rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_hits: int = SOFT_HITS) -> str:
    """DuckDB SQL for filter_urls() over `pages`, terms being plain letters and digits."""
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    count = lambda terms: " + ".join(f"CAST(regexp_matches({low}, '(^|[^a-z0-9]){t}($|[^a-z0-9])') AS INTEGER)" for t in terms) or "0"
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{k(r)}'" for r in order) + " END"
    return f"""
    WITH a AS (SELECT page_id, url, CASE WHEN position('://' IN coalesce(url, '')) > 0
                 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
    b AS (SELECT page_id, url,
            translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            substr(regexp_extract(rest, '^[^?#]*'), length(regexp_extract(rest, '^[^/?#]*')) + 1) AS path FROM a),
    c AS (SELECT *, {case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS act,
            ({count(strict)}) + ({count(soft)}) / {float(soft_hits)} AS weight FROM b)
    SELECT page_id, host, path, rule, coalesce(act, CASE WHEN weight >= 1 THEN 'block' ELSE 'allow' END) AS verdict,
           CAST(weight AS DOUBLE) AS weight FROM c"""
