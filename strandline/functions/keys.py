"""Node keys, confidences of resolutions, and language tags, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The confidence that each way of resolving a reference has at most.
CONFIDENCE = {
    "static": 1.0, "new": 1.0, "self": 1.0, "parent": 1.0, "this": 1.0, "typed_property": 1.0, "param": 1.0,
    "container": 1.0, "catch": 1.0, "constructor_assignment": 0.8, "local_assign": 0.8, "return_type": 0.8,
    "facade": 0.8, "cast": 0.8, "eloquent": 0.7, "docblock": 0.7, "interface": 0.6, "unique_member": 0.4,
    "unresolved": 0.0,
}

#: File endings and languages, the longest ending first.
LANGUAGES = ((".blade.php", "blade"), (".php", "php"), (".md", "md"), (".markdown", "md"), (".js", "js"), (".jsx", "js"), (".ts", "js"), (".tsx", "js"))


def key(prefix: str, *parts: Column | str) -> Column:
    """`prefix:` and the parts, one after the other; strings are literals."""
    return F.concat(F.lit(f"{prefix}:"), *[F.lit(p) if isinstance(p, str) else p for p in parts])


def base_confidence(resolution: Column) -> Column:
    table = F.create_map(*[x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(table, resolution)


def chained(resolution: Column, chain: Column) -> Column:
    """Confidence of a reference at the end of a chain: the least of both."""
    return F.least(base_confidence(resolution), chain)


def language(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for ending, name in reversed(LANGUAGES):
        out = F.when(F.lower(path).endswith(ending), name).otherwise(out)
    return out
