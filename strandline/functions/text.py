"""Text functions on columns: slugs, paths, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are trimmed off both ends of a title.
BLANKS = " \t\n\r\0\x0b"


def ascii_lower(c: Column) -> Column:
    """A-Z only; lower() would fold other letters too."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slugify(c: Column) -> Column:
    """Anchor of a heading: a-z, 0-9, _ and -, white space as one hyphen."""
    kept = F.regexp_replace(ascii_lower(c), r"[^a-z0-9\s_-]", "")
    return F.regexp_replace(F.btrim(kept, F.lit(BLANKS)), r"\s+", "-")


def normalise_path(c: Column) -> Column:
    """Resolve ".", ".." and empty parts; ".." above the root is ignored."""
    step = lambda acc, part: F.when(part.isin("", "."), acc).when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(part)))
    return F.array_join(F.aggregate(F.split(c, "/"), F.array().cast("array<string>"), step), "/")


def short_name(c: Column) -> Column:
    """What stands behind the last backslash."""
    return F.substring_index(c, "\\", -1)


def namespace(c: Column) -> Column:
    """What stands before the last backslash; empty without one."""
    return F.regexp_extract(c, r"^(.*)\\[^\\]*$", 1)


def view_name(path: Column) -> Column:
    """Dotted name of a template file."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^resources/views/", ""), r"\.blade\.php$", "")
    return F.translate(bare, "/", ".")
