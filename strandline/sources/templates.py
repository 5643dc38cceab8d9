"""Templates: the views that a template includes and the components it uses.

A directive is what stands between an "@" and the next one: a name, an opening bracket, arguments. Brackets inside
the arguments are taken out before they are split at commas, so that an argument may hold a call or a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import view_name

#: For each directive the argument that names the view, and its rank; for the same view the higher rank
#: wins, then the later place in the text. Of the directives in FIRST_ONLY only the first one counts.
ARGUMENT = {"extends": 0, "include": 0, "includeIf": 0, "each": 0, "includeWhen": 1, "includeUnless": 1, "includeFirst": 0}
RANK = {"extends": 0, "include": 1, "includeIf": 2, "each": 3, "includeWhen": 4, "includeUnless": 4, "includeFirst": 5}
FIRST_ONLY = ("extends", "includeFirst")
#: Brackets within brackets are taken out so many times.
DEPTH = 4


def directives(files: DataFrame) -> DataFrame:
    """(view, place, name, arguments): every "@name(" of a template, with what follows the bracket."""
    parts = files.select(view_name(F.col("path")).alias("view"), F.posexplode(F.split("content", "@")).alias("place", "part"))
    rows = parts.where("place > 0").select("view", "place", F.regexp_extract("part", r"^(\w+)\s*\(", 1).alias("name"), F.regexp_replace("part", r"^\w+\s*\(", "").alias("arguments"))
    return rows.where("name <> ''")


def _literal(argument: Column) -> Column:
    """The quoted string that an argument starts with; null if it starts with none."""
    text = F.btrim(argument)
    inner = F.get(F.split(F.substr(text, F.lit(2)), "['\"]", 2), F.lit(0))
    return F.when(text.rlike("^['\"]") & text.rlike("^.[^'\"]+['\"]"), inner)


def _argument(arguments: Column, number: int) -> Column:
    """The argument of that number, without what it has in brackets."""
    if number == 0:
        return arguments
    flat = arguments
    for _ in range(DEPTH):
        flat = F.regexp_replace(flat, r"[(\[][^()\[\]]*[)\]]", "")
    return F.get(F.split(F.substring_index(flat, ")", 1), ","), F.lit(number))


def includes(files: DataFrame) -> DataFrame:
    """(view, target, directive): one row for each included view of a template."""
    rows = directives(files).where(F.col("name").isin(list(ARGUMENT)))
    second = F.col("name").isin([n for n, k in ARGUMENT.items() if k == 1])
    one = F.array(_literal(F.when(second, _argument(F.col("arguments"), 1)).otherwise(F.col("arguments"))))
    items = F.split(F.substring_index(F.regexp_replace("arguments", r"^\s*\[", ""), "]", 1), ",")
    listed = F.when(F.col("arguments").rlike(r"^\s*\["), F.transform(items, _literal))
    targets = F.when(F.col("name") == "includeFirst", listed).otherwise(one)
    rank = F.element_at(F.create_map(*[F.lit(x) for pair in RANK.items() for x in pair]), F.col("name"))
    # exploded at once: a filter on the targets would be worked out anew beneath the columns that it is made of
    named = rows.select("view", "place", "name", F.explode(F.filter(targets, lambda t: t.isNotNull())).alias("target"))
    # one shuffle by view serves the window and the last grouping; a join would build a table of all directives
    first = F.min("place").over(Window.partitionBy("view", "name"))
    kept = named.repartition("view").withColumn("first", first).where(~F.col("name").isin(*FIRST_ONLY) | (F.col("place") == F.col("first")))
    each = kept.select("view", "target", "name", F.struct(rank.alias("rank"), "place").alias("order"))
    return each.groupBy("view", "target").agg(F.max_by("name", "order").alias("directive"))


def components(files: DataFrame) -> DataFrame:
    """(view, component): tags <x-name> and <x:name>, and @component('name'), each once."""
    after = F.explode(F.slice(F.split("content", "<x[-:]"), 2, 1 << 30))
    tags = files.select(view_name(F.col("path")).alias("view"), after.alias("rest")).select("view", F.regexp_extract("rest", r"^[\w.-]+", 0).alias("component")).where("component <> ''")
    calls = directives(files).where("name = 'component'").select("view", _literal(F.col("arguments")).alias("component")).where("component is not null")
    return tags.unionByName(calls).distinct()
