"""Models: classes under one of the base classes, their properties, tables and summaries.

classes(class, parent, traits, ...), properties(class, property, type, source); names of classes are compared without
case, names of properties with it. A model is found through its parents alone; a property through traits, in order,
and then the parent, as deep as symbols.ancestors looks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import short_name
from strandline.operators import lookup
from strandline.operators.lookup import Answer, is_exact
from strandline.operators.symbols import ancestors
from strandline.plans.runtime import cut

#: Base classes of models, the ending of the trait that keeps deleted rows, and the type of times.
BASES = ("illuminate\\database\\eloquent\\model", "illuminate\\foundation\\auth\\user", "illuminate\\database\\eloquent\\relations\\pivot")
SOFT_DELETES, TIME = "\\softdeletes", "Carbon\\Carbon"
TIMES, SOFT_TIMES = ("created_at", "updated_at"), ("deleted_at",)

#: English nouns with one form, with irregular plurals, and endings (a pattern, what replaces it) of which
#: the first that fits counts.
ONE_FORM = ("audio", "bison", "cattle", "chassis", "compensation", "data", "deer", "education", "equipment", "evidence", "feedback", "firmware", "fish", "furniture", "gold", "hardware", "information", "jedi", "knowledge", "love", "metadata", "money", "moose", "news", "nutrition", "offspring", "plankton", "pokemon", "police", "rain", "rice", "series", "sheep", "software", "species", "swine", "traffic", "wheat")
IRREGULAR = {"child": "children", "criterion": "criteria", "foot": "feet", "goose": "geese", "man": "men", "move": "moves", "ox": "oxen", "person": "people", "tooth": "teeth", "woman": "women"}
ENDINGS = (
    ("quiz$", "quizzes"), ("([ml])ouse$", "$1ice"), ("(matr|vert|ind)(ix|ex)$", "$1ices"), ("(x|ch|ss|sh|z)$", "$1es"), ("([^aeiouy]|qu)y$", "$1ies"),
    ("([^f])fe$", "$1ves"), ("([lr])f$", "$1ves"), ("sis$", "ses"), ("([ti])um$", "$1a"), ("(buffal|tomat|potat|ech|her|vet)o$", "$1oes"), ("(ax|cris|test)is$", "$1es"),
    ("(alias|bus|status|campus|virus)$", "$1es"), ("s$", "s"), ("$", "s"),
)


def plural(word: Column) -> Column:
    """The plural of an English noun in lower case."""
    by_ending = reduce(lambda other, e: F.when(word.rlike(e[0]), F.regexp_replace(word, *e)).otherwise(other), reversed(ENDINGS[:-1]), F.concat(word, F.lit(ENDINGS[-1][1])))
    irregular = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    return F.when(word.isin(*ONE_FORM), word).otherwise(F.coalesce(F.try_element_at(irregular, word), by_ending))


def table_name(name: Column) -> Column:
    """The table of a class by convention: its short name in parts from one capital to the next, joined by underscores, the
    last part in the plural."""
    base = short_name(name)
    last = F.regexp_extract(base, "([A-Z]?[^A-Z]*)$", 1)
    head = F.substr(base, F.lit(1), F.length(base) - F.length(last))
    snake = F.lower(F.regexp_replace(head, "(.)(?=[A-Z])", "$1_"))
    return F.concat(F.when(snake != "", F.concat(snake, F.lit("_"))).otherwise(""), plural(F.lower(last)))


#: Parents up to the fifteenth are found, by jumps of one, two, four and eight.
JUMPS = 4


def lineage(classes: DataFrame) -> DataFrame:
    """(class, ancestor): a class and its parents, in lower case. Each round joins the pairs found with jumps twice as
    long, so few rounds do; cycles end with the last one."""
    name, up = F.lower("class"), F.lower("parent")
    jump = cut(classes.where("parent is not null").select(name.alias("class"), up.alias("ancestor")).distinct())
    lines = classes.select(name.alias("class"), name.alias("ancestor")).distinct()
    then = lambda one, other: one.join(other.select(F.col("class").alias("ancestor"), F.col("ancestor").alias("far")), "ancestor").select("class", F.col("far").alias("ancestor"))
    for k in range(JUMPS):
        if k:
            jump = cut(then(jump, jump).distinct())
        if jump.isEmpty():
            break
        lines = cut(lines.unionByName(then(lines, jump)).distinct())
    return lines


def models(classes: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(class), in lower case, of the classes that are a base class or under one by their parents."""
    lines = lineage(classes) if lines is None else lines
    return lines.where(F.col("ancestor").isin(*BASES)).select("class").distinct()


def soft_deleting(classes: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(class), in lower case, of the classes that use the trait of kept rows, or whose parents do."""
    lines = lineage(classes) if lines is None else lines
    using = classes.where(F.exists("traits", lambda t: F.lower(t).endswith(SOFT_DELETES))).select(F.lower("class").alias("ancestor"))
    return lines.join(using, "ancestor", "left_semi").select("class").distinct()


def inherited_properties(classes: DataFrame, properties: DataFrame) -> DataFrame:
    """(class, property, owner, type, source): every property of every class, in lower case, from its first owner.
    Interfaces have none. Models have the times of rows besides, without an owner, where nobody declares them."""
    own = properties.select(F.lower("class").alias("ancestor"), "property", F.struct(F.col("class").alias("owner"), "type", "source").alias("said"))
    first = F.min_by("said", F.struct("rank", "said"))
    found = ancestors(classes, interfaces=False).join(own, "ancestor").groupBy("class", "property").agg(first.alias("said")).select("class", "property", "said.*")
    lines = lineage(classes)
    is_model = models(classes, lines)
    times = lambda df, names: df.select("class", F.explode(F.array(*[F.lit(n) for n in names])).alias("property"))
    given = times(is_model, TIMES).unionByName(times(is_model.join(soft_deleting(classes, lines), "class", "left_semi"), SOFT_TIMES))
    missing = given.join(found, ["class", "property"], "left_anti")
    return found.unionByName(missing.select("class", "property", F.lit(None).cast("string").alias("owner"), F.lit(TIME).alias("type"), F.lit("cast").alias("source")))


def table_edges(classes: DataFrame) -> DataFrame:
    """(type, from_key, to_key, file, meta): the table that each model maps, the one that it declares (`table`) or the one
    by convention; meta, a variant, says which."""
    mine = classes.join(models(classes).withColumnRenamed("class", "low"), F.lower("class") == F.col("low"), "left_semi")
    said = F.to_json(F.struct(F.when(F.col("table").isNotNull(), "declared").otherwise("convention").alias("source")))
    to = F.concat(F.lit("table:"), F.coalesce("table", table_name(F.col("class"))))
    return mine.select(F.lit("maps_table").alias("type"), F.concat(F.lit("class:"), "class").alias("from_key"), to.alias("to_key"), "file", F.parse_json(said).alias("meta"))


def details(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, role, other, relation, n) of the classes in `keys` (key), in any number: the table that each maps (the least
    key of several), its relations with their names, its observers, the files that touch its table, and the number of
    calls to it, 0 among them. One row for each fact; equal facts are counted in `n`. Edges have a variant `meta`."""
    keys = keys.select("key").distinct()
    none = F.lit(None).cast("string")
    row = lambda df, role, other, relation=none: df.select("key", F.lit(role).alias("role"), other.alias("other"), relation.alias("relation"))
    of = lambda type_, mine: edges.where(F.col("type") == type_).withColumn("key", F.col(mine)).join(keys, "key", "left_semi")
    tables = of("maps_table", "from_key").groupBy("key").agg(F.min("to_key").alias("table"))
    touching = edges.where((F.col("type") == "touches_table") & F.col("file").isNotNull()).select(F.col("to_key").alias("table"), "file").distinct()
    facts = [
        row(tables, "table", F.col("table")),
        row(of("relates", "from_key"), "relations", F.col("to_key"), F.try_variant_get("meta", "$.relation", "string")),
        row(of("observes", "to_key"), "observers", F.col("from_key")),
        row(touching.join(tables, "table"), "migrations", F.col("file")),
    ]
    counted = reduce(DataFrame.unionByName, facts).groupBy("key", "role", "other", "relation").agg(F.count("*").alias("n"))
    calls = of("calls", "to_key").groupBy("key").agg(F.count("*").alias("n"))
    sites = keys.join(calls, "key", "left").select("key", F.lit("call_sites").alias("role"), none.alias("other"), none.alias("relation"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return counted.unionByName(sites)


def model(nodes: DataFrame, edges: DataFrame, name: str) -> Answer:
    """details() of the one class of that key, name or short name. None or several are no answer: the classes of that
    name, or those like it, are suggested."""
    rows = lookup.candidates(nodes, name, "class")
    exact = rows.where(is_exact(name))
    found = exact.select("key").limit(2).collect()
    if len(found) == 1:
        return Answer(True, details(edges, exact))
    likely = exact if found else rows
    return Answer(False, suggestions=likely.limit(lookup.SUGGESTIONS).select("key", "name", "type", F.lit(lookup.SUGGESTION_SCORE).alias("score")))
