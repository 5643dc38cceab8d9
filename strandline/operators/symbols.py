"""Symbol tables: what a class inherits, which class an interface stands for, and references joined with both.

classes(class, kind, parent, interfaces, traits), methods(class, method, return_type), names compared without
case. Ancestors are found level by level with one join each; their order of lookup is an array that sorts as
the depth-first search would: own, traits in order, parent, interfaces in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.keys import base_confidence
from strandline.plans.runtime import cut

DEPTH = 15

#: Short names that stand for a class of the same name in FACADES, and those that stand for another one.
FACADES = "Illuminate\\Support\\Facades\\"
SHORT = (
    "Artisan", "Auth", "Blade", "Broadcast", "Bus", "Cache", "Config", "Cookie", "Crypt", "Date", "DB", "Event", "File", "Gate", "Hash", "Http", "Lang", "Log", "Mail", "Notification",
    "Password", "Process", "Queue", "RateLimiter", "Redirect", "Redis", "Request", "Response", "Route", "Schema", "Schedule", "Session", "Storage", "URL", "Validator", "View", "Vite",
)
OTHER = {"App": "Illuminate\\Foundation\\Application", "Arr": "Illuminate\\Support\\Arr", "Str": "Illuminate\\Support\\Str"}


def ancestors(classes: DataFrame, interfaces: bool = True, depth: int = DEPTH) -> DataFrame:
    """(class, ancestor, rank): a class itself and all it inherits from, each once at its first rank. Cycles end
    at `depth`; names without a class are kept as ancestors, without any of their own."""
    low = lambda c: F.lower(c)
    kinds = [F.transform(F.coalesce("traits", F.array()), lambda t, i: F.struct(low(t).alias("up"), F.array(F.lit(0), i).alias("step")))]
    kinds.append(F.when(F.col("parent").isNotNull(), F.array(F.struct(low(F.col("parent")).alias("up"), F.array(F.lit(1), F.lit(0)).alias("step")))).otherwise(F.array()))
    if interfaces:
        kinds.append(F.transform(F.coalesce("interfaces", F.array()), lambda t, i: F.struct(low(t).alias("up"), F.array(F.lit(2), i).alias("step"))))
    ups = cut(classes.select(low(F.col("class")).alias("at"), F.explode(F.concat(*kinds)).alias("e")).select("at", "e.up", "e.step"))
    level = cut(classes.select(low(F.col("class")).alias("class"), low(F.col("class")).alias("ancestor"), F.array().cast("array<int>").alias("rank")).distinct())
    found = [level]
    for _ in range(depth):
        step = level.join(ups, F.col("ancestor") == F.col("at")).select("class", F.col("up").alias("ancestor"), F.concat("rank", "step").alias("rank"))
        seen = reduce(DataFrame.unionByName, found).select("class", "ancestor", F.col("rank").alias("first"))
        # a class met before matters again only at an earlier rank
        old = seen.groupBy("class", "ancestor").agg(F.min("first").alias("first"))
        level = cut(step.groupBy("class", "ancestor").agg(F.min("rank").alias("rank")).join(old, ["class", "ancestor"], "left").where("first is null or rank < first").drop("first"))
        if level.isEmpty():
            break
        found.append(level)
    return reduce(DataFrame.unionByName, found).groupBy("class", "ancestor").agg(F.min("rank").alias("rank"))


def inherited_methods(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """(class, method, owner, return_type): for every class each method it has, from the first owner in order."""
    own = methods.select(F.lower("class").alias("ancestor"), F.lower("method").alias("method"), "return_type", F.col("class").alias("owner"))
    first = F.min_by(F.struct("owner", "return_type"), F.struct("rank", "owner"))
    return ancestors(classes).join(own, "ancestor").groupBy("class", "method").agg(first.alias("x")).select("class", "method", "x.owner", "x.return_type")


def descends_from(classes: DataFrame, bases: list[str]) -> DataFrame:
    """Classes (class) with one of the bases among their parents' parents, traits and so on."""
    return ancestors(classes, interfaces=False).where(F.col("ancestor").isin([b.lower() for b in bases]) & (F.col("class") != F.col("ancestor"))).select("class").distinct()


def substitute_interfaces(types: DataFrame, classes: DataFrame, bindings: DataFrame) -> DataFrame:
    """types (type, ...) with `concrete`, `kind` and `cap`: a binding's class, else the only project class that
    implements an interface, else the type itself."""
    bound = bindings.select(F.lower("abstract").alias("k"), F.col("concrete").alias("bound")).dropDuplicates(["k"])
    each = classes.where("is_project and kind = 'class'").select(F.col("class").alias("one"), F.explode("interfaces").alias("i"))
    only = each.groupBy(F.lower("i").alias("k")).agg(F.count("*").alias("n"), F.min("one").alias("one")).where("n = 1").drop("n")
    out = types.withColumn("k", F.lower("type")).join(bound, "k", "left").join(only, "k", "left")
    kind = F.when(F.col("bound").isNotNull(), "container").when(F.col("one").isNotNull(), "interface")
    return out.withColumns({"concrete": F.coalesce("bound", "one", "type"), "kind": kind, "cap": F.coalesce(base_confidence(kind), F.lit(1.0))}).drop("k", "bound", "one")


def expand_aliases(types: DataFrame, classes: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """types (type, ...) with short names as the classes they stand for, by `aliases` (short name: class; the fixed ones
    if none are given). A name with a namespace stays, and so does one that a class of its own has; case is ignored."""
    given = {n: FACADES + n for n in SHORT} | OTHER if aliases is None else aliases
    low = {n.lower(): full for n, full in given.items()}
    if not low:
        return types
    full = F.try_element_at(F.create_map(*[F.lit(x) for pair in low.items() for x in pair]), F.lower("type"))
    # no more rows than aliases
    taken = classes.select(F.lower("class").alias("_taken")).where(F.col("_taken").isin(*low)).distinct()
    rows = types.join(F.broadcast(taken), F.lower("type") == F.col("_taken"), "left")
    return rows.withColumn("type", F.coalesce(F.when(F.col("_taken").isNull(), full), "type")).drop("_taken")


def resolve_calls(calls: DataFrame, classes: DataFrame, methods: DataFrame, bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """calls (from_key, type, member, resolution, confidence) as edges and unresolved references. A call goes to
    the method its receiver's class has or inherits, to the class where it has none of that name, or to an
    external node for a class that is not known; without a receiver's type it stays unresolved."""
    typed = substitute_interfaces(calls.where("type is not null"), classes, bindings)
    known = classes.select(F.lower("class").alias("k"), F.col("class").alias("found"))
    at = typed.withColumns({"k": F.lower("concrete"), "m": F.lower("member")}).join(known, "k", "left")
    have = inherited_methods(classes, methods).select(F.col("class").alias("k"), F.col("method").alias("m"), "owner")
    at = at.join(have, ["k", "m"], "left")
    to = F.when(F.col("owner").isNotNull(), F.concat(F.lit("method:"), F.col("owner"), F.lit("::"), F.col("member"))).when(F.col("found").isNotNull(), F.concat(F.lit("class:"), F.col("found"))).otherwise(F.concat(F.lit("external:"), F.col("concrete")))
    resolution = F.coalesce("kind", "resolution")
    confidence: Column = F.least("confidence", "cap", F.coalesce(base_confidence(F.col("resolution")), F.lit(1.0)))
    edges = at.select(F.lit("calls").alias("type"), "from_key", to.alias("to_key"), resolution.alias("resolution"), confidence.alias("confidence"), "member")
    return edges, calls.where("type is null").select("from_key", F.lit("calls").alias("kind"), "member")


def declared_symbols(classes: DataFrame, functions: DataFrame) -> DataFrame:
    """(file, symbol): what files declare, in lower case: classes, their interfaces, and function:name."""
    own = classes.select("file", F.lower("class").alias("symbol"))
    used = classes.select("file", F.explode("interfaces").alias("i")).select("file", F.lower("i").alias("symbol"))
    named = functions.select("file", F.concat(F.lit("function:"), F.lower("name")).alias("symbol"))
    return own.unionByName(used).unionByName(named).distinct()
