"""Rebuilds that touch what changed and what depends on it, to a fixed point.

Three tables say what a rebuild needs to know, besides the files (path, hash):

    declared (path, symbol, shape)   what a file declares; shape stands for all that others may learn from it
    consulted (path, symbol, hit)    every symbol that was looked up for a file, misses among them
    ...                              whatever else a file yields, each table with a column `path`

A rebuild takes new, changed and deleted files as its first frontier. What the frontier declares now is compared with
what it declared before; symbols that came, went or changed their shape lead, through the index of symbols consulted,
to the files of the next frontier, which are read again with the symbols as they are now. It ends when a frontier
changes no symbol. Each round reads only its frontier and joins only the symbols that this round changed; a file may
come back in a later round. The other tables' rows are made once, for all files touched, and one commit replaces the
touched files' rows in all tables: a reader sees the old state or the new one.

`symbols(files, known)` returns (declared, consulted) of some files (path, hash, ...), given the known symbols (symbol,
shape); `outputs(files, known)` returns the other tables. Symbols that feed back on themselves without end raise an
error after ROUNDS rounds. Files without a symbol clear their rows; a symbol that several files declare counts once,
with its largest shape."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.store import changed_files
from strandline.operators.versions import Commit, Delta, Log
from strandline.plans.runtime import Replaced, cut

ROUNDS = 1000
#: Both sides of these joins grow with the files, and files of a table say too little of its rows to send one through the driver.
MERGE = "merge"
DECLARED, CONSULTED = "path string, symbol string, shape string", "path string, symbol string, hit boolean"


@dataclass
class Rebuild:
    """What a rebuild did: the commit (None if nothing changed), the files touched (path, status, round), and how many
    rounds it took. status: new, changed, deleted, or affected by a symbol that differs from the last rebuild's; files that
    were read only for a shape that a later round took back are not touched. round: the last one that read the file."""

    commit: Commit | None
    touched: DataFrame
    rounds: int


def known_symbols(declared: DataFrame) -> DataFrame:
    return declared.groupBy("symbol").agg(F.max("shape").alias("shape"))


def dependents(consulted: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path) of the files that have looked one of the symbols up, found or not."""
    return consulted.join(symbols.select("symbol").distinct().hint(MERGE), "symbol", "left_semi").select("path").distinct()


def changed_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """(symbol) of what came, went or has another shape, from known symbols before and after."""
    both = old.select("symbol", F.col("shape").alias("was"), F.lit(True).alias("had")).join(new.select("symbol", F.col("shape").alias("now"), F.lit(True).alias("has")).hint(MERGE), "symbol", "full")
    return both.where(F.col("had").isNull() | F.col("has").isNull() | ~F.col("was").eqNullSafe(F.col("now"))).select("symbol")


def replaced(table: DataFrame, paths: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """A table with the rows of some files taken out, and with new ones."""
    left = table.join(paths.select("path").hint(MERGE), "path", "left_anti").select(*table.columns)
    return left if rows is None else left.unionByName(rows.select(*table.columns))


def rebuild(log: Log, seen: DataFrame, symbols: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], outputs: Callable[[DataFrame, DataFrame], dict[str, DataFrame]]) -> Rebuild:
    """Bring the log up to date with the files (path, hash, ...) seen now; all files not among them are gone."""
    spark, version = log.spark, log.version()
    stored = (lambda name, schema: log.read(name, version)) if version else (lambda name, schema: spark.createDataFrame([], schema))
    old_files = stored("files", "path string, hash string")
    status = cut(changed_files(old_files, seen))
    if status.isEmpty():
        return Rebuild(None, status.withColumn("round", F.lit(0)), 0)
    declared_of, consulted_of, touched_of = Replaced(), Replaced(), Replaced()
    # what deleted files declared is unknown at once, and is compared in the first round
    gone = status.where("status = 'deleted'").select("path")
    before = cut(stored("declared", DECLARED))
    declared, _ = declared_of(replaced(before, gone))
    consulted, _ = consulted_of(replaced(stored("consulted", CONSULTED), gone))
    frontier, n = status.where("status <> 'deleted'").select("path"), 1
    touched, _ = touched_of(status.select("path", F.lit(0).alias("round")))
    rounds = 0
    while n:
        if rounds == ROUNDS:
            raise RuntimeError(f"symbols still change after {ROUNDS} rounds")
        files = seen.join(frontier.hint(MERGE), "path", "left_semi")
        made, looked = (cut(t) for t in symbols(files, known_symbols(declared)))
        # only symbols that the frontier (at first also the deleted files) declared or declares can have changed
        own = (frontier.unionByName(gone) if not rounds else frontier).distinct()
        base = before if not rounds else declared
        maybe = base.join(own.hint(MERGE), "path", "left_semi").select("symbol").unionByName(made.select("symbol")).distinct()
        after = cut(replaced(declared, frontier, made))
        differ = cut(changed_symbols(known_symbols(base.join(maybe.hint(MERGE), "symbol", "left_semi")), known_symbols(after.join(maybe.hint(MERGE), "symbol", "left_semi"))))
        consulted, _ = consulted_of(replaced(consulted, frontier, looked))
        declared, _ = declared_of(after)
        rounds += 1
        frontier = cut(dependents(consulted, differ))
        n = frontier.count()
        touched, _ = touched_of(touched.unionByName(frontier.withColumn("round", F.lit(rounds))).groupBy("path").agg(F.max("round").alias("round")))
    # a file may be read for a shape that a later round takes back; it is touched if one that it had looked up differs in the end
    net = dependents(stored("consulted", CONSULTED), changed_symbols(known_symbols(before), known_symbols(declared))).join(status.hint(MERGE), "path", "left_anti")
    settled = status.select("path", "status").unionByName(net.withColumn("status", F.lit("affected")))
    named = cut(touched.join(settled.hint(MERGE), "path").select("path", "status", "round"))
    paths = named.select("path")
    fresh = {"files": seen.join(status.where("status <> 'deleted'").hint(MERGE), "path", "left_semi").select("path", "hash"), "declared": declared.join(paths.hint(MERGE), "path", "left_semi"), "consulted": consulted.join(paths.hint(MERGE), "path", "left_semi").distinct()}
    fresh |= outputs(seen.join(paths.hint(MERGE), "path", "left_semi"), known_symbols(declared))

    def deltas(at: int) -> dict[str, Delta]:
        there = log.tables(at) if at else []
        out = {}
        for name, rows in fresh.items():
            moved = status.select("path") if name == "files" else paths
            out[name] = Delta(rows, log.without(name, moved, ["path"], at).remove if name in there else None)
        return out

    return Rebuild(log.commit(deltas(version), version, kind="rebuild", rounds=rounds), named, rounds)


def stale(stored: DataFrame, surviving: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, key) of nodes that files which were read again no longer have."""
    return stored.join(paths.select("path"), "path", "left_semi").join(surviving, ["path", "key"], "left_anti").select("path", "key")
