"""What a log of versions keeps beside the graph: builds, values, misses and warnings, and their export."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.versions import Commit, Conflict, Delta, Log
from strandline.plans.runtime import exists

BUILD = "id int, kind string, started double, seconds double, new_nodes long, changed_nodes long, edges long, unresolved long"
EXPORT = "name string, batch int, since int, upto int"


def record(log: Log, kind: str, work: Callable[[int], dict[str, Delta]], started: float, clock: Callable[[], float]) -> Commit:
    """Commit a build's deltas, and then its row. Its numbers were counted while the deltas were written: a node with a
    new key is new, one that replaces another is changed; edges and unresolved references are those that were written."""
    done = log.change(work, kind=kind)
    added = lambda name: done.rows.get(name, (0, 0))[0]
    replaced = min(done.rows.get("nodes", (0, 0)))
    row = (done.version, kind, started, clock() - started, added("nodes") - replaced, replaced, added("edges"), added("unresolved"))
    log.change(lambda at: {"builds": Delta(log.spark.createDataFrame([row], BUILD))}, kind="report")
    return done


def last(log: Log) -> DataFrame | None:
    """The newest build's row; None before the first."""
    if "builds" not in log.tables():
        return None
    return log.read("builds").agg(F.max_by(F.struct("*"), "id").alias("b")).select("b.*")


def set_values(log: Log, values: dict[str, str | None]) -> Commit:
    rows = log.spark.createDataFrame(list(values.items()), "key string, value string")
    return log.change(lambda at: {"meta": log.put("meta", rows, ["key"], at)})


def value(log: Log, key: str) -> str | None:
    if "meta" not in log.tables():
        return None
    found = log.read("meta").where(F.col("key") == key).first()
    return found.value if found else None


def clear_types(log: Log, at: int, node_types: list[str], edge_types: list[str]) -> dict[str, Delta]:
    """Deltas that take out all nodes and edges of some types, as before routes or bindings are read anew."""
    some = lambda name, types: Delta(remove=log.rows(name, at).where(F.col("type").isin(types)))
    return {"nodes": some("nodes", node_types), "edges": some("edges", edge_types)}


# export: each row once, whatever breaks off


def _batches(log: Log, name: str) -> list:
    if "exports" not in log.tables():
        return []
    return log.read("exports").where(F.col("name") == name).orderBy("batch").collect()


def waiting(log: Log, name: str) -> DataFrame:
    """Rows of a table that no batch has claimed."""
    claimed = max((b.upto for b in _batches(log, name)), default=0)
    return log.rows(name).where(F.col("_version") > claimed)


def _move(log: Log, draft: str, final: str) -> None:
    if not log._fs.rename(log._path(draft), log._path(final)):
        raise OSError(f"cannot move {draft} to {final}")


def export(log: Log, name: str, folder: str) -> list[int]:
    """Rows of a table as JSON lines in folder/batch=n; returns the batches that were moved into place.

    A batch is claimed first, as a row that names the versions it covers; only one writer's claim succeeds. Its rows
    are then written aside and their folder is moved to its final name. A run that breaks off leaves a claimed batch
    without a folder, which the next run writes from the same versions; what was written aside is never read."""
    while name in log.tables():
        version = log.version()
        batches = _batches(log, name)
        claimed = max((b.upto for b in batches), default=0)
        if log.rows(name, version).where(F.col("_version") > claimed).isEmpty():
            break
        try:
            log.commit({"exports": Delta(log.spark.createDataFrame([(name, len(batches) + 1, claimed, version)], EXPORT))}, version)
            break
        except Conflict:
            continue
    done = []
    for b in _batches(log, name):
        final = f"{folder.rstrip('/')}/batch={b.batch}"
        if not exists(log.spark, final):
            draft = f"{folder.rstrip('/')}/_draft-{uuid.uuid4().hex}"  # readers pass over names that start so
            rows = log.rows(name).where((F.col("_version") > b.since) & (F.col("_version") <= b.upto))
            rows.drop("_version", "_number").write.json(draft)
            _move(log, draft, final)
            done.append(b.batch)
    return done
