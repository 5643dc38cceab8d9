"""Parts of a stored graph that are replaced or read as one: routes, bindings, a section's concepts, a file's rows, and
the symbols of all files that are not read again.

Routes and bindings belong to no file: each build knows all of them, so the stored ones go as a whole and the new ones
come in the same commit. Deltas are for Log.change: each function gets the version that it works on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.versions import Delta, Log

#: Types of nodes and edges by what they come from.
ROUTE_NODES, ROUTE_EDGES, BINDING_EDGES, CONCEPT_EDGES = ("route", "middleware"), ("routes_to", "uses_middleware"), ("binds",), ("mentions", "relates_concept")


def _of_types(log: Log, at: int, name: str, types: tuple[str, ...]) -> DataFrame | None:
    return log.rows(name, at).where(F.col("type").isin(*types)) if at and name in log.tables(at) else None


def replace_routes(log: Log, at: int, nodes: DataFrame, edges: DataFrame) -> dict[str, Delta]:
    """All routes and middleware with their edges, in place of those that are stored. Rows of other types raise nothing
    and replace nothing: they are added."""
    return {"nodes": Delta(nodes, _of_types(log, at, "nodes", ROUTE_NODES)), "edges": Delta(edges, _of_types(log, at, "edges", ROUTE_EDGES))}


def replace_bindings(log: Log, at: int, edges: DataFrame) -> dict[str, Delta]:
    return {"edges": Delta(edges, _of_types(log, at, "edges", BINDING_EDGES))}


def replace_concepts(log: Log, at: int, sections: DataFrame, edges: DataFrame | None = None) -> dict[str, Delta]:
    """The concept edges of sections (file, line) go, new ones come. Edges without a place belong to no section."""
    old = _of_types(log, at, "edges", CONCEPT_EDGES)
    gone = None if old is None else old.join(sections.select("file", "line").distinct(), ["file", "line"], "left_semi")
    return {"edges": Delta(edges, gone)}


def append_unresolved(log: Log, at: int, rows: DataFrame) -> dict[str, Delta]:
    """Unresolved references (path, ...) as they are, repeated ones too. A path that is no stored file raises KeyError."""
    strange = rows.select("path").join(log.read("files", at).select("path"), "path", "left_anti").first()
    if strange is not None:
        raise KeyError(strange.path)
    return {"unresolved": Delta(rows)}


def stored_files(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of the files (path, ...) that are asked for."""
    return files.join(paths.select("path").distinct(), "path", "left_semi")


def keys_of(nodes: DataFrame, file: str) -> DataFrame:
    """(key) of the nodes of one file."""
    return nodes.where(F.col("file") == file).select("key")


def hydrate(nodes: DataFrame, without: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (the nodes' columns) and methods (class_key, key, name) of all files but those in `without` (path), as they
    are stored, with nothing read again. A method belongs to the class before the last "::" of its key, and is left
    out with it. Nodes without a file are left out as soon as any file is."""
    some = nodes.where("type in ('class', 'method')")
    if not without.isEmpty():
        some = some.where("file is not null").join(without.select(F.col("path").alias("file")), "file", "left_anti").select(*nodes.columns)
    classes = some.where("type = 'class'")
    owner = F.regexp_replace("key", r"(?s)^method:(.*)::.*$", "class:$1")
    methods = some.where("type = 'method'").select(owner.alias("class_key"), "key", "name")
    return classes, methods.join(classes.select(F.col("key").alias("class_key")), "class_key", "left_semi")
