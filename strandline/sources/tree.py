"""Source trees as tables: discovery, language tags, exclusions, content hashes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.keys import language

#: Folders of a project that are never read.
EXCLUDED = ("vendor", "node_modules", "storage", "bootstrap/cache", ".git")


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression; * and ? cross folder borders."""
    parts = {"*": ".*", "?": "."}
    return "^" + "".join(parts.get(c, re.escape(c)) for c in glob) + "$"


def select_files(files: DataFrame, project: bool = True, globs: tuple[str, ...] = ()) -> DataFrame:
    """Files (path relative, content) of a known language outside excluded folders (of projects only) and globs,
    with lang, is_project, size and hash."""
    path = F.col("path")
    rows = files.withColumn("lang", language(path)).where("lang is not null")
    if project:
        for d in EXCLUDED:
            rows = rows.where(~(path.startswith(d + "/") | path.contains(f"/{d}/")))
    for g in globs:
        rows = rows.where(~path.rlike(glob_pattern(g)))
    return rows.withColumns({"is_project": F.lit(project), "size": F.octet_length("content").cast("long"), "hash": F.sha2(F.col("content").cast("binary"), 256)})


def read_tree(spark: SparkSession, root: str, project: bool = True, globs: tuple[str, ...] = ()) -> DataFrame:
    """All files below a folder, in any store that Spark reads."""
    bare = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*(?=/)", ""), "^" + re.escape(re.sub("^[a-z]+:/*(?=/)", "", bare)) + "/", "")
    return select_files(found.select(name.alias("path"), F.decode("content", "UTF-8").alias("content")), project, globs)
