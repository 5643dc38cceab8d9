"""Tables of a graph as snapshots: upserts, deletes, diffs, and a folder of versions with an atomic pointer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of `new` replace those of `old` with the same key, nulls included; of several new rows for a key
    the one with the largest `order` stays."""
    if order is not None:
        last = Window.partitionBy(key).orderBy(F.desc(order), *[F.desc(c) for c in new.columns if c not in (key, order)])
        new = new.withColumn("r", F.row_number().over(last)).where("r = 1").drop("r", order)
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def insert_edges(old: DataFrame, new: DataFrame, place: tuple[str, ...] = ("file", "line"), identity: tuple[str, ...] = ("type", "from_key", "to_key")) -> DataFrame:
    """Edges are one by identity and place; a null in the place makes every row its own. New values win."""
    placed = F.lit(True)
    for c in place:
        placed = placed & F.col(c).isNotNull()
    keys = [*identity, *place]
    fresh = new.where(placed)
    last = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("confidence"), F.desc_nulls_last("resolution"))
    fresh = fresh.withColumn("r", F.row_number().over(last)).where("r = 1").drop("r")
    kept = old.where(placed).join(fresh.select(*keys), keys, "left_anti")
    return kept.unionByName(fresh).unionByName(old.where(~placed)).unionByName(new.where(~placed))


def known_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are nodes; the others are dropped without a word."""
    key = nodes.select("key")
    return edges.join(key.withColumnRenamed("key", "from_key"), "from_key", "left_semi").join(key.withColumnRenamed("key", "to_key"), "to_key", "left_semi")


def upsert_warnings(old: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """(warning, first_seen, last_seen): a warning that is seen again keeps its first time."""
    fresh = seen.select("warning").distinct().withColumn("now", now)
    return old.join(fresh, "warning", "full").select("warning", F.coalesce("first_seen", "now").alias("first_seen"), F.coalesce("now", "last_seen").alias("last_seen"))


def merge_meta(old: Column, new: Column) -> Column:
    """A shallow merge of two maps; the right one wins."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(old, empty), F.coalesce(new, empty), lambda k, x, y: F.coalesce(y, x))


def without_key(meta: Column, key: str) -> Column:
    """A map less one key; null when nothing is left."""
    rest = F.map_filter(meta, lambda k, v: k != key)
    return F.when(F.size(rest) > 0, rest)


def delete_files(files: DataFrame, nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stays of files, nodes and edges when the files `gone` (path) go, with their nodes and these' edges."""
    left = nodes.join(gone.withColumnRenamed("path", "file"), "file", "left_anti")
    stays = known_ends(edges.join(gone.withColumnRenamed("path", "file"), "file", "left_anti") if "file" in edges.columns else edges, left)
    return files.join(gone, "path", "left_anti"), left, stays


def changed_files(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """(path, status): new, changed by content hash (a null one is a value like others), or deleted."""
    both = seen.select("path", F.col("hash").alias("now"), F.lit(True).alias("is")).join(stored.select("path", F.col("hash").alias("was"), F.lit(True).alias("had")), "path", "full")
    status = F.when(F.col("had").isNull(), "new").when(F.col("is").isNull(), "deleted").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return both.select("path", status.alias("status")).where("status is not null")


def affected_files(deps: DataFrame, symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """Files that depend (path, symbol) on one of the symbols, less those changed themselves."""
    return deps.join(symbols.select("symbol"), "symbol", "left_semi").select("path").distinct().join(changed.select("path"), "path", "left_anti")


class Snapshots:
    """Versions of a set of tables in a folder. A writer claims a number by creating an empty file CLAIM-n, which
    fails where it exists; it writes the folder v=n whole, and then creates the empty file CURRENT-n-schema. The
    largest n of these counts and none is ever changed or removed, so at every moment readers see the old version or
    the new one, and a writer that breaks off leaves nothing that is read. Paths go through Hadoop's file system,
    local or not."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, mark: str) -> list[tuple[int, ...]]:
        found = self._fs.globStatus(self._path(f"{self.root}/{mark}-*"))
        return sorted(tuple(map(int, x.getPath().getName().split("-")[1:])) for x in found or ())

    def _create(self, name: str) -> None:
        self._fs.create(self._path(f"{self.root}/{name}"), False).close()

    def version(self) -> int:
        """The number of the current version; 0 before the first, or after a change of the schema version."""
        n, schema = (self._numbers("CURRENT") or [(0, SCHEMA_VERSION)])[-1]
        return n if schema == SCHEMA_VERSION else 0

    def read(self, name: str) -> DataFrame:
        if not (n := self.version()):
            raise FileNotFoundError(f"no version of schema {SCHEMA_VERSION} in {self.root}")
        return self.spark.read.parquet(f"{self.root}/v={n}/{name}")

    def write(self, tables: dict[str, DataFrame]) -> int:
        n = 1 + max((x[0] for mark in ("CLAIM", "CURRENT") for x in self._numbers(mark)), default=0)
        self._create(f"CLAIM-{n}")
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/v={n}/{name}")
        self._create(f"CURRENT-{n}-{SCHEMA_VERSION}")
        return n


def export_rows(rows: DataFrame, folder: str, now: Column) -> DataFrame:
    """Append rows without exported_at to a folder of JSON lines; returns all rows with theirs stamped."""
    rows.where("exported_at is null").drop("exported_at").write.mode("append").json(folder)
    return rows.withColumn("exported_at", F.coalesce("exported_at", now))
