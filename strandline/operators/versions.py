"""A set of tables as a log of deltas: what a version adds and removes, on top of a base.

Every row gets an identity when it is added: the number of its version and a number within it. A commit writes the
rows that it adds and the identities of those that it removes to new folders, and then a record of them, which is moved
into the log under the number after the version that the writer has read. The move fails if that number exists, so of
two writers that start from one version one gets a Conflict and nothing of its own is read; a writer that breaks off
leaves folders that no record names. Records and folders are never changed, so a reader keeps the version it opened.

    log/00000007.json   {"schema": 1, "base": false, "tables": {"edges": {"added": [path, rows], "removed": [path, rows]}}, ...}

A table is read as the rows added since the last base less the identities removed since: one anti-join, none where
nothing was removed. compact() writes a new base. Row numbers of a commit are counted while its rows are written. Rows
need no key: equal rows are kept apart, and a key with a null in it never equals another."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
#: Identity of a row: the version that added it, and its number there.
IDENTITY = ("_version", "_number")


class Conflict(RuntimeError):
    """Another writer has followed the same version first."""


@dataclass
class Delta:
    """What a commit does to a table: rows to add, and rows to remove as they were read with identities."""

    add: DataFrame | None = None
    remove: DataFrame | None = None


@dataclass
class Commit:
    version: int
    rows: dict[str, tuple[int, int]] = field(default_factory=dict)  # added, removed, by table


class Log:
    """The tables in a folder that all executors share. Paths go through Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str, schema: int = SCHEMA_VERSION):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # the log

    def _record(self, n: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/log/{n:08}.json"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _publish(self, n: int, record: dict) -> None:
        fs = self._jvm.org.apache.hadoop.fs
        draft = self._path(f"{self.root}/draft/{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(record).encode()))
        stream.close()
        self._fs.mkdirs(self._path(f"{self.root}/log"))
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.java.lang.Enum.valueOf(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), "NONE")
        root = self._path(self.root).makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory())
        try:
            fs.FileContext.getFileContext(root.toUri(), self._conf).rename(draft, self._path(f"{self.root}/log/{n:08}.json"), options)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {n} of {self.root} is another writer's") from None
            raise

    def latest(self) -> int:
        """The largest number in the log, whatever its schema."""
        found = self._fs.globStatus(self._path(f"{self.root}/log/*.json")) or ()
        return max((int(x.getPath().getName().split(".")[0]) for x in found), default=0)

    def version(self) -> int:
        """The current version; 0 before the first, or if it has another schema version: then all begins anew."""
        n = self.latest()
        return n if n and self._record(n)["schema"] == self.schema else 0

    def _since_base(self, version: int) -> list[tuple[int, dict]]:
        out = []
        while version > 0:
            record = self._record(version)
            if record["schema"] != self.schema:
                break
            out.append((version, record))
            if record["base"]:
                break
            version -= 1
        return out[::-1]

    # reading

    def tables(self, version: int | None = None) -> list[str]:
        return sorted({name for _, r in self._since_base(self.version() if version is None else version) for name in r["tables"]})

    def _rows(self, folders: list[str]) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.spark.read.parquet(x) for x in folders])

    def rows(self, name: str, version: int | None = None) -> DataFrame:
        """The table with the identities of its rows."""
        records = self._since_base(self.version() if version is None else version)
        parts = [r["tables"][name] for _, r in records if name in r["tables"]]
        added, removed = ([p[k][0] for p in parts if p.get(k)] for k in ("added", "removed"))
        if not added:
            raise FileNotFoundError(f"no table {name} in {self.root}")
        found = self._rows(added)
        return found.join(self._rows(removed).hint("merge"), list(IDENTITY), "left_anti").select(*found.columns) if removed else found

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.rows(name, version).drop(*IDENTITY)

    def changes(self, name: str, since: int, until: int | None = None) -> DataFrame:
        """What the versions after `since` up to `until` changed: the rows with a column `change`, added or removed. Rows
        that came and went between are in neither; a compaction changes nothing."""
        until = self.version() if until is None else until
        old = self.rows(name, since) if name in self.tables(since) else None
        new = self.rows(name, until)
        mark = lambda df, word: df.drop(*IDENTITY).withColumn("change", F.lit(word))
        if old is None:
            return mark(new, "added")
        gone, come = old.join(new.select(*IDENTITY), list(IDENTITY), "left_anti"), new.join(old.select(*IDENTITY), list(IDENTITY), "left_anti")
        return mark(come, "added").unionByName(mark(gone, "removed"), allowMissingColumns=True)

    # writing

    def _write(self, df: DataFrame, path: str) -> int:
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        return seen.get["n"]

    def commit(self, deltas: dict[str, Delta], after: int | None = None, compacted: bool = False, **note) -> Commit:
        """Write deltas as the version after `after` (the current one). `note` goes into the record."""
        last = self.latest()
        after = last if after is None or (after == 0 and last and not self.version()) else after
        n, folder, tables, rows = after + 1, f"{self.root}/data/{uuid.uuid4().hex}", {}, {}
        for name, delta in deltas.items():
            entry: dict = {}
            if delta.add is not None:
                own = delta.add if compacted else delta.add.drop(*IDENTITY).withColumn("_version", F.lit(n)).withColumn("_number", F.monotonically_increasing_id())
                entry["added"] = [f"{folder}/{name}-added", self._write(own, f"{folder}/{name}-added")]
            if delta.remove is not None:
                entry["removed"] = [f"{folder}/{name}-removed", self._write(delta.remove.select(*IDENTITY).distinct(), f"{folder}/{name}-removed")]
            tables[name] = entry
            rows[name] = tuple(entry.get(k, (None, 0))[1] for k in ("added", "removed"))
        first = not self._since_base(after)
        self._publish(n, {"schema": self.schema, "base": compacted or first, "tables": tables, "note": note})
        return Commit(n, rows)

    def change(self, work: Callable[[int], dict[str, Delta]], tries: int = 5, **note) -> Commit:
        """Commit work(version), worked out anew from the newer version after each conflict."""
        for left in range(tries, 0, -1):
            version = self.version()
            try:
                return self.commit(work(version), version, **note)
            except Conflict:
                if left == 1:
                    raise
        raise AssertionError

    def compact(self) -> Commit:
        """All tables as they are, as the base that later readers start from. Rows keep their identities."""
        version = self.version()
        return self.commit({name: Delta(self.rows(name, version)) for name in self.tables(version)}, version, compacted=True)

    def history(self, last: int | None = None) -> DataFrame:
        """(version, table, added, removed) of the versions since the last base, the newest `last` of them."""
        records = [(n, name, *(p.get(k, (None, 0))[1] for k in ("added", "removed"))) for n, r in self._since_base(self.version())[-(last or 0) :] for name, p in r["tables"].items()]
        return self.spark.createDataFrame(records, "version int, table string, added long, removed long")

    # deltas

    def put(self, name: str, new: DataFrame, keys: list[str], version: int) -> Delta:
        """Rows that replace those with the same keys. Rows that are stored as they are already are not written again; of
        several new rows with a key the largest one counts. A row with a null among its keys replaces nothing."""
        whole = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
        rest = [c for c in new.columns if c not in keys]
        fresh = new.where(whole).groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_rest")).select(*keys, *[F.col("_rest")[c].alias(c) for c in rest]) if rest else new.where(whole).distinct()
        fresh, loose = fresh.select(*new.columns), new.where(~whole)
        if not version or name not in self.tables(version):
            return Delta(fresh.unionByName(loose))
        old = self.rows(name, version).select(*new.columns, *IDENTITY)
        had = old.select(*keys, *IDENTITY, *[F.col(c).alias(f"_old_{c}") for c in rest])
        pairs = fresh.join(had, keys, "left")
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in rest], F.col("_version").isNotNull())
        # where a key has several old rows, all go and the new one comes, unless the only one is equal
        grouped = pairs.withColumn("_same", same).groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_rest") if rest else F.lit(1).alias("_rest"), F.every("_same").alias("_all"), F.collect_list(F.when(F.col("_version").isNotNull(), F.struct(*IDENTITY))).alias("_ids"))
        grouped = grouped.where(~(F.col("_all") & (F.size("_ids") == 1)))
        come = grouped.select(*keys, *[F.col("_rest")[c].alias(c) for c in rest]).select(*new.columns)
        gone = grouped.select(F.explode("_ids").alias("i")).select("i.*")
        return Delta(come.unionByName(loose), gone)

    def without(self, name: str, some: DataFrame, on: list[str], version: int) -> Delta:
        """The rows of a table that match rows of `some` in the columns `on`, to be removed."""
        return Delta(remove=self.rows(name, version).join(some.select(*on).distinct().hint("merge"), on, "left_semi"))
