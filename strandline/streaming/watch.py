"""Incremental file tables as a stream: every micro-batch of file rows is one delta of the stored table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.operators.versions import Log


def follow(files: DataFrame, log: Log, checkpoint: str, on_change: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Start a query over a stream of (path, hash, seen): the last row of a path in a batch counts. Only files whose
    hash is new are handed to `on_change` and written, whatever the size of the table; a batch that runs again finds
    nothing changed, and makes no version."""

    def step(batch: DataFrame, number: int) -> None:
        new = batch.groupBy("path").agg(F.max_by("hash", F.struct("seen", "hash")).alias("hash"))

        def deltas(at: int) -> dict:
            return {"files": log.put("files", new, ["path"], at)}

        changed = deltas(log.version())["files"].add.select("path").persist()
        try:
            if not changed.isEmpty():
                if on_change is not None:
                    on_change(changed, number)
                log.change(deltas, batch=number)
        finally:
            changed.unpersist()

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
