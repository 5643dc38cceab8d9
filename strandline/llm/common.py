"""Shared helpers: table access, shared-folder materialisation, Arrow text handling."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Text bytes that one vectorised step works on; a longer single text is a step of its own.
CHUNK_BYTES = 4 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset (local tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="strandline-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of this application's tables, which goes as a whole when nothing reads them."""
    return f"{shared_dir(spark)}/strandline/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a cut lineage that outlives executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table of fresh_path() once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch with at most `limit` text bytes, one row at least."""
    n = batch.num_rows
    if n == 0:
        return
    _, off = text_bytes(batch.column(column))
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and int64 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def append_columns(df: DataFrame, column: str, added: list[StructField], make: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """df with columns computed from one text column by a vectorised function, all else passed through.

    `make` gets a string array of bounded bytes and returns an array for each added field."""
    schema = StructType([*df.schema.fields, *added])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, column):
                yield pa.RecordBatch.from_arrays([*part.columns, *make(part.column(column))], names=names)

    return df.mapInArrow(run, schema)


def by_group(df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.Table], schema: str, bundle: int = 1) -> DataFrame:
    """work() for every group of rows with equal whole-number keys. Rows are dealt and sorted by the keys, and
    groups are cut from the stream, so that a small one costs little; a task holds one group at a time, or with
    `bundle`, small whole groups of together about so many rows (starts_of() tells them apart)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # whole groups, and the beginning of the last one
        rows = 0

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                yield from work(pa.Table.from_batches(held)).to_batches()
                held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = [*starts_of(batch, keys).tolist(), batch.num_rows]
            if held and all(held[-1].column(k)[-1] == batch.column(k)[0] for k in keys):
                cuts = cuts[1:]  # the last group goes on
                held.append(batch.slice(0, cuts[0]))
                rows += cuts[0]
            begin = cuts[0]
            for a, b in zip(cuts, cuts[1:]):
                if rows + a - begin >= bundle or rows + b - begin > 2 * bundle:
                    if a > begin:
                        held.append(batch.slice(begin, a - begin))
                    yield from done()
                    begin, rows = a, 0
            if batch.num_rows > begin:
                held.append(batch.slice(begin))
                rows += batch.num_rows - begin
        yield from done()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def starts_of(rows: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """The first row of every run of equal whole-number keys."""
    differ = np.zeros(rows.num_rows, bool)
    differ[:1] = True
    for k in keys:
        key = np.asarray(rows.column(k))
        differ[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(differ)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def held_out(doc_id: str = "doc_id"):
    """Whether the remainder of crc32(doc_id as text) by 5 is 0: rows that no model learns from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def segment_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of rows off[i]:off[i+1] along the first axis; 0 for empty segments."""
    out = np.zeros((len(off) - 1, *values.shape[1:]), values.dtype if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(off[1:] > off[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, off[full], axis=0, dtype=out.dtype)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (constants of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
