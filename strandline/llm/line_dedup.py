"""Lines that many documents share, kept in one document only.

A line's key is the line without white space (space, tab to carriage return) at its ends, A-Z in lower case. Keys of
MIN_POINTS code points or more that MIN_DOCS documents hold lose all their lines, except in the largest doc_id.

1. Lines are counted, which gives the size of the filters: BITS_PER_LINE bits a long line, MAX_BITS at most. Beyond
   that more lines are suspected than need be, and the result stays the same.
2. Each task reads its documents once and fills two Bloom filters with its keys' hashes: seen once, seen twice. Filters
   travel as compressed segments and are united segment by segment; what two tasks saw once each was seen twice.
3. Only lines in the united twice-seen filter are suspects. Their keys, whole, are grouped with the documents that
   hold them, which confirms the repeats and gives their last document. No other line is shuffled.
4. Documents are joined by doc_id with the digests of the keys that they lose, and cut in a map.

A row without a doc_id is no document: it is not counted and keeps its lines. Rows that repeat a doc_id are one
document when keys are counted, and each is returned. A null or empty text is one empty line. All lines may go,
which leaves an empty text. Null keys do not occur; an empty table gives an empty one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from strandline.llm.common import free_name, materialize

MIN_POINTS, MIN_DOCS = 40, 5
BITS_PER_LINE, HASHES = 16, 2
#: Both filters have so many bits at most (64 MB each), and this many at least.
MAX_BITS, MIN_BITS = 1 << 29, 1 << 16
#: Bits of a segment: what one row of a filter table holds.
SEGMENT = 1 << 19
#: Tasks that fill filters, for each core: a task of them reads several partitions, so that few filters travel.
TASKS_PER_CORE = 4
#: Parts that a repeated key's documents are dealt over.
PARTS = 32
BLANK = b" \t\n\x0b\x0c\r"


def long_keys(text: str | None, least: int = MIN_POINTS) -> list[bytes]:
    """The keys of a text's lines; b"" for those below `least` code points."""
    out = []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip(BLANK).lower()  # of bytes: A-Z only
        out.append(key if len(key) >= least and (key.isascii() or len(key.decode()) >= least) else b"")
    return out


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The HASHES bit numbers of each hash; bits is a power of 2."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(hashes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(HASHES)]).astype(np.int64)


class Filters:
    """Two Bloom filters as packed bits: hashes seen, and hashes seen twice."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = np.zeros(bits >> 3, np.uint8), np.zeros(bits >> 3, np.uint8)

    @staticmethod
    def has(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool).all(0)

    @staticmethod
    def put(packed: np.ndarray, at: np.ndarray) -> None:
        np.bitwise_or.at(packed, (at >> 3).ravel(), (1 << (at & 7)).astype(np.uint8).ravel())

    def add(self, hashes: np.ndarray) -> None:
        """Hashes of some documents, each once for every document."""
        some, count = np.unique(hashes, return_counts=True)
        at = places(some, self.bits)
        self.put(self.twice, at[:, (count > 1) | self.has(self.once, at)])
        self.put(self.once, at)


def _fill(bits: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = Filters(bits)
        for batch in batches:
            found = [xxhash.xxh3_64_intdigest(k) for i, text in zip(batch.column("doc_id"), batch.column("text")) if i.is_valid for k in set(long_keys(text.as_py(), least)) if k]
            if found:
                filters.add(np.array(found, np.uint64))
        size = min(bits, SEGMENT) >> 3
        for i in range(0, bits >> 3, size):
            once, twice = filters.once[i : i + size], filters.twice[i : i + size]
            if once.any():
                packed = [pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True)], pa.binary()) for x in (once, twice)]
                yield pa.RecordBatch.from_arrays([pa.array([i // size], pa.int32()), *packed], names=["segment", "once", "twice"])

    return run


def _unite(size: int):
    """Segments in order of their number: one is held at a time, whatever the number of tasks that filled it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, once, twice = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if number is not None and twice.any():
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([pa.compress(twice.tobytes(), "zstd", asbytes=True)], pa.binary())], names=["segment", "twice"])

        for batch in batches:
            for row in batch.to_pylist():
                a, b = (np.frombuffer(pa.decompress(row[k], size, "zstd", asbytes=True), np.uint8) for k in ("once", "twice"))
                if row["segment"] != number:
                    yield from done()
                    number, once, twice = row["segment"], a.copy(), b.copy()
                else:
                    twice |= b | (once & a)
                    once |= a
        yield from done()

    return run


def twice_seen(docs: DataFrame, least: int = MIN_POINTS, max_bits: int = MAX_BITS) -> np.ndarray:
    """The packed bits of the filter of keys that two documents (or rows) hold: no more than max_bits."""
    lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.octet_length(x) >= least))
    total = docs.agg(F.sum(lines)).first()[0] or 0
    bits = MIN_BITS
    while bits < min(max_bits, total * BITS_PER_LINE):
        bits *= 2
    spark = docs.sparkSession
    tasks = max(1, TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    filled = docs.select("doc_id", "text").coalesce(tasks).mapInArrow(_fill(bits, least), "segment int, once binary, twice binary")
    size = min(bits, SEGMENT) >> 3
    united = filled.repartition("segment").sortWithinPartitions("segment").mapInArrow(_unite(size), "segment int, twice binary")
    out = np.zeros(bits >> 3, np.uint8)
    for row in united.toLocalIterator():
        out[row.segment * size : (row.segment + 1) * size] = np.frombuffer(pa.decompress(bytes(row.twice), size, "zstd", asbytes=True), np.uint8)
    return out


def _suspects(known: Broadcast, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = known.value
        for batch in batches:
            keys, owner = [], []
            for i, (doc, text) in enumerate(zip(batch.column("doc_id"), batch.column("text"))):
                if doc.is_valid:
                    own = set(long_keys(text.as_py(), least)) - {b""}
                    keys += own
                    owner += [i] * len(own)
            if not keys:
                continue
            at = places(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64), len(packed) << 3)
            for some in np.array_split(hit := np.flatnonzero(Filters.has(packed, at)), max(1, len(hit) // 4096)):
                if len(some):
                    found = [keys[i] for i in some]
                    digests = [xxhash.xxh3_128_digest(k) for k in found]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array([owner[i] for i in some])).cast(pa.int64()), pa.array(digests, pa.binary()), pa.array([k.decode() for k in found], pa.string())], names=["doc_id", "digest", "key"]
                    )

    return run


def repeats(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS, max_bits: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """(key, digest, n_docs, last) of every repeated key, and all suspects (doc_id, digest, key)."""
    known = docs.sparkSession.sparkContext.broadcast(twice_seen(docs, min_points, max_bits))
    suspects = materialize(docs.select("doc_id", "text").mapInArrow(_suspects(known, min_points), "doc_id long, digest binary, key string"), "suspects")
    held = suspects.groupBy("key", "digest", "doc_id").agg(F.lit(1).alias("one"))
    found = held.groupBy("key", "digest").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last")).where(F.col("n_docs") >= min_docs)
    return found, suspects


def _cut(least: int, gone: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, dropped = [], [], []
            for text, lost in zip(batch.column("text"), batch.column(gone)):
                text, lost = text.as_py() or "", lost.as_py()
                lines = text.split("\n")
                total.append(len(lines))
                if lost:
                    lost = set(lost)
                    lines = [x for x, k in zip(lines, long_keys(text, least)) if not k or xxhash.xxh3_128_digest(k) not in lost]
                    text = "\n".join(lines)
                kept.append(text)
                dropped.append(total[-1] - len(lines))
            columns = [c for c, name in zip(batch.columns, batch.schema.names) if name != gone]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=names)

    return run


def dedup_lines(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS, max_bits: int = MAX_BITS) -> tuple[DataFrame, tuple[str, str, str]]:
    """All columns of docs with the number of lines, the number dropped, and the text that stays; returns the new
    columns' names too, which docs does not have."""
    found, suspects = repeats(docs, min_points, min_docs, max_bits)
    parts = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")
    dealt = found.select("digest", "last", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    lost = suspects.select("doc_id", "digest", parts.alias("part")).join(dealt, ["digest", "part"]).where("doc_id <> last")
    gone = free_name(docs, "gone")
    lost = lost.groupBy("doc_id").agg(F.collect_set("digest").alias(gone)).withColumnRenamed("doc_id", owner := free_name(docs, "owner"))
    names = [free_name(docs, n) for n in ("n_lines", "n_dropped", "kept_text")]
    schema = StructType([*docs.schema.fields, *[StructField(n, t) for n, t in zip(names, (LongType(), LongType(), StringType()))]])
    joined = docs.join(lost.hint("shuffle_hash"), F.col("doc_id") == F.col(owner), "left").drop(owner)
    return joined.mapInArrow(_cut(min_points, gone, schema.names), schema), tuple(names)
