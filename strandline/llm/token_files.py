"""Token files: encoded documents as range-coded containers, written and read back by Spark.

Documents are dealt by ranges of doc_id (nulls first) and sorted within; a document's ids are those of the
tokenizers library, followed by one end id. Each task cuts its stream of ids into containers (range_coder.py)
of about CONTAINER ids at document borders. A file is a Parquet file with a row for each container: part and
local_start (number of the task, and ids of that task before the container), doc_ids and counts of its
documents, n_tokens, and payload, the container's bytes with checksums of its head and of every block. A
reader needs no other row, and Spark's commit of files makes retried or lost tasks leave no half-written ones.

Reading needs, besides the rows, only each part's number of ids: one row for each part is summed on the
driver, whose running sums turn local places into global ones.

Null texts count as empty and hold the end id only; repeated doc_ids keep a place each, in an order that their
texts' hash decides; extra columns are not read. A container never splits a document, so it is as large as
the longest document at least."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import range_coder
from strandline.llm.common import chunks, ragged, segment_sums, text_bytes

CONTAINER = 7 << 20
#: Pieces whose ids a worker remembers.
MEMORY = 800_000
#: Text bytes that are encoded at once.
STEP = 4 << 20
#: New pieces that the library gets as one text.
TOGETHER = 100

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32, 0x1C, 0x1D, 0x1E, 0x1F]] = True
_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_ODD = "[\u0085   -     　]"

SCHEMA = "part int, local_start long, doc_ids array<long>, counts array<int>, n_tokens long, payload binary"


@lru_cache(maxsize=2)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel parts
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class PieceEncoder:
    """Ids of whole texts by the library, each distinct piece once.

    A byte-level tokenizer without normaliser always starts a piece at a single blank or line feed between two
    characters that are no white space, behind such a line feed, and at a punctuation mark behind a letter. So
    what stands between two of these places has the same ids wherever it stands. Texts with any other white
    space next to a blank, or with non-ASCII white space, go to the library whole, and so do all texts for a
    tokenizer file of another kind."""

    def __init__(self, path: str):
        self.library = _library(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"] or {}
        self.by_pieces = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
        added = {t["id"]: t for t in spec["added_tokens"]}
        self.by_pieces &= not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in added.values())
        # bytes of every id: a byte-level token has a character for each
        names = {i: len(n) for n, i in self.library.get_vocab(with_added_tokens=False).items()} | {i: len(t["content"].encode()) for i, t in added.items()}
        self.width = np.zeros(1 + max(names), np.int64)
        self.width[list(names)] = list(names.values())
        self.known: dict[str, int] = {}
        self.ids, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int16)

    def separately(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of texts given to the library one by one."""
        found = [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)] if pieces else []
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(size.sum())), size

    def together(self, pieces: list[str], behind: str) -> tuple[np.ndarray, np.ndarray]:
        """separately() for many pieces, TOGETHER at a time as one text, with `behind` (nothing, or a line feed)
        after each one; cut again where the bytes of the ids add up to those of the pieces."""
        texts = [behind.join(pieces[i : i + TOGETHER]) + behind for i in range(0, len(pieces), TOGETHER)]
        ids = [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        if not ids:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        flat = np.concatenate(ids)
        ends = np.cumsum(np.asarray(pc.binary_length(pa.array(pieces, pa.string()))) + len(behind), dtype=np.int64)
        done = np.cumsum(self.width[flat])
        last = np.searchsorted(done, ends)
        if done[-1] != ends[-1] or (done[last] != ends).any() or (behind and (self.width[flat[last]] != 1).any()):
            return self.separately(pieces)  # a piece that the library doesn't end here
        size = np.diff(last + 1, prepend=0)
        if behind:
            flat, size = np.delete(flat, last), size - 1
        return flat, size

    def encode_pieces(self, pieces: list[str], blank: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, sizes) of distinct pieces; blank: those that start with one; line: the line feed."""
        number = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        starts, sizes = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        old = np.flatnonzero(number >= 0)
        starts[old], sizes[old] = self.start[number[old]], self.size[number[old]]
        fresh = number < 0
        sets = [np.flatnonzero(fresh & blank), np.flatnonzero(fresh & ~blank & ~line), np.flatnonzero(fresh & line)]
        names = [[pieces[k] for k in some.tolist()] for some in sets]
        found = [self.together(names[0], ""), self.together(names[1], "\n"), self.separately(names[2])]
        new, size = np.concatenate(sets), np.concatenate([n for _, n in found])
        starts[new], sizes[new] = len(self.ids) + np.cumsum(size) - size, size
        pool = np.concatenate([self.ids, *(ids for ids, _ in found)])
        room = max(0, MEMORY - len(self.known))
        keep = len(new) if len(new) <= room and (size < 1 << 15).all() else 0
        if keep:
            self.known.update(zip(chain(*names), range(len(self.start), len(self.start) + keep)))
            self.ids = pool
            self.start, self.size = np.r_[self.start, starts[new]], np.r_[self.size, size.astype(np.int16)]
        return pool, starts, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text)."""
        if texts.null_count:
            texts = texts.fill_null("")
        if not self.by_pieces:
            return self.separately(texts.to_pylist())
        texts = texts.cast(pa.large_string())
        raw, off = text_bytes(texts)
        space = _SPACE[raw]
        blank = np.flatnonzero(raw == 32)
        last = len(raw) - 1
        bad = (blank == 0) | (blank == last)
        inner = blank[~bad]
        bad[~bad] = space[inner - 1] | space[inner + 1]
        whole = np.zeros(len(off) - 1, bool)
        whole[np.searchsorted(off, blank[bad], side="right") - 1] = True
        edge = np.flatnonzero(off[1:] > off[:-1])
        whole[edge] |= (raw[off[edge]] == 32) | (raw[off[edge + 1] - 1] == 32)
        whole |= np.asarray(pc.match_substring_regex(texts, _ODD))
        odd = np.flatnonzero(whole)
        if len(odd):
            odd_names = texts.take(pa.array(odd)).to_pylist()
            raw, off = text_bytes(pc.if_else(pa.array(whole), "", texts))
            space = _SPACE[raw]
        flat, count = self.by_cuts(raw, off, space)
        if len(odd):
            found, size = self.separately(odd_names)
            ends, stops = np.cumsum(count), np.cumsum(size)
            pieces, before = [], 0
            for k, a, b in zip(odd.tolist(), (stops - size).tolist(), stops.tolist()):
                pieces += [flat[before : ends[k]], found[a:b]]
                before = ends[k]
                count[k] += b - a
            flat = np.concatenate([*pieces, flat[before:]])
        return flat, count

    def by_cuts(self, raw: np.ndarray, off: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """encode() of texts whose blanks all stand between two other characters."""
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(off) - 1, np.int64)
        cut = raw == 32
        lines = np.flatnonzero(raw[1:-1] == 10) + 1
        lines = lines[~(space[lines - 1] | space[lines + 1])]
        edge = np.zeros(len(raw) + 1, bool)
        edge[off] = True
        lines = lines[~(edge[lines] | edge[lines + 1])]
        cut[lines] = cut[lines + 1] = True
        mark = np.flatnonzero(_MARK[raw[1:]]) + 1
        cut[mark[_LETTER[raw[mark - 1]]]] = True
        cut |= edge[:-1]
        start = np.flatnonzero(cut)
        bounds = pa.py_buffer(np.r_[start, len(raw)].astype(np.int64))
        coded = pa.LargeStringArray.from_buffers(len(start), bounds, pa.py_buffer(np.ascontiguousarray(raw))).dictionary_encode()
        names = coded.dictionary
        lead, begin = text_bytes(names)
        head = lead[begin[:-1]]
        ids, at, size = self.encode_pieces(names.to_numpy(zero_copy_only=False).tolist(), head == 32, (head == 10) & (np.diff(begin) == 1))
        word = np.asarray(coded.indices)
        each = size[word]
        return ids[ragged(at[word], each)], segment_sums(each, np.searchsorted(start, off))


@lru_cache(maxsize=1)
def piece_encoder(path: str) -> PieceEncoder:
    """One for all tasks of a worker, so that pieces stay known."""
    return PieceEncoder(path)


def with_end(ids: np.ndarray, count: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The end id behind each text's ids."""
    stops = np.cumsum(count)
    return np.insert(ids, stops, end), count + 1


def container_rows(docs: DataFrame, path: str, end_id: int = 0, text: str = "text", size: int = CONTAINER) -> DataFrame:
    """The rows of the token files, in order of doc_id over parts and within."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, done = piece_encoder(path), TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal done, held
            keys = pa.concat_arrays([k for k, _, _ in held])
            counts, ids = np.concatenate([c for _, c, _ in held]), np.concatenate([i for _, _, i in held])
            one = pa.array([0, len(keys)], pa.int32())
            columns = [pa.array([part], pa.int32()), pa.array([done], pa.int64()), pa.ListArray.from_arrays(one, keys), pa.ListArray.from_arrays(one, pa.array(counts.astype(np.int32))), pa.array([len(ids)], pa.int64()), pa.array([range_coder.encode(ids)], pa.binary())]
            done, held = done + len(ids), []
            return pa.RecordBatch.from_arrays(columns, names=["part", "local_start", "doc_ids", "counts", "n_tokens", "payload"])

        for batch in batches:
            for piece in chunks(batch, "text", STEP):
                ids, count = with_end(*encoder.encode(piece.column(1)), end_id)
                held.append((piece.column(0), count, ids))
                if sum(len(i) for _, _, i in held) >= size:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = 0, text: str = "text") -> None:
    """Encode every document and write the token files of `folder`."""
    container_rows(docs, path, end_id, text).write.parquet(folder)


def bases(spark: SparkSession, folder: str) -> dict[int, int]:
    """The ids before each part: one row for each part comes to the driver."""
    totals = spark.read.parquet(folder).groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before, out = 0, {}
    for x in totals:
        out[x.part], before = before, before + x.n
    return out


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, token_ids) of every document in the files."""
    return _read(spark, folder, "doc_id long, start long, n_tokens long, token_ids array<int>", lambda ids, off: pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32))))


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""

    def digest(ids: np.ndarray, off: np.ndarray) -> pa.Array:
        data = memoryview(ids.astype("<u4").tobytes())
        return pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())], pa.int64())

    return _read(spark, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", digest)


def _read(spark: SparkSession, folder: str, schema: str, last) -> DataFrame:
    before = spark.sparkContext.broadcast(bases(spark, folder))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, local, keys, counts, _, payload = (batch.column(c)[k] for c in range(6))
                ids = range_coder.decode(payload.as_py())
                count = np.asarray(counts.values).astype(np.int64)
                off = np.r_[0, np.cumsum(count)]
                if off[-1] != len(ids):
                    raise ValueError("a token container does not match its documents")
                start = off[:-1] + (before.value[part.as_py()] + local.as_py())
                for lo in range(0, len(count), 4096):
                    some = slice(lo, lo + 4096)
                    hi = min(len(count), lo + 4096)
                    yield pa.RecordBatch.from_arrays([keys.values[some], pa.array(start[some]), pa.array(count[some]), last(ids[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])], names=names)

    return spark.read.parquet(folder).mapInArrow(run, schema)
