"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased, compared by 64-bit hashes.
Documents and test items that share a seed of SEED words are compared: the longest match of words that are
not marked yet is marked in both, again and again, until none of SEED words is left. Each round finds the
longest length by bisection over Karp-Rabin hashes of all windows of a length. The marked share of the item's
words is its coverage; from THRESHOLD on the document is contaminated by the item. As tiles may lie in any
order, passages whose parts were rearranged are caught.

A pair is tiled only if the seeds it shares could cover that much: an upper bound, so nothing is lost.
Tiling looks only at words inside shared seeds, since every match of SEED words consists of them.

Items with fewer than SEED words, null texts and null items contaminate nothing and are not contaminated;
undecided() names these items.
Repeated item or document rows are compared each and give one row for each pair of ids. Extra columns are not
read. With up to BROADCAST_WORDS words the items go to every task and documents are read once, without a
shuffle; larger sets of items are joined on seeds, with the same result. There the places of an item that a
document's seeds share are gathered for each pair (as many as the item has words, combined before the shuffle) and give
the same bound before any words are joined."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import chunks, mix64, ragged, text_bytes
from strandline.llm.near_dedup import word_hashes

SEED = 5
THRESHOLD = 0.6
#: Words of all items that are sent to every task (some 100 MB with their seeds).
BROADCAST_WORDS = 3_000_000

_STEP = 2 << 20
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = False
_BASE = np.uint64(0xD1342543DE82EF95)
_FILTER = 22

SCHEMA = "doc_id long, item_id long, item_words int, matched_words int, tiles int, coverage double"


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of `size` words."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total = total * _BASE + words[k : len(words) - size + 1 + k]
    return mix64(total)


class Rolling:
    """Hashes of the windows of any length from running sums."""

    def __init__(self, words: np.ndarray, powers: np.ndarray):
        self.words, self.powers = words, powers
        self.sums = np.zeros(len(words) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(words * powers[: len(words)], out=self.sums[1:])

    def hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        """Of the windows at `at`, brought to one power so that equal windows agree wherever they lie."""
        with np.errstate(over="ignore"):
            return (self.sums[at + size] - self.sums[at]) * self.powers[len(self.powers) - 1 - at]


def free(marked: np.ndarray, size: int) -> np.ndarray:
    """Starts of windows without a marked word."""
    if len(marked) < size:
        return np.zeros(0, np.int64)
    run = np.r_[0, np.cumsum(marked)]
    return np.flatnonzero(run[size:] == run[:-size])


def tiles(item: np.ndarray, doc: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles (item place, document place, words), the longest first; ties from the left."""
    powers = np.ones(max(len(item), len(doc)) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(powers) - 1, _BASE)], out=powers)
    a, b = Rolling(item, powers), Rolling(doc, powers)
    marked_a, marked_b = np.zeros(len(item), bool), np.zeros(len(doc), bool)

    def common(size: int) -> np.ndarray:
        """Starts of free item windows that occur in a free document window."""
        i, j = free(marked_a, size), free(marked_b, size)
        return i[np.isin(a.hashes(i, size), b.hashes(j, size))]

    out, high = [], min(len(item), len(doc))
    while high >= least and len(common(least)):
        low = least
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(common(middle)) else (low, middle - 1)
        j = free(marked_b, high)
        places: dict[int, list[int]] = {}
        for h, x in zip(b.hashes(j, high).tolist(), j.tolist()):
            places.setdefault(h, []).append(x)
        starts = common(high)
        before = len(out)
        for x, h in zip(starts.tolist(), a.hashes(starts, high).tolist()):
            if marked_a[x : x + high].any():
                continue
            for y in places.get(h, ()):
                if not marked_b[y : y + high].any() and (item[x : x + high] == doc[y : y + high]).all():
                    marked_a[x : x + high] = True
                    marked_b[y : y + high] = True
                    out.append((x, y, high))
                    break
        if len(out) == before:  # hashes agreed where words do not
            high -= 1
    return out


def tile_row(doc_id: int | None, item_id: int | None, item: np.ndarray, doc: np.ndarray, threshold: float) -> tuple | None:
    """The result row of a pair, or None below the threshold."""
    found = tiles(item, doc)
    matched = sum(n for _, _, n in found)
    return (doc_id, item_id, len(item), matched, len(found), matched / len(item)) if matched >= threshold * len(item) else None


class Items:
    """All items' words and a table of their seeds."""

    def __init__(self, ids: list, words: list[np.ndarray]):
        some = [i for i, w in enumerate(words) if len(w) >= SEED]
        self.ids, self.words = [ids[i] for i in some], [words[i] for i in some]
        seeds = [windows(w, SEED) for w in self.words]
        seed = np.concatenate(seeds or [np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        place = ragged(np.zeros(len(seeds), np.int64), np.array([len(s) for s in seeds], np.int64))
        order = np.argsort(seed, kind="stable")
        self.seed, self.first = np.unique(seed[order], return_index=True)
        self.last = np.r_[self.first[1:], len(seed)]
        self.item, self.place = item[order], place[order]
        self.filter = np.zeros(1 << _FILTER, bool)
        self.filter[(self.seed >> np.uint64(64 - _FILTER)).astype(np.int64)] = True

    def seeds_of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, seed numbers) of the hashes that are seeds."""
        at = np.flatnonzero(self.filter[(hashes >> np.uint64(64 - _FILTER)).astype(np.int64)])
        if not len(at) or not len(self.seed):
            return at[:0], at[:0]
        number = np.minimum(np.searchsorted(self.seed, hashes[at]), len(self.seed) - 1)
        hit = self.seed[number] == hashes[at]
        return at[hit], number[hit]

    def near(self, seeds: np.ndarray, threshold: float) -> Iterator[int]:
        """Items that these seeds could cover to the threshold."""
        seeds = np.unique(seeds)
        count = self.last[seeds] - self.first[seeds]
        at = ragged(self.first[seeds], count)
        cover: dict[int, set[int]] = {}
        for i, p in zip(self.item[at].tolist(), self.place[at].tolist()):
            cover.setdefault(i, set()).update(range(p, p + SEED))
        for i, places in cover.items():
            if len(places) >= threshold * len(self.words[i]):
                yield i


def within(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The words inside seeds that start at `at`, stretches kept apart by words that occur nowhere else."""
    inside = np.zeros(len(words) + 1, np.int64)
    np.add.at(inside, at, 1)
    np.add.at(inside, np.minimum(at + SEED, len(words)), -1)
    keep = np.cumsum(inside[:-1]) > 0
    lead = keep.copy()
    lead[1:] = keep[1:] & ~keep[:-1]
    out = words.copy()
    gap = np.flatnonzero(lead) - 1
    gap = gap[gap >= 0]
    out[gap] = mix64(gap.astype(np.uint64) + np.uint64(1 << 40))
    keep[gap] = True
    return out[keep]


def item_words(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, words) with word hashes as an array, for items of SEED words and more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "t", _STEP):
                h, count = word_hashes(*text_bytes(part.column(1)), _BETWEEN)
                off = np.r_[0, np.cumsum(count)].astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(h.view(np.int64)))], names=["item_id", "words"])

    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("t is not null")
    return rows.mapInArrow(run, "item_id long, words array<long>").where(F.size("words") >= SEED)


def undecided(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, item_words) of the items that are too short to be told from chance: contamination() decides nothing
    about them. Null and empty texts have no words."""
    words = F.array_remove(F.split(F.coalesce(F.col(item_text), F.lit("")), r"[^0-9A-Za-z\x{80}-\x{10ffff}]+"), "")
    return benchmark.select(F.col(item_id).alias("item_id"), F.size(words).alias("item_words")).where(F.col("item_words") < SEED)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """A row for each document and item with coverage >= threshold."""
    items = item_words(benchmark, item_id, item_text)
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    found = _by_broadcast(rows, items, threshold) if total <= broadcast_words else _by_join(rows, items, threshold)
    best = F.max_by(F.struct("item_words", "matched_words", "tiles", "coverage"), F.struct("coverage", "matched_words", "item_words", "tiles"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.*")


def _by_broadcast(rows: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    got = items.collect()  # bounded by broadcast_words
    held = rows.sparkSession.sparkContext.broadcast(Items([x.item_id for x in got], [np.array(x.words, np.int64).view(np.uint64) for x in got]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Items = held.value
        for batch in batches:
            for part in chunks(batch, "text", _STEP):
                h, count = word_hashes(*text_bytes(part.column(1)), _BETWEEN)
                off = np.r_[0, np.cumsum(count)]
                at, seed = known.seeds_of(windows(h, SEED))
                doc = np.searchsorted(off, at, side="right") - 1
                inside = at + SEED <= off[doc + 1]  # not across texts
                at, seed, doc = at[inside], seed[inside], doc[inside]
                out = []
                for d in np.unique(doc).tolist():
                    mine = doc == d if len(doc) < 64 else slice(*np.searchsorted(doc, [d, d + 1]))
                    near = list(known.near(seed[mine], threshold))
                    if near:
                        words = within(h[off[d] : off[d + 1]], at[mine] - off[d])
                        doc_id = part.column(0)[d].as_py()
                        out += [r for i in near if (r := tile_row(doc_id, known.ids[i], known.words[i], words, threshold))]
                if out:
                    yield _batch(out)

    return rows.mapInArrow(run, SCHEMA)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "item_id", "item_words", "matched_words", "tiles", "coverage"])


def _by_join(rows: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """For items that are too many to send: a join on seeds finds the pairs, each is tiled with its words."""

    def doc_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", _STEP):
                h, count = word_hashes(*text_bytes(part.column(1)), _BETWEEN)
                off = np.r_[0, np.cumsum(count)].astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(h.view(np.int64)))], names=["doc_id", "words"])

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                seed, place = np.unique(windows(np.asarray(words.values).view(np.uint64), SEED), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seed), owner)), pa.array(seed.view(np.int64)), pa.array(place)], names=["owner", "seed", "place"])

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                seed = windows(np.asarray(words.values).view(np.uint64), SEED)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seed), owner)), pa.array(seed.view(np.int64)), pa.array(np.arange(len(seed)))], names=["owner", "seed", "place"])

    words = rows.mapInArrow(doc_words, "doc_id long, words array<long>").withColumn("row", F.xxhash64("doc_id", "words")).where(F.size("words") >= SEED)
    numbered = items.withColumn("number", F.xxhash64("item_id", "words"))
    kind = "owner long, seed long, place long"
    a = words.select("row", "words").mapInArrow(seeds, kind).select(F.col("owner").alias("row"), "seed")
    b = numbered.select("number", "words").mapInArrow(item_seeds, kind).select(F.col("owner").alias("number"), "seed", "place")
    # a pair's words are joined only if the item's words inside shared seeds could reach the threshold
    size = numbered.select("number", F.size("words").alias("size")).distinct()
    places = a.join(b, "seed").groupBy("row", "number").agg(F.collect_set("place").alias("places"))
    inside = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (SEED - 1))))))
    pairs = places.join(size, "number").where(inside >= F.col("size") * threshold).select("row", "number")
    both = pairs.join(words, "row").join(numbered.withColumnRenamed("words", "item"), "number").select("doc_id", "item_id", "item", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, item_id, item, doc in zip(*(batch.column(i) for i in range(4))):
                item, doc = np.asarray(item.values).view(np.uint64), np.asarray(doc.values).view(np.uint64)
                own = windows(item, SEED)
                at = np.flatnonzero(np.isin(windows(doc, SEED), own))
                if r := tile_row(doc_id.as_py(), item_id.as_py(), item, within(doc, at), threshold):
                    out.append(r)
            if out:
                yield _batch(out)

    return both.mapInArrow(run, SCHEMA)
