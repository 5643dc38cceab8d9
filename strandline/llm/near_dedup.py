"""Near-duplicate documents by one-permutation MinHash with optimal densification, bands and star edges.

Words are maximal runs without ASCII white space, A-Z lower-cased. A document's set holds its distinct
five-word shingles (64-bit hashes); with fewer words the whole sequence is the one element; without words, and
for null texts, it is empty and linked with nothing. Two documents are linked when
100 * |intersection| >= 75 * |union|; components of links are the near-duplicate groups.

1. Documents with the same set form one class; its smallest doc_id stands for it from here on.
2. One permutation deals a set's hashes to BANDS * ROWS bins, and a bin keeps its smallest. An empty bin takes
   the value of the first full one in a pseudo-random order of its own (optimal densification), the same for
   all sets. ROWS bins form the key of a bucket. A pair at the threshold shares none of the buckets with a
   probability of (1 - 0.75 ** ROWS) ** BANDS, 3e-9 here.
3. In a bucket, every class is a candidate with the smallest id in it only: as many pairs as rows.
4. Candidates are confirmed on full sets, and components of confirmed links are found.
5. A link that no star shows lies between two classes of one bucket, neither of them its smallest id, that are
   not in the same component yet. Buckets whose other members are still of several components, each set of
   members once, are searched with their members' whole sets, in blocks of at most BLOCK members and about
   BLOCK_SHINGLES shingles: a group gets two blocks, compares across components, and writes only links that
   join two components which its earlier links did not join. So a bucket writes fewer rows than it has members,
   however many pairs it holds, and its work is split over tasks.

Hot buckets: the smallest id is a grouped minimum, combined before the shuffle; the join that follows splits
hot keys. Nothing is collected on the driver. A doc_id should be unique; rows that repeat one are each
returned, and links of one are links of all. Extra columns are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import by_group, chunks, materialize, mix64, ragged, text_bytes
from strandline.llm.components import connected

WORDS = 5
ROWS = 5
BANDS = 72
#: Members of a bucket that are compared with as many others at once, and about how many shingles they may hold.
BLOCK = 512
BLOCK_SHINGLES = 2_000_000
#: Shingles whose common ones are counted at once.
PART_SHINGLES = 1 << 18
#: Link from 100 * intersection >= PERCENT * union on.
PERCENT = 75
#: At most so many ids of candidates are sent to all executors (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000

_STEP = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_PLACES = mix64(np.arange(1000, 1000 + WORDS, dtype=np.uint64)) | np.uint64(1)


def word_hashes(raw: np.ndarray, off: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the number of words of each text. space: the bytes between words."""
    n = len(off) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    inside = ~space[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = off[:-1][off[:-1] < len(raw)]
    first[cut] = inside[cut]
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    at = np.flatnonzero(inside)
    length = np.diff(np.r_[np.flatnonzero(first[at]), len(at)])
    place = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
    power = np.ones(int(length.max()), np.uint64)
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(power) - 1, _BASE)], out=power)
        value = _RANDOM[_FOLD[raw[at]]] * power[place]
        h = mix64(np.add.reduceat(value, np.cumsum(length) - length))
    return h, np.diff(np.searchsorted(start, off))


def shingle_sets(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after the other, and offsets."""
    h, words = word_hashes(raw, off)
    n = len(words)
    first = np.cumsum(words) - words
    count = np.where(words > 0, np.maximum(1, words - WORDS + 1), 0)
    at = ragged(first, count)
    left = np.repeat(words, count) - (at - np.repeat(first, count))  # words from here to the text's end
    total = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WORDS):
            total += np.where(left > k, h[np.minimum(at + k, max(0, len(h) - 1))] * _PLACES[k] + np.uint64(k + 1), np.uint64(0))
    total = mix64(total)
    bound = np.r_[0, np.cumsum(count)]
    sets = [np.unique(total[a:b]) for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())]
    return (np.concatenate(sets) if sets else total), np.r_[0, np.cumsum([len(s) for s in sets], dtype=np.int64)] if n else np.zeros(1, np.int64)


def _tries(n: int, bins: int) -> np.ndarray:
    """The n-th bin that each empty bin looks at."""
    with np.errstate(over="ignore"):
        return (mix64(np.arange(bins, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(n) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(bins)).astype(np.int64)


def signatures(sets: np.ndarray, off: np.ndarray, bins: int) -> np.ndarray:
    """Densified one-permutation signatures, a row for each non-empty set (all sets must be non-empty)."""
    n = len(off) - 1
    owner = np.repeat(np.arange(n), np.diff(off))
    bin_ = ((sets >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)  # grows with the hash
    cell = owner * bins + bin_
    lead = np.r_[True, cell[1:] != cell[:-1]][: len(cell)]
    out = np.zeros(n * bins, np.uint64)
    full = np.zeros(n * bins, bool)
    out[cell[lead]], full[cell[lead]] = sets[lead], True
    empty = np.flatnonzero(~full)
    filled = np.bincount(cell[lead] // bins, minlength=n)
    only = np.flatnonzero(filled == 1)  # all bins end at the one that is full
    if len(only):
        out.reshape(n, bins)[only] = sets[off[only]][:, None]
        empty = empty[filled[empty // bins] > 1]
    n_try = 0
    while len(empty):
        look = (empty // bins) * bins + _tries(n_try, bins)[empty % bins]
        hit = full[look]
        out[empty[hit]] = out[look[hit]]
        empty = empty[~hit]
        n_try += 1
    return out.reshape(n, bins)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    weight = mix64(np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    with np.errstate(over="ignore"):
        mixed = (mix64(signature).reshape(len(signature), bands, rows) * weight).sum(-1, dtype=np.uint64)
        return mix64(mixed + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def sketches(docs: DataFrame, text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, keys): size and 128-bit hash of each document's set, and its bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text, _STEP):
                sets, off = shingle_sets(*text_bytes(part.column(1)))
                size = np.diff(off)
                some = np.flatnonzero(size)
                both = np.zeros((2, len(size)), np.uint64)
                keys = np.zeros((0, bands), np.uint64)
                if len(some):
                    with np.errstate(over="ignore"):
                        for k in (0, 1):  # the set's hash: sums of two mixes of its elements
                            both[k, some] = np.add.reduceat(mix64(sets ^ mix64(np.full(1, k + 77, np.uint64))), off[some])
                    keys = band_keys(signatures(sets, np.r_[off[some], off[-1]], bands * rows), bands, rows)
                ends = np.r_[0, np.cumsum(np.where(size > 0, bands, 0))].astype(np.int32)
                arrays = [part.column(0), pa.array(size), *(pa.array(x.view(np.int64)) for x in both), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "h1", "h2", "keys"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, text: str = "text") -> DataFrame:
    """(id, n, shingles) of the documents whose doc_id is in `ids` (id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text, _STEP):
                sets, off = shingle_sets(*text_bytes(part.column(1)))
                arrays = [part.column(0), pa.array(np.diff(off)), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(sets.view(np.int64)))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "shingles"])

    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = docs.select("doc_id", text).join(wanted, F.col("doc_id") == F.col("id"), "left_semi")
    return rows.mapInArrow(run, "id long, n long, shingles array<long>")


def confirmed(docs: DataFrame, sizes: DataFrame, pairs: DataFrame, text: str, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked, decided on full sets. sizes: (id, n) of all classes."""
    n = lambda c: sizes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"))
    near = pairs.join(n("a"), "a").join(n("b"), "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).select("a", "b")
    near = materialize(near, "near-pairs")
    ids = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = materialize(full_sets(docs, ids, text).dropDuplicates(["id"]), "near-sets")
    own = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("shingles").alias(f"s_{c}"))
    both = near.join(own("b"), "b").join(own("a"), "a")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return both.where(shared * 100 >= (F.col("n_a") + F.col("n_b") - shared) * percent).select("a", "b")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of some sets share, as a matrix. Elements are dealt by their last bits, so that the
    arrays of a part stay small however large the sets are."""
    m = len(sets)
    out = np.zeros((m, m), np.float32)
    parts = 1 << (sum(map(len, sets)) // PART_SHINGLES).bit_length()
    for k in range(parts):
        some = [x[x & (parts - 1) == k] for x in sets] if parts > 1 else sets
        owner = np.repeat(np.arange(m), [len(x) for x in some])
        value, at, count = np.unique(np.concatenate(some), return_inverse=True, return_counts=True)
        keep = count[at] > 1
        owner, at = owner[keep], (np.cumsum(count > 1) - 1)[at[keep]]
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        step = max(256, (1 << 20) // m)
        for lo in range(0, int((count > 1).sum()), step):
            a, b = np.searchsorted(at, [lo, lo + step])
            part = np.zeros((m, step), np.float32)
            part[owner[a:b], at[a:b] - lo] = 1
            out += part @ part.T
    return out


def joining_links(table: pa.Table, percent: int) -> pa.Table:
    """Of a bucket's members (id, c, n, at, i, j, shingles) links that join components, one after the other."""
    ids, c, n, at = (table.column(x).to_numpy() for x in ("id", "c", "n", "at"))
    sets = table.column("shingles").combine_chunks()
    off, flat = np.asarray(sets.offsets), np.asarray(sets.values)
    if (np.minimum.outer(n, n) * 100 < np.maximum.outer(n, n) * percent)[c[:, None] != c[None, :]].all():
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})  # sizes exclude all links
    shared = shared_counts([flat[a:b] for a, b in zip(off[:-1], off[1:])])
    linked = (shared * 100 >= (n[:, None] + n[None, :] - shared) * percent) & (c[:, None] != c[None, :])
    if table.column("i")[0].as_py() != table.column("j")[0].as_py():
        linked &= at[:, None] != at[None, :]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out: list[tuple[int, int]] = []
    for x, y in zip(*np.nonzero(np.triu(linked, 1))):
        p, q = find(int(c[x])), find(int(c[y]))
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def across_components(docs: DataFrame, shared: DataFrame, found: DataFrame, text: str, percent: int, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Candidate links (a, b) between components that meet in a bucket. shared: (key, id, n), the members of
    buckets but for each one's center; found: (id, component)."""
    labelled = shared.join(found, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("c"))
    # buckets with the same members: by three sums of 32 independent bits of their ids
    half = lambda seed, cut: F.sum(F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), cut).bitwiseAND(F.lit(0xFFFFFFFF)))
    mixed = labelled.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("members"), F.sum("n").alias("size"), half(1, 0).alias("x"), half(1, 32).alias("y"), half(2, 0).alias("z")).where("low < high")
    once = mixed.groupBy("members", "size", "x", "y", "z").agg(F.min("key").alias("key")).select("key", F.ceil(F.greatest(F.col("members") / block, F.col("size") / block_shingles)).cast("int").alias("blocks"))
    rest = materialize(labelled.drop("n").join(once, "key"), "near-mixed")
    ids = rest.select("id").distinct()
    sets = full_sets(docs, ids, text).dropDuplicates(["id"])
    placed = rest.withColumn("at", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = placed.withColumn("other", other).select("key", F.greatest("at", "other").alias("i"), F.least("at", "other").alias("j"), "at", "id", "c")
    full = paired.join(sets, "id").select("key", "i", "j", "at", "id", "c", "n", "shingles")
    return by_group(full, ["key", "i", "j"], lambda t: joining_links(t, percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs; see the module's text."""
    sketch = materialize(sketches(docs, text, bands, rows), "near-sketches")
    some = sketch.where("n_shingles > 0")
    classes = some.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("id"))
    member = materialize(some.select("doc_id", "h1", "h2", "n_shingles").join(classes, ["h1", "h2", "n_shingles"]).select("doc_id", "id", F.col("n_shingles").alias("n")), "near-members")
    sizes = member.where("doc_id = id").select("id", "n").dropDuplicates(["id"])

    placed = some.join(sizes.select("id"), F.col("doc_id") == F.col("id"), "left_semi").select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"))
    centers = placed.groupBy("key").agg(F.min("id").alias("center"), F.max("id").alias("last")).where("center < last").select("key", "center")
    shared = materialize(placed.join(centers, "key"), "near-buckets")
    stars = materialize(shared.where("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct(), "near-stars")
    links = materialize(confirmed(docs, sizes, stars, text, percent), "near-links")
    found = connected(links)

    across = across_components(docs, shared.where("id <> center").select("key", "id", "n"), found, text, percent)
    more = materialize(confirmed(docs, sizes, across, text, percent), "near-links")
    groups = connected(links.unionByName(more)) if more.head(1) else found

    out = sketch.select("doc_id", "n_shingles").join(member.select("doc_id", "id").dropDuplicates(["doc_id"]), "doc_id", "left").join(groups, "id", "left")
    component = F.coalesce("component", "id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
