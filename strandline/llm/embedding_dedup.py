"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors.

Two vectors are linked when their cosine in double precision is at least THRESHOLD. Vectors that are null,
empty, zero, or hold null or non-finite components link with nothing, nor do rows without a vec_id; vectors of
different length do not link. Components are divided by the largest one first, so sizes of 1e200 or 1e-200 do
no harm.

Codes. A unit vector o is rotated into BITS dimensions by a random matrix with orthonormal columns and keeps
the signs, that is the nearest corner x of a cube, and the correction factor <x, o>. Both are stored once for
each vector: 40 bytes. For a rotated query q, <x, q> / <x, o> is an unbiased estimate of <o, q> with an error of
at most EPSILON * sqrt((1 - <x, o>^2) / <x, o>^2 / (BITS - 1)) but for a chance that falls with
exp(-EPSILON^2 / 2). Only a pair that this bound leaves open is recomputed exactly.

1. Equal vectors form one class, the smallest vec_id standing for it, with a weight of its size.
2. Candidates. Signs of further rotations give keys of k bits in L tables. k grows with the logarithm of the
   number of classes, so that unrelated vectors meet rarely at any size, and L follows from k so that a pair
   at the threshold is missed by all tables with a mean chance of MISS, over the spread of differing signs.
3. Stars. In each bucket every vector is a candidate with the smallest id only. A candidate brings its code, a
   center its vector, once; the vectors of both are joined for open pairs alone. Links give components.
4. Buckets whose other members are still of several components are searched in blocks of BLOCK members, pairs of
   blocks being spread over tasks: numbers of differing signs exclude pairs first, then the estimate, then the
   exact cosine decides, and only links that join two components are written.
5. Links lie within components. Each component is counted in the same way, in pairs of blocks: a task adds up,
   for each vector, the weights of those linked with it. No pairs are written.

Repeated vec_ids are each returned; extra columns, labels among them, are not read."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import by_group, materialize, mix64, ragged, starts_of
from strandline.llm.components import connected

THRESHOLD = 0.95
BITS = 256
#: Rotations of BITS signs each that keys are drawn from.
KEY_ROTATIONS = 4
EPSILON = 7.0
MISS = 1e-6
BLOCK = 4096
#: Pairs, and rows of a block, that are worked on at once.
STEP, ROWS = 1 << 14, 256
#: Groups of up to SMALL members are worked on together, about BUNDLE rows at once.
SMALL, BUNDLE = 64, 4096
#: A pair at the threshold has more differing signs than allowed with this chance at most.
EXCESS = 1e-12


@lru_cache(maxsize=32)
def rotation(dim: int, bits: int = BITS, seed: int = 20) -> np.ndarray:
    """dim rows, `bits` columns (more for longer vectors), orthonormal rows scaled to keep lengths."""
    bits = max(bits, -(-dim // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, dim)))
    return (q * np.sign(np.diag(r))).T


def tables(classes: int, bits: int = BITS * KEY_ROTATIONS, threshold: float = THRESHOLD, miss: float = MISS, seed: int = 21) -> np.ndarray:
    """The bits of each table: L rows of k bit numbers."""
    k = max(6, math.ceil(math.log2(max(2, classes))))
    differ = math.acos(threshold) / math.pi
    d = np.arange(bits + 1)
    log = np.array([math.lgamma(bits + 1) - math.lgamma(i + 1) - math.lgamma(bits - i + 1) for i in d]) + d * math.log(differ) + (bits - d) * math.log1p(-differ)
    share, same = np.exp(log), (1 - d / bits) ** k
    count = 1
    while (share * (1 - same) ** count).sum() > miss:
        count += 1 + count // 16
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(bits)[:k] for _ in range(count)])


def unit_rows(values: pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows in double precision."""
    rows = np.asarray(values.flatten(), np.float64).reshape(len(values), -1)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def signs(units: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signs as booleans, correction factors)."""
    turned = units @ turn
    return turned >= 0, np.abs(turned).sum(1) / math.sqrt(turn.shape[1])


def error_bound(factor: np.ndarray, bits: int) -> np.ndarray:
    return EPSILON * np.sqrt(np.maximum(0, 1 - factor**2) / factor**2 / (bits - 1))


@lru_cache(maxsize=32)
def most_differing(bits: int, threshold: float, excess: float = EXCESS) -> int:
    """So many signs of a pair at the threshold differ at most, but for a chance of `excess` (Chernoff's bound)."""
    p = math.acos(threshold) / math.pi
    for t in range(math.ceil(bits * p), bits):
        x = t / bits
        if x > p and bits * (x * math.log(x / p) + (1 - x) * math.log((1 - x) / (1 - p))) > -math.log(excess):
            return t
    return bits


def bucket_keys(sign: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """A 64-bit key for each vector and table."""
    value = np.zeros((sign.shape[1], len(picks)))
    for t, bits in enumerate(picks):
        value[bits, t] = 2.0 ** np.arange(len(bits))
    with np.errstate(over="ignore"):
        return mix64((sign @ value).astype(np.uint64) + mix64(np.arange(1, len(picks) + 1, dtype=np.uint64)))


def sound(vectors: str):
    """Whether a vector can link at all, as a column."""
    v = F.col(vectors)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _by_length(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    size = np.diff(np.asarray(vectors.offsets))
    for dim in np.unique(size).tolist():
        yield dim, np.flatnonzero(size == dim)


def codes(vectors: DataFrame) -> DataFrame:
    """(id, code, factor) of every vector (id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at in _by_length(batch.column(1)):
                sign, factor = signs(unit_rows(batch.column(1).take(pa.array(at))), rotation(dim))
                packed = [x.tobytes() for x in np.packbits(sign, axis=1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(packed, pa.binary()), pa.array(factor)], names=["id", "code", "factor"])

    return vectors.select("id", "v").mapInArrow(run, "id long, code binary, factor double")


def candidates(vectors: DataFrame, picks: np.ndarray) -> DataFrame:
    """(key, id): the buckets of every vector (id, v)."""
    picks = vectors.sparkSession.sparkContext.broadcast(picks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                for dim, at in _by_length(part.column(1)):
                    units = unit_rows(part.column(1).take(pa.array(at)))
                    sign = np.concatenate([units @ rotation(dim, BITS, 100 + r) >= 0 for r in range(KEY_ROTATIONS)], axis=1)[:, : BITS * KEY_ROTATIONS]
                    keys = bucket_keys(sign.astype(float), picks.value) ^ mix64(np.array([dim], np.uint64))
                    ids = np.repeat(np.asarray(part.column(0).take(pa.array(at))), keys.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], names=["key", "id"])

    return vectors.select("id", "v").mapInArrow(run, "key long, id long")


def unpacked(column: pa.Array, bits: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.unpackbits(raw, axis=1)[:, :bits]


def open_pairs(stars: DataFrame, coded: DataFrame, vectors: DataFrame, threshold: float, part: int = 1 << 16) -> DataFrame:
    """The pairs (a, b) that codes do not exclude: of each a its vector, of each b its stored code and factor.
    A center's pairs are dealt in parts, and its vector is sent once to each part."""
    parts = stars.groupBy("a").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    queries = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(vectors.select(F.col("id").alias("a"), "v"), "a")
    queries = queries.select("a", "part", F.lit(None).cast("long").alias("b"), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("factor"), "v")
    pairs = stars.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts").cast("int")).join(coded.select(F.col("id").alias("b"), "code", "factor"), "b")
    pairs = pairs.select("a", "part", "b", "code", "factor", F.lit(None).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros(0)  # the rotated vector of the last center
        for batch in batches:
            a, b, code, factor, v = (batch.column(k) for k in (0, 2, 3, 4, 5))
            lead = np.asarray(b.is_null())
            number = np.cumsum(lead)  # 0: of the last center of the batch before
            turned = [last] + [np.zeros(0)] * int(lead.sum())
            heads = v.filter(pa.array(lead))
            for dim, at in _by_length(heads) if len(heads) else ():
                for k, q in zip(at.tolist(), unit_rows(heads.take(pa.array(at))) @ rotation(dim)):
                    turned[1 + k] = q
            last = turned[-1]
            width, keep = np.array([len(q) for q in turned]), np.zeros(batch.num_rows, bool)
            for bits in np.unique(width[number[~lead]]).tolist():
                some = np.flatnonzero(~lead & (width[number] == bits))
                use = np.unique(number[some])
                q = np.stack([turned[k] for k in use])
                for lo in range(0, len(some), STEP):
                    at = some[lo : lo + STEP]
                    f = np.asarray(factor.take(pa.array(at)))
                    corner = unpacked(code.take(pa.array(at)), bits).astype(np.int8) * 2 - 1
                    estimate = (corner * q[np.searchsorted(use, number[at])]).sum(1) / math.sqrt(bits) / f
                    keep[at] = estimate + error_bound(f, bits) >= threshold
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    rows = queries.unionByName(pairs).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.mapInArrow(run, "a long, b long")


def exact(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose cosine reaches the threshold."""
    own = lambda c: vectors.select(F.col("id").alias(c), F.col("v").alias(f"v_{c}"))
    both = pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "v_a", "v_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            same, keep = np.diff(np.asarray(a.offsets)) == np.diff(np.asarray(b.offsets)), np.zeros(batch.num_rows, bool)
            for _, at in _by_length(a):
                at = pa.array(at[same[at]])
                if len(at):
                    keep[np.asarray(at)] = (unit_rows(a.take(at)) * unit_rows(b.take(at))).sum(1) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


class Block:
    """Vectors of one length with their codes and factors."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        column = lambda c: table.column(c).chunk(0)
        self.units = unit_rows(column("v"))
        self.turn = rotation(self.units.shape[1])
        self.bits = self.turn.shape[1]
        self.code = np.frombuffer(b"".join(column("code").to_pylist()), np.uint8).reshape(len(self.units), -1)
        self.words = self.code.view(np.uint64)
        self.factor = column("factor").to_numpy()
        self.slack = error_bound(self.factor, self.bits) + 1e-5
        self.recomputed = 0

    def corners(self, at: np.ndarray) -> np.ndarray:
        return np.unpackbits(self.code[at], axis=1)[:, : self.bits].astype(np.float32) * 2 - 1

    def turned(self, at: np.ndarray) -> np.ndarray:
        return (self.units[at] @ self.turn).astype(np.float32) / np.float32(math.sqrt(self.bits))

    def linked(self, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
        """Which pairs are linked: stored codes exclude a pair by the number of differing signs, then by the
        estimate; the rest is exact."""
        most, out = most_differing(self.bits, threshold), np.zeros(len(x), bool)
        for k in range(0, len(x), STEP):
            p, q = x[k : k + STEP], y[k : k + STEP]
            near = np.flatnonzero(np.bitwise_count(self.words[p] ^ self.words[q]).sum(1) <= most)
            if len(near):
                p, q = p[near], q[near]
                estimate = (self.turned(p) * self.corners(q)).sum(1) / self.factor[q]
                open_ = estimate + self.slack[q] >= threshold
                self.recomputed += int(open_.sum())
                near, p, q = near[open_], p[open_], q[open_]
                out[k + near] = (self.units[p] * self.units[q]).sum(1) >= threshold
        return out

    def links(self, allowed, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Linked pairs (x, y) with allowed(x as a column, all y), some rows after the other: linked() for whole
        rows, by matrix products where many pairs are near."""
        most, every, corners = most_differing(self.bits, threshold), np.arange(len(self.units)), None
        for lo in range(0, len(self.units), ROWS):
            own = every[lo : lo + ROWS]
            differ = np.zeros((len(own), len(every)), np.uint16)
            for w in range(self.words.shape[1]):
                differ += np.bitwise_count(self.words[own, w][:, None] ^ self.words[:, w])
            near = (differ <= most) & allowed(own[:, None], every)
            if near.sum() <= near.size // 8:
                x, y = np.nonzero(near)
                good = self.linked(own[x], y, threshold)
                yield own[x[good]], y[good]
                continue
            if corners is None:
                corners = self.corners(every)
            estimate = self.turned(own) @ corners.T / self.factor.astype(np.float32)
            x, y = np.nonzero(near & (estimate + self.slack.astype(np.float32) >= threshold))
            self.recomputed += len(x)
            value = (self.units[own] @ self.units.T)[x, y]
            unclear = np.flatnonzero(np.abs(value - threshold) < 1e-9)  # as linked() does it, whatever a product rounds to
            value[unclear] = (self.units[own[x[unclear]]] * self.units[y[unclear]]).sum(1)
            good = value >= threshold
            yield own[x[good]], y[good]


def linked_pairs(table: pa.Table, allowed, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (x, y) of rows of a table of whole groups (key, i, j), x < y, where allowed(x, y)."""
    start = starts_of(table, ["key", "i", "j"])
    end = np.r_[start[1:], table.num_rows]
    for a, b in zip(start, end):
        if b - a > SMALL:
            for x, y in Block(table.slice(a, b - a)).links(lambda x, y: (x < y) & allowed(a + x, a + y), threshold):
                yield a + x, a + y
    vectors = table.column("v").combine_chunks()
    dims = np.diff(np.asarray(vectors.offsets))[start]
    for dim in np.unique(dims[end - start <= SMALL]).tolist():  # all small groups at once
        some = (end - start <= SMALL) & (dims == dim)
        size = (end - start)[some]
        at, group_end = ragged(start[some], size), np.repeat(np.cumsum(size), size)
        more = group_end - np.arange(len(at)) - 1
        x, y = np.repeat(np.arange(len(at)), more), ragged(np.arange(len(at)) + 1, more)
        fit = allowed(at[x], at[y])
        x, y = x[fit], y[fit]
        if len(x):
            good = Block(table.take(pa.array(at))).linked(x, y, threshold)
            yield at[x[good]], at[y[good]]


def in_blocks(members: DataFrame, key: str, coded: DataFrame, vectors: DataFrame, block: int) -> DataFrame:
    """Rows (key, i, j, at, id, ..., v, weight, code, factor): the members of a key are dealt to blocks by a hash of
    the id, and block i meets block j <= i in the group (key, i, j). members: (key, id, c)."""
    size = members.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = members.join(size, key).withColumn("at", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(F.col(key).alias("key"), F.greatest("at", "other").alias("i"), F.least("at", "other").alias("j"), "at", "id", "c")
    return placed.join(vectors.join(coded, "id"), "id")


def link_weights(members: DataFrame, coded: DataFrame, vectors: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(id, links): the weights of all vectors of a component that are linked with each one. members:
    (id, component); vectors: (id, v, weight)."""

    def count(table: pa.Table) -> pa.Table:
        at, weight = table.column("at").to_numpy(), table.column("weight").to_numpy()
        one = np.asarray(table.column("i")) == np.asarray(table.column("j"))
        total = np.zeros(len(at), np.int64)
        for x, y in linked_pairs(table, lambda x, y: one[x] | (at[x] != at[y]), threshold):
            total += np.bincount(x, weight[y], len(at)).astype(np.int64) + np.bincount(y, weight[x], len(at)).astype(np.int64)
        return pa.table({"id": table.column("id"), "links": total})

    rows = in_blocks(members.withColumn("c", F.col("component")), "component", coded, vectors, block)
    return by_group(rows, ["key", "i", "j"], count, "id long, links long", BUNDLE).groupBy("id").agg(F.sum("links").alias("links"))


def across_components(shared: DataFrame, found: DataFrame, coded: DataFrame, vectors: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join components which meet in a bucket. shared: (key, id) without centers; found: (id, component)."""
    labelled = shared.join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    half = lambda seed, cut: F.sum(F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), cut).bitwiseAND(F.lit(0xFFFFFFFF)))
    mixed = labelled.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n"), half(1, 0).alias("x"), half(1, 32).alias("y"), half(2, 0).alias("z")).where("low < high")
    once = mixed.groupBy("n", "x", "y", "z").agg(F.min("key").alias("key")).select("key")  # buckets with the same members
    rest = materialize(labelled.join(once, "key", "left_semi"), "vector-mixed")

    def join(table: pa.Table) -> pa.Table:
        ids, c, at = (table.column(k).to_numpy() for k in ("id", "c", "at"))
        one = np.asarray(table.column("i")) == np.asarray(table.column("j"))
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        out: list[tuple[int, int]] = []
        for x, y in linked_pairs(table, lambda x, y: (c[x] != c[y]) & (one[x] | (at[x] != at[y])), threshold):
            for p, q in zip(x.tolist(), y.tolist()):
                a, b = find(int(c[p])), find(int(c[q]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((int(min(ids[p], ids[q])), int(max(ids[p], ids[q]))))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return by_group(in_blocks(rest, "key", coded, vectors, block), ["key", "i", "j"], join, "a long, b long", BUNDLE).distinct()


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row; see the module's text."""
    rows = embeddings.select(F.col(key).cast("long").alias("vec_id"), F.when(F.col(key).isNotNull() & sound(vector), F.transform(vector, lambda x: x.cast("double") + F.lit(0.0))).alias("v"))
    classes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")).select("id", "v", "weight")
    vectors = materialize(classes, "vectors")
    coded = materialize(codes(vectors), "vector-codes")
    picks = tables(vectors.count(), threshold=threshold)

    placed = materialize(candidates(vectors, picks), "vector-buckets")
    centers = placed.groupBy("key").agg(F.min("id").alias("center"), F.max("id").alias("last")).where("center < last").select("key", "center")
    shared = materialize(placed.join(centers, "key").where("id <> center"), "vector-shared")
    stars = materialize(shared.select(F.col("center").alias("a"), F.col("id").alias("b")).distinct(), "vector-stars")
    links = materialize(exact(open_pairs(stars, coded, vectors, threshold), vectors, threshold), "vector-links")
    found = connected(links)

    more = materialize(across_components(shared.select("key", "id"), found, coded, vectors, threshold, block), "vector-links")
    groups = materialize(connected(links.unionByName(more)) if more.head(1) else found, "vector-groups")

    counted = link_weights(groups, coded, vectors, threshold, block)
    info = vectors.join(groups, "id", "left").join(counted, "id", "left").select("v", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.join(info, "v", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
