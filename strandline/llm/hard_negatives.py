"""Hard negatives by a dual-tree search: for an anchor and each of its positives, the rows of other labels that score
just below the positive.

A component x counts as floor(SCALE * x), a score is the inner product of two such rows, larger scores and then
smaller vec_ids come first. Positives are an anchor's first TOP other rows of its label. Negatives of a positive are
the first TOP rows of other labels whose score is between SHARE_LOW and SHARE_HIGH hundredths of the positive's.

Trees. The nodes of both trees are balls: a center, a radius, the least and largest label, the least vec_id. Over
two nodes all inner products lie within c1*c2 +- (|c1| r2 + |c2| r1 + r1 r2), so a pair of nodes goes at once if this
interval misses what every anchor of the node still looks for, or if its labels rule it out.

1. The upper levels are median splits, fitted on SAMPLE rows (those of the smallest hashes), which every row is then
   sent down. Each of the CELLS cells at most has a center, and the radius that holds all of its rows. Cells of more
   than BLOCK rows, such as one vector that a third of the rows repeat, are dealt over several blocks.
2. Anchors are dealt over groups within a cell. A group is tested against the balls of the cells, then each anchor that
   is left; what remains is sent to the blocks, with what it looks for. The cells are in each task, CELLS rows for a
   vector length; blocks and anchors meet by a shuffle.
3. A task holds one block with the lower levels of its tree, and one group of anchors at a time with its own tree. Pairs
   of nodes are followed level by level, all pairs of a level at once. Pairs of leaves are scored exactly, those with
   the largest bound first, and every score found raises what its anchor still looks for.
4. A first round visits the FIRST likeliest cells of each anchor. Its scores are what the second round, over all other
   cells, has to beat. Both rounds run for positives, and then for negatives with a band for each positive.

No score is estimated. Rows without vec_id, label or vector, with a null or non-finite component, or with a length of
2^28 and more after scaling (whose scores times 100 might not fit in 64 bits) take no part. Vectors of another length
than the anchor's have no score with it; empty vectors score 0 with each other. Rows count as often as they stand in the
table, but never as a positive of an anchor with their vec_id; equal anchor rows count once, different ones of one
vec_id each have their rows. Other columns are not read. An empty table gives no rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import by_group, materialize, starts_of

SCALE, TOP, SHARE_LOW, SHARE_HIGH = 256, 5, 80, 100
SAMPLE, CELLS, CELL_ROWS = 4096, 256, 512
BLOCK, GROUP, FIRST = 16384, 512, 2
#: Rows and anchors of a leaf, and leaves that are scored in one step.
LEAF, ANCHOR_LEAF, STEP = 64, 16, 16
LONGEST = float(1 << 28)
NO_ID = np.iinfo(np.int64).max
LEAST, MOST = -(1 << 62), 1 << 62

ROWS = "vec_id long, label long, v array<int>, cell int, dist double, norm double"
FOUND = "a_key long, band int, vec_id long, score long"
SENT = ["group_", "a_key", "vec_id", "label", "v", "lows", "highs", "low_ids"]
SENT_SCHEMA = "group_ long, a_key long, vec_id long, label long, v array<int>, lows array<long>, highs array<long>, low_ids array<long>, at int, blocks int"


def integer_rows(vectors: DataFrame, label: Column) -> DataFrame:
    """(vec_id, label, v) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), "embedding")
    rows = rows.where("vec_id is not null and label is not null and embedding is not null").where(finite)
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    rows = rows.select("vec_id", "label", scaled.alias("x"))
    size = F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x)
    return rows.where(size < LONGEST**2).select("vec_id", "label", F.transform("x", lambda x: x.cast("int")).alias("v"))


def matrix(values: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    flat = np.asarray(values.flatten(), np.float64)
    return flat.reshape(len(values), len(flat) // max(1, len(values)))


class Splits:
    """Median splits of sampled vectors of one length, to 2^depth cells."""

    def __init__(self, x: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.at = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
        node = np.zeros(len(x), np.int64)
        for i in range(len(self.axis)):
            mine = np.flatnonzero(node == i)
            if len(mine) > 1 and x.shape[1]:
                spread = np.ptp(x[mine], 0)
                axis = int(spread.argmax())
                if spread[axis] > 0:
                    values = np.sort(x[mine, axis])
                    middle = values[(len(values) - 1) // 2]
                    self.axis[i], self.at[i] = axis, middle if middle < values[-1] else values[values < middle].max()
            node[mine] = self._down(x[mine], node[mine])
        cell = node - ((1 << depth) - 1)
        self.centers = np.zeros((1 << depth, x.shape[1]))
        for c in np.unique(cell):
            self.centers[c] = x[cell == c].mean(0)

    def _down(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        right = x[np.arange(len(x)), self.axis[node]] > self.at[node] if x.shape[1] else np.zeros(len(x), bool)
        return 2 * node + 1 + right

    def cells(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = self._down(x, node)
        return node - ((1 << self.depth) - 1)


def fit(rows: DataFrame) -> dict[int, tuple[int, Splits]]:
    """By vector length: the number of the first cell, and the splits. The number of cells follows the number of rows,
    up to CELLS in all."""
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id", "label"), "vec_id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    sizes = np.diff(np.asarray(sample.offsets)) if len(sample) else np.zeros(0, int)
    out, begin = {}, 0
    for size in np.unique(sizes):
        own = matrix(sample.take(pa.array(np.flatnonzero(sizes == size))))
        share = len(own) / len(sample)
        most = min(CELLS * share, total * share / CELL_ROWS, len(own) / 16)
        splits = Splits(own, int(math.log2(max(1, most))))
        out[int(size)] = (begin, splits)
        begin += len(splits.centers)
    return out


def _route(top):
    """Cell, distance from its center and length of each row. Lengths that were not sampled have a cell of their own,
    below 0, around 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("v")
            sizes = np.diff(np.asarray(vectors.offsets))
            for size in np.unique(sizes):
                some = batch.take(pa.array(np.flatnonzero(sizes == size)))
                x = matrix(some.column("v"))
                norm = np.sqrt((x * x).sum(1))
                if int(size) in top.value:
                    begin, splits = top.value[int(size)]
                    cell = splits.cells(x)
                    dist = np.sqrt(((x - splits.centers[cell]) ** 2).sum(1))
                    cell += begin
                else:
                    cell, dist = np.full(len(x), -1 - size), norm
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell, pa.int32()), pa.array(dist), pa.array(norm)], names=["vec_id", "label", "v", "cell", "dist", "norm"])

    return run


class Tree:
    """A balanced tree of balls; levels[l] has 2^l nodes, the children of node i are 2i and 2i + 1."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int):
        depth = max(0, math.ceil(math.log2(max(1, len(x) / leaf))))
        order, cuts, every = np.argsort(ids, kind="stable"), np.array([0, len(x)]), []
        for level in range(depth + 1):
            every.append(cuts)
            if level < depth:
                middle = (cuts[:-1] + cuts[1:]) // 2
                for a, m, b in zip(cuts, middle, cuts[1:]):
                    spread = np.ptp(own := x[order[a:b]], 0)
                    if spread.any():  # equal rows stay in order of their vec_ids
                        order[a:b] = order[a:b][np.argpartition(own[:, spread.argmax()], m - a)]
                cuts = np.sort(np.r_[cuts, middle])
        self.order, self.x, self.ids, self.labels, self.cuts, self.depth = order, x[order], ids[order], labels[order], every, depth
        self.norm = float(np.sqrt((x * x).sum(1).max()))
        self.levels = []
        for cuts in every:
            at, count = cuts[:-1], np.diff(cuts)
            center = np.add.reduceat(self.x, at) / count[:, None]
            far = ((self.x - np.repeat(center, count, 0)) ** 2).sum(1)
            radius = np.sqrt(np.maximum.reduceat(far, at))
            self.levels.append((center, radius, np.sqrt((center * center).sum(1)), np.minimum.reduceat(self.labels, at), np.maximum.reduceat(self.labels, at), np.minimum.reduceat(self.ids, at)))


def possible(same: bool, low_a, high_a, low_c, high_c) -> np.ndarray:
    """Whether two label ranges can hold an equal (or with `same` false, a different) pair."""
    return (low_a <= high_c) & (high_a >= low_c) if same else ~((low_a == high_a) & (low_c == high_c) & (low_a == low_c))


class Wanted:
    """What anchors look for: in each band scores of at most `high` that are larger than `low`, or equal to it with a
    vec_id below `low_id` (NO_ID: all vec_ids). The first k of a band are kept."""

    def __init__(self, lows: np.ndarray, highs: np.ndarray, low_ids: np.ndarray, k: int = TOP):
        self.low, self.high, self.low_id, self.k = lows, highs, low_ids, k
        self.kept = np.zeros((4, 0), np.int64)  # anchor, band, score, vec_id

    def node_bounds(self, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each node's anchors: the least score that is looked for, the largest vec_id with it, the largest score."""
        at = cuts[:-1]
        return np.minimum.reduceat(self.low.min(1), at), np.maximum.reduceat(self.low_id.max(1), at), np.maximum.reduceat(self.high.max(1), at)

    def offer(self, anchor: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Scores of some anchors (rows) with some vectors (columns)."""
        new = [self.kept]
        for band in range(self.low.shape[1]):
            low, high, low_id = (x[anchor, band][:, None] for x in (self.low, self.high, self.low_id))
            r, c = np.nonzero(allowed & (scores <= high) & ((scores > low) | (scores == low) & (ids < low_id)))
            new.append(np.stack([anchor[r], np.full(len(r), band), scores[r, c], ids[c]]))
        if sum(x.shape[1] for x in new[1:]):
            rows = np.concatenate(new, 1)
            rows = rows[:, np.lexsort((rows[3], -rows[2], rows[1], rows[0]))]
            begin = np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(0)]
            first = np.flatnonzero(begin)
            rank = np.arange(rows.shape[1]) - np.repeat(first, np.diff(np.r_[first, rows.shape[1]]))
            self.kept = rows[:, rank < self.k]
            a, b, s, i = rows[:, rank == self.k - 1]
            self.low[a, b], self.low_id[a, b] = s, i


def search(anchors: Tree, rows: Tree, wanted: Wanted, same: bool) -> None:
    """Offer every score to `wanted` that it can still look for. Anchors are in their tree's order."""
    exact = anchors.norm * rows.norm < 2.0**52
    slack = 0.25 + 1e-9 * anchors.norm * rows.norm
    left = [x.astype(np.int64) if not exact else x for x in (anchors.x, rows.x)]

    def upper(la: int, lc: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest score of each pair of nodes that may still be wanted, and which pairs are left."""
        ca, ra, na, least_a, most_a, _ = anchors.levels[la]
        cc, rc, nc, least_c, most_c, id_c = rows.levels[lc]
        middle = np.einsum("pd,pd->p", ca[i], cc[j]) if len(i) * 4 < len(ca) * len(cc) else (ca @ cc.T)[i, j]
        reach = na[i] * rc[j] + nc[j] * ra[i] + ra[i] * rc[j] + slack
        top = np.floor(middle + reach)
        low, low_id, high = wanted.node_bounds(anchors.cuts[la])
        open_ = ((top > low[i]) | (top == low[i]) & (id_c[j] < low_id[i])) & (middle - reach <= high[i]) & possible(same, least_a[i], most_a[i], least_c[j], most_c[j])
        return top, open_

    la = lc = 0
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        top, open_ = upper(la, lc, i, j)
        i, j, top = i[open_], j[open_], top[open_]
        if not len(i) or (la == anchors.depth and lc == rows.depth):
            break
        if la < anchors.depth:
            i, j, la = np.r_[2 * i, 2 * i + 1], np.r_[j, j], la + 1
        if lc < rows.depth:
            i, j, lc = np.r_[i, i], np.r_[2 * j, 2 * j + 1], lc + 1
    order = np.lexsort((rows.levels[lc][5][j], -top, i))
    i, j = i[order], j[order]
    ends_a, ends_c = anchors.cuts[-1], rows.cuts[-1]
    for node in np.unique(i):
        leaves = j[i == node]
        anchor = np.arange(ends_a[node], ends_a[node + 1])
        for k in range(0, len(leaves), STEP):
            some = leaves[k : k + STEP]
            _, open_ = upper(la, lc, np.full(len(some), node), some)
            some = some[open_]
            if not len(some):
                continue
            at = np.concatenate([np.arange(ends_c[c], ends_c[c + 1]) for c in some])
            scores = (left[0][anchor] @ left[1][at].T).astype(np.int64)
            equal = anchors.labels[anchor][:, None] == rows.labels[at]
            allowed = equal & (anchors.ids[anchor][:, None] != rows.ids[at]) if same else ~equal
            wanted.offer(anchor, scores, rows.ids[at], allowed)


def _bands(column: pa.ChunkedArray) -> np.ndarray:
    flat = np.asarray(column.combine_chunks().flatten(), np.int64)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _blocks(same: bool):
    """The step over rows sorted by block, side and group: a block's vectors come first and are held, its anchors
    follow group by group."""

    def tree(rows: pa.Table, leaf: int) -> Tree:
        return Tree(matrix(rows.column("v")), rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), leaf)

    def answer(held: Tree, group: pa.Table) -> Iterator[pa.RecordBatch]:
        own = tree(group, ANCHOR_LEAF)
        wanted = Wanted(*(_bands(group.column(c))[own.order].copy() for c in ("lows", "highs", "low_ids")))
        search(own, held, wanted, same)
        a, band, score, ids = wanted.kept
        if len(a):
            keys = group.column("a_key").to_numpy()[own.order][a]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(band, pa.int32()), pa.array(ids), pa.array(score)], names=["a_key", "band", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block, now, parts = None, None, None, []

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal held, block
            if not parts:
                return
            rows = pa.Table.from_batches(parts)
            parts.clear()
            if now[1] == 0:
                held, block = tree(rows, LEAF), now[0]
            elif block == now[0]:
                yield from answer(held, rows)

        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = [*starts_of(batch, ["block", "side", "group_"]).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                mark = tuple(batch.column(c)[a].as_py() for c in ("block", "side", "group_"))
                if mark != now:
                    yield from done()
                    now = mark
                parts.append(batch.slice(a, b - a))
        yield from done()

    return run


def _send(cells, same: bool, first: bool):
    """Anchors of a group with the cells that may hold what they look for: the FIRST likeliest of them, or all that
    the anchor has not seen."""

    def work(group: pa.Table) -> pa.Table:
        x, labels = matrix(group.column("v")), group.column("label").to_numpy()
        number, center, radius, least, most, id_, blocks = cells.value[x.shape[1]]
        low, low_id, high = _bands(group.column("lows")).min(1), _bands(group.column("low_ids")).max(1), _bands(group.column("highs")).max(1)
        length, far = np.sqrt((x * x).sum(1)), np.sqrt((center * center).sum(1))
        slack = 0.25 + 1e-9 * float(length.max() * (far + radius).max())

        def left(middle, reach, label_low, label_high, low, low_id, high):
            top = np.floor(middle + reach + slack)
            return ((top > low) | (top == low) & (id_ < low_id)) & (middle - reach - slack <= high) & possible(same, label_low, label_high, least, most)

        ball = x.mean(0)
        around, size = np.sqrt(((x - ball) ** 2).sum(1).max()), np.sqrt(ball @ ball)
        some = left(center @ ball, size * radius + far * around + around * radius, labels.min(), labels.max(), low.min(), low_id.max(), high.max())
        middle, each = x @ center.T, lambda a: a[:, None]
        open_ = some & left(middle, each(length) * radius, each(labels), each(labels), each(low), each(low_id), each(high))
        if first:
            likely = np.argsort(np.where(open_, -middle, np.inf), 1, kind="stable")[:, FIRST:]
            np.put_along_axis(open_, likely, False, 1)
        else:
            for r, seen in enumerate(group.column("seen").to_pylist()):
                open_[r] &= ~np.isin(number, seen or [])
        r, c = np.nonzero(open_)
        out = group.select(SENT).take(pa.array(r, pa.int64()))
        return out.append_column("at", pa.array(number[c], pa.int32())).append_column("blocks", pa.array(blocks[c], pa.int32()))

    return work


def top(found: DataFrame, k: int = TOP) -> DataFrame:
    """The first k of each anchor and band, with their rank from 1."""
    order = Window.partitionBy("a_key", "band").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Index:
    """The rows of a table, dealt over cells and blocks."""

    def __init__(self, rows: DataFrame, divisor: int):
        self.spark = rows.sparkSession
        context, fitted = self.spark.sparkContext, fit(rows)
        routed = materialize(rows.mapInArrow(_route(context.broadcast(fitted)), ROWS), "routed")
        mine = F.col("vec_id") % divisor == 0
        sizes = routed.groupBy("cell").agg(F.count("*").alias("n"), F.sum(mine.cast("int")).alias("anchors"), F.max("dist").alias("radius"), F.min("label").alias("least"), F.max("label").alias("most"), F.min("vec_id").alias("id"), F.max(F.size("v")).alias("length"))
        sizes = sizes.collect()  # CELLS rows, and one for a length that was not sampled
        by_length: dict[int, list] = {}
        for r in sizes:
            begin, splits = fitted.get(r.length, (r.cell, None))
            center = splits.centers[r.cell - begin] if splits else np.zeros(r.length)
            by_length.setdefault(r.length, []).append((r.cell, center, r.radius, r.least, r.most, r.id, -(-r.n // BLOCK)))
        self.cells = context.broadcast({k: tuple(np.array(c) for c in zip(*v)) for k, v in by_length.items()})
        known = F.broadcast(self.spark.createDataFrame([(r.cell, -(-r.n // BLOCK), max(1, -(-r.anchors // GROUP))) for r in sizes], "cell int, blocks int, groups int"))
        part = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.col(n))
        routed = routed.join(known, "cell")
        self.rows = routed.select(_number("cell", part("blocks")).alias("block"), "vec_id", "label", "v")
        self.anchors = routed.where(mine).select(_number("cell", part("groups")).alias("group_"), F.xxhash64("vec_id", "label", "v").alias("a_key"), "vec_id", "label", "v").distinct()

    def _round(self, anchors: DataFrame, same: bool, first: bool) -> tuple[DataFrame, DataFrame]:
        """(found, sent): scores of a round, and which anchors went to which cells."""
        sent = materialize(by_group(anchors, ["group_"], _send(self.cells, same, first), SENT_SCHEMA), "sent")
        asked = sent.withColumn("block", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: _number("at", b)))).withColumn("side", F.lit(1))
        none = F.lit(None)
        held = self.rows.select("block", F.lit(0).alias("side"), F.lit(0).cast("long").alias("group_"), none.cast("long").alias("a_key"), "vec_id", "label", "v", *[none.cast("array<long>").alias(c) for c in ("lows", "highs", "low_ids")])
        both = held.unionByName(asked.select(*held.columns)).repartition("block").sortWithinPartitions("block", "side", "group_")
        return materialize(both.mapInArrow(_blocks(same), FOUND), "found"), sent

    def search(self, anchors: DataFrame, same: bool) -> DataFrame:
        """(a_key, band, vec_id, score, rank): the first of every band of anchors (group_, a_key, vec_id, label, v, lows,
        highs), from rows of the same label or of other ones. All have as many bands; one from MOST to LEAST holds nothing."""
        free_id = lambda x: F.when(x == MOST, F.lit(LEAST)).otherwise(F.lit(NO_ID))
        found, sent = self._round(anchors.withColumn("low_ids", F.transform("lows", free_id)), same, True)
        full = top(found).where(F.col("rank") == TOP).groupBy("a_key").agg(F.map_from_entries(F.collect_list(F.struct("band", F.struct("score", "vec_id")))).alias("full"))
        seen = sent.groupBy("a_key").agg(F.collect_set("at").alias("seen"))
        rest = anchors.join(full, "a_key", "left").join(seen, "a_key", "left")
        reached = F.transform("lows", lambda x, i: F.coalesce(F.col("full")[i], F.struct(x.alias("score"), free_id(x).alias("vec_id"))))
        rest = rest.withColumn("reached", reached).withColumn("lows", F.col("reached.score")).withColumn("low_ids", F.col("reached.vec_id"))
        more, _ = self._round(rest, same, False)
        return top(found.unionByName(more))


def _number(cell: str, part: Column) -> Column:
    return F.col(cell).cast("long") * (1 << 20) + part


def hard_negatives(vectors: DataFrame, label: Column | None = None, divisor: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors, whose vec_id is
    divisible by `divisor`."""
    index = Index(materialize(integer_rows(vectors, F.col("label") if label is None else label), "integers"), divisor)
    wide = index.anchors.select("group_", "a_key", "vec_id", "label", "v", F.array(F.lit(LEAST)).alias("lows"), F.array(F.lit(MOST)).alias("highs"))
    positives = materialize(index.search(wide, same=True).where("score >= 0").select("a_key", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    least = F.expr(f"(positive_score * {SHARE_LOW} + 99) div 100")
    bands = positives.select("a_key", F.struct("place", least.alias("low"), F.expr(f"positive_score * {SHARE_HIGH} div 100").alias("high")).alias("b")).groupBy("a_key").agg(F.sort_array(F.collect_list("b")).alias("b"))
    padded = lambda side, none: F.slice(F.concat(F.transform("b", lambda b: b[side]), F.array_repeat(F.lit(none), TOP)), 1, TOP)
    asked = index.anchors.join(bands, "a_key").select("group_", "a_key", "vec_id", "label", "v", padded("low", MOST).alias("lows"), padded("high", LEAST).alias("highs"))
    found = index.search(asked, same=False).select("a_key", (F.col("band") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = positives.join(index.anchors.select("a_key", F.col("vec_id").alias("anchor_id")), "a_key")
    return named.join(found, ["a_key", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
