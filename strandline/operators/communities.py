"""Communities of a weighted graph by greedy modularity, with moves that cannot harm each other, and hubs.

A turn looks for every node's best move and then makes many of them at once, such that modularity rises for certain:

* Moves are ranked by gain, equal ones by a luck that is drawn anew each turn. A community whose best move out ranks above its best move in only gives nodes in
  this turn, the others only receive. Moves from a giver to a receiver remain, so no node leaves a community that
  another one joins for its sake. Between such moves links can only add to the gain.
* What is left between two of them is that both make the same community larger, or leave the same one: that costs
  the product of their strengths. Each move bears half of that for all others of its community, the whole for the
  highest ranked one, and is made if it still gains. The best move of all bears nothing, so every turn moves a node.

Modularity is 1 at most and rises by 2 * SAME at least with every turn, which bounds the turns; a level ends when no
node has a move that gains. All this is grouped sums and joins by community, however large one is.

Such turns are many, and each reads all links. A level is therefore swept node by node in tasks where it can be: nodes
are dealt to blocks, each block with SMALL links or so within it, and a task moves its nodes, from a community of
their own each, among the communities of the block until none gains. All members of these are in the block, so each gain is exact whatever
other tasks do, and modularity rises. What is left over between blocks is joined by the next levels, whose nodes are the
communities, dealt anew; they have fewer links and so fewer blocks, at last one. Nodes with one neighbour join it
before, where they are many. Turns remain for levels that no blocks make small enough, like those with a node of more links than blocks
can part."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from strandline.operators.analysis import PERCENTILE, both_ways, degrees, hub_set, projection
from strandline.plans.runtime import Replaced, cut

#: A smaller gain of a move (half the rise of modularity) is none.
SAME = 1e-9
#: Links, counted from both ends, that one task sweeps: some 10 MB, and twice as many at most.
SMALL = 1 << 18
#: Blocks of a level at most.
BLOCKS = 1 << 12
#: Nodes with one neighbour join it in a level of their own if at least one link of so many is theirs.
LONE = 8


def modularity(membership: DataFrame, weights: DataFrame, resolution: float = 1.0) -> float:
    """Of (id, community) and weights (a, b, w), loops allowed; 0 without weights."""
    end = lambda x: membership.select(F.col("id").alias(x), F.col("community").alias(f"c{x}"))
    rows = weights.join(end("a"), "a").join(end("b"), "b")
    ends = rows.select(F.explode(F.array("ca", "cb")).alias("c"), "w").groupBy("c").agg(F.sum("w").alias("tot"))
    total, inside = rows.agg(F.sum("w"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")))).first()
    squares = ends.agg(F.sum(F.col("tot").cast("double") ** 2)).first()[0]
    return (inside or 0) / total - resolution * squares / (2 * total) ** 2 if total else 0.0


def _wishes(state: DataFrame, links: DataFrame, total: float, resolution: float) -> DataFrame:
    """(id, c, to, k, gain, rank) of the nodes with a move that gains: their best one, the least community on a tie.
    Gains count in units of a half of total^2, as all that is made of them."""
    at = state.join(state.groupBy("c").agg(F.sum("k").alias("tot")), "c")
    theirs = at.select(F.col("id").alias("dst"), F.col("c").alias("to"), F.col("tot").alias("theirs"))
    near = links.join(theirs, "dst").groupBy(F.col("src").alias("id"), "to").agg(F.sum("w").alias("kin"), F.max("theirs").alias("theirs"))
    rows, k, elsewhere = near.join(at, "id"), F.col("k").cast("double"), F.col("to") != F.col("c")
    value = F.col("kin") * F.lit(total) - F.lit(resolution) * F.col("theirs") * k
    best = rows.groupBy("id").agg(
        F.min("c").alias("c"), F.min("k").alias("k"), F.min("luck").alias("luck"), F.min("tot").alias("tot"), F.coalesce(F.max(F.when(~elsewhere, F.col("kin"))), F.lit(0)).alias("kin"),
        F.min(F.when(elsewhere, F.struct((-value).alias("less"), "to"))).alias("best"),
    )
    gain = -F.col("best.less") - (F.col("kin") * F.lit(total) - F.lit(resolution) * (F.col("tot") - F.col("k")) * k)
    found = best.where("best is not null").select("id", "c", F.col("best.to").alias("to"), "k", gain.alias("gain"), "luck").where(F.col("gain") > SAME * total * total)
    return found.select("id", "c", "to", "k", "gain", F.struct("gain", "luck", "id").alias("rank"))


def _sound(wishes: DataFrame, resolution: float) -> DataFrame:
    """(id, to): those of the moves that can be made at the same time."""
    out = wishes.groupBy("c").agg(F.max("rank").alias("out"))
    into = wishes.groupBy(F.col("to").alias("c")).agg(F.max("rank").alias("into"))
    givers = out.join(into, "c", "left").where("into is null or out > into").select("c")
    moves = wishes.join(givers, "c", "left_semi").join(givers.select(F.col("c").alias("to")), "to", "left_anti")
    load: Column = F.lit(0)
    for end in ("c", "to"):
        of_end = moves.groupBy(end).agg(F.sum("k").alias(f"sum_{end}"), F.max(F.struct("rank", "k")).alias(f"top_{end}"))
        moves = moves.join(of_end, end)
        load = load + F.when(F.col("rank") == F.col(f"top_{end}.rank"), 0).otherwise(F.col(f"sum_{end}") - F.col("k") + F.col(f"top_{end}.k"))
    return moves.where(F.col("gain") > F.lit(resolution / 2) * F.col("k").cast("double") * load).select("id", "to")


def _level(nodes: DataFrame, links: DataFrame, strength: DataFrame, total: float, resolution: float, seen=None) -> DataFrame:
    """(id, c): each node in a community of its own at first, and then moved until no move gains. `seen` is called
    with the state after each turn."""
    state_of, wishes_of = Replaced(), Replaced()
    start = nodes.join(strength, "id", "left").select("id", F.col("id").alias("c"), F.coalesce("k", F.lit(0)).alias("k"), F.xxhash64("id").alias("luck"))
    state, _ = state_of(start)
    while True:
        wishes, n = wishes_of(_wishes(state, links, total, resolution))
        if not n:
            return state.select("id", "c")
        moved = state.join(_sound(wishes, resolution), "id", "left")
        state, _ = state_of(moved.select("id", F.coalesce("to", "c").alias("c"), "k", F.xxhash64("luck").alias("luck")))
        if seen is not None:
            seen(state.select("id", F.col("c").alias("community")))


def _sweep(total: float, resolution: float):
    """The step over the links (src, dst, w, k, need) of one block: (id, c) of its nodes. k is the strength of src, need
    what its move has to gain: as much as by its best link, which may lead to another block."""

    def run(rows: pa.Table) -> pa.Table:
        names = pa.chunked_array([*rows.column("src").chunks, *rows.column("dst").chunks]).unique().sort()
        place = lambda c: np.asarray(pc.index_in(rows.column(c), value_set=names))
        src, dst, w, n = place("src"), place("dst"), rows.column("w").to_numpy(), len(names)
        k, need = np.zeros(n), np.zeros(n)
        k[src], need[src] = rows.column("k").to_numpy(), rows.column("need").to_numpy()
        order = np.lexsort((dst, src))
        cuts, ends, weights = np.searchsorted(src[order], np.arange(n + 1)).tolist(), dst[order].tolist(), w[order].tolist()
        c, tot, k, need = list(range(n)), k.tolist(), k.tolist(), need.tolist()
        least, moved = SAME * total * total, True
        while moved:
            moved = False
            for x in range(n):
                own, near = c[x], {}
                for i in range(cuts[x], cuts[x + 1]):
                    y = c[ends[i]]
                    near[y] = near.get(y, 0) + weights[i]
                stay = near.pop(own, 0) * total - resolution * (tot[own] - k[x]) * k[x]
                if near:
                    gain, to = max((kin * total - resolution * tot[y] * k[x], -y) for y, kin in near.items())
                    if gain - stay > least and gain > need[x] - least:
                        tot[own] -= k[x]
                        c[x], moved = -to, True
                        tot[-to] += k[x]
        return pa.table({"id": names, "c": names.take(pa.array(c))})

    return run


def _lone(best: DataFrame, least: float, resolution: float) -> DataFrame:
    """(id, c): nodes with one neighbour that gain by joining it, all of them at once. Each bears half of what all
    others that join the same node cost it."""
    ends = best.select(F.col("id").alias("to"), (F.col("n") == 1).alias("lone"))
    moves = best.where((F.col("n") == 1) & (F.col("gain") > least)).join(ends, "to").where(~F.col("lone") | (F.col("id") > F.col("to")))
    moves = moves.join(moves.groupBy("to").agg(F.sum("k").alias("all")), "to")
    return moves.where(F.col("gain") > F.lit(resolution / 2) * F.col("k").cast("double") * (F.col("all") - F.col("k"))).select("id", F.col("to").alias("c"))


def _blocks(links: DataFrame, best: DataFrame, size: int, turn: int) -> DataFrame | None:
    """links with their block, those within one block only; None if no number of blocks makes them small enough.
    Nodes are dealt by hash, anew for each turn, but two nodes that are each other's best move stay together."""
    back = best.select(F.col("id").alias("to"), F.col("to").alias("back"))
    lead = cut(best.join(back, "to").select("id", F.when(F.col("back") == F.col("id"), F.least("id", "to")).otherwise(F.col("id")).alias("lead"), F.col("gain").alias("need")))
    parts = math.ceil((size / SMALL) ** 0.5) if SMALL else math.inf  # of so many blocks each has size / parts^2 links
    while parts <= BLOCKS:
        home = lead.select("id", "need", F.pmod(F.xxhash64("lead", F.lit(turn)), F.lit(parts)).alias("block"))
        inner = links.join(home.withColumnRenamed("id", "src"), "src").join(home.select(F.col("id").alias("dst"), "block"), ["dst", "block"])
        inner = cut(inner.select("block", "src", "dst", "w", "k", "need"))
        if (inner.groupBy("block").count().agg(F.max("count")).first()[0] or 0) <= 2 * SMALL:
            return inner
        parts *= 2
    return None


def communities(ids: DataFrame, weights: DataFrame, resolution: float = 1.0, seen=None) -> DataFrame:
    """(id, community) by greedy modularity: levels of moves (see above), whose communities are the nodes of the next
    level, until no two of them gain by becoming one. A community is named by its least member. ids: (id); weights:
    (a, b, w), loops allowed."""
    membership, weights, turn = cut(ids.select("id", F.col("id").alias("community"))), cut(weights), 0
    while True:
        both = both_ways(weights.where("a <> b"))
        loops = weights.where("a = b").groupBy(F.col("a").alias("id")).agg((2 * F.sum("w")).alias("k"))
        strength = cut(both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")).unionByName(loops).groupBy("id").agg(F.sum("k").alias("k")))
        total = float(strength.agg(F.sum("k")).first()[0] or 0)
        if total <= 0:
            break
        least = SAME * total * total
        ends = both.join(strength.withColumnRenamed("id", "src"), "src").join(strength.select(F.col("id").alias("dst"), F.col("k").alias("other")), "dst")
        gain = F.col("w") * F.lit(total) - F.lit(resolution) * F.col("other") * F.col("k").cast("double")
        links = cut(ends.select("src", "dst", "w", "k", gain.alias("gain")))
        size, gains = links.agg(F.count("*"), F.count_if(F.col("gain") > least)).first()
        if not gains:
            break
        state = _joined(links, strength, size, turn, total, resolution, seen)
        least_of = state.groupBy("c").agg(F.min("id").alias("name"))
        state = cut(state.join(least_of, "c").select("id", F.col("name").alias("c")))
        if not state.where("id <> c").limit(1).count():
            break
        known = state.withColumnRenamed("id", "community")
        membership = cut(membership.join(known, "community", "left").select("id", F.coalesce("c", "community").alias("community")))
        end = lambda x, y: state.select(F.col("id").alias(x), F.col("c").alias(y))  # noqa: E731, B023
        joined = weights.join(end("a", "ca"), "a").join(end("b", "cb"), "b")
        weights = cut(joined.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w")))
        turn += 1
    named = membership.groupBy("community").agg(F.min("id").alias("name"))
    return membership.join(named, "community").select("id", F.col("name").alias("community"))


def _joined(links: DataFrame, strength: DataFrame, size: int, turn: int, total: float, resolution: float, seen=None) -> DataFrame:
    """(id, c) of all nodes with a strength: what one level makes of them."""
    if size <= SMALL:
        inner = links.select(F.lit(0).alias("block"), "src", "dst", "w", "k", F.lit(-math.inf).alias("need"))  # no other block
    else:
        # of the best moves of all the one between the least names is the best of both its ends, so a level joins two nodes at least
        rank = F.struct("gain", F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high"))
        best = cut(links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.min("k").alias("k"), F.max("gain").alias("gain"), F.max_by("dst", rank).alias("to")))
        lone = cut(_lone(best, SAME * total * total, resolution))
        if SMALL and lone.count() * 2 * LONE > size:
            return strength.select("id").join(lone, "id", "left").select("id", F.coalesce("c", "id").alias("c"))
        inner = _blocks(links, best, size, turn)
        if inner is None:
            return _level(strength.select("id"), links.select("src", "dst", "w"), strength, total, resolution, seen)
    kind = strength.schema["id"].dataType
    swept = inner.groupBy("block").applyInArrow(_sweep(total, resolution), StructType([StructField("id", kind), StructField("c", kind)]))
    return strength.select("id").join(swept, "id", "left").select("id", F.coalesce("c", "id").alias("c"))


def attach_hubs(hubs: DataFrame, weights: DataFrame, membership: DataFrame) -> DataFrame:
    """(key, community) of the hubs (key), in order of their keys: each joins the community of its strongest neighbour
    (the least key on a tie) among the nodes of `membership` (key, community) and the hubs before it; without one it is
    a community of its own.

    Which neighbour that is does not depend on communities, so every hub points to a node or to a lower hub, and the
    chains are followed in rounds that double their reach: as many as the logarithm of the longest chain."""
    hub = hubs.select(F.col("key").alias("src"))
    near = both_ways(weights).join(hub, "src", "left_semi")
    known = membership.select(F.col("key").alias("dst"), "community")
    lower = near.join(hubs.select(F.col("key").alias("dst")), "dst", "left_semi").where("dst < src")
    rows = near.join(known, "dst").select("src", "dst", "w", "community").unionByName(lower.select("src", "dst", "w", F.lit(None).cast(membership.schema["community"].dataType).alias("community")))
    best = rows.groupBy("src").agg(F.min_by(F.struct("dst", "community"), F.struct(-F.col("w"), F.col("dst"))).alias("best"))
    own = hub.join(best, "src", "left")
    alone = F.when(F.col("best").isNull(), F.col("src").cast(membership.schema["community"].dataType))
    chains = Replaced()
    now, waiting = chains(own.select("src", F.coalesce(alone, F.col("best.community")).alias("community"), F.when(F.col("best").isNotNull() & F.col("best.community").isNull(), F.col("best.dst")).alias("next")), "next is not null")
    while waiting:
        ahead = now.select(F.col("src").alias("next"), F.col("community").alias("found"), F.col("next").alias("further"))
        now, waiting = chains(now.join(ahead, "next", "left").select("src", F.coalesce("community", "found").alias("community"), F.when(F.coalesce("community", "found").isNull(), F.col("further")).alias("next")), "next is not null")
    return now.select(F.col("src").alias("key"), "community")


def detect(nodes: DataFrame, edges: DataFrame, percentile: float = PERCENTILE, resolution: float = 1.0) -> DataFrame:
    """(key, community) of all eligible nodes: communities without the hubs, which are attached afterwards."""
    weights = cut(projection(nodes, edges))
    degree = cut(degrees(nodes, weights))
    top = cut(hub_set(degree, percentile).select("key"))
    rest = degree.select("key").join(top, "key", "left_anti").select(F.col("key").alias("id"))
    inner = weights.join(top.withColumnRenamed("key", "a"), "a", "left_anti").join(top.withColumnRenamed("key", "b"), "b", "left_anti")
    found = cut(communities(rest, inner, resolution)).withColumnRenamed("id", "key")
    return found.unionByName(attach_hubs(top, weights, found))
