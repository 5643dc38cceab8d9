"""How the filters of a cleaning run interact: every order of them, from one mask of failures for each document.

A document's mask has a bit for each filter that it fails. What an order of filters removes at a step follows from
the mask alone, so the documents are read once, whatever the number of orders: masks are counted by part, and all
orders are worked out from these additive counters (2^filters rows a part).

One filter fails documents whose text a smaller doc_id has too. It is found by sorting, without a group of equal texts:

1. Documents are dealt by ranges of (fingerprint of the text, doc_id) and sorted by (fingerprint, text, doc_id), so
   copies of one text fill as many partitions as they need.
2. Within a partition a row with the text of its predecessor and a larger doc_id than the first of that text is a
   duplicate. Only the first ones of a partition's first fingerprint are open; their rows keep the text.
3. Every partition also reports text and least doc_id of its last fingerprint. The least of all reports on a text,
   two or so for each partition, settles the open rows.

Null texts count as empty. A row without a doc_id is never a duplicate and makes none; rows that repeat a doc_id and
text are no duplicates of each other. A null part counts as the empty string, a document counts as good or toxic if
any of its label rows says so, labels of unknown documents are not read. An empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import materialize

#: The filter that fails texts of a smaller doc_id; the others' names are the keys of FILTERS.
DUPLICATE = "E"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SORTED_SCHEMA = "doc_id long, part string, mask int, kind int, fingerprint long, text string"
#: Kinds of rows: settled, open, and a report without a document.
SETTLED, OPEN, REPORT = 0, 1, 2


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[ \t-\r]+"), "")


#: Failure conditions by name, as functions of the text's column.
FILTERS = {
    "A": lambda text: F.size(_words(text)) < 200,
    "B": lambda text: 100 * F.size(F.array_distinct(_words(text))) < 50 * F.size(_words(text)),
    "C": lambda text: 100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))) > 3 * F.length(text),
    "D": lambda text: text.rlike("[#$%&*|]"),
}


def _compare(bit: int):
    """The step over sorted partitions: masks with the duplicates' bit, open rows, and reports."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None  # fingerprints
        runs: list[tuple[str, int]] = []  # (text, least doc_id) of the last fingerprint's texts
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            prints, texts, ids = np.asarray(batch.column("fingerprint")), batch.column("text"), batch.column("doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            doc = ids.fill_null(0).to_numpy()
            same = np.zeros(n, bool)
            near = np.flatnonzero(prints[1:] == prints[:-1]) + 1
            same[near] = pc.equal(texts.take(pa.array(near)), texts.take(pa.array(near - 1))).to_numpy(zero_copy_only=False)
            carried = runs[-1][1] if runs and last == prints[0] and runs[-1][0] == texts[0].as_py() else None
            begin = np.flatnonzero(~same)
            least = np.where(known[begin], doc[begin], np.iinfo(np.int64).max)  # doc_ids are sorted, nulls last
            if carried is not None:
                least[0] = min(least[0], carried)
            mine = np.repeat(least, np.diff(np.r_[begin, n]))
            first = prints[0] if first is None else first
            copies, opened = known & (doc > mine), known & (doc == mine) & (prints == first)
            mask = np.asarray(batch.column("mask")) | np.where(copies, bit, 0)
            bare = pa.array(~opened)
            columns = [ids, batch.column("part"), pa.array(mask, pa.int32()), pa.array(np.where(opened, OPEN, SETTLED), pa.int32())]
            columns += [pc.if_else(bare, pa.scalar(None, x.type), x) for x in (batch.column("fingerprint"), texts)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "mask", "kind", "fingerprint", "text"])
            tail = begin[prints[begin] == prints[-1]]
            fresh = [(texts[int(i)].as_py(), int(x)) for i, x in zip(tail, least[prints[begin] == prints[-1]])]
            if last == prints[-1] and runs:
                runs = [*(runs[:-1] if carried is not None else runs), *fresh]
            else:
                runs = fresh
            last = prints[-1]
        found = [(t, d) for t, d in runs if d != np.iinfo(np.int64).max]
        if found:
            k = len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for _, d in found], pa.int64()), pa.nulls(k, pa.string()), pa.array([0] * k, pa.int32()), pa.array([REPORT] * k, pa.int32()), pa.array([int(last)] * k, pa.int64()), pa.array([t for t, _ in found], pa.string())],
                names=["doc_id", "part", "mask", "kind", "fingerprint", "text"],
            )

    return run


def failure_masks(docs: DataFrame, part: str = "lang", filters: dict = FILTERS, duplicate: str = DUPLICATE) -> DataFrame:
    """(doc_id, part, mask) of every document; filter number k, in the order of `filters` and then `duplicate`, is
    bit 2^k."""
    bit = 1 << len(filters)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("fingerprint"))
    rows = rows.repartitionByRange("fingerprint", "doc_id").sortWithinPartitions("fingerprint", "text", F.asc_nulls_last("doc_id"))
    fails = [F.when(f(F.col("text")), 1 << k).otherwise(0) for k, f in enumerate(filters.values())]
    rows = rows.withColumn("mask", reduce(Column.bitwiseOR, fails, F.lit(0)).cast("int"))
    found = materialize(rows.select("doc_id", "part", "mask", "fingerprint", "text").mapInArrow(_compare(bit), SORTED_SCHEMA), "masks")
    least = found.where(F.col("kind") != SETTLED).groupBy("fingerprint", "text").agg(F.min("doc_id").alias("least"))
    settled = found.where(F.col("kind") == OPEN).join(least, ["fingerprint", "text"])
    settled = settled.withColumn("mask", F.when(F.col("doc_id") > F.col("least"), F.col("mask").bitwiseOR(F.lit(bit))).otherwise(F.col("mask")))
    return found.where(F.col("kind") == SETTLED).select("doc_id", "part", "mask").unionByName(settled.select("doc_id", "part", "mask"))


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): numbers of documents, additive over any split of the documents."""
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return masks.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def orders(counts: DataFrame, names: str) -> DataFrame:
    """For every part, order of the filters and step, what the step does: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, and shapley, the filter's removals over all orders."""
    bits = lambda some: reduce(Column.__add__, [F.when(F.instr(some, x) > 0, 1 << k).otherwise(0) for k, x in enumerate(names)])
    every = F.array(*[F.lit("".join(p)) for p in permutations(names)])
    rows = counts.withColumn("filter_order", F.explode(every)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(names)))))
    rows = rows.withColumn("filter", F.substr("filter_order", "step", F.lit(1))).withColumn("before", F.col("mask").bitwiseAND(bits(F.substr("filter_order", F.lit(1), F.col("step") - 1)))).withColumn("bit", bits(F.col("filter")))
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("before") != 0
    total = lambda where, what="n": F.sum(F.when(where, F.col(what)).otherwise(0)).cast("long")
    steps = rows.groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", filters: dict = FILTERS, duplicate: str = DUPLICATE) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    counts = materialize(counters(failure_masks(docs, part, filters, duplicate), labels), "counters")
    return orders(counts, "".join(filters) + duplicate)
