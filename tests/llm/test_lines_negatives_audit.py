"""Line dedup, hard negatives and the filter audit against brute force, with odd rows, ties, copies and empty tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import filter_audit, hard_negatives, line_dedup, queries

DATA = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
NAN, INF = float("nan"), float("inf")


# 11


def brute_negatives(rows, divisor, top=5):
    """From (vec_id, label, components) with unique vec_ids."""
    some = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            v = [math.floor(Fraction(x) * 256) for x in v]
            if sum(x * x for x in v) < 1 << 56:
                some[i] = (label, v)
    out = []
    for a, (label, v) in some.items():
        if a % divisor:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in some.items() if i != a and len(w) == len(v)))
        for p, i, _ in [x for x in scored if x[2] == label][:top]:
            near = [x for x in scored if x[2] != label and 80 * -p <= 100 * -x[0] <= 100 * -p][:top]
            out += [(a, i, r + 1, n, -p, -s) for r, (s, n, _) in enumerate(near)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<float>, v int, cell string, score double, side int"


def mined(spark, rows, divisor):
    df = spark.createDataFrame([(*r, 1, "x", 0.5, 2) for r in rows], VECTORS).repartition(3)
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, divisor=divisor).collect())


def vectors(n, dim, seed, centers=6, spread=0.3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centers, dim))
    return [(i, int(rng.integers(0, 4)), [float(np.float32(x)) for x in middle[i % centers] + spread * rng.normal(size=dim)]) for i in range(n)]


def test_negatives_match_brute_force_over_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 40)
    monkeypatch.setattr(hard_negatives, "BLOCK", 60)
    monkeypatch.setattr(hard_negatives, "GROUP", 7)
    rows = vectors(900, 5, 1)
    got = mined(spark, rows, 10)
    assert got == brute_negatives(rows, 10) and len(got) > 300


def test_negatives_of_odd_rows(spark):
    rows = vectors(120, 3, 2, spread=1.0)
    rows += [(1000, None, [1.0, 0.0, 0.0]), (1001, 1, None), (1002, 1, [NAN, 0.0, 0.0]), (1003, 1, [INF, 1.0, 1.0]), (1004, 2, [None, 1.0, 1.0]), (None, 1, [9.0, 9.0, 9.0])]
    rows += [(1005, 1, []), (1006, 2, []), (1010, 1, []), (1011, 1, [1.0]), (1020, 2, [1.0]), (1030, 1, [1e30, 0.0, 0.0]), (1040, 1, [0.0, 0.0, 0.0]), (1050, 3, [-1e-3, 2e5, -2e5])]
    got = mined(spark, rows, 10)
    assert got == brute_negatives(rows, 10) and {r[0] for r in got} >= {1010}


def test_negatives_with_ties_and_one_vector_for_a_third(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 50)
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 50)
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 3)), [1.0, 2.0, -1.0] if i % 3 else [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(600)]
    got = mined(spark, rows, 20)
    assert got == brute_negatives(rows, 20) and got


def test_negatives_at_the_band_ends(spark):
    score = lambda s: [s / 256, 0.0]  # noqa: E731 - with the anchor (1, 0): 256 * s
    rows = [(0, 1, [1.0, 0.0]), (1, 1, score(100)), (2, 2, score(80)), (3, 2, score(79)), (4, 2, score(100)), (5, 2, score(101)), (6, 3, score(90))]
    assert mined(spark, rows, 100) == brute_negatives(rows, 100) == [(0, 1, 1, 4, 25600, 25600), (0, 1, 2, 6, 25600, 23040), (0, 1, 3, 2, 25600, 20480)]
    assert mined(spark, [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-0.9])], 100) == []


def test_negatives_of_repeated_rows_and_an_empty_table(spark):
    rows = vectors(60, 3, 5)
    twice = mined(spark, rows + [rows[0], rows[3], rows[3]], 10)
    assert {r[0] for r in twice} == {r[0] for r in mined(spark, rows, 10)} and all(0 != r[1] for r in twice if r[0] == 0)
    assert max(Counter(r[:3] for r in twice).values()) <= 3  # a positive that stands three times
    assert mined(spark, [], 10) == []


# 12


def brute_lines(docs, least=40, most=5):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    held = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= least:
                held[key(line)].add(i)
    last = {k: max(v) for k, v in held.items() if len(v) >= most}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or last.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def cleaned(spark, docs, **limits):
    df = spark.createDataFrame([(i, t, "x", -1, b"k", 3) for i, t in docs], "doc_id long, text string, key string, n_lines int, digest binary, owner int").repartition(4)
    found, names = line_dedup.dedup_lines(df, **limits)
    assert not set(names) & set(df.columns) and found.columns[:6] == df.columns
    return sorted((tuple(r) for r in found.select("doc_id", *names).collect()), key=str)


LONG, WIDE = "A line of forty characters and some more, Shared", "日本語" * 13 + "é"
LINES = [
    *[(i, f"own {i}\n \t{LONG}\x0b\nshort\n{LONG.upper()}") for i in range(6)], (6, LONG.lower()), (7, LONG[:39]), (8, f"{WIDE}\r\n{WIDE[:39]}"), *[(i, WIDE + "\n" + "é" * 39 + "\n" + WIDE[:39]) for i in range(9, 14)],
    *[(i, "É" + "x" * 40 if i % 2 else "é" + "x" * 40) for i in range(14, 20)], *[(i, "only four documents hold this line of text, so it stays") for i in range(20, 24)], (24, None), (25, ""), (26, "\n\n"),
    (27, "z" * 200_000 + "\n" + LONG), (30, LONG), (30, LONG), (30, "twice " * 10), *[(31, "twice " * 10)] * 6, (None, LONG), (None, None), (32, "\x1c" + LONG),
]


def test_lines_match_brute_force(spark):
    got = cleaned(spark, LINES)
    assert got == brute_lines(LINES) and sum(r[2] for r in got) > 15
    assert cleaned(spark, []) == []


@pytest.mark.parametrize("bits", [64, 1 << 10])
def test_full_filters_change_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(line_dedup, "MIN_BITS", 64)
    assert cleaned(spark, LINES, max_bits=bits) == brute_lines(LINES)
    assert cleaned(spark, LINES, min_points=3, min_docs=2, max_bits=bits) == brute_lines(LINES, 3, 2)


def test_lines_of_the_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op12_line_dedup(spark, DATA).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str)
    assert got == sorted([(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute_lines(docs)], key=str)


def test_filters_of_two_tasks_are_united():
    rng = np.random.default_rng(4)
    hashes = rng.integers(0, 1 << 64, 600, dtype=np.uint64)
    one, two = line_dedup.Filters(1 << 16), line_dedup.Filters(1 << 16)
    one.add(hashes[:400])
    two.add(hashes[300:])
    two.add(hashes[550:])
    twice = one.twice | two.twice | (one.once & two.once)
    found = line_dedup.Filters.has(twice, line_dedup.places(hashes, 1 << 16))
    assert found[300:400].all() and found[550:].all() and found[:300].sum() + found[400:550].sum() <= 3


# 13


def brute_masks(docs):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t, part in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > first[t])
        out.append((i, part or "", sum(1 << k for k, f in enumerate(fails) if f)))
    return sorted(out, key=str)


def brute_audit(docs, labels):
    good, toxic = ({i for i, *v in labels if v[k] == 1} for k in (0, 1))
    rows, removed = {}, Counter()
    masks = [(i, part, {x for k, x in enumerate("ABCDE") if m >> k & 1}) for i, part, m in brute_masks(docs)]
    for order in map("".join, permutations("ABCDE")):
        for step, x in enumerate(order, 1):
            before = set(order[: step - 1])
            for part in {p for _, p, _ in masks}:
                mine = [(i, f) for i, p, f in masks if p == part]
                gone = [i for i, f in mine if x in f and not f & before]
                removed[part, x] += len(gone)
                rows[part, order, step] = [sum(not f & (before | {x}) for _, f in mine), len(gone), sum(x in f and bool(f & before) for _, f in mine), sum(f == {x} for _, f in mine), sum(i in good for i in gone), sum(i in toxic for i in gone), x]
    return sorted((*k, *v[:-1], removed[k[0], v[-1]]) for k, v in rows.items())


WORDS = " ".join(f"w{i}" for i in range(250))
AUDIT = [
    *[(i, WORDS, "en") for i in range(40)], *[(i, WORDS, "de") for i in (3, 3, 50)], (None, WORDS, "de"), (41, None, None), (42, "", "fr"), (43, "A B C #", "fr"), (44, "word " * 300, "en"), (45, "word\x0b" * 300 + "|", "fr"),
    (46, WORDS + " X Y Z" * 20, ""), (47, "a b" * 9, "en"), (48, "a b" * 9, "fr"), (48, "a b" * 9, "fr"), (49, "ÀÉ日本 " * 250, "de"), (60, "x" * 50_000 + " $", "en"), (-1, "word " * 300, None),
]
LABELS = [(0, 1, 0), (5, 1, 1), (5, 0, 1), (5, 1, None), (41, None, 1), (44, 1, 0), (99, 1, 1), (None, 1, 1), (48, 1, 1)]
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.fixture
def many_partitions(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    for k, v in zip(kept, ("13", "false", "3")):
        spark.conf.set(k, v)
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_masks_across_partitions(spark, many_partitions):
    docs = spark.createDataFrame([(*r, 1, "p") for r in AUDIT], "doc_id long, text string, lang string, mask int, part string").repartition(5)
    got = sorted((tuple(r) for r in filter_audit.failure_masks(docs).collect()), key=str)
    assert got == brute_masks(AUDIT)


def test_audit(spark):
    docs = spark.createDataFrame([(*r, 1, "p") for r in AUDIT], "doc_id long, text string, lang string, mask int, part string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels)
    assert sorted(tuple(r) for r in got.select(*COLUMNS).collect()) == brute_audit(AUDIT, LABELS)
    assert filter_audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0
    assert filter_audit.audit(docs.limit(0), labels).count() == 0


def test_audit_with_other_filters(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "bb", "y")], "doc_id long, text string, source string")
    got = filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), "source", {"S": lambda t: F.length(t) < 2}, "T")
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in got.where("part = 'x'").collect()} == {("x", "ST", 1): (0, 2, 0, 3), ("x", "ST", 2): (0, 0, 1, 1), ("x", "TS", 1): (1, 1, 0, 1), ("x", "TS", 2): (0, 1, 1, 3)}
