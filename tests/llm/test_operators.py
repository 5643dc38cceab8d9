"""Every operator against brute force or the library, with nulls, empty and long texts, ties, repeated rows,
empty tables and extra columns with clashing names."""

import hashlib
import lzma
import re
import time
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandline.llm import bpe, decontaminate, embedding_dedup, language_id, license_scan, near_dedup, range_coder, token_files, toxicity, url_filter
from strandline.llm.components import connected

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " \n\t ", "word", "Don't 'RE 'll it's", "<|endoftext|>x y<|startoftext|>", "a  b　c  d", "é É ﬁ 日本語 🙂🙂", "x" * 3000, "to be or not to be " * 400, "to be or not to be " * 400, " lead", "trail ", "a\x1cb 12345"]
DOC = "doc_id long, text string, token_ids string, lang_pred string, toxic_score string, n int, id long, key int"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "x", "x", "x", 0, -1, 7) for i, t in enumerate(texts)], DOC)


def rows(df):
    return sorted((tuple(x) for x in df.collect()), key=str)


# 1


def test_urls(spark):
    urls = [None, "nothing", "http://", "HTTP://A.Example.COM/en/x?q", "https://www.example.com/en/1", "https://example.com/en/", "http://x.net/fr/#a", "http://x.org?free-casino", "http://x.org/free/bets", "http://x.org/freebets", "http://x.org/free/free", "http://x.com.org/?a", "http://com", "http://a.com:80/"]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = {r.page_id: tuple(r)[1:5] for r in url_filter.filter_urls(pages, url_filter.RULES).collect()}
    assert [got[i] for i in range(len(urls))] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.com", "/en/x", "example.com/en/", "block"), ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("example.com", "/en/", "example.com/en/", "block"), ("x.net", "/fr/", "net/fr/", "block"), ("x.org", "", None, "block"), ("x.org", "/free/bets", None, "block"), ("x.org", "/freebets", None, "allow"),
        ("x.org", "/free/free", None, "allow"), ("x.com.org", "/", None, "allow"), ("com", "", None, "allow"), ("a.com:80", "/", None, "allow"),
    ]
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_rules_of_one_length_go_by_their_order(spark):
    long = "http://b.co/a/" + "free/" * 200_000 + "bet"
    urls = ["http://b.co/abcd/", "http://b.co/abcd/", "http://c.co/abcd/", long, long, "http://b.co/" + "é" * 300_000]
    pages = spark.createDataFrame([(i % 4, u, "h") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    ways = [("block", "b.co", "/a"), ("allow", "co", "/abc"), ("allow", "b.co", "/a"), ("block", "co", "/abc")]
    for rules in (ways, ways[1:] + ways[:1], ways[::-1]):
        fits = lambda u: [r for r in rules if (u.split("/")[2] + ".").endswith(r[1] + ".") and ("/" + u.split("/", 3)[3]).startswith(r[2])]
        want = []
        for i, u in enumerate(urls):
            best = max(fits(u), key=lambda r: len(r[1] + r[2]), default=None)  # the first of the longest
            want.append((i % 4, best and best[1] + best[2], best[0] if best else "allow"))
        got = [(r.page_id, r["rule"], r.verdict) for r in url_filter.filter_urls(pages, rules).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


# 2


@pytest.mark.parametrize("n,high", [(0, 1), (1, 5), (2047, 50257), (2048, 3), (4097, 1000), (3000, 1 << 20), (2500, 1 << 32), (5000, 1)])
def test_range_coder_round_trip(n, high):
    x = np.random.default_rng(n).integers(0, high, n)
    assert (range_coder.decode(range_coder.encode(x)) == x).all()


def test_range_coder_finds_damage_and_small_blocks():
    x = np.minimum(np.random.default_rng(1).zipf(1.3, 5000), 40000)
    packed = range_coder.encode(x, block=64)
    assert (range_coder.decode(packed) == x).all() and len(range_coder.encode(x)) < 2 * len(x)
    for at in (8, len(packed) // 2, len(packed) - 1):
        bad = bytearray(packed)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            range_coder.decode(bytes(bad))


def test_range_coder_blocks_are_independent_and_small(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").toPandas().text
    x = np.array([i for e in Tokenizer.from_file(BYTE).encode_batch(list(texts)) for i in e.ids])
    packed = range_coder.encode(x, block=256)
    last = len(x) // 256
    assert (range_coder.decode(packed, [3, last, 0]) == np.r_[x[768:1024], x[last * 256 :], x[:256]]).all()
    plain = [x[i : i + 256].astype("<u2").tobytes() for i in range(0, len(x), 256)]
    assert len(packed) < sum(len(lzma.compress(p, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2}])) for p in plain) and len(packed) < sum(len(zlib.compress(p, 9)) for p in plain)


def test_other_tokenizer_files_get_whole_texts():
    encoder = token_files.PieceEncoder(WORD)
    ids, count = encoder.encode(pa.array(ODD))
    want = [Tokenizer.from_file(WORD).encode(t or "", add_special_tokens=False).ids for t in ODD]
    assert not encoder.by_pieces and ids.tolist() == [i for w in want for i in w] and count.tolist() == list(map(len, want))


def test_token_files_of_repeated_and_null_ids(spark, tmp_path):
    given = [(5, "b c"), (None, "x"), (5, "a"), (5, "a"), (None, None), (1, "the quick")]
    token_files.write_tokens(spark.createDataFrame(given, "doc_id long, text string"), BYTE, str(tmp_path / "t"))
    got = sorted(token_files.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    lib = Tokenizer.from_file(BYTE)
    assert sorted((str(r.doc_id), r.token_ids) for r in got) == sorted((str(i), [*lib.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in given)
    assert [r.doc_id for r in got] == [None, None, 1, 5, 5, 5] and [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def test_token_files(spark, tmp_path):
    docs, lib = documents(spark, ODD), Tokenizer.from_file(BYTE)
    folder = str(tmp_path / "t")
    token_files.write_tokens(docs, BYTE, folder)
    want, start = {}, 0
    for i, t in enumerate(ODD):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        want[i] = (start, len(ids), ids)
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.token_ids) for r in token_files.read_tokens(spark, folder).collect()} == want
    got = {r.doc_id: (r.start, r.ids_crc32) for r in token_files.read_digests(spark, folder).collect()}
    assert got == {i: (s, zlib.crc32(np.array(ids, "<u4").tobytes())) for i, (s, _, ids) in want.items()}
    token_files.write_tokens(docs.limit(0), BYTE, folder + "0")
    assert token_files.read_digests(spark, folder + "0").count() == 0


# 3 and 7


def test_bpe_is_the_library(spark):
    docs, lib = documents(spark, ODD), Tokenizer.from_file(WORD)
    want = {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(ODD)}
    coded, ids = bpe.encode(docs, WORD)
    assert {r.doc_id: r[ids] for r in coded.collect()} == want and coded.columns[: len(docs.columns)] == docs.columns
    out, (count, a, b) = bpe.digest(docs, WORD)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in out.collect():
        x = want[r.doc_id]
        assert (r[count], r[a], r[b]) == (len(x), sha(" ".join(map(str, x))), sha(lib.decode(x, skip_special_tokens=False)))
        assert bpe.decode_ids(bpe.vocabulary(WORD), x) == lib.decode(x, skip_special_tokens=False)
    counted, n = bpe.count_tokens(docs, WORD)
    assert {r.doc_id: r[n] for r in counted.collect()} == {i: len(x) for i, x in want.items()}
    assert bpe.count_tokens(docs.limit(0), WORD)[0].count() == 0


def test_every_prefix():
    lib, v = Tokenizer.from_file(WORD), bpe.vocabulary(WORD)
    words = ["antidisestablishmentarianism", "aaaaaaaaaa", "thethethe", "zzyzx", "understandings", "qqqqab"]
    raw = [w.encode() for w in words]
    _, final = bpe.prefix_counts(v, np.frombuffer(b"".join(raw), np.uint8), np.array([len(w) for w in raw]))
    want = [len(lib.encode(w[:k], add_special_tokens=False).ids) for w in words for k in range(1, len(w) + 1)]
    assert final.tolist() == want
    table = bpe.PrefixTable(WORD, "We're they'll stop, wörld!!")
    assert table.count(len(table.upto) - 1) == len(lib.encode("We're they'll stop, wörld!!", add_special_tokens=False).ids)
    assert table.upto[: 6].tolist() == [len(lib.encode(x, add_special_tokens=False).ids) for x in ("", "w", "we", "we'", "we'r", "we're")]
    assert table.count(table.longest_within(3)) <= 3 < table.count(table.longest_within(3) + 1)
    assert bpe.PrefixTable(WORD, None).upto.tolist() == [0]


def test_prefix_counts_as_columns(spark):
    lib = Tokenizer.from_file(WORD)
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    texts = [*ODD, "We're all  unbelievably\nantidisestablishmentarian, wörld!! ok", "  \tlead and trail \n", "y" * 700 + " z"]
    docs = documents(spark, texts)
    found, name = bpe.prefix_tokens(docs, WORD)
    for r in found.collect():
        raw = (texts[r.doc_id] or "").encode()
        ends = [m.end() for m in re.finditer(rb"[^ \t-\r]+", raw)]
        assert [x.end for x in r[name]] == ends
        for x in r[name][:40]:
            assert x.tokens == count(raw[: x.end].decode())
    for budget in (0, 1, 3, 7, 10**9):
        within, (n, fitting) = bpe.count_within(docs, WORD, budget)
        for r in within.collect():
            t = texts[r.doc_id] or ""
            assert r[n] == count(t)
            fits = t.encode()[: r[fitting]].decode()
            assert count(fits) <= budget and (r[fitting] == len(t.encode())) == (count(t) <= budget or not t)
            if len(fits) < len(t) < 1000:
                assert not any(count(t[:k]) <= budget for k in range(len(fits) + 1, len(t) + 1))


CUTS = [
    "日本語のテキストは空白なしで続くので長い一語になる" * 3, "日本語　テキスト　ABC", "ééạ̀x", "ẹ́́y", "한국어 한ᄀ", "a\x1cb\x1d\x00c\x7f12", "x<|endoftext|>y!<|endoftext|><|startoftext|>", "!!<|endoftext", "<|endof<|endoftext|>|>",
    "İSTANBUL'RE ΣΟΦΟΣ ΣΑΣ", "we're'll'''ve", "🙂👩‍👩‍👧 ok🙂", "a b c d", "naïve—“quotes”…½²Ⅷ٣", "ßẞﬁﬃ", "don't<|startoftext|>'re", "मानक हिन्दी", "e\u0301e\u0301a\u0300\u0323x", "\u00e9\u0323\u0301y", "\u1112\u1161\u11ab\u1100", "x\u0307\u0323\u0307<|endoftext|>o\u0308", "a\u00a0b\u2003c\u2028d\x85e", "ẋ̣̇",
]


@pytest.mark.parametrize("word", CUTS)
def test_the_longest_prefix_of_any_text(word):
    """Against all prefixes by the library, for every budget."""
    lib = Tokenizer.from_file(WORD)
    for part in word.split(" "):
        counts = [len(lib.encode(part[:k], add_special_tokens=False).ids) for k in range(len(part) + 1)]
        for room in range(counts[-1] + 2):
            assert bpe.longest_cut(WORD, part, room) == max(k for k, n in enumerate(counts) if n <= room), (part, room)


def test_budgets_of_texts_without_blanks(spark):
    lib = Tokenizer.from_file(WORD)
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    texts = [*CUTS, " ".join(CUTS), "日本語" * 2000]
    for budget in (5, 40, 2048):
        found, (n, fitting) = bpe.count_within(documents(spark, texts), WORD, budget)
        for r in found.collect():
            t = texts[r.doc_id]
            fits = t.encode()[: r[fitting]].decode()
            assert r[n] == count(t) and count(fits) <= budget
            assert not any(count(t[:k]) <= budget for k in range(len(fits) + 1, min(len(t), len(fits) + 120) + 1))


def test_long_words_are_counted_one_by_one(monkeypatch):
    v, words = bpe.vocabulary(WORD), ["antidisestablishmentarianism", "a" * 40, "the", "understandings" * 3]
    raw, length = np.frombuffer("".join(words).encode(), np.uint8), np.array([len(w) for w in words])
    want = [bpe.prefix_counts(v, raw, length, every) for every in (True, False)]
    monkeypatch.setattr(bpe, "LONG", 20)
    for (a, b), every in zip(want, (True, False)):
        inner, final = bpe.prefix_counts(v, raw, length, every)
        assert (inner == a).all() and (final == b).all()


# 4


@pytest.mark.parametrize("block", [embedding_dedup.BLOCK, 7])
def test_vectors(spark, block):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    near = [base[0] + rng.normal(size=16) * s for s in np.linspace(0.01, 0.5, 60)]
    vectors = [*base, *near, base[1], base[1], 3 * base[2], base[3] * 1e200, base[4] * 1e-200]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] * 16, [1.0, 2.0], [1.0, 2.0]]
    data = [(i, None if v is None else list(map(lambda x: None if x is None else float(x), v)), 0, "c") for i, v in enumerate([*vectors, *odd])]
    given = spark.createDataFrame([*data, (None, [1.0, 2.0], 0, "c")], "vec_id long, embedding array<double>, n_links int, v string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(given, block=block).collect()}
    assert got.pop(None) == (0, None, True)
    x = np.array(vectors)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    links = [(a, b) for a, b in combinations(range(len(x)), 2) if (x[a] * x[b]).sum() >= 0.95] + [(len(x) + 6, len(x) + 7)]
    degree, root = dict.fromkeys(range(len(data)), 0), list(range(len(data)))
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
        p, q = root[a], root[b]
        root = [min(p, q) if r in (p, q) else r for r in root]
    assert got == {i: (degree[i], root[i], root[i] == i) for i in range(len(data))}
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_repeated_vector_ids(spark):
    data = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.01]), (3, [0.0, 1.0])]
    assert rows(embedding_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>"))) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]


def test_search_across_components_writes_joining_links_only(spark):
    """A cone of vectors in one bucket, no star among them: blocks find links enough to join it."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=64) + 0.2 * rng.normal(size=(60, 64))
    vectors = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "id long, v array<double>, weight long")
    shared = spark.createDataFrame([(1, i) for i in range(60)], "key long, id long")
    none = spark.createDataFrame([], "id long, component long")
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    for block in (4096, 9):
        links = rows(embedding_dedup.across_components(shared, none, embedding_dedup.codes(vectors), vectors, 0.95, block))
        assert all(unit[a] @ unit[b] >= 0.95 - 1e-9 for a, b in links)
        assert {r.component for r in connected(spark.createDataFrame(links, "a long, b long")).collect()} == {0} and len(links) < 60 * 59 // 2


def test_codes_leave_few_pairs_open():
    """Of unrelated pairs hardly any is recomputed, and no link is excluded."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 64))
    x[300:] = x[:300] + rng.normal(size=(300, 64)) * rng.uniform(0.05, 0.5, (300, 1))
    units = x / np.sqrt((x * x).sum(1, keepdims=True))
    sign, factor = embedding_dedup.signs(units, embedding_dedup.rotation(64))
    group = embedding_dedup.Block(pa.table({"v": pa.array(x.tolist()), "code": pa.array([b.tobytes() for b in np.packbits(sign, axis=1)], pa.binary()), "factor": factor}))
    got = {(int(a), int(b)) for p, q in group.links(lambda x, y: x < y, 0.95) for a, b in zip(p, q)}
    assert got == {(a, b) for a, b in zip(*np.nonzero(np.triu(units @ units.T >= 0.95, 1)))} and group.recomputed < 0.003 * 600 * 600 / 2


def test_number_of_tables_keeps_the_mean_miss():
    picks = embedding_dedup.tables(1000)
    rng, k = np.random.default_rng(4), picks.shape[1]
    differ = rng.binomial(1024, np.arccos(0.95) / np.pi, 200_000)
    assert ((1 - (1 - differ / 1024) ** k) ** len(picks)).mean() < 2e-6 and len(embedding_dedup.tables(10**9)) < 1500


def test_rotation_keeps_lengths():
    turn = embedding_dedup.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    x = np.random.default_rng(2).normal(size=(500, 64))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    corner, factor = embedding_dedup.signs(x[:1].repeat(499, 0), turn)
    estimate = ((corner * 2 - 1) * (x[1:] @ turn)).sum(1) / 16 / factor
    assert abs((estimate - x[1:] @ x[0]).mean()) < 0.02  # unbiased
    assert (np.abs(estimate - x[1:] @ x[0]) <= embedding_dedup.EPSILON * np.sqrt((1 - factor**2) / factor**2 / 255)).all()


# 5


def test_licenses(spark):
    texts = [None, "", "Foo bar.\nLicensed under the Apache License, Version 2.0.", "licensed under cc by-nc 4.0 and Released under the MIT License.", "This work is hereby licensed under the old GNU General Public License version 3", "a license is not enough", "All rights\nreserved. " * 2]
    got = rows(license_scan.scan_licenses(documents(spark, texts)).select("doc_id", "license"))
    assert got == [(2, "Apache-2.0"), (3, "CC-BY-NC-4.0"), (3, "MIT"), (4, "GPL-3.0"), (6, "reserved"), (6, "reserved")]


def test_many_notices_in_one_text():
    """Finds do not overlap and none is lost; settling them costs about as much as finding them."""
    known = [license_scan.Template(k, v) for k, v in license_scan.NOTICES.items()]
    notice = license_scan.NOTICES["MIT"]
    text = " ".join(f"credit {i} to somebody else here for it . {notice} ." for i in range(3000))
    began = time.process_time()
    found = license_scan.scan(text, known)
    assert [x[0] for x in found] == ["MIT"] * 3000 and all(a[4] < b[3] for a, b in zip(found, found[1:]))
    assert time.process_time() - began < 20


def test_settled_finds_are_those_of_a_plain_comparison():
    rng = np.random.default_rng(9)
    for _ in range(200):
        finds = [("abc"[int(rng.integers(3))], float(rng.random()), int(rng.integers(1, 9)), int(a), int(a + rng.integers(0, 9))) for a in rng.integers(0, 60, int(rng.integers(0, 25)))]
        kept = []
        for x in sorted(finds, key=lambda x: (-x[2], -x[1], x[4] - x[3], x[0], x[3])):
            if all(x[4] < y[3] or x[3] > y[4] for y in kept):
                kept.append(x)
        assert license_scan.settled(finds) == sorted(kept, key=lambda x: (x[3], x[0]))


def test_patience_alignment_is_monotone():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = ([str(x) for x in rng.integers(0, 8, int(rng.integers(0, 20)))] for _ in range(2))
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    words = [str(x) for x in range(30)]
    assert len(license_scan.align(["x", *words[:10], "y", *words[10:]], words)) == 30


def test_licenses_that_stand_close_together(spark):
    known = [license_scan.Template(k, v) for k, v in license_scan.TEMPLATES.items()]
    for name, notice in license_scan.TEMPLATES.items():
        n = len(license_scan.words_of(notice))
        for text, steps in ((f"foo {notice}. {notice}. bar", (n, n)), (" ".join(f"photo {k} {notice}." for k in range(40)), (n + 2,) * 40)):
            first = 1 if text[0] == "f" else 2
            assert license_scan.scan(text, known) == [(name, 1.0, n, first + k * step, first + k * step + n - 1) for k, step in enumerate(steps)]
    texts = ["Released under the MIT License, Released under the new MIT License, under the MIT License. Licensed under CC BY 4.0, Released under the MIT License"]
    got = license_scan.scan_licenses(documents(spark, texts)).select("first_word", "last_word", "license", "matched_words").collect()
    assert sorted(map(tuple, got)) == [(0, 4, "MIT", 5), (5, 10, "MIT", 5), (11, 14, "MIT", 4), (15, 19, "CC-BY-4.0", 5), (20, 24, "MIT", 5)]


def test_whole_license_texts(spark):
    known = [license_scan.Template(k, v) for k, v in license_scan.TEMPLATES.items()]
    rng = np.random.default_rng(3)
    for name, text in license_scan.TEXTS.items():
        words = license_scan.words_of(text)
        n = len(words)
        assert n > 30 and [x[:3] for x in license_scan.scan(text, known)] == [(name, 1.0, n)]
        # one word in twelve is changed, a holder is put in, another copy follows close by
        edited = [w if rng.random() > 1 / 12 else f"zq{i}" for i, w in enumerate(words)]
        edited[n // 2 : n // 2] = ["acme", "limited"]
        got = license_scan.scan(" ".join(["foo", *edited, "bar", *words, "baz"]), known)
        assert [x[0] for x in got] == [name, name] and got[1][1] == 1.0
        # brute force: no alignment matches more than a longest common subsequence, and at most two matches less
        most = len(license_scan.common(["foo", *edited], words))
        assert most - 2 <= got[0][2] <= most
    texts = [license_scan.TEXTS["MIT-text"].replace(" ", "\n  * ", 60), "copy modify merge " * 9000, license_scan.TEXTS["BSD-3-text"][:300]]
    assert [x[1] for x in rows(license_scan.scan_licenses(documents(spark, texts)).select("doc_id", "license")) if x[0] < 2] == ["MIT-text"]
    assert license_scan.scan_licenses(documents(spark, [])).count() == 0


def test_copies_of_long_templates_are_those_of_short_ones():
    rng = np.random.default_rng(5)
    t = license_scan.Template("t", "a b c d b e f a")
    for _ in range(200):
        words = [str(w) for w in rng.choice(list("abcdefxy"), 12)]
        short = license_scan.copies(words, t, 6)
        if all(b - a < len(t.words) for a, b in short):
            long = license_scan.long_copies(words, t, 6)
            assert len(long) >= len(short) and all(len(license_scan.common(words[a : b + 1], t.words)) >= 6 for a, b in long)


def test_gap_without_anchor_is_matched_by_a_common_subsequence():
    assert len(license_scan.align(list("xabcabcy"), list("abc"))) == 3
    assert license_scan.common(list("xaybzc"), list("abc")) == [(1, 0), (3, 1), (5, 2)]


# 6


@pytest.fixture(scope="module")
def toxic_rows():
    rng = np.random.default_rng(11)
    bad = ["blorkface", "snivelwort", "grumptoad", "dunghat"]
    word = lambda: "".join(rng.choice(list("aeioulnrst"), int(rng.integers(2, 8))))
    out = []
    for i in range(500):
        words = [word() for _ in range(40)]
        toxic = int(i % 5 == 0)
        if toxic:
            for k in rng.integers(0, 40, 4):
                words[k] = str(rng.choice(bad))
        out.append((" ".join(words), toxic))
    return out


def test_toxicity(spark, toxic_rows):
    model = toxicity.train(toxic_rows[:400])
    docs = documents(spark, [t for t, _ in toxic_rows[400:]] + ODD + ["la blorkfface ta gru-mp-toad se dunghatt snivvelwort ra", "l a b l o r k f a c e ra grumptoad"])
    scored, name = toxicity.score(docs, model)
    s = {r.doc_id: r[name] for r in scored.collect()}
    assert np.mean([(s[i] >= 0.5) == y for i, (_, y) in enumerate(toxic_rows[400:])]) > 0.97
    assert all(0 <= s[100 + i] < 0.5 for i in range(len(ODD))) and s[100 + len(ODD)] >= 0.5
    assert toxicity.train([]) is None and toxicity.train([("a", 0)]) is None
    assert {r[1] for r in toxicity.score(docs.select("doc_id"), None)[0].collect()} == {0.0}


def test_sentences_choose_their_windows():
    # windows 3, 5, 9 in sentences 0-3 of texts 0 (sentences 0, 1) and 1 (sentences 2, 3)
    bags = toxicity.Bags(np.array([3, 5, 5, 9, 3, 9]), np.array([0, 0, 1, 2, 3, 3]), np.array([0, 0, 1, 1]))
    f = np.array([0.4, 0.9, -0.5])  # of 3, 5, 9
    for above, want in ((0.0, {5: 2, 3: 1}), (2.0, {5: 1, 3: 1}), (-1.0, {5: 2, 3: 1, 9: 1})):
        assert dict(zip(*(x.tolist() for x in bags.chosen(f, above)))) == want


def test_toxicity_of_an_empty_table(spark):
    docs, labels = documents(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, toxicity.F.lit(True))
    assert model is None and toxicity.score(docs, model)[0].count() == 0


def test_string_kernel_by_brute_force():
    words = [b"\x01\x02\x03\x04", b"\x01\x05\x02\x03", b"\x01\x01\x01\x01\x01", b"\x02\x03"]

    def phi(w):
        out = {}
        for at in combinations(range(len(w)), 3):
            if at[2] - at[0] < toxicity.SPAN:
                u = tuple(w[i] for i in at)
                out[u] = out.get(u, 0) + toxicity.DECAY ** (at[2] - at[0] + 1)
        return out

    length = np.array([len(w) for w in words])
    made = toxicity.Windows(np.frombuffer(b"".join(words), np.uint8), np.cumsum(length) - length, length, np.arange(len(words)))
    key, value, norm = toxicity.explicit(made)
    n = toxicity._LETTERS
    got = {(k // n**3, k // n**2 % n, k // n % n, k % n): v for k, v in zip(key.tolist(), value.tolist())}
    want = {(i, *u): v for i, w in enumerate(words) for u, v in phi(w).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    assert np.allclose(norm, [np.sqrt(sum(v * v for v in phi(w).values())) for w in words])


# 8


def brute_groups(texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            p, q = root[a], root[b]
            root = [min(p, q) if r in (p, q) else r for r in root]
    return sets, root


def test_near_duplicates(spark):
    rng = np.random.default_rng(9)
    word = lambda: "w" + str(rng.integers(0, 5000))
    base = [[word() for _ in range(int(rng.integers(3, 150)))] for _ in range(25)]
    texts = list(ODD) + ["A b C d", "a B c D", "a b c d e", "A B C D E", "one two"]
    for b in base:
        texts.append(" ".join(b))
        for _ in range(6):
            c = list(b)
            for k in rng.integers(0, len(c), int(rng.integers(0, 1 + len(c) // 12))):
                c[k] = word()
            texts.append("  ".join(c))
    sets, root = brute_groups(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(documents(spark, texts)).collect()}
    assert got == {i: (len(sets[i]), root[i], root[i] == i) for i in range(len(texts))}
    again = documents(spark, ["a b c d e f"]).unionByName(documents(spark, ["a b c d e f", "x"]))
    assert rows(near_dedup.near_duplicates(again)) == [(0, 2, 0, True), (0, 2, 0, True), (1, 1, 1, True)]
    assert near_dedup.near_duplicates(documents(spark, ["a"]).limit(0)).count() == 0


def test_mixed_buckets_find_links_that_stars_miss(spark):
    """Only the search across components can link b and c here: a, the smallest, is in each of their buckets."""
    a, b, c = ("a b c d e f g h i j k l m n o p q r s t".split() for _ in range(3))
    b[0], c[0], b[10], c[10] = "x", "x", "y", "y"
    docs = documents(spark, [" ".join(t) for t in (a, b, c + ["z"])])
    shared = spark.createDataFrame([(1, 1, 16), (1, 2, 17)], "key long, id long, n long")
    found = spark.createDataFrame([], "id long, component long")
    got = near_dedup.across_components(docs, shared, found, "text", 75)
    assert rows(got) == [(1, 2)]


@pytest.mark.parametrize("block,size", [(512, 10**9), (4, 10**9), (512, 200)])
def test_search_of_a_large_mixed_bucket_in_blocks(spark, block, size):
    """Every link between components of one bucket joins them, whatever block its ends are in."""
    rng = np.random.default_rng(3)
    texts = []
    for k in range(12):
        base = [f"{k}w{i}" for i in range(40)]
        for v in range(3):
            c = list(base)
            c[int(rng.integers(0, 40))] = f"new{k}{v}"
            texts.append(" ".join(c))
    sets, root = brute_groups(texts)
    shared = spark.createDataFrame([(7, i, len(sets[i])) for i in range(len(texts))], "key long, id long, n long")
    none = spark.createDataFrame([], "id long, component long")
    links = near_dedup.across_components(documents(spark, texts), shared, none, "text", 75, block, size)
    got = {r.id: r.component for r in connected(links).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == root and links.count() <= 200


def test_hashes_that_agree_in_their_upper_half_change_no_link():
    def table(x, y):
        return pa.table({"id": [1, 2], "c": [1, 2], "n": [4, 4], "at": [0, 0], "i": [0, 0], "j": [0, 0], "shingles": pa.array([x, y], pa.list_(pa.int64()))})

    assert near_dedup.joining_links(table([1, 2, 3, 4], [5, 6, 7, 8]), 75).num_rows == 0  # between sets
    assert near_dedup.joining_links(table([1, 2, 3, 4], [1, 2, 3, 4]), 75).to_pydict() == {"a": [1], "b": [2]}  # inside a set


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9), (7, 7), (None, 3)], "a long, b long")
    assert rows(connected(e)) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8)]
    assert connected(e.limit(0)).count() == 0


# 9


def labelled(spark, samples):
    return spark.createDataFrame([(k, t) for k, texts in samples.items() for t in texts], "l string, t string")


def test_languages(spark):
    rng = np.random.default_rng(4)
    make = lambda letters, n: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n))
    model = language_id.train(labelled(spark, {"x": [make("abcde", 60) for _ in range(20)], "y": [make("cdefgé", 60) for _ in range(20)], "empty": [""]}))
    assert model.languages == ["x", "y"]
    texts = [make("abcde", 12), make("cdefgé", 12), None, "", "123 !?", "日本"]
    out, lang, score = language_id.identify(documents(spark, texts), model)
    got = {r.doc_id: (r[lang], r[score]) for r in out.collect()}
    assert got[0][0] == "x" and got[1][0] == "y" and got[5][0] in ("x", "y")
    assert [got[i] for i in (2, 3, 4)] == [("und", 0.0)] * 3 and all(0 <= s <= 1 for _, s in got.values())
    out, lang, _ = language_id.identify(documents(spark, texts), None)
    assert {r[lang] for r in out.collect()} == {"und"}
    assert language_id.train(labelled(spark, {})) is None and language_id.train(labelled(spark, {"x": ["", None]})) is None


def test_code_lengths_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MIN_CONTEXT", 1)
    monkeypatch.setattr(language_id, "STEP", 7)
    samples = {"a": ["banana band", "nab"], "b": ["bandit dana"]}
    model = language_id.train(labelled(spark, samples))
    texts = ["band nan", "zzz", "", "bandana banana band"]
    raw = [t.encode() for t in texts]
    got = model.bits(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    other = model.size - 1
    for k, name in enumerate(model.languages):
        counts = {}
        for t in samples[name]:
            s = [model.blank] * 3 + [int(model.lut[c]) for c in t.encode()]
            for i in range(3, len(s)):
                for o in range(4):
                    counts.setdefault(tuple(s[i - o : i]), {}).setdefault(s[i], 0)
                    counts[tuple(s[i - o : i])][s[i]] += 1

        def p(context, x):
            seen = counts.get(context)
            lower = (1 / model.size) if not context else None
            if seen is None:
                return p(context[1:], x)
            t, d = sum(seen.values()), len(seen)
            return seen[x] / (t + d) if x in seen else d / (t + d) * (lower if lower is not None else p(context[1:], x))

        for i, t in enumerate(texts):
            s = [model.blank] * 3 + [int(model.lut[c]) for c in t.encode()]
            assert abs(got[i, k] - sum(-np.log2(p(tuple(s[j - 3 : j]), s[j])) for j in range(3, len(s)))) < 1e-3
    assert other in model.lut


# 10


def test_contamination(spark):
    words = [f"w{i}" for i in range(40)]
    item = " ".join(words)
    texts = ["x y " + item + " z", " ".join(words[20:] + ["x"] + words[:20]), " ".join(words[:20]), item.upper().replace(" ", ", "), None, "", "w1 w2 w3", item]
    bench = spark.createDataFrame([(1, item, "a"), (2, "w1 w2", "a"), (3, None, "a"), (4, " ".join(f"v{i}" for i in range(9)), "a"), (1, item, "b")], "item_id long, text string, doc_id string")
    got = decontaminate.contamination(documents(spark, texts), bench)
    want = [(0, 1, 40, 40, 1, 1.0), (1, 1, 40, 40, 2, 1.0), (3, 1, 40, 40, 1, 1.0), (7, 1, 40, 40, 1, 1.0)]
    assert rows(got) == want
    assert rows(decontaminate.contamination(documents(spark, texts), bench, broadcast_words=0)) == want
    assert decontaminate.contamination(documents(spark, texts), bench.limit(0)).count() == 0


def test_tiles_by_brute_force():
    def brute(a, b, least):
        ma, mb, total = [0] * len(a), [0] * len(b), 0
        while True:
            best = (0, 0, 0)
            for i in range(len(a)):
                for j in range(len(b)):
                    k = 0
                    while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                        k += 1
                    best = max(best, (k, -i, -j))
            k, i, j = best[0], -best[1], -best[2]
            if k < least:
                return total
            ma[i : i + k], mb[j : j + k] = [1] * k, [1] * k
            total += k

    rng = np.random.default_rng(0)
    for _ in range(40):
        a, b = (rng.integers(1, 6, int(rng.integers(1, 40))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
        assert sum(n for _, _, n in decontaminate.tiles(a, b, 3)) == brute(a.tolist(), b.tolist(), 3)


def test_held_out_matches_zlib(spark):
    from strandline.llm.common import held_out

    got = spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


# language: sample and known texts


def test_language_sample_is_the_ranking_by_hash(spark):
    rows_ = [(i, f"text {i}", ("x", "y", None)[i % 3]) for i in range(3000)] + [(None, "null id", "x"), (9000, None, "x"), (9001, "long " * 100, "y")]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    h = lambda k: spark.sql(f"select shiftrightunsigned(xxhash64(cast({k} as bigint)), 1)")
    found = language_id.sample(docs.unionByName(docs.where("doc_id < 1500")), F.col("doc_id").isNotNull(), each=20, most_bytes=200)
    got = {lang: [r.t for r in found.where(F.col("l") == lang).collect()] for lang in "xy"}
    order = docs.where("text is not null and doc_id < 9001 and doc_id is not null").select("text", "lang", F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("h")).collect()
    assert h(1).count() == 1
    for lang in "xy":
        want = [r.text for r in sorted((r for r in order if r.lang == lang), key=lambda r: r.h)[:20]]
        assert sorted(got[lang]) == sorted(want)
    assert language_id.sample(docs.limit(0), F.lit(True)).count() == 0


def test_known_texts(spark):
    rng = np.random.default_rng(3)
    make = lambda letters, n: "".join(rng.choice(list(letters), n))
    prose = [" ".join(rng.choice(["the", "river", "runs", "under", "old", "stone", "bridges"], 60)) for _ in range(30)]
    model = language_id.train(labelled(spark, {"x": prose}))
    texts = [None, "", "123 456", prose[0], "the old river", "a", "The River runs. " * 5000, make("αβγδεζηθ", 300), make("abcdefghijklmnopqrstuvwxyz", 2000)]
    docs = documents(spark, texts)
    got = language_id.known(docs, model)
    assert sorted(r.doc_id for r in got.collect()) == [3, 4, 5, 6] and got.columns == docs.columns
    assert language_id.known(docs, None).count() == 0 and language_id.known(docs.limit(0), model).count() == 0


def test_decontamination_by_join_keeps_to_the_bound(spark):
    """Pairs that share one seed only are given up before their words are joined; results are those of the other way."""
    common = "one two three four five"
    items = [(k, common + " " + " ".join(f"i{k}w{j}" for j in range(25))) for k in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [common] * 5 + [items[3][1] + " more", " ".join(items[4][1].split()[12:] + items[4][1].split()[:12]), "x " * 50_000 + items[5][1], None, ""] + [items[3][1] + " more"]
    docs = documents(spark, texts)
    want = rows(decontaminate.contamination(docs, bench))
    assert rows(decontaminate.contamination(docs, bench, broadcast_words=0)) == want and {(r[0], r[1]) for r in want} == {(5, 3), (6, 4), (7, 5), (10, 3)}


def test_toxicity_learns_from_few_toxic_rows(spark):
    """Three toxic texts of two hundred: there is a model, which finds their words and leaves clean texts alone."""
    rng = np.random.default_rng(2)
    words = ["river", "garden", "window", "paper", "music", "winter", "bread", "lamp", "story", "bridge", "cloud", "table"]
    clean = [" ".join(rng.choice(words, 30)) + f" {i}." for i in range(200)]
    toxic = [f"{' '.join(rng.choice(words, 8))} you grumblefrotz {' '.join(rng.choice(words, 8))}." for _ in range(3)]
    docs = documents(spark, [*clean, *toxic])
    labels = spark.createDataFrame([(i, 1, int(i >= 200)) for i in range(203)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    assert model is not None
    asked = documents(spark, ["the garden and you grumblefrotz window", "the garden and the window of winter", "", None])
    found, name = toxicity.score(asked, model)
    got = [r[name] for r in found.orderBy("doc_id").collect()]
    assert got[0] > max(got[1:]) and all(0 <= x <= 1 for x in got)
    one_kind = labels.where("toxic = 0")
    assert toxicity.fit(docs, one_kind, F.lit(True)) is None and toxicity.fit(docs.limit(0), labels, F.lit(True)) is None


def test_toxicity_over_the_tables(spark):
    """The query: columns, whole tables, and what it finds of the labels."""
    from strandline.llm import queries

    data = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op6_toxicity(spark, data).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert set(got) == set(docs) and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for i, r in got.items())
    said = [(got[r.doc_id], r.toxic) for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r.doc_id in got]
    toxic = [r.predicted for r, t in said if t == 1]
    clean = [r.predicted for r, t in said if t == 0]
    assert sum(toxic) >= 0.6 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_languages_of_odd_tables(spark):
    rows_ = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("le chat est sur la table", "fr")] * 30 + [("the cat sat on the mat", "fr"), (None, "en"), ("", "fr"), ("the dog", None)])]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    model = language_id.train(language_id.sample(docs, F.lit(True)))
    odd = ["the mat", "la table", "the cat " * 60_000, "12 34", None, "the mat", "é"]
    asked = spark.createDataFrame([(i, t, "x", 0.5) for i, t in enumerate(odd)], "doc_id long, text string, lang_pred string, lang_score double")
    found, pred, score = language_id.identify(asked, model)
    got = {r.doc_id: (r[pred], r[score]) for r in found.collect()}
    assert [got[i][0] for i in range(6)] == ["en", "fr", "en", "und", "und", "en"] and got[0] == got[5] and got[2][1] == 1.0
    assert language_id.identify(asked.limit(0), model)[0].count() == 0 and language_id.known(asked.limit(0), model).count() == 0


def test_junk_is_of_no_known_language(spark):
    """The bound of known() follows the training texts: they and texts like them stay, letters at random go."""
    data = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.train(language_id.sample(data, F.lit(True)))
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    junk = ["".join(rng.choice(letters, 400)), " ".join("".join(rng.choice(letters, 7)) for _ in range(80)), "".join(rng.choice(np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")), 600)), "字" * 200]
    asked = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(junk)], data.schema).unionByName(spark.createDataFrame([(-9, "short zz", None)], data.schema))
    kept = {r.doc_id for r in language_id.known(data.unionByName(asked), model).collect()}
    assert not kept & {-1, -2, -3, -4} and -9 in kept
    assert all(r.doc_id in kept for r in data.collect() if r.text and any(c.isalpha() for c in r.text))


def test_items_that_are_too_short_are_named(spark):
    items = spark.createDataFrame([(1, "one two three four"), (2, "one, two; three four five"), (3, None), (4, "日本語 ok")], "item_id long, text string")
    assert rows(decontaminate.undecided(items)) == [(1, 4), (3, 0), (4, 2)]


def test_memory_of_a_step_does_not_follow_large_blocks():
    """Working arrays of large blocks of sets and of scored texts stay small, with the same counts and scores."""
    import tracemalloc

    rng = np.random.default_rng(3)
    pool = near_dedup.mix64(np.arange(30_000, dtype=np.uint64)).view(np.int64)
    small = [np.unique(rng.choice(pool, n)) for n in rng.integers(1, 20_000, 60)] + [pool[:0]]
    want = [[len(np.intersect1d(a, b)) for b in small] for a in small]
    assert (near_dedup.shared_counts(small) == want).all()
    large = [pool] * 100  # 24 MB
    text, model = "some plain words of a text " * 40, toxicity.Model(np.zeros(toxicity._LETTERS**3), 0.0)
    texts = pa.array([text] * 2000)  # 2 MB
    for work, most in ((lambda: near_dedup.shared_counts(large), 60), (lambda: model.scores(texts), 60)):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert peak < most, peak
