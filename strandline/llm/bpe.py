"""Byte-pair encoding and decoding by batched numpy merge rounds, and exact token counts of prefixes.

Merge rounds. The symbols of many distinct words lie in one flat array. A round forms the key of every
adjacent pair of a word, finds its rank by binary search over the sorted keys of all merges, takes the lowest
rank of each word, and merges all its places at once (left to right where places overlap); words without a
mergeable pair leave the array. Merging all places of the lowest rank at once is exact, as a merge only ever
makes pairs of higher rank.

Prefix counts. For every prefix of a word, the last token of its encoding is the one token t ending there for
which the pair (last token of the rest, t) is a valid one, that is encodes as itself. So the token counts of
all prefixes follow from shorter ones, position by position, for many words at once; validity of a pair is
decided by undoing the merges of both tokens down to their common border. A prefix that is cut inside a word
ends with the word-end form of its last token, which a second table holds.

Texts are normalised, split at white space and into pieces as the tokenizer file says (BPE with word ends,
lower case). Null counts as empty, an empty text has no tokens, repeated rows are encoded each, and strings
of added tokens inside texts become these tokens as the tokenizers library does by default.

Both work on the distinct words of a bounded number of text bytes; nothing is shuffled."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from strandline.llm.common import append_columns, free_name, ragged, segment_sums, text_bytes

#: Words of these characters only are normalised and split here; the library does all others.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
_NONE = np.iinfo(np.int32).max
#: Words of more bytes are counted one by one, not in step with others.
LONG = 512
_WHITE = b" \t\n\x0b\x0c\r"
#: Runs of characters that are no white space of Unicode (which some control characters of Python's are not).
_NO_SPACE = re.compile("[^\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_BLANK = np.zeros(256, bool)
_BLANK[list(_WHITE)] = True


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, n = [""] * 256, 0
    for b in range(256):
        out[b] = chr(b) if b in plain else chr(256 + n)
        n += b not in plain
    return out


class Vocabulary:
    """The tables of one tokenizer file of the kind of word_bpe_49k.json."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, signs = spec["model"], byte_symbols()
        end = model["end_of_word_suffix"] or ""
        ids: dict[str, int] = model["vocab"]
        self.path = path
        self.names = [""] * (1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]))
        for name, i in ids.items():
            self.names[i] = name
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for name, i in self.special.items():
            self.names[i] = name
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.size = len(self.names)
        self.byte_id = np.array([ids[c] for c in signs], np.int32)
        self.end_id = np.array([ids[c + end] for c in signs], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int32)
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.keys, self.rank, self.made = key[order], order.astype(np.int32), made  # made: by rank
        # for prefix counts: the merge that makes a token, its halves, and the bytes of every token
        self.rank_of = np.full(self.size, -1, np.int32)  # -1: a single byte
        self.half = np.zeros((2, self.size), np.int32)
        self.rank_of[made[::-1]] = np.arange(len(made), dtype=np.int32)[::-1]
        self.half[0][made[::-1]], self.half[1][made[::-1]] = left[::-1], right[::-1]
        back = {c: b for b, c in enumerate(signs)}
        inner: dict[bytes, int] = {}
        final: dict[bytes, int] = {}
        for name, i in ids.items():
            if name in self.special:
                continue
            ends = bool(end) and name.endswith(end)
            (final if ends else inner)[bytes(back[c] for c in (name[: -len(end)] if ends else name))] = i
        self.inner, self.final = _Hashed(inner), _Hashed(final)
        self.inner_id, self.final_id = inner, final
        self.valid: dict[tuple[int, int], bool] = {}  # pairs met in long words

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, or _NONE."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)


class _Hashed:
    """Token ids by length and 64-bit polynomial hash of their bytes; collisions within a length are refused."""

    BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

    def __init__(self, tokens: dict[bytes, int]):
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(t) for t in tokens}):
            some = [(t, i) for t, i in tokens.items() if len(t) == n]
            h = np.zeros(len(some), np.uint64)
            for k in range(n):
                h = h * self.BASE + np.array([t[k] + 1 for t, _ in some], np.uint64)
            order = np.argsort(h)
            if len(np.unique(h)) != len(h):
                raise ValueError("two tokens share a hash")
            self.by_length[n] = h[order], np.array([i for _, i in some], np.int32)[order]

    def find(self, n: int, h: np.ndarray) -> np.ndarray:
        """Ids of strings of n bytes with these hashes, -1 where there is none."""
        if n not in self.by_length:
            return np.full(len(h), -1, np.int32)
        keys, ids = self.by_length[n]
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, ids[at], -1)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def library(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def merge_rounds(v: Vocabulary, raw: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of words given as bytes, one after the other: (ids, tokens of each word)."""
    n = len(length)
    if not len(raw):
        return np.zeros(0, np.int32), np.zeros(n, np.int64)
    sym = v.byte_id[raw]
    last = np.cumsum(length)[length > 0] - 1
    sym[last] = v.end_id[raw[last]]
    word = np.repeat(np.arange(n, dtype=np.int32), length)
    done_sym, done_word = [], []
    while len(sym):
        rank = np.full(len(sym), _NONE, np.int32)
        rank[:-1] = np.where(word[:-1] == word[1:], v.find(sym[:-1], sym[1:]), _NONE)
        start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        size = np.diff(np.r_[start, len(sym)])
        best = np.minimum.reduceat(rank, start)
        over = np.repeat(best == _NONE, size)
        if over.any():
            done_sym.append(sym[over])
            done_word.append(word[over])
            keep = ~over
            sym, word, rank = sym[keep], word[keep], rank[keep]
            best, size = best[best != _NONE], size[best != _NONE]
            if not len(sym):
                break
        hit = rank == np.repeat(best, size)
        # of overlapping places, take every other one from the left
        at = np.flatnonzero(hit)
        fresh = np.r_[True, at[1:] - at[:-1] > 1]
        place = np.arange(len(at)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        at = at[place % 2 == 0]
        sym[at] = v.made[rank[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, word = sym[keep], word[keep]
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    return sym[order], np.bincount(word, minlength=n)


def split_word(v: Vocabulary, word: str) -> list[bytes | int]:
    """A word's pieces as bytes, or ids of added tokens."""
    if v.at_special is not None and "<" in word and v.at_special.search(word):
        out: list[bytes | int] = []
        for part in v.at_special.split(word):
            if part in v.special:
                out.append(v.special[part])
            elif part:
                out += split_word(v, part)
        return out
    if _PLAIN.fullmatch(word):
        return [p.encode() for p in _PIECES.findall(word.lower())]
    lib = library(v.path)
    signs = _back()
    return [bytes(signs[c] for c in p) for p, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(word))]


@lru_cache(maxsize=1)
def _back() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_symbols())}


class Words:
    """Distinct words of some texts. word: for every place its word's number; first: the places of each text;
    piece: for each word its pieces' numbers; negative numbers are added tokens, -1 - id."""

    def __init__(self, v: Vocabulary, texts: pa.Array):
        if texts.null_count:
            texts = texts.fill_null("")
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        first = np.asarray(split.offsets)
        coded = split.flatten().dictionary_encode()
        self.first = first - first[0]
        self.word = np.asarray(coded.indices)
        names = coded.dictionary.to_pylist()
        number: dict[bytes, int] = {}
        flat: list[int] = []
        count = np.zeros(len(names), np.int64)
        for i, name in enumerate(names):
            if name.isascii() and name.isalpha():  # most words
                flat.append(number.setdefault(name.lower().encode(), len(number)))
                count[i] = 1
                continue
            parts = split_word(v, name)
            count[i] = len(parts)
            flat += [-1 - p if isinstance(p, int) else number.setdefault(p, len(number)) for p in parts]
        self.flat, self.count = np.array(flat, np.int64), count
        self.named = np.array([bool(n) for n in names], bool)  # not what stands beside a leading or trailing blank
        self.pieces = list(number)
        self.length = np.array([len(p) for p in self.pieces], np.int64)
        self.raw = np.frombuffer(b"".join(self.pieces), np.uint8)

    def per_word(self, of_piece: np.ndarray, special: int) -> np.ndarray:
        """Sums over each word's pieces; `special` for an added token."""
        each = np.where(self.flat < 0, special, of_piece[np.maximum(self.flat, 0)] if len(of_piece) else special)
        return segment_sums(each, np.cumsum(np.r_[0, self.count]))

    def per_text(self, of_word: np.ndarray) -> np.ndarray:
        return segment_sums(of_word[self.word] if len(of_word) else np.zeros(0, np.int64), self.first)


def encode_words(v: Vocabulary, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(ids, tokens of each word) of all distinct words."""
    ids, size = merge_rounds(v, words.raw, words.length)
    start = np.cumsum(size) - size
    added = words.flat < 0
    piece = np.maximum(words.flat, 0)
    lengths = np.where(added, 1, size[piece] if len(size) else 1)
    pool = np.r_[ids, np.arange(v.size, dtype=np.int32)]  # behind the ids each id once, for added tokens
    source = np.where(added, len(ids) + (-1 - words.flat), start[piece] if len(start) else 0)
    return pool[ragged(source, lengths)], segment_sums(lengths, np.cumsum(np.r_[0, words.count]))


def encode_texts(v: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of whole texts."""
    words = Words(v, texts)
    ids, size = encode_words(v, words)
    start = np.cumsum(size) - size
    each = size[words.word] if len(size) else np.zeros(0, np.int64)
    flat = ids[ragged(start[words.word] if len(start) else each, each)]
    return flat, np.r_[0, np.cumsum(words.per_text(size))]


def encode(docs: DataFrame, path: str, text: str = "text") -> tuple[DataFrame, str]:
    """docs with one more column, the token ids of each whole text; its name is returned."""
    name = free_name(docs, "token_ids")

    def make(texts: pa.Array) -> list[pa.Array]:
        ids, off = encode_texts(vocabulary(path), texts)
        return [pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))]

    return append_columns(docs, text, [StructField(name, ArrayType(IntegerType()))], make), name


def decode_ids(v: Vocabulary, ids: Sequence[int]) -> str:
    """What the library decodes from ids, special tokens kept: the file has no decoder, so tokens stand apart."""
    return " ".join(v.names[i] for i in ids)


def digest(docs: DataFrame, path: str, text: str = "text") -> tuple[DataFrame, list[str]]:
    """docs with three more columns: number of tokens, sha256 of the decimal ids joined by one space, and
    sha256 of the text decoded from the ids.

    Ids become decimal and token strings by a table lookup for every id of the distinct words, and a text's
    strings are joined from those of its words."""
    names = [free_name(docs, n) for n in ("n_tokens", "ids_sha256", "decoded_sha256")]

    def make(texts: pa.Array) -> list[pa.Array]:
        v = vocabulary(path)
        words = Words(v, texts)
        ids, size = encode_words(v, words)
        end = np.cumsum(size).tolist()
        decimal = list(map(_decimals(v.size).__getitem__, ids.tolist()))
        tokens = list(map(_tokens(v.path).__getitem__, ids.tolist()))
        begin = [0, *end[:-1]]
        as_ids = [b" ".join(decimal[a:b]) for a, b in zip(begin, end)]
        as_text = [b" ".join(tokens[a:b]) for a, b in zip(begin, end)]
        filled = (size > 0).tolist()
        first, out1, out2 = words.first.tolist(), [], []
        some_empty = not all(filled)
        for a, b in zip(first[:-1], first[1:]):
            at = words.word[a:b].tolist()
            if some_empty:
                at = [i for i in at if filled[i]]
            out1.append(hashlib.sha256(b" ".join([as_ids[i] for i in at])).hexdigest())
            out2.append(hashlib.sha256(b" ".join([as_text[i] for i in at])).hexdigest())
        return [pa.array(words.per_text(size), pa.int64()), pa.array(out1, pa.string()), pa.array(out2, pa.string())]

    kinds = (LongType(), StringType(), StringType())
    return append_columns(docs, text, [StructField(n, k) for n, k in zip(names, kinds)], make), names


@lru_cache(maxsize=4)
def _decimals(n: int) -> list[bytes]:
    return [str(i).encode() for i in range(n)]


@lru_cache(maxsize=4)
def _tokens(path: str) -> list[bytes]:
    return [n.encode() for n in vocabulary(path).names]


def valid_pairs(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the strings of tokens a and b, put together, encode as just these two tokens.

    The merges that made both tokens are undone from the latest on; if, on the way, the tokens at the border
    have a merge that would have come before the last undone one, the border would not have survived."""
    ok = np.ones(len(a), bool)
    at = np.arange(len(a))
    a, b = a.copy(), b.copy()
    limit = np.full(len(a), _NONE, np.int64)
    strict = np.zeros(len(a), bool)  # the right token was undone last: at equal rank the border's merge comes first
    while len(at):
        meet = v.find(a, b).astype(np.int64)
        broken = (meet < limit) | (strict & (meet == limit) & (meet != _NONE))
        ok[at[broken]] = False
        ra, rb = v.rank_of[a].astype(np.int64), v.rank_of[b].astype(np.int64)
        go = ~broken & ((ra >= 0) | (rb >= 0))
        at, a, b, limit, strict, ra, rb = (x[go] for x in (at, a, b, limit, strict, ra, rb))
        left = ra > rb  # at equal rank the right one is later in the text: it was merged after the left one
        a = np.where(left, v.half[1][a], a)
        b = np.where(left, b, v.half[0][b])
        limit, strict = np.where(left, ra, rb), ~left
    return ok


def prefix_counts(v: Vocabulary, raw: np.ndarray, length: np.ndarray, every: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Exact token counts of all prefixes of words given as bytes, one after the other.

    Returns (inner, final): inner[i] is the number of tokens of a word's bytes up to and including byte i as
    the beginning of a longer word, final[i] as a word that ends there (0 where not asked for: without
    `every`, final holds whole words only). Positions are worked on in step for all words, longest first."""
    if len(length) and int(length.max()) > LONG:
        return _with_long_words(v, raw, length, every)
    n = len(length)
    total = int(length.sum())
    inner, final, last = np.zeros(total, np.int32), np.zeros(total, np.int32), np.full(total, -1, np.int32)
    if not total:
        return inner, final
    start = np.cumsum(length) - length
    longest = int(length.max())
    widest = min(longest, max(*v.inner.by_length, *v.final.by_length))
    order = np.argsort(-length, kind="stable")
    many = np.searchsorted(-length[order], -np.arange(1, longest + 1), side="right")  # words of so many bytes at least
    hashes = {}  # by length: hash of the bytes that end at each position
    h = np.zeros(total, np.uint64)
    base = _Hashed.BASE
    step = np.uint64(1)
    code = raw.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        for size in range(1, widest + 1):
            new = np.zeros(total, np.uint64)
            new[size - 1 :] = code[: total - size + 1] * step + (h[size - 1 :] if size > 1 else np.uint64(0))
            h, step = new, step * base
            hashes[size] = h
    place = np.arange(total) - np.repeat(start, length)
    ends = np.zeros(total, bool)
    ends[np.cumsum(length)[length > 0] - 1] = True
    memo_inner, memo_final = {}, {}
    for size in range(1, widest + 1):
        fits = place >= size - 1
        ids = np.full(total, -1, np.int32)
        ids[fits] = v.inner.find(size, hashes[size][fits])
        memo_inner[size] = ids
        want = fits if every else fits & ends
        ids = np.full(total, -1, np.int32)
        ids[want] = v.final.find(size, hashes[size][want])
        memo_final[size] = ids
    known: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, bool))

    def valid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """valid_pairs() with a table of pairs met before."""
        nonlocal known
        key, where = np.unique(a.astype(np.int64) * v.size + b, return_inverse=True)
        at = np.searchsorted(known[0], key)
        old = (at < len(known[0])) & (known[0][np.minimum(at, max(0, len(known[0]) - 1))] == key) if len(known[0]) else np.zeros(len(key), bool)
        out = np.zeros(len(key), bool)
        out[old] = known[1][at[old]]
        new = ~old
        if new.any():
            out[new] = valid_pairs(v, (key[new] // v.size).astype(np.int32), (key[new] % v.size).astype(np.int32))
            keys = np.r_[known[0], key[new]]
            by = np.argsort(keys, kind="stable")
            known = keys[by], np.r_[known[1], out[new]][by]
        return out[where]

    for i in range(longest):
        at = start[order[: many[i]]] + i
        for tokens, counts, save in ((memo_inner, inner, True), (memo_final, final, False)):
            open_ = at if save or every else at[ends[at]]
            for size in range(min(i + 1, widest), 0, -1):
                if not len(open_):
                    break
                t = tokens[size][open_]
                some = np.flatnonzero(t >= 0)
                if not len(some):
                    continue
                pos, t = open_[some], t[some]
                if size == i + 1:
                    good, before = np.ones(len(pos), bool), 0
                else:
                    good, before = valid(last[pos - size], t), inner[pos - size]
                counts[pos] = np.where(good, before + 1, counts[pos])
                if save:
                    last[pos[good]] = t[good]
                rest = np.ones(len(open_), bool)
                rest[some[good]] = False
                open_ = open_[rest]
    return inner, final


def _with_long_words(v: Vocabulary, raw: np.ndarray, length: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """prefix_counts() where some words are so long that few words are left for most positions: these one by one."""
    long, start = length > LONG, np.cumsum(length) - length
    at = ragged(start[~long], length[~long])
    inner, final = np.zeros(len(raw), np.int32), np.zeros(len(raw), np.int32)
    inner[at], final[at] = prefix_counts(v, raw[at], length[~long], every)
    widest = max(*v.inner.by_length, *v.final.by_length)

    def valid(a: int, b: int) -> bool:
        if (a, b) not in v.valid:
            v.valid[a, b] = bool(valid_pairs(v, np.array([a], np.int32), np.array([b], np.int32))[0])
        return v.valid[a, b]

    for k in np.flatnonzero(long).tolist():
        word, n = raw[start[k] : start[k] + length[k]].tobytes(), int(length[k])
        counts, ends, last = [0] * n, [0] * n, [-1] * n
        for i in range(n):
            for ids, save in ((v.inner_id, True), (v.final_id, False)):
                if not save and not every and i < n - 1:
                    continue
                for size in range(min(i + 1, widest), 0, -1):
                    t = ids.get(word[i + 1 - size : i + 1])
                    if t is not None and (size == i + 1 or valid(last[i - size], t)):
                        number = 1 + (counts[i - size] if size <= i else 0)
                        if save:
                            counts[i], last[i] = number, t
                        else:
                            ends[i] = number
                        break
        inner[start[k] : start[k] + n], final[start[k] : start[k] + n] = counts, ends
    return inner, final


def word_ends(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets in each text where a word of Words ends, and the number of words before each text (and all)."""
    raw, off = text_bytes(texts)
    inside = ~_BLANK[raw]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    last = off[1:][off[1:] > off[:-1]] - 1
    end[last] = inside[last]
    at = np.flatnonzero(end)
    first = np.searchsorted(at, off)
    return at + 1 - np.repeat(off[:-1], np.diff(first)), first


def _counted(v: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte offset of each word's end, tokens of its text up to there, words before each text): prefix counts, kept
    at the ends of words; those of a word's pieces add up."""
    words = Words(v, texts)
    _, final = prefix_counts(v, words.raw, words.length, every=False)
    whole = np.zeros(len(words.length), np.int64)
    some = words.length > 0
    whole[some] = final[np.cumsum(words.length)[some] - 1]
    each = words.per_word(whole, 1)[words.word] if len(words.word) else np.zeros(0, np.int64)
    named = words.named[words.word] if len(words.word) else np.zeros(0, bool)
    ends, first = word_ends(texts)
    running = np.cumsum(each[named])
    before = np.r_[0, running][first[:-1]] if len(first) > 1 else np.zeros(0, np.int64)
    return ends, running - np.repeat(before, np.diff(first)), first


def prefix_tokens(docs: DataFrame, path: str, text: str = "text") -> tuple[DataFrame, str]:
    """docs with one more column: for each text its prefixes that end with a word, as (end: bytes of the prefix,
    tokens: its exact number of tokens), ascending. Empty for null, empty and blank texts."""
    name = free_name(docs, "prefix_tokens")
    item = StructType([StructField("end", LongType()), StructField("tokens", LongType())])

    def make(texts: pa.Array) -> list[pa.Array]:
        ends, tokens, first = _counted(vocabulary(path), texts)
        both = pa.StructArray.from_arrays([pa.array(ends, pa.int64()), pa.array(tokens, pa.int64())], ["end", "tokens"])
        return [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), both)]

    return append_columns(docs, text, [StructField(name, ArrayType(item))], make), name


@lru_cache(maxsize=100_000)
def _prefixes(path: str, word: str) -> PrefixTable:
    return PrefixTable(path, word)


def _cut_counts(path: str, part: str) -> np.ndarray:
    """Tokens of part[:0], part[:1] and so on, for a part without white space and added tokens.

    Prefixes of a text in composed form are in that form too, so that their lower-case letters are those of the whole
    and one table of prefix counts answers for all. Other texts, whose marks may still join a letter, are encoded
    prefix by prefix."""
    if unicodedata.is_normalized("NFC", part):
        lower = [c.lower() for c in part]
        at, table = np.cumsum([0, *map(len, lower)]), _prefixes(path, part)
        if "".join(table.pieces) == "".join(lower):
            return table.upto[at]
    return np.array([len(e.ids) for lo in range(0, len(part) + 1, 256) for e in library(path).encode_batch([part[:k] for k in range(lo, min(lo + 256, len(part) + 1))], add_special_tokens=False)])


def longest_cut(path: str, word: str, room: int) -> int:
    """The most characters of a word without ASCII blanks that need no more than `room` tokens.

    Parts between white space of other kinds and between added tokens are counted one after the other. A cut within an
    added token leaves ordinary characters, which go with the part before it."""
    v, best, done = vocabulary(path), 0, 0
    for m in _NO_SPACE.finditer(word):
        if done > room:
            break
        best, at, before = m.start(), m.start(), ("", done)
        for part in v.at_special.split(m[0]) if v.at_special else [m[0]]:
            if before[1] > room:
                break
            if part in v.special:
                cuts = [before[1] + len(e.ids) for e in library(path).encode_batch([before[0] + part[:k] for k in range(1, len(part))], add_special_tokens=False)]
                counts = np.array([done, *cuts, done + 1])
            else:
                counts = done + _cut_counts(path, part)
            fits = np.flatnonzero(counts <= room)
            if len(fits):
                best = max(best, at + int(fits[-1]))
            before = ("", done + 1) if part in v.special else (part, done)
            at, done = at + len(part), int(counts[-1])
        if done <= room:
            best = at
    return len(word) if done <= room else best


def count_within(docs: DataFrame, path: str, budget: int, text: str = "text") -> tuple[DataFrame, tuple[str, str]]:
    """docs with two more columns: the exact number of tokens of each whole text, and the bytes of its longest
    prefix (in whole characters) of no more than `budget` tokens, both from prefix counts. That is the longest one for any
    text: marks, control characters, other scripts and added tokens included (longest_cut)."""
    names = free_name(docs, "n_tokens"), free_name(docs, "fitting_bytes")

    def make(texts: pa.Array) -> list[pa.Array]:
        ends, tokens, first = _counted(vocabulary(path), texts)
        if texts.null_count:
            texts = texts.fill_null("")
        size = np.asarray(pc.binary_length(texts.cast(pa.large_string()))).astype(np.int64)
        total = np.zeros(len(size), np.int64)
        some = np.diff(first) > 0
        total[some] = tokens[first[1:][some] - 1]
        fitting = size.copy()
        for k in np.flatnonzero(total > budget).tolist():
            own = tokens[first[k] : first[k + 1]]
            at = int(np.searchsorted(own, budget, side="right"))  # the first word that does not fit
            done, raw = int(own[at - 1]) if at else 0, texts[k].as_py().encode()
            end = int(ends[first[k] + at])
            begin = int(ends[first[k] + at - 1]) if at else 0
            begin += len(raw[begin:end]) - len(raw[begin:end].lstrip(_WHITE))
            word = raw[begin:end].decode()
            fitting[k] = begin + len(word[: longest_cut(path, word, budget - done)].encode())
        return [pa.array(total), pa.array(fitting)]

    return append_columns(docs, text, [StructField(n, LongType()) for n in names], make), names


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> tuple[DataFrame, str]:
    """docs with one more column, the exact number of tokens of each whole text by prefix counts."""
    name = free_name(docs, "n_tokens")

    def make(texts: pa.Array) -> list[pa.Array]:
        _, tokens, first = _counted(vocabulary(path), texts)
        total, some = np.zeros(len(texts), np.int64), np.diff(first) > 0
        total[some] = tokens[first[1:][some] - 1]
        return [pa.array(total)]

    return append_columns(docs, text, [StructField(name, LongType())], make), name


class PrefixTable:
    """The token counts of every prefix of one text, for questions about budgets without encoding again.

    Prefixes are those of the text as the tokenizer normalises it, cut between two characters of a piece or
    between pieces. upto[k] is the token count of the first k characters of `pieces` joined."""

    def __init__(self, path: str, text: str | None):
        v = vocabulary(path)
        self.pieces: list[str] = []
        upto = [0]
        done = 0
        parts = [p for word in _NO_SPACE.findall(text or "") for p in split_word(v, word)]
        raw = [p for p in parts if not isinstance(p, int)]
        length = np.array([len(p) for p in raw], np.int64)
        _, final = prefix_counts(v, np.frombuffer(b"".join(raw), np.uint8), length)
        at = 0
        for p in parts:
            if isinstance(p, int):
                self.pieces.append(v.names[p])
                upto += [done] * (len(v.names[p]) - 1) + [done + 1]  # an added token counts once it is whole
                done += 1
                continue
            name = p.decode()
            self.pieces.append(name)
            size = 0
            for c in name:
                size += len(c.encode())
                # an apostrophe and a part of a contraction stand apart until it is whole
                apart = name in ("'re", "'ve", "'ll") and size == 2
                upto.append(done + (2 if apart else int(final[at + size - 1])))
            done += int(final[at + len(p) - 1])
            at += len(p)
        self.upto = np.array(upto)

    def count(self, characters: int) -> int:
        return int(self.upto[characters])

    def longest_within(self, budget: int) -> int:
        """The most characters (of pieces joined) of which no more than `budget` tokens are needed."""
        return int(np.flatnonzero(self.upto <= budget)[-1])
