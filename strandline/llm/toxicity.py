"""Toxicity by a support vector machine on a subsequence string kernel with Nystrom landmarks.

Windows. A text is read in pieces between white space; a window is the letters of a piece (a-z, Latin-1
letters, and one symbol for all others; case folded), other characters are dropped. Pieces of a single letter that follow
each other form one window together ("i d i o t"). A piece in which other characters stand between letters
gives its letter runs as windows besides ("stupid,idiot", "i.d.i.o.t"), merged in the same way.

Kernel. phi_u(w) sums DECAY ** span over all places where the three letters u stand in w in this order within
SPAN letters; K(w, z) is the product of these vectors, normalised by lengths. So gaps and inserted characters
weaken a match but do not end it.

Machine. Landmarks are windows that occur in far more toxic training sentences than clean ones, and windows
of clean sentences; this count chooses landmarks only. The machine learns from sentences, which carry the label of
their text, in ROUNDS (multiple instances): a sentence of a toxic text is one toxic row, its window with the largest
f, where that f is above 0 or is the largest of the text; in the first round f is the kernel with the nearest toxic
landmark less that with the nearest clean one, and the bound NEAR. Clean rows are windows of clean sentences: a sample,
those with the largest f of every round, and all that stand for a toxic sentence too. The Nystrom map K_zz^(-1/2) k(w, z)
of landmarks feeds a linear squared-hinge machine over these rows, equal ones weighted by their number, with
inserted-character variants of the toxic ones. As the kernel
is a product of explicit vectors, the learned function is f(w) = <A, phi(w)> / |phi(w)| + b with one vector A:
scoring is a few gathers a letter. |phi(w)| is bounded below by its largest terms, and only windows that could
still reach the FLOOR get it exactly.

A text's margin is the second largest f of its pieces, or the largest less a constant where that is more
(one piece alone must be clearer), and its score a logistic function of it; constant and function are fitted
on the same training rows. Null and empty texts and texts without windows have f = FLOOR. Without toxic training
rows all scores are 0. Repeated rows are scored each; extra columns are not read. Training uses at most
TRAIN_TOXIC and TRAIN_CLEAN labelled documents, those with the smallest hash of doc_id, each text once."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from strandline.llm.common import append_columns, free_name, mix64, ragged, text_bytes

TRAIN_TOXIC = 1500
TRAIN_CLEAN = 3000
LANDMARKS = 160
CLEAN_LANDMARKS = 96
#: Rounds in which the machine learns and toxic sentences choose their windows anew.
ROUNDS = 3
#: In the first round sentences of toxic texts count whose best window is that much nearer to a toxic landmark than to a clean one.
NEAR = 0.5
#: A toxic training text counts so many times in the last fit, as a missed one costs more than a lost clean one.
TOXIC_WEIGHT = 3.0
SPAN = 5
DECAY = 0.6
FLOOR = -1.0
#: Bytes worked on at once (a longer text is one step); the arrays of a step are some 150 times as large.
STEP = 1 << 18

_LETTERS = 60  # 0 unused, 1-26 a-z, 27-58 Latin-1 letters by their second byte, 59 any other letter
_OFFSETS = [(a, b) for a, b in combinations(range(1, SPAN), 2)]

#: Byte classes: letters by their symbol, 0 dropped, 100 white space.
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CLASS[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_CLASS[0xC4:0xF5] = 59
_CLASS[[9, 10, 11, 12, 13, 32]] = 100


class Windows:
    """Letters of all windows, one after the other; for each window its start, length and text."""

    def __init__(self, letters: np.ndarray, start: np.ndarray, length: np.ndarray, owner: np.ndarray, piece: np.ndarray | None = None):
        self.letters, self.start, self.length, self.owner, self.piece = letters, start, length, owner, piece



def runs(letters: np.ndarray, run: np.ndarray, owner: np.ndarray, piece: np.ndarray) -> Windows:
    """Windows of letters that share a run number (ascending); single-letter runs of one text are merged."""
    if not len(letters):
        none = np.zeros(0, np.int64)
        return Windows(letters, none, none, none, none)
    start = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    length = np.diff(np.r_[start, len(letters)])
    own, single = owner[start], length == 1
    joined = np.zeros(len(start), bool)
    joined[1:] = single[1:] & single[:-1] & (own[1:] == own[:-1])
    head = np.flatnonzero(~joined)
    return Windows(letters, start[head], np.add.reduceat(length, head), own[head], piece[start[head]])


def windows(raw: np.ndarray, off: np.ndarray) -> list[Windows]:
    kind = _CLASS[raw]
    latin = np.flatnonzero(raw[:-1] == 0xC3)
    kind[latin] = 27 + (raw[latin + 1] & 0x1F)  # A0 and 80 differ in case only
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    space = kind == 100
    mark = space.copy()
    mark[off[:-1][off[:-1] < len(raw)]] = True
    piece = np.cumsum(mark)
    letter = (kind > 0) & ~space
    at = np.flatnonzero(letter)
    whole = runs(kind[at], piece[at], owner[at], piece[at])
    out = [whole]
    # pieces in which something else stands between letters: their letter runs are windows too
    if len(at) > 1:
        gap = (at[1:] - at[:-1] > 1) & (piece[at][1:] == piece[at][:-1])
        # continuation bytes of a letter are no gap
        between = raw[np.minimum(at[:-1] + 1, len(raw) - 1)]
        gap &= ~((between & 0xC0) == 0x80) | (at[1:] - at[:-1] > 2)
        if gap.any():
            mixed = np.zeros(int(piece[-1]) + 1, bool)
            mixed[piece[at][1:][gap]] = True
            sel = mixed[piece[at]]
            number = np.cumsum(np.r_[True, gap | (piece[at][1:] != piece[at][:-1])])
            out.append(runs(kind[at][sel], number[sel], owner[at][sel], piece[at][sel]))
    return out


def triples(w: Windows):
    """(cell, weight, window number, valid) for each pair of offsets of letters in a window."""
    number = np.repeat(np.arange(len(w.start), dtype=np.int32), w.length)
    if len(number) != len(w.letters):  # windows are a selection: gather their letters
        letters = w.letters[ragged(w.start, w.length)]
    else:
        letters = w.letters
    base = letters.astype(np.int32)
    for a, b in _OFFSETS:
        if len(base) <= b:
            continue
        valid = number[b:] == number[:-b]
        cell = (base[:-b] * _LETTERS + base[a : len(base) - b + a]) * _LETTERS + base[b:]
        yield cell, np.float32(DECAY ** (b + 1)), number[:-b], valid


def packed(strings: list[bytes]) -> Windows:
    """Windows of given letters."""
    length = np.array([len(s) for s in strings], np.int64)
    return Windows(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(length) - length, length, np.arange(len(strings)))


def features(strings: list[bytes], place: np.ndarray, size: int) -> np.ndarray:
    """Normalised phi of each window, reduced to the cells that `place` numbers (-1: left out)."""
    key, phi, norm = explicit(packed(strings))
    cell = place[key % _LETTERS**3]
    row = key // _LETTERS**3
    out = np.zeros((len(strings), size))
    out[row[cell >= 0], cell[cell >= 0]] = phi[cell >= 0]
    out /= np.maximum(norm, 1e-9)[:, None]
    return out


def explicit(w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The non-zero entries of phi, as (window * cells + cell, value), and each window's norm."""
    keys, weights = [np.zeros(0, np.int64)], [np.zeros(0)]
    for cell, weight, number, valid in triples(w):
        keys.append(number[valid].astype(np.int64) * _LETTERS**3 + cell[valid])
        weights.append(np.full(int(valid.sum()), weight))
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    phi = np.bincount(where, np.concatenate(weights), len(key))
    return key, phi, np.sqrt(np.bincount(key // _LETTERS**3, phi**2, len(w.start)))


class Model:
    """f(w) = <A, phi(w)> / |phi(w)| + b; score = 1 / (1 + exp(-(slope * max(second, first - alone) + shift)))."""

    def __init__(self, a: np.ndarray, b: float):
        self.a, self.b, self.slope, self.shift = a.astype(np.float32), float(b), 0.0, -50.0
        self.alone = 0.0

    def function(self, w: Windows) -> tuple[np.ndarray, np.ndarray]:
        """Window numbers that can reach the floor, and their f."""
        n = len(w.start)
        total, square = np.zeros(n), np.zeros(n)
        for cell, weight, number, valid in triples(w):
            gain = np.where(valid, self.a[cell], 0) * weight
            total += np.bincount(number, gain, n)
            square += np.maximum(0, w.length - (round(np.log(weight) / np.log(DECAY)) - 1)) * weight**2  # one term for each place
        near = np.flatnonzero((total > 0) & (total >= (FLOOR - self.b) * np.sqrt(square) - 1e-6)) if FLOOR > self.b else np.flatnonzero(square > 0)
        if not len(near):
            return near, np.zeros(0)
        few = Windows(w.letters, w.start[near], w.length[near], w.owner[near])
        return near, total[near] / np.maximum(explicit(few)[2], 1e-9) + self.b

    def margins(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """For each text the largest and second largest f of its pieces."""
        out = np.full((len(off) - 1, 2), FLOOR)
        found = [(w.owner[at], w.piece[at], f) for w in windows(raw, off) for at, f in [self.function(w)]]
        owner, piece, f = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((-f, piece))
        first = order[np.r_[True, piece[order][1:] != piece[order][:-1]][: len(order)]]  # each piece once
        order = first[np.lexsort((-f[first], owner[first]))]
        own = owner[order]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        for k in (0, 1):
            at = order[rank == k]
            out[owner[at], k] = np.maximum(FLOOR, f[at])
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        raw, off = text_bytes(texts)
        margin = np.full((len(off) - 1, 2), FLOOR)
        i = 0
        while i < len(margin):
            j = max(i + 1, int(np.searchsorted(off, off[i] + STEP, side="right")) - 1)
            margin[i:j] = self.margins(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            i = j
        return 1 / (1 + np.exp(-(self.slope * np.maximum(margin[:, 1], margin[:, 0] - self.alone) + self.shift)))


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def varied(window: bytes, rng: np.random.Generator, n: int) -> list[bytes]:
    """Copies with one letter inserted."""
    out = []
    for _ in range(n):
        i = int(rng.integers(1, max(2, len(window))))
        out.append(window[:i] + bytes([int(rng.integers(1, 27))]) + window[i:])
    return out


def nearer(strings: list[bytes], marks: np.ndarray, place: np.ndarray, toxic: int) -> np.ndarray:
    """k with the nearest of the toxic landmarks, which come first, less k with the nearest other one."""
    k = kernel(strings, marks, place)
    return k[:, :toxic].max(1, initial=0) - k[:, toxic:].max(1, initial=0)


def function_of(model: Model, names: list[bytes], which: np.ndarray, step: int = 20_000) -> np.ndarray:
    """f of the named windows, FLOOR where it is less."""
    out = np.full(len(which), FLOOR)
    for i in range(0, len(which), step):
        at, f = model.function(packed([names[k] for k in which[i : i + step]]))
        out[i + at] = np.maximum(FLOOR, f)
    return out


class Bags:
    """Windows of the sentences of toxic texts: (window, sentence) pairs, and the text of every sentence."""

    def __init__(self, name: np.ndarray, sentence: np.ndarray, of_text: np.ndarray):
        self.names, self.name = np.unique(name, return_inverse=True)
        self.sentence, self.text = sentence, of_text[sentence]

    def chosen(self, f: np.ndarray, above: float) -> tuple[np.ndarray, np.ndarray]:
        """Windows that stand for toxic sentences, and for how many: in each text its best sentence, and
        every other sentence whose best window has f above a bound."""
        value = f[self.name]
        order = np.lexsort((self.names[self.name], -value, self.sentence))
        best = order[np.r_[True, np.diff(self.sentence[order]) != 0][: len(order)]]
        order = best[np.lexsort((self.sentence[best], -value[best], self.text[best]))]
        first = np.r_[True, np.diff(self.text[order]) != 0][: len(order)]
        return np.unique(self.names[self.name[order[first | (value[order] > above)]]], return_counts=True)


def kernel(strings: list[bytes], marks: np.ndarray, place: np.ndarray, step: int = 512) -> np.ndarray:
    """k(w, z) of windows and landmark vectors."""
    return np.concatenate([features(strings[i : i + step], place, marks.shape[1]) @ marks.T for i in range(0, len(strings), step)])


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear squared-hinge machine by Newton steps; y is -1 or 1."""
    x1 = np.c_[x, np.ones(len(x))]
    w = np.zeros(x1.shape[1])
    reg = np.full(len(w), ridge)
    reg[-1] = 1e-6
    for _ in range(50):
        active = y * (x1 @ w) < 1
        xa, wa = x1[active], weight[active]
        new = np.linalg.solve((xa * wa[:, None]).T @ xa + np.diag(reg), (xa * wa[:, None]).T @ y[active])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and shift of P(y = 1 | x), with smoothed targets (Platt)."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x1 = np.c_[x, np.ones(len(x))]
    w = np.zeros(x1.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x1 @ w))
        step = np.linalg.solve((x1 * (weight * p * (1 - p))[:, None]).T @ x1 + 1e-3 * np.eye(len(w)), x1.T @ (weight * (t - p)) - 1e-3 * w)
        step *= min(1, 4 / max(1e-9, np.abs(step).max()))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def distinct_texts(texts: list[str], bands: int = 16, rows: int = 3) -> list[str]:
    """The texts without later near copies (any band of min-wise hashes of five-word shingles agrees): one
    passage that many training rows share must not look like many witnesses."""
    rng = np.random.default_rng(1)
    mul = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    seen: set[tuple] = set()
    out = []
    for t in texts:
        words = t.lower().split()
        h = np.array([int.from_bytes(blake2b(" ".join(words[i : i + 5]).encode(), digest_size=8).digest()) for i in range(max(1, len(words) - 4))], np.uint64)
        with np.errstate(over="ignore"):
            least = mix64(h[None, :] * mul[:, None]).min(1).reshape(bands, rows)
        keys = {(i, *least[i].tolist()) for i in range(bands)}
        if not keys & seen:
            out.append(t)
        seen |= keys
    return out


def train(rows: list[tuple[str, int]], seed: int = 7) -> Model | None:
    """rows: (text, label). Copies and near copies count once; a text with both labels counts as toxic, and of near
    copies with different labels the first text's label counts. Texts of one label only teach nothing: None."""
    label: dict[str, int] = {}
    for text, toxic in rows:
        if text:
            label[text] = max(label.get(text, 0), int(toxic))
    texts = distinct_texts(sorted(label))
    y = np.array([label[t] for t in texts])
    if not y.sum() or y.all():
        return None
    rng = np.random.default_rng(seed)
    sentences, of = [], []
    for i, t in enumerate(texts):
        for s in re.split(r"[.!?\n]+", t):
            if s.strip():
                sentences.append(s)
                of.append(i)
    of_text = np.array(of, np.int64)
    number: dict[bytes, int] = {}
    pairs = []  # (window, sentence), each once; worked on in steps, as the arrays of a step are many times its text
    for lo in range(0, len(sentences), 4000):
        w = windows(*joined(sentences[lo : lo + 4000]))[0]
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w.start), [None, pa.py_buffer(np.r_[w.start, len(w.letters)].astype(np.int64)), pa.py_buffer(w.letters)]).dictionary_encode()
        ids = np.array([number.setdefault(x, len(number)) for x in coded.dictionary.to_pylist()], np.int64)
        pairs.append(np.unique(ids[np.asarray(coded.indices)] * len(sentences) + lo + w.owner))
    names, known = list(number), number
    name_of, sentence_of = np.divmod(np.unique(np.concatenate(pairs)), len(sentences))
    del sentences, pairs, w, coded
    # in how many texts of each label a window occurs, each text once
    pair = np.unique(name_of * len(texts) + of_text[sentence_of])
    toxic = y[pair % len(texts)]
    n1 = np.bincount(pair // len(texts), toxic, len(names))
    n0 = np.bincount(pair // len(texts), 1 - toxic, len(names))
    rate1, rate0 = n1 / y.sum(), n0 / (len(y) - y.sum())
    pooled = (n1 + n0) / len(y)
    z = (rate1 - rate0) / np.sqrt(np.maximum(pooled * (1 - pooled) * (1 / y.sum() + 1 / (len(y) - y.sum())), 1e-12))
    long = np.array([len(s) >= 3 for s in names])
    # where few texts are toxic no window is that sure: the best there are take part then
    for least, sure, times in ((4, 5, 10), (2, 3, 3), (1, 0, 1), (1, -np.inf, 0)):
        bad = np.flatnonzero((z > sure) & (n1 >= least) & (rate1 > times * rate0) & long)
        if len(bad):
            break
    bad = bad[np.argsort(-z[bad], kind="stable")][:LANDMARKS]
    if not len(bad):  # no toxic text has a window of three letters
        return None
    clean = np.flatnonzero((n1 <= n0 * max(1e-9, y.mean()) * 3 + 1) & (n0 > 0) & long)
    common = clean[np.argsort(-n0[clean], kind="stable")][: CLEAN_LANDMARKS // 2]
    marks = [names[i] for i in [*bad, *common]]
    clean_rows = [*common, *clean[rng.permutation(len(clean))[:4000]]]
    some = (y[of_text[sentence_of]] == 1) & long[name_of]
    bags = Bags(name_of[some], sentence_of[some], of_text)
    model = None
    for turn in range(ROUNDS):
        key = explicit(packed(marks))[0]
        cells = np.unique(key % _LETTERS**3)
        place = np.full(_LETTERS**3, -1)
        place[cells] = np.arange(len(cells))
        zv = features(marks, place, len(cells))
        if model is None:
            f = np.concatenate([nearer([names[i] for i in part], zv, place, len(bad)) for part in np.array_split(bags.names, len(bags.names) // 4096 + 1)])
        else:
            f = function_of(model, names, bags.names)
        chosen, number_of = bags.chosen(f, NEAR if model is None else 0.0)
        value, basis = np.linalg.eigh(zv @ zv.T)
        root = basis @ np.diag(1 / np.sqrt(np.maximum(value, 1e-4))) @ basis.T
        rows, weight = [], []
        for i, n in zip(chosen.tolist(), number_of.tolist()):
            other = [v for v in varied(names[i], rng, 8) if v not in known]
            rows += [names[i], *other]
            weight += [float(n)] + [n / 4] * len(other)
        both = chosen[n0[chosen] > 0]  # windows of clean sentences too
        share = max(1, len(clean_rows)) / 2 / sum(weight)
        sign = np.r_[np.ones(len(rows)), -np.ones(len(clean_rows) + len(both))]
        balance = np.r_[np.array(weight) * share, np.ones(len(clean_rows)), n0[both] * share]
        beta, b = machine(kernel(rows + [names[i] for i in [*clean_rows, *both]], zv, place) @ root, sign, balance)
        a = np.zeros(_LETTERS**3)
        a[cells] = (root @ beta) @ zv
        model = Model(a, b)
        if turn < ROUNDS - 1:  # clean windows that come nearest join the rows, and the landmarks at first
            order = clean[rng.permutation(len(clean))]
            f = function_of(model, names, order)
            hard = [order[k] for k in np.argsort(-f, kind="stable")[:500] if f[k] > FLOOR]
            clean_rows += hard
            if turn == 0:
                marks += [names[i] for i in hard[: CLEAN_LANDMARKS // 2]]
    margin = np.concatenate([model.margins(*joined(texts[i : i + 100])) for i in range(0, len(texts), 100)])
    fits, weight = [], np.where(y > 0, TOXIC_WEIGHT, 1.0)
    for alone in np.arange(0, 4.1, 0.5):
        x = np.maximum(margin[:, 1], margin[:, 0] - alone)
        slope, shift = logistic(x[:, None], y, weight)
        p = np.clip(1 / (1 + np.exp(-(slope[0] * x + shift))), 1e-9, 1 - 1e-9)
        fits.append((-(weight * y * np.log(p) + (1 - y) * np.log(1 - p)).sum(), alone, slope[0], shift))
    _, model.alone, model.slope, model.shift = min(fits)
    return model


def fit(docs: DataFrame, labels: DataFrame, where: Column, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN) -> Model | None:
    """The model of at most so many labelled rows of each label; one task learns it from this bounded sample."""
    rows = labels.where(where & F.col("toxic").isNotNull()).select("doc_id", "toxic").distinct()
    first = lambda t, n: rows.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = first(1, toxic).unionByName(first(0, clean))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull()).select("text", "toxic")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(got))], pa.binary())], names=["model"])

    made = found.repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(made[0].model) if made else None


def score(docs: DataFrame, model: Model | None, text: str = "text") -> tuple[DataFrame, str]:
    """docs with one more column, the score; its name is returned. A map, no shuffle."""
    name = free_name(docs, "toxic_score")
    if model is None:
        return docs.withColumn(name, F.lit(0.0)), name
    held = docs.sparkSession.sparkContext.broadcast(model)
    return append_columns(docs, text, [StructField(name, DoubleType())], lambda texts: [pa.array(held.value.scores(texts))]), name
