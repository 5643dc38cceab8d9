"""Language identification by prediction by partial matching over bytes.

For every language a context tree of orders 0 to 3 is counted on a bounded sample of labelled documents
and then frozen. A byte s after a context costs -log2 p(s), where, by escape method C,

    p_k(s) = c / (T + D)                     if s was seen c times after the k bytes before it
    p_k(s) = D / (T + D) * p_(k-1)(s)        else: escape to the context that is one byte shorter

with T the context's count and D its number of distinct next bytes; an unseen context costs nothing, and
below order 0 all symbols are alike. The language with the shortest code of the whole text wins.

As statistics are frozen, the code length of every (context, byte) with all its escapes is worked out once,
for all languages at once, into a table that tasks gather from: no loop over bytes, no state between them.

Bytes are folded first: A-Z to a-z, white space to one blank, digits to one digit, and bytes beyond the
ALPHABET most frequent ones to one symbol.

Null texts and texts without a letter get "und" with score 0; ties go to the first language in order of
name; without any labelled row every text is "und". Repeated rows are judged each; extra columns are not
read. The sample is TRAIN_DOCS whole documents a language of no more than TRAIN_BYTES bytes each, those with the
smallest hash of doc_id. Its texts stay in tasks, which count them; the driver gets counts and makes the table of at
most MODEL_CELLS code lengths.

known() keeps the texts that some learned language codes about as well as the training texts: the bound follows the
median of these, which junk among them hardly moves. Letters at random, or a language that was never learned, cost more, as few of their contexts are in a
tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField

from strandline.llm.common import append_columns, chunks, free_name, materialize, ragged, segment_sums, text_bytes

TRAIN_DOCS = 400
TRAIN_BYTES = 200_000
#: A text of a learned language costs at most MARGIN times what the median training text of LEAST_BYTES bytes and more
#: does, within LEAST_BITS to MOST_BITS bits a byte (training texts that repeat themselves cost next to nothing, and
#: plain texts of their language several times as much), and so many bits more whatever its length.
MARGIN, LEAST_BYTES, LEAST_BITS, MOST_BITS, SLACK = 2.5, 100, 4.0, 8.0, 128.0
ALPHABET = 112
#: Contexts of three bytes are kept from so many occurrences on, over all languages.
MIN_CONTEXT = 4
#: Code lengths in a model at most (4 bytes each), so that it can be sent to all executors however many languages there are.
MODEL_CELLS = 100_000_000
#: Bytes worked on at once; a longer text is summed piece by piece.
STEP = 1 << 20

_BLANK = ord(" ")


def fold_table() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    fold[[9, 10, 11, 12, 13]] = _BLANK
    fold[ord("0") : ord("9") + 1] = ord("0")
    return fold


class Model:
    """The frozen statistics of all languages. lut: byte to symbol; row: three symbols to table row;
    cost: (row, symbol) to bits, a column for each language."""

    def __init__(self, languages: list[str], lut: np.ndarray, size: int, blank: int, row: np.ndarray, cost: np.ndarray):
        self.languages, self.lut, self.size, self.blank, self.row, self.cost = languages, lut, size, blank, row, cost
        self.typical = 0.0  # bits a byte of the median training text, of those of LEAST_BYTES and more

    def bits(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code lengths, a row for each text and a column for each language."""
        out = np.zeros((len(off) - 1, len(self.languages)))
        for lo in range(0, len(raw), STEP):
            hi = min(len(raw), lo + STEP)
            head = min(3, lo)
            sym = self.lut[raw[lo - head : hi]].astype(np.int32)
            cut = off[np.searchsorted(off, lo - 2) : np.searchsorted(off, hi)] - lo + head  # texts that start here or just before
            before = []
            for k in (1, 2, 3):
                c = np.empty_like(sym)
                c[:k], c[k:] = self.blank, sym[:-k]
                for j in range(k):
                    at = cut + j
                    c[at[(at >= 0) & (at < len(c))]] = self.blank
                before.append(c)
            context = (before[2] * self.size + before[1]) * self.size + before[0]
            cell = self.row[context[head:]] * np.int64(self.size) + sym[head:]
            part = np.clip(off, lo, hi) - lo
            a = max(0, int(np.searchsorted(off, lo, side="right")) - 1)
            b = int(np.searchsorted(off, hi, side="left"))
            out[a:b] += segment_sums(np.take(self.cost, cell, axis=0).astype(np.float64), part[a : b + 1])
        return out


def symbols(raw: np.ndarray, off: np.ndarray, lut: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' symbols, each text led by three blanks, and which of them are the texts' own."""
    size = np.diff(off)
    own = np.ones(len(raw) + 3 * len(size), bool)
    own[ragged(off[:-1] + 3 * np.arange(len(size)), np.full(len(size), 3))] = False
    out = np.full(len(own), blank, np.int64)
    out[own] = lut[raw]
    return out, own


def byte_counts(rows: DataFrame) -> dict[str, np.ndarray]:
    """How often a sample's (l, t) texts hold each folded byte, a row for each language; those without a byte are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = fold_table()
        for batch in batches:
            for part in chunks(batch, "t", STEP):
                raw, off = text_bytes(part.column("t"))
                who, at = np.unique(np.asarray(part.column("l").to_pylist(), object), return_inverse=True)
                code = np.repeat(at, np.diff(off)) * 256 + fold[raw]
                cell, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(who[cell // 256].tolist(), pa.string()), pa.array(cell % 256), pa.array(n)], names=["l", "byte", "n"])

    out: dict[str, np.ndarray] = {}
    for x in rows.mapInArrow(run, "l string, byte long, n long").groupBy("l", "byte").agg(F.sum("n").alias("n")).collect():
        out.setdefault(x.l, np.zeros(256, np.int64))[x.byte] = x.n
    return {k: out[k] for k in sorted(out)}


def gram_counts(rows: DataFrame, languages: list[str], lut: np.ndarray, size: int, blank: int) -> DataFrame:
    """(i, context, s, n): how often symbol s follows three symbols in the texts of language i; counted in every task, then
    summed. All shorter contexts' counts are sums of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {k: i for i, k in enumerate(languages)}
        for batch in batches:
            for part in chunks(batch, "t", STEP):
                raw, off = text_bytes(part.column("t"))
                s, own = symbols(raw, off, lut, blank)
                who = np.array([place.get(k, -1) for k in part.column("l").to_pylist()])
                lead = np.flatnonzero(own)
                gram = ((s[lead - 3] * size + s[lead - 2]) * size + s[lead - 1]) * size + s[lead]
                cell, n = np.unique(np.repeat(who, np.diff(off)) * size**4 + gram, return_counts=True)
                arrays = [cell // size**4, cell % size**4 // size, cell % size, n]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["i", "context", "s", "n"])

    return rows.mapInArrow(run, "i long, context long, s long, n long").groupBy("i", "context", "s").agg(F.sum("n").alias("n"))


def train(rows: DataFrame) -> Model | None:
    """The model of a sample (l, t). Texts are counted where they lie; the driver gets sums: of each language the bytes, the
    grams of three symbols and of four whose context is kept. No more than MODEL_CELLS code lengths are kept: where
    languages and contexts are too many for that, contexts of three symbols are those met most often."""
    bytes_ = byte_counts(rows)
    if not bytes_:
        return None
    languages = list(bytes_)
    fold, seen = fold_table(), sum(bytes_.values())
    kept = [int(b) for b in np.argsort(-seen, kind="stable")[:ALPHABET] if seen[b]]
    if _BLANK not in kept:
        kept.append(_BLANK)
    size = len(kept) + 1
    place = np.full(256, size - 1, np.uint8)  # the last symbol: all other bytes
    place[kept] = np.arange(len(kept))
    lut, blank = place[fold], kept.index(_BLANK)

    grams = materialize(gram_counts(rows, languages, lut, size, blank), "language-grams")
    met = grams.groupBy("context").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_CONTEXT)
    two = grams.groupBy("i", (F.col("context") % size**2).alias("context"), "s").agg(F.sum("n").alias("n"))
    short = columns(two)
    every = [None, np.arange(size), np.unique(short[1]), None]
    room = max(0, MODEL_CELLS // (size * len(languages)) - 1 - size - len(every[2]))
    if met.count() > room:
        met = met.orderBy(F.desc("n"), "context").limit(room)
    long_ = columns(grams.join(met.select("context"), "context", "left_semi"))
    every[3] = np.unique(long_[1])

    tables = [[] for _ in range(4)]  # by order: probabilities (row, symbol) of each language
    for i in range(len(languages)):
        (c2, s2, n2), (c3, s3, n3) = ([x[found[0] == i] for x in found[1:]] for found in (short, long_))
        count = np.bincount(s2, n2, minlength=size)
        t, d = count.sum(), (count > 0).sum()
        p = np.where(count > 0, count / (t + d), d / (t + d) / size)[None, :]
        tables[0].append(p.astype(np.float32))
        for order, c, s, n in ((1, c2 % size, s2, n2), (2, c2, s2, n2), (3, c3, s3, n3)):
            wanted = every[order]
            count = np.bincount(np.searchsorted(wanted, c) * size + s, n, minlength=len(wanted) * size).reshape(-1, size).astype(np.float32)
            t, d = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
            shorter = wanted % size ** (order - 1)
            lower = tables[order - 1][-1][np.searchsorted(every[order - 1], shorter) if order > 1 else np.zeros(len(wanted), int)]
            with np.errstate(invalid="ignore", divide="ignore"):
                p = np.where(count > 0, count / (t + d), d / (t + d) * lower)
            tables[order].append(np.where(t > 0, p, lower).astype(np.float32))

    first = np.cumsum([0, *(len(tables[o][0]) for o in range(4))])
    cost = np.stack([np.concatenate([tables[o][i] for o in range(4)]) for i in range(len(languages))], axis=-1)
    three = np.arange(size**3, dtype=np.int32)
    row = (first[1] + three % size).astype(np.int32)
    for order in (2, 3):
        known = np.full(size**order, -1, np.int32)
        known[every[order]] = first[order] + np.arange(len(every[order]))
        found = known[three % size**order]
        row = np.where(found >= 0, found, row)
    model = Model(languages, lut, size, blank, row, -np.log2(cost).reshape(-1, len(languages)).astype(np.float32))
    model.typical = typical(rows, model)
    return model


def columns(found: DataFrame) -> tuple[np.ndarray, ...]:
    """(i, context, s, n) of counts."""
    got = found.select("i", "context", "s", "n").toArrow()
    return tuple(got.column(k).to_numpy() for k in range(4))


def typical(rows: DataFrame, model: Model) -> float:
    """Bits a byte of the median text of a sample, of those of LEAST_BYTES and more; 0 if there is none."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def make(texts: pa.Array) -> list[pa.Array]:
        raw, off = text_bytes(texts)
        return [pa.array(held.value.bits(raw, off).min(1) / np.maximum(1, np.diff(off)))]

    long_ = rows.where(F.octet_length("t") >= LEAST_BYTES).select("t")
    got = append_columns(long_, "t", [StructField("bits", DoubleType())], make).agg(F.median("bits")).first()[0]
    held.unpersist()
    return got or 0.0


def sample(docs: DataFrame, where: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", each: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(l, t): at most `each` whole labelled texts of every language, as a table in the shared folder. Rows that repeat a
    key and a language count once, by the smallest of their texts.

    Rows of a language are counted first; only those with a hash below a bound that some four times `each`
    rows pass are ranked, so a language's ranking never meets a great part of the rows in one task."""
    hash_ = F.shiftrightunsigned(F.xxhash64(F.col(key)), 1)
    fit = where & F.col(lang).isNotNull() & (F.octet_length(text) <= most_bytes)
    rows = docs.where(fit).select(F.col(key).alias("k"), F.col(lang).alias("l"), hash_.alias("h"))
    share = rows.groupBy("l").agg((F.lit(4.0 * each + 100) / F.count("*")).alias("share"))
    below = rows.join(F.broadcast(share), "l").where(F.col("h") / float(2**63) <= F.col("share"))  # a row for each language
    order = Window.partitionBy("l").orderBy("h", "k")
    chosen = below.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= each).select("k", "l")
    found = docs.where(fit).select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t")).join(F.broadcast(chosen), ["k", "l"], "left_semi")
    return materialize(found.groupBy("k", "l").agg(F.min("t").alias("t")).select("l", "t"), "language-sample")


def known(docs: DataFrame, model: Model | None, text: str = "text", margin: float = MARGIN, slack: float = SLACK) -> DataFrame:
    """The rows whose text has a letter and is one of a learned language by its code length: no more than `margin` times
    the bits a byte of the median training text, LEAST_BITS at least and MOST_BITS at most, and `slack` bits that short texts need. Null and
    empty texts go; without a model nothing is known and all rows go. A map, no shuffle."""
    if model is None:
        return docs.where(F.lit(False))
    most_bits = min(MOST_BITS, max(LEAST_BITS, margin * model.typical)) if model.typical else MOST_BITS
    fits, held = free_name(docs, "lang_fits"), docs.sparkSession.sparkContext.broadcast(model)

    def make(texts: pa.Array) -> list[pa.Array]:
        raw, off = text_bytes(texts)
        return [pa.array(held.value.bits(raw, off).min(1) <= most_bits * np.diff(off) + slack)]

    lettered = docs.where(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    return append_columns(lettered, text, [StructField(fits, BooleanType())], make).where(F.col(fits)).drop(fits)


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> tuple[DataFrame, str, str]:
    """docs with two more columns, the language and its score; their names are returned. A map, no shuffle."""
    pred, score, bits = free_name(docs, "lang_pred"), free_name(docs, "lang_score"), free_name(docs, "lang_bits")
    if model is None:
        return docs.withColumns({pred: F.lit("und"), score: F.lit(0.0)}), pred, score
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts: pa.Array) -> list[pa.Array]:
        found = held.value.bits(*text_bytes(texts))
        flat = pa.array(found.ravel())
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), flat)]

    names = F.array(*[F.lit(x) for x in model.languages])
    least = F.array_min(bits)
    posterior = 1 / F.aggregate(bits, F.lit(0.0), lambda a, x: a + F.pow(F.lit(2.0), least - x))
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    out = append_columns(docs, text, [StructField(bits, ArrayType(DoubleType()))], make)
    out = out.withColumns({
        pred: F.when(letters, F.element_at(names, F.array_position(bits, least).cast("int"))).otherwise("und"),
        score: F.when(letters, posterior).otherwise(0.0),
    })
    return out.drop(bits), pred, score
