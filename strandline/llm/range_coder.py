"""An adaptive context-mixing range coder for token ids, run for many independent blocks in step.

Orders. Order 0 is the frequency of every id, order 1 the frequency of the ids that follow an id, both gathered
over the container and kept in its head: every block starts from them. Order 2 is learned by each block: a
table of the id that followed the last two ids, with a confidence.

An id is coded by arithmetic coding in up to three parts:

    1. whether it is the guess, which is the order-2 follower, else the commonest order-1 follower. The chance
       is a logistic mix of what the guess's confidence has meant in this block so far (order 2), of its order-1
       and of its order-0 frequency, with weights that follow the coding errors;
    2. if not, the id by its order-1 frequency without the guess, or an escape;
    3. behind an escape, the id by its order-0 frequency.

Confidences, chances and weights are a block's own and start anew in each. All arithmetic is in integers, so
every machine decodes what any other encoded.

Blocks are the lanes of numpy arrays: a step codes the next id of every block. Block i holds ids
i * BLOCK .. (i + 1) * BLOCK - 1 of the sequence, so only the last one is shorter. The head with the frequencies
has a checksum, and each block one of its own; a block needs the head and its own bytes only."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np

BLOCK = 1024
#: Blocks coded in step, at most.
LANES = 8192
#: Followers of an id are in the head from so many occurrences on.
LEAST = 3

_SLOTS = 10  # bits of a context's slot
_SURER = 15  # the highest confidence
_MAGIC = b"SLT2"
_HEAD = struct.Struct("<4sIQIII")  # magic, blocks, ids, ids of a block, bytes of the frequencies, checksum of what stands before
_TOTAL = 1 << 20  # no row of frequencies sums up to more
_SURE = 128  # a guess's chance is this much of 65536 at least and leaves as much
_LOW, _SHIFT = 1 << 30, 32  # a width below _LOW moves on by _SHIFT bits

_STRETCH_IN = (np.arange(4096) + 0.5) / 4096
_STRETCH = np.rint(np.log(_STRETCH_IN / (1 - _STRETCH_IN)) * 256).astype(np.int64)
_SQUASH = np.clip(np.rint(65536 / (1 + np.exp(-np.arange(-2047, 2048) / 256.0))), _SURE, 65536 - _SURE).astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers of up to 32 bits, their bytes apart, compressed."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes(), 6)


def _unplanes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").ravel().astype(np.int64)


class Frequencies:
    """Rows of (symbol, count): row 0 is order 0, the others belong to an id each and end with an escape.

    ids: the ids that occur, ascending; a symbol is a place in them, len(ids) the escape. row_of: each symbol's
    row (0: it has none). symbol, count, first: the entries of all rows and the counts before each one."""

    def __init__(self, ids: np.ndarray, zero: np.ndarray, sizes: np.ndarray, followers: np.ndarray, counts: np.ndarray, escapes: np.ndarray):
        self.parts = ids, zero, sizes, followers, counts, escapes
        self.ids, n = ids, len(ids)
        own = np.flatnonzero(sizes)
        self.row_of = np.zeros(n + 1, np.int64)
        self.row_of[own] = np.arange(1, len(own) + 1)
        # row 0 has an escape too, which is never coded: so every row has two entries at least
        length = np.r_[n, sizes[own]] + 1
        ends = np.cumsum(length)
        self.start = ends - length
        entries = int(ends[-1])
        self.escape = np.zeros(entries, bool)
        self.escape[ends - 1] = True
        self.symbol, self.count = np.full(entries, n, np.int64), np.zeros(entries, np.int64)
        self.symbol[~self.escape], self.count[~self.escape] = np.r_[np.arange(n), followers], np.r_[zero, counts]
        self.count[self.escape] = np.r_[1, escapes[own]]
        row = np.repeat(np.arange(len(length)), length)
        total = np.add.reduceat(self.count, self.start)
        while (over := total > _TOTAL).any():
            self.count = np.where(over[row], (self.count + 1) >> 1, self.count)
            total = np.add.reduceat(self.count, self.start)
        self.first = np.cumsum(self.count) - self.count
        self.base, self.total = self.first[self.start], total
        self.entry_at = np.repeat(np.arange(entries), self.count)
        self.within = self.first - self.base[row]
        self.row = np.r_[row, -1]
        self.top = np.lexsort((-self.count, row))[self.start] << 5 | (_SURER + 1)
        share = lambda a, b: _STRETCH[np.minimum(4095, a * 4096 // b)]
        self.one = share(self.count, total[row])
        common = np.r_[self.count[:n], self.count[self.escape].sum() // len(length) + 1]
        self.zero = share(common, np.maximum(total[0], common + 1))[self.symbol]

    @classmethod
    def of(cls, x: np.ndarray, block: int) -> tuple[Frequencies, np.ndarray, np.ndarray]:
        """The frequencies of a sequence of ids, for each id its symbol, and the entry of its row that codes it."""
        if len(x) and x.max() < 1 << 22:
            every = np.bincount(x)
            ids = np.flatnonzero(every)
            zero = every[ids]
            place = np.zeros(len(every), np.int32)
            place[ids] = np.arange(len(ids))
            at = place.take(x)
        else:
            ids, at, zero = np.unique(x, return_inverse=True, return_counts=True)
            at = at.astype(np.int32)
        n, bits = len(ids), max(1, len(x).bit_length())
        if n * n >= 1 << (62 - bits):
            raise ValueError("too many ids for one container")
        packed = at[:-1] * np.int64(n)
        packed += at[1:]
        packed[block - 1 :: block] = n * n  # the first id of a block has none before it
        packed <<= bits
        packed |= np.arange(1, max(1, len(x)))
        packed.sort()
        packed = packed[: len(x) - -(-len(x) // block)]
        some = packed & ((1 << bits) - 1)
        packed >>= bits
        key = packed
        lead = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        times = np.diff(np.r_[lead, len(key)])
        before, follower = key[lead] // max(1, n), key[lead] % max(1, n)
        kept = times >= LEAST
        sizes = np.bincount(before[kept], minlength=n)
        escapes = np.bincount(before[~kept], times[~kept], n).astype(np.int64)
        out = cls(ids, zero, sizes, follower[kept], times[kept], np.where(sizes > 0, np.maximum(1, escapes), 0))
        del packed, key
        entry = at.copy()  # in row 0
        row = out.row_of[before]
        number = np.zeros(len(lead), np.int32)
        number[kept] = np.flatnonzero(~out.escape)[n:]
        ends = np.flatnonzero(out.escape)
        own = np.where(kept, number, np.where(row > 0, ends[row], follower)).astype(np.int32)
        entry[some] = np.repeat(own, times)
        return out, at, entry

    def to_bytes(self) -> bytes:
        ids, zero, sizes, followers, counts, escapes = self.parts
        lead = np.r_[0, np.cumsum(sizes)[:-1]][sizes > 0] if len(sizes) else np.zeros(0, np.int64)
        steps = np.diff(followers, prepend=0)
        steps[lead] = followers[lead]
        data = [_planes(v) for v in (np.diff(ids, prepend=0), zero, sizes, steps, counts, escapes)]
        return struct.pack("<6I", *map(len, data)) + b"".join(data)

    @classmethod
    def from_bytes(cls, data: bytes) -> Frequencies:
        ends = 24 + np.cumsum(struct.unpack_from("<6I", data))
        ids, zero, sizes, steps, counts, escapes = (_unplanes(data[a:b]) for a, b in zip([24, *ends[:-1]], ends))
        run = np.cumsum(steps)
        lead = (np.cumsum(sizes) - sizes)[sizes > 0]
        followers = run - np.repeat(run[lead] - steps[lead], sizes[sizes > 0])
        return cls(np.cumsum(ids), zero, sizes, followers, counts, escapes)


class _Model:
    """The state of all lanes, the same for both directions: guess() before an id is coded, learn() behind it."""

    def __init__(self, lanes: int, tables: Frequencies):
        self.t = tables
        lane = np.arange(lanes)
        self.table = np.full(lanes << _SLOTS, len(tables.count) << 5, np.int64)  # entry << 5 | confidence; at first one of no row
        self.base = lane << _SLOTS
        self.chance = np.full(lanes * (_SURER + 2), 1 << 14, np.int64)  # by confidence, the last: no order-2 guess
        self.chance_at = lane * (_SURER + 2)
        self.weight = [np.full(lanes, w, np.int64) for w in (30000, 30000, 4000)]
        self.row = np.zeros(lanes, np.int64)
        self.one, self.two = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)  # hashes of the symbols before

    def guess(self, n: int) -> None:
        """For the first n lanes: guessed entry and its chance in 65536."""
        t, row = self.t, self.row[:n]
        self.slot = self.base[:n] + ((self.one[:n] ^ self.two[:n]) >> np.uint32(32 - _SLOTS))
        self.found = self.table.take(self.slot)
        self.follower = self.found >> 5
        guess = np.where(t.row.take(self.follower) == row, self.found, t.top.take(row))
        self.guessed = guess >> 5
        guess &= 31
        guess += self.chance_at[:n]
        self.cell = guess
        self.old = self.chance.take(guess)
        self.input = _STRETCH.take(self.old >> 4), t.one.take(self.guessed), t.zero.take(self.guessed)
        dot = self.weight[0][:n] * self.input[0]
        dot += self.weight[1][:n] * self.input[1]
        dot += self.weight[2][:n] * self.input[2]
        dot >>= 16
        dot += 2047
        self.p = _SQUASH.take(dot, mode="clip")

    def learn(self, n: int, hit: np.ndarray, entry: np.ndarray, symbol: np.ndarray, even: bool) -> None:
        """hit: whether the guess was right; entry: of the id in its row; symbol: the id itself; even: an even step."""
        y = hit * np.int64(65536)
        step = y - self.old
        step >>= 4
        step += self.old
        self.chance[self.cell] = step
        if even:  # every other error is enough
            y -= self.p
            y >>= 2
            for w, x in zip(self.weight, self.input):
                x *= y
                x >>= 12
                w[:n] += x
        same = self.follower == entry
        same &= self.found & 31 < _SURER
        self.found += same  # surer
        self.table[self.slot] = np.where(self.follower == entry, self.found, entry << 5)
        np.multiply(self.one[:n], np.uint32(0x85EBCA77), out=self.two[:n])
        np.multiply(symbol.astype(np.uint32), np.uint32(0x9E3779B1), out=self.one[:n])
        self.t.row_of.take(symbol, out=self.row[:n], mode="clip")


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """All ids (0 to 2^32 - 1) as one container: a head, its frequencies, a table of blocks, the blocks' bytes."""
    ids = np.asarray(ids)
    total = len(ids)
    tables, symbol, entry = Frequencies.of(ids, block)
    parts: list[bytes] = []
    for lo in range(0, total, block * LANES):
        parts += _encode_lanes(tables, symbol[lo : lo + block * LANES], entry[lo : lo + block * LANES], block)
    held = tables.to_bytes()
    table = np.array([[len(p), zlib.crc32(p)] for p in parts], "<u4").reshape(-1, 2).tobytes()
    head = _HEAD.pack(_MAGIC, len(parts), total, block, len(held), zlib.crc32(held + table))
    return head + struct.pack("<I", zlib.crc32(head)) + held + table + b"".join(parts)


def _encode_lanes(t: Frequencies, symbols: np.ndarray, entries: np.ndarray, block: int) -> list[bytes]:
    lanes = -(-len(symbols) // block)
    last = len(symbols) - (lanes - 1) * block

    def turned(x: np.ndarray) -> np.ndarray:
        grid = np.zeros(lanes * block, np.int32)
        grid[: len(x)] = x
        return np.ascontiguousarray(grid.reshape(lanes, block).T)

    symbol_at, entry_at = turned(symbols), turned(entries)
    low, width = np.zeros(lanes, np.int64), np.full(lanes, (1 << 62) - 1, np.int64)
    out = np.zeros((block // 4 + 8, lanes), np.int64)  # digits of 32 bits, with carries above
    size = np.zeros(lanes, np.int64)
    model = _Model(lanes, t)

    def move(n: int) -> None:
        nonlocal out
        at = np.flatnonzero(width[:n] < _LOW)
        if len(at):
            value, where = low.take(at), size.take(at)
            if where.max() >= len(out):
                out = np.r_[out, np.zeros((block // 8 + 8, lanes), np.int64)]
            out[where, at] = value >> 30
            size[at] = where + 1
            low[at] = (value & (_LOW - 1)) << _SHIFT
            width[at] <<= _SHIFT

    for k in range(block):
        n = lanes if k < last else lanes - 1
        if not n:
            break
        symbol, entry = symbol_at[k, :n], entry_at[k, :n].astype(np.int64)
        model.guess(n)
        guessed = model.guessed
        hit = entry == guessed
        part = width[:n] >> 16
        part *= model.p
        less = t.count.take(guessed)
        rest = t.total.take(model.row[:n])
        rest -= less
        step = ((width[:n] - part).view(np.uint64) // rest.view(np.uint64)).view(np.int64)
        less *= entry > guessed
        start = t.within.take(entry)
        start -= less
        start *= step
        start += part
        start *= ~hit
        low[:n] += start
        step *= t.count.take(entry)
        width[:n] = np.where(hit, part, step)
        move(n)
        escaped = np.flatnonzero(t.escape.take(entry))
        if len(escaped):
            plain = symbol.take(escaped)
            step = width.take(escaped) // t.total[0]
            low[escaped] += step * t.first.take(plain)
            width[escaped] = step * t.count.take(plain)
            move(n)
        model.learn(n, hit, entry, symbol, k % 2 == 0)
    at = np.arange(lanes)
    if size.max() + 2 > len(out):
        out = np.r_[out, np.zeros((2, lanes), np.int64)]
    out[size, at], out[size + 1, at] = low >> 30, (low & (_LOW - 1)) << 2
    size += 2
    carry = np.zeros(lanes, np.int64)
    for k in range(int(size.max()) - 1, -1, -1):
        out[k] += carry
        carry = out[k] >> 32
    words = out[: int(size.max())].astype("<u4")  # without the carries
    return [words[: size[i], i].tobytes() for i in range(lanes)]


def decode(payload: bytes, only: Sequence[int] | None = None) -> np.ndarray:
    """The ids of a container, or of some of its blocks (`only`: their numbers, in this order).

    ValueError if the head or a block that is read does not match its checksum."""
    magic, blocks, total, block, held, check = _HEAD.unpack_from(payload.ljust(_HEAD.size, b"\0"))
    begin = _HEAD.size + 4
    at = begin + held + 8 * blocks
    if magic != _MAGIC or len(payload) < at or zlib.crc32(payload[: _HEAD.size]) != struct.unpack_from("<I", payload, _HEAD.size)[0] or zlib.crc32(payload[begin:at]) != check:
        raise ValueError("damaged head of a token container")
    tables = Frequencies.from_bytes(payload[begin : begin + held])
    table = np.frombuffer(payload, "<u4", 2 * blocks, begin + held).reshape(-1, 2).astype(np.int64)
    ends = at + np.cumsum(table[:, 0])
    out = []
    wanted = list(range(blocks) if only is None else only)
    for lo in range(0, len(wanted), LANES):
        numbers = sorted(wanted[lo : lo + LANES])  # the shorter last block comes last
        parts = []
        for k in numbers:
            body = payload[ends[k] - table[k, 0] : ends[k]]
            if zlib.crc32(body) != table[k, 1]:
                raise ValueError("damaged block of a token container")
            parts.append(body)
        size = [block] * len(numbers)
        if numbers[-1] == blocks - 1:
            size[-1] = total - (blocks - 1) * block
        found = _decode_lanes(tables, parts, sum(size), block)
        own = dict(zip(numbers, np.split(found, np.cumsum(size)[:-1])))
        out += [found] if only is None else [own[k] for k in wanted[lo : lo + LANES]]
    return tables.ids[np.concatenate(out)] if out else np.zeros(0, np.int64)


def _decode_lanes(t: Frequencies, parts: list[bytes], total: int, block: int) -> np.ndarray:
    lanes = len(parts)
    words = np.zeros((max(map(len, parts)) // 4 + 4, lanes), np.int64)
    for i, p in enumerate(parts):
        words[: len(p) // 4, i] = np.frombuffer(p, "<u4")
    # digits are of 62 bits at first, then of 32: two bits to the left of the words
    ahead = ((words[1:-1] << 30) | (words[2:] >> 2)) & ((1 << 32) - 1)
    off, width = (words[0] << 30) | (words[1] >> 2), np.full(lanes, (1 << 62) - 1, np.int64)
    size = np.zeros(lanes, np.int64)
    last = total - (lanes - 1) * block
    grid = np.zeros((block, lanes), np.int32)
    model = _Model(lanes, t)

    def move(n: int) -> None:
        at = np.flatnonzero(width[:n] < _LOW)
        if len(at):
            where = size.take(at)
            off[at] = (off.take(at) << _SHIFT) | ahead[where, at]
            size[at] = where + 1
            width[at] <<= _SHIFT

    for k in range(block):
        n = lanes if k < last else lanes - 1
        if not n:
            break
        model.guess(n)
        row, guessed = model.row[:n], model.guessed
        own = off[:n]
        part = width[:n] >> 16
        part *= model.p
        hit = own < part
        less, base = t.count.take(guessed), t.base.take(row)
        rest = t.total.take(row)
        rest -= less
        step = ((width[:n] - part).view(np.uint64) // rest.view(np.uint64)).view(np.int64)
        behind = own - part
        behind *= ~hit
        value = (behind.view(np.uint64) // step.view(np.uint64)).view(np.int64)
        rest -= 1
        np.minimum(value, rest, out=value)
        value += base
        value += (value >= t.first.take(guessed)) * less
        entry = np.where(hit, guessed, t.entry_at.take(value))
        less *= entry > guessed
        start = t.within.take(entry)
        start -= less
        start *= step
        start += part
        start *= ~hit
        own -= start
        step *= t.count.take(entry)
        width[:n] = np.where(hit, part, step)
        move(n)
        symbol = t.symbol.take(entry)
        escaped = np.flatnonzero(t.escape.take(entry))
        if len(escaped):
            step = width.take(escaped) // t.total[0]
            plain = t.entry_at.take(np.minimum(off.take(escaped) // step, t.total[0] - 2))
            off[escaped] -= step * t.first.take(plain)
            width[escaped] = step * t.count.take(plain)
            symbol[escaped] = plain
            move(n)
        model.learn(n, hit, entry, symbol, k % 2 == 0)
        grid[k, :n] = symbol
    return grid.T.ravel()[:total] if last == block else np.r_[grid[:, :-1].T.ravel(), grid[:last, -1]]
