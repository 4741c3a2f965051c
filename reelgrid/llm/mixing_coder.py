"""An adaptive context-mixing range coder for token ids.

Ids (0 to LARGEST) are cut into blocks of BLOCK. Each block has a model and a coder of its own, begun anew, so a block
is decoded without any other; many blocks are coded side by side, one step of all of them at a time, as array operations.

The model mixes three predictions of the next id into one distribution. Order 2 and order 1 predict the id that last
followed the same two ids or one id; order 0 is a product of shares of the id's high and low byte, taken anew from the
block's counts so far at the steps RENEWED. The weights of the orders follow each one's recent success in the block.
The distribution is laid out as order 2's id, order 1's id, then all ids by order 0; an id takes the first of its
intervals. A range coder with 56 bits of state narrows to that interval and gives out 16-bit words; carries are added
to the words before at the end.

A coded block: magic, number of ids, crc32 of the ids as little-endian unsigned 32-bit integers, then the words. Ids
outside the range are refused by an OutOfRange error, damaged blocks by a Damaged error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

BLOCK = 2048
#: Blocks coded side by side.
LANES = 2048
MAGIC = b"TKB2"
HEAD = struct.Struct("<4sII")
_NONE = 0xFFFF
LARGEST = _NONE - 1
#: Steps before which the shares of order 0 are taken anew.
RENEWED = frozenset({16, 64, 192, 512, 1024})
#: Steps that the encoder looks ahead.
AHEAD = 16
_PARTS, _BITS = 64, 11  # the orders' weights add up to the one, a byte's shares to two to the power of the other
_TOTAL_BITS = 2 * _BITS + 6
_U = np.uint64
_FULL, _LOW, _LOWER, _DOWN, _WORD = _U(1 << 56), _U(1 << 40), _U(1 << 24), _U(40), _U(16)
_REST = _LOW - _U(1)
_SLOTS1, _SLOTS2 = 9, 10  # bits of a block's tables of what followed one id, and two


class OutOfRange(ValueError):
    """An id that the format can't hold."""


class Damaged(ValueError):
    """A block that isn't what was written."""


#: Blocks whose shares are taken, or whose ids are turned from blocks by steps to steps by blocks, at a time.
_SOME = 128


def _turned(a: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Rows as columns, some at a time."""
    for i in range(0, a.shape[0], _SOME):
        for j in range(0, a.shape[1], _SOME):
            out[j : j + _SOME, i : i + _SOME] = a[i : i + _SOME, j : j + _SOME].T
    return out


class _Bytes:
    """Shares of one byte of the ids, for n blocks: begin << 16 | width of every byte, and the byte of every slot."""

    def __init__(self, n: int, inverse: bool, table: np.ndarray):
        self.n, self.inverse, self.table = n, inverse, table
        self.counts = np.zeros((n, 256), np.float32)  # whole numbers up to BLOCK
        self.rows, self.slots = np.arange(n) << 8, np.arange(n) << _BITS
        self.byte_of = np.empty(n << _BITS if inverse else 0, np.uint8)
        self._shared()

    def count(self, some: np.ndarray) -> None:
        """Adds the bytes of some steps (blocks by steps), and takes the shares anew."""
        for i in range(0, self.n, _SOME):
            own = some[i : i + _SOME]
            self.counts[i : i + _SOME] += np.bincount((own + self.rows[: len(own), None]).ravel(), minlength=len(own) << 8).reshape(-1, 256)
        self._shared()

    def _shared(self) -> None:
        """Quotients of whole numbers below 2 ** 21 by ones up to BLOCK have the right whole part in 32 bits of floating point."""
        every = np.arange(256, dtype=np.uint8)
        for i in range(0, self.n, _SOME):
            c = self.counts[i : i + _SOME]
            width = (c * np.float32((1 << _BITS) - 256) / np.maximum(c.sum(1, keepdims=True), np.float32(1))).astype(np.int32)
            width += 1
            left = (1 << _BITS) - width.sum(1, dtype=np.int32)
            width += (left >> 8)[:, None]  # all of it before any byte was seen
            width[:, 0] += left & 255
            begin = np.cumsum(width, 1, dtype=np.int32)
            begin -= width
            begin <<= 16
            np.bitwise_or(begin, width, out=self.table[i : i + _SOME])
            if self.inverse:
                self.byte_of[i << _BITS : (i + len(c)) << _BITS] = np.repeat(np.tile(every, len(c)), width.ravel())


def _places(last: np.ndarray, before: np.ndarray, bases: np.ndarray) -> np.ndarray:
    """Where the tables hold what followed one id (first row) and two."""
    at = np.empty((2, *last.shape), np.int64)
    np.multiply(last, 40503, out=at[0])
    np.multiply(before, 30011, out=at[1])
    at[1] += at[0]
    at[0] >>= 7
    at[0] &= (1 << _SLOTS1) - 1
    at[1] >>= 6
    at[1] &= (1 << _SLOTS2) - 1
    at[0] += bases[0]
    at[1] += bases[1]
    return at


class _Model:
    """The models of n blocks. Arrays hold one entry for each; those of two rows have order 1 first, then order 2.

    All blocks are computed alike and the fitting results kept by masks, which costs less than picking blocks out.
    """

    def __init__(self, n: int, inverse: bool):
        self.high, self.low = (_Bytes(n, inverse, table) for table in np.empty((2, n, 256), np.int32))
        self.bases = np.stack([np.arange(n) << _SLOTS1, (n << _SLOTS1) + (np.arange(n) << _SLOTS2)])
        self.after = np.full((n << _SLOTS1) + (n << _SLOTS2), _NONE, np.uint16)
        self.trust = np.repeat(np.array([[16 << 4], [32 << 4]], np.int32), n, axis=1)
        self.most = np.array([[39 << 4], [55 << 4]], np.int32)

    def predict(self, at: np.ndarray) -> None:
        """The predicted ids for places in the tables, and where the orders' intervals end."""
        n = at.shape[1]
        self.at = at
        self.p = self.after.take(at)
        self.seen = (self.p != _NONE).astype(np.int32)
        w = self.trust[:, :n] >> 4
        w *= self.seen
        w1, w2 = w
        w1 *= _PARTS - w2
        w1 >>= 6
        w1 += w2
        self.w0 = _PARTS - w1
        w <<= 2 * _BITS
        self.end1, self.end2 = w

    def plain(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and width of ids (steps by blocks) by order 0 alone."""
        n = ids.shape[1]
        h, l = self.high.table.ravel().take(self.high.rows[:n] + (ids >> 8)), self.low.table.ravel().take(self.low.rows[:n] + (ids & 255))
        f = h & 0xFFFF
        return (h >> 16 << _BITS) + f * (l >> 16), f * (l & 0xFFFF)

    def interval(self, x: np.ndarray, begin: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and width of the ids' intervals, out of 2 to the power of _TOTAL_BITS, given those by order 0."""
        self.hit = x == self.p
        one, two = self.hit
        first = self.end1 - self.end2
        two = -two.astype(np.int32)
        one = -(one & (first > 0)).astype(np.int32) & ~two
        other = ~(one | two)
        begin = self.w0 * begin
        begin += self.end1
        begin &= other
        begin |= self.end2 & one
        width = self.w0 * width
        width &= other
        width |= first & one
        width |= self.end2 & two
        return begin, width

    def find(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids whose intervals hold v, and those intervals' begins and widths."""
        n = len(v)
        one, two = -(v < self.end1).astype(np.int32), -(v < self.end2).astype(np.int32)
        other = ~one
        one ^= two
        r = v - self.end1
        np.maximum(r, 0, out=r)
        r = (r / self.w0).astype(np.int32)
        high = self.high.byte_of.take(self.high.slots[:n] + (r >> _BITS))
        h = self.high.table.ravel().take(self.high.rows[:n] + high)
        c, f = h >> 16 << _BITS, h & 0xFFFF
        low = self.low.byte_of.take(self.low.slots[:n] + ((r - c) / f).astype(np.int32))
        l = self.low.table.ravel().take(self.low.rows[:n] + low)
        begin, width = l >> 16, l & 0xFFFF
        begin *= f
        begin += c
        begin *= self.w0
        begin += self.end1
        width *= f
        width *= self.w0
        x = high.astype(np.int32)
        x <<= 8
        x |= low
        begin &= other
        begin |= self.end2 & one
        width &= other
        width |= (self.end1 - self.end2) & one
        width |= self.end2 & two
        x &= other
        x |= self.p[0] & one
        x |= self.p[1] & two
        self.hit = x == self.p
        return x, begin, width

    def learn(self, x: np.ndarray) -> None:
        own = self.trust[:, : len(x)]
        more = self.hit * self.most
        more += 16
        more -= own
        more *= self.seen
        more >>= 4
        own += more
        x = x.astype(np.uint16)
        self.after[self.at[0]] = x
        self.after[self.at[1]] = x


def _cut(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Blocks by steps; steps by blocks after two rows of _NONE; and how many blocks have a step. Only the last block is shorter."""
    n = -(-len(ids) // block)
    padded = np.zeros(n * block, np.int32)
    padded[: len(ids)] = ids
    padded = padded.reshape(n, block)
    steps = np.full((block + 2, n), _NONE, np.int32)
    _turned(padded, steps[2:])
    tail = len(ids) - (n - 1) * block
    return padded, steps, [n if t < tail else n - 1 for t in range(block)]


def encode(ids: np.ndarray, block: int = BLOCK, lanes: int = LANES) -> Iterator[bytes]:
    """The coded blocks of ids."""
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) <= LARGEST:
        raise OutOfRange(f"ids from {int(ids.min())} to {int(ids.max())}; the format holds 0 to {LARGEST}")
    for i in range(0, len(ids), block * lanes):
        yield from _encode(ids[i : i + block * lanes], block)


def _encode(ids: np.ndarray, block: int) -> Iterator[bytes]:
    blocks, steps, live = _cut(ids, block)
    n = steps.shape[1]
    model, renewed, known = _Model(n, False), 0, 0
    low, width = np.zeros(n, np.uint64), np.full(n, _FULL)
    out, size = np.zeros((2 * block + 8) * n, np.uint32), np.arange(n)  # words by blocks, which advance alike
    for t in range(block):
        if not (m := live[t]):
            break
        if t in RENEWED:
            some = blocks[:, renewed:t]
            model.high.count(some >> 8)
            model.low.count(some & 255)
            renewed = t
        if t == renewed or t == known:  # what doesn't depend on the weights, for some steps at once
            since, known = t, min([t + AHEAD, block, *(r for r in RENEWED if r > t)])
            before, last, own = (steps[t + i : known + i] for i in range(3))
            places = _places(last, before, model.bases)
            begins, widths = model.plain(own)
        x, lo, wi, at, row = own[t - since, :m], low[:m], width[:m], size[:m], t - since
        model.predict(places[:, row, :m])
        begin, share = model.interval(x, begins[row, :m], widths[row, :m])
        wi >>= _U(_TOTAL_BITS)
        lo += begin.astype(np.uint64) * wi
        wi *= share.astype(np.uint64)
        need = wi < _LOW
        out[at] = lo >> _DOWN  # written again where nothing settled
        at += need * n
        settled = need.astype(np.uint64)
        lo &= (settled - _U(1)) | _REST
        settled <<= _U(4)
        lo <<= settled
        wi <<= settled
        while len(more := np.flatnonzero(wi < _LOW)):
            out[at[more]] = lo[more] >> _DOWN
            at[more] += n
            lo[more] = (lo[more] & _REST) << _WORD
            wi[more] <<= _WORD
        model.learn(x)
    out[size] = low >> _DOWN
    out[size + n] = low >> _U(24) & _U(0xFFFF)
    out[size + 2 * n] = low >> _U(8) & _U(0xFFFF)
    out[size + 3 * n] = (low & _U(0xFF)) << _U(8)
    size //= n
    words = out.reshape(-1, n)[: int(size.max()) + 4]
    for k in range(len(words) - 1, 0, -1):
        words[k - 1] += words[k] >> 16
    words = _turned(words, np.empty(words.shape[::-1], "<u2"))
    raw, ends = ids.astype("<u4"), size + 4
    for i in range(n):
        own = raw[i * block : (i + 1) * block]
        yield HEAD.pack(MAGIC, len(own), zlib.crc32(own)) + words[i, : ends[i]].tobytes()


def decode(blocks: list[bytes], lanes: int = LANES) -> np.ndarray:
    """The ids of coded blocks, each checked against its checksum."""
    return np.concatenate([np.zeros(0, "<u4"), *(_decode(blocks[i : i + lanes]) for i in range(0, len(blocks), lanes))])


def _decode(blocks: list[bytes]) -> np.ndarray:
    if any(len(b) < HEAD.size + 8 or len(b) % 2 for b in blocks):
        raise Damaged("a block is cut off")
    heads = [HEAD.unpack_from(b) for b in blocks]
    if any(h[0] != MAGIC for h in heads):
        raise Damaged("not a block of token ids")
    lengths = np.array([h[1] for h in heads])
    order = np.argsort(-lengths, kind="stable")
    n, most = len(blocks), int(lengths.max(initial=0))
    words = [np.frombuffer(blocks[i], "<u2", offset=HEAD.size) for i in order]
    flat = np.concatenate([*words, np.zeros(8, np.uint16)])
    at = np.cumsum([0, *map(len, words)])[:-1]
    code = np.zeros(n, np.uint64)
    for _ in range(3):
        code = code << _WORD | flat[at].astype(np.uint64)
        at += 1
    code = code << _U(8) | (flat[at] >> 8).astype(np.uint64)  # 56 bits; the word's low half comes next
    flat[:-1] = flat[:-1] << 8 | flat[1:] >> 8  # from here on, words of a low half and the next one's high half
    flat[-1] = 0
    flat = flat.astype(np.uint32) << 16 | np.append(flat[1:], np.uint16(0))  # two words at each place
    model, renewed = _Model(n, True), 0
    width = np.full(n, _FULL)
    out = np.full((most + 2, n), _NONE, np.int32)
    ends = np.searchsorted(-lengths[order], -np.arange(1, most + 1), side="right")
    for t in range(most):
        m = int(ends[t])
        if t in RENEWED:
            some = _turned(out[renewed + 2 : t + 2], np.empty((n, t - renewed), np.int32))
            model.high.count(some >> 8)
            model.low.count(some & 255)
            renewed = t
        model.predict(_places(out[t + 1, :m], out[t, :m], model.bases[:, :m]))
        co, wi, where = code[:m], width[:m], at[:m]
        wi >>= _U(_TOTAL_BITS)
        v = np.minimum(co // wi, _U((1 << _TOTAL_BITS) - 1)).astype(np.int32)
        x, begin, share = model.find(v)
        co -= begin.astype(np.uint64) * wi
        wi *= share.astype(np.uint64)
        need = (wi < _LOW).astype(np.uint64)
        need += wi < _LOWER  # at most two words, as the width has been 40 bits
        new = flat.take(where, mode="clip")
        where += need.view(np.int64)
        need <<= _U(4)
        co <<= need
        wi <<= need
        co |= new >> (_U(32) - need)
        model.learn(x)
        out[t + 2, :m] = x
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    by_block = _turned(out[2:], np.empty((n, most), "<u4"))
    found = [by_block[back[i], : lengths[i]] for i in range(n)]
    for ids, h in zip(found, heads, strict=True):
        if zlib.crc32(ids) != h[2]:
            raise Damaged("a block's checksum differs")
    return np.concatenate(found) if lengths.min() < most else by_block.ravel()
