"""Token ids in files: adaptive context-mixing range coder in independently reset, checksummed blocks.

Segment (one file unit, little endian)
--------------------------------------
    "LSID" u8 version | u32 n_docs | u64 n_ids | u32 block size | u32 n_blocks | u32 vocabulary size | u32 CRC of the tables
    tables: ids of the documents: u8 per document (0: null), i64 each | u32 ids of each document
            order-0 weights: u32 count, then (u32 id, u16 weight) each
            per block: u32 payload bytes, u32 CRC of payload, u32 CRC of its ids
    payloads (32-bit digits)

Model, reset at each block: an id's chance is a mixture,

    P(x) = w2 [x = g2] + w1 [x = g1] + (1 - w2 - w1) P0(x).

g2 and g1 are the ids last seen after the same two ids and after the same id, with a confidence each. The weights w2 and w1
are adaptive; which pair of weights applies is selected by both confidences and by whether the guesses agree. P0 is the
segment's order-0 distribution times class weights that follow the block. A 64-bit range coder with carries turns the
chances into digits.

All blocks of a run are coded side by side, one id of each per step, in integer arithmetic; any block can be decoded
alone, and a damaged one is found by its checksum without harm to the others.
"""

from __future__ import annotations

import struct
import zlib
from typing import NamedTuple

import numpy as np

BLOCK = 2048
LANES = 4096
SLOTS = 512
CLASSES = 16
REFRESH = 16
_U = np.uint64
#: Shift that leaves a slot's number of a 32-bit hash.
_TOP = np.uint32(33 - SLOTS.bit_length())
_MAGIC = b"LSID\x02"
_HEAD = "<IQIIII"
_LEAST = _U(1 << 32)
_S12, _S16, _S32 = _U(12), _U(16), _U(32)
_LOW32 = _U((1 << 32) - 1)
_ONE, _TWO, _THREE = np.uint32(1), np.uint32(2), np.uint32(3)
#: Weights move by 1/16 of the way to 65,024 (the guess was right) or 0; so both together stay below 2^16, and no weight reaches 0.
_RATE, _GAIN1, _GAIN2, _FIELDS = _U(4), _U(4064), _U(4064 << 32), _U(0xFFF << 32 | 0xFFF)
#: Least weight of a class, of 4,096.
_LEAST_CLASS = 32
#: Odd multipliers of the context hashes.
_H1, _H2, _H3 = np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)


class CorruptBlock(ValueError):
    """A block's or table's checksum doesn't fit."""


class Order0:
    """Static id weights in CLASSES classes of about equal weight; in each class the weights sum to 2^16."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, size: int):
        order = np.lexsort((ids, -weights.astype(np.int64)))
        ids, weights = ids[order], weights[order].astype(np.float64)
        total = max(weights.sum(), 1.0)
        cls = np.minimum((np.cumsum(weights) - weights) / total * CLASSES, CLASSES - 1).astype(np.int64)
        self.cls = np.zeros(size, np.int8)
        self.span = np.zeros(size, _U)  # cumulative weight << 32 | weight
        self.lookup = np.zeros((CLASSES, 1 << 16), np.int32)
        for c in range(CLASSES):
            here = np.flatnonzero(cls == c)
            if len(here):
                w = weights[here] / weights[here].sum()
                f = 1 + np.floor(w * ((1 << 16) - len(here))).astype(np.int64)
                f[0] += (1 << 16) - f.sum()
                x = ids[here]
                self.cls[x] = c
                self.span[x] = ((np.cumsum(f) - f) << 32 | f).astype(_U)
                self.lookup[c] = np.repeat(x, f)
        self.lookup = self.lookup.reshape(-1)


class _Model:
    """State of n lanes: what orders 2 and 1 predict for the next id of each, the weights of both, and the class weights.

    An entry of a table is id << 2 | confidence: 0 (nothing seen), 1 or 3. A right guess is at 3 from then on; a wrong one falls from
    3 to 1, and from 1 it makes way for the id that came.
    """

    def __init__(self, n: int):
        self.n = n
        self.at = np.arange(n, dtype=np.int64) * SLOTS
        self.h1, self.h2 = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        self.tables = [np.zeros(n * SLOTS, np.uint32) for _ in range(2)]
        # by confidence of order 2 (4), of order 1 (4), agreement (2): w2 << 32 | w1
        start = [(4000 * (c2 + c1), 16) if same else (4000 * c2, 3000 * c1 // (1 + c2)) for c2 in range(4) for c1 in range(4) for same in (0, 1)]
        self.weights = np.tile(np.array([max(a, 16) << 32 | max(b, 16) for a, b in start], _U), n)
        self.weights_at = np.arange(n, dtype=np.int64) * 32
        self.classes = np.full((n, CLASSES), (1 << 12) // CLASSES, np.int64)
        self.seen = np.full((REFRESH, n), CLASSES, np.int8)
        self.seen_at = np.arange(n, dtype=np.int64) * (CLASSES + 1)
        self.class_at = np.arange(n, dtype=np.int64) * CLASSES
        self._classes_changed()

    def _classes_changed(self) -> None:
        c = self.classes
        cum = np.cumsum(c, axis=1) - c
        self.class_span = (cum << 32 | c).astype(_U).reshape(-1)
        self.class_rows = np.ascontiguousarray(cum.T[1:].astype(np.int16))

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Guesses of order 2 and 1 (as id << 2 | 3) and their weights, of 2^16, for the first n lanes."""
        h1, at = self.h1[:n], self.at[:n]
        two = h1 * _H2
        two += self.h2[:n]
        two *= _H3
        two >>= _TOP
        self.slot2, self.slot1 = at + two, at + (h1 >> _TOP)
        e2, e1 = self.tables[1].take(self.slot2), self.tables[0].take(self.slot1)
        self.g2, self.g1 = e2 | _THREE, e1 | _THREE
        self.sure2, self.sure1 = (e2 & _TWO).astype(bool), (e1 & _TWO).astype(bool)
        e2 &= _THREE
        e1 &= _THREE
        e2 <<= _TWO
        e2 |= e1
        e2 <<= _ONE
        e2 |= self.g2 == self.g1
        self.context = self.weights_at[:n] + e2
        self.w = self.weights.take(self.context)
        return self.g2, self.g1, self.w >> _S32, self.w & _LOW32

    def learn(self, n: int, x: np.ndarray, is2: np.ndarray, hit1: np.ndarray, is1: np.ndarray, cls: np.ndarray, step: int) -> None:
        """x: the ids << 2 | 3; is2, hit1: whose guess was right; is1: order 1's alone; cls: class, CLASSES where a guess was right."""
        w = self.w
        w -= (w >> _RATE) & _FIELDS
        w += is2 * _GAIN2
        w += is1 * _GAIN1
        self.weights.put(self.context, w)
        fresh = x - _TWO
        self.tables[1].put(self.slot2, np.where(is2, x, np.where(self.sure2, self.g2 - _TWO, fresh)))
        self.tables[0].put(self.slot1, np.where(hit1, x, np.where(self.sure1, self.g1 - _TWO, fresh)))
        self.h2[:n] = self.h1[:n]
        np.multiply(x, _H1, out=self.h1[:n])
        self.seen[step % REFRESH, :n] = cls
        if step % REFRESH == REFRESH - 1:
            # move towards the classes of the last ids that no guess met
            fresh = np.bincount((self.seen_at + self.seen).ravel(), minlength=self.n * (CLASSES + 1)).reshape(self.n, CLASSES + 1)[:, :CLASSES]
            c = self.classes
            c += (fresh * ((1 << 12) // REFRESH) - c * fresh.sum(axis=1, keepdims=True) // REFRESH) >> 2
            np.maximum(c, _LEAST_CLASS, out=c)
            c[:, 0] += (1 << 12) - c.sum(axis=1)
            short = c[:, 0] < _LEAST_CLASS
            if short.any():
                c[short] = (1 << 12) // CLASSES
            self._classes_changed()


def _carry(flat: np.ndarray, at: np.ndarray) -> None:
    """Add one to the digits at these places, and on to the digits before those that overflow."""
    while len(at):
        flat[at] += np.uint32(1)
        at = at[flat[at] == 0] - 1


def _encode_run(lengths: np.ndarray, order0: Order0, ids: np.ndarray) -> list[bytes]:
    """Digits of lanes of falling length; ids [step, lane]."""
    n, steps = len(lengths), int(lengths[0])
    model = _Model(n)
    low, span = np.zeros(n, _U), np.full(n, (1 << 64) - 1, _U)
    out = np.zeros((n, steps + 2), "<u4")
    flat, row, place = out.reshape(-1), np.arange(n) * out.shape[1], np.zeros(n, np.int64)
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    for t in range(steps):
        k = int(active[t])
        lo, sp = low[:k], span[:k]
        g2, g1, w2, w1 = model.predict(k)
        own = ids[t, :k].astype(np.int64)
        cls, own, x = order0.cls.take(own), order0.span.take(own), own.astype(np.uint32)
        x <<= _TWO
        x |= _THREE
        is2, hit1 = x == g2, x == g1
        is1 = hit1 & ~is2
        other = ~(is2 | hit1)
        r = sp >> _S16
        w2 *= r
        w1 *= r
        edge = w2 + w1
        # order 0: the class, then the id in its class
        r = (sp - edge) >> _S12
        of_class = model.class_span.take(model.class_at[:k] + cls)
        add = r * (of_class >> _S32)
        add += edge
        r *= of_class & _LOW32
        r >>= _S16
        add += r * (own >> _S32)
        size = r * (own & _LOW32)
        add = np.where(other, add, w2 * is1)
        size = np.where(other, size, np.where(is2, w2, w1))
        lo += add
        carry = np.flatnonzero(lo < add)
        if len(carry):
            _carry(flat, row[carry] + place[carry] - 1)
        sp[:] = size
        go = np.flatnonzero(size < _LEAST)
        if len(go):
            l = lo.take(go)
            p = place.take(go)
            flat[row.take(go) + p] = l >> _S32
            place[go] = p + 1
            lo[go] = l << _S32
            sp[go] = size.take(go) << _S32
        model.learn(k, x, is2, hit1, is1, np.where(other, cls, np.int8(CLASSES)), t)
    # the least number of low's range whose second digit is zero
    last = low + (_LEAST - _U(1))
    carry = np.flatnonzero(last < low)
    _carry(flat, row[carry] + place[carry] - 1)
    flat[row + place] = last >> _S32
    place += 1
    return [out[i, : place[i]].tobytes() for i in range(n)]


def _decode_run(lengths: np.ndarray, order0: Order0, digits: np.ndarray) -> np.ndarray:
    """ids [step, lane] of lanes of falling length; digits [lane, place] with two zeros behind each lane's last."""
    n, steps = len(lengths), int(lengths[0])
    model = _Model(n)
    span = np.full(n, (1 << 64) - 1, _U)
    flat, place = digits.reshape(-1), np.arange(n) * digits.shape[1] + 2
    # code: the number read so far, less the low end of the range
    code = flat[place - 2].astype(_U) << _S32 | flat[place - 1].astype(_U)
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    out = np.zeros((steps, n), np.uint32)
    most = len(flat) - 1
    for t in range(steps):
        k = int(active[t])
        co, sp = code[:k], span[:k]
        g2, g1, w2, w1 = model.predict(k)
        r = sp >> _S16
        w2 *= r
        w1 *= r
        edge = w2 + w1
        is2 = co < w2
        other = co >= edge
        is1 = ~(is2 | other)
        # order 0: the class, then the id in its class
        r = (sp - edge) >> _S12
        c0 = co - edge
        c0 *= other
        v = np.minimum(c0 // r, _U((1 << 12) - 1)).astype(np.int16)
        cls = (model.class_rows[:, :k] <= v).sum(axis=0, dtype=np.int8)
        of_class = model.class_span.take(model.class_at[:k] + cls)
        c0 -= r * (of_class >> _S32)
        r *= of_class & _LOW32
        r >>= _S16
        v = np.minimum(c0 // r, _U((1 << 16) - 1))
        v += cls.astype(_U) << _S16
        found = order0.lookup.take(v.view(np.int64))
        own = order0.span.take(found)
        c0 -= r * (own >> _S32)
        r *= own & _LOW32
        x = found.astype(np.uint32)
        x <<= _TWO
        x |= _THREE
        x = np.where(other, x, np.where(is2, g2, g1))
        r = np.where(other, r, np.where(is2, w2, w1))
        w2 *= is1
        c0 = np.where(other, c0, co - w2)
        co[:] = c0
        sp[:] = r
        go = np.flatnonzero(r < _LEAST)
        if len(go):
            p = place.take(go)
            co[go] = c0.take(go) << _S32 | flat.take(np.minimum(p, most)).astype(_U)
            sp[go] = r.take(go) << _S32
            place[go] = p + 1
        out[t, :k] = x
        model.learn(k, x, is2, x == g1, is1, np.where(other, cls, np.int8(CLASSES)), t)
    out >>= np.uint32(2)
    return out


def _sizes(n_ids: int, block: int) -> np.ndarray:
    """Ids of each block."""
    n = -(-n_ids // block)
    sizes = np.full(n, block, np.int64)
    if n:
        sizes[-1] = n_ids - block * (n - 1)
    return sizes


def encode(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, vocabulary: int, block: int = BLOCK) -> bytes:
    """A segment of documents: their ids (int or None), how many token ids each has, and all token ids (below 2^30) in order."""
    count = np.bincount(ids, minlength=vocabulary) if len(ids) else np.zeros(vocabulary, np.int64)
    used = np.flatnonzero(count)
    # weights that fit 16 bits; the least is 1
    weights = np.maximum(1, np.minimum(count[used] * 65535 // max(int(count.max()) if len(ids) else 1, 1), 65535)).astype(np.uint16)
    order0 = Order0(used, weights, vocabulary)
    sizes = _sizes(len(ids), block)
    payloads: list[bytes] = []
    for a in range(0, len(sizes), LANES):
        some = sizes[a : a + LANES]
        grid = np.zeros(len(some) * block, np.int32)
        part = ids[a * block : a * block + int(some.sum())]
        grid[: len(part)] = part
        payloads += _encode_run(some, order0, np.ascontiguousarray(grid.reshape(len(some), block).T))
    raw = ids.astype("<u4")
    table = np.zeros(len(used), [("id", "<u4"), ("w", "<u2")])
    table["id"], table["w"] = used, weights
    tables = [bytes(i is not None for i in doc_ids), np.array([i or 0 for i in doc_ids], "<i8").tobytes(), np.asarray(lengths).astype("<u4").tobytes()]
    tables += [struct.pack("<I", len(used)), table.tobytes()]
    tables += [struct.pack("<III", len(p), zlib.crc32(p), zlib.crc32(raw[i * block : (i + 1) * block].tobytes())) for i, p in enumerate(payloads)]
    joined = b"".join(tables)
    head = struct.pack(_HEAD, len(doc_ids), len(ids), block, len(sizes), vocabulary, zlib.crc32(joined))
    return b"".join([_MAGIC, head, joined, *payloads])


class Segment(NamedTuple):
    """The tables of a segment and where its blocks lie."""

    raw: bytes
    doc_ids: list
    lengths: np.ndarray
    order0: Order0
    block: int
    sizes: np.ndarray
    crcs: np.ndarray
    start: np.ndarray


def tables(segment: bytes) -> Segment:
    """All of a segment but its blocks. Raises CorruptBlock where the tables are damaged."""
    head = struct.calcsize(_HEAD)
    if segment[:5] != _MAGIC or len(segment) < 5 + head:
        raise CorruptBlock("not a segment")
    n_docs, n_ids, block, n_blocks, vocabulary, crc = struct.unpack_from(_HEAD, segment, 5)
    begin = at = 5 + head
    weights_at = at + 13 * n_docs
    if len(segment) < weights_at + 4:
        raise CorruptBlock("the tables are cut off")
    (n_used,) = struct.unpack_from("<I", segment, weights_at)
    end = weights_at + 4 + 6 * n_used + 12 * n_blocks
    if len(segment) < end or zlib.crc32(segment[begin:end]) != crc:
        raise CorruptBlock("the tables are damaged")
    there = segment[at : at + n_docs]
    doc_ids = [i if t else None for i, t in zip(np.frombuffer(segment, "<i8", n_docs, at + n_docs).tolist(), there, strict=True)]
    lengths = np.frombuffer(segment, "<u4", n_docs, at + 9 * n_docs).astype(np.int64)
    table = np.frombuffer(segment, [("id", "<u4"), ("w", "<u2")], n_used, weights_at + 4)
    order0 = Order0(table["id"].astype(np.int64), table["w"], vocabulary)
    crcs = np.frombuffer(segment, "<u4", 3 * n_blocks, end - 12 * n_blocks).reshape(n_blocks, 3)
    start = end + np.concatenate([[0], np.cumsum(crcs[:, 0].astype(np.int64))])
    return Segment(segment, doc_ids, lengths, order0, block, _sizes(n_ids, block), crcs, start)


def decode_blocks(s: Segment, first: int, end: int) -> np.ndarray:
    """The ids of blocks [first, end), without a look at any other. Raises CorruptBlock where one of them is damaged."""
    for i in range(first, end):
        if zlib.crc32(s.raw[s.start[i] : s.start[i + 1]]) != s.crcs[i, 1]:
            raise CorruptBlock(f"block {i} is damaged")
    sizes = s.sizes[first:end]
    out = np.empty(int(sizes.sum()), np.uint32)
    for a in range(0, len(sizes), LANES):
        some = sizes[a : a + LANES]
        digits = np.zeros((len(some), int(s.crcs[first + a : first + a + len(some), 0].max()) // 4 + 3), np.uint32)
        for i in range(len(some)):
            d = np.frombuffer(s.raw, "<u4", int(s.crcs[first + a + i, 0]) // 4, int(s.start[first + a + i]))
            digits[i, : len(d)] = d
        grid = _decode_run(some, s.order0, digits)
        out[a * s.block : a * s.block + int(some.sum())] = np.ascontiguousarray(grid.T).reshape(-1)[: int(some.sum())]
    raw = out.astype("<u4")
    for i in range(first, end):
        a = (i - first) * s.block
        if zlib.crc32(raw[a : a + int(s.sizes[i])].tobytes()) != s.crcs[i, 2]:
            raise CorruptBlock(f"block {i} decodes to other ids")
    return out


def decode(segment: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """The arguments of encode(): document ids, lengths, token ids. Raises CorruptBlock on damage."""
    s = tables(segment)
    return s.doc_ids, s.lengths, decode_blocks(s, 0, len(s.sizes))
