"""Elias-Fano sequences and a two-level n-gram trie on them, in memory-mapped files.

A monotone sequence is kept as the low bits of each value, packed, and the high bits in unary with a small rank directory.
Successor search picks the run of values with the wanted high bits by two selects and finishes by binary search on low bits.
"""

from __future__ import annotations

import json
import os
import tempfile

import numpy as np

_U = np.uint64


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value, one after another, as 64-bit words (and one spare word)."""
    out = []
    step = 1 << 16  # a multiple of 64, so every part fills whole words
    for a in range(0, len(values), step):
        part = np.ascontiguousarray(values[a : a + step].astype("<u8")).view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(part, axis=1, bitorder="little", count=width) if width else np.empty((len(part), 0), np.uint8)
        out.append(np.packbits(bits.reshape(-1), bitorder="little"))
    raw = np.concatenate(out) if out else np.empty(0, np.uint8)
    return np.concatenate([raw, np.zeros(-len(raw) % 8 + 8, np.uint8)]).view("<u8")


def _select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the rank-th (from 0) one bit of each word."""
    word, rank, at = word.copy(), rank.astype(np.int64), np.zeros(len(word), dtype=np.int64)
    for s in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(word & _U((1 << s) - 1)).astype(np.int64)
        up = rank >= low
        rank -= np.where(up, low, 0)
        at += np.where(up, s, 0)
        word = np.where(up, word >> _U(s), word)
    return at


class EliasFano:
    """arrays: low, high, before (ones before each word of high). n values below 2^64, ascending (equal ones allowed)."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.n, self.width, self.low, self.high, self.before = n, width, low, high, before

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = values.astype(_U)
        n = len(values)
        width = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        tops = (values >> _U(width)).astype(np.int64) if width < 64 else np.zeros(n, np.int64)
        bits = np.zeros(((n + (int(tops[-1]) if n else 0) + 2) + 63) // 64 * 64, np.uint8)
        bits[tops + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.bitwise_count(high).astype(np.int64)
        return cls(n, width, _pack_bits(values, width), high, (np.cumsum(ones) - ones).astype("<u4" if n < 1 << 32 else "<u8"))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), _U)
        bit = i.astype(np.int64) * self.width
        word, off = bit >> 6, (bit & 63).astype(_U)
        value = self.low[word] >> off
        value |= np.where(off > 0, self.low[word + 1] << ((_U(64) - off) & _U(63)), _U(0))
        return value & _U((1 << self.width) - 1)

    def _select(self, rank: np.ndarray, zeros: bool) -> np.ndarray:
        before = self.before.astype(np.int64)
        if zeros:
            before = 64 * np.arange(len(before)) - before
        word = np.searchsorted(before, rank, side="right") - 1
        bits = self.high[word]
        return 64 * word + _select_in_word(~bits if zeros else bits, rank - before[word])

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, dtype=np.int64)
        return ((self._select(i, False) - i).astype(_U) << _U(self.width)) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value >= x; n where there is none."""
        x = np.asarray(x, dtype=_U)
        if not self.n or not len(x):
            return np.zeros(len(x), np.int64)
        top = x >> _U(self.width)
        zeros = len(self.high) * 64 - self.n
        over = top >= _U(zeros)
        h = np.where(over, _U(0), top).astype(np.int64)
        # ones before the h-th zero have high bits below h; the h-th run ends at the next zero
        a = np.where(h > 0, self._select(np.maximum(h - 1, 0), True) - (h - 1), 0)
        b = self._select(np.minimum(h, zeros - 1), True) - h
        low = x & _U((1 << self.width) - 1)
        a, b = np.minimum(a, self.n), np.minimum(b, self.n)
        open_ = np.flatnonzero(a < b)
        while len(open_):
            mid = (a[open_] + b[open_]) >> 1
            less = self._low(mid) < low[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
            open_ = open_[a[open_] < b[open_]]
        return np.where(over, self.n, a)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each value; -1 where it isn't there."""
        i = self.successor(x)
        out = np.full(len(i), -1, dtype=np.int64)
        inside = np.flatnonzero(i < self.n)
        hit = self.access(i[inside]) == np.asarray(x, dtype=_U)[inside]
        out[inside[hit]] = i[inside[hit]]
        return out


def quantise(values: np.ndarray, bits: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Codes and their means: equal bins between the least and the greatest value."""
    if not len(values):
        return np.empty(0, np.uint8), np.zeros(1)
    lo, hi = float(values.min()), float(values.max())
    bins = (1 << bits) - 1
    codes = np.rint((values - lo) / (hi - lo) * bins).astype(np.uint8 if bits <= 8 else np.uint16) if hi > lo else np.zeros(len(values), np.uint8)
    n = np.bincount(codes, minlength=1)
    return codes, np.bincount(codes, weights=values) / np.maximum(n, 1)


class Trie:
    """Bigrams by predicted word, then context.

    Levels: the words and the contexts (Elias-Fano over fingerprints, index = dense id); pointers from words to their children
    (Elias-Fano); the children's context ids, each raised by its word's number times the number of contexts, which makes
    one monotone sequence (Elias-Fano): a search for (word, context) is one successor search inside the word's range.
    Every word and child carries a quantised value.
    """

    def __init__(self, words: EliasFano, contexts: EliasFano, pointers: EliasFano, children: EliasFano, word_codes, word_table, child_codes, child_table):
        self.words, self.contexts, self.pointers, self.children = words, contexts, pointers, children
        self.word_codes, self.word_table, self.child_codes, self.child_table = word_codes, word_table, child_codes, child_table

    @classmethod
    def build(cls, words: np.ndarray, word_values: np.ndarray, child_word: np.ndarray, child_context: np.ndarray, child_values: np.ndarray) -> Trie:
        """words: ascending; child_word, child_context: fingerprints, ascending by (word, context), words among ``words``."""
        contexts = np.unique(child_context)
        at = np.searchsorted(words, child_word)
        m = max(len(contexts), 1)
        key = at.astype(_U) * _U(m) + np.searchsorted(contexts, child_context).astype(_U)
        starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(words)))])
        return cls(
            EliasFano.of(words, 1 << 64),
            EliasFano.of(contexts, 1 << 64),
            EliasFano.of(starts, len(child_word) + 1),
            EliasFano.of(key, max(len(words), 1) * m),
            *quantise(word_values),
            *quantise(child_values),
        )

    def lookup(self, words: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For (word, context) queries: whether the word is there and its value, whether the pair is there and its value."""
        w, inverse = np.unique(words, return_inverse=True)
        word = self.words.find(w)[inverse]
        c, inverse = np.unique(contexts, return_inverse=True)
        context = self.contexts.find(c)[inverse]
        known = word >= 0
        word_value = np.where(known, self.word_table[self.word_codes[np.maximum(word, 0)]] if len(self.word_codes) else 0.0, 0.0)
        pair, value = np.zeros(len(words), bool), np.zeros(len(words))
        ask = np.flatnonzero(known & (context >= 0))
        if len(ask) and self.children.n:
            # the range of each word's children, then the successor of its context in it
            some, inverse = np.unique(word[ask], return_inverse=True)
            begin, end = self.pointers.access(some)[inverse].astype(np.int64), self.pointers.access(some + 1)[inverse].astype(np.int64)
            target = word[ask].astype(_U) * _U(max(self.contexts.n, 1)) + context[ask].astype(_U)
            i = self.children.successor(target)
            inside = np.flatnonzero((i >= begin) & (i < end))
            hit = inside[self.children.access(i[inside]) == target[inside]]
            pair[ask[hit]] = True
            value[ask[hit]] = self.child_table[self.child_codes[i[hit]]]
        return known, word_value, pair, value

    # files

    def save(self, path: str) -> None:
        """One file: a JSON head with the place of each array, then the arrays, each at a multiple of 8 bytes."""
        head, body, at = {}, [], 0
        parts = {f"{n}.{k}": getattr(getattr(self, n), k) for n in ("words", "contexts", "pointers", "children") for k in ("low", "high", "before")}
        parts |= {k: getattr(self, k) for k in ("word_codes", "word_table", "child_codes", "child_table")}
        for name, a in parts.items():
            raw = np.ascontiguousarray(a).tobytes()
            head[name] = [a.dtype.str, len(a), at]
            body.append(raw + b"\0" * (-len(raw) % 8))
            at += len(body[-1])
        head |= {n: [getattr(self, n).n, getattr(self, n).width] for n in ("words", "contexts", "pointers", "children")}
        text = json.dumps(head).encode()
        text += b" " * (-len(text) % 8)
        with open(path, "wb") as f:
            f.write(len(text).to_bytes(8, "little") + text)
            f.writelines(body)

    @classmethod
    def open(cls, path: str) -> Trie:
        """Arrays are views of the mapped file; pages are read when a search touches them."""
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        n = int.from_bytes(raw[:8].tobytes(), "little")
        head = json.loads(raw[8 : 8 + n].tobytes())

        def part(name: str) -> np.ndarray:
            kind, length, at = head[name]
            return raw[8 + n + at : 8 + n + at + length * np.dtype(kind).itemsize].view(kind)

        sequences = [EliasFano(*head[s], *(part(f"{s}.{k}") for k in ("low", "high", "before"))) for s in ("words", "contexts", "pointers", "children")]
        return cls(*sequences, *(part(k) for k in ("word_codes", "word_table", "child_codes", "child_table")))

    def mapped(self) -> Trie:
        """This trie written to a local file and mapped; the file has no name any more, so nothing is left behind."""
        fd, path = tempfile.mkstemp(suffix=".trie")
        os.close(fd)
        try:
            self.save(path)
            return Trie.open(path)
        finally:
            os.unlink(path)
