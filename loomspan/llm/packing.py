"""Packing by non-negative least squares over length combinations.

A document's tokens are cut into full windows and one shorter rest. The rests' lengths form a histogram of at
most window - 1 bins. All combinations of two or three lengths that fill a window exactly are enumerated; their repeat
counts are the non-negative least-squares fit to the histogram, rounded by error diffusion and held to what is there;
what is left is packed best-fit decreasing on the histogram. Rests of windows that this leaves with over 1/64 padding are cut
into powers of two, which fill windows without a gap. The plan is a list of window patterns with counts: its
size depends on the window, not on the corpus. Each rest then finds its place by its rank among equal lengths.

Scale notes: the text is tokenized once, in place; only piece descriptions (about 40 bytes for up to 1024
tokens) are shuffled. Ranks are two-step prefix sums, so one length shared by a third of all rows doesn't meet in one
task. The driver handles the fixed-size histogram and plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import small_batches, stored, text_of
from loomspan.llm.mixing import _prefix, n_buckets

WINDOW = 1024


def combinations(window: int) -> list[tuple[int, ...]]:
    """All pairs and triples of lengths that sum to the window, longest first."""
    pairs = [(window - b, b) for b in range(1, window // 2 + 1)]
    return pairs + [(a, b, window - a - b) for a in range(-(-window // 3), window - 1) for b in range(-(-(window - a) // 2), min(a, window - a - 1) + 1)]


def solve(counts: np.ndarray, combos: list[tuple[int, ...]], steps: int = 400) -> np.ndarray:
    """min ||A x - counts|| with x >= 0 by accelerated projected gradient; A[l, c] is how often combo c has length l."""
    column = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    row = np.array([length for c in combos for length in c], dtype=np.int64)
    n, m = len(counts), len(combos)
    times = lambda x: np.bincount(row, weights=x[column], minlength=n)
    back = lambda y: np.bincount(column, weights=y[row], minlength=m)
    v = np.ones(m)
    for _ in range(30):  # the largest squared singular value bounds the step
        v = back(times(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = z = np.zeros(m)
    t = 1.0
    for _ in range(steps):
        new = np.maximum(z - back(times(z) - counts) / (1.02 * norm), 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def plan(counts: np.ndarray, window: int = WINDOW) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Window patterns with how often each is used, and how many rests of each length are left to be cut.

    counts[l]: rests of length l, for l below the window. Every rest is in exactly one pattern use or left to be cut.
    """
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left.sum() > 1:
        combos = combinations(window)
        x = solve(left.astype(float), combos)
        carry = 0.0
        for c in np.argsort(-x, kind="stable"):
            if x[c] <= 1e-9:
                break
            carry += x[c]
            combo = combos[c]
            need = {length: combo.count(length) for length in combo}
            k = int(min(np.floor(carry), *(left[length] // many for length, many in need.items())))
            carry -= np.floor(carry)
            if k > 0:
                out.append((combo, k))
                for length, many in need.items():
                    left[length] -= k * many
    cut_up = np.zeros_like(left)
    for pattern, k in _best_fit(left, window):
        total = sum(pattern)
        if window - total <= window // 64 or total & (total - 1) == 0:
            out.append((pattern, k))
        else:
            for length in pattern:
                cut_up[length] += k
    return out, cut_up


def _best_fit(left: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: open[s] holds window patterns with s tokens of room."""
    open_: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(window + 1)]
    for length in range(len(left) - 1, 0, -1):
        n = int(left[length])
        room = length
        while n:
            while room <= window and not open_[room]:
                room += 1
            if room > window:
                # a new window holds as many of this length as fit
                each = window // length
                k, rest = divmod(n, each)
                if k:
                    open_[window - each * length].append(((length,) * each, k))
                if rest:
                    open_[window - rest * length].append(((length,) * rest, 1))
                break
            pattern, k = open_[room].pop()
            fit = room // length
            full = min(k, n // fit)
            if full:
                open_[room - fit * length].append((pattern + (length,) * fit, full))
                n -= full * fit
            if k > full and n:
                open_[room - n * length].append((pattern + (length,) * n, 1))
                k, n = k - 1, 0
            if k > full:
                open_[room].append((pattern, k - full))
    return [p for some in open_ for p in some]


class Places:
    """The plan as arrays: the r-th rest of a length -> its pieces' (start, length, sequence, offset)."""

    def __init__(self, made: list[tuple[tuple[int, ...], int]], cut_up: np.ndarray, window: int):
        slots: list[list[tuple[int, int, int]]] = [[] for _ in range(window + 1)]
        base = 0
        for pattern, k in made:
            at = 0
            for length in pattern:
                slots[length].append((k, base, at))
                at += length
            base += k
        self.window, self.sequences, self.slots, self.whole = window, base, {}, np.zeros(window + 1, dtype=np.int64)
        for length, some in enumerate(slots):
            if some:
                k, first, at = (np.array(x, dtype=np.int64) for x in zip(*some, strict=True))
                self.slots[length] = (np.cumsum(k) - k, first, at)
                self.whole[length] = k.sum()
        # powers of two laid out in falling order never cross a window's end
        lengths = np.arange(len(cut_up))
        self.bits = [b for b in reversed(range(window.bit_length())) if (lengths >> b & 1).any()]
        self.first: dict[int, np.ndarray] = {}
        self.at: dict[int, int] = {}
        total = 0
        for b in self.bits:
            n = np.where(lengths >> b & 1, cut_up, 0)
            self.first[b], self.at[b] = np.cumsum(n) - n, total
            total += int(n.sum()) << b
        self.last = total // window * window  # from here on the parts stand alone, each a power of two

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """Indices into the arguments, and start within the rest, length, sequence and offset of each piece."""
        out: list[tuple[np.ndarray, ...]] = []
        every = np.arange(len(rank))
        for value in np.unique(length):
            here = every[(length == value) & (rank < self.whole[value])]
            if len(here):
                start, first, at = self.slots[int(value)]
                k = np.searchsorted(start, rank[here], side="right") - 1
                out.append((here, np.zeros_like(here), np.full_like(here, value), first[k] + rank[here] - start[k], at[k]))
            here = every[(length == value) & (rank >= self.whole[value])]
            done = 0
            for b in self.bits if len(here) else ():
                if value >> b & 1:
                    place = self.at[b] + ((self.first[b][value] + rank[here] - self.whole[value]) << b)
                    alone = place >= self.last
                    sequence = self.sequences + np.where(alone, self.last // self.window + place - self.last, place // self.window)
                    out.append((here, np.full_like(here, done), np.full_like(here, 1 << b), sequence, np.where(alone, 0, place % self.window)))
                    done += 1 << b
        empty = np.empty(0, dtype=np.int64)
        return tuple(np.concatenate(x) if x else empty for x in (zip(*out, strict=True) if out else [()] * 5))


def powers(length: int) -> list[int]:
    """The powers of two that sum to a length, largest first."""
    return [1 << b for b in reversed(range(length.bit_length())) if length >> b & 1]


def cut(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Windows and rest of every row: doc_id, start, length, ids_crc32, part_crcs, doc_tokens (and ids, little-endian bytes).

    part_crcs: of the powers of two that a rest would be cut into; they save the ids from being kept or made again.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomspan.llm.tokens import encoded

        for batch in batches:
            for a, b, flat, begin in encoded(vocabulary, "byte", batch.column(1)):
                at = begin + np.arange(b - a + 1)  # with the end id of each text before it
                every = np.full(at[-1], end_id, dtype="<u4")
                every[np.arange(len(flat)) + np.repeat(np.arange(b - a), np.diff(begin))] = flat
                # the windows of a text, then its rest
                total = np.diff(at)
                pieces = -(-total // window)
                take = np.repeat(np.arange(b - a), pieces)
                start = (np.arange(len(take)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
                length = np.minimum(window, total[take] - start)
                raw, crc, ids, parts = memoryview(every.tobytes()), [], [], []
                for at_byte, n in zip((4 * (at[take] + start)).tolist(), length.tolist(), strict=True):
                    piece = raw[at_byte : at_byte + 4 * n]
                    crc.append(zlib.crc32(piece))
                    some, k = [], 0
                    for p in powers(n) if n < window else ():
                        some.append(zlib.crc32(piece[k : k + 4 * p]))
                        k += 4 * p
                    parts.append(some)
                    if with_ids:
                        ids.append(bytes(piece))
                columns = [batch.column(0).take(pa.array(take + a)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total[take])), pa.array(parts, pa.list_(pa.int64()))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part_crcs"]
                yield pa.record_batch(columns + [pa.array(ids, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, part_crcs array<long>" + ", ids binary" * with_ids)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Every token lies in exactly one piece, every piece in one sequence of at most ``window`` tokens. A null or empty text
    is the end id alone; repeated rows are packed each on their own. Empty input gives no rows.
    """
    with small_batches(docs.sparkSession):
        pieces = stored(cut(docs, vocabulary, id_col, text_col, window, end_id, with_ids), "pieces")
    got = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``window`` rows
    counts = np.zeros(window + 1, dtype=np.int64)
    for r in got:
        counts[r["length"]] = r["n"]
    full = int(counts[window])
    made, cut_up = plan(counts[:window], window)
    places = Places(([((window,), full)] if full else []) + made, cut_up, window)
    parts = n_buckets(int(counts.sum()))
    rows = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)))
    ranked = _prefix(rows, "length", "part", ["doc_id", "start", "ids_crc32"], F.lit(1), "rank").drop("part")
    schema = f"doc_id {pieces.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            length = columns["length"].to_numpy()
            take, begin, size, sequence, offset = places.find(length, columns["rank"].to_numpy())
            crcs, part_crcs = columns["ids_crc32"].to_pylist(), columns["part_crcs"].to_pylist()
            # a part's number: how many larger powers its rest has
            crc = [crcs[i] if n == length[i] else part_crcs[i][powers(int(length[i])).index(n)] for i, n in zip(take.tolist(), size.tolist(), strict=True)]
            index = pa.array(take)
            out = [columns["doc_id"].take(index), pa.array(columns["start"].to_numpy()[take] + begin), pa.array(size), pa.array(crc, pa.int64()), columns["doc_tokens"].take(index), pa.array(sequence), pa.array(offset)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                ids = columns["ids"].to_pylist()
                out.append(pa.array([ids[i][4 * b : 4 * (b + n)] for i, b, n in zip(take.tolist(), begin.tolist(), size.tolist(), strict=True)], pa.binary()))
                names = [*names, "ids"]
            yield pa.record_batch(out, names=names)

    return ranked.mapInArrow(place, schema)
