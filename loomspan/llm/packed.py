"""Arrays as binary cells, for exchanges of many numbers in few rows, and hashes of words and shingles.

A packed cell holds integer arrays byte plane by byte plane, so that the high planes (mostly zero for sorted differences and
small numbers) cost almost nothing under the shuffle's own compression.
"""

from __future__ import annotations

import ctypes
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: odd multiplier of the powers that combine fingerprints.
_P = 0x9E3779B97F4A7C15
#: Words up to so many bytes are hashed by a table with a random number for each byte at each place and for each length,
#: longer ones by BLAKE2b.
SHORT = 32
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, SHORT * 256, dtype=np.uint64)
_LENGTHS = np.random.default_rng(20240301).integers(0, 1 << 64, SHORT + 1, dtype=np.uint64)
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def pack(*arrays: np.ndarray) -> bytes:
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        out.append(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)))
        out.append(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes() if len(a) else b"")
    return b"".join(out)


def unpack(raw: bytes) -> list[np.ndarray]:
    n, at, out = raw[0], 1, []
    for _ in range(n):
        kind, length = struct.unpack_from("<2sQ", raw, at)
        dtype = np.dtype("<" + kind.decode())
        at += struct.calcsize("<2sQ")
        planes = np.frombuffer(raw, dtype=np.uint8, count=length * dtype.itemsize, offset=at).reshape(dtype.itemsize, length)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype) if length else np.empty(0, dtype))
        at += length * dtype.itemsize
    return out


def narrow(values: np.ndarray) -> np.ndarray:
    """Numbers below 2^32 with as many bits each as the largest needs, as bytes; the first byte says how many."""
    width = max(1, int(values.max()).bit_length()) if len(values) else 1
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little")
    return np.concatenate([np.array([width], np.uint8), np.packbits(bits.reshape(-1), bitorder="little")])


def widen(raw: np.ndarray, n: int) -> np.ndarray:
    """The n numbers of narrow()."""
    width = int(raw[0])
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(raw[1:], count=n * width, bitorder="little").reshape(n, width)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


def finish(h: np.ndarray) -> np.ndarray:
    """Mix 64-bit values (the splitmix64 finisher)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(15, _P, dtype=np.uint64)]))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts in order: the number of each one's text and its 64-bit fingerprint."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    blank = _SPACES[data]
    begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    ends = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    doc = np.searchsorted(np.cumsum(lengths), begins, side="right")
    if not len(begins):
        return doc, np.empty(0, dtype=np.uint64)
    size = ends - begins
    first = np.cumsum(size) - size
    inside = np.arange(int(size.sum())) - np.repeat(first, size)
    inside &= SHORT - 1
    inside <<= 8
    inside |= data[~blank]
    made = finish(np.bitwise_xor.reduceat(_TABLE.take(inside), first) ^ _LENGTHS.take(np.minimum(size, SHORT)))
    for i in np.flatnonzero(size > SHORT).tolist():
        made[i] = int.from_bytes(hashlib.blake2b(data[begins[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return doc, made


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of 64-bit fingerprints as shard numbers (fewer than 2^32): ascending keys have ascending shards."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def runs(numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(number, begin, end) of each run of equal numbers; costs what there is, not what there could be."""
    if len(numbers):
        begin = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
        yield from zip(numbers[begin].tolist(), begin.tolist(), np.append(begin[1:], len(numbers)).tolist(), strict=True)


def combine(*parts: np.ndarray) -> np.ndarray:
    """One fingerprint of a sequence of fingerprints, element by element."""
    out = np.zeros(len(parts[0]), dtype=np.uint64)
    for k, p in enumerate(parts):
        out += p * _POWERS[k + 1]
    return finish(out)


def chunks(sizes: list[int], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Runs of bounded joint size; a larger single item stands alone."""
    at, size = 0, 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(sizes):
        yield at, len(sizes)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give memory that is free again back to the system: workers live on, and so would their largest moments."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def texts_of(column: pa.Array, most: int = 3 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first, end, texts as UTF-8) of a string column in runs of bounded size, so one run at a time is in memory."""
    for a, b in chunks(pc.binary_length(column).to_pylist(), most):
        yield a, b, column.slice(a, b - a).cast(pa.binary()).to_pylist()
        release()
