"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Words are runs of bytes outside these sets.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PUNCT = np.zeros(256, bool)
PUNCT[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_TABLE = LOWER.tobytes()

#: Bytes of text handled at a time; a longer text is a chunk of its own.
CHUNK = 1 << 19


try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _LIBC = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, start: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(start))


_BYTE = seeds(256, 7)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        m = 1 << max(10, (n - 1).bit_length())
        p = np.full(m, np.uint64(0xD6E8FEB86659FD93))
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS[:n]


def trim() -> None:
    """Give freed memory back to the system: a worker that lives on shares its machine with a heap."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


class Words(NamedTuple):
    """``start``/``end``: byte ranges in ``buf``; ``first[i]:first[i+1]`` are the words of text i; ``hash``: 64 bits of each word."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; null counts as empty."""
    a = batch.column(batch.schema.get_field_index(name))
    a = a.cast(pa.large_binary()) if not pa.types.is_large_string(a.type) else a
    if a.null_count:
        a = a.fill_null(b"" if pa.types.is_large_binary(a.type) else "")
    _, offs, data = a.buffers()
    offs = np.frombuffer(offs, np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def chunks(batch: pa.RecordBatch, name: str = "text", limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a batch of about ``limit`` bytes, with their bytes and offsets from 0."""
    buf, offs = column(batch, name)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi
    trim()


def hash_runs(dense: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs dense[at[i]:at[i + 1]]."""
    length = np.diff(at)
    with np.errstate(over="ignore"):
        terms = _powers(int(length.max()))[np.arange(len(dense)) - np.repeat(at[:-1], length)]
        terms *= _BYTE[dense]
        return mix(np.add.reduceat(terms, at[:-1]) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def words(buf: np.ndarray, offs: np.ndarray, gaps: np.ndarray = SPACE, lower: bool = False, hashes: bool = True) -> Words:
    """The words of texts that stand one after the other in ``buf``."""
    if lower:
        buf = LOWER[buf]
    if not len(buf):
        return Words(buf, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64), np.zeros(0, np.uint64))
    inside = ~gaps[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offs)
    h = np.zeros(len(start), np.uint64)
    if hashes and len(start):
        at = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start, out=at[1:])
        h = hash_runs(buf[inside], at)
    return Words(buf, start, end, first, h)


def grams(h: np.ndarray, k: int, salt: int = 11) -> np.ndarray:
    """Hash of the k words that begin at each word (the last k-1 places are left out)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    c = seeds(k, salt) | np.uint64(1)
    with np.errstate(over="ignore"):
        out = h[:n] * c[0]
        for j in range(1, k):
            out += h[j : j + n] * c[j]
    return mix(out)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    size, m = 1, a
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(m) - (w - size)], m[w - size :]) if w > size else m


def record_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from the concatenated values."""
    offs = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))
