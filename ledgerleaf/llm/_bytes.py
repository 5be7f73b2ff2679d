"""Vectorised hashing of the bytes of an Arrow batch of texts.

A prefix sum of ``T[byte] * B**-i`` (64-bit arithmetic, B odd) gives the
polynomial hash of any range of bytes by one subtraction and one product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Window starts that are worked on at a time; bounds the memory of one long document too.
BLOCK = 1 << 17

_U = np.uint64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, 256, dtype=np.uint64)


TABLES = (_table(20240101), _table(20240202))
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i < n at least."""
    if which not in _powers or len(_powers[which][0]) < n:
        base = BASES[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, BLOCK + 4096), b, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers[which] = (out[0], out[1])
    return _powers[which]


def prefix(data: np.ndarray, which: int) -> np.ndarray:
    """The n + 1 prefix sums for ``data`` (uint8)."""
    c = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(TABLES[which][data] * powers(which, len(data) + 1)[1][: len(data)], out=c[1:])
    return c


def ranges(c: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """Hashes of data[start:end), element by element; equal bytes give equal hashes wherever they stand."""
    return (c[end] - c[start]) * powers(which, len(c))[0][start]


def every(c: np.ndarray, k: int, which: int) -> np.ndarray:
    """Hashes of all ranges of k bytes."""
    n = len(c) - k
    return (c[k:] - c[:n]) * powers(which, len(c))[0][:n] if n > 0 else np.zeros(0, dtype=np.uint64)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = texts.fill_null("" if "string" in str(texts.type) else b"")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def window_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """For each p the leftmost position of the smallest of h[p:p+w]."""
    at = np.arange(len(h), dtype=np.int64)
    size = 1
    while size * 2 <= w:
        take = h[size:] < h[:-size]
        at = np.where(take, at[size:], at[:-size])
        h = np.where(take, h[size:], h[:-size])
        size *= 2
    if size < w:
        s = w - size
        at = np.where(h[s:] < h[:-s], at[s:], at[:-s])
    return at


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20):
    """``batch`` in slices with about ``most`` bytes of text in ``column`` (one row at least)."""
    texts = batch.column(column)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1)
    i = 0
    while i < len(batch):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
