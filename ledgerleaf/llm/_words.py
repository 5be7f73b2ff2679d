"""Words and word shingles of an Arrow batch of texts as 64-bit hashes; words are runs of non-blanks, A-Z lower-cased."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ledgerleaf.llm import _bytes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each document and the end)."""
    raw, offsets = _bytes.buffers(texts)
    n = len(raw)
    solid = ~_BLANK[raw]
    before = np.r_[False, solid[:-1]] if n else solid
    before[offsets[:-1][offsets[:-1] < n]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.r_[solid[1:], False] if n else solid
    cut = offsets[1:] - 1
    after[cut[cut >= 0]] = False
    ends = np.flatnonzero(solid & ~after) + 1
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _bytes.BLOCK)))
        at = starts[i]
        c = _bytes.prefix(_LOWER[raw[at : ends[j - 1]]], 0)
        out[i:j] = _bytes.mix(_bytes.ranges(c, starts[i:j] - at, ends[i:j] - at, 0) + (ends[i:j] - starts[i:j]).astype(np.uint64))
        i = j
    return out, np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the k-word shingles, and where each stands first.

    Shorter texts give their whole sequence as one shingle, empty ones none.
    """
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = min(k, len(words))
    h = np.full(len(words) - m + 1, m, np.uint64)
    for i in range(m):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - m + 1 + i]
    return np.unique(_bytes.mix(h), return_index=True)
