"""Operator 12: periodic runs of words by dyadic square catching.

The text grows word by word. Every completed block of 2**k words gets a catcher, which
watches for the block to appear again 2 to 4 block lengths later: each square of period
q holds a completed block of 2**k <= q / 2 words in its first half, and that block stands
again q words on. A catcher that finds its block compares suffixes, word by word to both
sides, and so reports squares; squares of one period whose words overlap merge into one
run. Each appended word meets a bounded number of catchers for each of the log n block
lengths, so a text of n words takes n log n comparisons.

Here the appended words of many documents advance together: for one block length all
comparisons of a slice of documents are one array operation. Words are numbered exactly;
blocks and suffixes are compared by 64-bit hashes of their numbers, and a run is checked
word by word before it is reported. Words of different documents are never equal.

A run is a stretch with smallest period q and a length of at least
``max(least, exponent * q)`` words which neither neighbour extends. Stretches that a
multiple of their period finds again have the same bounds, and only the smallest period
stays.

There is no shuffle, so copies of one text and hot sources cost no more than other rows.
A null text is empty; texts of any length are used whole, in one task; memory follows the
longest text. Repeated rows are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm import _bytes, _shared

#: A run repeats its period so many times at least, and has so many words.
EXPONENT, LEAST = 4, 6

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _prefix(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix sums of word * B**-i, powers of B): the hash of any stretch is one subtraction and one product."""
    p = np.empty((2, len(words) + 1), _U)
    for row, b in zip(p, (_BASE, pow(_BASE, -1, 1 << 64))):
        row[:] = b
        row[0] = 1
        np.cumprod(row, out=row)
    sums = np.zeros(len(words) + 1, _U)
    np.cumsum(_bytes.mix(words.astype(_U) + _U(1)) * p[1, : len(words)], out=sums[1:])
    return sums, p[0]


def _agree(sums: np.ndarray, powers: np.ndarray, x: np.ndarray, q: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """For each i the number of words, at most most[i], that agree at x[i] and x[i] + q[i], forward from there or backward before it."""
    low, high = np.zeros_like(most), most.copy()  # low words agree, more than high don't
    while len(open_ := np.flatnonzero(low < high)):
        n = (low[open_] + high[open_] + 1) // 2
        a = x[open_] - (n if back else 0)
        b = a + q[open_]
        same = (sums[a + n] - sums[a]) * powers[a] == (sums[b + n] - sums[b]) * powers[b]
        low[open_] = np.where(same, n, low[open_])
        high[open_] = np.where(same, high[open_], n - 1)
    return low


def _caught(sums: np.ndarray, powers: np.ndarray, n: int, size: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, period) of the stretches of completed blocks of ``size`` words that stand again one period on, ``least`` blocks or more."""
    found = []
    rows = n // size
    rolling = np.zeros(rows * size, _U)
    m = min(rows * size, n - size + 1)
    rolling[:m] = (sums[size : size + m] - sums[:m]) * powers[:m]
    table = rolling.reshape(rows, size)
    blocks = table[:, :1]
    for ahead in (1, 2, 3) if size == 1 else (2, 3):
        if rows <= ahead:
            break
        same = np.zeros((size, rows - ahead + 2), bool)  # by period, then by block; a false one at either end
        same[:, 1:-1] = (table[ahead:] == blocks[:-ahead]).T
        if m < rows * size:  # the last block's shifted ones leave the text
            same[m - (rows - 1) * size :, -2] = False
        flat = same.ravel()
        edges = np.flatnonzero(flat[1:] != flat[:-1]) + 1
        first, last = edges[::2], edges[1::2]
        enough = last - first >= least
        first, last = first[enough], last[enough]
        shift, block = np.divmod(first, rows - ahead + 2)
        found.append(((block - 1) * size, (last - first) * size, ahead * size + shift))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def find_runs(words: np.ndarray, ends: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of numbered ``words``, by start and period; ``ends``: where each document ends.

    Documents must not share numbers, so that no stretch crosses an end.
    """
    exponent = max(2, exponent)
    begin = np.r_[0, ends[:-1]]
    out, size, longest = [], 1, int(np.max(ends - begin, initial=0))
    base, held = np.arange(len(words)), None  # positions of the words that are still looked at
    while 2 * size * exponent <= longest or size == 1:
        wanted = ends - begin >= max(least, exponent * (1 if size == 1 else 2 * size))
        keep = np.repeat(wanted, ends - begin)
        if held is None or 2 * int(keep.sum()) < len(base):  # short documents hold no run of such periods
            base = np.flatnonzero(keep)
            if not len(base):
                break
            held = _prefix(words[base])
        sums, powers = held
        n = len(base)
        reach = (exponent - 1) * (1 if size == 1 else 2 * size)
        x, stretch, q = _caught(sums, powers, n, size, max(1, (reach - size + 1) // size))
        back = _agree(sums, powers, x, q, np.minimum(size - 1, x), True)
        ahead = _agree(sums, powers, x + stretch, q, np.minimum(size, n - x - stretch - q), False)
        start, length = x - back, back + stretch + ahead + q
        good = length >= np.maximum(least, exponent * q)
        out.append((base[start[good]], length[good], q[good]))
        size *= 2
    if not out:
        return (np.zeros(0, np.int64),) * 3
    start, length, q = (np.concatenate(c) for c in zip(*out))
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    first = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])][: len(start)]
    start, length, q = start[first], length[first], q[first]
    for i in range(len(start)):
        if not np.array_equal(words[start[i] : start[i] + length[i] - q[i]], words[start[i] + q[i] : start[i] + length[i]]):
            raise ArithmeticError("two blocks of words share a hash")
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def _kernel(exponent: int, least: int):
    """In: text; out: n_words, runs, collapsed, beside the other columns."""

    def run(batches):
        for whole in batches:
            for batch in _bytes.slices(whole, 0, 2 << 20):
                split = [t.split() for t in batch.column(0).cast(pa.binary()).fill_null(b"").to_pylist()]
                numbers, used = [], 0
                for words in split:
                    own = {w: i for i, w in enumerate(dict.fromkeys(words), used)}
                    used += len(own)
                    numbers.append(np.fromiter(map(own.__getitem__, words), np.int64, len(words)))
                sizes = np.array([len(w) for w in split], np.int64)
                ends = np.cumsum(sizes)
                start, length, q = find_runs(np.concatenate(numbers), ends, exponent, least)
                doc = np.searchsorted(ends, start, "right")
                drop = np.zeros(int(sizes.sum()) + 1, np.int32)
                np.add.at(drop, start + q, 1)
                np.add.at(drop, start + length, -1)
                gone = np.cumsum(drop)[:-1] > 0
                collapsed = []
                for k, words in enumerate(split):
                    own = gone[ends[k] - sizes[k] : ends[k]]
                    collapsed.append(b" ".join([words[i] for i in np.flatnonzero(~own)] if own.any() else words))
                offsets = np.searchsorted(doc, np.arange(len(split) + 1)).astype(np.int32)
                at = start - (ends - sizes)[doc]
                runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (at, length, q)], ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes), runs.cast(_RUNS), pa.array(collapsed, pa.binary()).cast(pa.string())], [*batch.schema.names[1:], "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (by start, then period) and collapsed.

    Words are runs of non-blanks and are numbered from 0. ``collapsed`` is the text whose
    runs are cut down to their first period, its words joined by one space. Other
    columns of ``docs`` are ignored.
    """
    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"))
    return rows.mapInArrow(_shared.lean("periodic_runs", _kernel(exponent, least)), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the contract's periodic endings: one document in ten, by CRC-32, repeats its words from word a on with period p."""
    words = "filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.expr("crc32(cast(doc_id as string))").alias("h"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, F.expr(words))).withColumn("n", F.size("w").cast("long"))
    rows = rows.withColumn("a", F.expr("if(n > 0, (h div 10) % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + (h div 10) % 8)"))
    again: Column = F.expr("array_join(transform(sequence(0, n - 1), i -> w[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's rows over ``planted(docs)``; a null doc_id plants nothing."""
    found = periodic_runs(planted(docs))
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\\n'), '')")
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
