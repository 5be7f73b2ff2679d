"""Operator 2: removal of repeated byte strings by a depth-limited radix sort of suffixes.

Only the first ``threshold`` bytes of a suffix decide, so suffixes are ordered no
deeper than that, by most-significant-digit passes, and what a pass leaves alone
in its group is finished and carried no further:

* Which suffixes are sorted: every window of ``threshold`` bytes contains exactly
  one *anchor*, the ``DIGIT`` bytes with the smallest hash in it (leftmost of
  equals). Equal windows have equal anchors at equal offsets, so sorting one entry
  per anchor - with all windows that chose it - orders all windows.
* Pass 1: the digit is the anchor. A group with one document ends here.
* Pass 2: the digit is the whole neighbourhood, from the first byte of the first
  window that chose the anchor to the last byte of the last one. In an equal
  group all documents but the smallest repeat all these windows.
* Pass 3: of entries in one group with different neighbourhoods, those that share
  the bytes before or after the anchor - half of what a window adds to it, so one
  of the two is part of every window - with another document go on.
* Pass 4: these go down to the full depth, window by window. Equal groups are
  exactly the repeated windows.

Digits are compared by hashes, of 64 bits in the first two passes and 128 in the last.

Skew: each task first closes what repeats among its own documents, so a passage
that a third of all documents share arrives from each task once. Null texts are
empty; rows with a null doc_id are neither smaller nor larger than others, and
lose nothing; rows with one doc_id do not remove from each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.llm import _bytes, _shared

THRESHOLD = 50
#: Bytes of the first digit; at most 31 windows may choose one anchor.
DIGIT = 20
#: Entries between two rounds of closing what repeats within a task.
LOCAL = 300_000

#: x and y: the upper and the lower 32 bits of the neighbourhood's hash; in x also 16 bits each of the bytes before and after the anchor (0: no window needs them).
#: at: 22 bits of the text's CRC-32, the first window's start, 5 bits for the number of windows less one.
#: A finished range has its length as x, 0 as y, and at with the sign bit.
_ENTRY = "h long, x long, y int, at long, doc long"
_NAMES = [n.split()[0] for n in _ENTRY.split(", ")]
_TAG = (1 << 22) - 1
_U = np.uint64


def _entries(raw: np.ndarray, offsets: np.ndarray, threshold: int, digit: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, x, y, document index, first window's start, number of windows) of one batch, block by block."""
    ends, begins = offsets[1:], offsets[:-1]
    half = (threshold - digit) // 2
    for at in range(0, len(raw) - threshold + 1, _bytes.BLOCK):
        data = raw[at : at + _bytes.BLOCK + threshold - 1]
        n = len(data) - threshold + 1
        c1 = _bytes.prefix(data, 0)
        h = _bytes.mix(_bytes.every(c1, digit, 0))
        anchor = _bytes.window_argmin(h, threshold - digit + 1)
        a, b = np.searchsorted(ends, at, "right"), np.searchsorted(begins, at + n, "left")
        crossing = np.zeros(n + 1, np.int32)  # a window that leaves its document is none
        cut = ends[a:b]
        np.add.at(crossing, np.clip(np.maximum(cut - threshold + 1, begins[a:b]) - at, 0, n), 1)
        np.add.at(crossing, np.clip(cut - at, 0, n), -1)
        valid = np.flatnonzero(np.cumsum(crossing[:-1]) == 0)
        if not len(valid):
            continue
        mine = anchor[valid]
        first = np.flatnonzero(np.r_[True, (mine[1:] != mine[:-1]) | (valid[1:] != valid[:-1] + 1)])
        last = np.r_[first[1:], len(valid)] - 1
        lo, hi, mid = valid[first], valid[last], mine[first]
        c2 = _bytes.prefix(data, 1)
        shape = ((mid - lo) * 4096 + (hi - lo) + 1).astype(_U)
        e = _bytes.mix(_bytes.ranges(c2, lo, hi + threshold, 1) + shape * _U(0xA24BAED4963EE407))
        x = (e >> _U(32)) << _U(32)
        for needed, start, end, shift in ((mid - lo >= half, np.maximum(mid - half, 0), mid, 16), (mid - hi <= threshold - digit - half, mid + digit, np.minimum(mid + digit + half, len(data)), 0)):
            x |= np.where(needed, (_bytes.mix(_bytes.ranges(c2, start, end, 1)) >> _U(48)) | _U(1), _U(0)) << _U(shift)
        yield h[mid], x, e.astype(np.uint32), np.searchsorted(ends, lo + at, "right"), lo + at, hi - lo + 1


def _merged(doc: np.ndarray, lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the first, start, end) of the unions of ranges that are sorted by document and start."""
    if not len(doc):
        return np.zeros(0, np.int64), lo, end
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (lo[1:] > end[:-1])])
    return new, lo[new], np.maximum.reduceat(end, new)


def _close(parts: list, threshold: int):
    """Entries of one task: those that a smaller document of the task repeats become finished ranges."""
    h, x, y, doc, tag, lo, n = (np.concatenate(c) for c in zip(*parts))
    key = _bytes.mix(_bytes.mix(h * _U(0x9FB21C651E98DF25) + x) + y)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    least = np.empty(len(key), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.r_[first, len(key)]))
    done = np.flatnonzero(least < doc)
    run = np.cumsum(np.r_[0, (doc[done][1:] != doc[done][:-1]) | (lo[done][1:] < lo[done][:-1])][: len(done)])
    new, start, end = _merged(run, lo[done], lo[done] + n[done] + threshold - 1)
    at, left = done[new], least == doc
    spread = _bytes.mix((doc[at].astype(_U) << _U(20)) + start.astype(_U))
    where = (tag << 41) | (lo << 5)
    cols = [np.r_[h[left], spread].view(np.int64), np.r_[x[left].view(np.int64), end - start], np.r_[y[left].view(np.int32), np.zeros(len(at), np.int32)], np.r_[(where | (n - 1))[left], where[at] | np.int64(-1 << 63)], np.r_[doc[left], doc[at]]]
    for k in range(0, len(cols[0]), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 50_000]) for c in cols], _NAMES)


def _digits(threshold: int, digit: int):
    def run(batches):
        parts, held = [], 0
        for batch in batches:
            doc, tag = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            raw, offsets = _bytes.buffers(batch.column(2))
            for h, x, y, i, lo, n in _entries(raw, offsets, threshold, digit):
                parts.append((h, x, y, doc[i], tag[i], lo - offsets[i], n))
                held += len(h)
                if held >= LOCAL:
                    yield from _close(parts, threshold)
                    parts, held = [], 0
        if held:
            yield from _close(parts, threshold)

    return run


def _neighbourhoods(threshold: int):
    """The bytes of the open entries; in: doc, tag, text, open."""

    def run(batches):
        names = ["h", "doc", "tag", "lo", "bytes"]
        for batch in batches:
            raw, offsets = _bytes.buffers(batch.column(2))
            opened = batch.column(3)
            size = np.diff(opened.offsets.to_numpy())
            doc, tag, begin = (np.repeat(y, size) for y in (batch.column(0).to_numpy(), batch.column(1).to_numpy(), offsets[:-1]))
            flat = opened.flatten()
            lo, n, h = (flat.field(f).to_numpy() for f in ("lo", "n", "h"))
            for k in range(0, len(lo), 50_000):
                some = slice(k, k + 50_000)
                pieces = [raw[a : a + m].tobytes() for a, m in zip((begin + lo)[some].tolist(), (n + threshold - 1)[some].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(doc[some]), pa.array(tag[some]), pa.array(lo[some]), pa.array(pieces, pa.binary())], names)

    return run


def _joined(batches):
    """The unions of the ranges of each document."""
    for batch in batches:
        ranges = batch.column(2)
        size, flat = np.diff(ranges.offsets.to_numpy()), ranges.flatten()
        row = np.repeat(np.arange(len(batch)), size)
        lo, length = flat.field("lo").to_numpy(), flat.field("len").to_numpy()
        order = np.lexsort((lo, row))
        row, lo, end = row[order], lo[order], (lo + length)[order]
        top = end.copy()  # the furthest end so far in the document
        for a, b in zip(np.r_[0, np.cumsum(size)[:-1]], np.cumsum(size)):
            np.maximum.accumulate(end[a:b], out=top[a:b])
        new, lo, end = _merged(row, lo, top)
        at = np.searchsorted(row[new], np.arange(len(batch) + 1)).astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(lo), pa.array(end - lo)], ["lo", "len"]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), spans], ["doc", "tag", "spans"])


def _cut(batches):
    """In: doc_id, text, spans (or null); out: the digest of each row."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for batch in batches:
        raw, offsets = _bytes.buffers(batch.column(1))
        spans, out = batch.column(2), []
        for k in range(len(batch)):
            data, removed, runs = raw[offsets[k] : offsets[k + 1]], 0, 0
            digest = hashlib.sha256()
            at = 0
            if spans[k].is_valid:
                lo = np.array(spans[k].values.field("lo"), np.int64)
                end = lo + np.array(spans[k].values.field("len"), np.int64)
                for lo, end in zip(lo.tolist(), end.tolist()):
                    digest.update(data[at:lo])
                    removed, runs, at = removed + end - lo, runs + 1, end
            digest.update(data[at:])
            out.append((len(data), removed, runs, digest.hexdigest()))
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names)


def repeated_spans(docs: DataFrame, threshold: int = THRESHOLD, digit: int = DIGIT) -> tuple[DataFrame, DataFrame]:
    """(ranges, scratch): (doc, tag, lo, len) of byte ranges that windows starting in smaller documents repeat; they may overlap.

    ``scratch`` is the staged table that the ranges are read from.

    ``tag`` holds bits of the text's CRC-32, which tell rows with one doc_id apart.
    """
    _shared.small_batches(docs.sparkSession)
    if not 0 < threshold - digit < 32:
        raise ValueError("a digit must be less than the threshold by 1 to 31 bytes")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), _tag(), "text").where(f"doc is not null and octet_length(text) >= {threshold}")
    entries = texts.mapInArrow(_digits(threshold, digit), _ENTRY)
    anchor = Window.partitionBy("h").orderBy("x", "y").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = entries.select("*", *(f(c).over(anchor).alias(f"{f.__name__}_{c}") for c in ("doc", "x", "y") for f in (F.min, F.max)), F.min("doc").over(Window.partitionBy("h", "x", "y")).alias("same"))
    seen = seen.withColumn("done", F.expr("at < 0 or same < doc")).where("done or (min_doc < max_doc and (min_x < max_x or min_y < max_y))")
    for side, shift in (("before", 16), ("after", 0)):
        seen = seen.withColumn(side, F.expr(f"shiftright(x, {shift}) & 65535"))
        own, group = F.expr("if(done, null, doc)"), Window.partitionBy("h", side)
        seen = seen.withColumn(f"{side}_shared", (F.min(own).over(group) < F.max(own).over(group)) & (F.col(side) > 0))
    seen = seen.where("done or before_shared or after_shared")
    decoded = seen.select("h", "doc", "done", F.expr(f"shiftright(at & {(1 << 63) - 1}, 41)").alias("tag"), F.expr(f"shiftright(at, 5) & {(1 << 36) - 1}").alias("lo"), F.expr("if(at < 0, 0, (at & 31) + 1)").alias("n"), F.expr(f"if(at < 0, x, (at & 31) + {threshold})").alias("len"))
    found = _shared.stage(decoded, "suffixes")
    done = found.where("done").select("doc", "tag", "lo", "len")
    opened = found.where("not done").groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "n", "h")).alias("open"))
    with_open = texts.join(_shared.small_side(found.where("not done").select("doc", "tag").distinct()), ["doc", "tag"], "left_semi")
    deep = with_open.join(opened, ["doc", "tag"]).select("doc", "tag", "text", "open").mapInArrow(_neighbourhoods(threshold), "h long, doc long, tag long, lo long, bytes binary")
    deep = deep.repartition("h").select("h", "doc", "tag", "lo", F.posexplode(F.expr(f"transform(sequence(1, octet_length(bytes) - {threshold - 1}), i -> substring(bytes, i, {threshold}))")).alias("i", "window"))
    deep = deep.select("h", "doc", "tag", (F.col("lo") + F.col("i")).alias("lo"), F.xxhash64("window").alias("w1"), F.xxhash64("window", F.lit(1)).alias("w2"))
    again = deep.withColumn("same", F.min("doc").over(Window.partitionBy("h", "w1", "w2"))).where("same < doc")
    return done.unionByName(again.select("doc", "tag", "lo", F.lit(threshold).cast("long").alias("len"))), found


def _tag():
    return F.expr(f"crc32(text) & {_TAG}").alias("tag")


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, digit: int = DIGIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removes each byte covered by ``threshold`` bytes that also start in a document
    with a smaller doc_id; strings are judged on the input. Other columns of
    ``docs`` are ignored.
    """
    found, scratch = repeated_spans(docs, threshold, digit)
    ranges = found.groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "len")).alias("ranges"))
    spans = _shared.stage(ranges.mapInArrow(_joined, "doc long, tag long, spans array<struct<lo: long, len: long>>"), "spans")
    _shared.drop(scratch)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _tag())
    kept = rows.join(spans.withColumnRenamed("doc", "doc_id").hint("shuffle_merge"), ["doc_id", "tag"], "left")
    return kept.select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
