"""Operator 13: phrase collocations by multikey three-way quicksort of suffix pointers.

Texts are split into pieces at punctuation and line ends, pieces into words. Every word
begins a suffix, which counts to a depth of ``max_words`` words or to the end of its
piece. A phrase's count is the number of suffixes that begin with it, which is the size
of an equal partition of the sorted suffixes:

* Each task numbers the words of some texts at a time and adds up its equal phrases of
  1 to ``max_words`` words, so a phrase that all documents share leaves a task once.
* These are routed to buckets by the words that lead them, all that a phrase has. The
  continuations of a very common word or pair so go to different buckets, and every
  count is whole in its bucket.
* In its bucket the phrases are sorted by multikey three-way quicksort: a segment is
  split at a pivot word into smaller, equal and larger; the equal part goes on to the next
  word. An equal part at the full depth, or at the end of its phrases, is one phrase, and
  its size the count. Parts that hold fewer than ``min_count`` are abandoned at once. All
  segments of a bucket are split in the same round of array operations.

What is left are phrases with ``min_count`` occurrences and their parts; scores, the
removal of phrases inside longer ones and the ranks are joins and windows over these.

Null texts are empty, a null lang is ``und``. Repeated rows count each time. A text of any
length is used whole, in parts that end with a piece. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.llm import _bytes, _shared

MAX_WORDS, MIN_COUNT, TOP = 3, 10, 2000
#: A phrase inside a longer one goes if the longer one has this share of its count.
SHARE_PERCENT = 50
#: Words whose phrases a task adds up at a time.
SLICE = 2_000_000
#: Bytes of text for each bucket of phrases, and the fewest buckets.
BUCKET_BYTES, BUCKETS = 8 << 20, 128
#: Rows of a language that are ranked together before the last ranking.
RANKED_PARTS = 64

#: Ends a piece: a byte that UTF-8 does not have.
_END = b"\xff"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + _END * 10)
_PACKETS = "slot long, lang string, n int, words binary, ids binary, counts binary"
_NAMES = [c.split()[0] for c in _PACKETS.split(", ")]
_PHRASES = "lang string, words array<string>, a long"
_U = np.uint64


def _narrow(x: np.ndarray) -> np.ndarray:
    """In the smallest unsigned type that holds all values."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _read(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}")


class _Slice:
    """The numbered words of some texts of one language; 0 ends a piece."""

    def __init__(self) -> None:
        self.index, self.parts, self.size = {_END: 0}, [np.zeros(1, np.int64)], 0

    def add(self, data: bytes) -> None:
        words = (data.translate(_FOLD) + _END).replace(_END, b" " + _END + b" ").split()
        for w in set(words) - self.index.keys():
            self.index[w] = len(self.index)
        self.parts.append(np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)))
        self.size += len(words)

    def phrases(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(words by depth, filled up with 0; counts) of the distinct phrases of 1 to ``depth`` words."""
        w, v = np.concatenate([*self.parts, np.zeros(depth, np.int64)]), len(self.index)
        at, ids, counts = np.flatnonzero(w), [], []
        for k in range(1, depth + 1):
            columns = [w[at + i] for i in range(k)]
            if v**k < 1 << 63:
                packed = columns[0]
                for c in columns[1:]:
                    packed = packed * v + c
                packed.sort()
                first = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]][: len(packed)])
                n = np.diff(np.r_[first, len(packed)])
                packed = packed[first]
                found = np.zeros((depth, len(packed)), np.int32)
                for i in reversed(range(k)):
                    left = packed // v
                    found[i] = packed - left * v
                    packed = left
            else:
                several, n = np.unique(np.stack(columns), axis=1, return_counts=True)
                found = np.vstack([several, np.zeros((depth - k, several.shape[1]), np.int64)]).astype(np.int32)
            ids.append(found)
            counts.append(n)
            at = at[w[at + k] > 0]
        return np.concatenate(ids, axis=1), np.concatenate(counts)

    def packets(self, lang: str, depth: int, buckets: int) -> Iterator[tuple]:
        """A row for each bucket that gets some of the phrases."""
        ids, counts = self.phrases(depth)
        if not len(counts):
            return
        words = list(self.index)
        sums = np.fromiter(map(zlib.crc32, words), _U, len(words))
        sums[0] = 0
        h = np.zeros(len(counts), _U)
        for row in ids:
            h = _bytes.mix(h * _U(0x9E3779B97F4A7C15) + sums[row])
        bucket = (h % _U(buckets)).astype(np.int64)
        bucket = _narrow(bucket)
        order = np.argsort(bucket, kind="stable")
        bucket, ids, counts = bucket[order], ids[:, order], counts[order]
        cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)]
        base = zlib.crc32(lang.encode()) << 31
        there, number = np.zeros(len(words), bool), np.zeros(len(words), np.int32)
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = ids[:, start:end]
            there[own] = True
            there[0] = True  # 0 stays the end
            used = np.flatnonzero(there)
            there[used] = False
            number[used] = np.arange(len(used))
            yield base + int(bucket[start]), lang, end - start, b" ".join([words[i] for i in used[1:].tolist()]), _narrow(number[own]).tobytes(), _narrow(counts[start:end]).tobytes()


def _pieces(data: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """``data`` in parts of about ``most`` bytes that end with a piece."""
    while len(data) > most:
        cut = max(data.rfind(c, 0, most) for c in (b".", b",", b"\n"))
        cut = min((i for c in (b".", b",", b"\n") if (i := data.find(c, most)) >= 0), default=-1) if cut < 0 else cut
        if cut < 0:
            break
        yield data[:cut]
        data = data[cut + 1 :]
    yield data


def _routed(depth: int, buckets: int):
    """In: lang, text; out: packets of phrases."""

    def flush(slices: dict[str, _Slice]) -> Iterator[pa.RecordBatch]:
        for lang, words in slices.items():
            rows = []
            for row in words.packets(lang, depth, buckets):
                rows.append(row)
                if len(rows) == 64:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)
        slices.clear()

    def run(batches):
        slices: dict[str, _Slice] = {}
        for whole in batches:
            for batch in _bytes.slices(whole, 1, 1 << 20):
                by: dict[str, list[bytes]] = {}
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                    if text:
                        by.setdefault(lang, []).append(text)
                for lang, texts in by.items():
                    own = slices.setdefault(lang, _Slice())
                    for part in _pieces(b"\n".join(texts)):
                        own.add(part)
                        if sum(s.size for s in slices.values()) >= SLICE:
                            yield from flush(slices)
                            own = slices.setdefault(lang, _Slice())
        yield from flush(slices)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _NAMES)


def equal_partitions(keys: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one of its suffixes, words, size) of each final equal partition that weighs ``least`` or more.

    ``keys``: the word at each depth of each suffix, 0 where it has ended. Multikey
    three-way quicksort: each round splits all segments at one of their words each,
    smaller, equal and larger; segments below ``least`` are abandoned, and suffixes
    whose leading word weighs less before all others.
    """
    depths, m = keys.shape
    flat = np.ascontiguousarray(keys).ravel()
    leading = np.bincount(keys[0], weights)[keys[0]] >= least if m else np.zeros(0, bool)  # partitions of one leading word are weighed first
    at = np.random.Generator(np.random.PCG64(13)).permutation(np.flatnonzero(leading)).astype(np.int32)  # so that a segment's last suffixes are any of them
    weight = weights[at].astype(np.float64)  # whole numbers, exact below 2**53
    segment, depth = np.zeros(len(at), np.int32), np.zeros(1, np.int64)
    found = []
    while len(at):
        key = flat[(depth * m)[segment] + at]
        of = [np.zeros(len(depth), flat.dtype) for _ in range(3)]
        for i, some in enumerate((slice(None), slice(len(at) // 3), slice(len(at) // 3, 2 * len(at) // 3))):
            of[i][:] = of[0]
            of[i][segment[some]] = key[some]
        pivot = np.maximum(np.minimum(of[0], of[1]), np.minimum(np.maximum(of[0], of[1]), of[2]))  # the median of three
        against = pivot[segment]
        part = 3 * segment + (key >= against) + (key > against)
        size = np.bincount(part, weight, 3 * len(depth))
        depth = np.repeat(depth, 3)
        equal = np.zeros(len(depth), bool)
        equal[1::3] = True
        ended = equal & np.repeat(pivot == 0, 3)
        depth[1::3] += 1
        keep = size >= least
        done = keep & equal & (ended | (depth == depths))
        if done.any():
            one = np.zeros(len(depth), np.int64)
            one[part] = at
            found.append((one[done], (depth - ended)[done], size[done].astype(np.int64)))
        keep &= ~done
        stay = keep[part]
        at, weight, segment = at[stay], weight[stay], (np.cumsum(keep) - 1).astype(np.int32)[part[stay]]
        depth = depth[keep]
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def _counted(depth: int, least: int):
    """In: packets sorted by slot; out: phrases with their counts, and under no words the number of all words."""

    def run(batches):
        for bucket in _shared.runs(batches, 1):
            by: dict[str, list] = {}
            for row in range(len(bucket)):
                lang, *packet = (bucket.column(i)[row].as_py() for i in range(1, 6))
                by.setdefault(lang, []).append(packet)
            for lang, packets in by.items():
                index, keys, weights = {_END: 0}, [], []
                for n, words, ids, counts in packets:
                    own = words.split(b" ")
                    new = [w for w in own if w not in index]
                    index.update(zip(new, range(len(index), len(index) + len(new))))
                    number = np.r_[0, np.fromiter(map(index.__getitem__, own), np.int32, len(own))].astype(np.int32)
                    keys.append(number[_read(ids, n * depth).reshape(depth, n)])
                    weights.append(_read(counts, n).astype(np.int64))
                keys, weights = np.concatenate(keys, axis=1), np.concatenate(weights)
                total = int(weights[keys[1] == 0].sum()) if depth > 1 else int(weights.sum())
                one, size, count = equal_partitions(keys, weights, least)
                words = list(index)
                out = [[words[i].decode() for i in keys[:k, p].tolist()] for p, k in zip(one.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(out) + 1)), pa.array([*out, []], pa.list_(pa.string())), pa.array([*count.tolist(), total], pa.int64())], ["lang", "words", "a"])

    return run


def phrase_counts(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, words, a): every phrase of 1 to ``max_words`` words with ``min_count`` occurrences or more; partial sums of all words under an empty ``words``."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(BUCKETS, size // BUCKET_BYTES)
    packets = texts.mapInArrow(_shared.lean("collocations", _routed(max_words, buckets)), _PACKETS)
    sorted_ = packets.repartition("slot").sortWithinPartitions("slot")
    return sorted_.mapInArrow(_shared.lean("collocations", _counted(max_words, min_count)), _PHRASES)


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, share_percent: int = SHARE_PERCENT) -> DataFrame:
    """(lang, phrase, words, a, cut, l, r, n, score): all phrases of 2 words and more that no longer one stands for.

    A phrase's score is that of its lowest-scoring cut, floor(1000000 * a * a / (l * r)),
    exact in decimals of 38 digits. Other columns of ``docs`` than lang and text are ignored.
    """
    counted = _shared.stage(phrase_counts(docs, max_words, min_count), "phrases")
    total = counted.where("size(words) = 0").groupBy("lang").agg(F.sum("a").alias("n"))
    phrases = counted.where("size(words) > 1").withColumn("phrase", F.array_join("words", " "))
    parts = counted.where(f"size(words) between 1 and {max_words - 1}").select("lang", F.array_join("words", " ").alias("part"), F.col("a").alias("count"))
    cuts = phrases.select("*", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("cut"))
    cuts = cuts.withColumn("first", F.expr("array_join(slice(words, 1, cut), ' ')")).withColumn("rest", F.expr("array_join(slice(words, cut + 1, size(words)), ' ')"))
    for side, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(parts.select("lang", F.col("part").alias(side), F.col("count").alias(name)), ["lang", side])
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "alr"}
    score = F.expr("cast(1000000 as decimal(7,0)) * (wa * wa) div (wl * wr)")
    cuts = cuts.select("*", *(x.alias(f"w{c}") for c, x in wide.items())).withColumn("score", score)
    scored = cuts.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    inner = "flatten(transform(sequence(2, size(words) - 1), k -> transform(sequence(1, size(words) - k + 1), i -> array_join(slice(words, i, k), ' '))))"
    longer = phrases.where("size(words) > 2").select("lang", F.explode(F.expr(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = scored.join(longer, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {share_percent} * a")
    return left.join(total, "lang").select("lang", "phrase", "words", "a", "best.cut", "best.l", "best.r", "n", "best.score")


def top_collocations(docs: DataFrame, top: int = TOP, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, share_percent: int = SHARE_PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top``, by score, count, phrase.

    A language's phrases are cut to the first ``top`` of some parts first, so its last
    ranking gets a bounded number of rows.
    """
    found = collocations(docs, max_words, min_count, share_percent).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_PARTS)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
lists AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
occurrences AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM lists, (VALUES (1), (2), (3)) AS t(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM occurrences GROUP BY ALL),
total AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
split AS MATERIALIZED (
  SELECT lang, k, phrase, a, cut, array_to_string(w[1:cut], ' ') AS first, array_to_string(w[cut + 1:k], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)),
cuts AS (
  SELECT s.lang, s.k, s.phrase, s.a, s.cut, x.a AS l, y.a AS r,
         CAST(1000000 * CAST(s.a AS HUGEINT) * s.a // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM split s
  JOIN f x ON x.lang = s.lang AND x.phrase = s.first
  JOIN f y ON y.lang = s.lang AND y.phrase = s.rest),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM candidates WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM candidates WHERE k = 3) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, l, r, n, score
FROM best b JOIN total t ON t.lang = b.lang LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a
QUALIFY rank <= 2000
"""
