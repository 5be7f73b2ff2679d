"""Operator 10: n-gram Jaccard self-join by prefix filters under several global token orders.

A document's set holds its distinct k-word shingles. If two sets reach the
threshold, then under any global order of the shingles their first few shingles
(the prefix, whose length follows from the sizes and the threshold) share one. A
candidate must share prefix shingles under each of ``ORDERS`` different orders; these
filters are intersected on the prefixes alone, before any text is moved.
All orders put frequent shingles last, by powers of two of their document frequency:
of shingles that tasks report as frequent their count, and of all others what the
frequencies of their words make likely. So chance repetitions of common words are
hardly met at all, and the shared text of a large group of copies only by documents
that differ from it little. Within a class each order has its own hash.

Groups of copies never become all pairs. Equal sets are one node. Each bucket
(documents with one prefix shingle of the first order) first compares its members with
the member that holds the shingle earliest. Members that are still in different
components are then compared in blocks of ``PART``, within tasks: what is left of them
after the filters by position, size and bitmap (the parities of hash classes of a set,
of which two sets can differ in no more than the shingles that they don't share) are the
candidates. Of a bucket's largest component no two blocks meet. Verification
compares whole shingle sets, so no component is lost; links within a component that is
already connected are not searched.

Null or blank texts have no shingles and link with nothing; texts with fewer words
than k have their whole sequence as one shingle. Rows with a null doc_id keep their
size and have no component. Repeated rows fall in one component, and rows that share a
doc_id are told apart by their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm import _bytes, _shared, _words

WORDS, PERCENT = 5, 80
ORDERS = 3
#: Shingles a task counts together; the count from which it reports one, and the share of words from which it reports a word.
COUNTED, FREQUENT, COMMON = 1_000_000, 4, 1 / 500_000
#: At most so many shingles and words, the most frequent ones, shape the orders; any order is a right one.
LISTED, LISTED_WORDS = 1_000_000, 200_000
#: Least and most bits of a set's bitmap, which has half as many as the set at least; members of a bucket that are compared at once; pairs that a task holds.
BITS, MOST_BITS, PART, HELD = 256, 2_048, 500, 300_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
#: Logarithms are whole numbers of this fraction, so that sums of them don't depend on where they begin.
_FINE = 1024


def _sets(batch: pa.RecordBatch, k: int, column: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(shingles, where each stands first, words) of each document."""
    for some in _bytes.slices(batch, column, 1 << 19):
        words, first = _words.word_hashes(some.column(column))
        for i in range(len(some)):
            own = words[first[i] : first[i + 1]]
            yield *_words.shingles(own, k), own


def _digest(s: np.ndarray) -> int:
    """64-bit digest of a set."""
    if not len(s):
        return 0
    both = np.array([s.sum(dtype=np.uint64), _bytes.mix(s ^ _ODD[1]).sum(dtype=np.uint64)], dtype=np.uint64)
    return int(_bytes.mix(both[:1] * _ODD[0] + both[1:] * _ODD[2] + np.uint64(len(s))).view(np.int64)[0])


def _bitmap(s: np.ndarray) -> bytes:
    """For each class of shingles by hash whether the set holds an odd number of them."""
    bits = BITS
    while bits < MOST_BITS and 2 * bits < len(s):
        bits *= 2
    return np.packbits(np.bincount((_bytes.mix(s * _ODD[4]) % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def _differing(bitmaps: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits the bitmaps of each pair differ; the longer is folded to the shorter's length, as parities add up."""
    sizes = np.array([len(b) for b in bitmaps])
    short, out = np.minimum(sizes[i], sizes[j]), np.zeros(len(i), np.int64)
    for size in np.unique(short):
        folded = np.zeros((len(sizes), size // 8), np.uint64)
        for own in np.unique(sizes[sizes >= size]):
            which = np.flatnonzero(sizes == own)
            whole = np.frombuffer(b"".join(bitmaps[k] for k in which), np.uint64).reshape(len(which), own // size, -1)
            folded[which] = np.bitwise_xor.reduce(whole, axis=1)
        some = np.flatnonzero(short == size)
        for c in range(size // 8):
            out[some] += np.bitwise_count(folded[i[some], c] ^ folded[j[some], c])
    return out


def _sized(k: int):
    """Rows (0, doc, sid, n, h) per document, and (1, token, df) and (2, word, count) of frequent shingles and words."""

    def rows(kind, *cols):
        none = pa.nulls(len(cols[0]), pa.int64())
        full = [*(c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in cols), none, none][:4]
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(none), pa.int32()), *full], ["kind", "a", "b", "c", "d"])

    def counted(kind, parts, least):
        every = np.concatenate(parts)
        parts.clear()  # and sorted in place: a worker's memory counts beside the executor's heap
        every.sort()
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        n = np.diff(first, append=len(every))
        some = n >= least
        return rows(kind, every[first[some]].view(np.int64), n[some])

    def run(batches):
        parts, words, held = [], [], 0
        for batch in batches:
            sids, sizes = [], []
            for s, _, own in _sets(batch, k):
                sids.append(_digest(s))
                sizes.append(len(s))
                parts.append(s)
                words.append(own.copy())  # not a view that keeps the whole batch
                held += len(own)
                if held >= COUNTED:
                    yield counted(1, parts, FREQUENT)
                    yield counted(2, words, max(FREQUENT, COMMON * held))
                    parts, words, held = [], [], 0
            yield rows(0, batch.column(0), sids, sizes, batch.column(2))
        if held:
            yield counted(1, parts, FREQUENT)
            yield counted(2, words, max(FREQUENT, COMMON * held))

    return _shared.lean("ngrams", run)


def _listed(sized: DataFrame, kind: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of the most frequent shingles or words that tasks reported."""
    top = sized.where(F.col("kind") == kind).groupBy(F.col("a").alias("token")).agg(F.sum("b").alias("n")).orderBy(F.desc("n"), "token").limit(most).toPandas()
    token, n = top["token"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.float64)
    order = np.argsort(token)
    return token[order], n[order]


def _fine(x) -> np.ndarray:
    return np.rint(_FINE * np.log2(x)).astype(np.int64)


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: int) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), other)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other)


class Frequencies:
    """The class of a shingle: about the logarithm of the number of documents with it."""

    def __init__(self, shingles, words, total: int):
        self.shingles, self.words = (shingles[0], _fine(shingles[1])), (words[0], _fine(words[1] / max(total, 1)))
        self.total, self.rare = int(_fine(max(total, 1))), int(_fine(COMMON / 2))

    def classes(self, s: np.ndarray, first: np.ndarray, words: np.ndarray, k: int) -> np.ndarray:
        share = np.r_[0, np.cumsum(_looked_up(*self.words, words, self.rare))]
        likely = self.total + share[np.minimum(first + k, len(words))] - share[first]
        return np.clip(np.maximum(likely, _looked_up(*self.shingles, s, -99 * _FINE)) // _FINE + 30, 0, 63).astype(np.uint64)

    def prefixes(self, s: np.ndarray, first: np.ndarray, words: np.ndarray, k: int, length: int) -> list[np.ndarray]:
        """The first ``length`` shingles in each of the orders."""
        top, out = self.classes(s, first, words, k) << np.uint64(58), []
        for order in range(ORDERS):
            key = top | _bytes.mix(s * _ODD[order]) >> np.uint64(6)
            some = np.argpartition(key, length - 1)[:length] if length < len(s) else np.arange(len(s))
            out.append(s[some[np.argsort(key[some], kind="stable")]])
        return out


def _prefixes(k: int, percent: int, shared):
    """(sid, n, bits, p0, p1, ...): the prefixes of each set, where the task meets it first; but for p0 32 bits of each shingle."""
    names = ["sid", "n", "bits", *(f"p{o}" for o in range(ORDERS))]

    def lists(parts, kind):
        ends = np.r_[0, np.cumsum([len(x) for x in parts])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else [], kind))

    def run(batches):
        frequencies = shared.value
        met: set[int] = set()  # grows with the task's own rows alone
        for batch in batches:
            sids, sizes, bits, prefixes = [], [], [], []
            for s, first, own in _sets(batch, k, 0):
                sid = _digest(s)
                if not len(s) or sid in met:
                    continue
                met.add(sid)
                sids.append(sid)
                sizes.append(len(s))
                bits.append(_bitmap(s))
                p0, *more = frequencies.prefixes(s, first, own, k, len(s) - (percent * len(s) + 99) // 100 + 1)
                prefixes.append([p0.view(np.int64), *((p & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32) for p in more)])
            own = list(zip(*prefixes)) or [()] * ORDERS
            cols = [lists(own[0], pa.int64()), *(lists(p, pa.int32()) for p in own[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), *cols], names)

    return _shared.lean("ngrams", run)


def _compared(percent: int):
    """In, sorted by token, a, b: token, a, b, part, sid, at, component, bits; out: pairs that pass position, size and bitmap."""

    def group(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        a, b = rows.column(1)[0].as_py(), rows.column(2)[0].as_py()
        part, sid, at, component = (rows.column(i).to_numpy() for i in range(3, 7))
        rank, n = at >> 32, at & 0xFFFFFFFF
        x, y = np.flatnonzero(part == a), np.flatnonzero(part == b)
        m = n[x][:, None], n[y][None, :]
        need = -(-percent * (m[0] + m[1]) // (100 + percent))
        possible = (component[x][:, None] != component[y][None, :]) & ((n - rank)[x][:, None] >= need) & ((n - rank)[y][None, :] >= need) & (100 * np.minimum(*m) >= percent * np.maximum(*m))
        i, j = np.nonzero(possible)
        need, i, j = need[i, j], x[i], y[j]
        if a == b:
            need, i, j = need[i < j], i[i < j], j[i < j]
        some = _differing(rows.column(7).to_pylist(), i, j) <= n[i] + n[j] - 2 * need
        return sid[i[some]], sid[j[some]]

    def distinct(parts):
        a, b = (np.concatenate(x) for x in zip(*parts))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches):
        parts, held = [], 0
        for rows in _shared.runs(batches, 3):
            if len(rows) > 1:
                parts.append(group(rows))
                held += len(parts[-1][0])
                if held > HELD:  # pairs that share many shingles come from many buckets
                    yield distinct(parts)
                    parts, held = [], 0
        if held:
            yield distinct(parts)

    return _shared.lean("ngrams", run)


def _verified(k: int, percent: int):
    """In: a, text_a, b, text_b; out: the pairs that reach the threshold."""

    def run(batches):
        for whole in batches:
            for batch in _bytes.slices(whole, 1):
                sets: dict[int, np.ndarray] = {}
                for i in (0, 2):
                    new = {x: j for j, x in enumerate(batch.column(i).to_pylist()) if x not in sets}
                    some = pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), batch.column(i + 1).take(pa.array(list(new.values()), pa.int64()))], ["id", "text"])
                    sets |= {x: s for x, (s, _, _) in zip(new, _sets(some, k))}
                a, b = [], []
                for x, y in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                        a.append(x)
                        b.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _shared.lean("ngrams", run)


def _text_hash():
    return F.xxhash64("text").alias("h")


def similar_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """(documents, links): (doc, h, sid, n) of each document, where h hashes its text, and verified links (a, b) between sids.

    The links connect what belongs together; further ones between members of one
    component are not listed.
    """
    _shared.small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text", _text_hash())
    sized = _shared.stage(texts.mapInArrow(_sized(words), "kind int, a long, b long, c long, d long"), "sized")
    documents = sized.where("kind = 0").select(F.col("a").alias("doc"), F.col("d").alias("h"), F.col("b").alias("sid"), F.col("c").alias("n"))
    total = documents.agg(F.sum("n")).first()[0] or 0
    frequent = docs.sparkSession.sparkContext.broadcast(Frequencies(_listed(sized, 1, LISTED), _listed(sized, 2, LISTED_WORDS), total))

    schema = "sid long, n long, bits binary, p0 array<long>" + "".join(f", p{o} array<int>" for o in range(1, ORDERS))
    prefixes = _shared.stage(texts.where("doc is not null").select("text").mapInArrow(_prefixes(words, percent, frequent), schema), "prefixes")
    entries = prefixes.select("sid", "n", F.posexplode("p0").alias("rank", "token")).select("token", "sid", F.expr("shiftleft(cast(rank as bigint), 32) + n").alias("at"))
    met = entries.groupBy("token").agg(F.min("sid").alias("least"), F.max("sid").alias("most"), F.count("*").alias("members"))
    live = _shared.stage(entries.join(met.where("least < most").select("token", "members"), "token"), "buckets")

    def needed(n1, n2):  # shared shingles without which two sets can't reach the threshold
        return f"cast(ceil({percent} * ({n1} + {n2}) / {100 + percent}) as int)"

    def possible(r1, n1, r2, n2):  # shared tokens that the sizes ask for, of those from the common one on
        return F.expr(f"{n1} - {r1} >= {needed(n1, n2)} and {n2} - {r2} >= {needed(n1, n2)} and 100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2})")

    rep = documents.where("doc is not null and n > 0").groupBy("sid").agg(F.min(F.struct("doc", "h")).alias("rep")).select("sid", "rep.*")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = _shared.stage(pairs.distinct(), f"{name}-pairs")
        for o in range(1, ORDERS):  # the filters of the other orders
            own = prefixes.join(_shared.small_side(_sids(pairs)), "sid", "left_semi").select("sid", "n", f"p{o}").dropDuplicates(["sid"])
            both = pairs
            for side in "ab":
                both = both.join(own.select(F.col("sid").alias(side), F.col("n").alias(f"n_{side}"), F.col(f"p{o}").alias(f"p_{side}")), side)
            need = needed("n_a", "n_b")
            left = both.where(F.expr(f"arrays_overlap(slice(p_a, 1, cast(n_a as int) - {need} + 1), slice(p_b, 1, cast(n_b as int) - {need} + 1))")).select("a", "b")
            before, pairs = pairs, _shared.stage(left, f"{name}-pairs")
            _shared.drop(before)
        wanted = rep.join(_shared.small_side(_sids(pairs)), "sid")
        text = _shared.stage(texts.join(_shared.small_side(wanted), ["doc", "h"]).select("sid", "text").dropDuplicates(["sid"]), f"{name}-texts")
        both = pairs
        for side in "ab":
            both = both.join(text.select(F.col("sid").alias(side), F.col("text").alias(f"text_{side}")), side)
        links = _shared.stage(both.select("a", "text_a", "b", "text_b").mapInArrow(_verified(words, percent), "a long, b long"), f"{name}-links")
        _shared.drop(pairs, text)
        return links

    rank, n = (lambda at: f"shiftright({at}, 32)"), (lambda at: f"({at} & 4294967295)")
    rank, n = (lambda at: f"shiftright({at}, 32)"), (lambda at: f"({at} & 4294967295)")
    heads = live.groupBy("token").agg(F.min(F.struct("at", "sid")).alias("first"))
    star = live.join(heads, "token").where("sid <> first.sid").where(possible(rank("at"), n("at"), rank("first.at"), n("first.at")))
    links = verified(star.select(F.least("sid", "first.sid").alias("a"), F.greatest("sid", "first.sid").alias("b")), "star")

    component = _shared.connected_components(links)
    known = prefixes.select("sid", "bits").dropDuplicates(["sid"]).join(component, F.col("sid") == F.col("node"), "left").select("sid", "bits", F.coalesce("component", "sid").alias("component"))
    joined = live.join(known, "sid").select("token", "sid", "at", "component", "bits", "members")
    whole = joined.where(F.col("members") <= part).select("token", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("part"), "sid", "at", "component", "bits")
    # of a bucket of several parts those of the largest component are few, few + 1, ...; no two of these meet
    large = joined.where(F.col("members") > part)
    sizes = large.groupBy("token", "component").agg(F.count("*").alias("m")).groupBy("token").agg(F.sum("m").alias("members"), F.max(F.struct("m", "component")).alias("big"))
    sizes = sizes.where("members > big.m").select("token", F.col("big.component").alias("big"), F.expr(f"cast(ceil((members - big.m) / {part}) as int)").alias("few"), F.expr(f"cast(ceil(big.m / {part}) as int)").alias("many"))
    parts = large.drop("members").join(sizes, "token").withColumn("part", F.expr("cast(if(component = big, few + pmod(xxhash64(sid), many), pmod(xxhash64(sid), few)) as int)"))
    parts = parts.withColumn("other", F.explode(F.expr("sequence(0, if(component = big, few, few + many) - 1)")))
    blocks = whole.unionByName(parts.select("token", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "sid", "at", "component", "bits"))
    found = blocks.repartition("token", "a", "b").sortWithinPartitions("token", "a", "b").mapInArrow(_compared(percent), "a long, b long")
    more = verified(found, "rest")
    _shared.drop(prefixes, live)
    return documents, links.unionByName(more)


def _sids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()


def classed(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc, h (hash of its text), n (size of its set), least_doc and least_h of its component.

    The least are null for rows that link with nothing by definition: those without
    words, or without doc_id.
    """
    documents, links = similar_sets(docs, words, percent)
    component = _shared.connected_components(links)
    # one row per set meets its component; the documents of a set that has many copies are joined once more, by its sid
    sets = documents.where("doc is not null and n > 0").groupBy("sid").agg(F.min(F.struct("doc", "h")).alias("least"))
    sets = sets.join(component, sets.sid == component.node, "left").select("sid", "least", F.coalesce("component", "sid").alias("component"))
    least = sets.groupBy("component").agg(F.min("least").alias("first"))
    found = sets.join(least, "component").select("sid", "first")
    out = documents.join(found, "sid", "left")
    linked = F.expr("doc is not null and n > 0")
    return out.select("doc", "h", "n", F.when(linked, F.col("first.doc")).alias("least_doc"), F.when(linked, F.col("first.h")).alias("least_h"))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    return classed(docs, words, percent).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least_doc", "doc").alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Of each group of similar documents of ``docs`` the row with the smallest doc_id, of several the one with the smallest hash of its text.

    Decisions are made row by row: rows that share a doc_id but not their text are
    documents of their own. Of rows with equal doc_id and text the least one by all
    columns stays (so they must have an order: no maps). Rows without doc_id, and texts
    without words, stay.
    """
    rows = _shared.stage(classed(docs, words, percent), "classed")
    gone = rows.where("doc <> least_doc or h <> least_h").select("doc", "h").distinct()
    again = rows.where("doc is not null and n > 0").groupBy("doc", "h").count().where("count > 1").select("doc", "h")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc"), _text_hash(), F.struct(*(F.col(c) for c in docs.columns)).alias("row"))
    kept = keyed.join(_shared.small_side(gone), ["doc", "h"], "left_anti")
    repeats = _shared.small_side(again)
    once = kept.join(repeats, ["doc", "h"], "left_semi").groupBy("doc", "h").agg(F.min("row").alias("row"))
    return kept.join(repeats, ["doc", "h"], "left_anti").select("row.*").unionByName(once.select("row.*"))
