"""Operator 6: language-model scoring by cross-entropy difference.

Two word bigram models that differ in nothing but their counts - of a target sample
and of the whole corpus - share one vocabulary, every word of all documents and the end
of a document. A word's share is ``(count + 1) / (all + size of the vocabulary)``, and
after a given word ``(count of both + PRIOR * share) / (count of that word + PRIOR)``. A
document is scored by the counts of the others: its own are taken off first, so a word
that it alone has is unseen, and a copy elsewhere shows. Each token, and the document's
end, has a loss, the negative log-probability, under both models; the score is the mean
of background loss minus target loss, so documents like the target score high.

The counts are over all documents and all of the target sample, which is every document
labelled with quality 1, and nothing of them is gathered: texts are cut into blocks,
each block sends its own words and bigrams, once each with their counts, to buckets by
hash, the buckets add them up and answer each block in the order of its asking. Blocks and
buckets are of bounded size and grow in number with the corpus; as every block counts
before it sends, a frequent word reaches its bucket once from each block.

Words are 64-bit hashes of runs of non-blanks with A-Z lower-cased; 40 bits of a bigram's
hash and its bucket tell it from others. Null and blank texts have no tokens, no losses
and score 0; with no target sample the target model knows no more than the vocabulary.
Repeated rows count each time, see each other and are scored alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm import _bytes, _shared, _words

#: How many tokens a word's share counts for, beside those that follow a given word.
PRIOR = 4.0
#: Bytes of text in a block, and for which there is one bucket.
BLOCK = 8 << 20
#: Tokens that are scored together.
EVENTS = 200_000
#: Stand for the start of a document, its end, and no word before.
START, END, ANY = (np.uint64(i) for i in (1, 2, 3))
_SUMS = "bucket int, block long, kind int, low binary, high binary, sums binary"
_NAMES = [c.split()[0] for c in _SUMS.split(", ")]
WORD, BIGRAM, SIZE = range(3)


def losses(pair: np.ndarray, word: np.ndarray, before: np.ndarray, every, size) -> np.ndarray:
    """Negative log-probabilities from counts of bigrams, of their words, of the words before, of all tokens, and the vocabulary's size."""
    return -np.log((pair + PRIOR * (word + 1) / (every + size)) / (before + PRIOR))


def _key(before, word: np.ndarray) -> np.ndarray:
    return _bytes.mix(before * np.uint64(0x9E3779B97F4A7C15) + word)


def _events(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word before, word or END, document) of every token and end of a document with words."""
    word, first = _words.word_hashes(texts)
    sizes = np.diff(first)
    some = np.flatnonzero(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes + (sizes > 0))
    ends = np.cumsum(sizes[some] + 1) - 1
    after = np.full(len(doc), END)
    after[np.setdiff1d(np.arange(len(doc)), ends, assume_unique=True)] = word
    before = np.r_[START, after[:-1]][: len(doc)]
    before[before == END] = START
    return before, after, doc


def _dealt(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's part of sorted keys starts, and the end."""
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))


def _packed(sums: np.ndarray) -> bytes:
    """The sums in the narrowest whole numbers that hold them, after the width of these."""
    kind = np.min_scalar_type(sums.max(initial=0))
    return bytes([kind.itemsize]) + sums.astype(kind).tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).reshape(width, -1).astype(np.int64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 3))], _NAMES)


def _blocks(batches):
    """In: doc_id, text, target; adds the block."""
    block, held = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)
        at = held + np.cumsum(size)
        held = int(at[-1]) if len(at) else held
        yield pa.RecordBatch.from_arrays([pa.array(block + at // BLOCK), *batch.columns, pa.array(size)], ["block", "doc_id", "text", "target", "size"])


def _asked(buckets: int):
    """In: block, text, target; out: each block's words and bigrams, with their counts in all and in target documents."""

    def run(batches):
        for part in _shared.runs(batches, 1):
            block = part.column(0)[0].as_py()
            before, word, doc = _events(part.column(1))
            target = part.column(2).to_numpy(zero_copy_only=False)[doc].astype(np.float64)
            for kind, key in ((WORD, _key(ANY, word)), (BIGRAM, _key(before, word))):
                key, which, n = np.unique(key, return_inverse=True, return_counts=True)
                sums = np.array([n, np.bincount(which, target, len(key))]).astype(np.int64)
                at, low, high = _dealt(key, buckets), key.astype(np.uint32), (key >> np.uint64(32)).astype(np.uint8)
                yield _batch([(b, block, kind, low[i:j].tobytes(), high[i:j].tobytes(), _packed(sums[:, i:j])) for b, (i, j) in enumerate(zip(at, at[1:])) if i < j])

    return run


def _added(table: pa.Table) -> pa.Table:
    """Of one bucket: the sums in the order in which each block asked, and the number of its words (block -1)."""
    out = []
    for kind in (WORD, BIGRAM):
        rows = table.filter(pc.equal(table["kind"], kind)).to_pylist()
        if not rows:
            continue
        bucket = rows[0]["bucket"]
        key = np.concatenate([np.frombuffer(r["high"], np.uint8).astype(np.uint64) << np.uint64(32) | np.frombuffer(r["low"], np.uint32) for r in rows])
        sums = np.concatenate([_unpacked(r["sums"], 2) for r in rows], axis=1)
        found, which = np.unique(key, return_inverse=True)
        sums = np.array([np.bincount(which, s, len(found)) for s in sums]).astype(np.int64)
        at = np.r_[0, np.cumsum([len(r["high"]) for r in rows])]
        out += [(bucket, r["block"], kind, b"", b"", _packed(sums[:, which[i:j]])) for r, i, j in zip(rows, at, at[1:])]
        if kind == WORD:
            out.append((bucket, -1, SIZE, b"", b"", np.array([len(found), *sums.sum(axis=1)]).astype("<i8").tobytes()))
    return pa.Table.from_batches([_batch(out)])


def _in_order(answers: pa.Table, kind: int) -> np.ndarray:
    """The sums for a block's sorted keys of a kind."""
    rows = sorted(answers.filter(pc.equal(answers["kind"], kind)).select(["bucket", "sums"]).to_pylist(), key=lambda r: r["bucket"])
    return np.concatenate([np.zeros((2, 0), np.int64), *(_unpacked(r["sums"], 2) for r in rows)], axis=1)


def _own(doc: np.ndarray, key: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """How often each asked key stands among its document's; all do."""
    width = int(key.max(initial=0)) + 1
    mine, n = np.unique(doc * width + key, return_counts=True)
    return n[np.searchsorted(mine, doc * width + asked)]


def _scored(size: int, every: tuple[int, int]):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        """Losses and score of the documents of one block."""
        text = texts["text"].combine_chunks()
        before, word, doc = _events(text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.string()))
        target = texts["target"].to_numpy()[doc].astype(np.int64)
        events = np.bincount(doc, minlength=len(texts))
        asked = np.unique(_key(ANY, word)), np.unique(_key(before, word))
        sums = [_in_order(answers, kind) for kind in (WORD, BIGRAM)]
        found = np.zeros((2, len(texts)))
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        low = 0
        while low < len(texts):  # some documents at a time
            high = max(low + 1, int(np.searchsorted(first, first[low] + EVENTS, "right")) - 1)
            i, j = first[low], first[high]
            b, w, d = before[i:j], word[i:j], doc[i:j] - low
            # END's count stands for START's too: both come once in each document with words
            at_word, at_before = (np.searchsorted(asked[0], _key(ANY, x)) for x in (w, np.where(b == START, END, b)))
            at_pair = np.searchsorted(asked[1], _key(b, w))
            own_pair, own_word, own_before = _own(d, at_pair, at_pair), _own(d, at_word, at_word), _own(d, at_word, at_before)
            for model, takes_own in enumerate((1, target[i:j])):
                pair, alone, context = sums[1][model][at_pair] - own_pair * takes_own, sums[0][model][at_word] - own_word * takes_own, sums[0][model][at_before] - own_before * takes_own
                loss = losses(pair, alone, context, every[model] - events[doc[i:j]] * takes_own, size)
                found[model, low:high] = np.bincount(d, loss, high - low) / np.maximum(events[low:high], 1)
            low = high
        b, t = found
        none = events == 0
        names = ["doc_id", "n_tokens", "target_loss", "background_loss", "score"]
        return pa.table([texts["doc_id"], pa.array(np.maximum(events - 1, 0), pa.int64()), pa.array(t, mask=none), pa.array(b, mask=none), pa.array(b - t)], names)

    return run


def target_sample(labels: DataFrame) -> DataFrame:
    """doc_id of all labelled rows with quality 1."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    return good.select(F.col("doc_id").cast("long").alias("doc_id"))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, target_loss, background_loss, score."""
    _shared.small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = _shared.small_side(target_sample(labels).withColumn("target", F.lit(True)))
    marked = texts.join(sample, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    texts = _shared.stage(marked.mapInArrow(_blocks, "block long, doc_id long, text string, target boolean, size long"), "lm-texts")
    buckets = int(texts.agg(F.sum("size")).first()[0] or 0) // BLOCK + 1
    asked = texts.select("block", "text", "target").mapInArrow(_asked(buckets), _SUMS)
    sums = _shared.stage(asked.groupBy("bucket").applyInArrow(_added, _SUMS), "lm-sums")
    sizes = [np.frombuffer(r["sums"], "<i8") for r in sums.where("block < 0").select("sums").collect()]  # one row of each bucket
    size, *every = (int(n) for n in np.sum([np.zeros(3, np.int64), *sizes], axis=0))
    schema = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
    blocks = texts.select("block", "doc_id", "text", "target").groupBy("block").cogroup(sums.where("block >= 0").groupBy("block"))
    return blocks.applyInArrow(_scored(size, tuple(every)), schema)
