"""Operator 3: hierarchical packing of documents into sequences of several context sizes.

Each partition tokenizes its documents and packs them in blocks, without a shuffle:

* Routing: a document longer than the longest context gives full sequences of it;
  what remains, like every shorter document, belongs to the tier with the smallest
  context that holds it.
* Tiers are packed from the longest context to the shortest. Each of a tier's
  pieces opens a sequence, whose gap takes the longest pieces of shorter tiers
  that fit, and at last the head of one that doesn't, so every sequence is full.
* What a block can't fill goes to the next block; at the end of a partition it is
  written as sequences whose lengths are powers of two, which need no padding.
* Step groups: the sequences of a block are dealt to groups of ``step_tokens``
  tokens, the costliest first, each to the group with the fewest tokens so far and
  among those the one with the least attention cost.

Partitions are cut by the input's files alone, so a task that is run again gives
the same sequences. Null and empty texts have the end id only; repeated rows are
documents of their own; a null doc_id is kept.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm import _bytes, _shared

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 8 * 2048
#: Tokens that are packed together.
BLOCK_TOKENS = 2_000_000
#: Parts of texts whose ids a worker remembers.
CACHED = 100_000

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, step_group long"


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine; paths stay as they are."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


#: Latin letters in lower case, as the tokenizer sees them; a text of others, or with what it treats apart, goes the plain way.
_LETTERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u024f"
_PARTS = re.compile(f"[{_LETTERS}]+|[^{_LETTERS} \t\n\r]+")
#: Capitals below U+0250 whose lower case isn't.
_FAR = "".join(c for c in map(chr, range(0x250)) if max(c.lower()) > "\u024f")
_APART = re.compile(f"['\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0\u00b2\u00b3\u00b9\u00bc-\u00be\u0250-\U0010ffff{_FAR}]|<\\|")


def _byte_letters() -> dict[int, str]:
    """The letter with which byte-level BPE writes each byte: printable ones as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Ids(dict):
    """Part of a text -> its ids as bytes of unsigned 32-bit numbers.

    The tokenizer lower-cases, drops white space, and cuts between letters and other
    characters before its merges, so the ids of a text are those of its parts: runs
    of letters and runs of others, or in texts with characters of ``_APART`` whatever
    stands between blanks. Only the parts that are new to a worker are encoded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces, self.letters = self.tokenizer.model.tokenize, _byte_letters()

    def __missing__(self, part: str) -> bytes:
        if part.isascii() and part.islower() and part.isalpha():
            ids = [t.id for t in self.pieces(part)]
        elif part.islower() and part.isalpha() and not _APART.search(part):
            ids = [t.id for t in self.pieces(part.encode().decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        found = self[part] = array("I", ids).tobytes()
        return found

    def of(self, texts: list[str], end_id: int) -> Iterator[np.ndarray]:
        """The ids of each text, and the end id."""
        if len(self) > CACHED:
            self.clear()
        end = array("I", [end_id]).tobytes()
        for t in texts:
            parts = t.replace("\n", " ").split(" ") if _APART.search(t) else _PARTS.findall(t.lower())
            yield np.frombuffer(b"".join(map(self.__getitem__, parts)) + end, np.uint32)


def pack_block(lengths: list[int], tiers: tuple[int, ...]) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """(sequences, rest): each sequence is a list of (document, start, length); the rest can fill none of ``tiers``."""
    longest = tiers[-1]
    sequences = []
    pool: list[tuple[int, int, int]] = []  # (length, document, start), sorted
    for d, n in enumerate(lengths):
        full = n - n % longest
        sequences += [[(d, s, longest)] for s in range(0, full, longest)]
        if n > full:
            pool.append((n - full, d, full))
    pool.sort()
    total = sum(p[0] for p in pool)
    for size in reversed(tiers):
        low = size // 2 if size > tiers[0] else 0
        while pool and pool[-1][0] > low and total >= size:
            n, d, s = pool.pop()
            if n > size:  # of a longer tier that had too few tokens for another sequence
                insort(pool, (n - size, d, s + size))
                n = size
            own, gap = [(d, s, n)], size - n
            while gap:
                i = bisect_right(pool, (gap, 1 << 62, 0)) - 1
                if i >= 0:
                    n, d, s = pool.pop(i)
                    own.append((d, s, n))
                    gap -= n
                else:
                    n, d, s = pool.pop(bisect_left(pool, (gap, -1, 0)))
                    own.append((d, s, gap))
                    insort(pool, (n - gap, d, s + gap))
                    gap = 0
            total -= size
            sequences.append(own)
    return sequences, [(d, s, n) for n, d, s in pool]


def power_sequences(rest: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The rest of a partition in sequences whose lengths are powers of two."""
    total, out = sum(n for _, _, n in rest), []
    pieces = list(reversed(rest))
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            own, gap = [], 1 << bit
            while gap:
                d, s, n = pieces.pop()
                if n > gap:
                    pieces.append((d, s + gap, n - gap))
                own.append((d, s, min(n, gap)))
                gap -= min(n, gap)
            out.append(own)
    return out


def step_groups(sequences: list[list[tuple[int, int, int]]], step_tokens: int) -> tuple[list[int], int]:
    """(group of each sequence, number of groups), balanced by tokens and by the sum of squared lengths."""
    cost = [(sum(n for _, _, n in s), sum(n * n for _, _, n in s)) for s in sequences]
    groups = max(1, -(-sum(t for t, _ in cost) // step_tokens))
    heap = [(0, 0, g) for g in range(groups)]
    out = [0] * len(sequences)
    for i in sorted(range(len(sequences)), key=lambda i: cost[i], reverse=True):
        tokens, work, g = heap[0]
        heapq.heapreplace(heap, (tokens + cost[i][0], work + cost[i][1], g))
        out[i] = g
    return out, groups


def _pack(tokenizer: str, tiers: tuple[int, ...], end_id: int, step_tokens: int):
    names = [c.split()[0] for c in _SCHEMA.split(", ")]

    def run(batches):
        path = tokenizer_path(tokenizer)
        kept = _shared.worker_cache("packing")
        ids_of = kept.get(path) or kept.setdefault(path, Ids(path))
        base = TaskContext.get().partitionId() << 36
        counted = {"sequence": base, "group": base}
        held: list[tuple[int | None, int, int, np.ndarray]] = []  # (doc_id, tokens of the document, start of the piece, ids)

        def written(sequences):
            group, groups = step_groups(sequences, step_tokens)
            rows = []
            for own, g in zip(sequences, group):
                at, length = 0, sum(n for _, _, n in own)
                for d, s, n in own:
                    doc_id, tokens, start, ids = held[d]
                    rows.append((doc_id, start + s, n, zlib.crc32(ids[s : s + n].astype("<u4").tobytes()), tokens, counted["sequence"], at, length, counted["group"] + g))
                    at += n
                counted["sequence"] += 1
            counted["group"] += groups
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

        def block(last: bool):
            nonlocal held
            sequences, rest = pack_block([len(h[3]) for h in held], tiers)
            if last:
                sequences, rest = sequences + power_sequences(rest), []
            out = [written(sequences)] if sequences else []
            held = [(held[d][0], held[d][1], held[d][2] + s, held[d][3][s : s + n].copy()) for d, s, n in rest]
            return out

        count = 0
        for batch in batches:
            for some in _bytes.slices(batch, 1, 1 << 20):
                texts = [t or "" for t in some.column(1).to_pylist()]
                for doc_id, ids in zip(some.column(0).to_pylist(), ids_of.of(texts, end_id)):
                    held.append((doc_id, len(ids), 0, ids))
                    count += len(ids)
                if count >= BLOCK_TOKENS:
                    yield from block(False)
                    count = sum(len(h[3]) for h in held)
        if held:
            yield from block(True)

    return _shared.lean("packing", run)


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece of each document, as the module says.

    ``start``: ids of the document before the piece; ``offset``: its place in the
    sequence; ``ids_crc32``: of its ids as little-endian unsigned 32-bit numbers;
    ``doc_tokens``: ids of the document with the end id; ``sequence_length``: of
    the whole sequence; ``tiers`` are powers of two, ascending.
    """
    if list(tiers) != sorted({t for t in tiers if t > 0 and t & (t - 1) == 0}) or not tiers:
        raise ValueError("tiers must be different powers of two, ascending")
    _shared.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(_pack(tokenizer, tuple(tiers), end_id, step_tokens), _SCHEMA)
