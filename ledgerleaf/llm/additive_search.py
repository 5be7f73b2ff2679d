"""Operator 9: approximate nearest neighbours by additive quantisation.

A vector is encoded as a sum of codewords, one of each of ``BOOKS`` codebooks whose
words have the full dimension. Codebooks are fitted on a bounded sample by k-means on
residuals, then refined: the sample is encoded by beam search and all words are solved
anew by least squares. Every vector is encoded by beam search over the codebooks, with
the squared norm of its reconstruction stored beside the codes. A query's inner
products with all words make its lookup tables, so the distance to an encoded vector is
a sum of table entries and the stored norm. Of each block of vectors a shortlist by
this distance is ranked again by exact distance on the original vectors.

Queries and vectors are cut into blocks of a fixed size, and each pair of blocks is one
piece of work, so neither is ever held whole. Ties go to smaller vec_ids, in the
shortlist too. Vectors that are null or zero, hold null or non-finite components or
have another dimension than most take no part; of rows with one vec_id the least vector
does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.llm import _shared, _vectors

BOOKS, WORDS, BEAM = 16, 256, 6
#: Vectors that codebooks are fitted on: those with the smallest hashes of vec_id.
SAMPLE = 8_000
#: Vectors and queries of a block, and the candidates that it ranks again for each query.
BLOCK, QUERIES, SHORTLIST = 8_000, 1_000, 300
NEIGHBOURS = 10


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """(rows, books) codes: beam search over the codebooks in turn, keeping the best sums so far."""
    n = len(x)
    norms = (books**2).sum(axis=2)
    rest, codes, error = x[:, None, :], np.zeros((n, 1, 0), np.uint8), (x**2).sum(axis=1)[:, None]
    for b, book in enumerate(books):
        now = error[:, :, None] - 2 * (rest @ book.T) + norms[b]
        flat = now.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        from_path, word = best // len(book), best % len(book)
        error = np.take_along_axis(flat, best, axis=1)
        rest = np.take_along_axis(rest, from_path[:, :, None], axis=1) - book[word]
        codes = np.concatenate([np.take_along_axis(codes, from_path[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
    return codes[np.arange(n), error.argmin(axis=1)]


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(book[codes[:, b]] for b, book in enumerate(books))


def fit(x: np.ndarray, n_books: int = BOOKS, n_words: int = WORDS, rounds: int = 6, refinements: int = 1, seed: int = 7) -> np.ndarray:
    """(books, words, dimension) codebooks for the sample ``x``."""
    rng = np.random.Generator(np.random.PCG64(seed))
    n_words = max(1, min(n_words, len(x)))
    rest, books = x.copy(), []
    for _ in range(n_books):
        book = rest[rng.choice(len(rest), n_words, replace=False)]
        for _ in range(rounds):
            word = ((book**2).sum(axis=1) - 2 * rest @ book.T).argmin(axis=1)
            count = np.bincount(word, minlength=n_words)
            sums = np.zeros_like(book)
            np.add.at(sums, word, rest)
            book = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], rest[rng.choice(len(rest), n_words)])
        word = ((book**2).sum(axis=1) - 2 * rest @ book.T).argmin(axis=1)
        rest = rest - book[word]
        books.append(book)
    books = np.array(books)
    for _ in range(refinements):
        codes = np.concatenate([encode(x[k : k + 250], books) for k in range(0, len(x), 250)]).astype(np.int64) + np.arange(n_books) * n_words
        together = np.zeros((n_books * n_words,) * 2)
        target = np.zeros((n_books * n_words, x.shape[1]))
        for a in range(n_books):
            np.add.at(target, codes[:, a], x)
            for b in range(n_books):
                np.add.at(together, (codes[:, a], codes[:, b]), 1)
        together[np.diag_indices_from(together)] += 1e-2
        books = np.linalg.solve(together, target).reshape(books.shape)
    return books


def _encoded(books):
    def run(batches):
        for batch in batches:
            x = _vectors.matrix(batch.column(1))
            codes = np.concatenate([encode(x[k : k + 250], books.value) for k in range(0, len(x), 250)]) if len(x) else np.zeros((0, len(books.value)), np.uint8)
            norm = (decode(codes, books.value) ** 2).sum(axis=1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm)], ["vec_id", "embedding", "codes", "norm"])

    return run


def _shortlist(score: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` smallest of scores that are sorted by vec_id; of equal ones the first."""
    if size >= len(score):
        return np.arange(len(score))
    last = np.partition(score, size - 1)[size - 1]
    below = np.flatnonzero(score < last)
    return np.sort(np.r_[below, np.flatnonzero(score == last)[: size - len(below)]])


def _searched(books, neighbours: int, shortlist: int):
    """In: a block of queries and one of vectors; out: the nearest found of each query in the block."""

    def run(batches):
        words = books.value
        for batch in batches:
            for k in range(len(batch)):
                q, v = (batch.column(i)[k].values for i in (0, 1))
                order = np.argsort(v.field("vec_id").to_numpy(), kind="stable")
                ids, norm = v.field("vec_id").to_numpy()[order], v.field("norm").to_numpy()[order]
                x = _vectors.matrix(v.field("embedding"))[order]
                codes = np.frombuffer(b"".join(v.field("codes").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
                out: tuple[list, list, list] = ([], [], [])
                for query, own in zip(q.field("vec_id").to_pylist(), _vectors.matrix(q.field("embedding"))):
                    table = words @ own
                    score = norm.copy()
                    for b in range(len(words)):
                        score -= 2 * table[b][codes[:, b]]
                    near = _shortlist(score, shortlist + 1)
                    near = near[ids[near] != query]
                    exact = np.sqrt(((x[near] - own) ** 2).sum(axis=1))
                    best = np.lexsort((ids[near], exact))[:neighbours]
                    out[0].extend([query] * len(best))
                    out[1].extend(ids[near][best].tolist())
                    out[2].extend(exact[best].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def _sample(every: DataFrame, total: int, size: int) -> np.ndarray:
    """Those of the ``total`` vectors with the ``size`` smallest hashes of vec_id, in that order.

    A task would hand over its ``size`` smallest, which is all that it has where there are
    many tasks; so tasks leave out what is above a bound that few more than ``size`` meet.
    """
    hashed, share = F.xxhash64("vec_id"), (size + 6 * size**0.5) / max(1, total)
    while True:
        low = every if share >= 1 else every.where(hashed < int(share * 2**64) - 2**63)
        drawn = low.orderBy(hashed, "vec_id").limit(size).toPandas()["embedding"]
        if len(drawn) >= size or share >= 1:
            return np.array(drawn.to_list(), np.float64)
        share *= 2


def nearest(vectors: DataFrame, is_query: Column, neighbours: int = NEIGHBOURS, sample: int = SAMPLE, shortlist: int = SHORTLIST) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found by Euclidean distance of each vector that ``is_query`` holds for."""
    spark = vectors.sparkSession
    every = _vectors.one_each(vectors)
    lengths = every.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    every = every.where(F.size("embedding") == (lengths[0]["d"] if lengths else 0))
    drawn = _sample(every, lengths[0]["count"] if lengths else 0, sample)
    books = spark.sparkContext.broadcast(fit(drawn) if len(drawn) else np.zeros((BOOKS, 1, 1)))
    encoded = _shared.stage(every.mapInArrow(_encoded(books), "vec_id long, embedding array<double>, codes binary, norm double"), "codes")
    total = encoded.count()
    queries = encoded.where(is_query).select("vec_id", "embedding")
    n_blocks, n_query_blocks = max(1, -(-total // BLOCK)), max(1, -(-queries.count() // QUERIES))

    def blocked(rows: DataFrame, n: int, name: str) -> DataFrame:
        return rows.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias(name)).agg(F.collect_list(F.struct(*rows.columns)).alias(f"{name}s"))

    asked = blocked(queries, n_query_blocks, "query").select("querys", F.expr(f"explode(sequence(0L, {n_blocks - 1}L))").alias("block"))
    # Spark takes rows that are exploded for no more than they were before, and would broadcast all of them through the driver
    pairs = asked.hint("merge").join(blocked(encoded, n_blocks, "block"), "block").select("querys", "blocks")
    found = pairs.repartition(max(1, min(n_blocks * n_query_blocks, 10_000))).mapInArrow(_searched(books, neighbours, shortlist), "query_id long, vec_id long, score double")
    first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")
