"""Session helpers of the training-data operators: shared tables, size checks, connected components."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.sources.shared import drop, shared_dir, small_batches, stage

__all__ = ["connected_components", "drop", "lean", "runs", "shared_dir", "small_batches", "small_side", "stage", "worker_cache"]

#: A side of a join is broadcast only when a count shows that it has at most so many (narrow) rows.
BROADCAST_ROWS = 200_000


_caches: dict[str, dict] = {}
_libc = None


def worker_cache(owner: str) -> dict:
    """What an operator keeps in a Python worker from task to task; workers outlive stages, so what others keep there goes."""
    for other in [k for k in _caches if k != owner]:
        del _caches[other]
    return _caches.setdefault(owner, {})


def _release() -> None:
    """Gives back to the system what this worker has freed; arrays of a MB and more are given back at once from the first call on."""
    global _libc
    pa.default_memory_pool().release_unused()
    if _libc is None:
        _libc = ctypes.CDLL(None)
        if hasattr(_libc, "mallopt"):
            _libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def lean(owner: str, run):
    """A task function that begins and ends without what other tasks of its worker have left."""

    def tidy(batches):
        worker_cache(owner)
        _release()
        try:
            yield from run(batches)
        finally:
            _release()

    return tidy


def small_side(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows; larger ones are left to a shuffled join."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


def runs(batches, columns: int):
    """Batches with one value of the first ``columns`` columns each, from batches that are sorted by these."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = [batch.column(i).to_numpy() for i in range(columns)]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in keys], axis=0)) + 1
        for start, end in zip(np.r_[0, cuts], np.r_[cuts, len(batch)]):
            piece = batch.slice(start, end - start)
            if held and [held[-1].column(i)[0] for i in range(columns)] != [piece.column(i)[0] for i in range(columns)]:
                yield _one(held)
                held = []
            held.append(piece)
    if held:
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (columns a, b; longs).

    Alternating large-star and small-star rounds: every round replaces the edges by
    an equivalent set that is closer to one star per component, so no round holds
    more rows than twice the edges. A hub's rows are aggregated before they are
    shuffled, and joined with one row, so AQE can split them. Rounds end when an edge set repeats.
    """
    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        before, edges = edges, stage(small.where("a <> b").distinct(), "edges")
        drop(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError("connected components did not settle")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
