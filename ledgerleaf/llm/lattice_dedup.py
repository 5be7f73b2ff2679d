"""Operator 5: near-duplicate vectors by E8 lattice hashing.

In each of ``TABLES`` tables a random projection maps unit vectors to ``BLOCKS``
times eight dimensions, and each eight are decoded to the nearest point of the E8
lattice: the better of the nearest points of D8 and of D8 shifted by a half. A vector
enters the cell of its lattice points and those of the neighbouring points (by the
240 minimal vectors) that are nearest next, so vectors on two sides of a border still
meet. Vectors in one cell are compared by cosine in double precision.

Equal vectors are one node that counts as often as it occurs. A cell with more than
``PART`` members is cut into parts and each pair of parts is a task's piece of work, so
a large group of near copies is spread and never listed pair by pair: a task returns a
count of links and a local component for each member. A pair that shares several cells
counts in the one with the smallest key alone.

Vectors that are null or zero or hold null or non-finite components link with nothing,
nor do vectors of different dimensions; rows with a null vec_id have no component.
Rows with one vec_id are one vector, the least of them.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm import _bytes, _shared, _vectors

COSINE = 0.9
TABLES, BLOCKS, CELLS, SCALE = 12, 2, 2, 0.5
#: Members of a cell that are compared at once.
PART = 2_000


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    return np.array(out + [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if np.prod(s) > 0])


MINIMAL = _minimal_vectors()


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Integers with an even sum: round, and where the sum is odd round the worst coordinate the other way."""
    f = np.round(x)
    off = x - f
    rows, worst = np.arange(len(x)), np.abs(off).argmax(axis=1)
    other = f.copy()
    other[rows, worst] += np.where(off[rows, worst] >= 0, 1, -1)
    return np.where((f.sum(axis=1) % 2 != 0)[:, None], other, f)


def nearest_e8(x: np.ndarray) -> np.ndarray:
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def cells(x: np.ndarray, n: int) -> np.ndarray:
    """(rows, n, 8): the nearest lattice point and its n - 1 neighbours that are nearest to x."""
    home = nearest_e8(x)
    if n == 1:
        return home[:, None]
    near = np.argsort(-((x - home) @ MINIMAL.T), axis=1, kind="stable")[:, : n - 1]
    return np.concatenate([home[:, None], home[:, None] + MINIMAL[near]], axis=1)


def hash_keys(unit: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, n_cells: int = CELLS, scale: float = SCALE) -> np.ndarray:
    """(rows, tables * n_cells ** blocks): 64-bit keys of the cells that each vector enters."""
    d, out = unit.shape[1], []
    for t in range(tables):
        key = np.full((len(unit), 1), t * 1_000_003 + d, np.uint64)
        for b in range(blocks):
            projection = np.random.Generator(np.random.PCG64([d, t, b])).normal(size=(d, 8)) * scale
            points = np.round(2 * cells(unit @ projection, n_cells)).astype(np.int64).view(np.uint64)
            own = np.zeros(points.shape[:2], np.uint64)
            for k in range(8):
                own = _bytes.mix(own * np.uint64(31) + points[:, :, k])
            key = _bytes.mix(key[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + own[:, None, :]).reshape(len(unit), -1)
        out.append(key)
    return np.sort(np.concatenate(out, axis=1).view(np.int64), axis=1)


def _hashed(options: dict):
    def run(batches):
        for batch in batches:
            for rows, x in _vectors.by_dimension(batch.column(1)):
                keys = hash_keys(x / np.linalg.norm(x, axis=1, keepdims=True), **options)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists], ["rep", "keys"])

    return run


def _met(keys: np.ndarray, key: int, x: np.ndarray, y: np.ndarray, width: int = 2_000) -> np.ndarray:
    """Of each pair of rows from ``x`` and ``y`` whether both hold one more key below ``key``: products of incidence matrices, some keys at a time."""
    row, col = np.nonzero(keys < key)
    _, which, n = np.unique(keys[row, col], return_inverse=True, return_counts=True)
    place = np.cumsum(n > 1) - 1  # keys of several members
    row, which = row[n[which] > 1], place[which[n[which] > 1]]
    met = np.zeros((len(x), len(y)), bool)
    for k in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        some = (which >= k) & (which < k + width)
        holds = np.zeros((len(keys), width), np.float32)
        holds[row[some], which[some] - k] = 1
        met |= holds[x] @ holds[y].T > 0
    return met


def _linked(cosine: float):
    """In, sorted by key, a, b: key, a, b, part, rep, copies, embedding, keys; out: (rep, links, other) of linked members."""

    def group(rows: pa.RecordBatch):
        key, a, b = (rows.column(i)[0].as_py() for i in range(3))
        part, rep, copies = (rows.column(i).to_numpy() for i in (3, 4, 5))
        unit = _vectors.matrix(rows.column(6))
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        x, y = np.flatnonzero(part == a), np.flatnonzero(part == b)
        linked = unit[x] @ unit[y].T >= cosine
        if a == b:
            linked = np.triu(linked, 1)
        if not linked.any():
            return None
        keys = rows.column(7).flatten().to_numpy().reshape(len(rows), -1)
        i, j = np.nonzero(linked & ~_met(keys, key, x, y))  # a pair counts in the smallest cell that both entered
        i, j = x[i], y[j]
        if not len(i):
            return None
        links = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
        low = rep.copy()
        while True:  # the smallest member that is reachable within the cell
            was = low.copy()
            least = np.minimum(low[i], low[j])
            np.minimum.at(low, i, least)
            np.minimum.at(low, j, least)
            if (low == was).all():
                break
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some].astype(np.int64)), pa.array(low[some])], ["rep", "links", "other"])

    def run(batches):
        for rows in _shared.runs(batches, 3):
            if (out := group(rows)) is not None:
                yield out

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, part: int = PART, **options) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    every = _shared.stage(_vectors.one_each(vectors).select("vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64("embedding", F.lit(1)).alias("h2")), "vectors")
    reps = every.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    reps = _shared.stage(reps, "classes")
    keyed = _shared.stage(reps.select("rep", "embedding").mapInArrow(_hashed(options), "rep long, keys array<long>"), "cells")
    entered = keyed.select("rep", F.explode(F.array_distinct("keys")).alias("key"))
    shared = entered.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").withColumn("parts", F.expr(f"cast(ceil(members / {part}) as int)")).select("key", "parts")
    placed = entered.join(shared, "key").withColumn("part", F.expr("cast(pmod(xxhash64(rep, key), parts) as int)"))
    pieces = placed.select("key", "part", "rep", F.explode(F.expr("transform(sequence(0, parts - 1), p -> struct(least(p, part) as a, greatest(p, part) as b))")).alias("pair"))
    full = pieces.join(reps.select("rep", "copies", "embedding"), "rep").join(keyed, "rep").select("key", "pair.a", "pair.b", "part", "rep", "copies", "embedding", "keys")
    found = full.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(_linked(cosine), "rep long, links long, other long")
    found = _shared.stage(found, "links")
    component = _shared.connected_components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = reps.select("h1", "h2", "rep", "copies").join(counted, "rep", "left").join(component, F.col("rep") == F.col("node"), "left")
    known = known.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    known = every.select("vec_id", "h1", "h2").join(known, ["h1", "h2"]).drop("h1", "h2")
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(known, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
