"""Operator 11: sharding by longest-processing-time scheduling.

Rows with equal texts are a group that must stay together. Groups, sorted by size, go to
the least-loaded shard through a heap. Only units that matter for the balance are dealt
one by one, so the heap gets a bounded number of them at any size of the table:

* A group that holds at least 1/``FINE`` of a shard's even share is a unit of its own;
  by arithmetic there are at most ``shards * FINE`` of these.
* All other groups go whole into one of ``shards * FINE`` bundles, by the hash of their
  text; a bundle is a unit, too.

Loads then differ by no more than the largest unit does from what is left to balance it:
near 1/``FINE`` of a shard, or one group that is larger than a shard's even share. Where
every group is large this is the plain rule over all groups.

Skew: sizes are added up before any shuffle, rows find their shard through two broadcast
tables of the bounded size above, and positions within a shard are distributed prefix
sums over buckets of rows, so one group with a third of all rows moves through as many
tasks as its rows ask for.

Null texts count as empty and are one group with the empty ones. Repeated rows are rows
of their own. Rows without doc_id take part. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.llm import _shared

SHARDS = 16
#: Parts of a shard's even share from which on a group is dealt by itself.
FINE = 1024
#: Rows of a shard that get their positions together.
BUCKET_ROWS = 1_000


def _keys() -> list:
    """128 bits that stand for a text, and its size."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2"), (F.octet_length(text) + 1).cast("long").alias("size")]


def deal(units: list[tuple], shards: int) -> list[tuple]:
    """Longest processing time first: (key, size) in falling size to the least-loaded shard, as (key, shard).

    Ties go by key and to the smallest shard.
    """
    heap = [(0, s) for s in range(shards)]
    out = []
    for key, size in sorted(units, key=lambda u: (-u[1], u[0])):
        load, shard = heapq.heappop(heap)
        out.append((key, shard))
        heapq.heappush(heap, (load + size, shard))
    return out


def schedule(groups: DataFrame, shards: int = SHARDS, fine: int = FINE) -> tuple[DataFrame, DataFrame]:
    """(large, bundles) for groups (h1, h2, size, n): the place of each large group (own_h1, own_h2, own) and of each bundle (bundle, bundled).

    A place has the shard and the number of position buckets that the shard's rows ask for.
    """
    spark, parts = groups.sparkSession, shards * fine
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    own = F.col("size").cast("decimal(38,0)") * parts >= F.lit(total).cast("decimal(38,0)")
    unit = groups.select(F.when(own, F.struct("h1", "h2")).alias("own"), F.when(~own, F.pmod("h1", F.lit(parts))).alias("bundle"), "size", "n")
    units = unit.groupBy("own", "bundle").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect()  # at most 2 * parts
    keyed = [((0, *u.own) if u.own else (1, u.bundle, 0), u) for u in units]
    dealt = dict(deal([(k, u.size) for k, u in keyed], shards))
    rows = [0] * shards
    for k, u in keyed:
        rows[dealt[k]] += u.n
    place = {k: (s, -(-rows[s] // BUCKET_ROWS)) for k, s in dealt.items()}
    kind = "struct<shard: int, buckets: long>"
    large = spark.createDataFrame([(k[1], k[2], p) for k, p in place.items() if not k[0]], f"own_h1 long, own_h2 long, own {kind}")
    bundles = spark.createDataFrame([(k[1], p) for k, p in place.items() if k[0]], f"bundle long, bundled {kind}")
    return large, bundles


def _placed(rows: DataFrame, large: DataFrame, bundles: DataFrame, shards: int, fine: int) -> DataFrame:
    """Adds shard and buckets to rows with h1 and h2; no shuffle."""
    same = (F.col("h1") == F.col("own_h1")) & (F.col("h2") == F.col("own_h2"))
    out = rows.join(F.broadcast(large), same, "left").join(F.broadcast(bundles), F.pmod("h1", F.lit(shards * fine)) == F.col("bundle"), "left")
    place = F.coalesce("own", "bundled")
    return out.withColumns({"shard": place["shard"], "buckets": place["buckets"]}).drop("own_h1", "own_h2", "own", "bundle", "bundled")


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("h1", "h2").agg(F.sum("size").alias("size"), F.count("*").alias("n"))


def shard(docs: DataFrame, shards: int = SHARDS, fine: int = FINE) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, h1, h2, shard, slot; slots are gapless from 0 in each shard.

    Positions follow a hash of doc_id and text, so neighbours in a shard are unrelated.
    Other columns of ``docs`` are ignored.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_keys(), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    rows = _shared.stage(narrow, "sharding")  # texts are read once
    placed = _placed(rows, *schedule(_groups(rows), shards, fine), shards, fine)
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h1"), F.col("buckets"))).drop("buckets")
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("shard").alias("of_shard"), F.col("bucket").alias("of_bucket"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "h1", "h2")
    numbered = placed.withColumn("at", F.row_number().over(within) - 1)
    out = numbered.join(starts, (F.col("shard") == F.col("of_shard")) & (F.col("bucket") == F.col("of_bucket")))
    return out.select("doc_id", "size", "text_crc32", "h1", "h2", "shard", (F.col("start") + F.col("at")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, fine: int = FINE, files: int = 1) -> None:
    """Writes ``docs`` with all its columns as Parquet folders ``shard=0``, ``shard=1`` and so on, of ``files`` files each.

    Texts are shuffled once, in the write. A column ``shard`` of ``docs`` gives way to the new one.
    """
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != "shard")).alias("row")
    rows = docs.select(*_keys(), own)
    placed = _placed(rows, *schedule(_groups(rows), shards, fine), shards, fine)
    placed = placed.withColumn("file", F.pmod(F.xxhash64("row.doc_id", "h1"), F.lit(files)))
    placed.repartition(shards * files, "shard", "file").select("row.*", "shard").write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's rows: the law is ``bytes``, so no shard is held for a further one."""
    rows = shard(docs)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
