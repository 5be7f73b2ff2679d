"""Operator 8: mixing sources to target weights, with DataFrame functions only.

Every row gets a hash-random key. Within a source, rows are taken in the order of
their keys until the source's budget is used up; a budget above the source's size
repeats whole epochs first. The prefix sums that find the cut are distributed: a
source's key range is split evenly into buckets, sums of buckets are added up in
bucket order, and only the rows of one bucket are sorted together, so a source with
a third of all rows is spread over as many tasks as its rows ask for.

Null texts have size 0, null sources are one source and come last. Repeated rows are
rows of their own; an empty table gives an empty mix. Rows are drawn by doc_id, those
without one by their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.llm import _shared

WEIGHTS = (5, 2, 1)
#: The mix's words as a share of all words, in percent, and the most epochs of a source.
SHARE_PERCENT = 150
MOST = 2
#: Rows that are sorted together.
BUCKET_ROWS = 4_000
_KEY_BITS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def random_key() -> Column:
    """60 bits of an MD5 digest: the same for every run and every engine."""
    return F.expr(f"cast(conv(substring(md5(coalesce(cast(doc_id as string), text, '')), 1, {_KEY_BITS // 4}), 16, 10) as bigint)")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """Adds target (double) to (source, source_size); one row per source.

    Targets are proportional to the weights, which repeat over the sources by code
    point. They stop at ``most`` times the source's size; the excess is shared again
    by weight among the others. With sources ordered by size for their weight those
    that stop come first, so one ordered pass finds the level of the others.
    """
    by_name, by_ratio, every = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last()), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    rows = rows.withColumn("ratio", F.expr(f"{most} * source_size / weight"))
    before = F.coalesce(F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (share_percent * F.sum("source_size").over(every) - 100 * most * before) / (100 * left))
    rows = rows.withColumn("level", F.min(F.expr("if(level < ratio, struct(ratio, level), null)")).over(every)["level"])
    return rows.withColumn("target", F.expr(f"least(cast({most} * source_size as double), coalesce(level * weight, {most} * source_size))")).drop("ratio", "level")


def mix_rows(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """Adds source_size, target, taken and copies to rows with doc_id, source, size and key.

    ``taken``: words of the row that the mix takes, repeats counted; the row at the
    cut gives just the words that are missing. ``copies``: whole copies of the row,
    where the row at the cut counts if most of it is taken. Other columns stay; a column
    ``tie`` orders rows that share doc_id and size.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    plan = source_targets(sizes, weights, share_percent, most).withColumn("bits", F.expr(f"cast(ceil(log2(greatest(1, n_rows / {BUCKET_ROWS}))) as int)"))
    plan = plan.withColumn("budget", F.floor(F.col("target") + 0.5)).withColumn("epochs", F.expr("if(source_size > 0, budget div source_size, 0)"))
    plan = plan.select(F.col("source").alias("plan_source"), "source_size", "target", "bits", "epochs", F.expr("budget - epochs * source_size").alias("rest"))
    bucketed = rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source").withColumn("bucket", F.expr(f"shiftright(key, {_KEY_BITS} - bits)"))
    sums = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("of_source"), F.col("bucket").alias("of_bucket"), F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("bucket_before"))
    joined = bucketed.join(sums, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("bucket") == F.col("of_bucket")))
    ties = ["tie"] if "tie" in rows.columns else []
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = joined.withColumn("before", F.col("bucket_before") + F.sum("size").over(within) - F.col("size"))
    out = out.withColumn("taken", F.expr("epochs * size + greatest(0, least(size, rest - before))"))
    out = out.withColumn("copies", F.expr("epochs + if(size > 0 and 2 * (rest - before) >= size, 1, 0)"))
    return out.drop("of_source", "of_bucket", "bucket", "bucket_before", "before", "bits", "epochs", "rest", "key")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken."""
    rows = _shared.stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), random_key().alias("key")), "mixing")  # texts are read once
    return mix_rows(rows, weights, share_percent, most).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as it is taken whole; the columns of ``docs``."""
    own = F.struct(*(F.col(c) for c in docs.columns)).alias("row")
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), random_key().alias("key"), F.xxhash64("text").alias("tie"), own)
    taken = mix_rows(rows, weights, share_percent, most).where("copies > 0")
    return taken.select("row", F.explode(F.expr("sequence(1, copies)")).alias("copy")).select("row.*")


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 'x', 'g'), '[\\x20\\x09-\\x0D]+', '', 'g')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15))::BIGINT AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source),
r AS (SELECT *, 2 * source_size / weight AS ratio FROM s),
l AS (
  SELECT *, CAST(150 * sum(source_size) OVER () - 200 * coalesce(sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(100 * sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lev
  FROM r),
t AS (
  SELECT *, least(CAST(2 * source_size AS DOUBLE), coalesce((SELECT arg_min(lev, ratio) FROM l WHERE lev < ratio) * weight, 2 * source_size)) AS target
  FROM l),
b AS (SELECT source, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM t),
c AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, CASE WHEN b.source_size > 0 THEN b.budget // b.source_size ELSE 0 END AS epochs, b.budget,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS taken
FROM c
"""
