"""Stable addresses: base slugs, allocation without collisions, reseeding and redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.sources import shared

#: Lengths of the hash suffix that are tried in turn.
SUFFIXES = range(6, 65, 2)


def base_slug(segments: Column) -> Column:
    """Slugs of the names from the root on, joined without the root's; empty for the root itself."""
    return F.array_join(F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0))), "/")


def suffixed(base: Column, item: Column, length: int) -> Column:
    return F.concat(base, F.lit("--"), F.substring(F.sha2(item, 256), 1, length))


def allocate(new: DataFrame, taken: DataFrame) -> DataFrame:
    """(id, slug) for new (id, kind, base): folders before documents, then by id; ``taken`` has the slugs in use.

    The first claimant of a base that is free gets it, the others its base with a
    hash of their id. Only what collides even so is tried again with a longer hash,
    and that is almost always nothing.
    """
    claims = new.where("base <> ''")
    used = taken.select(F.col("slug").alias("base"), F.lit(True).alias("used")).distinct()
    first = claims.groupBy("base").agg(F.min(F.struct((F.col("kind") != "folder").alias("later"), "id"))["id"].alias("first")).join(used, "base", "left_anti")  # one row a base, so a hot base is no hot task
    plain = F.col("id").eqNullSafe(F.col("first"))
    rows = claims.join(first, "base", "left").select("id", "base", F.when(plain, F.col("base")).otherwise(suffixed(F.col("base"), F.col("id"), SUFFIXES[0])).alias("slug"))
    held = taken.select("slug", F.lit(True).alias("held")).distinct()
    same = Window.partitionBy("slug").orderBy(~(F.col("slug") == F.col("base")), "base", "id")
    for length in SUFFIXES[1:]:
        claimed = rows.join(held, "slug", "left").select("id", "base", "slug", ((F.row_number().over(same) > 1) | F.col("held").isNotNull()).alias("clash"))
        rows = shared.stage(claimed, "slugs")
        if rows.where("clash").isEmpty():
            return rows.select("id", "slug")
        rows = rows.select("id", "base", F.when(F.col("clash"), suffixed(F.col("base"), F.col("id"), length)).otherwise(F.col("slug")).alias("slug"))
    return rows.select("id", "slug")


def universe(redirects: DataFrame, manifest: DataFrame, routes: tuple[str, ...]) -> DataFrame:
    """(slug, owner): all slugs in use - sources of redirects, the manifest's documents and folders, and the platform's routes."""
    fixed = manifest.sparkSession.createDataFrame([(r,) for r in routes], "slug string")
    rows = redirects.select(F.col("old_slug").alias("slug"), F.lit("redirect").alias("owner")).unionByName(manifest.select("slug", F.col("kind").alias("owner")))
    return rows.unionByName(fixed.withColumn("owner", F.lit("route")))


def stable(items: DataFrame, manifest: DataFrame, redirects: DataFrame, routes: tuple[str, ...]) -> DataFrame:
    """(id, slug, kept) of (id, kind, base): what the manifest (id, kind, slug) has stays, the others are allocated around all that is in use.

    Slugs of items that are gone stay reserved as long as the manifest lists them.
    """
    old = manifest.where("slug is not null").select("id", "slug")
    kept = items.select("id").join(old, "id").withColumn("kept", F.lit(True))
    new = items.join(old.select("id"), "id", "left_anti")
    return kept.unionByName(allocate(new, universe(redirects, manifest.where("slug is not null"), routes)).withColumn("kept", F.lit(False)))


def manifest_issues(manifest: DataFrame, redirects: DataFrame) -> DataFrame:
    """(slug, claims) of the manifest's slugs that more than one of its items and redirects hold."""
    rows = manifest.where("slug is not null").select("slug").unionByName(redirects.select(F.col("old_slug").alias("slug")))
    return rows.groupBy("slug").agg(F.count("*").alias("claims")).where("claims > 1")


def reseed(documents: DataFrame, others: DataFrame) -> DataFrame:
    """(id, old_slug, new_slug): addresses of (id, slug, base) anew, around the slugs of all others (slug).

    ``others``: sources of redirects, routes, and documents that keep their slugs.
    Documents that are reseeded together are allocated together, so they never clash.
    """
    new = allocate(documents.select("id", F.lit("document").alias("kind"), "base"), others)
    return documents.select("id", F.col("slug").alias("old_slug")).join(new.withColumnRenamed("slug", "new_slug"), "id")


def redirects_after(redirects: DataFrame, changes: DataFrame) -> DataFrame:
    """(old_slug, target) without chains, after (old_slug, new_slug) changes of documents."""
    moved = changes.where("old_slug <> new_slug").select(F.col("old_slug").alias("target"), "new_slug")
    kept = redirects.join(moved, "target", "left").select("old_slug", F.coalesce("new_slug", "target").alias("target"))
    added = moved.select(F.col("target").alias("old_slug"), F.col("new_slug").alias("target"))
    return kept.join(added.select("old_slug"), "old_slug", "left_anti").unionByName(added).where("old_slug <> target")


def redirect_map(redirects: DataFrame) -> DataFrame:
    return redirects.select(F.concat(F.lit("/"), "old_slug", F.lit("/")).alias("source"), F.concat(F.lit("/"), "target", F.lit("/")).alias("destination"))
