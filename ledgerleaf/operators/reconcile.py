"""Reconciliation of an inventory with the state of the previous run.

``current`` and ``manifest`` have (id, name, parent, modified); all comparisons are
null-safe, and each function is one join on id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("name", "parent", "modified")


def joined(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """Full outer join with presence flags and ``metadata_changed``."""
    new = current.select(F.col("id"), *(F.col(c).alias(f"new_{c}") for c in FIELDS), F.lit(True).alias("listed"))
    old = manifest.select(F.col("id"), *(F.col(c).alias(f"old_{c}") for c in FIELDS), F.lit(True).alias("known"))
    both = new.join(old, "id", "full")
    changed: Column = F.lit(False)
    for c in FIELDS:
        changed = changed | ~F.col(f"new_{c}").eqNullSafe(F.col(f"old_{c}"))
    return both.withColumn("metadata_changed", F.col("listed").isNotNull() & F.col("known").isNotNull() & changed)


def classes(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """(id, class): added, removed, changed or unchanged."""
    kind = F.when(F.col("known").isNull(), "added").when(F.col("listed").isNull(), "removed").when(F.col("metadata_changed"), "changed").otherwise("unchanged")
    return joined(current, manifest).select("id", kind.alias("class"))


def counters(classed: DataFrame) -> DataFrame:
    return classed.agg(*(F.count_if(F.col("class") == c).alias(c) for c in ("added", "changed", "unchanged", "removed")))


def corpus_changed(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: whether the sets of ids differ."""
    sides = current.select("id", F.lit(1).alias("listed")).join(manifest.select("id", F.lit(1).alias("known")), "id", "full")
    return sides.agg((F.count_if(F.col("listed").isNull() | F.col("known").isNull()) > 0).alias("corpus_changed"))


def needs_export(current: DataFrame, manifest: DataFrame, full: bool = False, narrow: bool = False) -> DataFrame:
    """(id, needs_export) of listed documents; by default one added or removed document exports all, as links may change."""
    rows = joined(current, manifest).where("listed")
    own = F.col("known").isNull() | F.col("metadata_changed")
    if full:
        return rows.select("id", F.lit(True).alias("needs_export"))
    if narrow:
        return rows.select("id", own.alias("needs_export"))
    flag = F.broadcast(corpus_changed(current, manifest))  # one row
    return rows.join(flag).select("id", (own | F.col("corpus_changed")).alias("needs_export"))


def removed(current: DataFrame, manifest: DataFrame) -> DataFrame:
    return manifest.join(current.select("id"), "id", "left_anti").select("id")


def shape_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: whether folders (id, label, parent) differ; order numbers don't count."""
    cols = ["id", "label", "parent"]
    both = old.select(*cols).exceptAll(new.select(*cols)).unionAll(new.select(*cols).exceptAll(old.select(*cols)))
    return both.agg((F.count("*") > 0).alias("shape_changed"))


def overlay(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows by id, the new ones winning whole."""
    cols = [c for c in old.columns if c != "id"]
    a = old.select("id", F.struct(*cols).alias("old_row"))
    b = new.select("id", F.struct(*cols).alias("new_row"))
    return a.join(b, "id", "full").select("id", F.coalesce("new_row", "old_row").alias("row")).select("id", "row.*")
