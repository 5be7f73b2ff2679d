"""What a run has to do, and what it keeps: exports, outputs that are still good, reuse, preserved records and counters.

``manifest`` records have (id, name, parent, modified, slug, content_hash, output_hash,
path, generated_at); ``current`` documents (id, name, parent, modified). Every function
joins on id or path once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.functions import text
from ledgerleaf.operators import bodies, reconcile


def content_hash(body: Column, assets: Column) -> Column:
    """Hash of the JSON text of a body and its assets (array of (path, hash)) in order of path."""
    ordered = F.transform(F.array_sort(assets), lambda a: F.struct(a["path"].alias("path"), a["hash"].alias("hash")))
    return text.sha256(F.to_json(F.struct(body.alias("body"), ordered.alias("assets"))))


def output_issues(manifest: DataFrame, outputs: DataFrame) -> DataFrame:
    """(id, issue) of records whose generated file (path, content) is missing, unmarked, or not what was written."""
    joined = manifest.select("id", "path", "output_hash", "content_hash").join(outputs.select("path", "content"), "path", "left")
    body = bodies.document_body(F.col("content"))
    issue = (
        F.when(F.col("content").isNull(), "missing").when(body.isNull(), "marker_missing").when(~text.sha256(F.col("content")).eqNullSafe(F.col("output_hash")), "output_changed")
        .when(~text.sha256(body).eqNullSafe(F.col("content_hash")), "content_changed")
    )
    return joined.select("id", issue.alias("issue")).where("issue is not null")


def version_changed(written: dict[str, str], now: dict[str, str], manifest: DataFrame, target: str | None = None) -> bool:
    """Whether another converter or normalizer wrote the outputs; a run for one document is refused then, unless nothing was written."""
    changed = any(written.get(k) != v for k, v in now.items())
    if changed and target is not None and not manifest.isEmpty():
        raise ValueError("outputs of another version need a full run")
    return changed


def plan(current: DataFrame, manifest: DataFrame, invalid: DataFrame, full: bool = False, target: str | None = None, shape_changed: bool = False) -> DataFrame:
    """(id, needs_export, reasons) of the documents that a run looks at.

    A run for one document looks at it and at what the manifest has, and exports it
    alone. ``full``: another version wrote the outputs; ``shape_changed``: folders moved.
    """
    rows = reconcile.joined(current, manifest).where("listed").join(invalid.select("id", F.lit(True).alias("bad")).distinct(), "id", "left")
    if target is not None:
        return rows.where(F.col("known") | (F.col("id") == target)).select("id", (F.col("id") == target).alias("needs_export"), F.when(F.col("id") == target, "target").otherwise("").alias("reasons"))
    corpus = F.broadcast(reconcile.corpus_changed(current, manifest))  # one row
    flags = {"full": F.lit(full), "corpus": F.col("corpus_changed"), "new": F.col("known").isNull(), "metadata": F.col("metadata_changed") | F.lit(shape_changed), "output": F.coalesce("bad", F.lit(False))}
    reasons = F.array_join(F.array_compact(F.array(*(F.when(c, name) for name, c in flags.items()))), ",")
    return rows.join(corpus).select("id", (reasons != "").alias("needs_export"), reasons.alias("reasons"))


def merged(planned: DataFrame, exported: DataFrame) -> DataFrame:
    """Records of planned documents, those of exported ones in their place; both (id, ...) with the same columns."""
    return reconcile.overlay(planned, exported.join(planned.select("id"), "id", "left_semi"))


def with_reuse(exported: DataFrame, manifest: DataFrame, invalid: DataFrame) -> DataFrame:
    """Records (id, name, parent, modified, slug, content_hash, generated_at): the old ones whole, with their time, where nothing that counts differs."""
    fields = [c for c in exported.columns if c != "id"]
    old = manifest.select("id", F.struct(*fields).alias("old")).join(invalid.select("id"), "id", "left_anti")
    both = exported.select("id", F.struct(*fields).alias("new")).join(old, "id", "left")
    same = F.col("old").isNotNull()
    for c in fields:
        if c != "generated_at":
            same = same & F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}"))
    return both.select("id", same.alias("reused"), F.when(same, F.col("old")).otherwise(F.col("new")).alias("record")).select("id", "reused", "record.*")


def generated_at(new: DataFrame, old: DataFrame, now: str, before: str) -> DataFrame:
    """One row: the time of this run, or of the one before if the tables (without times) are equal."""
    cols = [c for c in new.columns if c != "generated_at"]
    differ = new.select(*cols).exceptAll(old.select(*cols)).unionAll(old.select(*cols).exceptAll(new.select(*cols)))
    return differ.agg(F.when(F.count("*") > 0, now).otherwise(before).alias("generated_at"))


def preserved(manifest: DataFrame, planned: DataFrame, invalid: DataFrame) -> DataFrame:
    """Records outside of the plan of a run for one document, with whether their outputs are still good."""
    rest = manifest.join(planned.select("id"), "id", "left_anti")
    return rest.join(invalid.select("id", F.lit(False).alias("good")).distinct(), "id", "left").withColumn("good", F.coalesce("good", F.lit(True)))


def navigation_after(target: str | None, rebuilt: DataFrame, before: DataFrame) -> DataFrame:
    """The navigation that a run writes: that of the run before for one document, else the rebuilt one; both with the same columns.

    A run for one document knows the others by their records alone, so nothing else of
    the navigation may move; a document that it adds is there after the next full run.
    """
    return rebuilt if target is None else before.select(*rebuilt.columns)


def managed_children(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """``hierarchy.children_in_order`` with the documents that the manifest has alone, numbered again."""
    kept = rows.where("kind = 'folder'").unionByName(rows.where("kind = 'document'").join(manifest.select("id"), "id", "left_semi").select(*rows.columns))
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("parent", "kind").orderBy("position")).cast("long"))


def managed(placed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Folders of ``paths`` and, of its documents, those that the manifest has."""
    return placed.where("kind = 'folder'").unionByName(placed.where("kind = 'document'").join(manifest.select("id"), "id", "left_semi").select(*placed.columns))


def folder_records(placed: DataFrame, slugs: DataFrame, root: str = "root") -> DataFrame:
    """(id, name, parent, slug, page_path): folders as the manifest keeps them; the root has no parent, and only folders with a slug a page."""
    rows = placed.where("kind = 'folder'").join(slugs.select("id", "slug"), "id", "left")
    return rows.select("id", "name", F.when(F.col("id") != root, F.col("parent")).alias("parent"), "slug", F.when(F.col("slug").isNotNull(), F.concat(F.lit("sections/"), "id", F.lit(".md"))).alias("page_path"))


def report_counters(items: DataFrame, placed: DataFrame, kept: DataFrame, issues: DataFrame) -> DataFrame:
    """One row of the inventory's report: all, below the root, selected by kind, ignored, outside, and issues."""
    kinds = kept.agg(*(F.count_if(F.col("kind") == k).alias(f"selected_{k}s") for k in ("folder", "document", "unsupported")), F.count("*").alias("selected"))
    counts = items.agg(F.count("*").alias("items")).join(placed.agg(F.count("*").alias("descendants"))).join(kinds).join(issues.agg(F.count("*").alias("issues")))  # one row each
    return counts.select("items", "descendants", "selected_folders", "selected_documents", "selected_unsupporteds", (F.col("descendants") - F.col("selected")).alias("ignored"), (F.col("items") - F.col("descendants")).alias("outside"), "issues")


def run_counters(current: DataFrame, manifest: DataFrame, folders: DataFrame, unsupported: DataFrame, warnings: DataFrame, targeted: bool = False) -> DataFrame:
    """One row: added, changed, unchanged and removed documents (a run for one document removes none), folders, unsupported items and warnings."""
    counted = reconcile.counters(reconcile.classes(current, manifest))
    sizes = [df.agg(F.count("*").alias(name)) for df, name in ((folders, "folders"), (unsupported, "unsupported"), (warnings.distinct(), "warnings"))]
    for one in sizes:
        counted = counted.join(one)  # one row each
    return counted.withColumn("removed", F.lit(0).cast("long")) if targeted else counted
