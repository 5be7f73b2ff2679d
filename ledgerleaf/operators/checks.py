"""Integrity rules as violations: each check returns (rule, key, detail), empty where all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerleaf.functions import settings
from ledgerleaf.operators import bodies, markdown, runs


def _found(rows: DataFrame, rule: str, key: str | Column, detail: str | Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), (F.col(key) if isinstance(key, str) else key).cast("string").alias("key"), (F.col(detail) if isinstance(detail, str) else detail).cast("string").alias("detail"))


def slug_unique(slugs: DataFrame) -> DataFrame:
    """slugs: (id, slug) of folders and documents together."""
    return _found(slugs.groupBy("slug").agg(F.count("*").alias("n")).where("n > 1"), "slug_unique", "slug", "n")


def slug_not_reserved(slugs: DataFrame, reserved: tuple[str, ...]) -> DataFrame:
    return _found(slugs.where(F.col("slug").isin(*reserved)), "slug_reserved", "id", "slug")


def paths(records: DataFrame, column: str, expected: Column) -> DataFrame:
    """Recorded paths that aren't what their id makes them."""
    return _found(records.where(~F.col(column).eqNullSafe(expected)), "path", "id", column)


def hashes(records: DataFrame, files: DataFrame) -> DataFrame:
    """records: (path, hash); files: (path, content): missing files and files with another hash."""
    actual = files.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("actual"))
    both = records.join(actual, "path", "left").where(~F.col("hash").eqNullSafe(F.col("actual")))
    return _found(both, "hash", "path", F.coalesce("actual", F.lit("missing")))


def orphans(files: DataFrame, referenced: DataFrame) -> DataFrame:
    return _found(files.select("path").join(referenced.select("path"), "path", "left_anti"), "orphan", "path", F.lit(None))


def redirects(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """rows: (old_slug, target, owner); documents: (id, slug): sources in use, self-redirects, and stale targets."""
    held = documents.select(F.col("slug").alias("old_slug"), F.col("id").alias("holder"))
    used = _found(rows.join(held, "old_slug"), "redirect_source_used", "old_slug", "holder")
    itself = _found(rows.where("old_slug = target"), "redirect_to_itself", "old_slug", "target")
    owned = rows.join(documents.select(F.col("id").alias("owner"), "slug"), "owner", "left")
    stale = _found(owned.where(~F.col("target").eqNullSafe(F.col("slug"))), "redirect_target", "old_slug", "target")
    return used.unionByName(itself).unionByName(stale)


def index(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Index rows (id, markdown_path) against documents (id, markdown_path), one to one."""
    a = rows.groupBy("id").agg(F.count("*").alias("n"), F.min("markdown_path").alias("listed"))
    both = a.join(documents.select("id", F.col("markdown_path").alias("recorded")), "id", "full")
    bad = both.where(~F.col("listed").eqNullSafe(F.col("recorded")) | (F.col("n") > 1))
    return _found(bad, "index", "id", F.coalesce("listed", F.lit("missing")))


def files(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path): files that are missing, and files that shouldn't be there."""
    missing = _found(expected.select("path").join(actual.select("path"), "path", "left_anti"), "file_missing", "path", F.lit(None))
    return missing.unionByName(_found(actual.select("path").join(expected.select("path"), "path", "left_anti"), "file_unexpected", "path", F.lit(None)))


def folder_slugs(folders: DataFrame, root: str = "root") -> DataFrame:
    """folders: (id, slug): folders but the root that have no slug."""
    return _found(folders.where((F.col("id") != root) & (F.coalesce("slug", F.lit("")) == "")), "folder_slug", "id", F.lit(None))


def front_matter(files: DataFrame, records: DataFrame) -> DataFrame:
    """files: (path, content); records: (path, slug, content_hash): heads that are refused, or differ from the record."""
    both = records.join(files.select("path", "content"), "path")
    issue = markdown.front_matter_issue(F.col("content"))
    head = lambda name: markdown.front_matter_value(F.col("content"), name)
    detail = F.coalesce(issue, F.when(~head("slug").eqNullSafe(F.col("slug")), "slug"), F.when(~head("contentHash").eqNullSafe(F.col("content_hash")), "contentHash"))
    return _found(both.withColumn("detail", detail).where("detail is not null"), "front_matter", "path", "detail")


def images(referenced: DataFrame, assets: DataFrame) -> DataFrame:
    """referenced: (id, href); assets: (path, type), below the owner's id: images elsewhere, oddly named, missing, or of another type than named."""
    part = lambda i: F.regexp_extract("href", r"^/assets/generated/([^/]+)/(image-\d{3,}\.([a-z]+))$", i)
    rows = referenced.select("id", "href", part(1).alias("owner"), F.concat(part(1), F.lit("/"), part(2)).alias("path"), part(3).alias("extension"))
    rows = rows.join(assets.select("path", "type", F.lit(True).alias("there")), "path", "left")
    detail = F.when(F.col("owner") == "", "name").when(F.col("owner") != F.col("id"), "other_document").when(F.col("there").isNull(), "missing").when(~F.col("type").eqNullSafe(F.col("extension")), "type")
    return _found(rows.withColumn("detail", detail).where("detail is not null"), "image", F.concat_ws(" ", "id", "href"), "detail")


def content_hashes(records: DataFrame, bodies_: DataFrame, assets: DataFrame) -> DataFrame:
    """records: (id, content_hash); bodies: (id, body); assets: (id, path, hash): records whose hash isn't that of the body and all its assets."""
    own = assets.groupBy("id").agg(F.collect_list(F.struct("path", "hash")).alias("assets"))
    none = F.array().cast("array<struct<path: string, hash: string>>")
    made = bodies_.join(own, "id", "left").select("id", runs.content_hash(F.col("body"), F.coalesce("assets", none)).alias("made"))
    both = records.join(made, "id", "left").where(~F.col("content_hash").eqNullSafe(F.col("made")))
    return _found(both, "content_hash", "id", F.coalesce("made", F.lit("missing")))


def modules(files: DataFrame, derived: DataFrame) -> DataFrame:
    """(path, content): generated modules that aren't byte by byte what they are derived from."""
    both = derived.select("path", F.col("content").alias("wanted")).join(files.select("path", "content"), "path", "left")
    return _found(both.where(~F.col("content").eqNullSafe(F.col("wanted"))), "module", "path", F.when(F.col("content").isNull(), "missing").otherwise("differs"))


def places(spark: SparkSession, files: tuple[str, ...], folders: tuple[str, ...]) -> DataFrame:
    """(place, whole) of allowed files and folders."""
    return spark.createDataFrame([*((f, True) for f in files), *((f, False) for f in folders)], "place string, whole boolean")


def allowed_paths(paths: DataFrame, allowed: DataFrame) -> DataFrame:
    """``paths`` (path) with allowed: whether a path is one of ``allowed`` (place, whole), or below one that isn't whole.

    Every path meets the rules as itself and as each folder above it, by equality, so
    any number of rules is one join. Paths that leave their root are never allowed.
    """
    distinct = paths.select("path").distinct().withColumn("parts", F.split(settings.plain_path(F.col("path")), "/"))
    steps = distinct.where("parts is not null").select("path", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("n"))
    above = steps.select("path", F.array_join(F.slice("parts", F.lit(1), F.col("n")), "/").alias("place"), (F.col("n") == F.size("parts")).alias("self"))
    met = above.join(allowed.select("place", "whole"), "place").where("self or not whole").select("path", F.lit(True).alias("allowed")).distinct()
    return paths.join(met, "path", "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def generated_files(files: DataFrame, allowed: DataFrame, documents: str) -> DataFrame:
    """files: (path, content): files outside of the allowed places, other than Markdown among the documents, or without the marker there."""
    inside = F.col("path").startswith(f"{documents}/")
    detail = F.when(~F.col("allowed"), "not_allowed").when(inside & ~F.col("path").endswith(".md"), "not_markdown").when(inside & ~F.col("content").contains(bodies.MARKER), "no_marker")
    return _found(allowed_paths(files, allowed).withColumn("detail", detail).where("detail is not null"), "generated_file", "path", "detail")


def working_changes(changed: DataFrame, untracked: DataFrame, allowed: DataFrame) -> DataFrame:
    """(path, link): changed and untracked paths, each once, that may not change in a run, and links among them."""
    rows = changed.select("path", "link").unionByName(untracked.select("path", "link")).groupBy("path").agg(F.bool_or("link").alias("link"))
    detail = F.when(~F.col("allowed"), "not_allowed").when(F.col("link"), "link")
    return _found(allowed_paths(rows, allowed).withColumn("detail", detail).where("detail is not null"), "working_change", "path", "detail")


def header_rules(files: DataFrame) -> DataFrame:
    """(file, pattern, header) of header files (file, content): a line from the first column on opens a rule, indented lines are its headers.

    What follows a number sign is a comment. Of a pattern that opens several rules the
    last counts; a rule without headers has one row without header.
    """
    lines = files.select("file", F.posexplode(F.split("content", r"\r?\n")).alias("at", "raw")).withColumn("line", F.split_part("raw", F.lit("#"), F.lit(1))).where(F.col("line").rlike(r"\S"))
    opens = ~F.col("line").rlike(r"^\s")
    so_far = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ruled = lines.withColumns({"pattern": F.last(F.when(opens, F.trim(F.regexp_replace("line", r"\s+$", ""))), True).over(so_far), "rule": F.last(F.when(opens, F.col("at")), True).over(so_far)}).where("pattern is not null")
    latest = ruled.withColumn("latest", F.max("rule").over(Window.partitionBy("file", "pattern"))).where("rule = latest")
    header = F.lower(F.regexp_replace("line", r"^\s+|\s+$", ""))
    headers = latest.where("at <> rule").select("file", "pattern", header.alias("header"))
    return latest.where("at = rule").select("file", "pattern").join(headers, ["file", "pattern"], "left")


#: The headers that a rule for content of a private site begins with.
PRIVATE_HEADERS = ("cache-control: private", "x-robots-tag")


def headers(files: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Rules of header files (file, content) against (file, pattern, public): content that is public may not be kept out of indexes, other content must be."""
    rules = header_rules(files).groupBy("file", "pattern").agg(F.collect_list("header").alias("headers"))
    both = surfaces.join(rules, ["file", "pattern"], "left")
    hidden = F.coalesce(F.exists("headers", lambda h: h.contains("noindex")), F.lit(False))
    lack = lambda start: F.when(~F.exists("headers", lambda h: h.startswith(start)), F.lit(f"lacks {start}"))
    lacks = [lack(start) for start in PRIVATE_HEADERS]
    details = F.when(F.col("public"), F.array_compact(F.array(F.when(hidden, F.lit("hidden"))))).when(F.col("headers").isNull(), F.array(F.lit("no_rule"))).otherwise(F.array_compact(F.array(*lacks)))
    return _found(both.select(F.concat_ws(" ", "file", "pattern").alias("key"), F.explode(details).alias("detail")), "headers", "key", "detail")


def exempt_paths(tracked: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """(path): tracked paths that a pattern of the scanner's exemptions matches; the patterns are a setting, so one pass meets them all."""
    hits = F.array_compact(F.array(*(F.when(F.col("path").rlike(p), F.lit(p)) for p in patterns)))
    return _found(tracked.select("path", F.explode(hits).alias("pattern")), "exempt", "path", "pattern")


def section_pages(pages: DataFrame, folders: DataFrame) -> DataFrame:
    """pages: (path, content); folders: (id, page_path, page_hash): pages that are missing or aren't what was recorded."""
    both = folders.where("page_path is not null").join(pages.select(F.col("path").alias("page_path"), "content"), "page_path", "left")
    made = F.concat(F.lit("sha256:"), F.sha2("content", 256))
    return _found(both.where(~F.col("page_hash").eqNullSafe(made)), "section_page", "id", F.when(F.col("content").isNull(), "missing").otherwise("differs"))


def require(*violations: DataFrame) -> None:
    """Raises with a bounded report if any rule is violated."""
    found = violations[0]
    for more in violations[1:]:
        found = found.unionByName(more)
    some = found.limit(20).collect()
    if some:
        raise ValueError("integrity rules are violated: " + "; ".join(f"{r['rule']}: {r['key']} ({r['detail']})" for r in some))
