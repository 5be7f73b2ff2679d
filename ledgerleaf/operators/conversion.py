"""The way over an archive: a document's exported page and its files to Markdown, with its images as assets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.operators import bodies, markdown, markup
from ledgerleaf.sources import shared

#: Fixed value: where a generated page finds its assets.
ASSETS = "../../../assets/generated"


def converted(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, html, body, description, complex_tables, warnings, issue) of pages (id, folder, title, html) and entries (id, path, bytes).

    The page is sanitized; images that lead out of the archive go with a warning, and
    those that are missing or none are the issue that ends a document's conversion.
    Others are numbered files, with the title to describe them where nothing else does.
    ``body`` is Markdown without a first heading that repeats the title.
    """
    found = shared.stage(markup.events(pages), "events")  # steps are read several times, so each is a table
    images = shared.stage(bodies.archive_images(pages, entries), "images")
    named = images.where("issue is null").select("id", "position", F.concat(F.lit(f"{ASSETS}/"), F.col("id").cast("string"), F.lit("/"), "file").alias("file"), "alt")
    kept = shared.stage(markup.with_images(markup.kept_events(found), named), "kept")
    made = pages.select("id", "title").join(markup.as_html(kept), "id", "left").join(markup.to_markdown(kept), "id", "left").fillna("", ["html", "markdown"]).withColumnRenamed("markdown", "body")
    docs = shared.stage(markdown.normalized_headings(shared.stage(made, "made")), "bodies")
    unsafe = images.where("issue = 'unsafe_path'").select("id", F.lit("removed_unsafe_image").alias("code"))
    codes = markup.warnings(found).unionByName(unsafe).groupBy("id").agg(F.array_sort(F.collect_set("code")).alias("warnings"))
    complex_ = markup.tables(kept).groupBy("id").agg(F.bool_or("complex").alias("complex_tables"))
    issue = images.where("issue in ('missing', 'not_an_image')").groupBy("id").agg(F.min_by("issue", "position").alias("issue"))
    out = docs.join(markdown.descriptions(docs), "id").join(complex_, "id", "left").join(codes, "id", "left").join(issue, "id", "left")
    return out.select("id", "html", "body", "description", F.coalesce("complex_tables", F.lit(False)).alias("complex_tables"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"), "issue")
