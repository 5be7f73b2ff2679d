"""The link graph: extraction, rewriting of links to documents, and broken links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions import urls

#: Routes that a site serves beside its documents.
STATIC = ("", "about", "documents")
MARKDOWN_LINK = r"\]\(([^()\s]+)\)"


def extract(docs: DataFrame, body: str = "body") -> DataFrame:
    """(id, position, href) of inline Markdown links."""
    return docs.select("id", F.posexplode(F.regexp_extract_all(body, F.lit(MARKDOWN_LINK), F.lit(1))).alias("position", "href"))


def valid_slugs(documents: DataFrame, redirects: DataFrame, static: tuple[str, ...] = STATIC) -> DataFrame:
    """(slug) of documents, redirects and the routes of the site, once each."""
    fixed = documents.sparkSession.createDataFrame([(s,) for s in static], "slug string")
    return documents.select("slug").unionByName(redirects.select(F.col("old_slug").alias("slug"))).unionByName(fixed).distinct()


def broken(links: DataFrame, valid: DataFrame) -> DataFrame:
    """(source, target) of links (source, href) that lead within the site but nowhere; repeated links stay repeated."""
    routed = links.select("source", urls.route(F.col("href"), F.col("source")).alias("slug")).where("slug is not null")
    return routed.join(valid, "slug", "left_anti").select("source", F.col("slug").alias("target"))


def rewritten(links: DataFrame, slugs: DataFrame) -> DataFrame:
    """Adds new_href and removed_anchor to links with href; slugs: (id, slug).

    Redirects are unwrapped first; links to known documents become their addresses,
    others keep where they lead.
    """
    target = links.withColumn("target", F.coalesce(urls.unwrapped(F.col("href")), F.col("href")))
    target = target.withColumn("linked", urls.document_id(F.col("target")))
    known = target.join(slugs.select(F.col("id").alias("linked"), "slug"), "linked", "left")
    anchor = urls.fragment(F.col("target"))
    new = F.when(F.col("slug").isNotNull(), F.concat(F.lit("/"), "slug", F.lit("/"), anchor)).otherwise(F.col("target"))
    removed = F.col("slug").isNotNull() & F.col("target").contains("#") & (anchor == "")
    return known.select(*links.columns, new.alias("new_href"), removed.alias("removed_anchor"))


def broken_in_order(found: DataFrame) -> DataFrame:
    """Rows of ``broken`` by source, then by target."""
    return found.orderBy("source", "target")
