"""Document bodies: headings, front matter, and the readers of archives and drawings."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerleaf.functions import outputs, text, urls
from ledgerleaf.operators import markup

# Limits of archives, and elements of drawings.
ENTRIES, ENTRY_BYTES, TOTAL_BYTES, RATIO = 1_000, 20 * 1024 * 1024, 50 * 1024 * 1024, 200
DRAWING = ("circle", "clippath", "defs", "desc", "ellipse", "g", "line", "lineargradient", "mask", "path", "pattern", "polygon", "polyline", "radialgradient", "rect", "stop", "svg", "text", "title", "tspan", "use")

MARKER = "<!-- Generated. Do not edit. -->"


def document(title: Column, slug: Column, content_hash: Column, body: Column) -> Column:
    """A generated file: front matter, the marker, and the body."""
    meta = F.concat(*(part for name, value in (("title", title), ("slug", slug), ("contentHash", content_hash)) for part in (F.lit(f"{name}: "), F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r"^\{\"v\":(.*)\}$", 1), F.lit("\n"))))
    return F.concat(F.lit("---\n"), meta, F.lit(f"---\n\n{MARKER}\n\n"), body, F.lit("\n"))


def generated_document(record: dict[str, Column], body: Column) -> Column:
    """A whole generated file: ``record`` has title, description, slug, id, modified, synced, contentHash and folderPath (array); then the marker and the body."""
    # The names of the fields in their order, and the type of source.
    fields = {
        "title": record["title"], "description": F.nullif(record["description"], F.lit("")), "slug": record["slug"], "editUrl": outputs.source_url(record["id"]), "sourceType": F.lit("google-doc"), "googleFileId": record["id"],
        "googleModifiedTime": record["modified"], "syncedAt": record["synced"], "contentHash": record["contentHash"], "folderPath": record["folderPath"], "pagefind": F.lit(True),
    }
    text_ = F.regexp_replace(body, r"\s+$", "")
    return F.concat(outputs.front_matter(fields, ("folderPath",), ("pagefind",)), F.lit(f"{MARKER}\n\n"), text_, F.when(text_ != "", "\n").otherwise(""))


def document_body(content: Column) -> Column:
    """What follows the marker, or null without one."""
    at = F.instr(content, MARKER)
    return F.when(at > 0, F.regexp_replace(F.substr(content, at + len(MARKER)), r"^\n+|\n+$", ""))


_ENTRIES = T.StructType([T.StructField("issue", T.StringType()), T.StructField("entries", T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("bytes", T.BinaryType())])))])


@F.pandas_udf(_ENTRIES)
def archive_entries(data: pd.Series) -> pd.DataFrame:
    """The files of each ZIP archive in order of path, or the reason for which it is refused."""
    return pd.DataFrame([_archive(d) for d in data], columns=["issue", "entries"])


def _archive(data: bytes | None) -> tuple[str | None, list | None]:
    try:
        found, names, total = [], set(), 0
        archive = zipfile.ZipFile(io.BytesIO(data or b""))
        infos = archive.infolist()
        if len(infos) > ENTRIES:
            return "too_many_entries", None
        for info in infos:
            path, total = info.filename, total + info.file_size
            if path.startswith(("/", "\\")) or "\0" in info.orig_filename or "\\" in path or ":" in path or ".." in path.split("/"):
                return "unsafe_path", None
            if path.lower() in names:
                return "duplicate_path", None
            if info.flag_bits & 1 or (info.external_attr >> 16) & 0o170000 == 0o120000 or info.compress_type not in (0, 8):
                return "unsupported_entry", None
            if info.file_size > ENTRY_BYTES or total > TOTAL_BYTES or info.file_size > RATIO * max(info.compress_size, 1):
                return "too_large", None
            names.add(path.lower())
            if not info.is_dir():
                found.append({"path": path, "bytes": archive.read(info)})
        return None, sorted(found, key=lambda e: e["path"])
    except (zipfile.BadZipFile, EOFError, NotImplementedError, OSError, ValueError, RuntimeError, zlib.error) as e:
        return f"unreadable: {type(e).__name__}", None


def entry_page(entries: Column) -> Column:
    """The one HTML page among an archive's entries; null if there is none, or another."""
    pages = F.filter(entries, lambda e: e["path"].rlike(r"(?i)\.html?$"))
    return F.when(F.size(pages) == 1, F.get(pages, 0))


def archive_images(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, position, src, file, alt, issue) of the images of pages, in their order.

    pages: (id, folder, html), and title where images without alternative are to be
    described by it; entries: (id, path, bytes). Equal images of a page are one file, numbered by first appearance; those that lead out of the archive, aren't
    in it, or are no image of a known type have an issue and no number.
    """
    own = ["id", "folder", *(["title"] if "title" in pages.columns else [])]
    tags = markup.images(markup.kept_events(markup.events(pages))).join(pages.select(*own), "id")
    plain = F.concat(F.lit("Image from "), "title") if "title" in pages.columns else F.lit("Image")
    rows = tags.select("id", "position", "src", F.coalesce(F.nullif(F.trim("alt"), F.lit("")), plain).alias("alt"), urls.asset_path(F.col("src"), F.col("folder")).alias("path"))
    found = rows.join(entries.select("id", "path", F.sha2("bytes", 256).alias("hash"), text.image_type(F.col("bytes")).alias("type"), F.lit(True).alias("there")), ["id", "path"], "left")
    issue = F.when(F.col("path").isNull(), "unsafe_path").when(F.col("there").isNull(), "missing").when(F.col("type").isNull(), "not_an_image")
    found = found.withColumn("issue", issue)
    first = found.where("issue is null").groupBy("id", "hash", "type").agg(F.min("position").alias("first"))
    number = F.row_number().over(Window.partitionBy("id").orderBy("first"))
    named = first.select("id", "hash", F.concat(F.lit("image-"), F.lpad(number.cast("string"), 3, "0"), F.lit("."), "type").alias("file"))
    return found.join(named, ["id", "hash"], "left").select("id", "position", "src", "file", "alt", "issue")


@F.pandas_udf(T.StringType())
def drawing_issue(svg: pd.Series) -> pd.Series:
    """Why each SVG drawing is refused, or null."""
    return svg.map(_drawing)


def _drawing(text: str | None) -> str | None:
    found: list[str] = []
    depth = [0]

    def start(name, attributes):
        if depth[0] == 0 and name.lower() != "svg":
            found.append("not_svg")
        depth[0] += 1
        if name.lower() not in DRAWING:
            found.append("element")
        for key, value in attributes.items():
            if key.lower().startswith("on") or key.lower() == "style":
                found.append("attribute")
            if key.lower() in ("href", "xlink:href") and not re.match(r"^#[^\x00-\x1f\x7f]+$", value):
                found.append("reference")

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.StartDoctypeDeclHandler = start, lambda *_: found.append("doctype")
    try:
        parser.Parse(text or "", True)
    except expat.ExpatError:
        found.append("unreadable")
    return found[0] if found else None
