"""Column functions on what a run writes: where documents come from and go to, and their front matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How the service addresses documents, and the folders of generated files.
SOURCE = "https://docs.google.com/document/d/{}/edit"
DOCUMENTS, ASSETS = "docs", "assets/generated"


def source_url(item: Column) -> Column:
    """Where readers edit a document; ids are percent-encoded."""
    encoded = F.regexp_replace(F.url_encode(item), r"\+", "%20")
    before, after = SOURCE.split("{}")
    return F.concat(F.lit(before), encoded, F.lit(after))


def markdown_path(item: Column) -> Column:
    return F.concat(F.lit(f"{DOCUMENTS}/"), item, F.lit(".md"))


def assets_folder(item: Column) -> Column:
    return F.concat(F.lit(f"{ASSETS}/"), item)


def quoted(value: Column) -> Column:
    """A text as a double-quoted JSON string, which YAML reads as well."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r"^\{\"v\":(.*)\}$", 1)


def front_matter(fields: dict[str, Column], lists: tuple[str, ...] = (), flags: tuple[str, ...] = ()) -> Column:
    """A head in YAML between its lines of hyphens; texts are quoted, ``lists`` are arrays of texts, ``flags`` booleans; fields without value are left out."""

    def one(name: str, value: Column) -> Column:
        if name in flags:
            return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\n"))
        if name in lists:
            lines = F.array_join(F.transform(value, lambda x: F.concat(F.lit("  - "), quoted(x), F.lit("\n"))), "")
            return F.when(F.size(value) == 0, f"{name}: []\n").otherwise(F.concat(F.lit(f"{name}:\n"), lines))
        return F.concat(F.lit(f"{name}: "), quoted(value), F.lit("\n"))

    parts = [F.when(v.isNotNull(), one(k, v)).otherwise("") for k, v in fields.items()]
    return F.concat(F.lit("---\n"), *parts, F.lit("---\n"))
