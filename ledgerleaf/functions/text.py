"""Column functions on bodies: line ends, hashes, escapes, and the type of an image by its first bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def newlines(text: Column) -> Column:
    """No byte order mark, and line feeds alone."""
    return F.regexp_replace(F.regexp_replace(text, r"^\x{FEFF}", ""), r"\r\n|[\r\x{2028}\x{2029}]", "\n")


def sha256(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def escape_heading(text: Column) -> Column:
    """Markdown's own characters escaped."""
    return F.regexp_replace(text, r"([\\`*_\[\]<>#])", r"\\$1")


def image_type(data: Column) -> Column:
    """Extension by magic bytes: png, jpg, gif or webp, else null."""
    head = F.hex(F.substring(data, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpg")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "gif")
        .when(head.startswith("52494646") & head.endswith("57454250"), "webp")
    )
