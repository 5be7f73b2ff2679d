"""Column functions on names: order prefixes, slugs, sort keys, descriptions, ages and anchors.

All are native expressions. Unicode normalization, which Spark lacks, is a separate
Arrow function, to be applied only to the rows that need it (``needs_normalizing``).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number before a name - one to three digits in brackets, or
# before a hyphen, a dash or a full stop - what looks like an attempt at one, and the name of nothing.
NUMBERED = r"^(?:\[(\d{1,3})\]|(\d{1,3})\s*[-–—.])\s*"
BARE_NUMBER = r"^\d{1,3}(?:\s|$)"
UNTITLED = "Untitled"
#: Longest description in characters, and the share of it below which a word is cut.
DESCRIPTION, WORD_SHARE = 200, 0.6
FRESH_DAYS, RECENT_DAYS = 14, 90
# The mean days of a month and of a year by which ages are told.
MONTH_DAYS, YEAR_DAYS = 30.44, 365.25


def needs_normalizing(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7F]")


def normalized(form: str):
    """An Arrow-batched function that brings strings into NFC, NFD, NFKC or NFKD."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v is None else unicodedata.normalize(form, v))

    return run


def trimmed(text: Column) -> Column:
    """Without white space of any kind around it."""
    return F.regexp_replace(text, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", "")


def order_number(name: Column) -> Column:
    """The number of an order prefix, or null."""
    text = trimmed(name)
    bracketed, plain = (F.regexp_extract(text, NUMBERED, i) for i in (1, 2))
    return F.when(bracketed != "", bracketed).when(plain != "", plain).cast("int")


def label(name: Column) -> Column:
    """The name without its order prefix."""
    rest = trimmed(F.regexp_replace(trimmed(name), NUMBERED, ""))
    return F.when(rest == "", F.lit(UNTITLED)).otherwise(rest)


def shown(name: Column) -> Column:
    """The name without its order prefix, in NFC, as readers see it."""
    return composed(label(name))


def unrecognized_prefix(name: Column) -> Column:
    """Digits and a blank: an attempt at numbering that the convention does not know."""
    text = trimmed(name)
    return text.rlike(BARE_NUMBER) & ~text.rlike(NUMBERED)


def composed(name: Column) -> Column:
    """The name in NFC; only names beyond ASCII leave the JVM."""
    return F.coalesce(normalized("NFC")(F.when(needs_normalizing(name), name)), name)


def slug_segment(name: Column) -> Column:
    """One part of an address: the label in NFKD without marks, in lower case, other characters as single hyphens."""
    plain = label(name)
    text = F.coalesce(normalized("NFKD")(F.when(needs_normalizing(plain), plain)), plain)
    text = F.regexp_replace(F.lower(F.regexp_replace(text, r"\p{M}+", "")), r"\p{M}+", "")
    slug = F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")
    return F.when(slug == "", F.lit("untitled")).otherwise(slug)


def natural_key(text: Column) -> Column:
    """Sorts like the text in lower case with runs of digits as numbers (of up to 20 digits)."""
    padded = F.regexp_replace(F.lower(text), r"(\d+)", "00000000000000000000$1")
    return F.regexp_replace(padded, r"\d*(\d{20})", "$1")


def description(text: Column, limit: int = DESCRIPTION) -> Column:
    """White space collapsed; cut at the last blank if that keeps most of it, else at the limit; with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"[\s\x{00A0}]+", " "))
    head = F.substring(flat, 1, limit + 1)
    last = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, " ") > 0) & (last >= limit * WORD_SHARE), last).otherwise(F.lit(limit))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substr(flat, F.lit(1), cut)), F.lit("…")))


def age_phrase(days: Column) -> Column:
    """Days below a month, then months below a year, then years; one month or year is the last one."""
    months, years = F.floor(days / MONTH_DAYS + 0.5), F.floor(days / YEAR_DAYS + 0.5)
    unit = F.when(days < 30, "day").when(months < 12, "month").otherwise("year")
    count = F.when(days < 30, days).when(months < 12, months).otherwise(years)
    near = F.when(days < 0, "just now").when(days < 2, F.element_at(F.array(F.lit("today"), F.lit("yesterday")), (days + 1).cast("int")))
    single = F.when((days >= 30) & (count == 1), F.concat(F.lit("last "), unit))
    return F.coalesce(near, single, F.concat(count.cast("string"), F.lit(" "), unit, F.lit("s ago")))


def freshness(days: Column) -> Column:
    return F.when(days <= FRESH_DAYS, "fresh").when(days <= RECENT_DAYS, "recent").otherwise("older")


def folder_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"/+$", ""))


def folder_anchor(name: Column) -> Column:
    """Element id of a folder's heading, percent-encoded like a URL component."""
    encoded = F.url_encode(F.regexp_replace(F.lower(folder_name(name)), r"\s+", "-"))
    for code, char in (("+", "%20"), ("%7E", "~"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        encoded = F.replace(encoded, F.lit(code), F.lit(char))
    return F.concat(F.lit("section-"), encoded)
