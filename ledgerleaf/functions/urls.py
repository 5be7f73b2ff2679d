"""Column functions on URLs: the link policy, redirect unwrapping, document links and routes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerleaf.functions import labels

SCHEME = r"(?i)^[a-z][a-z0-9+.-]*:"
SAFE_SCHEME = r"(?i)^(https?|mailto):"
CONTROL = r"[\x00-\x1F\x7F]"
#: The hosts whose /url path redirects, and the patterns of links to documents.
REDIRECT = r"^https?://(?:www\.)?google\.com/url\?(.*?)(?:#.*)?$"
DOCUMENT = r"^https://docs\.google\.com/document/d/([^/?#]+)/(?:edit|view)/?(?:\?[^#]*)?(#.*)?$"
OPENED = r"^https://drive\.google\.com/open/*\?(?:[^#]*&)?id=([^&#]+)[^#]*(#.*)?$"
DOCUMENT_ID = r"^[A-Za-z0-9_-]+$"
READABLE_ANCHOR = r"^#[A-Za-z][A-Za-z0-9_-]*$"
PROVIDER_ANCHOR = r"^#(heading=|bookmark=|h\.|id\.)"


def allowed(url: Column) -> Column:
    """Not empty, no blanks around it, no ``//``, backslash or control character; relative or of a safe scheme."""
    shape = (F.length(url) > 0) & (url == F.trim(url)) & ~url.startswith("//") & ~url.contains("\\") & ~url.rlike(CONTROL)
    return shape & (~url.rlike(SCHEME) | url.rlike(SAFE_SCHEME))


def safe_in_markdown(url: Column) -> Column:
    """In NFKC, without blanks, control and format characters: an anchor, a path that begins with a slash or dots, or a safe scheme.

    Unlike ``allowed`` bare words are refused.
    """
    compatible = F.coalesce(labels.normalized("NFKC")(F.when(labels.needs_normalizing(url), url)), url)
    plain = F.regexp_replace(compatible, r"[\s\p{Cc}\p{Cf}\p{Z}]+", "")
    local = plain.startswith("#") | plain.startswith("./") | plain.startswith("../") | (plain.startswith("/") & ~plain.startswith("//"))
    return local | plain.rlike(SAFE_SCHEME)


def unwrapped(url: Column) -> Column:
    """The target of a search redirect, or null where the URL is none or its target isn't an allowed absolute one."""
    query = F.regexp_extract(url, REDIRECT, 1)
    values = [F.regexp_extract(query, rf"(?:^|&){key}=([^&]*)", 1) for key in ("q", "url")]
    target = F.try_url_decode(F.when(query.rlike("(?:^|&)q="), values[0]).otherwise(values[1]))
    return F.when(url.rlike(REDIRECT) & (target != "") & allowed(target) & target.rlike(SAFE_SCHEME), target)


def document_id(url: Column) -> Column:
    found = F.when(url.rlike(DOCUMENT), F.regexp_extract(url, DOCUMENT, 1)).when(url.rlike(OPENED), F.regexp_extract(url, OPENED, 1))
    return F.when(found.rlike(DOCUMENT_ID), found)


def fragment(url: Column) -> Column:
    """``#...`` of a URL, where readers can have written it; else empty."""
    raw = F.regexp_extract(url, r"(#.*)$", 1)
    return F.when(raw.rlike(READABLE_ANCHOR) & ~raw.rlike(PROVIDER_ANCHOR), raw).otherwise(F.lit(""))


def route(url: Column, source: Column) -> Column:
    """The site path that a link of the page ``/source/`` leads to, without slashes around it; null if it leads elsewhere."""
    plain = F.regexp_replace(url, r"[?#].*$", "")
    absolute = F.when(plain.startswith("/"), plain).otherwise(F.concat(F.lit("/"), source, F.lit("/"), plain))
    kept = F.aggregate(
        F.split(absolute, "/"),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part.isin("", "."), done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part))),
    )
    path = F.array_join(kept, "/")
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    outside = url.isNull() | (url == "") | url.startswith("#") | url.startswith("//") | url.rlike(SCHEME)
    return F.when(~outside, decoded)


def asset_path(href: Column, folder: Column) -> Column:
    """The archive path that a relative reference of a page in ``folder`` means; null where it leads out of the archive or isn't plain.

    Refused: schemes, absolute paths, queries, fragments, backslashes, control
    characters, broken or doubly encoded escapes, and ways above the archive's root. Paths
    are in NFC.
    """
    decoded = F.try_url_decode(F.replace(href, F.lit("+"), F.lit("%2B")))
    plain = href.isNotNull() & (href != "") & ~href.rlike(SCHEME) & ~href.startswith("/") & ~href.rlike(r"[?#]") & ~href.rlike(r"%(?![0-9A-Fa-f]{2})")
    safe = plain & ~decoded.contains("\\") & ~decoded.rlike(CONTROL) & ~decoded.contains("%") & ~decoded.startswith("/")
    parts = F.split(F.concat(F.coalesce(folder, F.lit("")), F.lit("/"), decoded), "/")
    walked = F.aggregate(
        parts,
        F.struct(F.array().cast("array<string>").alias("path"), F.lit(True).alias("inside")),
        lambda s, x: F.when(x.isin("", "."), s)
        .when(x == "..", F.struct(F.slice(s["path"], F.lit(1), F.greatest(F.size(s["path"]) - 1, F.lit(0))).alias("path"), (s["inside"] & (F.size(s["path"]) > 0)).alias("inside")))
        .otherwise(F.struct(F.concat(s["path"], F.array(x)).alias("path"), s["inside"].alias("inside"))),
    )
    return labels.composed(F.when(safe & walked["inside"] & (F.size(walked["path"]) > 0), F.array_join(walked["path"], "/")))


def https_origin(url: Column) -> Column:
    """Whether a URL is an HTTPS origin alone, without user, path, query or fragment."""
    return url.rlike(r"^https://[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?(?::\d{1,5})?/?$")


def safe_slug(slug: Column) -> Column:
    """Whether all parts are letters and digits with single hyphens between."""
    return slug.rlike(r"^[\p{L}\p{N}]+(?:-+[\p{L}\p{N}]+)*(?:/[\p{L}\p{N}]+(?:-+[\p{L}\p{N}]+)*)*$")


def readable_fragment(url: Column) -> Column:
    """The decoded fragment with which readers can have marked a place; null for the service's own, unreadable or broken ones."""
    decoded = F.try_url_decode(F.replace(F.regexp_extract(url, r"#(.*)$", 1), F.lit("+"), F.lit("%2B")))
    marked = F.concat(F.lit("#"), decoded)
    return F.when(marked.rlike(READABLE_ANCHOR) & ~marked.rlike(PROVIDER_ANCHOR), decoded)
