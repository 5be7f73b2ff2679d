"""Markdown bodies as rows: blocks and marks with their places, and what is asked, refused or rewritten as joins over them.

``blocks`` reads every body once (``functions.marks``); links, policy, descriptions, code,
tables and the canonical form are queries over its rows. A rewritten body is the old one
with some spans replaced: ``splice`` cuts it at their places and joins the pieces.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerleaf.functions import labels, marks, outputs, text, urls
from ledgerleaf.operators import bodies, markup
from ledgerleaf.operators import links as graph
from ledgerleaf.sources import shared

TABLE_LINE = r"(?m)^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*$"
LANGUAGE = r"^[A-Za-z0-9_+#.-]+$"
#: The images that a generated page may hold: its own assets.
ASSET = r"^(\.\./){3}assets/generated/[A-Za-z0-9_-]+/image-\d{3}\.(?:gif|jpg|png|svg|webp)$"

_SPAN = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("href_start", pa.int32()), ("href_end", pa.int32()), ("href", pa.string()), ("label", pa.string())]
_BLOCK = pa.schema([
    ("block", pa.int32()), ("kind", pa.string()), ("level", pa.int32()), ("info", pa.string()), ("text", pa.string()), ("plain", pa.string()), ("canonical", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
    ("top", pa.bool_()), ("fenced", pa.bool_()), ("closed", pa.bool_()), ("gap", pa.string()), ("first", pa.string()), ("rest", pa.string()), ("spans", pa.list_(pa.struct(_SPAN))),
])
BLOCKS = (
    "block int, kind string, level int, info string, text string, plain string, canonical string, start int, end int, top boolean, fenced boolean, closed boolean, gap string, first string, rest string, "
    "spans array<struct<kind: string, start: int, end: int, href_start: int, href_end: int, href: string, label: string>>"
)


_NAMES = tuple(_BLOCK.names)
_FIELDS = {f.name: f.type for f in _BLOCK} | {"prose": pa.string()}  # prose: the text of all but code
_DDL = dict(x.split(" ", 1) for x in re.split(r", (?![^<]*>)", BLOCKS)) | {"prose": "string"}
_MARKED = ("paragraph", "heading", "table")
#: So many characters of texts are worked on before their rows are handed on.
_SLICE = 4_000_000


def _read(body: str, fields: Sequence[str] = _NAMES, kinds: Sequence[str] | None = None) -> list[tuple]:
    """``fields`` of the blocks of ``kinds``, or of all; what no field asks for isn't worked out."""
    found = marks.blocks(body)
    marked = not {"plain", "canonical", "spans"}.isdisjoint(fields)
    layout = marks.layout(found) if not {"gap", "first", "rest"}.isdisjoint(fields) else [(None, None, None)] * len(found)
    named = {b.info for b in found if b.kind == "definition"} if marked else set()
    keys = [k for k, _ in _SPAN]
    pick = operator.itemgetter(*(_ALL.index(f) for f in fields))
    rows = []
    for i, (b, (gap, first, rest)) in enumerate(zip(found, layout)):
        if kinds is not None and b.kind not in kinds:
            continue
        source, plain, canonical, spans = b.text, None, None, []
        if b.kind in _MARKED and marked:
            marked_, plain, canonical = marks.inlines(source, named)
            place = lambda x: None if x is None else b.place(x)  # noqa: B023, E731
            spans = [(kind, b.place(s), b.place(e - 1) + 1, place(hs), None if hs is None else b.place(hs) + he - hs, href, label) for kind, s, e, hs, he, href, label in marked_]
        elif b.kind == "definition":
            at = b.lines[0][0]
            spans = [("definition", b.start, b.end, at, at + len(source), marks.unescaped(source), b.info)]
            source = body[b.start : b.end]
        elif b.kind == "html" and marked:
            spans = [("table", b.place(s), b.place(e - 1) + 1, None, None, None, None) for s, e in marks.outer_tables(source)]
        spans = [dict(zip(keys, x)) for x in spans] if "spans" in fields else None
        row = pick((i, b.kind, b.level, b.info, source, plain, canonical, b.start, b.end, not b.holders, bool(b.fence), b.closed, gap, first, rest, spans, None if b.kind == "code" else source))
        rows.append(row if len(fields) > 1 else (row,))
    return rows


_ALL = (*_NAMES, "prose")


def _columns(rows: list[tuple], fields: Sequence[str]) -> list[pa.Array]:
    return [pa.array(c, _FIELDS[f]) for c, f in zip(list(zip(*rows)) or [()] * len(fields), fields)]


def _rows(fields: Sequence[str], kinds: Sequence[str] | None):
    def run(batches):
        for batch in batches:
            rows, owner, size = [], [], 0
            for i, body in enumerate(batch.column(1).to_pylist()):
                new = _read(body or "", fields, kinds)
                rows += new
                owner += [i] * len(new)
                size += len(body or "")
                if len(rows) >= 5_000 or size >= _SLICE or i == len(batch) - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int32())), *_columns(rows, fields)], ["id", *fields])
                    rows, owner, size = [], [], 0

    return run


def blocks(docs: DataFrame, body: str = "body", fields: Sequence[str] = _NAMES, kinds: Sequence[str] | None = None) -> DataFrame:
    """The blocks of the bodies of (id, body) in order, with the marks in them; of ``kinds`` alone, and ``fields`` alone, if these are named.

    kind: heading, paragraph, code, rule, html, table or definition; places count
    characters. ``text`` is without marks of quotations and lists; ``plain`` without any.
    """
    shared.small_batches(docs.sparkSession)
    ddl = ", ".join(f"{f} {_DDL[f]}" for f in fields)
    return docs.select("id", F.col(body).alias("body")).mapInArrow(_rows(tuple(fields), kinds), f"id {dict(docs.dtypes)['id']}, {ddl}")


def with_blocks(docs: DataFrame, body: str, fields: Sequence[str], kinds: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with their ``blocks`` as an array of (fields) beside each body, ``_blocks``: what is told from one body alone needs no shuffle."""
    shared.small_batches(docs.sparkSession)
    fields = tuple(fields)

    def run(bodies: pa.Array) -> pa.Array:
        parts = []
        rows, offsets, size = [], [0], 0
        for i, text_ in enumerate(bodies.to_pylist()):
            rows += _read(text_ or "", fields, kinds)
            offsets.append(len(rows))
            size += len(text_ or "")
            if size >= _SLICE or i == len(bodies) - 1:
                values = pa.StructArray.from_arrays(_columns(rows, fields), list(fields))
                parts.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values))
                rows, offsets, size = [], [0], 0
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.struct([(f, _FIELDS[f]) for f in fields])))

    reader = F.arrow_udf(run, "array<struct<" + ", ".join(f"{f}: {_DDL[f]}" for f in fields) + ">>")
    return docs.withColumn("_blocks", reader(F.col(body)))


def spans(found: DataFrame) -> DataFrame:
    """(id, block, kind, start, end, href_start, href_end, href, label) of the marks of ``blocks``."""
    return found.select("id", "block", F.explode("spans").alias("s")).select("id", "block", "s.*")


@F.arrow_udf(T.StringType())
def _spliced(body: pa.Array, edits: pa.Array) -> pa.Array:
    starts, ends, news = (c.to_pylist() for c in edits.flatten().flatten())
    out, done = [], 0
    for old, n in zip(body.to_pylist(), edits.value_lengths().to_pylist()):
        n = n or 0
        if old is not None and n:
            pieces, at = [], 0
            for start, end, new in zip(starts[done : done + n], ends[done : done + n], news[done : done + n]):
                if start >= at:
                    pieces += [old[at:start], new]
                    at = end
            old = "".join([*pieces, old[at:]])
        out.append(old)
        done += n
    return pa.array(out, pa.string())


def splice(docs: DataFrame, edits: DataFrame, body: str = "body") -> DataFrame:
    """``docs`` with their bodies cut at the places of ``edits`` (id, start, end, new) and put together with what is new.

    Of edits that overlap the first counts; of equal ones the least.
    """
    per = edits.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("start", "end", "new"))).alias("edits"))
    joined = docs.join(per, "id", "left")
    return joined.withColumn(body, _spliced(F.col(body), F.col("edits"))).select(*docs.columns)


def _spliced_rows(rows: DataFrame, edits: Column, body: str) -> DataFrame:
    """As ``splice``, where each row of ``with_blocks`` tells its own edits, an array of (start, end, new): nothing is joined or shuffled."""
    return rows.withColumn(body, _spliced(F.col(body), F.array_sort(F.array_distinct(edits)))).drop("_blocks")


def code_blocks(docs: DataFrame, body: str = "body") -> DataFrame:
    """(id, block, language, code, width): closed fences, numbered from 1; width is of a fence longer than any run of backticks inside.

    A language tag that isn't one plain word is dropped.
    """
    found = blocks(docs, body, ("block", "info", "text", "fenced", "closed"), ("code",)).where("fenced")
    number = F.row_number().over(Window.partitionBy("id").orderBy("block"))
    return found.withColumn("block", number).where("closed").select("id", "block", F.when(F.col("info").rlike(LANGUAGE), F.col("info")).alias("language"), F.col("text").alias("code"), _width().alias("width"))


def _width() -> Column:
    runs = F.transform(F.regexp_extract_all("text", F.lit("`+"), F.lit(0)), lambda r: F.length(r))
    return F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1)


def fence_states(docs: DataFrame, body: str = "body") -> DataFrame:
    """(id, unclosed, prose): whether a fence is open at the end, and the text of all that isn't code."""
    rows = with_blocks(docs.select("id", body), body, ("kind", "fenced", "closed", "prose"))
    open_ = F.exists("_blocks", lambda b: (b["kind"] == "code") & b["fenced"] & ~b["closed"])
    return rows.select("id", open_.alias("unclosed"), F.array_join(F.transform("_blocks", lambda b: b["prose"]), "\n").alias("prose"))


_ENTRY = ("kind", "text", "start", "spans")


def _entries(found: DataFrame) -> DataFrame:
    """(id, kind, start, href, label) of the marks of ``blocks``, and of raw blocks as html with their text as href; one pass over the blocks."""
    own = F.when(F.col("kind") == "html", F.array(F.struct(F.lit("html").alias("kind"), "start", F.col("text").alias("href"), F.lit(None).cast("string").alias("label"))))
    own = own.when(F.col("kind") == "table", F.array(F.struct(F.lit("table_block").alias("kind"), "start", F.lit(None).cast("string").alias("href"), F.lit(None).cast("string").alias("label"))))
    marked = F.transform("spans", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["href"].alias("href"), x["label"].alias("label")))
    return found.select("id", F.explode(F.concat(marked, F.coalesce(own, F.slice(marked, 1, 0)))).alias("s")).select("id", "s.*")


def links(docs: DataFrame, body: str = "body") -> DataFrame:
    """(id, kind, href): links and images outside of code - inline, automatic, by reference, and in raw HTML.

    References meet the definitions of their own document, whatever their case; of
    several definitions the first counts.
    """
    marked = shared.stage(_entries(blocks(docs, body, _ENTRY)), "marks")
    defined = marked.where("kind = 'definition'").groupBy("id", "label").agg(F.min_by("href", "start").alias("defined"))
    direct = marked.where("kind in ('link', 'image', 'autolink')").select("id", "kind", "href")
    referred = marked.where("kind in ('reference', 'image_reference')").join(defined, ["id", "label"]).select("id", "kind", F.col("defined").alias("href"))
    tags = markup.events(marked.where("kind = 'html'").select("id", F.col("href").alias("html"))).where("kind in ('open', 'void') and name in ('a', 'img')")
    own = F.when(F.col("name") == "a", F.col("attributes")["href"]).otherwise(F.col("attributes")["src"])
    raw = tags.select("id", F.when(F.col("name") == "a", "html_link").otherwise("html_image").alias("kind"), own.alias("href")).where("href is not null")
    return direct.unionByName(referred).unionByName(raw)


def policy_issues(docs: DataFrame, body: str = "body", allow_html: bool = False, allow_images: bool = False) -> DataFrame:
    """(id, code), each once: unsupported_html, unsupported_image, unsafe_url.

    Links, automatic links and definitions, used or not, must be safe; images by
    reference are never supported, others only if allowed and one of the page's assets.
    """
    marked = _entries(blocks(docs, body, _ENTRY))
    kind, href = F.col("kind"), F.col("href")
    code = F.when(kind == "image_reference", "unsupported_image").when((kind == "image") & (F.lit(not allow_images) | ~href.rlike(ASSET)), "unsafe_url" if allow_images else "unsupported_image")
    code = code.when(kind.isin("link", "autolink", "definition") & ~urls.safe_in_markdown(href), "unsafe_url")
    if not allow_html:
        code = code.when(kind == "html", "unsupported_html")
    return marked.select("id", code.alias("code")).where("code is not null").distinct()


def fallback_reasons(docs: DataFrame, structures: DataFrame | None = None, body: str = "body") -> DataFrame:
    """(id, reasons): why a body takes the way over an archive, sorted; bodies without reason have no row.

    ``structures``: (id, has_drawings, has_media) of the documents' objects, where known.
    """
    reason = F.when(F.col("kind") == "html", "html").when(F.col("kind") == "table_block", "table").otherwise("image")
    out = _entries(blocks(docs, body, _ENTRY)).where("kind in ('html', 'image', 'image_reference', 'table_block')").select("id", reason.alias("reason"))
    if structures is not None:
        own = F.array_compact(F.array(F.when(F.col("has_drawings"), "embedded_drawing"), F.when(F.col("has_media"), "media_object")))
        out = out.unionByName(structures.select("id", F.explode(own).alias("reason")))
    reasons = F.transform(F.array_sort(F.collect_set("reason")), lambda r: F.concat(F.lit("fallback:"), r))
    return out.groupBy("id").agg(F.array_join(reasons, ",").alias("reasons"))


def plain_text(docs: DataFrame, body: str = "body") -> DataFrame:
    """(id, block, kind, words): the text of every heading, paragraph and table without marks, white space single."""
    found = blocks(docs, body, ("block", "kind", "plain"), _MARKED)
    return found.select("id", "block", "kind", F.trim(F.regexp_replace("plain", r"\s+", " ")).alias("words"))


def descriptions(docs: DataFrame, body: str = "body") -> DataFrame:
    """(id, description): the first paragraph with words that stands in no list or quotation, cut to 200; null without one."""
    found = blocks(docs, body, ("block", "plain", "top"), ("paragraph",)).where("top").withColumn("words", F.trim(F.regexp_replace("plain", r"\s+", " "))).where("words <> ''")
    first = found.groupBy("id").agg(F.min_by("words", "block").alias("words"))
    return docs.select("id").join(first, "id", "left").select("id", labels.description(F.col("words")).alias("description"))


def _comparable(c: Column) -> Column:
    label = labels.label(c)
    compatible = F.coalesce(labels.normalized("NFKC")(F.when(labels.needs_normalizing(label), label)), label)
    return F.lower(F.trim(F.regexp_replace(compatible, r"\s+", " ")))


def normalized_headings(docs: DataFrame, body: str = "body", title: str = "title") -> DataFrame:
    """``docs`` whose first heading, behind rules only, is gone if it repeats the title; other first-level headings become second-level.

    Titles are compared in NFKC, without case, order prefix and white space.
    """
    rows = with_blocks(docs, body, ("block", "kind", "level", "text", "plain", "start", "end", "top"), ("heading", "rule"))
    rows = rows.withColumn("_head", F.get(F.filter("_blocks", lambda b: b["kind"] == "heading"), 0))
    rules = F.size(F.filter("_blocks", lambda b: (b["kind"] == "rule") & (b["block"] < F.col("_head.block"))))
    leads = (F.col("_head.block") == rules) & (F.col("_head.level") == 1) & F.col("_head.top")
    rows = rows.withColumn("_gone", F.coalesce(leads & (_comparable(F.when(leads, F.col("_head.plain"))) == _comparable(F.when(leads, F.col(title)))), F.lit(False)))

    def edit(b: Column) -> Column:
        line = F.concat(F.lit("## "), F.regexp_replace(b["text"], r"\n", " "))
        return F.struct(b["start"].alias("start"), b["end"].alias("end"), F.when(F.col("_gone") & (b["block"] == F.col("_head.block")), "").otherwise(line).alias("new"))

    edits = F.transform(F.filter("_blocks", lambda b: (b["kind"] == "heading") & (b["level"] == 1)), edit)
    return _spliced_rows(rows, edits, body).drop("_head", "_gone").withColumn(body, F.regexp_replace(body, r"^\n+", ""))


def front_matter_issue(content: Column) -> Column:
    """Why a generated file's head is refused, or null: it opens at once, closes, and the marker is the first line after that isn't blank."""
    lines = F.split(content, "\n")
    close = F.array_position(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "---")
    after = F.filter(F.slice(lines, F.greatest(close, F.lit(1)).cast("int") + 2, F.size(lines)), lambda x: F.trim(x) != "")
    return F.when(F.get(lines, 0) != "---", "not_opened").when(close == 0, "not_closed").when(~F.coalesce(F.get(after, 0) == bodies.MARKER, F.lit(False)), "no_marker")


def front_matter_value(content: Column, name: str) -> Column:
    """A quoted value of the head, as text; null if it isn't there or isn't a string."""
    raw = F.regexp_extract(F.regexp_extract(content, r"(?s)^---\n(.*?)\n---\n", 1), rf'(?m)^{name}: ("(?:[^"\\]|\\.)*")$', 1)
    return F.when(raw != "", F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"])


def folder_path(content: Column) -> Column:
    """The folderPath of a file's head as an array of texts, in either way to write lists; null where it isn't one."""
    head = F.regexp_extract(content, r"(?s)^---\n(.*?\n)---(?:\n|$)", 1)
    item = r"(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[A-Za-z][^\n:#,\[\]{}'\"]*)"
    listed = F.regexp_extract(head, rf"(?m)^folderPath:[ \t]*\n((?:[ \t]*-[ \t]+{item}[ \t]*\n)+)(?![ \t]|-)", 1)
    inline = F.regexp_extract(head, rf"(?m)^folderPath:[ \t]*\[([ \t]*(?:{item}(?:[ \t]*,[ \t]*{item})*)?[ \t]*)\][ \t]*\n", 1)
    has_inline = head.rlike(rf"(?m)^folderPath:[ \t]*\[[ \t]*(?:{item}(?:[ \t]*,[ \t]*{item})*)?[ \t]*\][ \t]*\n")

    def value(raw: Column) -> Column:
        double = F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"]
        single = F.replace(F.substr(raw, F.lit(2), F.length(raw) - 2), F.lit("''"), F.lit("'"))
        return F.when(raw.startswith('"'), double).when(raw.startswith("'"), single).otherwise(F.trim(raw))

    lines = F.regexp_extract_all(listed, F.lit(rf"(?m)^[ \t]*-[ \t]+({item})"), F.lit(1))
    found = F.when(listed != "", F.transform(lines, value)).when(has_inline, F.transform(F.regexp_extract_all(inline, F.lit(f"({item})"), F.lit(1)), value))
    return F.when(~F.exists(found, lambda x: x.isNull() | x.rlike("^(?:true|false|null)$")), found)


def published_files(records: DataFrame, slugs: DataFrame) -> DataFrame:
    """(path, content) of the Markdown projections of (id, title, slug, source_url, modified_at, synced_at, content_hash, body).

    Bodies begin with the marker of generated files, or the run ends with an error; links
    to pages of the site lead to these pages' Markdown; five fields stand in the head.
    """
    marker = bodies.MARKER
    owned = (F.col("body") == marker) | F.col("body").startswith(f"{marker}\n")
    clean = F.regexp_replace(F.substr("body", F.lit(len(marker) + 1)), r"^\s+|\s+$", "")
    checked = records.withColumn("body", F.when(owned, clean).otherwise(F.raise_error(F.concat(F.lit("no marker in document "), F.col("id").cast("string")))))
    made = published(checked, slugs)
    head = outputs.front_matter({name: F.col(name) for name in ("title", "source_url", "modified_at", "synced_at", "content_hash")})
    content = F.concat(head, F.lit("\n# "), text.escape_heading(F.col("title")), F.lit("\n"), F.when(F.col("body") != "", F.concat(F.lit("\n"), "body", F.lit("\n"))).otherwise(""))
    return made.select(F.concat("slug", F.lit("/index.md")).alias("path"), content.alias("content"))


def document_links(docs: DataFrame, body: str = "body") -> DataFrame:
    """(id, start, end, href): where the targets of links and definitions stand."""
    return spans(blocks(docs, body, ("block", "spans"), (*_MARKED, "definition"))).where("kind in ('link', 'definition')").select("id", F.col("href_start").alias("start"), F.col("href_end").alias("end"), "href")


def internal_links(docs: DataFrame, slugs: DataFrame, body: str = "body") -> DataFrame:
    """(id, start, end, href, new): links of bodies to known pages, led to their Markdown, with query and fragment."""
    found = document_links(docs, body)
    parts = found.select("*", F.regexp_extract("href", r"^/([^?#]*?)/?(?:[?#].*)?$", 1).alias("slug"), F.regexp_extract("href", r"^[^?#]*(.*)$", 1).alias("rest"))
    local = parts.where(F.col("href").startswith("/") & ~F.col("href").startswith("//"))
    return local.join(slugs.select("slug"), "slug").select("id", "start", "end", "href", F.concat(F.lit("/"), "slug", F.lit("/index.md"), "rest").alias("new"))


def published(docs: DataFrame, slugs: DataFrame, body: str = "body") -> DataFrame:
    """``docs`` with their links to known pages led to these pages' Markdown."""
    return splice(docs, internal_links(docs, slugs, body).select("id", "start", "end", "new"), body)


def with_document_links(docs: DataFrame, slugs: DataFrame, body: str = "body") -> DataFrame:
    """``docs`` whose links to documents (id, slug) of the service are their addresses, and redirects unwrapped."""
    rewritten = graph.rewritten(document_links(docs, body).withColumnRenamed("id", "owner"), slugs)
    return splice(docs, rewritten.where("new_href <> href").select(F.col("owner").alias("id"), "start", "end", F.col("new_href").alias("new")), body)


def diagram(code: Column, language: Column) -> Column:
    """The container of a diagram's source; null for other code."""
    return F.when(language == "mermaid", F.concat(F.lit('<div class="diagram" data-diagram="'), text.escape_html(code), F.lit('"><pre>'), text.escape_html(code), F.lit("</pre></div>")))


def with_diagrams(docs: DataFrame, body: str = "body") -> DataFrame:
    """``docs`` with their diagram fences as containers."""
    rows = with_blocks(docs, body, ("info", "text", "start", "end", "fenced"), ("code",))
    container = lambda b: diagram(b["text"], F.regexp_extract(b["info"], r"^(\S*)", 1))
    edits = F.transform(F.filter("_blocks", lambda b: b["fenced"]), lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), container(b).alias("new")))
    return _spliced_rows(rows, F.filter(edits, lambda e: e["new"].isNotNull()), body)


@F.pandas_udf(T.StringType())
def restored_code(body: pd.Series) -> pd.Series:
    """Bodies whose code an export has escaped, with their fences and spans back (``marks.restored``)."""
    return body.map(marks.restored, na_action="ignore")


def wrapped_tables(docs: DataFrame, body: str = "body") -> DataFrame:
    """``docs`` with each Markdown table, and each outermost closed table of raw HTML, in a container that can scroll; code stays."""
    rows = with_blocks(docs, body, ("kind", "start", "end", "top", "spans"), ("table", "html"))
    ends = lambda start, end, inner: F.array(F.struct(start.alias("start"), start.alias("end"), F.lit(f'<div class="table">{inner}').alias("new")), F.struct(end.alias("start"), end.alias("end"), F.lit(f"{inner}</div>").alias("new")))
    none = F.array().cast("array<struct<start: int, end: int, new: string>>")
    whole = lambda b: F.when((b["kind"] == "table") & b["top"], ends(b["start"], b["end"], "\n\n")).otherwise(none)
    raw = lambda b: F.flatten(F.transform(F.filter(b["spans"], lambda x: x["kind"] == "table"), lambda x: ends(x["start"], x["end"], "")))
    return _spliced_rows(rows, F.flatten(F.transform("_blocks", lambda b: F.concat(whole(b), raw(b)))), body)


def canonical(docs: DataFrame, body: str = "body") -> DataFrame:
    """``docs`` in one way to write: hyphens and numbers for items, asterisks for emphasis, number signs for headings, fences for code, single blank lines.

    Items are indented by their marker alone; a second time changes nothing.
    """
    fence = F.repeat(F.lit("`"), _width())
    shown = (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.regexp_replace("canonical", r"\\?\n", " "))).when(F.col("kind") == "rule", "---")
        .when(F.col("kind") == "code", F.concat(fence, F.col("info"), F.lit("\n"), F.when(F.col("text") != "", F.concat("text", F.lit("\n"))).otherwise(""), fence)).otherwise(F.coalesce("canonical", "text"))
    )
    lines = F.transform(F.split(shown, "\n"), lambda line, i: F.when(F.col("kind") == "code", F.regexp_replace(F.concat(F.when(i == 0, F.col("first")).otherwise(F.col("rest")), line), r"^\s+$", "")).otherwise(F.rtrim(F.concat(F.when(i == 0, F.col("first")).otherwise(F.col("rest")), line))))
    pieces = blocks(docs, body).select("id", "block", F.concat("gap", F.array_join(lines, "\n")).alias("piece"))
    made = pieces.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda p: p["piece"]), "").alias("_made"))
    return docs.join(made, "id", "left").withColumn(body, F.coalesce("_made", F.lit(""))).select(*docs.columns)
