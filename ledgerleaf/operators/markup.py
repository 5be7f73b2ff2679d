"""HTML as a tree of intervals: pages as rows of events, and what is kept, refused or rewritten as joins and windows over them.

``events`` gives every page's tags and texts in order, with the element each belongs to
and the elements around it. It is the one step in Python: a tokenizer and a stack of
open elements that closes what HTML closes without a tag (paragraphs before blocks, list
items, cells), so that elements always nest. An element is the interval between its
first and its last event. From there on all is Spark: containment is a running sum of
opened and closed elements, lists and quotations of a block are joined by the elements
around it, tables and rows are groups, and pages are put together from their pieces.

A page is one group of the windows here, as it was one row; no window spans pages.
Formatting that a page leaves open ends with the block it stands in.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.functions import urls
from ledgerleaf.sources import shared

# Elements that stay, those that go with all they contain, and the attributes that stay.
ALLOWED = ("a", "blockquote", "br", "code", "del", "div", "em", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "img", "li", "ol", "p", "pre", "span", "strong", "sub", "sup", "table", "tbody", "td", "th", "thead", "tr", "ul")
REMOVED = ("embed", "form", "iframe", "object", "script", "style")
ATTRIBUTES = {"a": ("href", "title"), "img": ("alt", "src", "title"), "td": ("colspan", "rowspan"), "th": ("colspan", "rowspan")}
# Rules of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
HEAD = frozenset("base head link meta noscript script style title".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOUNDS = {
    "li": ({"li"}, {"ol", "ul", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}), "a": ({"a"}, {"td", "th", "table"}),
}
CELLS = frozenset("td th caption table".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<[/a-zA-Z][^>]*\Z|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)>", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?")

EVENTS = "at int, kind string, name string, text string, attributes map<string,string>, node int, path array<int>"
_KINDS = pa.schema([("at", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("text", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("node", pa.int32()), ("path", pa.list_(pa.int32()))])


def _attributes(source: str) -> list[tuple[str, str]]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        value = m[2] or ""
        found.setdefault(m[1].lower(), html.unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return list(found.items())


def _parsed(page: str) -> Iterator[tuple]:
    """(kind, name, text, attributes, element, elements around it and itself) of a page in order; kind is open, close, void, text or comment."""
    stack: list[tuple[str, int]] = []
    count = at = 0

    def path() -> list[int]:
        return [n for _, n in stack]

    def closed(to: int) -> Iterator[tuple]:
        while len(stack) > to:
            name, node = stack[-1]
            yield "close", name, None, None, node, path()
            stack.pop()

    def last(names, until) -> int | None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in until:
                return None
        return None

    def text(start: int, end: int, raw: bool = False) -> Iterator[tuple]:
        if start < end:
            yield "text", None, page[start:end] if raw else html.unescape(page[start:end]), None, stack[-1][1] if stack else None, path()

    while m := TOKEN.search(page, at):
        yield from text(at, m.start())
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            yield "comment", None, None, None, None, path()
        elif m[1]:
            found = last(HEADINGS if name in HEADINGS else {name}, CELLS - {name} if name != "table" else ())
            if found is not None:
                yield from closed(found)
        else:
            if name in CLOSES_P and (p := last({"p"}, CELLS)) is not None:
                yield from closed(p)
            if name in BOUNDS and (i := last(*BOUNDS[name])) is not None:
                yield from closed(i)
            count += 1
            attributes = _attributes(m[3])
            if name in VOID:
                yield "void", name, None, attributes, count, [*path(), count]
                continue
            stack.append((name, count))
            yield "open", name, None, attributes, count, path()
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                yield from text(at, end.start() if end else len(page), name not in ("title", "textarea"))
                at = end.end() if end else len(page)
                yield from closed(len(stack) - 1)
    yield from text(at, len(page))
    yield from closed(0)


def _rows(batches):
    """In: the id as it is, and html; out: its events."""
    for batch in batches:
        rows, owner = [], []
        for i, page in enumerate(batch.column(1).to_pylist()):
            for at, event in enumerate(_parsed(page or "")):
                rows.append((at, *event))
                owner.append(i)
            if len(rows) >= 20_000 or i == len(batch) - 1:
                columns = list(zip(*rows)) or [()] * len(_KINDS)
                arrays = [pa.array(c, f.type) for c, f in zip(columns, _KINDS)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int32())), *arrays], ["id", *_KINDS.names])
                rows, owner = [], []


def events(pages: DataFrame) -> DataFrame:
    """(id, at, kind, name, text, attributes, node, path) of pages (id, html); null pages have no events."""
    shared.small_batches(pages.sparkSession)
    return pages.select("id", "html").mapInArrow(_rows, f"id {dict(pages.dtypes)['id']}, {EVENTS}")


def _so_far(*by: str) -> Window:
    return Window.partitionBy("id", *by).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)


def _inside(condition: Column) -> Column:
    """How many open elements of ``condition`` an event stands in, its own included."""
    opened = F.sum(F.when(condition & (F.col("kind") == "open"), 1).otherwise(0)).over(_so_far())
    closed = F.sum(F.when(condition & (F.col("kind") == "close"), 1).otherwise(0)).over(_so_far())
    return opened - closed + F.when(condition & (F.col("kind") == "close"), 1).otherwise(0)


def body_events(found: DataFrame) -> DataFrame:
    """Events of the body: without the head, and what stands in for one at the start."""
    head = F.coalesce(F.col("name").isin("head") | (F.col("name").isin(*HEAD) & ~F.col("started")), F.lit(False))
    content = (F.col("kind").isin("open", "void") & ~F.col("name").isin(*HEAD, "html")) | ((F.col("kind") == "text") & ~F.col("in_head") & F.col("text").rlike(r"\S"))
    rows = found.withColumn("in_head", _inside(F.coalesce(F.col("name").isin(*HEAD), F.lit(False))) > 0)
    rows = rows.withColumn("started", F.coalesce(F.max(content & ~F.col("in_head")).over(_so_far()), F.lit(False)))
    rows = rows.withColumn("gone", (_inside(head) > 0) | (head & (F.col("kind") == "void")) | F.coalesce(F.col("name").isin("html", "body"), F.lit(False)))
    return rows.where(~F.col("gone") & (F.col("started") | (F.col("kind") == "comment"))).drop("in_head", "started", "gone")


def _refused(name: str) -> Column:
    """Attributes of an event that its element may not have."""
    allowed = F.create_map(*(x for k, v in ATTRIBUTES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    own = F.coalesce(F.try_element_at(allowed, F.col("name")), F.array().cast("array<string>"))
    return F.map_filter(name, lambda k, v: ~F.array_contains(own, k))


def _unsafe(k: Column, v: Column) -> Column:
    return (k == "href") & ~F.coalesce(urls.allowed(v), F.lit(False))


def _bad_span(k: Column, v: Column) -> Column:
    return k.isin("colspan", "rowspan") & ~v.rlike(r"^[1-9]\d{0,2}$")


def kept_events(found: DataFrame) -> DataFrame:
    """Events of the body that stay, with the attributes that stay.

    Elements of REMOVED go with their content, other unknown ones leave theirs; comments go.
    """
    rows = body_events(found)
    removed = F.coalesce(F.col("name").isin(*REMOVED), F.lit(False))
    rows = rows.withColumn("removed", (_inside(removed) > 0) | removed)
    rows = rows.where(~F.col("removed") & (F.col("kind") != "comment") & (F.col("name").isNull() | F.col("name").isin(*ALLOWED)))
    refused = F.map_keys(_refused("attributes"))
    kept = F.map_filter("attributes", lambda k, v: ~F.array_contains(refused, k) & ~_unsafe(k, v) & ~_bad_span(k, v))
    return rows.withColumn("attributes", kept).drop("removed")


def warnings(found: DataFrame) -> DataFrame:
    """(id, code) of what sanitizing takes away, each once a page."""
    removed = F.coalesce(F.col("name").isin(*REMOVED), F.lit(False))
    rows = body_events(found).withColumn("depth", _inside(removed)).where("kind in ('open', 'void')")
    known = F.col("name").isin(*ALLOWED)
    stays = known & (F.col("depth") == 0)
    codes = F.array_compact(F.array(
        F.when(~known, "removed_unsupported_html"),
        F.when(stays & (F.size(_refused("attributes")) > 0), "removed_unsafe_html_attribute"),
        F.when(stays & (F.col("name") == "a") & F.exists(F.map_entries("attributes"), lambda e: _unsafe(e["key"], e["value"])), "removed_unsafe_link"),
        F.when(stays & F.col("name").isin("td", "th") & F.exists(F.map_entries("attributes"), lambda e: _bad_span(e["key"], e["value"])), "removed_invalid_table_span"),
    ))
    return rows.select("id", F.explode(codes).alias("code")).distinct()


def _escaped(text: Column, quote: bool = False) -> Column:
    for old, new in (("&", "&amp;"), ("\u00a0", "&nbsp;"), *((('"', "&quot;"),) if quote else (("<", "&lt;"), (">", "&gt;")))):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _html() -> Column:
    """An event as HTML; attributes by name."""
    attributes = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), _escaped(e["value"], True), F.lit('"'))), "")
    opened = F.concat(F.lit("<"), "name", F.coalesce(attributes, F.lit("")), F.lit(">"))
    return F.when(F.col("kind") == "text", _escaped(F.col("text"))).when(F.col("kind") == "close", F.concat(F.lit("</"), "name", F.lit(">"))).otherwise(opened)


def _joined(pieces: Column, by: str = "at") -> Column:
    """Aggregate: ``pieces`` put together in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, pieces.alias("piece")))), lambda p: p["piece"]), "")


def sanitized(pages: DataFrame) -> DataFrame:
    """(id, html) of every page of (id, html): its body with allowed elements and attributes, all elements closed."""
    made = as_html(kept_events(events(pages)))
    return pages.select("id").join(made, "id", "left").select("id", F.coalesce("html", F.lit("")).alias("html"))


def as_html(kept: DataFrame) -> DataFrame:
    """(id, html) of pages by their events."""
    return kept.groupBy("id").agg(F.regexp_replace(_joined(_html()), r"^\s+|\s+$", "").alias("html"))


def images(kept: DataFrame) -> DataFrame:
    """(id, position, src, alt) of the images among events, numbered from 0."""
    found = kept.where("kind = 'void' and name = 'img'")
    place = F.row_number().over(Window.partitionBy("id").orderBy("at")) - 1
    return found.select("id", place.alias("position"), F.col("attributes")["src"].alias("src"), F.col("attributes")["alt"].alias("alt"))


def with_images(kept: DataFrame, images: DataFrame) -> DataFrame:
    """Events with the sources of ``bodies.archive_images`` (id, position, file, alt, issue): images with a file get it, others go."""
    rows = kept.withColumn("position", F.when(F.col("name") == "img", F.count_if(F.col("name") == "img").over(_so_far()) - 1).cast("int"))
    joined = rows.join(images.select("id", "position", "file", F.col("alt").alias("new_alt")), ["id", "position"], "left").where("coalesce(name, '') <> 'img' or file is not null")
    named = F.map_concat(F.map_filter("attributes", lambda k, v: ~k.isin("src", "alt")), F.create_map(F.lit("src"), F.col("file"), F.lit("alt"), F.col("new_alt")))
    return joined.withColumn("attributes", F.when(F.col("name") == "img", named).otherwise(F.col("attributes"))).drop("position", "file", "new_alt")


def tables(kept: DataFrame) -> DataFrame:
    """(id, at, node, complex, html, markdown): every outermost table, by its first event.

    A table is complex, and stays HTML, if it holds a table, image, list or preformatted
    text, a cell of more than one row or column, no rows, or rows of different lengths.
    ``markdown`` is that of simple ones: the first row is the head.
    """
    return _tables(_tabled(kept))


def _tables(tabled: DataFrame) -> DataFrame:
    rows = tabled.where("table is not null")
    span = F.exists(F.map_entries("attributes"), lambda e: e["key"].isin("colspan", "rowspan") & (e["value"] != "1"))
    opened = F.col("kind").isin("open", "void")
    whole = rows.groupBy("id", "table").agg(
        F.min("at").alias("at"), _joined(_html()).alias("html"), F.count_if((F.col("kind") == "open") & (F.col("name") == "tr")).alias("n_rows"),
        F.coalesce(F.bool_or(opened & (F.col("name").isin("img", "ol", "pre", "ul") | ((F.col("name") == "table") & (F.col("node") != F.col("table"))) | (F.col("name").isin("td", "th") & span))), F.lit(False)).alias("nested"),
    )
    parent = F.try_element_at("path", F.lit(-2))
    cells = rows.where("kind = 'open' and name in ('td', 'th')").select("id", "table", "node", parent.alias("row"))
    texts = rows.where("kind = 'text'").select("id", "table", F.explode("path").alias("node"), "at", "text")
    said = cells.join(texts, ["id", "table", "node"], "left").groupBy("id", "table", "row", "node").agg(_joined(F.coalesce("text", F.lit(""))).alias("text"))
    plain = F.replace(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("|"), F.lit("\\|"))
    lines = said.withColumn("text", plain).groupBy("id", "table", "row").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "text"))), lambda c: c["text"]), " | ").alias("cells"))
    all_rows = rows.where("kind = 'open' and name = 'tr'").select("id", "table", F.col("node").alias("row")).join(lines, ["id", "table", "row"], "left")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row", F.coalesce("n", F.lit(0)).alias("n"), F.concat(F.lit("| "), F.coalesce("cells", F.lit("")), F.lit(" |")).alias("line")))), lambda r: r)
    grouped = all_rows.groupBy("id", "table").agg(ordered.alias("lines"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.get("lines", 0)["n"].cast("int")))
    head, rest = F.slice("lines", 1, 1), F.slice("lines", F.lit(2), F.size("lines"))
    markdown = F.array_join(F.concat(F.transform(head, lambda r: r["line"]), F.array(rule), F.transform(rest, lambda r: r["line"])), "\n")
    out = whole.join(grouped, ["id", "table"], "left")
    ragged = F.coalesce(F.size(F.array_distinct(F.transform("lines", lambda r: r["n"]))) != 1, F.lit(True))
    out = out.withColumn("complex", F.col("nested") | ragged)
    return out.select("id", "at", F.col("table").alias("node"), "complex", "html", F.when(~F.col("complex"), markdown).alias("markdown"))


def _tabled(kept: DataFrame) -> DataFrame:
    """Adds table: the outermost table an event stands in, or null."""
    is_table = F.coalesce(F.col("name") == "table", F.lit(False))
    rows = kept.withColumn("depth", _inside(is_table))
    first = F.last(F.when(is_table & (F.col("kind") == "open") & (F.col("depth") == 1), F.col("node")), True).over(_so_far())
    return rows.withColumn("table", F.when(F.col("depth") > 0, first)).drop("depth")


def _longest_run(text: str) -> Column:
    """The most backticks in a row."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), lambda r: F.length(r))), F.lit(0))


_BLOCKS = ("blockquote", "div", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "li", "ol", "p", "pre", "table", "ul")
_MARKS = {"em": "*", "strong": "**", "del": "~~"}


def _inline() -> Column:
    """An event within a block as Markdown."""
    opened, name = F.col("kind") == "open", F.col("name")
    text = F.when(F.col("pre") > 0, F.col("text")).when(F.col("code") > 0, F.regexp_replace("text", r"\s+", " ")).otherwise(F.regexp_replace(F.regexp_replace("text", r"([\\*_`\[\]<])", r"\\$1"), r"\s+", " "))
    title = F.coalesce(F.concat(F.lit(' "'), F.replace(F.col("attributes")["title"], F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit(""))
    target = lambda c: F.when(c.rlike(r"[\s()<>]"), F.concat(F.lit("<"), F.regexp_replace(c, r"([<>])", r"\\$1"), F.lit(">"))).otherwise(c)
    image = F.concat(F.lit("!["), F.regexp_replace(F.coalesce(F.col("attributes")["alt"], F.lit("")), r"([\\\[\]])", r"\\$1"), F.lit("]("), target(F.col("attributes")["src"]), title, F.lit(")"))
    linked = F.col("href").isNotNull()
    ticks, room = F.repeat(F.lit("`"), F.col("ticks") + 1), F.when(F.col("ticks") > 0, " ").otherwise("")
    mark = F.lit("")
    for element, sign in _MARKS.items():
        mark = F.when((name == element) & (F.col("pre") == 0), F.lit(sign)).otherwise(mark)
    link = F.when(opened, F.lit("[")).otherwise(F.concat(F.lit("]("), target(F.col("href")), F.col("link_title"), F.lit(")")))
    return (
        F.when(F.col("kind") == "text", text).when(name == "img", F.coalesce(image, F.lit(""))).when((name == "br") & (F.col("pre") > 0), "\n").when(name == "br", "\\\n")
        .when((name == "a") & linked, link).when((name == "code") & (F.col("pre") == 0), F.when(opened | (F.col("ticks") == 0), F.concat(ticks, room)).otherwise(F.concat(room, ticks))).otherwise(mark)
    )


def to_markdown(kept: DataFrame) -> DataFrame:
    """(id, markdown) of pages by their kept events.

    Headings, paragraphs, quotations, fenced code, rules, nested bullet and numbered
    lists, emphasis, links, images, simple tables with pipes; complex tables stay HTML.
    Blocks are apart by an empty line, items that hold no paragraphs by a line end.
    """
    tabled = shared.stage(_tabled(kept), "tabled")  # these are read several times, so each is a table
    placed = _tables(tabled).select("id", "at", F.when(F.col("complex"), F.col("html")).otherwise(F.col("markdown")).alias("table_text"))
    outside = tabled.where("table is null or node = table")
    rows = outside.join(placed, ["id", "at"], "left")
    own = F.when((F.col("kind") == "open") & (F.col("name") == "a"), F.struct(F.col("attributes")["href"].alias("href"), F.coalesce(F.concat(F.lit(' "'), F.replace(F.col("attributes")["title"], F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit("")).alias("title")))
    link = F.first(own, True).over(Window.partitionBy("id", "node"))
    rows = rows.withColumn("link", F.when(F.col("name") == "a", link)).withColumn("href", F.col("link.href")).withColumn("link_title", F.col("link.title"))
    boundary = F.coalesce(F.col("name").isin(*_BLOCKS), F.lit(False))
    rows = rows.withColumns({"block": F.count_if(boundary).over(_so_far()), "pre": _inside(F.coalesce(F.col("name") == "pre", F.lit(False))), "code": _inside(F.coalesce(F.col("name") == "code", F.lit(False)))})
    code_node = F.last(F.when((F.col("name") == "code") & (F.col("kind") == "open"), F.col("node")), True).over(_so_far())
    rows = rows.withColumn("code_node", F.when(F.col("code") > 0, code_node))
    rows = shared.stage(rows.withColumn("ticks", F.coalesce(F.max(_longest_run("text")).over(Window.partitionBy("id", "code_node")), F.lit(0))), "inlines")
    piece = F.when(F.col("table_text").isNotNull(), F.col("table_text")).when(F.col("name") == "hr", "---").when(boundary, "").otherwise(_inline())
    # a block's containers are those around the first event that stands in it
    within = F.when((F.col("kind") == "close") & boundary, F.slice("path", F.lit(1), F.size("path") - 1)).otherwise(F.col("path"))
    blocks = rows.groupBy("id", "block").agg(
        F.min_by(within, "at").alias("path"), _joined(piece).alias("text"), F.max(F.when(boundary, 0).otherwise(F.col("pre"))).alias("pre"), F.bool_or(F.col("table_text").isNotNull()).alias("is_table"), F.bool_or(F.coalesce(F.col("kind") == "text", F.lit(False))).alias("has_text"),
    )
    in_pre = (F.col("pre") > 0) & F.col("has_text")
    text = F.when(F.col("is_table") | in_pre, F.col("text")).otherwise(F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.col("text")), r" *\\\n *", "\\\\\n"), r"(?:\\\n)+$", "")))
    blocks = blocks.withColumns({"text": text, "in_pre": in_pre}).where("text <> ''")
    elements = rows.where("kind in ('open', 'void') and name is not null").select("id", "node", "name", F.try_element_at("path", F.lit(-2)).alias("parent"), "at")
    items = elements.where("name = 'li'").withColumn("number", F.row_number().over(Window.partitionBy("id", "parent").orderBy("at")))
    kinds = elements.select("id", F.col("node").alias("parent"), F.col("name").alias("list"))
    items = items.select("id", "node", "parent", "number").join(kinds, ["id", "parent"], "left").select("id", "node", F.when(F.col("list") == "ol", F.concat("number", F.lit(". "))).otherwise(F.lit("- ")).alias("marker"))
    around = blocks.select("id", "block", F.posexplode("path").alias("depth", "node")).join(elements.select("id", "node", "name"), ["id", "node"]).join(items, ["id", "node"], "left")
    first = Window.partitionBy("id", "node").orderBy("block")
    around = around.withColumn("first", F.row_number().over(first) == 1)
    container = F.col("name").isin("li", "blockquote")
    starts = F.when(F.col("name") == "blockquote", "> ").when(F.col("name") == "li", F.when(F.col("first"), F.col("marker")).otherwise(F.repeat(F.lit(" "), F.length("marker"))))
    goes_on = F.when(F.col("name") == "blockquote", "> ").when(F.col("name") == "li", F.repeat(F.lit(" "), F.length("marker")))
    block_name = F.when(F.col("name").isin(*_BLOCKS), F.col("name"))
    context = around.groupBy("id", "block").agg(
        _joined(F.when(container, starts).otherwise(""), "depth").alias("start"), _joined(F.when(container, goes_on).otherwise(""), "depth").alias("indent"),
        F.max_by("name", F.when(block_name.isNotNull(), F.col("depth"))).alias("element"), F.min_by("node", F.when(F.col("name").isin("ul", "ol"), F.col("depth"))).alias("list"),
    )
    placed_blocks = blocks.join(context, ["id", "block"], "left").fillna("", ["start", "indent", "element"])
    level = F.regexp_extract("element", r"^h([1-6])$", 1)
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), _longest_run("text") + 1))
    guarded = F.regexp_replace("text", r"(?m)^(#{1,6}(?=\s|$)|[-+](?=\s|$)|>|~{3,}|[-=]{2,}$)", r"\\$1")
    guarded = F.regexp_replace(guarded, r"(?m)^(\d{1,9})([.)])(?=\s|$)", r"$1\\$2")
    shown = (
        F.when(F.col("in_pre"), F.concat(fence, F.lit("\n"), F.regexp_replace("text", r"^\n|\n$", ""), F.lit("\n"), fence)).when(F.col("is_table") | (F.col("text") == "---"), F.col("text"))
        .when(level != "", F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "), F.regexp_replace("text", r"\\?\n", " "))).otherwise(guarded)
    )
    lines = F.split(shown, "\n")
    spread = F.transform(lines, lambda line, i: F.rtrim(F.concat(F.when(i == 0, F.col("start")).otherwise(F.col("indent")), line)))
    order = Window.partitionBy("id").orderBy("block")
    tight = (F.col("element") == "li") & (F.col("list") == F.lag("list").over(order)) & (F.lag("element").over(order) == "li")
    gap = F.when(F.lag("block").over(order).isNull(), "").when(F.coalesce(tight, F.lit(False)), "\n").otherwise(F.concat(F.lit("\n"), F.rtrim(F.when(F.col("start").startswith("> ") & F.lag("start").over(order).startswith("> "), F.lit(">")).otherwise(F.lit(""))), F.lit("\n")))
    made = placed_blocks.withColumn("piece", F.concat(gap, F.array_join(spread, "\n")))
    return made.groupBy("id").agg(_joined(F.col("piece"), "block").alias("markdown"))


def markdown_of_pages(pages: DataFrame) -> DataFrame:
    """(id, markdown) of every page of (id, html)."""
    made = to_markdown(kept_events(events(pages)))
    return pages.select("id").join(made, "id", "left").select("id", F.coalesce("markdown", F.lit("")).alias("markdown"))
