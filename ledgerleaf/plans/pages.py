"""Registered queries of HTML pages, with DuckDB SQL that tells the results from what the driver's pages are known to hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.operators import conversion, markup
from ledgerleaf.sources import bindings, shared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return register


def _pages(spark, d):
    return bindings.table(spark, d, "pages").select(F.col("page_id").alias("id"), "html")


#: The body of each page with its known tags put right: told by what they are, not by the operator's steps.
_CLEAN = r"""
bodies AS (SELECT page_id, regexp_replace(html, '(?s)^.*?<body>', '') AS h FROM pages),
plain AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '(?s)<script>.*?</script>', '', 'g'),
    '(?s)<!--.*?-->', '', 'g'), '</?(html|body|b)( [^>]*)?>', '', 'g'), '<div class="ad">', '<div>') AS h FROM bodies),
bounds AS (SELECT page_id, regexp_replace(h, '</?(article|footer|nav)( [^>]*)?>', chr(5), 'g') AS h FROM plain),
entities AS (SELECT page_id, replace(replace(replace(replace(h, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&#39;', '''') AS h FROM bounds),
paragraphs AS (
  SELECT page_id, string_split(h, '<p>') AS parts FROM entities),
closed AS (
  SELECT page_id, trim(parts[1] || array_to_string(list_transform(parts[2:], lambda x:
    '<p>' || CASE WHEN contains(x, '</p>') THEN x ELSE regexp_replace(x, '(?s)^(.*?)(<div|<ul|<h1|\x05|$)', '\1</p>\2') END), '')) AS html FROM paragraphs),
clean AS (SELECT page_id, trim(replace(html, chr(5), '')) AS html FROM closed)"""


@query(f"WITH {_CLEAN} SELECT page_id, html FROM clean")
def html_sanitize(spark, d):
    return markup.sanitized(_pages(spark, d)).withColumnRenamed("id", "page_id")


_TOKENS = r"'<a href=\"[^\"]*\">[^<]*</a>|<[^>]*>|[^<]+'".replace('\\"', '"')


@query(rf"""
WITH {_CLEAN},
pieces AS (
  SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, {_TOKENS}), lambda t: CASE
    WHEN t LIKE '<a href=%' THEN '[' || regexp_replace(regexp_extract(t, '>([^<]*)<', 1), '([\\*_`\[\]])', '\\\1', 'g') || '](' || regexp_extract(t, '"([^"]*)"', 1) || ')'
    WHEN t = '<h1>' THEN chr(1) || chr(4)
    WHEN t = '<br>' THEN chr(3)
    WHEN t = '<li>' THEN chr(1) || chr(2)
    WHEN t LIKE '<%' THEN chr(1)
    ELSE regexp_replace(t, '([\\*_`\[\]])', '\\\1', 'g') END), '') AS m FROM clean),
unescaped AS (SELECT page_id, replace(replace(replace(m, '&lt;', '\<'), '&gt;', '>'), '&amp;', '&') AS m FROM pieces),
cut AS (SELECT page_id, unnest(range(0, len(b))) AS n, unnest(b) AS b FROM (SELECT page_id, string_split(m, chr(1)) AS b FROM unescaped)),
blocks AS (
  SELECT page_id, n, b[1:1] AS kind, regexp_replace(regexp_replace(trim(regexp_replace(replace(replace(b, chr(2), ''), chr(4), ''), '\s+', ' ', 'g')), '( *\x03)+$', ''), ' *\x03 *', '\\' || chr(10), 'g') AS b
  FROM cut),
guarded AS (
  SELECT page_id, n, kind, CASE WHEN kind = chr(4) THEN '# ' || b
    ELSE regexp_replace(regexp_replace(b, '(?m)^(#{{1,6}}( |$)|[-+]( |$)|>|~{{3,}}|[-=]{{2,}}$)', '\\\1', 'g'), '(?m)^(\d{{1,9}})([.)]( |$))', '\1\\\2', 'g') END AS b
  FROM blocks WHERE b <> ''),
spaced AS (
  SELECT page_id, n, CASE WHEN lag(kind) OVER w IS NULL THEN '' WHEN kind = chr(2) AND lag(kind) OVER w = chr(2) THEN chr(10) ELSE chr(10) || chr(10) END
    || CASE WHEN kind = chr(2) THEN '- ' ELSE '' END || b AS b
  FROM guarded WINDOW w AS (PARTITION BY page_id ORDER BY n))
SELECT page_id, coalesce(string_agg(b, '' ORDER BY n), '') AS markdown FROM spaced GROUP BY page_id""")
def html_to_markdown(spark, d):
    return markup.markdown_of_pages(_pages(spark, d)).withColumnRenamed("id", "page_id")


@query(r"""
SELECT page_id, 'removed_unsupported_html' AS code FROM pages
UNION ALL SELECT page_id, 'removed_unsafe_html_attribute' FROM pages WHERE regexp_matches(html, '<(div|p|h1|ul|li|br|a href="[^"]*") [a-z]+=')
UNION ALL SELECT page_id, 'removed_unsafe_link' FROM pages WHERE len(list_filter(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda h: h = '' OR h LIKE '//%' OR regexp_matches(h, '^[a-z]+:') AND NOT regexp_matches(h, '^(https?|mailto):'))) > 0""")
def html_warnings(spark, d):
    return markup.warnings(markup.events(_pages(spark, d))).withColumnRenamed("id", "page_id")


#: Every page's words beside those shapes that the driver's pages lack: the n-th word longer than four letters, and a letter-only head.
_WORDS = "regexp_extract_all(html, '[A-Za-z]{5,}', 0)"
_SHAPES = (
    '<body><h2 id="x">{a}</h2><ol start="3"><li>{b}<li>{c}<ul><li>{d}</ol><p onclick="f()">see <a href=\'/{a}_(x)\' title="{b}">{c}</a> and <a href="javascript:{a}">{d}</a>'
    '<pre><code>{a}  *{b}*\n``` {c}</code></pre><blockquote>{d}<p>{a} <code>{b}`{c}</code></blockquote><img src="i/{a}.png" alt="{b}" width="3">'
    '<table><thead><tr><th>{a}<th>b|{b}<tbody><tr><td>{c}<td> {d} <em>x</em></table><table><tr><td colspan="2" rowspan="1000">{a}</table>'
    "<p>{a}<form><p>{b}</form><iframe>{c}</iframe>{d}<br>{a} <del>{b}</del> <strong>{c}</strong>"
)
_SHAPES_HTML = (
    '<h2>{a}</h2><ol><li>{b}</li><li>{c}<ul><li>{d}</li></ul></li></ol><p>see <a href="/{a}_(x)" title="{b}">{c}</a> and <a>{d}</a></p>'
    '<pre><code>{a}  *{b}*\n``` {c}</code></pre><blockquote>{d}<p>{a} <code>{b}`{c}</code></p></blockquote><img alt="{b}" src="i/{a}.png">'
    '<table><thead><tr><th>{a}</th><th>b|{b}</th></tr></thead><tbody><tr><td>{c}</td><td> {d} <em>x</em></td></tr></tbody></table><table><tr><td colspan="2">{a}</td></tr></table>'
    "<p>{a}</p>{d}<br>{a} <del>{b}</del> <strong>{c}</strong>"
)
_SHAPES_MARKDOWN = (
    '## {a}\n\n1. {b}\n2. {c}\n   - {d}\n\nsee [{c}](</{a}_(x)> "{b}") and {d}\n\n````\n{a}  *{b}*\n``` {c}\n````\n\n> {d}\n>\n> {a} `` {b}`{c} ``\n\n![{b}](i/{a}.png)\n\n'
    '| {a} | b\\|{b} |\n| --- | --- |\n| {c} | {d} x |\n\n<table><tr><td colspan="2">{a}</td></tr></table>\n\n{a}\n\n{d}\\\n{a} ~~{b}~~ **{c}**'
)


def _filled(template: str) -> str:
    """SQL of a template: a to d are words of the page."""
    sql = "'" + template.replace("'", "''") + "'"
    for i, letter in enumerate("abcd", 1):
        sql = f"replace({sql}, '{{{letter}}}', w{i})"
    return sql


@query(f"""
WITH w AS (SELECT page_id, {_WORDS} AS w FROM pages), x AS (SELECT page_id, {', '.join(f'w[len(w) - {i}] AS w{i}' for i in range(1, 5))}
FROM w) SELECT page_id, {_filled(_SHAPES_HTML)} AS html, {_filled(_SHAPES_MARKDOWN)} AS markdown, 'removed_invalid_table_span,removed_unsafe_html_attribute,removed_unsafe_link,removed_unsupported_html' AS codes
FROM x""")
def html_structures(spark, d):
    """Lists, code, quotations, images and tables around the last long words of each page."""
    words = bindings.table(spark, d, "pages").select("page_id", F.regexp_extract_all("html", F.lit("[A-Za-z]{5,}"), F.lit(0)).alias("w"))
    page = F.lit(_SHAPES)
    for i, letter in enumerate("abcd", 1):
        page = F.replace(page, F.lit(f"{{{letter}}}"), F.get("w", F.size("w") - 1 - i))
    pages = words.select(F.col("page_id").alias("id"), page.alias("html"))
    found = shared.stage(markup.events(pages), "events")  # steps are read several times, so each is a table
    kept = shared.stage(markup.kept_events(found), "kept")
    codes = markup.warnings(found).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))
    return markup.as_html(kept).join(markup.to_markdown(kept), "id").join(codes, "id").withColumnRenamed("id", "page_id")


@query(r"""
WITH l AS (SELECT page_id, regexp_extract_all(html, '(?s)<ul>(.*?)</ul>', 1) AS lists FROM pages),
t AS (SELECT page_id, unnest(range(0, len(lists))) AS position, regexp_extract_all(unnest(lists), '<li><a href="[^"]*">([^<]*)</a>', 1) AS items FROM l)
SELECT page_id, position, len(list_filter(items, lambda x: contains(x, ','))) > 0 AS complex,
  CASE WHEN len(list_filter(items, lambda x: contains(x, ','))) = 0 THEN '| Name | a\|b |' || chr(10) || '| --- | --- |'
    || array_to_string(list_transform(items, lambda x: chr(10) || '| ' || replace(replace(replace(trim(regexp_replace(x, '\s+', ' ', 'g')), '&amp;', '&'), '|', '\|'), '&quot;', '"') || ' | 1 |'), '') END AS markdown
FROM t""")
def table_complexity(spark, d):
    """All lists of all pages as tables, a row for each item; an item with a comma gets a third cell."""
    lists = bindings.table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<ul>(.*?)</ul>"), F.lit(1))).alias("position", "items"))
    table = F.regexp_replace(F.regexp_replace("items", r"(?s)<li>(.*?)</li>", "<tr><td>$1<td> 1"), "(,[^<]*</a>)", "$1<td>")
    made = lists.select(F.struct("page_id", "position").alias("key"), F.concat(F.lit("<table><tr><th>Name</th>\n<th class='x'>a|b</th></tr>"), table, F.lit("</table>")).alias("html"))
    made = made.select(F.concat_ws(":", "key.page_id", "key.position").alias("id"), "html")
    found = markup.tables(markup.kept_events(markup.events(made)))
    key = F.split("id", ":")
    return found.select(F.get(key, 0).cast("long").alias("page_id"), F.get(key, 1).cast("long").alias("position"), "complex", "markdown")


_ARCHIVE = (
    '<h1>{a}</h1><p>{b} {c}</p><img src="../../up.png"><p><img src=\'img/{a}.png\' alt="{b}"><img class=x src="img/./copy.png"></p><table><tr><td>{d}</table><h1>{c}</h1>'
)
_ARCHIVE_HTML = (
    '<h1>{a}</h1><p>{b} {c}</p><p><img alt="{b}" src="../../../assets/generated/@/image-001.png"><img alt="Image from {a}" src="../../../assets/generated/@/image-001.png"></p>'
    "<table><tbody><tr><td>{d}</td></tr></tbody></table><h1>{c}</h1>"
).replace("<tbody>", "").replace("</tbody>", "")
_ARCHIVE_BODY = "{b} {c}\n\n![{b}](../../../assets/generated/@/image-001.png)![Image from {a}](../../../assets/generated/@/image-001.png)\n\n| {d} |\n| --- |\n\n## {c}"


@query(f"""
WITH w AS (SELECT page_id, {_WORDS} AS w FROM pages), x AS (SELECT page_id, {', '.join(f'w[len(w) - {i}] AS w{i}' for i in range(1, 5))} FROM w)
SELECT page_id AS id, replace({_filled(_ARCHIVE_HTML)}, '@', CAST(page_id AS VARCHAR)) AS html, replace({_filled(_ARCHIVE_BODY)}, '@', CAST(page_id AS VARCHAR)) AS body, w2 || ' ' || w3 AS description,
       'false' AS complex_tables, 'removed_unsafe_html_attribute,removed_unsafe_image' AS warnings, CASE WHEN page_id % 10 = 9 THEN 'missing' END AS issue
FROM x WHERE page_id % 10 <> 9
UNION ALL SELECT page_id, NULL, NULL, NULL, NULL, NULL, 'missing' FROM x WHERE page_id % 10 = 9""")
def archive_conversion(spark, d):
    """Exported pages around words of each page with their archives; every tenth archive lacks an image."""
    words = bindings.table(spark, d, "pages").select(F.col("page_id").alias("id"), "url", F.regexp_extract_all("html", F.lit("[A-Za-z]{5,}"), F.lit(0)).alias("w"))
    page, title = F.lit(_ARCHIVE), F.get("w", F.size("w") - 2)
    for i, letter in enumerate("abcd", 1):
        page = F.replace(page, F.lit(f"{{{letter}}}"), F.get("w", F.size("w") - 1 - i))
    pages = words.select("id", F.lit("docs").alias("folder"), title.alias("title"), page.alias("html"))
    png = F.expr("concat(unhex('89504E470D0A1A0A'), encode(url, 'UTF-8'))").alias("bytes")
    one = words.select("id", F.concat(F.lit("docs/img/"), title, F.lit(".png")).alias("path"), png)
    entries = one.unionByName(words.where("id % 10 <> 9").select("id", F.lit("docs/img/copy.png").alias("path"), png))
    made = conversion.converted(pages, entries).withColumns({"warnings": F.array_join("warnings", ","), "complex_tables": F.col("complex_tables").cast("string")})
    bad = F.col("issue").isNotNull()
    return made.select("id", *(F.when(~bad, F.col(c)).alias(c) for c in ("html", "body", "description", "complex_tables", "warnings")), "issue")
