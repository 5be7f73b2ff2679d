"""Registered queries of Markdown bodies, with DuckDB SQL.

Bodies are the whole texts of ``documents``: every line, without its marks, stands in
one of several shapes, turn and turn about, so blocks and marks of all kinds occur in
all orders. The SQL tells each line's result from its shape alone, apart from the reader.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerleaf.functions import text
from ledgerleaf.operators import bodies, markdown
from ledgerleaf.sources import bindings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


#: Shapes of a line {L} with its number {i}.
SHAPES = [
    "{L}",
    "## {L} *em* __st__",
    '> [{L}](/p_({i}) "t") <https://e.org/{i}>',
    "```py\n# {L}\n[no](x) <b> ![no](y)\n```",
    "- {L}\n- _b_ [r]",
    '![{L}](i.png) <b>x</b> <a href="/h{i}">y</a>',
    "{L}\n===",
    "    # {L}",
]
TAIL = "[r]: /ref"


def _line(line: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.regexp_replace(line, "[^A-Za-z ]+", ""), " +", " "))
    return F.when(plain == "", "x").otherwise(plain)


@F.arrow_udf(T.StringType())
def _plain(texts: pa.Array) -> pa.Array:
    """Letters, line ends and single blanks of texts; Arrow's expressions take a fifth of the time of the JVM's here."""
    return pc.replace_substring_regex(pc.replace_substring_regex(texts, r"[^A-Za-z \n]+", ""), " {2,}", " ")


def _lines_of(text: Column) -> Column:
    """``_line`` of every line of a text, with one pass over the whole text for each rule."""
    return F.transform(F.transform(F.split(_plain(text), "\n"), lambda x: F.trim(x)), lambda x: F.when(x == "", "x").otherwise(x))


def _filled(template: str, line: Column, i: Column) -> Column:
    """A template with a line in place of its marks; pieces between the marks are constants."""
    parts = [{"{L}": line, "{i}": i.cast("string")}.get(p, F.lit(p)) for p in re.split(r"(\{[Li]\})", template) if p]
    return F.concat(*parts)


def _body(shapes: list[str], tail: str = "") -> Column:
    def one(line: Column, i: Column) -> Column:
        turn = (i + F.col("doc_id")) % len(shapes)
        out = F.lit("")
        for k, s in enumerate(shapes):
            out = F.when(turn == k, _filled(s, line, i)).otherwise(out)
        return out

    pieces = F.transform(_lines_of(F.col("text")), one)
    return F.array_join(F.concat(pieces, F.array(F.lit(tail))) if tail else pieces, "\n\n")


def _docs(spark, d, shapes: list[str] = SHAPES, tail: str = TAIL) -> DataFrame:
    return bindings.table(spark, d, "documents").select(F.col("doc_id").alias("id"), _body(shapes, tail).alias("body"))


_LINES = r"""cut AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
raw AS (SELECT doc_id, unnest(range(0, len(p))) AS i, trim(regexp_replace(regexp_replace(unnest(p), '[^A-Za-z ]+', '', 'g'), ' +', ' ', 'g')) AS l FROM cut)"""


def _lines(n: int) -> str:
    return f"{_LINES}, lines AS (SELECT doc_id AS id, i, (i + doc_id) % {n} AS turn, CASE WHEN l = '' THEN 'x' ELSE l END AS l FROM raw)"


def _sql(template: str) -> str:
    quoted = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return f"replace(replace({quoted}, '{{L}}', l), '{{i}}', CAST(i AS VARCHAR))"


def _texts(shapes: list[str], tail: str = "") -> str:
    """SQL of the bodies (id, body) that the shapes make."""
    cases = " ".join(f"WHEN {k} THEN {_sql(s)}" for k, s in enumerate(shapes))
    end = f" || chr(10) || chr(10) || {_sql(tail)}" if tail else ""
    return f"{_lines(len(shapes))}, texts AS (SELECT id, string_agg(CASE turn {cases} END, chr(10) || chr(10) ORDER BY i){end.replace(', l)', ', chr(0))').replace('CAST(i AS VARCHAR)', 'chr(0)')} AS body FROM lines GROUP BY id)"


@query(rf"""WITH {_lines(8)}
SELECT id, 'link' AS kind, CASE WHEN i % 3 = 0 THEN 'javascript:f(' || i || ')' ELSE '/p_(' || i || ')' END AS href FROM lines WHERE turn = 2
UNION ALL SELECT id, 'autolink', 'https://e.org/' || i FROM lines WHERE turn = 2
UNION ALL SELECT id, 'reference', '/ref' FROM lines WHERE turn = 4
UNION ALL SELECT id, 'image', 'i.png' FROM lines WHERE turn = 5
UNION ALL SELECT id, 'html_link', '/h' || i FROM lines WHERE turn = 5""")
def markdown_links(spark, d):
    """Every third link is unsafe."""
    return markdown.links(_unsafe(spark, d))


def _unsafe(spark, d) -> DataFrame:
    return _docs(spark, d).withColumn("body", _every_third("body"))


def _every_third(body: str) -> Column:
    parts = F.split(body, r"\(/p_\(")
    return F.array_join(F.transform(parts, lambda p, k: F.when(k == 0, p).when(F.regexp_extract(p, r"^(\d+)", 1).cast("int") % 3 == 0, F.concat(F.lit("(javascript:f("), p)).otherwise(F.concat(F.lit("(/p_("), p))), "")


@query(rf"""WITH {_lines(8)}
SELECT DISTINCT id, 'unsupported_image' AS code FROM lines WHERE turn = 5
UNION ALL SELECT DISTINCT id, 'unsupported_html' FROM lines WHERE turn = 5
UNION ALL SELECT DISTINCT id, 'unsafe_url' FROM lines WHERE turn = 2 AND i % 3 = 0""")
def markdown_policy(spark, d):
    return markdown.policy_issues(_unsafe(spark, d))


@query(rf"""WITH {_lines(8)}, reasons AS (
  SELECT id, unnest(['html', 'image']) AS r FROM lines WHERE turn = 5
  UNION SELECT doc_id, 'table' FROM documents WHERE doc_id % 5 = 0
  UNION SELECT doc_id, 'embedded_drawing' FROM documents WHERE doc_id % 7 = 0
  UNION SELECT doc_id, 'media_object' FROM documents WHERE doc_id % 11 = 0)
SELECT id, string_agg('fallback:' || r, ',' ORDER BY r) AS reasons FROM reasons GROUP BY id""")
def fallback_reasons(spark, d):
    docs = _docs(spark, d).withColumn("body", F.expr("if(id % 5 = 0, concat('| a | b |\n|---|:-:|\n\n', body), body)"))
    return markdown.fallback_reasons(docs, docs.select("id", F.expr("id % 7 = 0").alias("has_drawings"), F.expr("id % 11 = 0").alias("has_media")))


@query(rf"""WITH {_lines(8)}, placed AS (SELECT *, CAST(sum(CASE WHEN turn = 4 THEN 2 ELSE 1 END) OVER (PARTITION BY id ORDER BY i) AS BIGINT) - 1 AS last FROM lines)
SELECT id, last AS block, CASE WHEN turn IN (1, 6) THEN 'heading' ELSE 'paragraph' END AS kind,
  CASE turn WHEN 1 THEN l || ' em st' WHEN 2 THEN l || ' https://e.org/' || i WHEN 4 THEN 'b r' WHEN 5 THEN l || ' x y' ELSE l END AS words FROM placed WHERE turn NOT IN (3, 7)
UNION ALL SELECT id, last - 1, 'paragraph', l FROM placed WHERE turn = 4""")
def plain_words(spark, d):
    return markdown.plain_text(_docs(spark, d)).withColumn("block", F.col("block").cast("long"))


@query(rf"""WITH {_lines(8)}, first AS (SELECT id, arg_min(l || CASE WHEN turn = 5 THEN ' x y' ELSE '' END, i) AS w FROM lines WHERE turn IN (0, 5) GROUP BY id),
heads AS (SELECT id, w, left(w, 201) AS head FROM first), places AS (SELECT *, CASE WHEN contains(head, ' ') THEN 201 - instr(reverse(head), ' ') ELSE 0 END AS last FROM heads)
SELECT doc_id AS id, CASE WHEN length(w) <= 200 THEN w ELSE rtrim(left(w, CASE WHEN last >= 120 THEN last ELSE 200 END)) || '…' END AS description FROM documents LEFT JOIN places ON places.id = doc_id""")
def first_paragraphs(spark, d):
    return markdown.descriptions(_docs(spark, d))


_CANONICAL = ["{L}", "## {L} *em* **st**", SHAPES[2], SHAPES[3], "- {L}\n- *b* [r]", SHAPES[5], "# {L}", "```\n# {L}\n```"]


@query(f"WITH {_texts(_CANONICAL, TAIL)} SELECT id, 'sha256:' || sha256(body) AS hash, true AS stable FROM texts")
def markdown_canonical(spark, d):
    once = markdown.canonical(_docs(spark, d))
    twice = markdown.canonical(once).withColumnRenamed("body", "again")
    return once.join(twice, "id").select("id", text.sha256(F.col("body")).alias("hash"), (F.col("body") == F.col("again")).alias("stable"))


_HEADED = [*SHAPES[:6], "# {L}", SHAPES[7]]
_SECOND = [*SHAPES[:6], "## {L}", SHAPES[7]]


@query(rf"""WITH {_texts(_SECOND, TAIL)}
SELECT t.id, 'sha256:' || sha256(CASE WHEN turn = 6 AND t.id % 2 = 0 THEN regexp_replace(body, '^[^\n]*\n+', '') ELSE body END) AS hash FROM texts t JOIN lines l ON l.id = t.id AND l.i = 0""")
def markdown_normalize(spark, d):
    """Titles are the first lines, in capitals; those of odd documents are others."""
    first = F.upper(_line(F.get(F.split("text", "\n"), 0)))
    docs = bindings.table(spark, d, "documents").select(F.col("doc_id").alias("id"), _body(_HEADED, TAIL).alias("body"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("07 - "), first)).otherwise("another").alias("title"))
    return markdown.normalized_headings(docs).select("id", text.sha256(F.col("body")).alias("hash"))


# -- code --------------------------------------------------------------------


def _fenced(spark, d):
    return bindings.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.expr("concat('intro\n````py x\n', text, '\n```\n````\n~~~ c++\n', source, '\n```\n~~~\nrest\n', if(doc_id % 3 = 0, '```open\nlost', 'end'))").alias("body"))


@query("""SELECT doc_id AS id, CAST(1 AS BIGINT) AS block, NULL AS language, sha256(text || chr(10) || '```') AS code_hash, CAST(4 AS BIGINT) AS width FROM documents
UNION ALL SELECT doc_id, 2, 'c++', sha256(source || chr(10) || '```'), 4 FROM documents""")
def code_blocks(spark, d):
    found = markdown.code_blocks(_fenced(spark, d))
    return found.select("id", F.col("block").cast("long").alias("block"), "language", F.sha2("code", 256).alias("code_hash"), F.col("width").cast("long").alias("width"))


@query("SELECT doc_id AS id, doc_id % 3 = 0 AS unclosed, 'intro' || chr(10) || 'rest' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || 'end' END AS prose FROM documents")
def fence_states(spark, d):
    return markdown.fence_states(_fenced(spark, d))


@query(r"SELECT doc_id, len(regexp_extract_all('```' || chr(10) || text || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '```' ELSE '``' END, '(?m)^```')) % 2 = 1 AS unclosed FROM documents")
def fence_check(spark, d):
    """Lines of another fence inside close nothing."""
    fenced = bindings.bodies(spark, d).select(F.col("doc_id").alias("id"), F.expr("concat('```\n', body, '\n~~~\n', if(doc_id % 3 = 0, '```', '``'))").alias("body"))
    return markdown.fence_states(fenced).select(F.col("id").alias("doc_id"), "unclosed")


_ESCAPED = ["a \\`{L}\\` b", "\\`\\`\\`py\n\\*{L}\\*\n\\`\\`\\`", "{L}\n\\*{i}", "~~~ no tag\n\\`\\`\\` {L}\n~~~"]
_RESTORED = ["a `{L}` b", "```py\n*{L}*\n```", "{L}\n\\*{i}", "~~~\n``` {L}\n~~~"]


@query(f"WITH {_texts(_RESTORED)} SELECT id, 'sha256:' || sha256(body) AS hash FROM texts")
def code_restored(spark, d):
    return _docs(spark, d, _ESCAPED, "").select("id", text.sha256(markdown.restored_code("body")).alias("hash"))


# -- splicing ----------------------------------------------------------------

_TABLES = ["| {L} | b |\n| --- | --- |\n| x | y |", "```\n| a | b |\n| - | - |\n<table></table>\n```", "<table><tr><td><table></table>{L}</td></tr></table> after", "{L} | no\ntable"]
_WRAPPED = ['<div class="table">\n\n' + _TABLES[0] + "\n\n</div>", _TABLES[1], '<div class="table"><table><tr><td><table></table>{L}</td></tr></table></div> after', _TABLES[3]]


@query(f"WITH {_texts(_WRAPPED)} SELECT id, 'sha256:' || sha256(body) AS hash FROM texts")
def tables_wrapped(spark, d):
    return markdown.wrapped_tables(_docs(spark, d, _TABLES, "")).select("id", text.sha256(F.col("body")).alias("hash"))


_DIAGRAMS = ["{L}", "```mermaid\n{L} <->& \"{i}\"\n```", "```py\n{L}\n```"]
_CONTAINERS = ["{L}", '<div class="diagram" data-diagram="{L} &lt;-&gt;&amp; &quot;{i}&quot;"><pre>{L} &lt;-&gt;&amp; &quot;{i}&quot;</pre></div>', _DIAGRAMS[2]]


@query(f"WITH {_texts(_CONTAINERS)} SELECT id, 'sha256:' || sha256(body) AS hash FROM texts")
def diagram_containers(spark, d):
    return markdown.with_diagrams(_docs(spark, d, _DIAGRAMS, "")).select("id", text.sha256(F.col("body")).alias("hash"))


_ROUTED = [*SHAPES[:2], '> [{L}](/p_({i})/index.md?v=1#x "t") <https://e.org/{i}>', *SHAPES[3:]]
_WITH_QUERY = [*SHAPES[:2], '> [{L}](/p_({i})/?v=1#x "t") <https://e.org/{i}>', *SHAPES[3:]]
_GENERATED = "'---' || chr(10) || 'title: \"' || t || '\"' || chr(10) || 'slug: \"docs/' || id || '\"' || chr(10) || 'contentHash: \"sha256:' || sha256(body) || '\"' || chr(10) || '---' || chr(10) || chr(10) || '" + bodies.MARKER + "' || chr(10) || chr(10) || body || chr(10)"


@query(rf"""WITH {_texts(_ROUTED, '[r]: /ref/index.md')}, titled AS (SELECT t.*, l.l AS t FROM texts t JOIN lines l ON l.id = t.id AND l.i = 0)
SELECT id, 'sha256:' || sha256({_GENERATED}) AS file_hash, length(body) AS body_length FROM titled""")
def published_projection(spark, d):
    """Bodies whose links to pages of the site lead to these pages' Markdown, in files with their front matter."""
    docs = bindings.table(spark, d, "documents").select(F.col("doc_id").alias("id"), _body(_WITH_QUERY, TAIL).alias("body"), _line(F.get(F.split("text", "\n"), 0)).alias("title"))
    slugs = markdown.links(docs).where("kind in ('link', 'reference')").select(F.regexp_extract("href", r"^/([^/?#]*)", 1).alias("slug")).distinct()
    made = markdown.published(docs, slugs)
    made = made.withColumn("content", bodies.document(F.col("title"), F.concat(F.lit("docs/"), "id"), text.sha256(F.col("body")), F.col("body")))
    return made.select("id", text.sha256(F.col("content")).alias("file_hash"), F.length(bodies.document_body(F.col("content"))).alias("body_length"))


_DOCUMENT = "https://docs.google.com/document/d/d{i}/edit#part"  # a fixed value: how the service addresses documents
_TO_DOCUMENTS = ["[{L}](" + _DOCUMENT + ")", "{L} [a](https://e.org/{i})", "[{L}](<https://docs.google.com/document/d/none{i}/edit>)"]
_TO_SLUGS = ["[{L}](/s/{i}/#part)", _TO_DOCUMENTS[1], _TO_DOCUMENTS[2]]


@query(f"WITH {_texts(_TO_SLUGS)} SELECT id, 'sha256:' || sha256(body) AS hash FROM texts")
def bodies_relinked(spark, d):
    """Bodies whose links to documents of the service become their addresses; others stay."""
    docs = _docs(spark, d, _TO_DOCUMENTS, "")
    most = bindings.table(spark, d, "documents").select(F.explode(F.sequence(F.lit(0), F.size(F.split("text", "\n")))).alias("i")).distinct()
    return markdown.with_document_links(docs, most.select(F.concat(F.lit("d"), "i").alias("id"), F.concat(F.lit("s/"), "i").alias("slug"))).select("id", text.sha256(F.col("body")).alias("hash"))
