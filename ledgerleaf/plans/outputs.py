"""Registered queries of what a run writes and how it is ordered, with DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions import labels, outputs, text
from ledgerleaf.operators import bodies, corpus, hierarchy, links, markdown, ordering, runs
from ledgerleaf.plans import texts
from ledgerleaf.plans.oracle import _CORPUS, _ITEMS, _NEW, _TREE
from ledgerleaf.plans.queries import _corpus, _placed, _ranked, _slugs
from ledgerleaf.sources import bindings, publish, rendered, shared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


# -- the index, and orders -----------------------------------------------------

_INDEX = f"""{_CORPUS}, {_NEW.strip()}, indexed AS (
  SELECT d.id, d.title, s.slug, 'docs/' || d.id || '.md' AS markdown_path, 'https://docs.google.com/document/d/' || d.id || '/edit' AS source_url,
         strftime(d.modified, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS modified_time, strftime(d.modified + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS synced_at,
         'sha256:' || sha256(d.id) AS content_hash, array_to_string(d.trail, '/') AS folder_path, 'en' AS language
  FROM docs d JOIN slugs s ON s.id = d.id)"""


def _index(spark, d):
    documents = _corpus(spark, d).join(_slugs(spark, d), "id")
    return corpus.index(documents.withColumns({"synced_at": F.expr("modified + interval 1 day"), "content_hash": text.sha256(F.col("id"))}))


@query(f"{_INDEX} SELECT * FROM indexed")
def docs_index(spark, d):
    return _index(spark, d).withColumn("folder_path", F.array_join("folder_path", "/"))


@query(f"{_INDEX} SELECT slug, id FROM indexed ORDER BY slug, id")
def index_sorted(spark, d):
    return corpus.index_in_order(_index(spark, d)).select("slug", "id")


@query(f"{_CORPUS} SELECT folder, count(*) AS document_count, max(modified) AS newest FROM foldered GROUP BY folder ORDER BY newest DESC NULLS LAST, folder")
def groups_sorted(spark, d):
    return corpus.groups_in_order(corpus.groups(_corpus(spark, d))).select("folder", "document_count", "newest")


@query("""
WITH l AS (SELECT page_id, regexp_replace(unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)), '[?#].*$', '') AS href FROM pages)
SELECT 'p' || page_id AS source, substr(href, 2) AS target FROM l WHERE regexp_matches(href, '^/[A-Za-z]{4,}$') AND length(href) % 3 <> 0 ORDER BY source, target""")
def broken_links_sorted(spark, d):
    """Links of letters alone; every third length is a known page's."""
    found = bindings.page_links(spark, d).where("href rlike '^/[A-Za-z]{4,}$'").select(F.concat(F.lit("p"), "page_id").alias("source"), "href")
    known = found.where("length(href) % 3 = 0").select(F.expr("substring(href, 2)").alias("slug")).distinct()
    return links.broken_in_order(links.broken(found, known))


@query(rf"""
WITH t AS (SELECT doc_id, regexp_extract(text, '^([^\n]*)', 1) AS t FROM documents),
n AS (SELECT doc_id, trim(nfc_normalize(t)) AS l FROM t)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 100 END AS number, CASE WHEN l = '' THEN 'Untitled' ELSE l END AS label FROM n""")
def labels_composed(spark, d):
    """Titles whose letters with marks come apart; every third has a number before it."""
    title = F.regexp_extract("text", r"^([^\n]*)", 1)
    apart = title
    for letter, base, mark in (("é", "e", "́"), ("è", "e", "̀"), ("ü", "u", "̈"), ("ñ", "n", "̃"), ("ç", "c", "̧")):
        apart = F.replace(apart, F.lit(letter), F.lit(base + mark))
    name = F.when(F.col("doc_id") % 3 == 0, F.concat((F.col("doc_id") % 100).cast("string"), F.lit(" – "), apart)).otherwise(F.concat(F.lit(" "), apart))
    rows = bindings.table(spark, d, "documents").select("doc_id", name.alias("name"))
    return rows.select("doc_id", labels.order_number(F.col("name")).cast("long").alias("number"), labels.shown(F.col("name")).alias("label"))


# -- runs ----------------------------------------------------------------------


@query(f"""
WITH {_ITEMS.strip()} SELECT CASE WHEN kind = 'folder' THEN NULL ELSE 'root_not_folder' END AS code, id AS item_id
FROM items WHERE id IN ('c9', 's1') AND kind <> 'folder' UNION ALL
SELECT 'root_not_found', 'nowhere'""")
def root_issues(spark, d):
    """Roots that are folders, documents, and nowhere."""
    items = bindings.items(spark, d)
    out = hierarchy.root_issues(items, "root")
    for root in ("n3", "c9", "s1", "nowhere"):
        out = out.unionByName(hierarchy.root_issues(items, root))
    return out


@query(f"{_TREE} SELECT id, parent, 'docs/' || id || '.md' AS path FROM tree WHERE kind = 'document'")
def navigation_records(spark, d):
    """Documents of the navigation with their records; one without a record ends the run."""
    nodes = _placed(spark, d).where("kind = 'document'").select("id", "parent")
    records = bindings.documents(spark, d).select("id", outputs.markdown_path(F.col("id")).alias("path"))
    hierarchy.require_sound(hierarchy.root_issues(bindings.items(spark, d)))
    return ordering.require_records(nodes, records)


@query(f"{_TREE} SELECT id, parent FROM tree WHERE kind = 'document' AND id NOT LIKE '%3' UNION ALL SELECT 'full-' || id, parent FROM tree WHERE kind = 'document'")
def navigation_kept(spark, d):
    """The navigation after a run for one document, and after a full one."""
    rebuilt = _placed(spark, d).where("kind = 'document'").select("id", "parent")
    before = rebuilt.where("id not like '%3'")
    full = runs.navigation_after(None, rebuilt, before).withColumn("id", F.concat(F.lit("full-"), "id"))
    return runs.navigation_after("c3", rebuilt, before).unionByName(full)


@query(f"""
{_TREE} SELECT parent, kind, row_number() OVER (PARTITION BY parent, kind
ORDER BY name, id) AS position, id FROM tree WHERE parent IS NOT NULL AND (kind = 'folder' OR kind = 'document' AND (id LIKE 's%' OR CAST(substr(id, 2) AS INT) % 10 <> 0))""")
def managed_children(spark, d):
    return runs.managed_children(hierarchy.children_in_order(_placed(spark, d)), bindings.manifest(spark, d))


# -- files ---------------------------------------------------------------------

_TITLED = "t AS (SELECT *, regexp_extract(text, '^([^' || chr(10) || ']*)', 1) AS t FROM documents)"


def _generated(spark, d) -> DataFrame:
    rows = bindings.bodies(spark, d).join(bindings.table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    folders = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.upper("lang"), F.concat(F.lit('a "b": '), "source")))
    record = {
        "title": F.col("title"), "description": F.when(F.col("doc_id") % 2 == 0, F.lit("It's: #1")), "slug": F.concat(F.lit("docs/"), "doc_id"), "id": F.concat(F.lit("d "), "doc_id"), "modified": F.lit("2024-01-01T00:00:00.000Z"),
        "synced": F.lit("2024-01-02T00:00:00.000Z"), "contentHash": text.sha256(F.col("body")), "folderPath": folders,
    }
    return rows.select("doc_id", bodies.generated_document(record, F.col("body")).alias("content"))


@query(rf"""
WITH {_TITLED}, made AS (
  SELECT doc_id, '---' || chr(10) || 'title: ' || CAST(to_json(t) AS VARCHAR) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'description: "It''s: #1"' || chr(10) ELSE '' END || 'slug: "docs/' || doc_id || '"' || chr(10)
    || 'editUrl: "https://docs.google.com/document/d/d%20' || doc_id || '/edit"' || chr(10) || 'sourceType: "google-doc"' || chr(10) || 'googleFileId: "d ' || doc_id || '"' || chr(10)
    || 'googleModifiedTime: "2024-01-01T00:00:00.000Z"' || chr(10) || 'syncedAt: "2024-01-02T00:00:00.000Z"' || chr(10) || 'contentHash: "sha256:' || sha256(text) || '"' || chr(10)
    || CASE WHEN doc_id % 5 = 0 THEN 'folderPath: []' ELSE 'folderPath:' || chr(10) || '  - "' || upper(lang) || '"' || chr(10) || '  - "a \"b\": ' || source || '"' END || chr(10)
    || 'pagefind: true' || chr(10) || '---' || chr(10) || '{bodies.MARKER}' || chr(10) || chr(10) || regexp_replace(text, '\s+$', '') || chr(10) AS content FROM t)
SELECT doc_id, 'sha256:' || sha256(content) AS hash FROM made""")
def generated_documents(spark, d):
    return _generated(spark, d).select("doc_id", text.sha256(F.col("content")).alias("hash"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 7 IN (0, 3) THEN CASE WHEN doc_id % 5 = 0 THEN '' ELSE upper(lang) || '/a "b": ' || source END
  WHEN doc_id % 7 = 1 THEN 'one/it''s/three' WHEN doc_id % 7 = 2 THEN 'plain words/q' END AS folders FROM documents""")
def folder_paths_read(spark, d):
    """Heads as they are written, by hand in two ways, and in four that aren't lists of texts."""
    hand = ["folderPath: [\"one\", 'it''s', three]\n", "folderPath:\n- plain words\n  - \"q\"\n", None, "folderPath: text\n", "folderPath:\n  - a: b\n", "folderPath: [true]\n"]
    own = F.regexp_replace("content", r"(?s)(\n)folderPath:.*?\n(pagefind:)", "$1\x01$2")
    case = F.col("doc_id") % 7
    made = F.when(case.isin(0, 3), F.col("content"))
    for k, head in zip((1, 2, 3, 4, 5, 6), hand):
        if head is not None:
            made = made.when(case == k, F.replace(own, F.lit("\x01"), F.lit(head)))
    return _generated(spark, d).select("doc_id", F.array_join(markdown.folder_path(made), "/").alias("folders"))


_PUBLISHED = "'---' || chr(10) || 'title: \"' || t || '\"' || chr(10) || 'source_url: \"https://docs.google.com/document/d/' || id || '/edit\"' || chr(10) || 'modified_at: \"m\"' || chr(10) || 'synced_at: \"s\"' || chr(10) || 'content_hash: \"' || sha256(CAST(id AS VARCHAR)) || '\"' || chr(10) || '---' || chr(10) || chr(10) || '# ' || t || chr(10) || chr(10) || regexp_replace(body, '^\\s+', '') || chr(10)"


@query(rf"""WITH {texts._texts(texts._ROUTED, '[r]: /ref/index.md')}, titled AS (SELECT t.*, l.l AS t FROM texts t JOIN lines l ON l.id = t.id AND l.i = 0)
SELECT 'docs/' || id || '/index.md' AS path, 'sha256:' || sha256({_PUBLISHED}) AS hash FROM titled""")
def published_markdown(spark, d):
    docs = bindings.table(spark, d, "documents").select(F.col("doc_id").alias("id"), texts._body(texts._WITH_QUERY, texts.TAIL).alias("body"), texts._line(F.get(F.split("text", "\n"), 0)).alias("title"))
    slugs = markdown.links(docs).where("kind in ('link', 'reference')").select(F.regexp_extract("href", r"^/([^/?#]*)", 1).alias("slug")).distinct()
    made = docs.withColumns({"body": F.concat(F.lit(f"{bodies.MARKER}\n\n"), "body"), "slug": F.concat(F.lit("docs/"), "id"), "source_url": outputs.source_url(F.col("id").cast("string")), "modified_at": F.lit("m"), "synced_at": F.lit("s"), "content_hash": F.sha2(F.col("id").cast("string"), 256)})
    return markdown.published_files(made, slugs).select("path", text.sha256(F.col("content")).alias("hash"))


@query("SELECT 'texts/' || lang || '/' || doc_id || '.md' AS path, 'sha256:' || sha256(text) AS hash FROM documents")
def published_tree(spark, d):
    """Every text as a file, written by the sink in one commit and read back."""
    files = bindings.table(spark, d, "documents").select(F.concat("lang", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), F.col("text").alias("content"))
    target = f"{shared.shared_dir(spark)}/ledgerleaf-site-{uuid.uuid4().hex}"
    publish.publish({"texts": files}, target)
    return publish.published(spark, target).select("path", text.sha256(F.col("content")).alias("hash"))


@query(f"""
WITH {_ITEMS.strip()}, k AS (SELECT id, name, kind, id = max(id) OVER (PARTITION BY kind) AS last FROM items WHERE kind <> 'unsupported')
SELECT kind || 's' AS section, id AS key, '    ' || to_json(id) || ': ' || chr(123) || chr(10) || '      "kind": ' || to_json(kind) || ',' || chr(10) || '      "name": ' || to_json(name) || chr(10) || '    ' || chr(125) || CASE WHEN last THEN '' ELSE ',' END AS text FROM k""")
def manifest_lines(spark, d):
    """The manifest's document as lines: records in order of id, fields in order of name."""
    return rendered.document_lines(bindings.items(spark, d).where("kind <> 'unsupported'").select("id", "name", "kind", F.concat("kind", F.lit("s")).alias("section")))


@query(f"""{_TREE}, top AS (SELECT id, name FROM tree WHERE parent = 'root' AND kind = 'folder')
SELECT 'src/sidebar.ts' AS path, count(*) AS groups, bool_and(name IS NOT NULL) AS complete FROM top""")
def sidebar_module(spark, d):
    """The sidebar as one module; its groups are counted in its text."""
    ranked = _ranked(spark, d).where("parent = 'root' and kind = 'folder'")
    made = rendered.sidebar_file(ranked.select("sibling_rank", "label", F.array().cast("array<struct<label: string, link: string>>").alias("items")), "src/sidebar.ts", "Generated.")
    opened = F.regexp_count("content", F.lit(r'"label": "'))
    return made.select("path", opened.cast("long").alias("groups"), F.col("content").rlike(r"(?s)^// Generated\.\n.*= \[\n.*\];\n$").alias("complete"))
