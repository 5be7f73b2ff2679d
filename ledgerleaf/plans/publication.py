"""Registered queries of readers, runs, Markdown, rendered outputs and further checks, each with its DuckDB SQL.

What the driver's tables don't hold - statuses, files, settings - is derived from all of
their rows, so that every case of an operator occurs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerleaf.functions import labels, settings, text, urls
from ledgerleaf.operators import bodies, checks, corpus, hierarchy, ordering, reconcile, runs
from ledgerleaf.plans.oracle import _CORPUS, _ITEMS, _MANIFEST, _NAVIGATION, _NEW, _PARENTS, _RANKED, _TREE, _label, _order
from ledgerleaf.plans.queries import _both, _corpus, _new, _placed, _slugs
from ledgerleaf.sources import bindings, landed, paged, publish, rendered, shared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def _landed(rows: DataFrame, name: str) -> str:
    path = f"{shared.shared_dir(rows.sparkSession)}/ledgerleaf-{name}-{uuid.uuid4().hex}"
    rows.write.json(path)
    return path


def _texts(spark, d):
    return bindings.table(spark, d, "documents")


# -- readers -----------------------------------------------------------------


def _raw(spark, d):
    kind = F.expr(f"case kind when 'folder' then '{landed.FOLDER}' when 'document' then '{landed.DOCUMENT}' else 'text/csv' end")
    rows = bindings.items(spark, d).select("id", "name", kind.alias("mimeType"), F.array_compact(F.array("parent")).alias("parents"), F.col("modified").alias("modifiedTime"), F.expr("id like '%9'").alias("trashed"), F.lit("drive").alias("driveId"))
    return _landed(rows, "listing")


@query(f"WITH {_ITEMS.strip()} SELECT id, name, kind, parent FROM items WHERE id NOT LIKE '%9'")
def landed_listing(spark, d):
    return landed.listing(spark, _raw(spark, d)).select("id", "name", "kind", "parent")


@query(f"""
WITH {_ITEMS.strip()}, bad AS (SELECT id, ['scope_other_drive', CASE WHEN kind <> 'folder' THEN 'scope_not_folder' END, CASE WHEN id LIKE '%9' THEN 'scope_trashed' END] AS codes
FROM items WHERE id = 'c9') SELECT code, id AS item_id FROM (SELECT id, unnest(codes) AS code
FROM bad) WHERE code IS NOT NULL""")
def scope_issues(spark, d):
    raw = landed.raw_listing(spark, _raw(spark, d))
    return landed.scope_issues(raw, "drive", "root").unionByName(landed.scope_issues(raw, "another", "c9"))


@query(f"{_MANIFEST} SELECT id, 'document' AS kind, CASE WHEN id LIKE '%1' THEN 'kept/' ELSE 'docs/' END || id || '.md' AS path, CAST(3 AS BIGINT) AS version FROM manifest")
def landed_manifest(spark, d):
    """Records of three versions in one landing."""
    rows = bindings.manifest(spark, d).select("id", "name", "parent", F.expr("if(id like '%1', 3, if(id like '%2', 2, 1))").alias("version"))
    rows = rows.withColumn("kind", F.expr("if(version > 1, 'document', null)")).withColumn("path", F.expr("if(version > 2, concat('kept/', id, '.md'), null)"))
    return landed.manifest(spark, _landed(rows, "manifest")).select("id", "kind", "path", F.col("version").cast("long").alias("version"))


def _page_count(items: int) -> int:
    return max(1, min(items // 50, paged.MOST_PAGES))


def _pages_landed(spark, d) -> str:
    """The inventory as a chain of pages of 50 items each, of more where the pages would be more than a listing may have; one JSON file a page."""
    rows = bindings.items(spark, d).select("id", "name", F.expr(f"case kind when 'folder' then '{landed.FOLDER}' when 'document' then '{landed.DOCUMENT}' else 'text/csv' end").alias("mimeType"), F.array_compact(F.array("parent")).alias("parents"), F.date_format("modified", "yyyy-MM-dd HH:mm:ss").alias("modifiedTime"), F.expr("id like '%9'").alias("trashed"))
    keyed = shared.stage(rows.withColumn("page", F.pmod(F.xxhash64("id"), F.lit(_page_count(rows.count())))), "listed")
    places = keyed.select("page").distinct().withColumn("place", F.row_number().over(Window.orderBy("page")))  # a row a page, so at most MOST_PAGES
    last = places.count()
    page = keyed.groupBy("page").agg(F.collect_list(F.struct(*rows.columns)).alias("files")).join(F.broadcast(places), "page")
    token = F.concat(F.lit("t"), "place")
    body = F.struct(F.when(F.col("place") > 1, token).alias("pageToken"), F.when(F.col("place") < last, F.concat(F.lit("t"), F.col("place") + 1)).alias("nextPageToken"), F.lit(False).alias("incompleteSearch"), "files")
    path = f"{shared.shared_dir(spark)}/ledgerleaf-pages-{uuid.uuid4().hex}"
    files = page.select(F.concat("place", F.lit(".json")).alias("path"), F.to_json(body).alias("content"))
    publish.publish({"pages": files}, path)
    return f"{path}/pages"


@query(f"WITH {_ITEMS.strip()} SELECT id, name, kind, parent FROM items WHERE id NOT LIKE '%9'")
def paged_listing(spark, d):
    """Pages go out by the file sink, and come back by the data source."""
    return paged.listing(spark, _pages_landed(spark, d)).select("id", "name", "kind", "parent")


def _manifests(spark, d):
    """A manifest for each source, of the version that its name gives; its documents by id, a folder for each language."""
    rows = _texts(spark, d).withColumn("version", 1 + F.pmod(F.length("source") + F.ascii(F.substring("source", -1, 1)), F.lit(3)))
    entry = lambda *fields: F.struct(*(v.alias(k) for k, v in fields))
    document = entry(("title", F.regexp_extract("text", r"^([^\n]*)", 1)), ("parentId", F.col("lang")), ("slug", F.concat("lang", F.lit("/"), "doc_id")), ("contentHash", text.sha256(F.col("text"))))
    folder = entry(("name", F.upper("lang")), ("slug", F.concat(F.lit("f-"), "lang")))
    keyed = lambda key, value: F.map_from_entries(F.collect_list(F.struct(key, value)))
    documents = rows.groupBy("source", "version").agg(keyed(F.col("doc_id").cast("string"), document).alias("documents"), keyed(F.concat(F.lit("old/"), "doc_id"), entry(("targetDocumentId", F.col("doc_id").cast("string")))).alias("redirects"))
    folders = rows.select("source", "lang").distinct().groupBy("source").agg(keyed(F.col("lang"), folder).alias("folders"))
    body = F.struct(F.col("version").alias("schemaVersion"), F.when(F.col("source") < "src5", "drive").otherwise("other").alias("driveId"), F.lit("root").alias("rootFolderId"), "documents", "folders", "redirects")
    return documents.join(folders, "source").select(F.col("source").alias("owner"), F.to_json(body).alias("json"))


_VERSIONED = "v AS (SELECT *, 1 + (length(source) + ascii(right(source, 1))) % 3 AS version FROM documents)"


@query(f"""
WITH {_VERSIONED}
SELECT source AS owner, 'documents' AS section, CAST(doc_id AS VARCHAR) AS id, regexp_extract(text, '^([^\n]*)', 1) AS name, lang AS parent, lang || '/' || doc_id AS slug, 'sha256:' || sha256(text) AS "contentHash", NULL AS target, version FROM v
UNION ALL SELECT DISTINCT source, 'folders', lang, upper(lang), NULL, CASE WHEN version >= 3 THEN 'f-' || lang END, NULL, NULL, version FROM v
UNION ALL SELECT source, 'redirects', 'old/' || doc_id, NULL, NULL, NULL, NULL, CAST(doc_id AS VARCHAR), version FROM v WHERE version >= 2""")
def manifest_documents(spark, d):
    """Whole manifests of three versions, a JSON object each."""
    found = landed.manifest_documents(_manifests(spark, d)).drop("modified", "outputHash")
    return found.withColumn("version", F.col("version").cast("long"))


@query("""
SELECT DISTINCT source AS owner, CASE source WHEN 'src1' THEN 'not_json' WHEN 'src2' THEN 'unknown_version' ELSE 'other_scope' END AS code
FROM documents WHERE source IN ('src1', 'src2') OR source >= 'src5'""")
def manifest_issues(spark, d):
    raw = _manifests(spark, d)
    broken = F.when(F.col("owner") == "src1", F.substring("json", 1, 200)).when(F.col("owner") == "src2", F.regexp_replace("json", '"schemaVersion":.', '"schemaVersion":7')).otherwise(F.col("json"))
    return landed.manifest_issues(raw.withColumn("json", broken), "drive", "root")


@query("""
WITH s AS (SELECT event_id, 200 + (event_id * 37) % 400 AS status, event_id % 12 AS attempt, CASE WHEN event_id % 3 = 0 THEN event_id * 7 END AS asked
FROM events) SELECT event_id, CASE WHEN status < 300 THEN NULL WHEN status = 401 THEN 'authentication' WHEN status IN (403, 404) THEN 'permission' WHEN status = 429 THEN 'rate_limit' WHEN status >= 500 THEN 'server' ELSE 'invalid_response' END AS error_class, status IN (429, 500, 502, 503, 504) AS retried, CAST(CASE WHEN asked IS NOT NULL THEN least(asked, 30000) WHEN attempt > 5 THEN 10000 ELSE 250 * (1 << CAST(attempt AS INT)) END AS BIGINT) AS delay
FROM s""")
def request_failures(spark, d):
    rows = bindings.table(spark, d, "events").select("event_id", F.expr("200 + (event_id * 37) % 400").alias("status"), F.expr("event_id % 12").alias("attempt"), F.expr("if(event_id % 3 = 0, event_id * 7, null)").alias("asked"))
    return rows.select("event_id", landed.error_class(F.col("status")).alias("error_class"), F.col("status").isin(*landed.RETRIED).alias("retried"), landed.retry_delay(F.col("attempt"), F.col("asked")).alias("delay"))


# -- runs --------------------------------------------------------------------


def _written(spark, d):
    """(records, outputs): generated files of all documents, of which some are gone, unmarked, changed, or recorded otherwise."""
    made = _texts(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("docs/"), "doc_id", F.lit(".md")).alias("path"), F.col("text").alias("body"), F.expr("doc_id % 6").alias("case"))
    made = made.withColumn("content", bodies.document(F.col("id"), F.col("path"), text.sha256(F.col("body")), F.col("body")))
    body = bodies.document_body(F.col("content"))
    records = made.select("id", "path", text.sha256(F.expr("if(case = 4, concat(content, ' '), content)")).alias("output_hash"), text.sha256(F.when(F.col("case") == 5, F.lit("other")).otherwise(body)).alias("content_hash"))
    found = F.when(F.col("case") == 2, F.replace(F.col("content"), F.lit(bodies.MARKER), F.lit(""))).when(F.col("case") == 3, F.concat("content", F.lit("x"))).otherwise(F.col("content"))
    return records, made.where("case <> 1").select("path", found.alias("content"))


@query("""
SELECT CAST(doc_id AS VARCHAR) AS id, CASE doc_id % 6 WHEN 1 THEN 'missing' WHEN 2 THEN 'marker_missing' WHEN 5 THEN 'content_changed' ELSE 'output_changed' END AS issue
FROM documents WHERE doc_id % 6 > 0""")
def output_issues(spark, d):
    return runs.output_issues(*_written(spark, d))


_BAD = "bad AS (SELECT id FROM current WHERE id LIKE '%3')"


@query(f"""
{_MANIFEST}, {_BAD}, listed AS (SELECT id, class, id IN (SELECT id
FROM bad) AS bad FROM classed WHERE class <> 'removed') SELECT id, reasons <> '' AS needs_export, reasons
FROM (SELECT id, array_to_string(list_filter([CASE WHEN (SELECT bool_or(class IN ('added', 'removed'))
FROM classed) THEN 'corpus' END, CASE WHEN class = 'added' THEN 'new' END, CASE WHEN class = 'changed' THEN 'metadata' END, CASE WHEN bad THEN 'output' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM listed)""")
def run_plan(spark, d):
    current, manifest = _both(spark, d)
    return runs.plan(current, manifest, current.where("id like '%3'"))


@query(f"{_MANIFEST} SELECT c.id, c.id = 'c10' AS needs_export, CASE WHEN c.id = 'c10' THEN 'target' ELSE '' END AS reasons FROM current c WHERE c.id = 'c10' OR c.id IN (SELECT id FROM manifest)")
def run_plan_of_one(spark, d):
    current, manifest = _both(spark, d)
    return runs.plan(current, manifest, current.where("id like '%3'"), target="c10")


def _dated(spark, d):
    current, manifest = _both(spark, d)
    return current.select("id", "name", "parent", "modified", F.lit("now").alias("generated_at")), manifest.select("id", "name", "parent", "modified", F.lit("before").alias("generated_at")), current.where("id like '%3'")


@query(f"""
{_MANIFEST}, {_BAD} SELECT c.id, class = 'unchanged' AND c.id NOT IN (SELECT id
FROM bad) AS reused, CASE WHEN class = 'unchanged' AND c.id NOT IN (SELECT id
FROM bad) THEN 'before' ELSE 'now' END AS generated_at FROM current c
JOIN classed USING (id)""")
def run_reuse(spark, d):
    exported, manifest, bad = _dated(spark, d)
    return runs.with_reuse(exported, manifest, bad).select("id", "reused", "generated_at")


@query(f"{_MANIFEST} SELECT 'same' AS run, 'before' AS generated_at UNION ALL SELECT 'other', CASE WHEN bool_or(class <> 'unchanged') THEN 'now' ELSE 'before' END FROM classed")
def run_time(spark, d):
    exported, manifest, _ = _dated(spark, d)
    same = runs.generated_at(manifest.withColumn("generated_at", F.lit("now")), manifest, "now", "before").withColumn("run", F.lit("same"))
    return same.unionByName(runs.generated_at(exported, manifest, "now", "before").withColumn("run", F.lit("other")))


@query(f"{_MANIFEST} SELECT id, name, id NOT LIKE '%3' OR id NOT IN (SELECT id FROM current) AS good FROM manifest WHERE id NOT IN (SELECT id FROM current WHERE parent IN ('n1', 'n2'))")
def run_preserved(spark, d):
    current, manifest = _both(spark, d)
    return runs.preserved(manifest, current.where("parent in ('n1', 'n2')"), current.where("id like '%3'")).select("id", "name", "good")


@query(f"{_MANIFEST} SELECT c.id, CASE WHEN c.parent = 'n3' THEN upper(c.name) ELSE c.name END AS name FROM current c")
def run_merged(spark, d):
    current, manifest = _both(spark, d)
    exported = current.unionByName(manifest.where("id like 'x%'")).where("parent = 'n3' or id like 'x%'")
    return runs.merged(current.select("id", "name"), exported.select("id", F.upper("name").alias("name")))


_MANAGED = f"{_TREE}, known AS (SELECT 's' || s_suppkey AS id FROM supplier UNION ALL SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 10 <> 0)"


@query(f"{_MANAGED} SELECT id, kind FROM tree WHERE kind = 'folder' OR kind = 'document' AND id IN (SELECT id FROM known)")
def managed_documents(spark, d):
    return runs.managed(_placed(spark, d), bindings.manifest(spark, d)).select("id", "kind")


@query(f"""
{_TREE}, {_NEW.strip()} SELECT t.id, t.name, CASE WHEN t.id <> 'root' THEN t.parent END AS parent, s.slug, CASE WHEN s.slug IS NOT NULL THEN 'sections/' || t.id || '.md' END AS page_path
FROM tree t LEFT JOIN slugs s ON s.id = t.id WHERE t.kind = 'folder'""")
def folder_records(spark, d):
    return runs.folder_records(_placed(spark, d), _slugs(spark, d))


@query(f"""
{_TREE}, kept AS (SELECT * FROM tree WHERE NOT list_has_any(ids, ['r1', 'n3'])),
dup AS (SELECT c_custkey FROM customer WHERE c_custkey % 40 = 3)
SELECT (SELECT count(*) FROM items) AS items, (SELECT count(*)
FROM tree) AS descendants, count(*) FILTER (WHERE kind = 'folder') AS selected_folders, count(*) FILTER (WHERE kind = 'document') AS selected_documents, count(*) FILTER (WHERE kind = 'unsupported') AS selected_unsupporteds, (SELECT count(*)
FROM tree) - count(*) AS ignored, (SELECT count(*) FROM items) - (SELECT count(*)
FROM tree) AS outside, (SELECT count(*) FROM dup) AS issues FROM kept""")
def inventory_report(spark, d):
    items, placed = bindings.items(spark, d), _placed(spark, d)
    return runs.report_counters(items, placed, hierarchy.without_subtrees(placed, ["r1", "n3"]), hierarchy.multiple_parents(bindings.parent_links(spark, d)))


@query(f"""
{_MANIFEST} SELECT count(*) FILTER (WHERE class = 'added') AS added, count(*) FILTER (WHERE class = 'changed') AS changed, count(*) FILTER (WHERE class = 'unchanged') AS unchanged, count(*) FILTER (WHERE class = 'removed') AS removed, (SELECT count(*)
FROM items WHERE kind = 'folder') AS folders, (SELECT count(*)
FROM items WHERE kind = 'unsupported') AS unsupported, (SELECT count(DISTINCT name)
FROM current) AS warnings FROM classed""")
def run_counters(spark, d):
    items = bindings.items(spark, d)
    return runs.run_counters(*_both(spark, d), items.where("kind = 'folder'"), items.where("kind = 'unsupported'"), bindings.documents(spark, d).select("name"))


@query("SELECT doc_id, 'sha256:' || sha256(CAST(to_json({'body': text, 'assets': [{'path': 'a' || doc_id, 'hash': source}, {'path': 'b', 'hash': lang}]}) AS VARCHAR)) AS hash FROM documents")
def content_hash_with_assets(spark, d):
    """Assets arrive in any order and are hashed in order of path."""
    assets = F.array(F.struct(F.lit("b").alias("path"), F.col("lang").alias("hash")), F.struct(F.concat(F.lit("a"), "doc_id").alias("path"), F.col("source").alias("hash")))
    return _texts(spark, d).select("doc_id", runs.content_hash(F.col("text"), assets).alias("hash"))


# -- URLs and settings -------------------------------------------------------


@query("""
SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'docs/img/' || page_id || '.png' WHEN 1 THEN 'img/' || page_id || '.png' WHEN 2 THEN 'docs/a b/' || page_id || '.png' WHEN 3 THEN page_id || '.png' END AS path
FROM pages""")
def archive_paths(spark, d):
    href = F.expr("concat(case page_id % 8 when 0 then 'img//./' when 1 then '../img/' when 2 then 'a%20b/' when 3 then 'x/../../' when 4 then '../../' when 5 then '/img/' when 6 then 'http:' else '%252e%252e/' end, page_id, '.png')")
    return bindings.table(spark, d, "pages").select("page_id", urls.asset_path(href, F.lit("docs")).alias("path"))


@query("""
WITH u AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_extract(url, '^([a-z]+://[^/]+)', 1) WHEN 1 THEN regexp_extract(url, '^([a-z]+://[^/]+/)', 1) ELSE url END AS site, url FROM pages)
SELECT page_id, url LIKE 'https://%' AND (page_id % 3 <> 2 OR regexp_full_match(url, '[a-z]+://[^/]+/?')) AS origin, CASE WHEN contains(url, '#') THEN regexp_extract(url, '#(.*)$', 1) END AS fragment,
       regexp_full_match(rtrim(regexp_replace(url, '^[a-z]+://[^/]+/', ''), '/'), '[a-z0-9]+(-+[a-z0-9]+)*(/[a-z0-9]+(-+[a-z0-9]+)*)*') AS safe FROM u""")
def url_parts(spark, d):
    """Sites of URLs, without and with a slash at the end, and whole URLs as origins; a slash at the end is part of a route, not of a slug."""
    url = F.col("url")
    site = F.when(F.col("page_id") % 3 == 0, F.regexp_extract(url, r"^([a-z]+://[^/]+)", 1)).when(F.col("page_id") % 3 == 1, F.regexp_extract(url, r"^([a-z]+://[^/]+/)", 1)).otherwise(url)
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/]+/", ""), r"/+$", "")
    return bindings.table(spark, d, "pages").select("page_id", urls.https_origin(site).alias("origin"), urls.readable_fragment(url).alias("fragment"), urls.safe_slug(path).alias("safe"))


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 4 WHEN 1 THEN CASE WHEN user_id BETWEEN 1 AND 60 THEN user_id END WHEN 3 THEN 7 END AS number, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN event_type = 'click' END AS flag, CASE WHEN event_type = 'click' THEN 'click' ELSE event_type || ',click' END AS list
FROM events""")
def settings_parsed(spark, d):
    rows = bindings.table(spark, d, "events")
    number = F.expr("case event_id % 4 when 0 then '' when 1 then cast(user_id as string) when 2 then concat(user_id, 'x') else ' 7 ' end")
    flag = F.expr("case event_id % 3 when 0 then null when 1 then cast(event_type = 'click' as string) else 'yes' end")
    items = F.concat(F.lit(" , "), "event_type", F.lit(", click,"), "event_type", F.lit(" ,"))
    return rows.select("event_id", settings.bounded_integer(number, 1, 60, 4).alias("number"), settings.boolean(flag, True).alias("flag"), F.array_join(settings.listed(items), ",").alias("list"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS instant, strftime(o_orderdate, '%b %-d, %Y, %-I:%M %p') AS shown FROM orders")
def times_shown(spark, d):
    return bindings.table(spark, d, "orders").select("o_orderkey", settings.instant(F.col("o_orderdate")).alias("instant"), settings.medium_time(F.col("o_orderdate")).alias("shown"))


_ALLOWED_FILES, _ALLOWED_FOLDERS = ("state/manifest.json",), ("docs", "assets/generated")


def _paths(spark, d):
    """Places of files, good and bad, with the case they stand for."""
    path = F.expr("case doc_id % 9 when 0 then concat('docs/', doc_id, '.md') when 1 then concat('docs/../docs//', doc_id, '.md') when 2 then concat('docs/', doc_id, '.txt') when 3 then concat('assets/generated/', doc_id, '/image-001.png') when 4 then concat('docs/../secret/', doc_id) when 5 then concat('../docs/', doc_id, '.md') when 6 then concat('/docs/', doc_id, '.md') when 7 then 'state/manifest.json' else concat('docs2/', doc_id, '.md') end")
    return _texts(spark, d).select("doc_id", path.alias("path"))


@query("SELECT doc_id, doc_id % 9 IN (0, 1, 2, 3, 7) AS allowed FROM documents")
def paths_allowed(spark, d):
    return checks.allowed_paths(_paths(spark, d), checks.places(spark, _ALLOWED_FILES, _ALLOWED_FOLDERS)).select("doc_id", "allowed")


@query("""
WITH f AS (SELECT doc_id, source || '/' || (doc_id % 500) AS folder FROM documents),
rules AS (SELECT DISTINCT 'area/' || folder AS place FROM f WHERE doc_id % 3 = 0)
SELECT doc_id, 'area/' || folder IN (SELECT place FROM rules) AS allowed FROM f""")
def paths_allowed_by_many(spark, d):
    """Hundreds of allowed folders, taken from the documents themselves."""
    rows = _texts(spark, d).select("doc_id", F.concat(F.lit("area/"), "source", F.lit("/"), (F.col("doc_id") % 500).cast("string")).alias("folder"))
    rules = rows.where("doc_id % 3 = 0").select(F.col("folder").alias("place"), F.lit(False).alias("whole")).distinct()
    return checks.allowed_paths(rows.select("doc_id", F.concat("folder", F.lit("/./deep/"), "doc_id").alias("path")), rules).select("doc_id", "allowed")


# -- checks ------------------------------------------------------------------


@query(f"WITH {_ITEMS.strip()} SELECT 'folder_slug' AS rule, id AS key, CAST(NULL AS VARCHAR) AS detail FROM items WHERE kind = 'folder' AND id LIKE 'n%' AND id LIKE '%3'")
def checks_folder_slugs(spark, d):
    folders = bindings.items(spark, d).where("kind = 'folder'").select("id", F.expr("if(id like 'n%3' or id = 'root', null, lower(name))").alias("slug"))
    return checks.folder_slugs(folders)


@query(f"{_TREE}, {_NEW.strip()} SELECT 'slug_reserved' AS rule, id AS key, base AS detail FROM fresh WHERE base IN ('asia', 'europe', '01-asia')")
def checks_reserved(spark, d):
    return checks.slug_not_reserved(_new(spark, d).select("id", F.col("base").alias("slug")), ("asia", "europe", "01-asia"))


@query("""
SELECT 'front_matter' AS rule, 'docs/' || doc_id || '.md' AS key, CASE doc_id % 7 WHEN 1 THEN 'not_opened' WHEN 2 THEN 'not_closed' WHEN 3 THEN 'no_marker' WHEN 4 THEN 'slug' ELSE 'contentHash' END AS detail
FROM documents WHERE doc_id % 7 BETWEEN 1 AND 5""")
def checks_front_matter(spark, d):
    made = _texts(spark, d).select("doc_id", F.concat(F.lit("docs/"), "doc_id", F.lit(".md")).alias("path"), F.concat(F.lit("a/"), "doc_id").alias("slug"), text.sha256(F.col("text")).alias("content_hash"), F.col("text").alias("body"))
    content = bodies.document(F.lit("t"), F.expr("if(doc_id % 7 = 4, 'other', slug)"), F.expr("if(doc_id % 7 = 5, 'other', content_hash)"), F.col("body"))
    made = made.withColumn("c", content)
    bad = F.expr(f"case doc_id % 7 when 1 then concat('\n', c) when 2 then concat('---\n', regexp_replace(substring(c, 5), '(?m)^---$', '--')) when 3 then replace(c, '{bodies.MARKER}', 'x') else c end")
    return checks.front_matter(made.select("path", bad.alias("content")), made.select("path", "slug", "content_hash"))


@query("""
SELECT 'image' AS rule, doc_id || ' /assets/generated/' || CASE doc_id % 5 WHEN 1 THEN doc_id || '/picture.png' WHEN 2 THEN doc_id + 1 || '/image-001.png' ELSE doc_id || '/image-001.png' END AS key, CASE doc_id % 5 WHEN 1 THEN 'name' WHEN 2 THEN 'other_document' WHEN 3 THEN 'missing' ELSE 'type' END AS detail
FROM documents WHERE doc_id % 5 > 0""")
def checks_images(spark, d):
    rows = _texts(spark, d)
    referenced = rows.select(F.col("doc_id").cast("string").alias("id"), F.expr("concat('/assets/generated/', case doc_id % 5 when 1 then concat(doc_id, '/picture.png') when 2 then concat(doc_id + 1, '/image-001.png') else concat(doc_id, '/image-001.png') end)").alias("href"))
    found = rows.where("doc_id % 5 <> 3").select(F.concat("doc_id", F.lit("/image-001.png")).alias("path"), F.expr("if(doc_id % 5 = 4, 'gif', 'png')").alias("type"))
    return checks.images(referenced, found)


@query("""
SELECT 'content_hash' AS rule, CAST(doc_id AS VARCHAR) AS key, CASE WHEN doc_id % 4 = 2 THEN 'missing' ELSE 'sha256:' || sha256(CAST(to_json({'body': text, 'assets': [{'path': 'a', 'hash': source}]}) AS VARCHAR)) END AS detail
FROM documents WHERE doc_id % 4 IN (1, 2)""")
def checks_content_hashes(spark, d):
    rows = _texts(spark, d).withColumn("id", F.col("doc_id").cast("string"))
    none = F.array().cast("array<struct<path: string, hash: string>>")
    own = F.array(F.struct(F.lit("a").alias("path"), F.col("source").alias("hash")))
    records = rows.select("id", runs.content_hash(F.col("text"), F.when(F.col("doc_id") % 4 == 1, none).otherwise(own)).alias("content_hash"))
    return checks.content_hashes(records, rows.where("doc_id % 4 <> 2").select("id", F.col("text").alias("body")), rows.select("id", F.lit("a").alias("path"), F.col("source").alias("hash")))


@query("""
SELECT 'generated_file' AS rule, p AS key, CASE WHEN doc_id % 9 = 2 THEN 'not_markdown' WHEN doc_id % 9 IN (0, 1) THEN 'no_marker' ELSE 'not_allowed' END AS detail
FROM (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'docs/' || doc_id || '.md' WHEN 1 THEN 'docs/../docs//' || doc_id || '.md' WHEN 2 THEN 'docs/' || doc_id || '.txt' WHEN 4 THEN 'docs/../secret/' || doc_id WHEN 5 THEN '../docs/' || doc_id || '.md' WHEN 6 THEN '/docs/' || doc_id || '.md' WHEN 8 THEN 'docs2/' || doc_id || '.md' END AS p
FROM documents) WHERE doc_id % 9 IN (2, 4, 5, 6, 8) OR doc_id % 9 < 2 AND doc_id % 2 = 1""")
def checks_generated_files(spark, d):
    files = _paths(spark, d).withColumn("content", F.expr(f"if(doc_id % 2 = 0, '{bodies.MARKER}', 'text')"))
    return checks.generated_files(files, checks.places(spark, _ALLOWED_FILES, _ALLOWED_FOLDERS), "docs")


@query("""
WITH p AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'docs/' || doc_id || '.md' WHEN 1 THEN 'docs/../docs//' || doc_id || '.md' WHEN 2 THEN 'docs/' || doc_id || '.txt' WHEN 3 THEN 'assets/generated/' || doc_id || '/image-001.png' WHEN 4 THEN 'docs/../secret/' || doc_id WHEN 5 THEN '../docs/' || doc_id || '.md' WHEN 6 THEN '/docs/' || doc_id || '.md' WHEN 7 THEN 'state/manifest.json' ELSE 'docs2/' || doc_id || '.md' END AS p
FROM documents), g AS (SELECT p, bool_or(doc_id % 11 = 0) AS link, min(doc_id % 9) AS k
FROM p GROUP BY p) SELECT 'working_change' AS rule, p AS key, CASE WHEN k IN (4, 5, 6, 8) THEN 'not_allowed' ELSE 'link' END AS detail
FROM g WHERE k IN (4, 5, 6, 8) OR link""")
def checks_working_changes(spark, d):
    rows = _paths(spark, d).select("path", F.expr("doc_id % 11 = 0").alias("link"))
    return checks.working_changes(rows, rows.where("path not like 'docs/%'"), checks.places(spark, _ALLOWED_FILES, _ALLOWED_FOLDERS))


@query("""
WITH f AS (SELECT doc_id, 'f' || doc_id || ' /docs/*' AS key FROM documents)
SELECT 'headers' AS rule, key, 'no_rule' AS detail FROM f WHERE doc_id % 6 = 1
UNION ALL SELECT 'headers', key, 'lacks x-robots-tag' FROM f WHERE doc_id % 6 IN (2, 5)
UNION ALL SELECT 'headers', key, 'lacks cache-control: private' FROM f WHERE doc_id % 6 = 2
UNION ALL SELECT 'headers', key, 'hidden' FROM f WHERE doc_id % 6 = 4""")
def checks_headers(spark, d):
    """Header files around each document's text, whose lines are rules of other patterns."""
    good = "/docs/*  # all\n  Cache-Control: private, no-store\n\tX-Robots-Tag: noindex\n"
    cases = [good, "/docs/\n  X-Robots-Tag: noindex\n", "/docs/*\n# X-Robots-Tag: noindex\n", "/docs/*\n  ETag: x\n", good, good + "/docs/*\n  Cache-Control: private\n"]
    rules = F.element_at(F.array(*map(F.lit, cases)), (F.col("doc_id") % 6 + 1).cast("int"))
    other = F.regexp_replace(F.regexp_replace("text", r"(?m)^\s+", ""), "#", "")
    files = _texts(spark, d).select("doc_id", F.concat(F.lit("f"), "doc_id").alias("file"), F.concat(other, F.lit("\n"), rules).alias("content"))
    return checks.headers(files, files.select("file", F.lit("/docs/*").alias("pattern"), F.expr("doc_id % 6 in (3, 4)").alias("public")))


@query("""
WITH p AS (SELECT 'docs/' || source || '/' || doc_id || '.md' AS p
FROM documents) SELECT 'exempt' AS rule, p AS key, '7[.]md$' AS detail
FROM p WHERE p LIKE '%7.md' UNION ALL SELECT 'exempt', p, '^docs/src1/'
FROM p WHERE p LIKE 'docs/src1/%'""")
def checks_exempt_paths(spark, d):
    tracked = _texts(spark, d).select(F.concat(F.lit("docs/"), "source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"))
    return checks.exempt_paths(tracked, ("7[.]md$", "^docs/src1/", "^nothing"))


@query("SELECT 'section_page' AS rule, 'n' || n_nationkey AS key, CASE n_nationkey % 4 WHEN 1 THEN 'missing' ELSE 'differs' END AS detail FROM nation WHERE n_nationkey % 4 IN (1, 2)")
def checks_section_pages(spark, d):
    rows = bindings.table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("sections/"), "n_nationkey", F.lit(".md")).alias("page_path"), F.col("n_name").alias("content"), F.expr("n_nationkey % 4").alias("case"))
    pages = rows.where("case <> 1").select(F.col("page_path").alias("path"), F.expr("if(case = 2, concat(content, '!'), content)").alias("content"))
    return checks.section_pages(pages, rows.select("id", "page_path", text.sha256(F.col("content")).alias("page_hash")))


# -- views and outputs -------------------------------------------------------


@query(f"""
{_CORPUS} SELECT folder, place, id, title, CASE WHEN len(trail) > 1 THEN array_to_string(trail[2:], ' / ') END AS qualifier, coalesce(strftime(modified, '%b %-d, %Y'), 'Unknown') AS updated
FROM byfolder""")
def full_index(spark, d):
    return corpus.full_index(_corpus(spark, d)).withColumn("place", F.col("place").cast("long"))


@query(f"""
{_CORPUS}, {_NEW.strip()}, x AS (SELECT d.id, s.slug, len(d.trail) AS n
FROM docs d JOIN slugs s ON s.id = d.id) SELECT 'document' AS sample, arg_min(id, (slug, id)) AS id
FROM x UNION ALL SELECT 'in_folder', arg_min(id, (slug, id)) FROM x
WHERE n > 0 UNION ALL SELECT 'with_table', arg_min(id, (slug, id))
FROM x WHERE id LIKE '%7' UNION ALL SELECT 'with_asset', arg_min(id, (slug, id))
FROM x WHERE id LIKE 's%'""")
def index_samples(spark, d):
    documents = _corpus(spark, d).join(_slugs(spark, d), "id")
    found = documents.select("id", F.expr("if(id like '%7', concat('text\n\n| a | ', title, '\n| --- | --- |\n| 1 | 2 |'), title)").alias("body"))
    return corpus.samples(documents, found, documents.where("id like 's%'").select("id"))


@query(f"{_CORPUS}, {_NEW.strip()} SELECT d.id, '/' || s.slug || '/index.md' AS href FROM docs d JOIN slugs s ON s.id = d.id WHERE modified IS NOT NULL ORDER BY modified DESC, title, d.id LIMIT 1")
def agent_sample(spark, d):
    return corpus.agent_sample(_corpus(spark, d).join(_slugs(spark, d), "id"))


@query(f"""
WITH {_ITEMS.strip()}, n AS (SELECT id, CASE WHEN kind = 'document' THEN (CAST(substr(id, 2) AS BIGINT) % 500) || '. ' || name ELSE name END AS name
FROM items) SELECT id, {_label('name')} AS shown, CAST({_order('name')} // 100 * 100 AS BIGINT) AS \"group\"
FROM n""")
def sidebar_labels(spark, d):
    named = bindings.items(spark, d).select("id", F.expr("if(kind = 'document', concat(cast(substring(id, 2) as bigint) % 500, '. ', name), name)").alias("name"))
    return corpus.sidebar_labels(named).select("id", "shown", F.col("group").cast("long").alias("group"))


_EXTRA = f"{_TREE}, {_RANKED.strip()}, sizes AS (SELECT a AS id FROM (SELECT unnest(ids) AS a FROM tree WHERE kind = 'document') GROUP BY a)"


@query(f"""
{_EXTRA} SELECT r.id, r.ids[2] AS \"group\", r.parent, r.label, r.kind, coalesce(g.sibling_rank, 0) AS group_rank, r.sibling_rank AS rank
FROM ranked r JOIN sizes USING (id) LEFT JOIN ranked g ON g.id = r.ids[2]""")
def navigation_tree(spark, d):
    placed = _placed(spark, d)
    return ordering.navigation_tree(placed, ordering.siblings(placed))


@query(f"""
{_TREE}, {_RANKED.strip()}, {_NEW.strip()} SELECT f.id, coalesce(r.sibling_rank, 0) AS position, CASE WHEN r.id IS NULL THEN 'This section has no documents yet.' ELSE '- [' || r.label || '](/' || s.slug || '/)' || CASE WHEN r.kind = 'document' THEN ': About ' || r.id ELSE '' END END AS line
FROM (SELECT id FROM tree WHERE kind = 'folder' UNION ALL SELECT 'r9') f
LEFT JOIN (SELECT r.*, x.slug FROM ranked r JOIN slugs x ON x.id = r.id) r ON r.parent = f.id
LEFT JOIN slugs s ON s.id = r.id""")
def section_page_lines(spark, d):
    placed = _placed(spark, d)
    described = placed.select("id", F.expr("if(kind = 'document', concat('About ', id), null)").alias("description")).join(_slugs(spark, d), "id")
    folders = placed.where("kind = 'folder'").select("id").unionByName(spark.createDataFrame([("r9",)], "id string"))
    return ordering.section_pages(ordering.siblings(placed), folders, described)


@query(f"""
WITH {_ITEMS.strip()} SELECT id AS key, '{{\"id\":\"' || id || '\",\"kind\":\"' || kind || '\",\"name\":\"' || name || '\"' || CASE WHEN parent IS NOT NULL THEN ',\"parent\":\"' || parent || '\"' ELSE '' END || '}}' AS line
FROM items""")
def manifest_lines(spark, d):
    return rendered.json_lines(bindings.items(spark, d).select("name", "parent", "id", "kind"))


@query("""
SELECT CAST(1 AS BIGINT) AS line_no, '  \"/old/' || s_suppkey || '/\": \"/' || s_name || '/\",' AS line
FROM supplier UNION ALL SELECT 0, '// Generated.' || chr(10) || 'export default {'
UNION ALL SELECT 2, '};'""")
def redirect_module(spark, d):
    entries = bindings.table(spark, d, "supplier").select(F.concat(F.lit("/old/"), "s_suppkey", F.lit("/")).alias("key"), F.concat(F.lit("/"), "s_name", F.lit("/")).alias("value"))
    return rendered.module(entries, "Generated.").withColumn("line_no", F.col("line_no").cast("long"))


@query("SELECT 'module' AS rule, 'm' || s_suppkey AS key, CASE WHEN s_suppkey % 3 = 1 THEN 'missing' ELSE 'differs' END AS detail FROM supplier WHERE s_suppkey % 3 > 0")
def checks_modules(spark, d):
    wanted = bindings.table(spark, d, "supplier").select(F.concat(F.lit("m"), "s_suppkey").alias("path"), F.col("s_name").alias("content"), "s_suppkey")
    files = wanted.where("s_suppkey % 3 <> 1").select("path", F.expr("if(s_suppkey % 3 = 2, concat(content, '\n'), content)").alias("content"))
    return checks.modules(files, wanted)


@query(r"""
SELECT '/' || source || '/' || doc_id || '/index.md' AS path, sha256('# ' || regexp_replace(regexp_extract(text, '^([^\n]*)', 1), '([\\`*_\[\]<>#])', '\\\1', 'g') || chr(10) || chr(10) || text || chr(10)) AS content_hash
FROM documents""")
def markdown_projection(spark, d):
    made = rendered.markdown_routes(bindings.bodies(spark, d).join(_texts(spark, d).select("doc_id", F.concat("source", F.lit("/"), "doc_id").alias("slug")), "doc_id"))
    return made.select("path", F.sha2("content", 256).alias("content_hash"))


@query("""
SELECT '/assets/generated/' || doc_id || '/image-001.' || e AS path, CASE e WHEN 'PNG' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'svg' THEN 'image/svg+xml' END AS type, CASE WHEN e = 'exe' THEN 'unknown_type' END AS issue
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'PNG' WHEN 1 THEN 'jpg' WHEN 2 THEN 'svg' ELSE 'exe' END AS e
FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))""")
def asset_routes(spark, d):
    assets = _texts(spark, d).select(F.col("doc_id").alias("owner"), F.expr("concat(doc_id, '/image-001.', case doc_id % 4 when 0 then 'PNG' when 1 then 'jpg' when 2 then 'svg' else 'exe' end)").alias("path"))
    return rendered.asset_routes(bindings.table(spark, d, "labels").select(F.col("doc_id").alias("id")), assets)


@query(f"{_MANIFEST} SELECT '| ' || class || ' | ' || count(*) || ' |' AS line FROM classed GROUP BY class")
def summary_lines(spark, d):
    counted = reconcile.classes(*_both(spark, d)).groupBy(F.col("class").alias("counter")).agg(F.count("*").alias("value"))
    return rendered.summary_lines(counted)


@query("""
WITH s AS (SELECT user_id AS run, CASE event_id % 6 WHEN 0 THEN 'publish' WHEN 1 THEN 'validate' WHEN 2 THEN 'export' WHEN 3 THEN 'list' WHEN 4 THEN 'authenticate' ELSE 'notify' END AS stage, event_type
FROM events) SELECT run, ['authenticate', 'list', 'export', 'validate', 'publish'][min(list_position(['authenticate', 'list', 'export', 'validate', 'publish'], stage))] AS stage
FROM s WHERE event_type = 'error' AND stage <> 'notify' GROUP BY run""")
def failed_stages(spark, d):
    rows = bindings.table(spark, d, "events").select(F.col("user_id").alias("run"), F.expr("case event_id % 6 when 0 then 'publish' when 1 then 'validate' when 2 then 'export' when 3 then 'list' when 4 then 'authenticate' else 'notify' end").alias("stage"), F.expr("if(event_type = 'error', 'failure', 'success')").alias("outcome"))
    return rendered.failed_stage(rows)


@query(f"{_PARENTS} SELECT DISTINCT kind || ':' || substr(id, 1, 1) AS value FROM items")
def distinct_values(spark, d):
    return bindings.items(spark, d).select(F.concat("kind", F.lit(":"), F.substring("id", 1, 1)).alias("value")).distinct()


@query(f"{_TREE}, {_RANKED.strip()}, {_NAVIGATION.strip()} SELECT * FROM issues ORDER BY code, item_id")
def issues_sorted(spark, d):
    return ordering.issues_in_order(ordering.issues(ordering.siblings(_placed(spark, d))))


@query(f"{_TREE} SELECT id, array_to_string(path, '/') AS path FROM tree ORDER BY 2, 1")
def selection_sorted(spark, d):
    return hierarchy.in_order(_placed(spark, d)).select("id", F.array_join("path", "/").alias("path"))


@query(f"""
{_TREE}, part AS (SELECT * FROM tree WHERE id NOT LIKE 'r%') SELECT id, array_to_string(path[3:], '/') AS path, CAST(depth - 2 AS BIGINT) AS depth
FROM part WHERE kind <> 'unsupported' UNION ALL SELECT id, name, 0
FROM part WHERE kind = 'unsupported'""")
def paths_of_selection(spark, d):
    """Regions and the root are not selected, so nations and parts start their own paths."""
    rows = hierarchy.paths_of_selection(bindings.items(spark, d).where("id not like 'r%'"))
    return rows.select("id", F.array_join("path", "/").alias("path"), F.col("depth").cast("long").alias("depth"))


# -- more of bodies ----------------------------------------------------------


@query("""
SELECT page_id AS id, CAST(p AS BIGINT) AS position, CASE p WHEN 0 THEN 'image-001.png' WHEN 1 THEN 'image-002.gif' WHEN 2 THEN 'image-001.png' END AS file, CASE p WHEN 1 THEN url ELSE 'Image' END AS alt, CASE p WHEN 3 THEN 'missing' WHEN 4 THEN 'unsafe_path' WHEN 5 THEN 'not_an_image' END AS issue
FROM pages, range(0, 6) t(p)""")
def archive_images(spark, d):
    """Pages with six images, two of them equal, one missing, one outside and one that is none."""
    rows = bindings.table(spark, d, "pages").withColumnRenamed("page_id", "id")
    html = F.concat(F.lit('<p><img src="img/a.png"><img alt="'), "url", F.lit('" src="img/b.gif"/><img src="img/../img/c.png" alt=" "><img src="img/d.png"><img src="../../e.png"><img src="f.txt"></p>'))
    png, gif = F.expr("concat(unhex('89504E470D0A1A0A'), encode(url, 'UTF-8'))"), F.expr("concat(encode('GIF89a', 'UTF-8'), encode(url, 'UTF-8'))")
    files = {"docs/img/a.png": png, "docs/img/b.gif": gif, "docs/img/c.png": png, "docs/f.txt": F.encode("url", "UTF-8")}
    entries = rows.select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("path"), v.alias("bytes")) for k, v in files.items()))).alias("e")).select("id", "e.*")
    found = bodies.archive_images(rows.select("id", F.lit("docs").alias("folder"), html.alias("html")), entries)
    return found.select("id", F.col("position").cast("long").alias("position"), "file", "alt", "issue")


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'a/index.HTML' END AS entry FROM pages")
def entry_pages(spark, d):
    paths = F.expr("case page_id % 3 when 0 then array('a/index.HTML', 'a/b.png') when 1 then array('x.css') else array('a.html', 'b.htm') end")
    entries = F.transform(paths, lambda p: F.struct(p.alias("path")))
    return bindings.table(spark, d, "pages").select("page_id", bodies.entry_page(entries)["path"].alias("entry"))


@query("""
SELECT doc_id AS id, CAST(CASE WHEN doc_id % 4 = 3 THEN NULL ELSE 2 END AS BIGINT) AS tabs, CAST(CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 END AS BIGINT) AS inline, CASE doc_id % 4 WHEN 3 THEN NULL ELSE doc_id % 4 < 2 END AS has_images, CASE doc_id % 4 WHEN 3 THEN NULL ELSE doc_id % 4 = 1 END AS has_drawings, CASE doc_id % 4 WHEN 2 THEN 'nested_tabs' WHEN 3 THEN 'no_tabs' END AS issue
FROM documents""")
def document_structures(spark, d):
    image, drawing = '{\\"imageProperties\\":1}', '{\\"embeddedDrawingProperties\\":1}'
    first = f"case doc_id % 4 when 0 then '{{\"a\":\"{image}\"}}' when 1 then '{{\"a\":\"{image}\",\"b\":\"{drawing}\"}}' else '{{}}' end"
    json = F.expr(f"if(doc_id % 4 = 3, 'none', concat('{{\"tabs\":[{{\"documentTab\":{{\"inlineObjects\":', {first}, '}}}},{{\"childTabs\":[', if(doc_id % 4 = 2, '\"x\"', ''), ']}}]}}'))".replace("\\", "\\\\"))
    found = landed.structure(_texts(spark, d).select(F.col("doc_id").alias("id"), json.alias("json")))
    return found.select("id", F.when(F.col("tabs") > 0, F.col("tabs")).cast("long").alias("tabs"), F.when(F.col("tabs") > 0, F.col("inline")).cast("long").alias("inline"), "has_images", "has_drawings", "issue")


@query(f"{_CORPUS}, {_NEW.strip()} SELECT d.id, d.title FROM docs d JOIN slugs s ON s.id = d.id WHERE regexp_matches(d.title, '[\\p{{L}}\\p{{N}}-]{{4,}}') ORDER BY s.slug, d.id LIMIT 5")
def search_cases(spark, d):
    return corpus.search_cases(_corpus(spark, d).join(_slugs(spark, d), "id"))
