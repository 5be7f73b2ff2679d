"""DuckDB SQL of the queries that SQL can express, written apart from the operators."""

from __future__ import annotations

_ITEMS = """
items AS (
  SELECT 'root' AS id, 'Corpus' AS name, 'folder' AS kind, CAST(NULL AS VARCHAR) AS parent, CAST(NULL AS TIMESTAMP) AS modified
  UNION ALL SELECT 'r' || r_regionkey, lpad(CAST(r_regionkey AS VARCHAR), 2, '0') || ' - ' || r_name, 'folder', 'root', NULL FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'folder', 'r' || n_regionkey, NULL FROM nation
  UNION ALL SELECT 'c' || c_custkey, c_mktsegment || ' ' || (c_custkey % 7), 'document', 'n' || c_nationkey, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'Overview', 'document', 'n' || s_nationkey, NULL FROM supplier
  UNION ALL SELECT 'p' || p_partkey, p_name, 'unsupported', 'r' || (p_partkey % 5), NULL FROM part)"""

_TREE_ONLY = """tree AS (
  SELECT id, name, kind, parent, modified, [name] AS path, [id] AS ids, 0 AS depth FROM items WHERE id = 'root'
  UNION ALL
  SELECT i.id, i.name, i.kind, i.parent, i.modified, list_append(t.path, i.name), list_append(t.ids, i.id), t.depth + 1 FROM items i JOIN tree t ON i.parent = t.id)"""
_TREE = f"WITH RECURSIVE {_ITEMS.strip()},\n{_TREE_ONLY}"

_PREFIX = r"^(?:\[(\d{1,3})\]|(\d{1,3})\s*[-–—.])\s*"


def _label(x: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace(trim({x}), '{_PREFIX}', '')), ''), 'Untitled')"


def _order(x: str) -> str:
    return f"CAST(coalesce(nullif(regexp_extract(trim({x}), '{_PREFIX}', 1), ''), nullif(regexp_extract(trim({x}), '{_PREFIX}', 2), '')) AS BIGINT)"


def _segment(x: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace(lower({_label(x)}), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled')"


_BASE = f"array_to_string(list_transform(path[2:], lambda x: {_segment('x')}), '/')"
_RANKED = rf"""
keyed AS (
  SELECT *, {_order('name')} AS number, {_label('name')} AS label FROM tree WHERE kind IN ('folder', 'document') AND parent IS NOT NULL),
tiered AS (
  SELECT *, CASE WHEN number IS NOT NULL THEN 1 WHEN kind = 'document' AND lower(label) IN ('overview', 'readme', 'about') THEN 0 ELSE 2 END AS tier FROM keyed),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY parent ORDER BY tier, CASE WHEN tier = 1 THEN number WHEN tier = 0 THEN list_position(['overview', 'readme', 'about'], lower(label)) ELSE 0 END,
    regexp_replace(regexp_replace(lower(label), '(\d+)', '00000000000000000000\1', 'g'), '\d*(\d{{20}})', '\1', 'g'), id) AS sibling_rank
  FROM tiered)"""
_NEW = f"""
fresh AS (SELECT id, kind, {_BASE} AS base FROM tree WHERE kind IN ('folder', 'document')),
taken AS (
  SELECT lower(n_name) AS slug FROM nation WHERE n_nationkey % 5 = 0
  UNION SELECT base FROM fresh WHERE kind = 'folder' AND id LIKE 'n%' AND CAST(substr(id, 2) AS INT) % 4 = 1),
claims AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY kind <> 'folder', id) AS claim FROM fresh WHERE base <> ''),
slugs AS (
  SELECT id, kind, base, CASE WHEN claim = 1 AND base NOT IN (SELECT slug FROM taken) THEN base ELSE base || '--' || substr(sha256(id), 1, 6) END AS slug FROM claims)"""
_REDIRECTS = "redirects AS (SELECT 'old/' || id AS old_slug, slug AS target, id AS owner FROM slugs WHERE id LIKE 's%')"
_STATIC = "['', 'about', 'documents']"


def _claimed(kept: str, taken: str) -> str:
    """Slugs of what isn't in ``kept`` around ``taken``: the first free claimant of a base has it, others get a suffix."""
    return f"""todo AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY kind <> 'folder', id) AS k FROM fresh WHERE base <> '' AND id NOT IN (SELECT id FROM {kept})),
given AS (SELECT id, kind, CASE WHEN k = 1 AND base NOT IN (SELECT slug FROM {taken}) THEN base ELSE base || '--' || substr(sha256(id), 1, 6) END AS slug FROM todo)"""


_MANIFEST = f"""WITH {_ITEMS.strip()},
current AS (SELECT * FROM items WHERE kind = 'document'),
manifest AS (
  SELECT id, name, CASE WHEN id LIKE 'c%' AND CAST(substr(id, 2) AS BIGINT) % 50 = 2 THEN 'n0' ELSE parent END AS parent,
         CASE WHEN id LIKE 'c%' AND CAST(substr(id, 2) AS BIGINT) % 10 = 1 THEN modified - INTERVAL 1 DAY ELSE modified END AS modified
  FROM current WHERE id LIKE 's%' OR CAST(substr(id, 2) AS BIGINT) % 10 <> 0
  UNION ALL SELECT 'x' || c_custkey, c_name, 'n1', NULL FROM customer WHERE c_custkey % 97 = 0),
classed AS (
  SELECT coalesce(c.id, m.id) AS id, CASE WHEN m.id IS NULL THEN 'added' WHEN c.id IS NULL THEN 'removed'
         WHEN c.name IS DISTINCT FROM m.name OR c.parent IS DISTINCT FROM m.parent OR c.modified IS DISTINCT FROM m.modified THEN 'changed' ELSE 'unchanged' END AS class
  FROM current c FULL JOIN manifest m ON c.id = m.id)"""
_PARENTS = f"""WITH RECURSIVE {_ITEMS.strip()},
links AS (
  SELECT id, parent FROM items
  UNION ALL SELECT 'c' || c_custkey, 'n2' FROM customer WHERE c_custkey % 40 = 3
  UNION ALL SELECT 'l' || c_custkey, 'gone' || c_custkey FROM customer WHERE c_custkey % 60 = 7
  UNION ALL SELECT 'a' || c_custkey, 'b' || c_custkey FROM customer WHERE c_custkey % 80 = 9
  UNION ALL SELECT 'b' || c_custkey, 'a' || c_custkey FROM customer WHERE c_custkey % 80 = 9)"""
_MULTIPLE = "SELECT 'multiple_parents' AS code, id AS item_id, CAST(NULL AS VARCHAR) AS related_id FROM links GROUP BY id HAVING count(*) > 1"
_UNRESOLVED = "SELECT 'unresolved_parent' AS code, id AS item_id, parent AS related_id FROM links WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM links)"
_NAVIGATION = """
firsts AS (SELECT *, first_value(id) OVER (PARTITION BY parent, tier, CASE WHEN tier = 1 THEN number ELSE 0 END ORDER BY sibling_rank) AS holder, min(tier) OVER (PARTITION BY parent) AS lowest FROM ranked),
issues AS (
  SELECT CASE tier WHEN 1 THEN 'duplicate_navigation_order' ELSE 'multiple_landing_documents' END AS code, id AS item_id, holder AS related_id FROM firsts WHERE tier < 2 AND id <> holder
  UNION ALL SELECT 'unrecognized_order_prefix', id, NULL FROM firsts WHERE lowest < 2 AND regexp_matches(trim(name), '^\\d{1,3}(?:\\s|$)') AND NOT regexp_matches(trim(name), '^(?:\\[(\\d{1,3})\\]|(\\d{1,3})\\s*[-–—.])\\s*'))""".replace("\\\\", "\\")
_ORDER = f"""{_TREE}, {_RANKED.strip()},
sizes AS (SELECT a AS id, count(*) AS size FROM (SELECT unnest(ids) AS a FROM tree WHERE kind = 'document') GROUP BY a),
before AS (SELECT r.id, coalesce(sum(s.size) OVER (PARTITION BY r.parent ORDER BY r.sibling_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM ranked r JOIN sizes s ON r.id = s.id),
places AS (SELECT d.id, CAST(1 + sum(b.n) AS BIGINT) AS place FROM (SELECT id, unnest(ids) AS a FROM tree WHERE kind = 'document') d JOIN before b ON b.id = d.a GROUP BY d.id)"""
_DESCRIPTION = r"""
WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g')) AS flat FROM documents),
h AS (SELECT doc_id, flat, substr(flat, 1, 201) AS head FROM f)
SELECT doc_id, CASE WHEN length(flat) <= 200 THEN flat
  ELSE rtrim(substr(flat, 1, CASE WHEN instr(head, ' ') > 0 AND length(head) - instr(reverse(head), ' ') >= 120 THEN length(head) - instr(reverse(head), ' ') ELSE 200 END)) || '…' END AS description
FROM h"""
_LINKS = "l AS (SELECT page_id, unnest(range(0, len(h))) AS position, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS h FROM pages))"
_SOURCES = _LINKS + ", src AS (SELECT 'a/p' || page_id AS source, CASE page_id % 4 WHEN 0 THEN href WHEN 1 THEN '..' || href || '/' WHEN 2 THEN substr(href, 2) || '#top' ELSE '.' || href || '?x=1' END AS href FROM l)"
#: The shapes above have at most one '..', right after the source.
_ROUTE = """
plain AS (SELECT source, href, regexp_replace(href, '[?#].*$', '') AS p FROM src),
full_path AS (SELECT source, href, CASE WHEN starts_with(p, '/') THEN p WHEN starts_with(p, '../') THEN regexp_replace('/' || source, '/[^/]*$', '') || substr(p, 3) WHEN starts_with(p, './') THEN '/' || source || substr(p, 2) ELSE '/' || source || '/' || p END AS p FROM plain),
routed AS (SELECT source, href, url_decode(replace(array_to_string(list_filter(string_split(p, '/'), lambda x: x <> '' AND x <> '.'), '/'), '+', '%2B')) AS route FROM full_path WHERE NOT starts_with(href, '#') AND NOT starts_with(href, '//'))"""
_VALID = "valid AS (SELECT 'a/p' || page_id AS slug FROM pages UNION SELECT substr(href, 2) FROM l GROUP BY href HAVING count(DISTINCT page_id) > 1 UNION SELECT unnest(['', 'about', 'documents']))"
_PROVIDER = "p AS (SELECT doc_id, doc_id + 1 AS t FROM documents)"
_TARGET = "CASE doc_id % 7 WHEN 3 THEN 'https://docs.google.com/document/d/d' || t || '/edit' WHEN 4 THEN 'https://example.com/' || t END"
_CORPUS = f"""{_TREE},
docs AS (
  SELECT id, name AS title, list_transform(path[2:len(path) - 1], lambda x: {_label('x')}) AS trail, modified, CASE WHEN name = 'Overview' THEN 'About ' || id END AS description
  FROM tree WHERE kind = 'document'),
foldered AS (SELECT *, coalesce(trail[1], 'General') AS folder FROM docs),
byfolder AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY modified DESC NULLS LAST, title, id) AS place FROM foldered)"""
_TERMS = r"words AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}-]+')) AS term FROM documents), terms AS (SELECT term, id, count(*) AS tf FROM words WHERE length(term) >= 4 AND NOT regexp_matches(term, '^[0-9]+$') GROUP BY term, id)"
_SEARCH = rf"""WITH {_TERMS},
asked AS (SELECT DISTINCT doc_id AS query, term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(regexp_extract(text, '^([^\n]*)', 1)), '[\p{{L}}\p{{N}}-]+')) AS term FROM documents WHERE doc_id % 20 = 0) WHERE length(term) >= 4 AND NOT regexp_matches(term, '^[0-9]+$')),
df AS (SELECT term, count(*) AS df FROM terms GROUP BY term),
scores AS (SELECT query, id, round(sum(tf * ln((SELECT count(*) FROM documents)::DOUBLE / df)), 6) AS score FROM asked JOIN terms USING (term) JOIN df USING (term) GROUP BY query, id),
placed AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM scores)"""
_DAYS = "CAST(floor((epoch(TIMESTAMP '2001-01-01') - epoch(date_trunc('second', o_orderdate))) / 86400) AS BIGINT)"

ORACLE: dict[str, str] = {
    "inventory_paths": f"{_TREE} SELECT id, array_to_string(path, '/') AS path, CAST(depth AS BIGINT) AS depth FROM tree",
    "inventory_selection_counts": f"""
        {_TREE} SELECT (SELECT count(*) FROM items) AS all_item_count, count(*) AS descendant_count, (SELECT count(*)
        FROM items) - count(*) AS outside_root_count, count(*) FILTER (WHERE list_has_any(ids, ['r1', 'n3'])) AS ignored_count
        FROM tree""",
    "inventory_children": f"""
        {_TREE} SELECT parent, count(*) FILTER (WHERE kind = 'folder') AS n_folder, count(*) FILTER (WHERE kind = 'document') AS n_document, count(*) FILTER (WHERE kind = 'unsupported') AS n_unsupported, coalesce(string_agg(id, ',' ORDER BY name, id) FILTER (WHERE kind = 'folder'), '') AS folder_ids, coalesce(string_agg(id, ',' ORDER BY name, id) FILTER (WHERE kind = 'document'), '') AS document_ids
        FROM tree WHERE parent IS NOT NULL GROUP BY parent""",
    "inventory_children_in_order": f"""
        {_TREE} SELECT parent, kind, row_number() OVER (PARTITION BY parent, kind
        ORDER BY name, id) AS position, id FROM tree WHERE parent IS NOT NULL AND kind IN ('folder', 'document')""",
    "ignored_subtree": f"{_TREE} SELECT id, kind FROM tree WHERE NOT list_has_any(ids, ['r1', 'n3'])",
    "unsupported_items": f"{_TREE} SELECT id, name, array_to_string(path, '/') AS path FROM tree WHERE kind = 'unsupported'",
    "issues_multiple_parents": f"{_PARENTS} {_MULTIPLE}",
    "issues_unresolved_parent": f"{_PARENTS} {_UNRESOLVED}",
    "issues_duplicate_id": f"{_PARENTS} SELECT 'duplicate_id' AS code, id AS item_id, unnest(range(2, n + 1)) AS occurrence FROM (SELECT id, count(*) AS n FROM links GROUP BY id HAVING count(*) > 1)",
    "issues_cycle": f"""
        {_PARENTS}, one AS (SELECT id, min(parent) AS parent FROM links
        GROUP BY id) SELECT 'cycle' AS code, a.id AS item_id, a.parent AS related_id
        FROM one a JOIN one b ON a.parent = b.id WHERE b.parent = a.id AND b.id < a.id""",
    "issues_ignored": f"""
        {_TREE}, asked AS (SELECT DISTINCT unnest(['root', 'r1', 'c1', 'nowhere', 'n3', 'n3', 'p2']) AS item_id),
        known AS (SELECT a.item_id, i.kind, a.item_id IN (SELECT id FROM tree) AS inside
        FROM asked a LEFT JOIN items i ON i.id = a.item_id) SELECT CASE WHEN item_id = 'root' THEN 'ignored_root' WHEN kind IS NULL THEN 'ignored_not_found' WHEN kind <> 'folder' THEN 'ignored_not_folder' ELSE 'ignored_outside_root' END AS code, item_id
        FROM known WHERE item_id = 'root' OR kind IS DISTINCT FROM 'folder' OR NOT inside""",
    "order_prefix": f"WITH {_ITEMS.strip()} SELECT id, {_order('name')} AS order_number, {_label('name')} AS label FROM items",
    "unrecognized_prefix": rf"""
        WITH c AS (SELECT c_custkey, (c_custkey % 1500) || CASE c_custkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN ' - ' WHEN 2 THEN '. ' ELSE '' END || c_mktsegment AS name
        FROM customer) SELECT c_custkey, name, regexp_matches(name, '^\d{{1,3}}(?:\s|$)') AND NOT regexp_matches(name, '{_PREFIX}') AS unrecognized
        FROM c""",
    "slug_segment": f"WITH {_ITEMS.strip()} SELECT id, {_segment('name')} AS slug FROM items",
    "base_slug": f"{_TREE} SELECT id, {_BASE} AS base FROM tree",
    "slug_collisions": f"{_TREE}, {_NEW.strip()} SELECT base, count(*) AS claims FROM fresh WHERE base <> '' GROUP BY base HAVING count(*) > 1",
    "slug_allocation": f"{_TREE}, {_NEW.strip()} SELECT id, slug FROM slugs",
    "redirect_map": f"{_TREE}, {_NEW.strip()}, {_REDIRECTS} SELECT '/' || old_slug || '/' AS source, '/' || target || '/' AS destination FROM redirects",
    "redirects_retargeted": f"""
        {_TREE}, {_NEW.strip()}, {_REDIRECTS}, moved AS (SELECT slug, 'moved/' || id AS new_slug
        FROM slugs WHERE id LIKE 's%' OR id LIKE 'c%') SELECT old_slug, coalesce(new_slug, target) AS target
        FROM redirects LEFT JOIN moved ON target = slug UNION ALL SELECT slug, new_slug
        FROM moved""",
    "reseed_slug": f"""
        {_TREE}, {_NEW.strip()}, nothing AS (SELECT id FROM fresh WHERE kind <> 'document'),
        used AS (SELECT slug FROM taken UNION ALL SELECT unnest({_STATIC})), {_claimed('nothing', 'used')}
        SELECT id, 'earlier/' || id AS old_slug, slug AS new_slug FROM given""",
    "slug_carry_forward": f"""
        {_TREE}, {_NEW.strip()}, old AS (SELECT id, 'earlier/' || id AS slug
        FROM fresh WHERE kind = 'folder' OR id LIKE '%2' OR id LIKE '%5'),
        used AS (SELECT slug FROM old UNION ALL SELECT base FROM fresh
        WHERE kind = 'folder' UNION ALL SELECT unnest({_STATIC})), {_claimed('old', 'used')}
        SELECT id, slug, true AS kept FROM old UNION ALL SELECT id, slug, false
        FROM given""",
    "slug_universe": f"""
        {_TREE}, {_NEW.strip()} SELECT 'old/' || base AS slug, 'redirect' AS owner
        FROM fresh WHERE base <> '' AND kind = 'folder' UNION ALL SELECT base, kind
        FROM fresh WHERE base <> '' UNION ALL SELECT unnest({_STATIC}), 'route'""",
    "slug_manifest_issues": f"""
        {_TREE}, {_NEW.strip()} SELECT base AS slug, count(*) AS claims
        FROM (SELECT base FROM fresh WHERE base <> '' UNION ALL SELECT base
        FROM fresh WHERE base <> '' AND kind = 'folder') GROUP BY base HAVING count(*) > 1""",
    "sibling_order": f"{_TREE}, {_RANKED.strip()} SELECT id, parent, sibling_rank FROM ranked",
    "navigation_issues": f"{_TREE}, {_RANKED.strip()}, {_NAVIGATION.strip()} SELECT * FROM issues",
    "sidebar_nodes": f"{_ORDER} SELECT r.id, r.parent, r.label, r.sibling_rank, s.size AS documents FROM ranked r JOIN sizes s ON r.id = s.id",
    "sidebar_pruned": f"{_TREE} SELECT id FROM tree t WHERE kind = 'folder' AND NOT EXISTS (SELECT 1 FROM tree d WHERE d.kind = 'document' AND d.parent <> 'n7' AND list_contains(d.ids, t.id))",
    "reading_order": f"{_ORDER} SELECT id, place FROM places",
    "prev_next": f"{_ORDER} SELECT id, lag(id) OVER (ORDER BY place) AS previous_id, lead(id) OVER (ORDER BY place) AS next_id FROM places",
    "section_listing": f"{_TREE}, {_RANKED.strip()}, {_NEW.strip()} SELECT r.parent AS section, r.sibling_rank AS position, r.label, s.slug FROM ranked r JOIN slugs s ON s.id = r.id",
    "reconcile_classes": f"{_MANIFEST} SELECT id, class FROM classed",
    "reconcile_counters": f"""
        {_MANIFEST} SELECT count(*) FILTER (WHERE class = 'added') AS added, count(*) FILTER (WHERE class = 'changed') AS changed, count(*) FILTER (WHERE class = 'unchanged') AS unchanged, count(*) FILTER (WHERE class = 'removed') AS removed
        FROM classed""",
    "needs_export": f"{_MANIFEST} SELECT id, class <> 'unchanged' AS needs_export FROM classed WHERE class <> 'removed'",
    "needs_export_broad": f"""
        {_MANIFEST} SELECT class <> 'unchanged' OR (SELECT bool_or(class IN ('added', 'removed'))
        FROM classed) AS needs_export, count(*) AS documents FROM classed
        WHERE class <> 'removed' GROUP BY 1""",
    "removed_documents": f"{_MANIFEST} SELECT id FROM manifest WHERE id NOT IN (SELECT id FROM current)",
    "corpus_changed": f"{_MANIFEST} SELECT count(*) FILTER (WHERE class IN ('added', 'removed')) > 0 AS corpus_changed FROM classed",
    "folder_shape_changed": f"WITH {_ITEMS.strip()}, folders AS (SELECT id, {_label('name')} AS label, {_label("regexp_replace(name, '^0', '1')")} AS renumbered, parent, CASE WHEN id = 'n4' THEN 'r0x' ELSE parent END AS moved FROM items WHERE kind = 'folder') SELECT 'renumbered' AS run, bool_or(label IS DISTINCT FROM renumbered) AS shape_changed FROM folders UNION ALL SELECT 'moved', bool_or(parent IS DISTINCT FROM moved) FROM folders",
    "overlay_folders": f"""
        {_MANIFEST}, fresh AS (SELECT id, upper(name) AS name, parent
        FROM current WHERE parent IN ('n1', 'n2')) SELECT * FROM fresh
        UNION ALL SELECT id, name, parent FROM manifest WHERE id NOT IN (SELECT id
        FROM fresh)""",
    "run_summary": f"{_MANIFEST} SELECT counter, (SELECT count(*) FROM classed WHERE class = counter) AS value FROM (VALUES ('added'), ('changed'), ('unchanged'), ('removed')) t(counter)",
    "warning_counts": f"""
        {_PARENTS}, {_TREE_ONLY}, {_RANKED.strip()}, {_NAVIGATION.strip()},
        every AS (SELECT * FROM ({_MULTIPLE}) UNION ALL SELECT * FROM ({_UNRESOLVED})
        UNION ALL SELECT * FROM issues) SELECT code, count(*) AS issues
        FROM every GROUP BY code""",
    "content_hash": "SELECT doc_id, 'sha256:' || sha256(text) AS content_hash FROM documents",
    "duplicate_content": "SELECT 'sha256:' || sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1",
    "asset_numbering": """
        WITH f AS (SELECT page_id, unnest(range(0, len(h))) AS position, unnest(h) AS asset
        FROM (SELECT page_id, regexp_extract_all(html, '[A-Za-z]{9,}') AS h
        FROM pages)), g AS (SELECT page_id, asset, min(position) AS position
        FROM f GROUP BY page_id, asset) SELECT page_id, sha256(asset) AS hash, 'image-' || lpad(CAST(row_number() OVER (PARTITION BY page_id
        ORDER BY position) AS VARCHAR), 3, '0') AS file FROM g""",
    "description_truncate": _DESCRIPTION,
    "newline_normalize": "SELECT doc_id, 'sha256:' || sha256(text) AS hash FROM documents",
    "heading_escape": r"""SELECT doc_id, regexp_replace(t, '([\\`*_\[\]<>#])', '\\\1', 'g') AS heading, replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM (SELECT doc_id, regexp_extract(text, '^([^\n]*)', 1) AS t FROM documents)""",
    "asset_mime": r"""WITH b AS (SELECT doc_id, (CASE doc_id % 6 WHEN 0 THEN '\x89PNG\x0D\x0A\x1A\x0A'::BLOB WHEN 1 THEN '\xFF\xD8\xFF\xE0'::BLOB WHEN 2 THEN 'GIF89a'::BLOB WHEN 3 THEN 'RIFF\x00\x00\x00\x00WEBP'::BLOB ELSE ''::BLOB END) || encode(text) AS data FROM documents), h AS (SELECT doc_id, hex(data) AS h FROM b)
        SELECT doc_id, CASE WHEN starts_with(h, hex('\x89PNG\x0D\x0A\x1A\x0A'::BLOB)) THEN 'png' WHEN h LIKE 'FFD8FF%' THEN 'jpg' WHEN starts_with(h, hex('GIF87a'::BLOB)) OR starts_with(h, hex('GIF89a'::BLOB)) THEN 'gif' WHEN starts_with(h, hex('RIFF'::BLOB)) AND substr(h, 17, 8) = hex('WEBP'::BLOB) THEN 'webp' END AS type FROM h""",
    "link_extract": f"WITH {_LINKS} SELECT page_id, CAST(position AS BIGINT) AS position, href FROM l",
    "link_policy": f"WITH {_LINKS} SELECT page_id, CAST(position AS BIGINT) AS position, (page_id + position) % 6 IN (0, 1, 5) AS allowed FROM l",
    "link_route_path": f"WITH {_SOURCES}, {_ROUTE.strip()} SELECT source, href, route FROM routed",
    "valid_slugs": f"WITH {_LINKS}, {_VALID} SELECT slug FROM valid",
    "broken_links": f"WITH {_SOURCES}, {_ROUTE.strip()}, {_VALID} SELECT source, route AS target, count(*) AS links FROM routed WHERE route NOT IN (SELECT slug FROM valid) GROUP BY ALL",
    "link_unwrap": f"WITH {_PROVIDER} SELECT doc_id, {_TARGET} AS target FROM p",
    "link_rewrite": f"""WITH {_PROVIDER}, known AS (SELECT doc_id AS k FROM documents JOIN labels USING (doc_id))
        SELECT doc_id, CASE WHEN doc_id % 7 <= 3 AND k IS NOT NULL THEN '/section/doc-' || t || '/' || CASE doc_id % 7 WHEN 1 THEN '#intro' ELSE '' END
               ELSE coalesce({_TARGET}, CASE doc_id % 7 WHEN 0 THEN 'https://docs.google.com/document/d/d' || t || '/edit#heading=h.x1' WHEN 1 THEN 'https://docs.google.com/document/d/d' || t || '/view?usp=sharing#intro' WHEN 2 THEN 'https://drive.google.com/open?id=d' || t WHEN 5 THEN 'https://www.google.com/url?q=javascript:x' ELSE 'https://example.com/p' || t || '#part' END) END AS new_href,
               doc_id % 7 = 0 AND k IS NOT NULL AS removed_anchor
        FROM p LEFT JOIN known ON k = t""",
    "corpus_summary": f"{_CORPUS} SELECT count(*) AS document_count, max(modified) AS latest_change FROM docs",
    "corpus_groups": f"""
        {_CORPUS}, marked AS (SELECT folder, description, row_number() OVER (PARTITION BY folder
        ORDER BY modified DESC NULLS LAST, title, id) AS k FROM foldered
        WHERE lower(trim(title)) IN ('overview', 'readme', 'about') OR lower(trim(title)) = lower(folder))
        SELECT f.folder, count(*) AS document_count, max(f.modified) AS newest, any_value(m.description) AS description, 'section-' || url_encode(replace(lower(f.folder), ' ', '-')) AS anchor
        FROM foldered f LEFT JOIN marked m ON m.folder = f.folder AND m.k = 1
        GROUP BY f.folder""",
    "recent_documents": f"{_CORPUS} SELECT id, title, modified FROM docs WHERE modified IS NOT NULL ORDER BY modified DESC, title, id LIMIT 6",
    "folder_cards": f"{_CORPUS} SELECT folder, place, title, id FROM byfolder WHERE place <= 3",
    "breadcrumbs": f"""
        {_CORPUS} SELECT id, CAST(p AS BIGINT) AS position, trail[p] AS label, CASE WHEN p = 1 THEN CASE WHEN trail[1] IN (SELECT r_name
        FROM region) AND trail[1] <> 'ASIA' THEN '/' || lower(trail[1]) || '/' ELSE '/documents/#section-' || url_encode(replace(lower(trail[1]), ' ', '-')) END END AS href
        FROM (SELECT id, trail, unnest(range(1, len(trail) + 1)) AS p
        FROM docs)""",
    "folder_anchor": """
        SELECT p_partkey, 'section-' || replace(replace(replace(replace(replace(url_encode(replace(lower(p_name || ' (a+b)/~''' || p_brand), ' ', '-')), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') AS anchor
        FROM part""",
    "freshness": f"""
        WITH o AS (SELECT o_orderkey, o_orderdate, {_DAYS} AS d FROM orders),
        m AS (SELECT *, CAST(floor(d / 30.44 + 0.5) AS BIGINT) AS mo, CAST(floor(d / 365.25 + 0.5) AS BIGINT) AS y
        FROM o) SELECT o_orderkey, CASE WHEN d < 0 THEN 'just now' WHEN d = 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d < 30 THEN d || ' days ago' WHEN mo = 1 THEN 'last month' WHEN mo < 12 THEN mo || ' months ago' WHEN y = 1 THEN 'last year' ELSE y || ' years ago' END AS age, CASE WHEN d <= 14 THEN 'fresh' WHEN d <= 90 THEN 'recent' ELSE 'older' END AS freshness, strftime(o_orderdate, '%b %-d, %Y') AS shown
        FROM m""",
    "search_terms": f"WITH {_TERMS} SELECT term, id, tf FROM terms",
    "search_topk": f"{_SEARCH} SELECT query, place, id, score FROM placed WHERE place <= 5",
    "search_own_title": f"{_SEARCH} SELECT DISTINCT query, EXISTS (SELECT 1 FROM placed p WHERE p.query = a.query AND p.id = a.query AND p.place <= 5) AS found FROM asked a",
    "checks_slug_unique": f"{_TREE}, {_NEW.strip()} SELECT 'slug_unique' AS rule, base AS key, CAST(count(*) AS VARCHAR) AS detail FROM fresh WHERE base <> '' GROUP BY base HAVING count(*) > 1",
    "checks_redirects": f"""
        {_TREE}, {_NEW.strip()}, {_REDIRECTS}, r AS (SELECT CASE WHEN owner LIKE '%7' THEN target ELSE old_slug END AS old_slug, CASE WHEN owner LIKE '%6' THEN 'stale' ELSE target END AS target, owner
        FROM redirects) SELECT 'redirect_source_used' AS rule, old_slug AS key, s.id AS detail
        FROM r JOIN slugs s ON s.slug = r.old_slug UNION ALL SELECT 'redirect_to_itself', old_slug, target
        FROM r WHERE old_slug = target UNION ALL SELECT 'redirect_target', old_slug, target
        FROM r LEFT JOIN slugs s ON s.id = r.owner WHERE r.target IS DISTINCT
        FROM s.slug""",
    "checks_orphans": "SELECT 'orphan' AS rule, 'assets/' || doc_id || '.png' AS key, CAST(NULL AS VARCHAR) AS detail FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "checks_paths": f"WITH {_ITEMS.strip()} SELECT 'path' AS rule, id AS key, 'docs/' || upper(id) || '.md' AS detail FROM items WHERE kind = 'document' AND id LIKE '%13'",
    "checks_hashes": """
        SELECT 'hash' AS rule, CAST(doc_id AS VARCHAR) AS key, CASE WHEN CAST(doc_id AS VARCHAR) LIKE '%77' THEN 'missing' ELSE 'sha256:' || sha256(text) END AS detail
        FROM documents WHERE CAST(doc_id AS VARCHAR) LIKE '%5' OR CAST(doc_id AS VARCHAR) LIKE '%77'""",
    "checks_index": f"""
        WITH {_ITEMS.strip()} SELECT 'index' AS rule, id AS key, CASE WHEN id LIKE '%21' THEN 'missing' ELSE 'docs/' || id || '.md' END AS detail
        FROM items WHERE kind = 'document' AND (id LIKE '%21' OR id LIKE '%42')""",
    "checks_files": f"""
        {_MANIFEST} SELECT CASE class WHEN 'added' THEN 'file_missing' ELSE 'file_unexpected' END AS rule, 'docs/' || id AS key, CAST(NULL AS VARCHAR) AS detail
        FROM classed WHERE class IN ('added', 'removed')""",
}
ORACLE["slug_unicode"] = f"WITH t AS (SELECT doc_id, {_label("regexp_extract(text, '^([^' || chr(10) || ']*)', 1)")} AS l FROM documents) SELECT doc_id, coalesce(nullif(trim(regexp_replace(lower(strip_accents(l)), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-'), ''), 'untitled') AS slug FROM t"
