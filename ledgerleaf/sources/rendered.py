"""Texts that a run writes: records as JSON lines, modules of the site, Markdown files, summaries and failures.

Each gives rows of text, so Spark writes them in parallel and ``publish`` swaps them in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions import text

# Media types of generated assets by extension.
MEDIA = {"avif": "image/avif", "gif": "image/gif", "jpg": "image/jpeg", "png": "image/png", "svg": "image/svg+xml", "webp": "image/webp"}
#: Stages of a run in their order, for reports of failures.
STAGES = ("authenticate", "list", "export", "validate", "publish")


def json_lines(records: DataFrame, key: str = "id") -> DataFrame:
    """(key, line): each record as JSON with its fields in order of their names; fields without value are left out."""
    return records.select(F.col(key).alias("key"), F.to_json(F.struct(*sorted(records.columns))).alias("line"))


def module(entries: DataFrame, header: str) -> DataFrame:
    """(line_no, line) of a module with one entry (key, value) a line in order of key; the lines of keys are numbered after the header's.

    ``line_no`` is null but for the header and the end: lines sort by (line_no, line).
    """
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r"^\{\"v\":(.*)\}$", 1)
    lines = entries.select(F.lit(1).alias("line_no"), F.concat(F.lit("  "), quoted("key"), F.lit(": "), quoted("value"), F.lit(",")).alias("line"))
    ends = entries.sparkSession.createDataFrame([(0, f"// {header}\nexport default {{"), (2, "};")], "line_no int, line string")
    return lines.unionByName(ends)


def document_lines(records: DataFrame, key: str = "id", section: str = "section") -> DataFrame:
    """(section, key, text): a document of records by section and key, as its text in order of both.

    Records are indented by four, their fields in order of name; all of a section but the
    last end with a comma. A section opens before its first and closes after its last record.
    """
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.cast("string").alias("v"))), r"^\{\"v\":(.*)\}$", 1)
    fields = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'      "{c}": '), quoted(F.col(c)))) for c in sorted(set(records.columns) - {key, section})]
    last = records.groupBy(section).agg(F.max(key).alias("_last"))
    body = F.concat(F.lit("    "), quoted(F.col(key)), F.lit(": {\n"), F.array_join(F.array_compact(F.array(*fields)), ",\n"), F.lit("\n    }"), F.when(F.col(key) == F.col("_last"), "").otherwise(","))
    return records.join(last, section).select(F.col(section).alias("section"), F.col(key).alias("key"), body.alias("text"))


def sidebar_file(groups: DataFrame, path: str, header: str) -> DataFrame:
    """(path, content): the sidebar (sibling_rank, label, items array of (label, link)) as one module, groups in order of rank."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"^\{\"v\":(.*)\}$", 1)
    links = F.array_join(F.transform("items", lambda x: F.concat(F.lit('      { "label": '), quoted(x["label"]), F.lit(', "link": '), quoted(x["link"]), F.lit(" }"))), ",\n")
    one = F.concat(F.lit('  {\n    "label": '), quoted(F.col("label")), F.lit(',\n    "items": ['), F.when(links != "", F.concat(F.lit("\n"), links, F.lit("\n    "))).otherwise(""), F.lit("]\n  }"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sibling_rank", one.alias("text")))), lambda g: g["text"]), ",\n")
    made = groups.agg(ordered.alias("body"))
    return made.select(F.lit(path).alias("path"), F.concat(F.lit(f"// {header}\nexport const generatedSidebar = [\n"), "body", F.lit("\n];\n")).alias("content"))


def markdown_routes(documents: DataFrame) -> DataFrame:
    """(path, content) of the Markdown projections of (slug, title, body)."""
    return documents.select(F.concat(F.lit("/"), "slug", F.lit("/index.md")).alias("path"), F.concat(F.lit("# "), text.escape_heading(F.col("title")), F.lit("\n\n"), "body", F.lit("\n")).alias("content"))


def media_type(path: Column) -> Column:
    """By extension; null for others."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*(F.lit(x) for pair in MEDIA.items() for x in pair))
    return F.element_at(known, extension)


def asset_routes(documents: DataFrame, assets: DataFrame) -> DataFrame:
    """(path, type, issue) of the assets (owner, path) of documents (id); types that aren't known are an issue."""
    rows = assets.join(documents.select(F.col("id").alias("owner")), "owner", "left_semi")
    found = media_type(F.col("path"))
    return rows.select(F.concat(F.lit("/assets/generated/"), "path").alias("path"), found.alias("type"), F.when(found.isNull(), "unknown_type").alias("issue"))


def summary_lines(counters: DataFrame) -> DataFrame:
    """(line) of a Markdown table of (counter, value)."""
    return counters.select(F.concat(F.lit("| "), "counter", F.lit(" | "), F.col("value").cast("string"), F.lit(" |")).alias("line"))


def failed_stage(outcomes: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """(run, stage): the first stage in the fixed order that failed, of each run with a failure; outcomes: (run, stage, outcome)."""
    place = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    failed = outcomes.where("outcome = 'failure'").select("run", place.alias("place")).where("place > 0").groupBy("run").agg(F.min("place").alias("place"))
    return failed.select("run", F.element_at(F.array(*map(F.lit, stages)), F.col("place").cast("int")).alias("stage"))
