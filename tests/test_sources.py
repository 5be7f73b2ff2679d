"""The paged data source, the file sink, whole manifests, and readers of landed files."""

import json

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerleaf.operators import checks
from ledgerleaf.plans import publication
from ledgerleaf.sources import landed, paged, publish


def pages(folder, chain):
    folder.mkdir()
    for i, (token, after, files, incomplete) in enumerate(chain):
        (folder / f"{i}.json").write_text(json.dumps({"pageToken": token, "nextPageToken": after, "incompleteSearch": incomplete, "files": files}))
    return str(folder)


def item(i, **more):
    return {"id": i, "name": i.upper(), "mimeType": landed.DOCUMENT, "parents": ["root"], "modifiedTime": "2024-01-02T03:04:05", "trashed": False} | more


def test_listing(spark, tmp_path):
    whole = pages(tmp_path / "whole", [(None, "b", [item("x"), item("y", trashed=True)], False), ("b", "c", [item("z", mimeType="text/csv", parents=None)], False), ("c", None, [item("w", mimeType=landed.FOLDER)], None)])
    for setting in ("false", "true"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", setting)
        rows = paged.listing(spark, whole)
        assert sorted((r.id, r.kind, r.parent) for r in rows.collect()) == [("w", "folder", "root"), ("x", "document", "root"), ("z", "unsupported", None)]
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert ("Filter (" in plan) == (setting == "false")
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert rows.first().modified.isoformat() == "2024-01-02T03:04:05"
    narrow = spark.read.format("landed_pages").schema("id string").load(f"file:{whole}")
    assert sorted(r.id for r in narrow.collect()) == ["w", "x", "y", "z"]


@pytest.mark.parametrize(
    ("chain", "code"),
    [
        ([(None, "b", [], False), ("b", "b", [], False)], "repeated_token"), ([(None, "b", [], False)], "missing_page"), ([(None, None, [], True)], "incomplete_search"), ([(None, None, [], False), (None, None, [], False)], "first_page"), ([], "first_page"),
    ],
)
def test_listings_that_are_not_whole(spark, tmp_path, chain, code):
    path = pages(tmp_path / "pages", chain)
    assert code in {r.code for r in paged.chain_issues(spark, path).collect()}
    with pytest.raises(ValueError, match=code):
        paged.listing(spark, path)


def test_too_many_pages(spark, tmp_path):
    path = pages(tmp_path / "pages", [(None, "1", [], False), ("1", "2", [], False), ("2", None, [], False)])
    with pytest.raises(PySparkException, match="more than 2 pages"):
        paged.listing(spark, path, most=2)


def test_publish(spark, tmp_path):
    files = spark.createDataFrame([("a/x.md", "1"), ("b.md", "2é"), ("c", None)], "path string, content string").repartition(3)
    target = str(tmp_path / "out")
    assert publish.publish({"docs": files}, target, dry_run=True) is False and not (tmp_path / "out").exists()
    assert publish.publish({"docs": files}, target) is True
    assert {r.path: r.content for r in publish.published(spark, target).where("path <> 'docs/c'").collect()} == {"docs/a/x.md": "1", "docs/b.md": "2é"}
    before = (tmp_path / "out").stat().st_ino
    assert publish.publish({"docs": files.coalesce(1).orderBy(F.desc("path"))}, target) is False  # equal content commits nothing
    assert (tmp_path / "out").stat().st_ino == before
    fails = files.select("path", F.when(F.col("path") == "b.md", F.raise_error(F.lit("no"))).otherwise(F.col("content")).alias("content"))
    with pytest.raises(PySparkException):
        publish.publish({"docs": fails}, target)
    for bad in ("../up", "/abs", "a//b", "x\\y", ""):
        with pytest.raises(PySparkException):
            publish.publish({"docs": spark.createDataFrame([(bad, "x")], files.schema)}, target)

    def refuse(outputs):
        raise ValueError("refused")

    with pytest.raises(ValueError, match="refused"):
        publish.publish({"docs": files.limit(1)}, target, refuse)
    with pytest.raises(ValueError, match="several files"):
        publish.publish({"docs": files.unionByName(files)}, target)
    assert (tmp_path / "out/docs/b.md").read_text() == "2é"  # all failures left it as it was
    assert publish.publish({"docs": files.where("path <> 'c'"), "more": files.where("path = 'b.md'")}, target) is True
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"] and (tmp_path / "out/more/b.md").exists() and not (tmp_path / "out/docs/c").exists()


def test_manifests(spark):
    documents = {"d1": {"title": "T", "slug": "s", "parentId": "f1", "contentHash": "h"}}
    folders = {"f1": {"name": "F", "slug": "f"}}
    rows = [
        ("v1", {"schemaVersion": 1, "driveId": "d", "rootFolderId": "r", "documents": documents, "folders": folders, "redirects": {"x": {"targetDocumentId": "d1"}}}), ("v2", {"schemaVersion": 2, "driveId": "d", "rootFolderId": "r", "documents": {}, "folders": folders, "redirects": {"x": {"targetDocumentId": "d1"}}}),
        ("v3", {"schemaVersion": 3, "driveId": "e", "rootFolderId": "r", "documents": documents, "folders": folders, "redirects": {}}), ("v9", {"schemaVersion": 9, "documents": documents}), ("empty", {"schemaVersion": 3, "driveId": "d", "rootFolderId": "r"}),
    ]
    raw = spark.createDataFrame([*((k, json.dumps(v)) for k, v in rows), ("broken", "{"), ("null", None)], "owner string, json string")
    got = sorted((r.owner, r.section, r.id, r.name, r.slug, r.target, r.version) for r in landed.manifest_documents(raw).collect())
    assert got == [("v1", "documents", "d1", "T", "s", None, 1), ("v1", "folders", "f1", "F", None, None, 1), ("v2", "folders", "f1", "F", None, None, 2), ("v2", "redirects", "x", None, None, "d1", 2), ("v3", "documents", "d1", "T", "s", None, 3), ("v3", "folders", "f1", "F", "f", None, 3)]
    assert sorted((r.owner, r.code) for r in landed.manifest_issues(raw, "d", "r").collect()) == [("broken", "not_json"), ("null", "not_json"), ("v3", "other_scope"), ("v9", "unknown_version")]


def test_an_oversized_export_is_an_issue(spark, tmp_path):
    for name, data in {"a.md": b"text", "big.md": b"x" * 200}.items():
        (tmp_path / name).write_bytes(data)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")
    try:
        got = {r.id: (r.content, r.issue) for r in landed.exports(spark, str(tmp_path), most=100).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == {"a": (bytearray(b"text"), None), "big": (None, "too_large")}


def test_ten_thousand_path_rules(spark):
    rules = spark.range(10_000).select(F.concat(F.lit("a/"), "id").alias("place"), (F.col("id") % 2 == 0).alias("whole"))
    paths = spark.createDataFrame([("a/1/x/y",), ("a/2/x",), ("a/2",), ("a/3",), ("b/1",), ("../a/1",), ("a/./1//z",), ("a",), ("",)], "path string")
    found = checks.allowed_paths(paths, rules)
    assert {r.path: r.allowed for r in found.collect()} == {"a/1/x/y": True, "a/2/x": False, "a/2": True, "a/3": True, "b/1": False, "../a/1": False, "a/./1//z": True, "a": False, "": False}
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_header_rules(spark):
    content = "  orphan: x\n/docs/* # c\r\n  Cache-Control: private, x\r\n\r\n\tX-Robots-Tag: noindex # y\n/a\n/docs/*\n# note\n  ETag: q\n"
    files = spark.createDataFrame([("f", content)], "file string, content string")
    assert sorted((r.pattern, r.header) for r in checks.header_rules(files).collect()) == [("/a", None), ("/docs/*", "etag: q")]
    surfaces = spark.createDataFrame([("f", "/docs/*", False), ("f", "/a", True), ("f", "/none", False), ("g", "/docs/*", True)], "file string, pattern string, public boolean")
    assert sorted((r.key, r.detail) for r in checks.headers(files, surfaces).collect()) == [("f /docs/*", "lacks cache-control: private"), ("f /docs/*", "lacks x-robots-tag"), ("f /none", "no_rule")]


def test_a_listing_of_any_length_fits_its_pages():
    assert [publication._page_count(n) for n in (0, 49, 3_631, 2_160_000, 100_000_000)] == [1, 1, 72, paged.MOST_PAGES, paged.MOST_PAGES]


def test_published_files_are_listed_and_read_by_tasks(spark, tmp_path):
    files = spark.createDataFrame([("a/b/x.md", "1é"), ("_y", ""), ("a/z.digest", "2")], "path string, content string")
    target = str(tmp_path / "out")
    publish.publish({"docs": files}, target)
    made = publish.published(spark, target)
    assert "FileScan text" not in made._jdf.queryExecution().executedPlan().toString()
    assert {r.path: r.content for r in made.collect()} == {"docs/a/b/x.md": "1é", "docs/_y": "", "docs/a/z.digest": "2"}


def test_a_task_that_lags_behind_an_abort_leaves_nothing(tmp_path):
    writer = publish._Writer({"path": str(tmp_path / "out")})
    writer.abort([])
    with pytest.raises(OSError):
        writer.write(iter([pa.RecordBatch.from_pydict({"path": ["a/b"], "content": ["x"]})]))
    assert list(tmp_path.iterdir()) == []
