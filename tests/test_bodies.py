import io
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import bodies, markdown, ordering, runs
from ledgerleaf.sources import landed
from ledgerleaf.streaming import reconcile_stream


def one(spark, value, *columns, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(*columns).first()


def test_front_matter(spark):
    made = bodies.document(F.lit("t"), F.lit("a"), F.lit("h"), F.lit("body"))
    content = one(spark, "", made)[0]
    files = {content: None, "x" + content: "not_opened", "---\ntitle: 1\n": "not_closed", content.replace("\n\n<!--", "\n\nx\n<!--"): "no_marker", "": "not_opened"}
    assert [one(spark, f, markdown.front_matter_issue(F.col("v")))[0] for f in files] == list(files.values())
    assert one(spark, content, markdown.front_matter_value(F.col("v"), "slug"), markdown.front_matter_value(F.col("v"), "none")) == ("a", None)


def test_landed_files(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    for name, data in {"in/a b.md": b"text", "in/big.md": b"x" * 200, "in/bad.md": b"\xff\xfe", "in/other.zip": b"zip", "in/deep/c.png": b"png"}.items():
        (tmp_path / name).write_bytes(data)
    exported = landed.exports(spark, f"{tmp_path}/in/*", ".md", most=100)
    got = {r.id: (r.text, r.issue) for r in landed.decoded(exported).collect()}
    assert got == {"a%20b" if "a%20b" in got else "a b": ("text", None), "big": (None, "too_large"), "bad": (None, "not_utf8")}
    assert [(r.path, r.owner) for r in landed.assets(spark, f"{tmp_path}/in").where("path like '%png'").collect()] == [("deep/c.png", "deep")]
    texts = {r.path: r.content for r in landed.generated(spark, f"{tmp_path}/in").where("path like '%.md'").collect()}
    assert texts["big.md"] == "x" * 200
    assert landed.manifest(spark, f"{tmp_path}/none").count() == 0
    records = spark.createDataFrame([(1, "d", "r", "a"), (1, "e", "r", "b")], "version int, driveId string, rootFolderId string, id string")
    records.write.json(f"{tmp_path}/manifest")
    rows = landed.manifest(spark, f"{tmp_path}/manifest")
    assert [(r.id, r.kind, r.path, r.version) for r in rows.orderBy("id").collect()] == [("a", "document", "docs/a.md", 3), ("b", "document", "docs/b.md", 3)]
    assert [r.item_id for r in landed.manifest_scope_issues(rows, "d", "r").collect()] == ["b"]


def test_runs(spark):
    manifest = spark.createDataFrame([("a",)], "id string")
    assert runs.version_changed({"converter": "1"}, {"converter": "1"}, manifest) is False
    assert runs.version_changed({"converter": "1"}, {"converter": "2"}, manifest) is True
    assert runs.version_changed({}, {"converter": "2"}, manifest.limit(0), "a") is True
    with pytest.raises(ValueError, match="full run"):
        runs.version_changed({}, {"converter": "2"}, manifest, "a")
    with pytest.raises(ValueError, match="without records: b"):
        ordering.require_records(spark.createDataFrame([("a",), ("b",)], "id string"), manifest)


def test_document_round_trip(spark):
    made = bodies.document(F.lit('A "title"'), F.lit("a/b"), F.lit("sha256:0"), F.col("v"))
    content, body = one(spark, "text\n\nmore", made, bodies.document_body(made))
    assert content.startswith('---\ntitle: "A \\"title\\""\nslug: "a/b"\n') and body == "text\n\nmore"
    assert one(spark, "no marker", bodies.document_body(F.col("v")))[0] is None


@pytest.mark.parametrize(("names", "issue"), [(["b.html", "a.png"], None), (["../x"], "unsafe_path"), (["A", "a"], "duplicate_path")])
def test_archives(spark, names, issue):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for n in names:
            z.writestr(n, "content")
    got = one(spark, data.getvalue(), bodies.archive_entries(F.col("v")).alias("x"), kind="binary").x
    assert got.issue == issue and (issue or [e.path for e in got.entries] == sorted(names))


def test_bad_archives_and_drawings(spark):
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("zeros", b"\0" * 1_000_000)
    assert one(spark, bomb.getvalue(), bodies.archive_entries(F.col("v")).alias("x"), kind="binary").x.issue == "too_large"
    assert one(spark, b"junk", bodies.archive_entries(F.col("v")).alias("x"), kind="binary").x.issue.startswith("unreadable")
    good = io.BytesIO()
    with zipfile.ZipFile(good, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "tide and time " * 30)
    data = good.getvalue()
    damaged = [data[:i] + bytes([data[i] ^ 0xFF]) + data[i + 1 :] for i in range(len(data))]
    got = spark.createDataFrame([(d,) for d in damaged], "v binary").select(bodies.archive_entries(F.col("v")).issue.alias("issue")).collect()
    assert len(got) == len(damaged) and sum(r.issue is not None for r in got) > len(data) // 3
    drawings = ["<svg><path d='M0'/></svg>", "<svg><script/></svg>", "<svg><use href='https://e.org'/></svg>", "<!DOCTYPE svg><svg/>", "<svg onload='x'/>", "<svg>", "<p/>"]
    assert [one(spark, d, bodies.drawing_issue(F.col("v")))[0] for d in drawings] == [None, "element", "reference", "doctype", "attribute", "unreadable", "not_svg"]


def test_stream_of_changes(spark, tmp_path):
    fold = reconcile_stream.apply_to(str(tmp_path), ["name"])
    schema = "id string, name string, deleted boolean, changed_at int, change_id int"
    fold(spark.createDataFrame([("a", "A", False, 1, 1), ("a", "A2", False, 2, 2), ("b", "B", False, 1, 3)], schema), 0)
    for _ in range(2):
        fold(spark.createDataFrame([("b", None, True, 3, 4), ("c", "C", False, 3, 5)], schema), 1)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/1").collect())) == [("a", "A2"), ("c", "C")]
