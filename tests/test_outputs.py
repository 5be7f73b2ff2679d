"""What a run writes, in which order, and what is read back."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerleaf.functions import labels, outputs, urls
from ledgerleaf.operators import bodies, corpus, hierarchy, links, markdown, ordering, runs
from ledgerleaf.sources import rendered


def test_orders(spark):
    found = spark.createDataFrame([("b", "y"), ("a", "z"), ("b", "x")], "source string, target string")
    assert [tuple(r) for r in links.broken_in_order(found).collect()] == [("a", "z"), ("b", "x"), ("b", "y")]
    index = spark.createDataFrame([("2", "b"), ("1", "b"), ("9", "B"), ("3", "a")], "id string, slug string")
    assert [r.id for r in corpus.index_in_order(index).collect()] == ["9", "3", "1", "2"]
    grouped = spark.createDataFrame([("zeta", None), ("Éa", "2024-01-01"), ("eb", "2024-01-01"), ("Alpha", None), ("new", "2024-02-01")], "folder string, newest string")
    assert [r.folder for r in corpus.groups_in_order(grouped).collect()] == ["new", "Éa", "eb", "Alpha", "zeta"]


def test_labels_are_composed(spark):
    row = spark.createDataFrame([("3 – Café  ",)], "n string").select(labels.order_number(F.col("n")), labels.shown(F.col("n")), urls.asset_path(F.lit("img/cafe%CC%81.png"), F.lit("docs"))).first()
    assert tuple(row) == (3, "Café", "docs/img/café.png")


@pytest.mark.parametrize(
    ("head", "want"),
    {
        'folderPath:\n  - "A"\n  - "b \\"c\\": d"\nx: y\n': ["A", 'b "c": d'], "folderPath: []\n": [], "folderPath: [\"a\", 'it''s', plain]\n": ["a", "it's", "plain"], "folderPath:\n- one\n- 'two'\n": ["one", "two"], "folderPath: text\n": None,
        "folderPath:\n  - a: b\n": None, "folderPath: [a\n": None, "folderPath: [true]\n": None, "folderPath:\n  - ok\n  - [x]\n": None, "title: x\n": None,
    }.items(),
)
def test_folder_path(spark, head, want):
    content = spark.createDataFrame([(f"---\n{head}---\nbody\nfolderPath: [no]\n",)], "c string")
    assert content.select(markdown.folder_path(F.col("c"))).first()[0] == want


def test_files_without_head(spark):
    content = spark.createDataFrame([("folderPath: [a]\n",), ("---\nfolderPath: [a]\n",), (None,)], "c string")
    assert [r[0] for r in content.select(markdown.folder_path(F.col("c"))).collect()] == [None] * 3


def test_generated_and_published(spark):
    record = {"title": F.lit('A "b"'), "description": F.lit(""), "slug": F.lit("s"), "id": F.lit("i d"), "modified": F.lit("m"), "synced": F.lit("y"), "contentHash": F.lit("h"), "folderPath": F.array(F.lit("X"), F.lit("y/z"))}
    content = spark.range(1).select(bodies.generated_document(record, F.lit("text\n\n")).alias("c"))
    made = content.first().c
    assert made == f'---\ntitle: "A \\"b\\""\nslug: "s"\neditUrl: "https://docs.google.com/document/d/i%20d/edit"\nsourceType: "google-doc"\ngoogleFileId: "i d"\ngoogleModifiedTime: "m"\nsyncedAt: "y"\ncontentHash: "h"\nfolderPath:\n  - "X"\n  - "y/z"\npagefind: true\n---\n{bodies.MARKER}\n\ntext\n'
    assert content.select(markdown.folder_path(F.col("c")), bodies.document_body(F.col("c"))).first()[:] == (["X", "y/z"], "text")
    columns = "id int, title string, slug string, source_url string, modified_at string, synced_at string, content_hash string, body string"
    rows = [(1, "T *x*", "a/b", "u", "m", "s", "h", f"{bodies.MARKER}\n\n[x](/known/?q#f) [y](/other/) `[z](/known)`\n\n[r]: /known\n"), (2, "E", "e", "u", "m", "s", "h", bodies.MARKER)]
    files = {r.path: r.content for r in markdown.published_files(spark.createDataFrame(rows, columns), spark.createDataFrame([("known",)], "slug string")).collect()}
    head = '---\ntitle: "{}"\nsource_url: "u"\nmodified_at: "m"\nsynced_at: "s"\ncontent_hash: "h"\n---\n\n# {}\n'
    assert files == {"a/b/index.md": head.format("T *x*", "T \\*x\\*") + "\n[x](/known/index.md?q#f) [y](/other/) `[z](/known)`\n\n[r]: /known/index.md\n", "e/index.md": head.format("E", "E")}
    with pytest.raises(PySparkException, match="no marker in document 3"):
        markdown.published_files(spark.createDataFrame([(3, "", "", "", "", "", "", "text")], columns), spark.createDataFrame([], "slug string")).collect()
    assert spark.range(1).select(outputs.markdown_path(F.lit("x")), outputs.assets_folder(F.lit("x"))).first()[:] == ("docs/x.md", "assets/generated/x")


def test_relinked_bodies(spark):
    body = "[a](https://docs.google.com/document/d/one/edit#part) ![i](https://docs.google.com/document/d/one/edit) [b](https://www.google.com/url?q=https%3A%2F%2Fe.org%2Fx) [c](/y)\n\n```\n[a](https://docs.google.com/document/d/one/edit)\n```"
    docs = spark.createDataFrame([(7, body)], "id int, body string")
    made = markdown.with_document_links(docs, spark.createDataFrame([("one", "first/page")], "id string, slug string")).first().body
    assert made == body.replace("[a](https://docs.google.com/document/d/one/edit#part)", "[a](/first/page/#part)").replace("[b](https://www.google.com/url?q=https%3A%2F%2Fe.org%2Fx)", "[b](https://e.org/x)")


def test_navigation_of_runs(spark):
    rebuilt, before = spark.createDataFrame([("a",), ("new",)], "id string"), spark.createDataFrame([("a",)], "id string")
    assert runs.navigation_after("new", rebuilt, before).count() == 1 and runs.navigation_after(None, rebuilt, before).count() == 2
    nodes = spark.createDataFrame([("a", "p"), ("b", "p")], "id string, parent string")
    with pytest.raises(ValueError, match="without records: b"):
        ordering.require_records(nodes, before)
    placed = spark.createDataFrame([("p", "f", "folder", "root"), ("b", "2", "document", "p"), ("a", "1", "document", "p"), ("c", "0", "document", "p"), ("u", "9", "unsupported", "p")], "id string, name string, kind string, parent string")
    ordered = hierarchy.children_in_order(placed)
    assert sorted((r.parent, r.kind, r.position, r.id) for r in ordered.collect()) == [("p", "document", 1, "c"), ("p", "document", 2, "a"), ("p", "document", 3, "b"), ("root", "folder", 1, "p")]
    kept = runs.managed_children(ordered, spark.createDataFrame([("b",), ("a",)], "id string"))
    assert sorted((r.kind, r.position, r.id) for r in kept.collect()) == [("document", 1, "a"), ("document", 2, "b"), ("folder", 1, "p")]


def test_rendered_documents(spark):
    rows = spark.createDataFrame([("b", 'q"', "s"), ("a", None, "s"), ("z", "1", "t")], "id string, name string, section string")
    lines = {(r.section, r.key): r.text for r in rendered.document_lines(rows).collect()}
    assert lines == {("s", "a"): '    "a": {\n\n    },', ("s", "b"): '    "b": {\n      "name": "q\\""\n    }', ("t", "z"): '    "z": {\n      "name": "1"\n    }'}
    groups = spark.createDataFrame([(2, "B", []), (1, "A", [("x", "/x/")])], "sibling_rank int, label string, items array<struct<label: string, link: string>>")
    assert rendered.sidebar_file(groups, "p", "H").first().content == '// H\nexport const generatedSidebar = [\n  {\n    "label": "A",\n    "items": [\n      { "label": "x", "link": "/x/" }\n    ]\n  },\n  {\n    "label": "B",\n    "items": []\n  }\n];\n'
