"""HTML trees: implied ends, policy, tables, images and Markdown, page by page."""

import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import markup
from ledgerleaf.plans import pages as page_plans

PAGES = {
    "head": ("<!doctype html><html><head><title>T</title><style>p{}</style></head><body onload=x><!-- c --><h1 onclick='x'>A &amp; B</h1>", "<h1>A &amp; B</h1>", "# A & B"),
    "headless": ("<title>T</title><meta charset=utf-8>\n<p>text", "<p>text</p>", "text"),
    "removed": ("a<script>var t='</p><b>';</script><form>x<div>y</div></form><iframe><p>z</iframe><embed src=q>b<nav>c</nav>", "abc", "abc"),
    "links": ("<a href='javascript:x'>p</a> <a class=q href='/ok' title='t&quot;'>q</a> <a href=\"/A_(b)\">r</a> <a href='//evil'>s</a>", '<a>p</a> <a href="/ok" title="t&quot;">q</a> <a href="/A_(b)">r</a> <a>s</a>', 'p [q](/ok "t\\"") [r](</A_(b)>) s'),
    "implied": ("<p>one<div>two<p>three</div><ul><li>x<li>y</ul>z", "<p>one</p><div>two<p>three</p></div><ul><li>x</li><li>y</li></ul>z", "one\n\ntwo\n\nthree\n\n- x\n- y\n\nz"),
    "stray": ("</p></div>a</em><em>b", "a<em>b</em>", "a*b*"),
    "lists": ("<ol start=4><li>a<ul><li>b<li><p>c</p><pre>d\n  e</pre></ul><li>f</ol>", "<ol><li>a<ul><li>b</li><li><p>c</p><pre>d\n  e</pre></li></ul></li><li>f</li></ol>", "1. a\n   - b\n\n   - c\n\n     ```\n     d\n       e\n     ```\n\n2. f"),
    "quotes": ("<blockquote><p>a<br>b<ul><li>c</ul></blockquote>", "<blockquote><p>a<br>b</p><ul><li>c</li></ul></blockquote>", "> a\\\n> b\n>\n> - c"),
    "code": ("<pre><code>*x*\n``` y</code></pre><code>a`b</code> <code>*c*</code>", "<pre><code>*x*\n``` y</code></pre><code>a`b</code> <code>*c*</code>", "````\n*x*\n``` y\n````\n\n`` a`b `` `*c*`"),
    "escapes": ("<p># a<p>- b<p>1. c<p>d * e _ f [g] `h`<p>+<p>x &lt;b&gt;", "<p># a</p><p>- b</p><p>1. c</p><p>d * e _ f [g] `h`</p><p>+</p><p>x &lt;b&gt;</p>", "\\# a\n\n\\- b\n\n1\\. c\n\nd \\* e \\_ f \\[g\\] \\`h\\`\n\n\\+\n\nx \\<b>"),
    "image": ('<p><img src="a b.png" alt="x]y" width=3></p>', '<p><img alt="x]y" src="a b.png"></p>', "![x\\]y](<a b.png>)"),
    "table": ("<table><tr><th>a|b<th>c<tr><td>1 <em>x</em><td>\n2 </table>t", "<table><tr><th>a|b</th><th>c</th></tr><tr><td>1 <em>x</em></td><td>\n2 </td></tr></table>t", "| a\\|b | c |\n| --- | --- |\n| 1 x | 2 |\n\nt"),
    "spans": ('<table><tr><td colspan=2>a<td rowspan="1000">b</table>', '<table><tr><td colspan="2">a</td><td>b</td></tr></table>', '<table><tr><td colspan="2">a</td><td>b</td></tr></table>'),
    "nested": ("<table><tr><td><table><tr><td>x</table>y</table>z", "<table><tr><td><table><tr><td>x</td></tr></table>y</td></tr></table>z", "<table><tr><td><table><tr><td>x</td></tr></table>y</td></tr></table>\n\nz"),
    "cut": ("<p>text <em>more</p><a href='x", "<p>text <em>more</em></p>", "text *more*"),
    "quoted": ('<a title="a > b" href="/x">y</a>', '<a href="/x" title="a &gt; b">y</a>'.replace("&gt;", ">"), '[y](/x "a > b")'),
    "empty": ("", "", ""),
    "nothing": (None, "", ""),
}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(k, v[0]) for k, v in PAGES.items()], "id string, html string")


def test_sanitized(spark, pages):
    assert {r.id: r.html for r in markup.sanitized(pages).collect()} == {k: v[1] for k, v in PAGES.items()}
    again = spark.createDataFrame([(k, v[1]) for k, v in PAGES.items()], "id string, html string")
    assert {r.id: r.html for r in markup.sanitized(again).collect()} == {k: v[1] for k, v in PAGES.items()}


def test_markdown(pages):
    assert {r.id: r.markdown for r in markup.markdown_of_pages(pages).collect()} == {k: v[2] for k, v in PAGES.items()}


def test_warnings_and_tables(pages):
    found = markup.events(pages)
    codes = {}
    for r in markup.warnings(found).collect():
        codes.setdefault(r.id, set()).add(r.code.removeprefix("removed_"))
    assert codes == {"head": {"unsafe_html_attribute"}, "removed": {"unsupported_html"}, "links": {"unsafe_link", "unsafe_html_attribute"}, "lists": {"unsafe_html_attribute"}, "image": {"unsafe_html_attribute"}, "spans": {"invalid_table_span"}}
    assert {(r.id, r.complex) for r in markup.tables(markup.kept_events(found)).collect()} == {("table", False), ("spans", True), ("nested", True)}


def test_images(spark):
    pages = spark.createDataFrame([(1, '<img src="a.png"><p><img src="b.png" title="t"></p><img src="c.png" alt="x">')], "id int, html string")
    named = spark.createDataFrame([(1, 0, "image-001.png", "A", None), (1, 1, None, "B", "unsafe_path"), (1, 2, "image-002.png", "x", None)], "id int, position int, file string, alt string, issue string")
    kept = markup.with_images(markup.kept_events(markup.events(pages)), named)
    assert markup.to_markdown(kept).first().markdown == "![A](image-001.png)\n\n![x](image-002.png)"


def test_a_long_page_takes_linear_time(spark):
    page = "<ul>" + "<li><p>a <b>b</b>" * 30_000
    assert markup.events(spark.createDataFrame([(1, page)], "id int, html string")).where(F.col("kind") == "open").count() == 90_001


def test_archive_conversion(spark):
    from ledgerleaf.operators import conversion

    png = bytearray(b"\x89PNG\r\n\x1a\n1")
    html = "<h1>My title</h1><p>First *words*</p><img src='a.png'><img src=\"a.png\" alt=' '><img src='http://e.org/x.png'><table><tr><td>1<td>2<tr><td>3</table>"
    pages = spark.createDataFrame([(1, "", "01 - my Title", html), (2, "d", "t", "<img src=none.png>"), (3, "d", "t", "<img src=text.png>x"), (4, "", "t", None)], "id int, folder string, title string, html string")
    entries = spark.createDataFrame([(1, "a.png", png), (3, "d/text.png", bytearray(b"no"))], "id int, path string, bytes binary")
    got = {r.id: r for r in conversion.converted(pages, entries).collect()}
    asset = "../../../assets/generated/1/image-001.png"
    assert got[1].body == f"First \\*words\\*\n\n![Image from 01 - my Title]({asset})![Image from 01 - my Title]({asset})\n\n<table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>"
    assert (got[1].description, got[1].complex_tables, got[1].warnings, got[1].issue) == ("First *words*", True, ["removed_unsafe_image"], None)
    assert {i: (got[i].issue, got[i].body) for i in (2, 3, 4)} == {2: ("missing", ""), 3: ("not_an_image", "x"), 4: (None, "")}


def test_pages_are_read_once(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    docs = spark.createDataFrame([(1, "<p onclick='f()'>a<form><p id='x'>b</form><u>c</u>"), (2, "<p>a")], "id int, html string")
    found = markup.warnings(markup.events(docs))
    assert plan(found).count("MapInArrow") == 1
    assert sorted(tuple(r) for r in found.collect()) == [(1, "removed_unsafe_html_attribute"), (1, "removed_unsupported_html")]
    assert "MapInArrow" not in plan(page_plans.html_structures(spark, "/root/testdata/sf0.001"))
