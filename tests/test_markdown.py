"""The reader of Markdown, and what is asked of bodies: policy, links, plain text, canonical form, splicing."""

import time

import pytest
from pyspark.sql import functions as F

from ledgerleaf.functions import marks
from ledgerleaf.operators import markdown


def frame(spark, bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "id int, body string")


def kinds(body):
    return [(b.kind, b.text) for b in marks.blocks(body)]


@pytest.mark.parametrize(
    ("body", "want"),
    {
        "# a #\n## b\n#c": [("heading", "a"), ("heading", "b"), ("paragraph", "#c")],
        "a\nb\n---\nc\n***": [("heading", "a\nb"), ("paragraph", "c"), ("rule", "")],
        "````\n```\n# no\n````\ntext": [("code", "```\n# no"), ("paragraph", "text")],
        "~~~ py\n```\n~~~\n```a`b": [("code", "```"), ("paragraph", "```a`b")],
        "    # code\n\n    more\n\nx": [("code", "# code\n\nmore"), ("paragraph", "x")],
        "> a\nlazy\n> - b\n\nc": [("paragraph", "a\nlazy"), ("paragraph", "b"), ("paragraph", "c")],
        "- a\n\n  b\n- c\n1. d": [("paragraph", "a"), ("paragraph", "b"), ("paragraph", "c"), ("paragraph", "d")],
        "text\n2. no list\n* list": [("paragraph", "text\n2. no list"), ("paragraph", "list")],
        "a | b\n--|:-:\n1 | 2\n\n| x\n| -\n| y": [("table", "a | b\n--|:-:\n1 | 2"), ("table", "| x\n| -\n| y")],
        "a | b\n---|---|---\n": [("paragraph", "a | b\n---|---|---")],
        "<div>\n*a*\n\n*b*\n<b>\nc": [("html", "<div>\n*a*"), ("paragraph", "*b*\n<b>\nc")],
        "<!-- a\n\nb -->\nc": [("html", "<!-- a\n\nb -->"), ("paragraph", "c")],
        "[a]: /x 'T'\n[b]:\n/y\n\n[c] d": [("definition", "/x"), ("definition", "/y"), ("paragraph", "[c] d")],
        "": [],
        "\n \n\t\n": [],
    }.items(),
)
def test_blocks(body, want):
    assert kinds(body) == want


@pytest.mark.parametrize(
    ("source", "found"),
    {
        "[x](javascript:alert(1))": [("link", "javascript:alert(1)")],
        "[a](/A_(b) 'T') [c](</d e>) [f]()": [("link", "/A_(b)"), ("link", "/d e"), ("link", "")],
        "[[a]](/x) [b [c](/d) e](/f)": [("link", "/x"), ("link", "/d")],
        "![a [b](/c)](/d)": [("link", "/c"), ("image", "/d")],
        "`[no](x)` \\[no](x) [no] (x)": [("code", "[no](x)")],
        "<https://e.org/a b> <javascript:x> <me@e.org> <b c='d>'>": [("autolink", "https://e.org/a"), ("autolink", "javascript:x"), ("autolink", "mailto:me@e.org"), ("html", "<b c='d>'>")],
        "see https://e.org/a_(b). www.e.org, x": [("autolink", "https://e.org/a_(b)"), ("autolink", "http://www.e.org")],
        "[R][] [r] [t][R] [u] ![i][r]": [("reference", "r"), ("reference", "r"), ("reference", "r"), ("image_reference", "r")],
        "``a`b`` `c": [("code", "a`b")],
    }.items(),
)
def test_marks(source, found):
    spans, _, _ = marks.inlines(source, {"r"})
    assert [(s[0], s[6] or s[5]) for s in sorted(spans, key=lambda s: (s[2], s[1]))] == found


@pytest.mark.parametrize(
    ("source", "plain", "canonical"),
    [
        ("_a_ __b__ ***c*** ~~d~~", "a b c d", "*a* **b** ***c*** ~~d~~"), ("snake_case_word 2 * 3 * 4", "snake_case_word 2 * 3 * 4", "snake_case_word 2 * 3 * 4"), ("my_long_name(2*3)", "my_long_name(2*3)", "my_long_name(2*3)"),
        ("_a __b__ c_ *d", "a b c *d", "*a **b** c* *d"), ("**a*", "*a", "**a*"), ("a\\*b &amp; \\_", "a*b & _", "a\\*b &amp; \\_"), ("a  \nb\\\nc\nd", "a b c\nd", "a\\\nb\\\nc\nd"), ("`*a*` <b>c</b>", "*a* c", "`*a*` <b>c</b>"), ("[_a_](/b_c_)", "a", "[*a*](/b_c_)"),
    ],
)
def test_emphasis(source, plain, canonical):
    assert marks.inlines(source, set())[1:] == (plain, canonical)


def test_policy(spark):
    asset = "../../../assets/generated/d1/image-001.png"
    cases = {
        "[x](javascript:alert(1))": {"unsafe_url"}, "[ok]\n\n[ok]: javascript:x": {"unsafe_url"}, "text\n\n[unused]: data:x": {"unsafe_url"}, "<javascript:alert(1)>": {"unsafe_url"}, "[[a]](javascript:x)": {"unsafe_url"}, "[a](JaVaScRiPt&#58;x)": {"unsafe_url"},
        "[a](<java script:x>)": {"unsafe_url"}, "[a](/A_(b)) [b](#c) <https://e.org>": set(), "`[x](javascript:y)`\n\n    <b>\n\n```\n<b>\n```": set(), "a <b>c</b>": {"unsupported_html"}, "<div>\n": {"unsupported_html"}, "![a](x.png)": {"unsupported_image"},
        f"![a]({asset})": {"unsupported_image"}, "![a][r]\n\n[r]: /x": {"unsupported_image"}, "> - [a](vbscript:x)": {"unsafe_url"}, "| a |\n| - |\n| [a](javascript:x) |": {"unsafe_url"}, "[a](//e.org)": {"unsafe_url"}, "[a](bare)": {"unsafe_url"},
    }
    docs = frame(spark, cases)
    got = {i: set() for i in range(len(cases))}
    for r in markdown.policy_issues(docs).collect():
        got[r.id].add(r.code)
    assert list(got.values()) == list(cases.values())
    allowed = markdown.policy_issues(frame(spark, [f"<b> ![a]({asset}) ![b](other.png)", "![c][r]\n\n[r]: /x"]), allow_html=True, allow_images=True)
    assert sorted((r.id, r.code) for r in allowed.collect()) == [(0, "unsafe_url"), (1, "unsupported_image")]


def test_links(spark):
    docs = frame(spark, ["[A  b][] ![x](y) [c][A B] [z]\n\n[a B]: /first\n[A b]: /second\n\n<p><a href='/h'>t</a><img src=i.png></p>", None, "`[a](b)`"])
    got = sorted((r.id, r.kind, r.href) for r in markdown.links(docs).collect())
    assert got == [(0, "html_image", "i.png"), (0, "html_link", "/h"), (0, "image", "y"), (0, "reference", "/first"), (0, "reference", "/first")]


def test_headings_and_descriptions(spark):
    rows = [("---\n\n# 01 - My  Title\n\ntext\n\n```\n# comment\n```\n\n# More\n\nSet\n===", "my title"), ("> # quoted\n\nx", "quoted"), ("text\n\n# T", "T"), ("# Ｔitle", "Title")]
    docs = spark.createDataFrame([(i, b, t) for i, (b, t) in enumerate(rows)], "id int, body string, title string")
    got = {r.id: r.body for r in markdown.normalized_headings(docs).collect()}
    assert got == {0: "---\n\n\n\ntext\n\n```\n# comment\n```\n\n## More\n\n## Set", 1: "> ## quoted\n\nx", 2: "text\n\n## T", 3: ""}
    docs = frame(spark, ["# h\n\n- item\n\n> quote\n\n<b></b>\n\n*First* [para](/x) `code`\n\nlater", "- only", None, "a " * 150])
    assert [r.description for r in markdown.descriptions(docs).orderBy("id").collect()] == ["First para code", None, None, ("a " * 100).strip() + "…"]


def test_canonical(spark):
    bodies = {
        "* a\n* b\n\n  c\n    1) d\n    2) e\n+ f": "- a\n\n- b\n\n  c\n  1. d\n  2. e\n\n- f",
        "Set\nup\n===\n_x_ __y__  \nz": "# Set up\n\n*x* **y**\\\nz", "    code\n      more": "```\ncode\n  more\n```", "~~~ py\n```\n\n~~~": "````py\n```\n\n````", "> a\n> * b\n>   > c": "> a\n>\n> - b\n>\n>   > c", "***\n| a |\n|-|\n| b |": "---\n\n| a |\n|-|\n| b |", "": "",
    }
    once = markdown.canonical(frame(spark, bodies))
    got = [r.body for r in once.orderBy("id").collect()]
    assert [r.body for r in markdown.canonical(once).orderBy("id").collect()] == got
    assert got[1:] == list(bodies.values())[1:]
    assert got[0].startswith("- a\n") and "1. d\n" in got[0]


def test_restored_code():
    cases = {
        "\\`\\`\\`py x\n\\*a\\* \\`\\`\\`\n\\`\\`\\`\nb \\`c\\` \\` \\`": "````\n*a* ```\n````\nb `c` \\` \\`", "\\`\\`\\`\n\\*never closed \\`x\\`": "\\`\\`\\`\n\\*never closed `x`", "~~~ c++\n\\~\\~\\~ no\n~~~": "~~~~c++\n~~~ no\n~~~~".replace("~~~~c++", "~~~~c++"), "plain\n": "plain\n", "": "",
    }
    assert {k: marks.restored(k) for k in cases} == cases


def test_splice(spark):
    docs = frame(spark, ["añb😀c", "x", None])
    edits = spark.createDataFrame([(0, 1, 2, "N"), (0, 3, 4, ""), (0, 5, 5, "!"), (0, 1, 3, "lost"), (2, 0, 1, "y")], "id int, start int, end int, new string")
    assert [r.body for r in markdown.splice(docs, edits).orderBy("id").collect()] == ["aNbc!", "x", None]
    tables = frame(spark, ["| a |\n| - |\n\n```\n| a |\n| - |\n```\n\n<table><tr><td><table></table></table>x\n\n<table>"])
    assert markdown.wrapped_tables(tables).first().body == '<div class="table">\n\n| a |\n| - |\n\n</div>\n\n```\n| a |\n| - |\n```\n\n<div class="table"><table><tr><td><table></table></table></div>x\n\n<table>'
    diagrams = frame(spark, ["> ```mermaid\n> a-->b\n> ```\n\n```py\nx\n```"])
    assert 'data-diagram="a--&gt;b"' in markdown.with_diagrams(diagrams).first().body


def test_linear_time():
    """Long bodies, and those made to be slow."""
    n = 100_000
    prose = "".join(f"line {i} *a* [b](/c{i}) `d`\n" + ("\n```\ncode\n```\n\n" if i % 10 == 0 else "") for i in range(n))
    for body, most in ((prose, 60), ("[" * n, 20), ("*a " * n, 20), ("[a](" * n, 40), ("![a](b" * n, 40), ("`" * n + "a", 20), ("- a\n" * n, 40), ("a](\"b " * n, 40), ("_a*b" * n, 40)):
        began = time.perf_counter()
        for b in marks.blocks(body):
            marks.inlines(b.text, set())
        assert time.perf_counter() - began < most, body[:20]
    began = time.perf_counter()
    marks.restored("\\`\\`\\`\n\\*a\\*\n\\`\\`\\`\n" * n)
    assert time.perf_counter() - began < 10


def test_code_blocks(spark):
    docs = frame(spark, ["```py\na\n```\n~~~ two words\n```\n~~~\n```\nopen", "none"])
    assert sorted(tuple(r) for r in markdown.code_blocks(docs).collect()) == [(0, 1, "py", "a", 3), (0, 2, None, "```", 4)]
    assert [tuple(r) for r in markdown.fence_states(docs).orderBy("id").collect()] == [(0, True, ""), (1, False, "none")]
    assert markdown.blocks(docs).where(F.col("end") < F.col("start")).count() == 0


def test_marks_are_read_in_one_pass(spark):
    docs = spark.createDataFrame([(1, "[a](javascript:x) ![b](c)\n\n<p>d</p>\n\n| a | b |\n|---|---|")], "id int, body string")
    for made in (markdown.policy_issues(docs), markdown.links(docs), markdown.fallback_reasons(docs), markdown.wrapped_tables(docs)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") <= 1
    assert sorted(r.code for r in markdown.policy_issues(docs).collect()) == ["unsafe_url", "unsupported_html", "unsupported_image"]
    assert [r.reasons for r in markdown.fallback_reasons(docs).collect()] == ["fallback:html,fallback:image,fallback:table"]


def moved(df):
    """Whether rows of ``df`` are shuffled or joined."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Exchange" in plan or "Join" in plan


def test_headings_are_put_right_in_their_rows(spark):
    docs = spark.createDataFrame([(1, "---\n# A\n\n# b\nx", "01 - a"), (1, "# c\n\n## d", "A"), (2, "x\n\n# T", "T"), (None, "# ｔ", "t"), (3, None, "t"), (4, "> # t", "t")], "id int, body string, title string")
    made = markdown.normalized_headings(docs)
    assert not moved(made) and made.columns == docs.columns
    assert [r.body for r in made.collect()] == ["---\n\n\n## b\nx", "## c\n\n## d", "x\n\n## T", "", None, "> ## t"]


def test_diagrams_are_put_in_their_rows(spark):
    docs = spark.createDataFrame([(1, "a\n```mermaid\nx<y\n```"), (1, "```py\nx\n```\n~~~mermaid z\n~~~"), (2, None)], "id int, body string")
    made = markdown.with_diagrams(docs)
    assert not moved(made)
    shown = '<div class="diagram" data-diagram="{0}"><pre>{0}</pre></div>'
    assert [r.body for r in made.collect()] == ["a\n" + shown.format("x&lt;y"), "```py\nx\n```\n" + shown.format(""), None]


def test_fences_are_told_in_their_rows(spark):
    docs = spark.createDataFrame([(1, "a\n```\nb"), (1, "a\n```\nb\n```\nc"), (2, None)], "id int, body string")
    made = markdown.fence_states(docs)
    assert not moved(made)
    assert [tuple(r) for r in made.collect()] == [(1, True, "a"), (1, False, "a\nc"), (2, False, "")]
    assert markdown._read("a\n```\nb\n```", ("kind", "prose")) == [("paragraph", "a"), ("code", None)]  # no code goes back to the JVM


def test_only_what_is_asked_of_blocks_is_read(spark):
    docs = frame(spark, ["# a *b*\n\n```\nc\n```\n[r]\n\n[r]: /x", None])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "canonical" not in plan(markdown.plain_text(docs)) and "spans" not in plan(markdown.plain_text(docs))
    assert sorted(tuple(r)[1:] for r in markdown.plain_text(docs).collect()) == [(0, "heading", "a b"), (2, "paragraph", "r")]
    assert "canonical" not in plan(markdown.document_links(docs)) and "plain" not in plan(markdown.document_links(docs))
    assert [(r.id, r.href) for r in markdown.document_links(docs).collect()] == [(0, "/x")]
    assert markdown.blocks(docs, fields=("kind",)).collect()[0].asDict() == {"id": 0, "kind": "heading"}


def test_plain_words_are_read_without_rules(monkeypatch):
    tried = []

    class Counted:
        def __init__(self, pattern):
            self.pattern = pattern

        def __getattr__(self, name):
            tried.append(name)
            return getattr(self.pattern, name)

    for name in ("TOKEN", "HEADING", "DEFINITION"):
        monkeypatch.setattr(marks, name, Counted(getattr(marks, name)))
    assert [b.kind for b in marks.blocks("plain words\nand more\n\n[a](/x) of it\n\n" * 50)] == ["paragraph"] * 100
    assert marks.inlines("plain words " * 50, set()) == ([], "plain words " * 50, "plain words " * 50)
    assert not tried


def test_tokens_are_found_behind_plain_words():
    for text in ("a b  \n c", "a \t\nb", "a. b: c http://e.org", "a https://e.org", "a www.e.org", "xhttp://e.org a_b", "a.b &amp; c", "a\\\nb", "a  b ![c](d)", "`a`", "a"):
        at = 0
        while m := marks.TOKEN.search(text, at):
            assert marks._token(text, at).span() == m.span()
            at = m.end()
        assert marks._token(text, at) is None


def test_backticks_behind_an_escaped_one():
    assert marks.inlines("\\``` a", set())[1] == "``` a"
    assert marks.inlines("\\``` a `` b", set())[1] == "`a b"
