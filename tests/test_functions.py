from pyspark.sql import functions as F

from ledgerleaf.functions import labels, text, urls


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
    return [r[0] for r in rows.select(expression(F.col("v")).alias("x"), "i").orderBy("i").select("x").collect()]


def test_numbers_before_names(spark):
    """Every separator and bracket with one, two and three digits; four digits, words and other signs are no numbers."""
    for digits in ("4", "42", "420", "007"):
        names = [f"[{digits}]Harbour", f"[{digits}]  Harbour", *(f"{digits}{gap}{sign}{gap}Harbour" for sign in "-–—." for gap in ("", " "))]
        assert set(column(spark, names, labels.order_number)) == {int(digits)}
        assert set(column(spark, names, labels.label)) == {"Harbour"}
    others = ["1984 - Novel", "12: Monkeys", "7) Seas", "[12 Rows", "3rd - Floor", "½ - Way", "Harbour - 4"]
    assert column(spark, others, labels.order_number) == [None] * len(others)
    assert column(spark, others, labels.label) == others
    assert column(spark, ["  5 - ", "[9]", "\t"], labels.label) == ["Untitled"] * 3
    assert column(spark, ["8 Bridges", "66", "8 - Bridges", "1984 Novel", "8th Bridge"], labels.unrecognized_prefix) == [True, True, False, False, False]


def test_slugs(spark):
    names = ["3. Zürich & Genève", "ﬁne   print", "Ёлка №5", "?!", "[2] Ångström²", "plain ascii", "x̌y"]
    assert column(spark, names, labels.slug_segment) == ["zurich-geneve", "fine-print", "елка-no5", "untitled", "angstrom2", "plain-ascii", "xy"]
    assert column(spark, ["éclair", "plain"], labels.composed) == ["éclair", "plain"]


def test_natural_key(spark):
    names = ["Volume 2b", "volume 10", "VOLUME 2", "volume 002c"]
    keys = column(spark, names, labels.natural_key)
    assert sorted(range(4), key=keys.__getitem__) == [2, 0, 3, 1]


def test_description(spark):
    long, unbroken, short = column(spark, ["\n tide and  time " * 30, "z" * 230, " a\tb "], labels.description)
    assert len(long) <= 201 and long.endswith(("tide…", "and…", "time…")) and short == "a b"
    assert unbroken == "z" * 200 + "…"


def test_ages(spark):
    days = spark.createDataFrame([(d,) for d in (-3, 0, 1, 2, 28, 31, 100, 340, 365, 1100)], "d int").coalesce(1)
    assert [r[0] for r in days.select(labels.age_phrase(F.col("d"))).collect()] == ["just now", "today", "yesterday", "2 days ago", "28 days ago", "last month", "3 months ago", "11 months ago", "last year", "3 years ago"]


def test_link_policy(spark):
    verdicts = {"HTTPS://Port.example:8443/a?b=c#d": True, "mailto:crew@port.example": True, "quay/4": True, "?tide=high": True, "vbscript:go": False, "ftp://port.example": False, "file:///etc": False, "//port.example/a": False, "\\\\port\\a": False, "quay\u0007": False, "quay ": False, "": False}
    assert column(spark, verdicts, urls.allowed) == list(verdicts.values())


def test_markdown_policy(spark):
    verdicts = {"#dock": True, "/dock": True, "./dock": True, "../dock": True, "https://port.example": True, "dock/4": False, "//port.example": False, "java​script:go": False, " /dock ": True, "ＨＴＴＰ://port.example": True, "": False}
    assert column(spark, verdicts, urls.safe_in_markdown) == list(verdicts.values())


def test_unwrapping(spark):
    found = {
        "http://google.com/url?sa=D&url=http%3A%2F%2Fport.example%2F%3Fa%3D1": "http://port.example/?a=1",
        "https://www.google.com/url?q=mailto%3Acrew%40port.example#x": "mailto:crew@port.example",
        "https://www.google.com/maps?q=https://port.example": None,
        "https://www.google.com/url?q=data%3Atext": None,
        "https://www.google.com/url?q=quay": None,
        "https://port.example/url?q=https://port.example": None,
    }
    assert column(spark, found, urls.unwrapped) == list(found.values())


def test_routes(spark):
    found = [("port/quay", "", None), ("port/quay", "berth", "port/quay/berth"), ("port/quay", "../../fleet/?sort=up#top", "fleet"), ("port", "/fleet//a/./b/", "fleet/a/b"), ("port", "tel:5", None), ("port", "../../..", ""), ("port", "caf%C3%A9+x", "port/café+x")]
    rows = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(found)], "i int, source string, href string").coalesce(1)
    assert [r[0] for r in rows.orderBy("i").select(urls.route(F.col("href"), F.col("source"))).collect()] == [r[2] for r in found]


def test_text(spark):
    assert column(spark, ["﻿one\r\rtwo\r\n three﻿"], text.newlines) == ["one\n\ntwo\n\nthree﻿"]
    assert column(spark, ["*Fleet* #1 <new>_`x`\\"], text.escape_heading) == ["\\*Fleet\\* \\#1 \\<new\\>\\_\\`x\\`\\\\"]
    assert column(spark, ['"Fleet" & \'crew\' > 1'], text.escape_html) == ["&quot;Fleet&quot; &amp; &#39;crew&#39; &gt; 1"]
