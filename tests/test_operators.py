import random

import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import addressing, checks, corpus, hierarchy, links, ordering, reconcile

ITEMS = "id string, name string, kind string, parent string, modified string"
TREE = [
    ("root", "Harbour", "folder", None, None),
    ("tides", "2. Tides", "folder", "root", None),
    ("maps", "[1] Maps", "folder", "tides", None),
    ("low", "Low water", "document", "maps", None),
    ("read", "readme", "document", "maps", "2023-05-01"),
    ("nine", "9 – Nine", "document", "maps", None),
    ("sheet", "table", "unsupported", "maps", None),
    ("ten", "10 – Ten", "document", "tides", "2023-04-01"),
    ("note", "About", "document", "root", None),
    ("void", "Void", "folder", "root", None),
    ("adrift", "Adrift", "document", "beyond", None),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(TREE, ITEMS)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_paths_and_counts(spark, items):
    placed = hierarchy.paths(items)
    assert dict(rows(placed.select("id", F.array_join("path", "/"))))["nine"] == "Harbour/2. Tides/[1] Maps/9 – Nine"
    assert rows(hierarchy.selection_counts(items, placed, ["tides"]).select("all_item_count", "descendant_count", "outside_root_count", "ignored_count")) == [(11, 10, 1, 7)]
    assert {r[0] for r in rows(hierarchy.without_subtrees(placed, ["tides"]).select("id"))} == {"root", "note", "void"}


def test_any_order_of_rows_gives_one_result(spark, items):
    shuffled = TREE[:]
    random.Random(3).shuffle(shuffled)
    again = spark.createDataFrame(shuffled, ITEMS).repartition(3)
    one, two = (rows(ordering.siblings(hierarchy.paths(x)).select("id", "sibling_rank")) for x in (items, again))
    assert one == two


def test_cycles(spark):
    """Of each cycle the link that a walk from the smallest id into it comes to last."""
    parents = spark.createDataFrame([("root", None), ("m", "n"), ("n", "o"), ("o", "m"), ("below", "n"), ("x", "root"), ("self", "self"), ("lost", "gone"), ("p", "q"), ("q", "p")], "id string, parent string")
    assert rows(hierarchy.cycles(parents).select("item_id", "related_id")) == [("m", "n"), ("q", "p"), ("self", "self")]
    assert hierarchy.cycles(parents.where("id in ('root', 'x')")).count() == 0


def test_paths_of_any_depth_and_number(spark):
    deep = [("root", "r", "folder", None)] + [(f"d{i}", f"n{i}", "folder", f"d{i - 1}" if i else "root") for i in range(200)] + [("loop", "l", "folder", "loop"), ("tail", "t", "folder", "loop")]
    placed = hierarchy.paths(spark.createDataFrame(deep, "id string, name string, kind string, parent string"))
    last = placed.where("id = 'd199'").first()
    assert placed.count() == 201 and last.depth == 200 and last.path == ["r", *(f"n{i}" for i in range(200))]
    wide = spark.range(1_200_000).selectExpr("if(id = 0, 'root', cast(id as string)) as id", "'x' as name", "'document' as kind", "if(id = 0, null, if(id < 1000, 'root', cast(id % 999 + 1 as string))) as parent")
    assert hierarchy.paths(wide).where("ids[0] = 'root'").count() == 1_200_000


def test_paths_of_a_selection(spark, items):
    placed = hierarchy.paths_of_selection(items.where("id <> 'maps'"))
    got = {r.id: (r.depth, "/".join(r.path)) for r in placed.collect()}
    assert got["low"] == (0, "Low water") and got["ten"] == (2, "Harbour/2. Tides/10 – Ten") and got["adrift"] == (0, "Adrift")
    assert [r.id for r in hierarchy.in_order(placed).collect()][:2] == ["nine", "adrift"]


def test_sound_inventories(spark, items):
    assert hierarchy.root_issues(items).count() == 0
    assert rows(hierarchy.root_issues(items, "note")) == [("root_not_folder", "note")] and rows(hierarchy.root_issues(items, "zz")) == [("root_not_found", "zz")]
    hierarchy.require_sound(hierarchy.root_issues(items), hierarchy.duplicate_ids(items))
    with pytest.raises(ValueError, match="2 issues of the inventory: duplicate_id a; root_not_found zz"):
        hierarchy.require_sound(hierarchy.root_issues(items, "zz"), hierarchy.duplicate_ids(spark.createDataFrame([("a",), ("a",)], "id string")))


def test_sibling_order_and_reading_order(spark, items):
    placed = hierarchy.paths(items)
    ranked = ordering.siblings(placed)
    assert [r[0] for r in rows(ranked.where("parent = 'maps'").select("id", "sibling_rank"), "sibling_rank")] == ["read", "nine", "low"]
    assert {r[0] for r in rows(ordering.navigation(placed, ranked).select("id"))} == {"tides", "maps", "low", "read", "nine", "ten", "note"}
    order = ordering.reading_order(placed, ranked)
    assert [r[0] for r in rows(order, "place")] == ["note", "read", "nine", "low", "ten"]
    assert rows(ordering.neighbours(order))[0] == ("low", "nine", "ten")


def test_navigation_issues(spark):
    found = [("f", "F", "folder", "root", None), ("a", "1 - A", "document", "f", None), ("b", "1 - B", "document", "f", None), ("o", "Overview", "document", "f", None), ("r", "README", "document", "f", None), ("u", "07 Late", "document", "f", None)]
    placed = hierarchy.paths(spark.createDataFrame([TREE[0], *found], ITEMS))
    assert rows(ordering.issues(ordering.siblings(placed))) == [("duplicate_navigation_order", "b", "a"), ("multiple_landing_documents", "r", "o"), ("unrecognized_order_prefix", "u", None)]


def test_allocation(spark):
    new = spark.createDataFrame([("d1", "document", "team/guide"), ("d2", "document", "team/guide"), ("f1", "folder", "team/guide"), ("d3", "document", "free"), ("d4", "document", "used")], "id string, kind string, base string")
    slugs = dict(rows(addressing.allocate(new, spark.createDataFrame([("used",)], "slug string"))))
    assert slugs["f1"] == "team/guide" and slugs["d3"] == "free" and slugs["d4"].startswith("used--")
    assert slugs["d1"].startswith("team/guide--") and len(set(slugs.values())) == 5


def test_stable_addresses(spark):
    items = spark.createDataFrame([("a", "document", "quay"), ("b", "document", "quay"), ("c", "folder", "fleet"), ("d", "document", "about"), ("e", "document", "ferry")], "id string, kind string, base string")
    manifest = spark.createDataFrame([("b", "document", "quay"), ("gone", "document", "fleet"), ("c", "folder", None)], "id string, kind string, slug string")
    redirects = spark.createDataFrame([("ferry",)], "old_slug string")
    got = {r.id: (r.slug, r.kept) for r in addressing.stable(items, manifest, redirects, links.STATIC).collect()}
    assert got["b"] == ("quay", True) and all(got[i][0].startswith(f"{s}--") and not got[i][1] for i, s in (("a", "quay"), ("c", "fleet"), ("d", "about"), ("e", "ferry")))
    assert rows(addressing.manifest_issues(manifest, spark.createDataFrame([("quay",)], "old_slug string"))) == [("quay", 2)]


def test_reseeded_documents_never_clash(spark):
    documents = spark.createDataFrame([(f"i{i}", "old", "same") for i in range(300)] + [("z", "old", "free")], "id string, slug string, base string")
    import hashlib

    first = {hashlib.sha256(f"i{i}".encode()).hexdigest()[:6] for i in range(5)}
    taken = spark.createDataFrame([("same",), *((f"same--{h}",) for h in first)], "slug string")
    got = dict(rows(addressing.reseed(documents, taken).select("id", "new_slug")))
    assert len(set(got.values())) == 301 and got["z"] == "free" and len(got["i0"]) == len("same--") + 8 and len(got["i9"]) == len("same--") + 6


def test_search_finds_own_titles(spark):
    terms = spark.createDataFrame([("tide", i, 1) for i in range(20)] + [("harbour", 3, 2), ("harbour", 4, 1), ("beacon", 4, 1)], "term string, id int, tf int")
    asked = spark.createDataFrame([(3, "tide"), (3, "harbour"), (4, "beacon"), (4, "harbour"), (5, "absent")], "query int, term string")
    found = corpus.search(asked, corpus.posting_blocks(terms, 3), 20)
    assert rows(found.select("query", "place", "id").where("query = 4 or place < 3")) == [(3, 1, 3), (3, 2, 4), (4, 1, 4), (4, 2, 3)]
    assert rows(corpus.found_in_top(asked.select("query", F.col("query").alias("id")).distinct(), found)) == [(3, True), (4, True), (5, False)]


@pytest.mark.parametrize("seeds", [1, 50])
def test_search_is_exact(spark, monkeypatch, seeds):
    import math
    import random
    from collections import Counter, defaultdict

    rng = random.Random(seeds)
    vocabulary = [f"word{min(rng.randrange(60), rng.randrange(60), rng.randrange(60))}" for _ in range(4000)]
    docs = [Counter(rng.choices(vocabulary, k=rng.randint(1, 40))) + Counter(["everywhere"]) for _ in range(120)]
    docs += [Counter({"alpha": 1, "beta": 1, "gamma": 1, "delta": 1}), Counter({"alpha": 1, "beta": 1, "gamma": 1, "delta": 1}), Counter({"zzzzz": 1})]
    terms = spark.createDataFrame([(t, i, n) for i, d in enumerate(docs) for t, n in d.items()], "term string, id int, tf int")
    asked = [(q, t) for q in range(25) for t in {*rng.choices(vocabulary, k=rng.randint(1, 8)), *(["everywhere"] if q % 3 == 0 else [])}]
    asked += [(99, t) for t in ("alpha", "beta", "gamma", "delta", "zzzzz", "absent")]
    df = Counter(t for d in docs for t in d)
    want, by = [], defaultdict(set)
    for q, t in asked:
        by[q].add(t)
    for q, ts in by.items():
        scores = {i: round(sum(d[t] * math.log(len(docs) / df[t]) for t in ts if t in d), 6) for i, d in enumerate(docs) if ts & d.keys()}
        want += [(q, k, i) for k, (i, _) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5], 1)]
    monkeypatch.setattr(corpus, "SEEDS", seeds)
    found = corpus.search(spark.createDataFrame(asked, "query int, term string"), corpus.posting_blocks(terms, 10), len(docs))
    assert rows(found.select("query", "place", "id")) == sorted(want)


def test_redirects_have_no_chains(spark):
    old = spark.createDataFrame([("first", "second"), ("other", "x")], "old_slug string, target string")
    changes = spark.createDataFrame([("second", "third"), ("same", "same")], "old_slug string, new_slug string")
    assert rows(addressing.redirects_after(old, changes)) == [("first", "third"), ("other", "x"), ("second", "third")]


def test_reconcile(spark):
    now = spark.createDataFrame([("a", "A", "p", "1"), ("b", "B", "p", "2"), ("c", "C", None, None)], "id string, name string, parent string, modified string")
    was = spark.createDataFrame([("b", "B", "p", "1"), ("c", "C", None, None), ("d", "D", "p", "1")], now.schema)
    assert rows(reconcile.classes(now, was)) == [("a", "added"), ("b", "changed"), ("c", "unchanged"), ("d", "removed")]
    assert rows(reconcile.classes(now, now).select("class").distinct()) == [("unchanged",)]
    assert rows(reconcile.needs_export(now, was, narrow=True)) == [("a", True), ("b", True), ("c", False)]
    assert {r[1] for r in rows(reconcile.needs_export(now, was))} == {True}


def test_broken_links(spark):
    found = spark.createDataFrame([("fleet", "tug"), ("fleet", "tug?new=1"), ("fleet", "../ferry#deck"), ("quay/north", "/fleet/"), ("quay/north", "../south/"), ("quay/north", "mailto:crew@port.example"), ("fleet", None)], "source string, href string")
    valid = links.valid_slugs(spark.createDataFrame([("fleet",), ("quay/north",)], "slug string"), spark.createDataFrame([("ferry",)], "old_slug string"))
    assert rows(links.broken(found, valid)) == [("fleet", "fleet/tug"), ("fleet", "fleet/tug"), ("quay/north", "quay/south")]


def test_link_rewrite(spark):
    hrefs = ["https://docs.google.com/document/d/id1/edit", "https://docs.google.com/document/d/id1/view#intro", "https://drive.google.com/open?id=id1", "https://docs.google.com/document/d/id1/edit#heading=h.1", "https://docs.google.com/document/d/other/edit", "https://www.google.com/url?q=https://docs.google.com/document/d/id1/edit"]
    slugs = spark.createDataFrame([("id1", "team/page")], "id string, slug string")
    out = links.rewritten(spark.createDataFrame(list(enumerate(hrefs)), "i int, href string"), slugs)
    assert [tuple(r) for r in out.orderBy("i").select("new_href", "removed_anchor").collect()] == [("/team/page/", False), ("/team/page/#intro", False), ("/team/page/", False), ("/team/page/", True), (hrefs[4], False), ("/team/page/", False)]


def test_groups(spark):
    docs = spark.createDataFrame([("a", "Overview", ["One/"], "2024-01-01", "about one"), ("b", "X", ["One", "Deep"], "2024-02-01", None), ("c", "Y", [], None, None)], "id string, title string, folder_path array<string>, modified string, description string")
    assert rows(corpus.groups(docs).select("folder", "document_count", "newest", "description")) == [("General", 1, None, None), ("One", 2, "2024-02-01", "about one")]
    assert [r[0] for r in corpus.recent(docs).select("id").collect()] == ["b", "a"]


def test_checks(spark):
    slugs = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "documents")], "id string, slug string")
    assert rows(checks.slug_unique(slugs)) == [("slug_unique", "x", "2")]
    assert rows(checks.slug_not_reserved(slugs, ("documents",))) == [("slug_reserved", "c", "documents")]
    with pytest.raises(ValueError, match="slug_unique: x"):
        checks.require(checks.slug_unique(slugs))


def test_plans(spark, items):
    ranked = corpus.cards(spark.createDataFrame([("a", "t", ["f"], "1")], "id string, title string, folder_path array<string>, modified string"))
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().executedPlan().toString()


def test_children_name_their_folders_and_documents_in_order(spark):
    rows = [("root", "R", "folder", None), ("f", "Z", "folder", "root"), ("d2", "B", "document", "root"), ("d1", "B", "document", "root"), ("d3", "A", "document", "root"), ("u", "A", "unsupported", "root")]
    placed = hierarchy.paths(spark.createDataFrame(rows, "id string, name string, kind string, parent string"))
    assert [tuple(r) for r in hierarchy.children(placed).collect()] == [("root", 1, 3, 1, "f", "d3,d1,d2")]


def test_search_of_texts_shuffles_no_postings(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["alpha", "bravo", "charlie", "delta", "echoes", "1234", "abc"]) for _ in range(rng.randrange(30)))) for i in range(60)] + [(60, None)]
    texts = spark.createDataFrame(docs, "id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "alpha"), (1, "delta"), (2, "echoes"), (3, "nowhere"), (4, "bravo"), (4, "bravo")], "query long, term string")
    expected = corpus.search(asked, corpus.posting_blocks(corpus.terms(texts), 10), texts).collect()
    monkeypatch.setattr(corpus, "SCORED_WORDS", 50)
    monkeypatch.setattr(corpus, "ASKED_ENTRIES", 2)
    found = corpus.search_texts(asked, texts)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected)) and len(expected) == 15
    assert "postings" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_own_titles_are_searched_without_postings(spark):
    from ledgerleaf.plans import queries

    made = queries.search_own_title(spark, "/root/testdata/sf0.001")
    assert "postings" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_terms_are_counted_in_their_rows(spark):
    rows = [(1, "Word word-x, 1234 Éclair éclair abc"), (2, None), (3, ""), (4, "word")]
    texts = spark.createDataFrame(rows, "id int, text string")
    made = corpus.terms(texts)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in made.collect()) == [("word", 1, 1), ("word", 4, 1), ("word-x", 1, 1), ("éclair", 1, 2)]
    twice = texts.unionByName(spark.createDataFrame([(1, "word")], texts.schema))  # rows that share an id are one document
    assert ("word", 1, 2) in {tuple(r) for r in corpus.terms(twice).collect()}
