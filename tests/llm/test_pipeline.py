"""The pipeline's decisions on a small corpus, stage by stage and as a whole."""

import random

import pytest


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    rows, labels = [], []
    for i in range(200):
        own = prose(60)
        if i % 5 == 0:
            own[10], own[20], own[30] = "gruzokka", "wumpfle", "gruzokken"
        rows.append((i, " ".join(own), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(i % 5 == 0)))
    copy = prose(80)
    rows += [(300, " ".join(copy), "en", "s0", 0), (301, " ".join(copy), "en", "s1", 0), (302, " ".join([*copy[:79], "other"]), "en", "s2", 0)]
    rows += [(400, " ".join(prose(50)) + " password: hunter2222 end", "en", "s1", 0), (401, None, "en", None, None), (402, "", "en", "s0", 0)]
    where = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    from ledgerleaf.llm import _shared, mixing, packing

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = _shared.stage(stage(spark, docs, sf_dir), name)
        seen[name] = docs
        assert name == "packing" or docs.columns == columns
    ids = {name: sorted(r.doc_id for r in df.select("doc_id").collect()) for name, df in seen.items()}
    kept = [i for i in range(200) if i % 5] + [300, 301, 302, 400, 401, 402]
    assert ids["toxicity"] == kept
    assert ids["ngram_join"] == ids["secrets"] == [i for i in kept if i not in (301, 302)]
    texts = {r.doc_id: r.text for r in seen["secrets"].collect()}
    assert texts[400].endswith(" [SECRET] end") and texts[401] is None
    total = lambda df: sum(r[0] for r in df.select(mixing.word_count(df.text)).collect())
    assert abs(total(seen["mixing"]) - 1.5 * total(seen["secrets"])) <= 150
    encoder = packing.Ids(packing.tokenizer_path(packing.TOKENIZER))
    assert sum(r.length for r in docs.collect()) == sum(len(x) for x in encoder.of([r.text or "" for r in seen["mixing"].collect()], 1))
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()


EXTRA = ["base", "more", "hexes", "clean", "row", "copy", "h", "doc", "key", "x", "score", "size", "bucket", "sid"]


def odd_rows(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame([(i, t, "en", s, None, *(f"{c}!" for c in EXTRA)) for i, t, s in rows], schema)


def test_stages_keep_rows_apart_and_columns_as_they_are(spark, sf_dir, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    one, other, third = (" ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(30)) for _ in range(3))
    docs = odd_rows(spark, [(3, one, "a"), (3, other, "a"), (1, other, "b"), (9, one, "b"), (9, one, "b"), (None, third, None), (None, None, "a"), (5, third + " password=abcdef123", "a"), (6, "", "b")])
    stages = dict(corpus_pipeline.STAGES)
    left = stages["ngram_join"](spark, docs, sf_dir)
    assert left.columns == docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in left.collect()) == sorted(str(x) for x in [(3, one), (1, other), (None, third), (None, None), (5, third + " password=abcdef123"), (6, "")])
    plain = [(1000 + r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 200").collect()]
    labels = spark.createDataFrame([(1000 + i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, sf_dir = docs.unionByName(odd_rows(spark, plain)), str(tmp_path)
    for name in ("toxicity", "ngram_join", "secrets", "mixing"):
        before, docs = docs, stages[name](spark, docs, sf_dir)
        assert docs.columns == before.columns, name
        assert all(r[c] == f"{c}!" for r in docs.collect() for c in EXTRA), name
    assert stages["packing"](spark, docs, sf_dir).count() > 0


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
