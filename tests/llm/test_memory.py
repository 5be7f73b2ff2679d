"""What the pipeline's tasks hold in their Python workers, beside the executor's heap."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from ledgerleaf.llm import _shared, ngram_join, toxicity


def test_shingles_are_counted_in_little_memory():
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 50_000, 2_000))) for _ in range(ngram_join.COUNTED // 2_000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(texts[i : i + 100]), pa.array(range(100))], ["doc", "text", "h"]) for i in range(0, len(texts), 100)]
    tracemalloc.start()
    try:
        found = pa.Table.from_batches(ngram_join._sized(5)(iter(batches))).to_pydict()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    words, n = np.unique(np.array(" ".join(texts).split()), return_counts=True)
    assert sorted(b for kind, b in zip(found["kind"], found["b"]) if kind == 2) == sorted(n[n >= ngram_join.FREQUENT])
    assert peak < 6 * 8 * ngram_join.COUNTED


def test_texts_are_scored_some_at_a_time(monkeypatch):
    met = []

    class Evidence:
        def __init__(self, models):
            pass

        def features(self, texts):
            met.append(sum(map(len, texts)))
            return np.zeros((len(texts), len(toxicity.MARGINS) + 1))

    monkeypatch.setattr(toxicity, "Evidence", Evidence)
    batch = pa.RecordBatch.from_arrays([pa.array(range(1_000)), pa.array(["x" * 3_000] * 1_000)], ["doc_id", "text"])
    out = list(toxicity._featured(type("B", (), {"value": None}))(iter([batch])))
    assert sum(len(b) for b in out) == 1_000 and sum(met) == 3_000_000
    assert max(met) <= 1 << 20


def test_the_sample_reaches_the_executors_without_rows_of_python(spark, monkeypatch):
    """Rows of Python would start workers of another kind beside those that score texts."""
    docs = spark.createDataFrame([(i, "plain words" if i % 2 else "vile words") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, (i + 1) % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    made, met = SparkSession.createDataFrame, []
    monkeypatch.setattr(SparkSession, "createDataFrame", lambda self, data, *more, **named: (met.append(type(data)), made(self, data, *more, **named))[1])
    assert toxicity.score(docs, labels).count() == 60 and toxicity.score(docs, labels.limit(0)).count() == 60
    assert met and set(met) == {pa.Table}


def test_a_batch_of_long_texts_is_small():
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000"}
    _shared.small_batches(type("Session", (), {"conf": type("Conf", (), {"get": conf.get, "set": conf.__setitem__})}))
    assert int(conf["spark.sql.execution.arrow.maxRecordsPerBatch"]) * 32_000 <= 8_000_000
