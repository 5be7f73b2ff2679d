import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import additive_search, lattice_dedup


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 32))
    near = [x[i % 10] / np.linalg.norm(x[i % 10]) + rng.normal(size=32) * 0.03 for i in range(60)]
    rows = [(i, v.tolist()) for i, v in enumerate([*x, *near, *([x[3]] * 5)])]
    odd = [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, [None] * 32), (904, [1.0, 2.0]), (None, x[0].tolist()), (7, x[7].tolist())]
    return rows, spark.createDataFrame([(i, v, 0, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, label int, keys string")


def test_lattice_links(vectors):
    rows, df = vectors
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    got = {r.vec_id: r for r in lattice_dedup.near_duplicates(df, part=7).collect() if r.vec_id is not None}
    want = linked.sum(axis=1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.95 * want.sum()
    assert got[900].n_links == got[901].n_links == got[902].n_links == got[903].n_links == 0
    group = list(range(len(x)))
    for i, j in zip(*np.nonzero(linked)):
        group = [group[j] if g == group[i] else g for g in group] if group[i] != group[j] else group
    same = sum(got[i].component_id == min(k for k in range(len(x)) if group[k] == group[i]) for i in range(len(x)))
    assert same >= 0.95 * len(x) and all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_e8_decoding():
    x = np.random.default_rng(1).normal(size=(200, 8)) * 2
    p = lattice_dedup.nearest_e8(x)
    assert (np.round(2 * p) == 2 * p).all() and (np.round(p.sum(axis=1)) % 2 == 0).all()
    around = p[:, None, :] + lattice_dedup.MINIMAL[None]
    assert (((x[:, None] - around) ** 2).sum(axis=2).min(axis=1) >= ((x - p) ** 2).sum(axis=1) - 1e-9).all()


def test_search(vectors):
    rows, df = vectors
    x = np.array([v for _, v in rows])
    got = additive_search.nearest(df, F.col("vec_id") % 20 == 0, shortlist=120).collect()
    hit = total = 0
    for q in range(0, len(x), 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and np.allclose([r.score for r in own], [d[r.vec_id] for r in own])
        hit, total = hit + len({r.vec_id for r in own} & set(want)), total + 10
    assert hit / total >= 0.9


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert additive_search.nearest(none, F.col("vec_id") % 20 == 0).count() == 0
    assert lattice_dedup.near_duplicates(none).count() == 0


def test_search_with_ties_and_recall_on_the_given_vectors(spark):
    x = np.repeat(np.eye(8), 5, axis=0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in additive_search.nearest(df, F.col("vec_id") % 20 == 0).collect())
    # the copies come first, then the smallest ids of those that are equally far
    assert [v for q, _, v in got if q == 0] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert [v for q, _, v in got if q == 20] == [21, 22, 23, 24, 0, 1, 2, 3, 4, 5]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_recall_at_two_sizes(spark, size):
    import os

    path = f"/root/testdata/{size}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("the driver's tables are not here")
    df = spark.read.parquet(path).select("vec_id", "embedding")
    rows = df.toPandas().sort_values("vec_id")
    ids, x = rows["vec_id"].to_numpy(), np.array(rows["embedding"].to_list(), np.float64)
    hit = total = 0
    found = {}
    for r in additive_search.nearest(df, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for k in np.flatnonzero(ids % 100 == 0):
        d = ((x - x[k]) ** 2).sum(axis=1)
        want = [i for i in ids[np.lexsort((ids, d))] if i != ids[k]][:10]
        hit, total = hit + len(found[ids[k]] & set(want)), total + 10
    assert hit / total >= 0.9
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum() - len(x)
    assert lattice_dedup.near_duplicates(df).agg(F.sum("n_links")).first()[0] >= 0.9 * links


def test_sample_leaves_most_vectors_with_their_tasks(spark):
    """The codebooks' sample is what it was, and the driver gets little more than that, however many tasks there are."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(20_000, 16)))], "vec_id long, embedding array<double>")
    want = df.orderBy(F.xxhash64("vec_id"), "vec_id").limit(1_000).toPandas()["embedding"].to_list()
    for total in (20_000, 2_000_000):  # at the second the bound is too low at first
        assert additive_search._sample(df, total, 1_000).tolist() == [list(v) for v in want]
    context = spark.sparkContext._jsc.sc()

    def returned() -> int:
        context.listenerBus().waitUntilEmpty(30_000)
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
        return sum(stages.apply(i).resultSize() for i in range(stages.size()))

    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        before = returned()
        additive_search.nearest(df, F.col("vec_id") % 100 == 0, sample=1_000)
        assert returned() - before < 1_500_000  # all vectors are 3 MB
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_pairs_of_blocks_are_not_broadcast(spark):
    """Spark counts exploded query blocks as one copy each, so under its threshold all copies would go through the driver."""
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 8)))], "vec_id long, embedding array<double>")
    found = additive_search.nearest(df, F.col("vec_id") % 20 == 0)
    assert len(found.collect()) == 300
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
