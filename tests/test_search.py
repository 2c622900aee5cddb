import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrail.functions import vectors as V
from vectrail.operators import search as S
from vectrail.operators.store import VectorStore

DIMS = 13


def rows_of(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v], i) for i, v in enumerate(vectors)], "id bigint, values array<float>, order bigint")


@pytest.fixture(scope="module")
def vectors():
    return np.random.default_rng(42).uniform(-1, 1, (200, DIMS)).astype(np.float32)


@pytest.fixture(scope="module")
def store(spark, vectors):
    return VectorStore.of("s", DIMS, rows_of(spark, vectors)).persist()


def brute(vectors, q, k, keep=None):
    v, q = vectors.astype(np.float64), np.array(q, np.float64)
    score = v @ q / (np.linalg.norm(v, axis=1) * np.linalg.norm(q))
    order = [i for i in np.lexsort((np.arange(len(v)), -score)) if keep is None or keep(i)]
    return [(int(i), score[i]) for i in order[:k]]


def same(found, wanted):
    got = [(r["id"], r["score"]) for r in found.collect()]
    assert [g[0] for g in got] == [w[0] for w in wanted]
    assert np.allclose([g[1] for g in got], [w[1] for w in wanted], atol=1e-6)


@pytest.mark.parametrize("values, norm", [([1.0, 0.0, 0.0], 1), ([0.0] * 10, 0), ([3.0, 4.0], 5)])
def test_magnitude(spark, values, norm):
    assert spark.createDataFrame([(values,)], "v array<float>").select(V.magnitude(F.col("v"))).first()[0] == pytest.approx(norm)


@pytest.mark.parametrize("a, b, score", [([1, 2, 3], [1, 2, 3], 1), ([1, 0, 0], [0, 1, 0], 0), ([1, 2, 3], [-1, -2, -3], -1), ([1, 2], [0, 0], 0)])
def test_cosine(spark, a, b, score):
    df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b])], "a array<float>, b array<float>")
    assert df.select(V.cosine(F.col("a"), V.magnitude(F.col("a")), F.col("b"), V.magnitude(F.col("b")))).first()[0] == pytest.approx(score, abs=1e-4)


def test_masked_mean_and_unit_length(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "v array<array<double>>, m array<int>")
    mean = df.select(V.masked_mean(F.col("v"), F.col("m")).alias("x")).first()[0]
    assert mean == [2.0, 3.0]
    unit = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(V.l2_normalize(F.col("v")).alias("x")).collect()
    assert [list(r[0]) for r in unit] == [[0.6, 0.8], [0.0, 0.0]]


def test_top_k(store, vectors):
    q = vectors[7]
    same(store.search(q.tolist(), 10), brute(vectors, q, 10))
    assert store.search(q.tolist(), 500).count() == 200


@pytest.mark.parametrize("k, query", [(0, [1.0] * DIMS), (-1, [1.0] * DIMS), (5, []), (5, [0.0] * DIMS)])
def test_empty_results(store, k, query):
    assert store.search(query, k).count() == 0


def test_wrong_inputs(store):
    with pytest.raises(ValueError):
        store.search([1.0], 5)
    assert store.search([1.0], 0).count() == 0  # the limit is looked at first
    with pytest.raises(ValueError):
        store.search(None, 5)


def test_filters(spark, store, vectors):
    q = vectors[3].tolist()
    wanted = brute(vectors, q, 3, lambda i: i in {1, 3, 5, 7, 9, 11})
    allowed = spark.createDataFrame([(i,) for i in (1, 3, 5, 7, 9, 11, 11)], "key bigint")
    same(store.search(q, 3, allowed), wanted)
    same(store.search(q, 3, F.col("id").isin(1, 3, 5, 7, 9, 11)), wanted)
    same(store.search(q, 3, lambda i: i in (1, 3, 5, 7, 9, 11)), wanted)
    assert store.search(q, 3, F.col("id") < 0).count() == 0


def test_filter_reaches_the_scan(spark, vectors, tmp_path):
    path = f"file://{tmp_path}/rows"
    VectorStore.of("s", DIMS, rows_of(spark, vectors)).rows.write.parquet(path)
    plan = S.top_k(spark.read.parquet(path), vectors[0].tolist(), 5, DIMS, F.col("id") > 100)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,100)" in plan and "TakeOrderedAndProject" in plan


def test_ties_and_zero_and_nan(spark):
    v = [[1.0, 0.0], [1.0, 0.0], [0.0, 0.0], [float("nan"), 1.0], [-1.0, 0.0]]
    store = VectorStore.of("s", 2, rows_of(spark, v))
    assert [(r["id"], r["score"]) for r in store.search([2.0, 0.0], 10).collect()] == [(0, 1.0), (1, 1.0), (2, 0.0), (4, -1.0)]


def test_batch(spark, store, vectors):
    queries = spark.createDataFrame([(int(i), vectors[i].tolist()) for i in (0, 5, 9)], "query_id bigint, values array<float>")
    found = {}
    for r in S.batch_top_k(store.rows, queries, 4).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    for i in (0, 5, 9):
        assert [found[i][r] for r in (1, 2, 3, 4)] == [w[0] for w in brute(vectors, vectors[i], 4)]
    assert S.batch_top_k(store.rows, queries, 0).count() == 0
    assert S.batch_top_k(store.rows, queries.limit(0), 3).count() == 0


ODD = [None, [], [float("nan")] + [1.0] * (DIMS - 1), [float("inf")] + [1.0] * (DIMS - 1), [None] + [1.0] * (DIMS - 1), [1.0, 2.0], [0.0] * DIMS]


@pytest.mark.parametrize("bound", [S.QUERY_BYTES, 0])
def test_batch_finds_what_single_searches_find(spark, vectors, bound, monkeypatch):
    """Odd rows and queries, keys that are strings, ties, k beyond the rows; both ways of pairing."""
    monkeypatch.setattr(S, "QUERY_BYTES", bound)
    monkeypatch.setattr(S, "QUERY_BLOCK", 7)
    monkeypatch.setattr(S, "SCORES", 70)
    held = [(f"r{i:03}", v.tolist()) for i, v in enumerate(vectors[:40])] + [(f"odd{i}", v) for i, v in enumerate(ODD)] + [("twin", vectors[0].tolist()), (None, vectors[1].tolist())]
    rows = spark.createDataFrame([(i, v, None if v is None else float(np.sqrt(np.sum(np.square(np.array(v, float)))))) for i, v in held], "id string, values array<float>, magnitude double")
    rows = rows.withColumn("magnitude", V.magnitude(F.col("values"))).repartition(3)
    asked = [(f"q{i}", vectors[i].tolist()) for i in range(0, 30, 2)] + [(f"x{i}", v) for i, v in enumerate(ODD)]
    queries = spark.createDataFrame(asked, "query_id string, values array<float>")
    for k in (1, 3, 100):
        found = {}
        for r in S.batch_top_k(rows, queries, k).orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 9)))
        for name, v in asked[:3]:
            assert found[name] == [(r["id"], round(r["score"], 9)) for r in S.top_k(rows, v, k).collect()]
        assert {n for n in found if n[0] == "x"} <= {"x5"}  # a query of two dimensions meets the row of two


def test_several_stores(spark, vectors):
    a = VectorStore.of("a", DIMS, rows_of(spark, vectors[:100]))
    b = VectorStore.of("b", DIMS, rows_of(spark, vectors[100:]))
    found = S.search_stores([a, b], vectors[150].tolist(), 3).collect()
    assert (found[0]["id"], found[0]["store_name"]) == (50, "b")
    assert [r["score"] for r in found] == sorted((r["score"] for r in found), reverse=True)
    for bad in (lambda: S.search_stores([], [1.0], 1), lambda: S.search_stores([a], [1.0] * DIMS, 0), lambda: S.search_stores(None, [1.0], 1)):
        with pytest.raises(ValueError):
            bad()
