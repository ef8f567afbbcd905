import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from compare import connect, difference
from wardlake.llm import queries, topk


def brute(q, own, x, ids, k):
    out = []
    for query, name in zip(q, own):
        places = np.flatnonzero(ids != name)
        s = x[places] @ query
        out.append(places[np.lexsort((ids[places], -s))[:k]])
    return out


@pytest.mark.parametrize("n,k,width,spread", [(3000, 10, 16, 300), (500, 10, 64, 2), (5, 10, 3, 5), (1, 10, 4, 9), (400, 3, 1, 1)])
def test_search_equals_brute_force(n, k, width, spread):
    rng = np.random.default_rng(n)
    x = rng.integers(-spread, spread + 1, (n, width))
    x[: n // 3] = x[0]  # a third of the vectors is one vector
    ids = np.arange(n) * 3
    q, own = np.vstack([x[::50], -x[:1], np.zeros((1, width), int)]), np.append(ids[::50], [-1, -2])
    for got, want in zip(topk.search(q, own, x, ids, k), brute(q, own, x, ids, k)):
        assert got.tolist() == want.tolist()


def test_large_numbers_stay_exact():
    x = np.array([[2**31, 1], [2**31, 2], [2**31, 0]])
    [got] = topk.search(np.array([[2**30, 1]]), np.array([-1]), x, np.arange(3), 2)
    assert got.tolist() == [1, 0]


def test_query_equals_sql(spark, small):
    assert difference(queries.QUERIES["op2_exact_top_k"](spark, small), connect(small), queries.CHECKS["op2_exact_top_k"]) is None


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 2)
    monkeypatch.setattr(topk, "QUERIES", 1)
    rows = [(0, [0.5, 1.0]), (1, [0.5, 1.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]),
            (6, [-0.0005]), (7, []), (100, [0.1, 0.1]), (100, [0.1, 0.1]), (None, [1.0, 1.0]), (-100, [-1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<float>").withColumn("shard", F.lit("own"))
    vectors = topk.integer_vectors(df, "vec_id", "v")
    assert {tuple(r["x"]) for r in vectors.filter("vec_id = 6").collect()} == {(-1,)}
    got = topk.top_k(vectors, F.col("vec_id") % 100 == 0).toPandas()
    x = {0: (512, 1024), 1: (512, 1024), 6: (-1, 0), 7: (0, 0), 100: (102, 102), -100: (-1024, 1024)}
    for name in (0, 100, -100):
        want = sorted((-(x[name][0] * b[0] + x[name][1] * b[1]), i) for i, b in x.items() if i != name)[:10]
        mine = got[got["query_id"] == name].sort_values("rank")
        assert [(-s, i) for s, i in zip(mine["score"], mine["vec_id"])] == want
    assert topk.top_k(vectors.limit(0), F.lit(True)).count() == 0
    assert topk.top_k(vectors, F.lit(False)).count() == 0
    assert "op2_exact_top_k" in entry_points.queries()
