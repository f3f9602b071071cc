import random

import numpy as np
import pytest

from pricewake.llm import topk


def brute(rows, queries, k):
    out = set()
    for q, x in queries:
        scores = sorted((-sum(a * b for a, b in zip(x, y)), v) for v, y in rows if v != q)
        out |= {(q, i, v, -s) for i, (s, v) in enumerate(scores[:k], 1)}
    return out


@pytest.mark.parametrize("n,dims,block,pass_bytes", [(300, 8, 64, 500), (700, 6, 400, 1 << 20), (5, 3, 2, 24)])
def test_like_brute_force(spark, n, dims, block, pass_bytes):
    random.seed(n)
    rows = [(i, [random.randint(-9, 9) for _ in range(dims)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(30)]  # ties
    rows += [(n + 100, [0] * dims)]
    df = spark.createDataFrame(rows, "id long, vector array<long>")
    got = topk.top_k(df, df.filter("id % 3 = 0"), 4, block, pass_bytes)
    assert {tuple(r) for r in got.collect()} == brute(rows, [r for r in rows if r[0] % 3 == 0], 4)


def test_search_stops_early_and_stays_exact():
    rng = np.random.default_rng(1)
    vectors = np.floor(rng.pareto(1.2, size=(6000, 16))).clip(0, 500).astype(np.int64)
    ids = np.arange(6000)
    block = topk.Block(ids, *topk.Block.segments(vectors), width=16)
    assert list(block.levels) == sorted(block.levels, reverse=True)
    queries = np.floor(rng.pareto(1.5, size=(9, 16))).astype(np.int64) * rng.choice([-1, 1], (9, 16))
    queries[0] = 0
    short = 0
    for query, (places, scores) in zip(queries, block.search(queries, 5)):
        exact = sorted((-int(v @ query), i) for i, v in enumerate(vectors))[:5]
        assert sorted(zip((-scores).tolist(), places.tolist()))[:5] == exact
        short += len(places) < 6000
    assert short


def test_awkward_vectors(spark):
    rows = [
        (0, [1.0, 2.0]),
        (0, [1.0, 2.0]),
        (1, None),
        (2, [float("nan"), 1.0]),
        (3, [None, 1.0]),
        (4, [float("inf"), 1.0]),
        (5, []),
        (6, [0.5]),
        (None, [1.0, 1.0]),
        (7, [-1.0, 0.01]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr(
        "vec_id", "embedding", "'x' as id", "1 as block", "2 as part"
    )
    vectors = topk.quantised(df, "vec_id", "embedding")
    assert {r.id for r in vectors.collect()} == {0, 5, 6, 7}
    got = [tuple(r) for r in topk.top_k(vectors, vectors, 2).collect() if r.query_id == 0]
    assert sorted(got) == [(0, 1, 6, 64 * 32), (0, 2, 5, 0)]
    none = vectors.filter("id < 0")
    assert topk.top_k(none, none).count() == 0
    assert topk.top_k(vectors, none).count() == 0
