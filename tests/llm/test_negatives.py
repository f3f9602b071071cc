import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewake.llm import negatives

SCHEMA = "id long, label long, vector array<long>"


def brute(rows, anchors, k=5, m=5, low=80, high=100):
    out = []
    for a, la, x in anchors:
        scored = [(-sum(p * q for p, q in zip(x, y)), i, lb) for i, lb, y in rows if i != a]
        for ps, p, _ in sorted(s for s in scored if s[2] == la)[:k]:
            fits = [s for s in scored if s[2] != la and low * -ps <= 100 * -s[0] <= high * -ps]
            out += [(a, p, r, i, -ps, -ns) for r, (ns, i, _) in enumerate(sorted(fits)[:m], 1)]
    return Counter(out)


def random_rows(seed, n, dims, spread):
    random.seed(seed)
    centres = [[random.randint(-spread, spread) for _ in range(dims)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = random.choice(centres)
        rows.append((i, random.randrange(4), [x + random.randint(-4, 4) for x in c]))
    rows += [(n + i, i % 2, rows[0][2]) for i in range(30)]  # ties
    return rows + [(n + 100, 1, [0] * dims), (n + 101, 9, rows[1][2])]


@pytest.mark.parametrize(
    "n,dims,spread,sizes",
    [
        (300, 8, 20, {"block": 64, "codewords": 4}),
        (500, 7, 3, {"block": 200, "pass_bytes": 600, "sample": 50}),
        (6, 3, 5, {"block": 2, "codewords": 50}),
        (200, 1, 9, {}),
    ],
)
def test_like_brute_force(spark, n, dims, spread, sizes):
    rows = random_rows(n, n, dims, spread)
    df = spark.createDataFrame(rows, SCHEMA)
    got = negatives.mine(df, df.filter("id % 9 = 0"), **sizes)
    assert Counter(map(tuple, got.collect())) == brute(rows, [r for r in rows if r[0] % 9 == 0])


def test_other_windows(spark):
    rows = random_rows(1, 200, 5, 10)
    df = spark.createDataFrame(rows, SCHEMA)
    got = negatives.mine(df, df.filter("id < 20"), positives=2, negatives=3, low=50, high=90, block=70)
    assert Counter(map(tuple, got.collect())) == brute(rows, rows[:20], 2, 3, 50, 90)


def test_search_stops_early_and_passes_cells_over():
    rng = np.random.default_rng(3)
    centres = rng.integers(-300, 300, (20, 16))
    vectors = centres[rng.integers(0, 20, 4000)] + rng.integers(-5, 6, (4000, 16))
    labels = rng.integers(0, 3, 4000)
    books = (negatives.fit_codebook(vectors[:, :8], 16), negatives.fit_codebook(vectors[:, 8:], 16))
    cells = negatives.Cells.build(np.arange(4000), labels, vectors, books)
    query = vectors[7].astype(float)
    bounds = [scores.max() for _, scores in cells.walk(query, lambda: -np.inf)]
    assert sum(len(places) for places, _ in cells.walk(query, lambda: -np.inf)) == 4000 and bounds
    best = cells.positives(7, int(labels[7]), query, 5)
    exact = sorted((-int(vectors[i] @ vectors[7]), i) for i in range(4000) if i != 7 and labels[i] == labels[7])[:5]
    assert best == [(-s, i) for s, i in exact]
    seen = sum(len(p) for p, _ in cells.walk(query, lambda: best[-1][0]))
    assert 0 < seen < 2000
    below = sum(len(p) for p, _ in cells.walk(query, lambda: -np.inf, highest=0.0))
    assert 0 < below < 4000


def test_awkward_rows(spark):
    rows = [
        (0, [1.0, 2.0], 1),
        (0, [1.0, 2.0], 1),
        (1, None, 1),
        (2, [float("nan"), 1.0], 1),
        (3, [None, 1.0], 1),
        (4, [1.0, float("inf")], 2),
        (None, [1.0, 1.0], 1),
        (5, [1.0, 1.0], None),
        (6, [1.0], 1),
        (7, [], 2),
        (8, [1.0, 1.5], 2),
        (9, [-1.0, -1.5], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("block", F.lit("x"))
    ready = negatives.labelled_vectors(df, "vec_id", "embedding", F.col("label"), 2.0)
    plain = [(r.id, r.label, r.vector) for r in ready.collect()]
    assert sorted(plain) == [(0, 1, [2, 4]), (6, 1, [2]), (7, 2, []), (8, 2, [2, 3]), (9, 1, [-2, -3])]
    padded = [(i, label, (v + [0, 0])[:2]) for i, label, v in plain]
    got = negatives.mine(ready, ready, low=50, high=400)
    assert Counter(map(tuple, got.collect())) == brute(padded, padded, low=50, high=400)
    none = negatives.mine(ready.filter("id < 0"), ready.filter("id < 0"))
    assert none.columns == got.columns and none.count() == 0
    assert negatives.mine(ready, ready.filter("id < 0")).count() == 0
