import math
from collections import Counter, defaultdict

import pytest
from helpers import SF, awkward, empty
from pyspark.sql import functions as F

from pricewake.llm import mixing


def weights(tokens, a):
    z = sum((t / sum(tokens.values())) ** a for t in tokens.values())
    return {s: (t / sum(tokens.values())) ** a / z for s, t in tokens.items()}


def entropy(w):
    return -sum(x * math.log(x) for x in w.values())


def test_exponent_meets_targets(spark):
    tokens = {"a": 1_000_000, "b": 50_000, "c": 9_000, "d": 700}
    totals = spark.createDataFrame([(s, t, 1) for s, t in tokens.items()], "source string, tokens long, n long")
    budget = sum(tokens.values())
    for share in (0.2, 0.5, 0.9, 1.0):
        a = mixing.bisect_exponent(totals, budget, entropy=share)
        assert entropy(weights(tokens, a)) >= share * math.log(4) - 1e-9
        assert entropy(weights(tokens, a + 1e-4)) < share * math.log(4)
    for limit in (1.5, 3.0, 20.0):
        a = mixing.bisect_exponent(totals, budget, repetition=limit)
        most = max(budget * w / tokens[s] for s, w in weights(tokens, a).items())
        less = max(budget * w / tokens[s] for s, w in weights(tokens, max(0, a - 1e-5)).items())
        assert most <= limit + 1e-6 < less + 1e-6 and less > limit
    assert mixing.bisect_exponent(totals, budget, repetition=0.5) == 1.0
    assert mixing.bisect_exponent(totals, budget) == 1.0
    assert mixing.bisect_exponent(totals.limit(1), budget, entropy=0.5) == 1.0
    both = mixing.bisect_exponent(totals, budget, entropy=1.0, repetition=3.0)
    assert both == mixing.bisect_exponent(totals, budget, repetition=3.0)


@pytest.mark.parametrize("per_block", [3, 4096])
def test_budget_is_filled(spark, per_block):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mixture(docs, entropy=0.98, per_block=per_block, budget=60_000).collect()
    tokens, used, weight, largest = Counter(), Counter(), {}, Counter()
    for r in docs.collect():
        n = len((r.text or "").split())
        tokens[r.source] += n
        largest[r.source] = max(largest[r.source], n)
    for r in got:
        used[r.source] += r.n_tokens
        weight[r.source] = r.weight
    for source, w in weight.items():
        assert 60_000 * w - largest[source] - 1 <= used[source] <= 60_000 * w + 1
    passes = defaultdict(Counter)
    for r in got:
        passes[r.source][r.doc_id] += 1
    for counts in passes.values():
        assert max(counts.values()) - min(counts.values()) <= 1


def test_blocks_change_nothing_but_their_number(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [
        Counter((r.doc_id, r.epoch) for r in mixing.mixture(docs, entropy=0.9, per_block=n).collect()) for n in (2, 5000)
    ]
    assert rows[0] == rows[1]


def test_documents_like_mixture(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("use", F.lit(1)).withColumn("key", F.lit("k"))
    a = Counter(r.doc_id for r in mixing.mixture(docs, repetition=2.0).collect())
    mixed = mixing.mix_documents(docs, repetition=2.0)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == a
    assert max(a.values()) <= 3


def test_very_many_uses(spark, monkeypatch):
    """A source of one word with half the weight: ranges of its uses are cut over several levels."""
    rows = [(1, "one", "tiny"), (2, "two " * 50, "large"), (3, "three " * 50, "large")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for uses in (1024, 16):
        monkeypatch.setattr(mixing, "USES", uses)
        got = mixing.mixture(docs, entropy=1.0, budget=40_000)
        seen = Counter((r.doc_id, r.epoch) for r in got.collect())
        assert seen == Counter({(1, e): 1 for e in range(20_000)} | {(i, e): 1 for i in (2, 3) for e in range(200)})
    mixed = Counter(r.doc_id for r in mixing.mix_documents(docs, entropy=1.0, budget=40_000).collect())
    assert mixed == {1: 20_000, 2: 200, 3: 200}


def test_awkward(spark):
    got = mixing.mixture(awkward(spark), repetition=4.0).collect()
    known = {1, 2, 3, 4, 5, 6, 7, None, 8, 9, 10, 11}
    assert {r.doc_id for r in got} <= known and got
    same = [r.epoch for r in got if r.doc_id == 1 and r.source == "a"]
    assert all(n == 2 for n in Counter(same).values())
    assert mixing.mix_documents(awkward(spark), entropy=0.5).columns == awkward(spark).columns
    assert mixing.mixture(empty(spark), entropy=0.5).count() == 0
    assert mixing.mix_documents(empty(spark), entropy=0.5).count() == 0
    silent = awkward(spark, [(1, None, "en", "a"), (2, "", "en", None)])
    assert mixing.mixture(silent, entropy=0.5).count() == 0
