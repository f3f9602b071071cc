"""The alias table against the list in the plan and against plain search."""

import random

import pytest
from pyspark.sql import functions as F

from pricewake.functions import text as X
from pricewake.functions.brands import BRANDS, brand_dim
from pricewake.operators.brands import BRAND_DIM, attach_first_alias

TEXTS = ["Christian Dior 50ml", "a summer day", "YSL and mfk", "ESTÉE LAUDER", "nothing", "", None, "pdm", "hermès x dior",
         "Jo Malone London", "viktor & rolf!", "ATH", "xDiorx"]


def plain(text, rows, word_bound):
    hits = []
    for order, alias, canonical in rows:
        if text is None or not alias or order is None:
            continue
        low, word, at = text.lower(), alias.lower(), -1
        while (at := low.find(word, at + 1)) >= 0:
            around = (low[at - 1 : at] if at else "") + low[at + len(word) : at + len(word) + 1]
            if not word_bound or not any(c.isalnum() for c in around):
                hits.append((order, alias, canonical))
    return min(hits, default=(None,) * 3)


@pytest.mark.parametrize("word_bound", [False, True])
@pytest.mark.parametrize("part_bytes", [8 << 20, 500])
def test_like_the_list_in_the_plan(spark, word_bound, part_bytes):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "ord int, text string").withColumnRenamed("ord", "n")
    dim = spark.createDataFrame([(i, b, b) for i, b in enumerate(BRANDS)], BRAND_DIM)
    got = {r.n: r.alias for r in attach_first_alias(texts, dim, "text", word_bound, part_bytes).collect()}
    listed = texts.select("n", X.brand_of(F.lower("text"), BRANDS, word_bound).alias("brand"))
    assert got == {r.n: r.brand for r in listed.collect()}
    both = attach_first_alias(texts, spark.createDataFrame(brand_dim(), BRAND_DIM))
    listed = texts.select("n", X.alias_of(F.lower("text")).alias("a")).select("n", "a.alias", "a.canonical")
    assert {(r.n, r.alias, r.canonical) for r in both.collect()} == {tuple(r) for r in listed.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_like_plain_search(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(500), "".join(rng.choices("abC d", k=rng.randrange(1, 6))), f"c{i}") for i in range(60)]
    rows += [(None, "a", "x"), (3, "", "x"), (7, None, "x"), (1000, "É", "e")]
    texts = [(i, "".join(rng.choices("abcd XÉ", k=rng.randrange(0, 14)))) for i in range(200)]
    df = spark.createDataFrame(texts, "id int, `a.b` string")
    for word_bound in (False, True):
        got = attach_first_alias(df, spark.createDataFrame(rows, BRAND_DIM), "a.b", word_bound, part_bytes=700)
        assert got.columns == ["id", "a.b", "alias_ord", "alias", "canonical"]
        for r in got.collect():
            want = plain(r["a.b"], rows, word_bound)
            assert (r.alias_ord, (r.alias or "").lower() or None) == (want[0], (want[1] or "").lower() or None)


def test_empty_table_and_no_shuffle(spark):
    texts = spark.createDataFrame([("dior",)], "text string")
    none = attach_first_alias(texts, spark.createDataFrame([], BRAND_DIM))
    assert [tuple(r) for r in none.collect()] == [("dior", None, None, None)]
    assert "Exchange" not in none._jdf.queryExecution().executedPlan().toString()
