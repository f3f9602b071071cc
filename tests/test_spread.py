"""Rows that cost much each are worked on by many tasks, however few row groups their table has."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pricewake.catalog import inputs as I
from pricewake.functions import text as X

SF = Path("/root/testdata/sf0.01")


def sizes(rows):
    return rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()


def test_one_row_group_becomes_many_tasks(spark):
    rows = spark.range(10_000).coalesce(1)
    spread = I.spread(rows, "id", rows_per_task=1_000)
    found = sizes(spread)
    assert len(found) == 10 and max(found) < 2_000
    assert sorted(r["id"] for r in spread.collect()) == list(range(10_000))
    assert len(sizes(I.spread(rows, "id"))) == spark.sparkContext.defaultParallelism
    assert sizes(I.spread(rows.limit(0), "id")) == [0]


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("make", [I.sale_posts, I.product_pages, I.catalogue_pages])
def test_posts_and_pages_are_spread(spark, make):
    found = sizes(make(spark, str(SF)))
    assert len(found) > 1 and max(found) < 0.75 * sum(found)


def test_searches_before_patterns_change_nothing(spark):
    """Texts are spared patterns that cannot match; what comes out is what the plain patterns give."""
    bits = ["ml", "mL", "Ml", "50", "45/50 ml", " ", "  ", "\t", "　", "\x85", "\r\n", "\r", "$ 1,200.5", "%",
            "95%", "≈30ml", "https://a.b/c", "://", "(a)", "~~", "**", "-", "BNIB", "😀", "é", "x"]
    rows = [(a + b + c,) for a in bits for b in bits for c in bits[::2]] + [(None,)]
    t = F.col("t")
    name = F.regexp_replace(F.regexp_replace(t, X.URL, ""), X.PARENTHESISED, "")
    for word in X.DESCRIPTORS:
        name = F.replace(name, F.lit(word), F.lit(""))
    name = X.strip(F.regexp_replace(F.regexp_replace(name, "[-*]", ""), f"[{X.WS}]+", " "))
    lines = F.transform(F.split(F.coalesce(t, F.lit("")), X.LINE_BREAK), X.strip)
    sizes = F.transform(F.split(F.regexp_extract(t, X.SIZE, 1), "/"), lambda n: X.strip(n).try_cast("double"))
    price = F.replace(F.regexp_extract(t, X.PRICE, 1), F.lit(","), F.lit("")).try_cast("double")
    fill = F.coalesce(
        F.regexp_extract(t, X.FILL, 1).try_cast("double"), F.regexp_extract(t, X.FILL_ML, 1).try_cast("double") * 2
    )
    pairs = [
        (X.clean_item_name(t), name),
        (X.lines(t), F.filter(lines, lambda x: x != "")),
        (X.size_ml(t), F.array_max(sizes)),
        (X.price_usd(t), price),
        (X.fill_percent(t, F.lit(50.0)), fill),
        (X.without_emoji(t), F.regexp_replace(t, X.EMOJI, "")),
        (X.is_struck(t), t.rlike(X.STRUCK)),
    ]
    texts = spark.createDataFrame(rows, "t string")
    wrong = [F.count(F.when(~got.eqNullSafe(plain), t)).alias(f"c{i}") for i, (got, plain) in enumerate(pairs)]
    assert list(texts.agg(*wrong).first()) == [0] * len(pairs)
