"""Search through postings against search by scan."""

import random

import pytest

from pricewake import schemas
from pricewake.plans import browse
from pricewake.plans.grams import GramIndex


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(8)
    words = ["AVENTUS", "SAUVAGE", "OUD WOOD", "É", "BLEU 50%", "", "a_b", "aa", "AVENT"]
    rows = [
        (rng.choice([None, "CREED", "Dior", "x_y"]), f"{rng.choice(words)} {rng.choice(words)} {i}", None, 90.0, None, 0.5,
         float(i), 1.0, 5, rng.choice([None, -5.0, float("nan"), float(i)]))
        for i in range(200)
    ]
    return spark.createDataFrame(rows, schemas.MARKET_INDEX)


TERMS = ["", "a", "A", "av", "aven", "Aventus", "oud w", "é", "50%", "_", "zzz", "dior", "creed", " 1", "aaa", "us sau", "x_y"]


def test_like_the_scan(spark, tmp_path, index):
    found = GramIndex(spark, str(tmp_path / "grams")).build(index)
    for term in TERMS:
        assert found.search(term).collect() == browse.search(index, term).collect(), term
        assert found.suggest_brands(term).collect() == browse.suggest_brands(index, term).collect(), term
        assert found.suggest_names(term).collect() == browse.suggest_names(index, term).collect(), term


def test_postings_are_read_and_not_the_rows(spark, tmp_path, index):
    found = GramIndex(spark, str(tmp_path / "grams")).build(index)
    hits = found.search("Aventus 17")
    assert "EqualTo(gram," in hits._jdf.queryExecution().executedPlan().toString()
    assert all("/postings/" in file for file in hits.inputFiles())
    # The rarest gram leaves few rows to verify.
    assert found.candidates("Aventus 17").count() < 30 < index.count()
    empty = GramIndex(spark, str(tmp_path / "none")).build(index.limit(0))
    assert empty.search("a").count() == 0 and empty.search("").count() == 0
