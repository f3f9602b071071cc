"""Statistics kept as sums, against statistics of all rows."""

import random

import pytest

from pricewake import schemas
from pricewake.operators import stats
from pricewake.operators.keyed import changed_rows
from pricewake.plans import market

NAMES = "listing_key int, flair string, frag_name string, price double, fill_percent double"


def row(rng, key):
    flair = rng.choice([None, "Sales:3", "Sales:40", "Sales:0"])
    return (key, flair, rng.choice("ab"), rng.choice([None, 1e-3, 5.0, 5.01, 80.0, 3e6]), rng.choice([None, 50.0, 100.0]))


def test_batches_of_changes_like_all_rows(spark, tmp_path):
    rng = random.Random(3)
    state = {}
    moments = market.moments_table(spark, str(tmp_path / "moments"))
    for _ in range(5):
        keys = rng.sample(range(40), 12)
        old = [state[k] for k in keys if k in state]
        for k in keys:
            state[k] = row(rng, k)
        for k in keys[:4]:
            del state[k]
        new = [state[k] for k in keys if k in state]
        market.apply_changes(moments, spark.createDataFrame(old, NAMES), spark.createDataFrame(new, NAMES))
    want = stats.weighted_stats(spark.createDataFrame(list(state.values()), NAMES)).collect()
    got = {r.frag_name: r for r in market.maintained_stats(moments).collect()}
    assert set(got) == {r.frag_name for r in want}
    for r in want:
        g = got[r.frag_name]
        assert g.listing_count == r.listing_count
        assert g.weighted_avg_price == pytest.approx(r.weighted_avg_price, rel=1e-9)
        assert g.weighted_std_dev == pytest.approx(r.weighted_std_dev, rel=1e-6, abs=1e-6)


def test_empty_cells_and_repeated_states(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Sales:3", "a", 0.1, None), (2, "Sales:40", "a", 0.3, None)], NAMES)
    moments = market.moments_table(spark, str(tmp_path / "moments"))
    none = rows.limit(0)
    assert market.apply_changes(moments, none, rows).count() == 1
    version = moments.version()
    # Rows that are as they were touch nothing.
    assert market.apply_changes(moments, rows, rows).count() == 0 and moments.version() == version
    market.apply_changes(moments, rows, none)
    assert market.maintained_stats(moments).count() == 0
    market.apply_changes(moments, none, rows)
    once = stats.weighted_stats(rows).first()
    assert market.maintained_stats(moments).first() == once


def test_only_touched_items_are_published(spark, tmp_path):
    rows = [(1, "Sales:3", "a", 10.0, None), (2, "Sales:3", "b", 20.0, None)]
    listings = spark.createDataFrame(rows, NAMES)
    matched = spark.createDataFrame(
        [("X", "A", "A ONE", 0.9, 10.0, 1, 50.0, "u", 40.0), ("X", "B", "B ONE", 0.9, 10.0, 1, 50.0, "u", 40.0)],
        "brand string, reddit_name string, jomashop_name string, match_score double, reddit_avg double, "
        "reddit_count long, jomashop_price double, jomashop_url string, price_diff double",
    )
    moments = market.moments_table(spark, str(tmp_path / "moments"))
    index = market.index_table(spark, str(tmp_path / "index"))
    items = market.apply_changes(moments, listings.limit(0), listings)
    assert market.refresh_index(index, matched, moments, items) == 2
    edited = spark.createDataFrame([(2, "Sales:3", "b", 30.0, None)], NAMES)
    items = market.apply_changes(moments, listings.filter("listing_key = 2"), edited)
    assert [r.frag_name for r in items.collect()] == ["B"]
    assert market.refresh_index(index, matched, moments, items) == 1
    got = {r.reddit_name: r.weighted_avg_price for r in index.read().collect()}
    assert got == {"A": 10.0, "B": 30.0} and index.read().columns == schemas.MARKET_INDEX.names
    # Publishing what is there already writes nothing and keeps the version.
    version = index.version()
    assert market.publish(index, index.read()) == 0 and index.version() == version


def test_changed_rows_of_many_states_share_one_shuffle(spark):
    rows = [(i, None if i % 7 == 0 else i % 5, i % 3) for i in range(500)]
    table = spark.createDataFrame(rows, "k int, v int, w int").repartition("k")
    states = [
        table.selectExpr("k", f"CASE WHEN w = {n} THEN v + {n} ELSE v END AS v", f"w <> {n} AND k <> 9 AS there") for n in (0, 1, 2)
    ]
    found = [changed_rows(a, b, ["k"], "there") for a, b in zip(states, states[1:])]

    def held(n):
        return {k: v + n if w == n and v is not None else v for k, v, w in rows if w != n and k != 9}

    for n, changed in enumerate(found):
        got = {r.k: (r.before and r.before.v, r.after and r.after.v, r.before is None, r.after is None) for r in changed.collect()}
        a, b = held(n), held(n + 1)
        want = {k: (a.get(k), b.get(k), k not in a, k not in b) for k in {*a, *b} if (k in a, a.get(k)) != (k in b, b.get(k))}
        assert got == want and got
    both = found[0].unionByName(found[1])
    both.collect()
    plan = both._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 3


def test_the_steps_read_the_listings_once(spark, monkeypatch):
    from pricewake.catalog import inputs, market_queries

    calls = []
    real = inputs.listings
    monkeypatch.setattr(inputs, "listings", lambda *a: calls.append(1) or real(*a))
    before = []
    written = market_queries.written
    monkeypatch.setattr(market_queries, "written", lambda df, name: before.append(name) or written(df, name))
    assert market_queries.maintained_moments(spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 1 and before[0] == "listings"
