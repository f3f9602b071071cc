import math
import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricewake import schemas
from pricewake.functions import pricing as P
from pricewake.operators import alerts as A
from pricewake.operators import cleaning as C
from pricewake.operators import keyed, pages, similarity, stats
from pricewake.operators.containment import contains_join
from pricewake.plans import browse, market


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


@pytest.mark.parametrize(
    "flair, weight",
    [
        (None, 1.0), ("MODERATOR", 0.0), ("Legacy:0/Buys:1/Sales:0", 0.0), ("Sales:15", 225.0),
        ("Sales:16", 450 * math.log(16) - 993), ("Sales:327", 450 * math.log(327) - 993),
    ],
)
def test_seller_weight(spark, flair, weight):
    got = one(spark, P.seller_weight(F.lit(flair).cast("string")))
    assert got == pytest.approx(weight, rel=1e-12)


def test_weight_grows_with_sales(spark):
    rows = spark.range(0, 400).select(P.weight_of_sales(F.col("id").cast("double")).alias("w"))
    weights = [r.w for r in rows.collect()]
    assert weights == sorted(weights)


@pytest.mark.parametrize(
    "price, fill, expected",
    [(50.0, 50.0, 100.0), (50.0, None, 50.0), (50.0, 0.0, None), (50.0, -5.0, None),
     (50.0, 150.0, 50.0), (None, 50.0, None), (50.0, math.nan, 50.0)],
)
def test_full_bottle_price(spark, price, fill, expected):
    lit = [F.lit(v).cast("double") for v in (price, fill)]
    assert one(spark, P.full_bottle_price(*lit)) == expected


def test_display_figures(spark):
    d = F.lit
    assert one(spark, P.volatility(d(100.0), d(10.0))) == 50.0
    assert one(spark, P.volatility(d(1.0), d(10.0))) == 100.0
    assert one(spark, P.volatility(d(0.0), d(0.1))) == 50.0
    assert one(spark, P.volatility(d(None).cast("double"), d(None).cast("double"))) == 0.0
    assert one(spark, P.deal_badge(d(10.0), d(-1.0))) == "DEAL"
    assert one(spark, P.deal_badge(d(10.0), d(1.0))) == "HIGH"
    assert one(spark, P.deal_badge(d(0.0), d(1.0))) is None
    assert one(spark, P.deal_badge(d(10.0), d(0.0))) is None
    assert one(spark, P.quote_text(P.target_quote(d(100.0), d(10.0), 0.3))) == "97.00"
    assert one(spark, P.quote_text(P.target_quote(d(100.0), d(0.0), 0.3))) == "N/A"


def test_weighted_moments_against_two_passes(spark):
    rng = np.random.default_rng(7)
    rows = []
    for key, base, spread in (
        ("close", 1e6, 1e-3), ("wide", 10.0, 500.0), ("same", 123.456, 0.0), ("tiny", 1e-9, 1e-9)
    ):
        rows += [
            (key, float(base + abs(spread * rng.standard_normal())), float(rng.uniform(0.5, 2000)))
            for _ in range(3000)
        ]
    rows += [("signs", v, 1.0) for v in (-3.0, 0.0, 5.0)]
    df = spark.createDataFrame(rows, "k string, normalized_price double, weight double")
    for r in stats.weighted_moments(df.repartition(7), ["k"]).collect():
        x = np.array([v for k, v, _ in rows if k == r.k])
        w = np.array([v for k, _, v in rows if k == r.k])
        mean = np.average(x, weights=w)
        std = math.sqrt(np.average((x - mean) ** 2, weights=w))
        assert r.weighted_avg_price == pytest.approx(mean, rel=1e-12)
        assert r.weighted_std_dev == pytest.approx(std, rel=1e-6, abs=1e-6 * abs(mean))
        assert x.min() - 1e-9 <= r.weighted_avg_price <= x.max() * (1 + 1e-12) + 1e-9
        assert r.listing_count == len(x)


def test_plain_stats_keeps_unpriced_groups(spark):
    rows = spark.createDataFrame(
        [("A", "X", 1.0), ("A", "X", 3.0), ("A", "Y", None), ("A", "Z", 2.0), (None, "X", 9.0)],
        "brand string, clean_name string, price double",
    )
    got = {r.clean_name: r for r in stats.plain_stats(rows).collect()}
    assert got["X"].reddit_avg_price == 2.0 and got["X"].reddit_std == pytest.approx(math.sqrt(2))
    assert (got["Y"].reddit_avg_price, got["Y"].reddit_count) == (None, 0)
    assert got["Z"].reddit_std is None and len(got) == 3


def test_full_bottles(spark):
    rows = spark.createDataFrame(
        [
            (" a ", " N (x) ", "50", "10", "95"), ("a", "n DECANT", "50", "10", "95"),
            ("a", "small", "28.9", "10", "95"), ("a", "low", "50", "10", "89"),
            ("a", "open", None, "bad", "?"), ("a", None, "50", "1", None),
        ],
        "brand string, frag_name string, size string, price string, fill_percent string",
    )
    got = {(r.brand, r.clean_name, r.size, r.price) for r in C.full_bottles(rows).collect()}
    assert got == {("A", "N", 50.0, 10.0), ("A", "OPEN", None, None), ("A", None, 50.0, 1.0)}


# ---- keyed rows ---------------------------------------------------------------------


def test_first_and_latest(spark):
    rows = spark.createDataFrame(
        [("a", 1, "x"), ("a", 2, None), ("b", 5, "y")], "k string, o int, v string"
    )
    assert {tuple(r) for r in keyed.first_by(rows, ["k"], F.col("o")).collect()} == {
        ("a", 1, "x"), ("b", 5, "y"),
    }
    assert {tuple(r) for r in keyed.latest_by(rows, ["k"], F.col("o")).collect()} == {
        ("a", 2, None), ("b", 5, "y"),
    }


def test_merge(spark):
    old = spark.createDataFrame(
        [("a", 1, "keep", 10), ("b", 2, "keep", 20), ("c", 3, "keep", 30)],
        "k string, v int, own string, born int",
    )
    new = spark.createDataFrame(
        [("a", None, 99, 1), ("b", 2, 99, 1), ("d", 4, 98, 1), ("d", 5, 99, 2)],
        "k string, v int, born int, o int",
    )
    merged = keyed.merge_by_key(
        old, new.drop("o"), ["k"], ["born"], [F.col("v")]
    ).collect()
    assert {tuple(r) for r in merged} == {
        ("a", None, "keep", 10, "modified"), ("b", 2, "keep", 20, "matched"),
        ("c", 3, "keep", 30, "kept"), ("d", 5, None, 98, "inserted"),
    }


# ---- similarity ------------------------------------------------------------------------


def brute(names, products, order, min_score):
    out = []
    for i, a in enumerate(names):
        best, at = 0, None
        for j in sorted(range(len(products)), key=lambda j: order[j]):
            score = SequenceMatcher(None, a, products[j]).ratio()
            if score > best:
                best, at = score, j
        if at is not None and best > min_score:
            out.append((i, at, best))
    return out


words = st.lists(st.text("ABCD É2", max_size=9), min_size=1, max_size=12, unique=True)


@settings(max_examples=150, deadline=None)
@given(words, words, st.sampled_from([0.0, 0.4, 0.7]), st.randoms())
def test_best_in_cell_like_brute_force(names, products, min_score, rng):
    order = list(range(len(products)))
    rng.shuffle(order)
    assert similarity.best_in_cell(names, products, order, min_score) == brute(
        names, products, order, min_score
    )


def test_long_titles_like_brute_force():
    rng = random.Random(3)
    names = ["".join(rng.choice("abcdef ") for _ in range(n)) for n in (5, 60, 190, 240)]
    products = [n[: len(n) // 2] + x for n in names for x in ("", "zz" * 60, n)]
    order = list(range(len(products)))
    assert similarity.best_in_cell(names, products, order, 0.4) == brute(
        names, products, order, 0.4
    )


def test_grid_of_one_hot_brand(spark):
    rng = random.Random(5)
    def title():
        return " ".join(rng.choice(["OUD", "ROSE", "NOIR", "X", "EDP"]) for _ in range(3))

    names = sorted({title() for _ in range(60)})
    products = sorted({title() + " SPRAY" for _ in range(60)})
    n = spark.createDataFrame([("B", x) for x in names] + [(None, "Q")], "brand string, clean_name string")
    p = spark.createDataFrame(
        [("B", x, i) for i, x in enumerate(products)] + [("C", "Q", 1)],
        "brand string, product string, ord int",
    )
    expected = {
        (names[i], products[j], s)
        for i, j, s in brute(names, products, range(len(products)), 0.4)
    }
    for size in (1000, 7):
        got = similarity.best_matches(n, p, slice_size=size).collect()
        assert {(r.clean_name, r.product, r.match_score) for r in got} == expected


def test_known_score(spark):
    n = spark.createDataFrame([("CREED", "AVENTUS")], "brand string, clean_name string")
    p = spark.createDataFrame(
        [("CREED", "CREED AVENTUS EDP SPRAY 3.4 OZ", "a")],
        "brand string, product string, ord string",
    )
    assert similarity.best_matches(n, p).count() == 0
    score = similarity.best_matches(n, p, min_score=0.3).first().match_score
    assert round(score, 3) == 0.378


# ---- containment -------------------------------------------------------------------------


def test_containment_like_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["a", "ab", "abc", "bc", "hot", "hotel", "x" * 30, "x" * 30 + "y", "7", "sad"]
    texts = [
        (i, ("hot " if i % 3 else "") + " ".join(rng.choice(vocabulary) for _ in range(4))
         + ("  " if i % 5 == 0 else "") + " end")
        for i in range(120)
    ] + [(998, ""), (999, "hot")]
    targets = {""}
    for _, text in texts:
        for _ in range(4):
            at = rng.randrange(max(1, len(text)))
            targets.add(" ".join(text[at : at + rng.randrange(1, 25)].split()))
    targets |= {"nothing", "hot hot", "zz top", "x" * 29, "x" * 31}
    df = spark.createDataFrame(texts, "id int, haystack string")
    wanted = spark.createDataFrame([(t,) for t in sorted(targets)], "target string")
    expected = {(i, t) for i, text in texts for t in targets if t and t in text}
    for cell in (200_000, 3):
        got = [(r.id, r.target) for r in contains_join(df, wanted, rows_per_cell=cell).collect()]
        assert len(got) == len(set(got)) and set(got) == expected


def test_containment_has_no_pairwise_plan(spark):
    df = spark.createDataFrame([(1, "a b")], "id int, haystack string")
    wanted = spark.createDataFrame([("a",)], "target string")
    plan = contains_join(df, wanted)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_containment_of_equal_texts_is_dealt_out(spark):
    """Ten thousand copies of one text: 10 cells of about a thousand rows, no text below the exchange."""
    df = spark.range(10_000).selectExpr("id", "'creed aventus 100ml' AS haystack")
    wanted = spark.createDataFrame([("aventus 100",), ("creed",)], "target string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = contains_join(df, wanted, rows_per_cell=1000)
        assert found.count() == 20_000
        explain = spark.sparkContext._jvm.PythonSQLUtils.explainString
        plan = explain(found._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = re.findall(r"\) Exchange\nInput \[\d+\]: (.*)\nArguments: hashpartitioning\(.*cell", plan)
    assert dealt and not any("haystack" in columns or "_words" in columns for columns in dealt)
    cells = spark.range(10_000).selectExpr("pmod(xxhash64(id), 10) AS cell").groupBy("cell").count()
    assert max(r["count"] for r in cells.collect()) < 1200


# ---- alerts ----------------------------------------------------------------------------------


# The search form of every text below, written out.
PLAIN = {
    None: "", "": "", "!!": "", "Creed": "creed", "Dior": "dior", "Aventus (F0)": "aventus f0",
    "Aventus": "aventus", "aventus": "aventus", "Green Irish Tweed": "green irish tweed",
    "Sauvage": "sauvage", "sauvage": "sauvage", "Creed Aventus 100ml": "creed aventus 100ml",
    "git": "git", "[WTS] x": "wts x", "aventus in title": "aventus in title", "AVENTUS": "aventus",
    "AVENTUS CLONE": "aventus clone", "SAUVAGE": "sauvage",
    "GREEN IRISH TWEED": "green irish tweed", "creed aventus": "creed aventus",
    "unknown thing": "unknown thing", "irish": "irish",
}


LISTINGS = [
    ("k0", "Creed", "Aventus (F0)", 150.0, "u0", "Creed Aventus 100ml", "[WTS] x"),
    ("k1", "Creed", "Aventus", 400.0, "u1", None, None),
    ("k2", None, "Green Irish Tweed", None, "u2", "git", "aventus in title"),
    ("k3", "Dior", "Sauvage", 60.0, "u3", "Sauvage", ""),
]
INDEX = [
    ("CREED", "AVENTUS", 200.0, 20.0), ("ARMAF", "AVENTUS CLONE", 30.0, 5.0),
    ("DIOR", "SAUVAGE", None, None), (None, "GREEN IRISH TWEED", 100.0, 0.0),
]
ALERTS = [
    ("1", "a@x", "DEAL", "Aventus", 1.0, True), ("2", "b@x", "deal", "aventus", None, None),
    ("3", "c@x", "RARE", "creed aventus", None, True), ("4", "d@x", "DEAL", "sauvage", 1.0, True),
    ("5", "e@x", "DEAL", "unknown thing", 1.0, True), ("6", "f@x", "RARE", "!!", None, True),
    ("7", "g@x", "OTHER", "aventus", None, True), ("8", "h@x", "RARE", "aventus", None, False),
    ("9", "i@x", "RARE", "irish", None, True), ("10", "j@x", "DEAL", "", None, True),
]


def alert_frames(spark):
    listings = spark.createDataFrame(
        LISTINGS,
        "listing_key string, brand string, frag_name string, price_usd double, post_url string, "
        "raw_text string, post_title string",
    )
    index = spark.createDataFrame(
        INDEX,
        "brand string, reddit_name string, weighted_avg_price double, weighted_std_dev double",
    )
    alerts = spark.createDataFrame(
        ALERTS,
        "alert_id string, email string, type string, target_name string, threshold double, "
        "active boolean",
    )
    return listings, index, alerts


def expected_events():
    ordered = sorted(INDEX, key=lambda r: (r[0] or "", r[1]))
    out = {}
    for alert_id, _, kind, target, threshold, active in ALERTS:
        if active is False:
            continue
        price = None
        if kind.upper() == "DEAL":
            base = next((r for r in ordered if PLAIN[target] in PLAIN[r[1]]), None)
            if base is None or base[2] is None:
                continue
            price = base[2] - (threshold or 0) * base[3]
        for key, brand, name, usd, _, raw, title in LISTINGS:
            hay = " ".join(PLAIN[x] for x in (brand, name, raw, title))
            if not PLAIN[target] or PLAIN[target] not in hay:
                continue
            if kind.upper() == "DEAL" and (usd is None or usd > price):
                continue
            if kind.upper() not in ("DEAL", "RARE"):
                continue
            out[f"{alert_id}:{key}"] = price
    return out


def test_alert_matches_like_brute_force(spark):
    listings, index, alerts = alert_frames(spark)
    priced = A.priced_alerts(alerts, index)
    found = A.match_alerts(listings, priced)
    events = {r.event_key: r for r in A.events(found, "2024-01-02").collect()}
    assert set(events) == set(expected_events())
    assert "3:k0" in events and "9:k2" in events
    skipped = {r.alert_id: r.skipped for r in priced.collect() if r.skipped}
    assert skipped == {"4": "missing stats", "5": "no baseline"}
    summary = A.run_summary(priced, found).first()
    assert tuple(summary) == (9, 1, 1, len(events))
    # Of all names that contain the target the first by brand and name is the baseline.
    prices = {r.alert_id: r.target_price for r in priced.collect()}
    assert prices["1"] == 25.0 and prices["2"] == 30.0


def test_reason_and_messages(spark):
    matches = spark.createDataFrame(
        [
            ("k", ("Creed", 'A<"b">&', 100.0, "u", "raw <i>"), "1", "a@x", "DEAL", "t", 120.5),
            ("l", (None, "", None, "u", None), "2", "b@x", "RARE", "target", None),
        ],
        "listing_key string, listing struct<brand: string, frag_name: string, price_usd: double, "
        "post_url: string, raw_text: string>, alert_id string, email string, alert_type string, "
        "target_name string, target_price double",
    )
    events = A.events(matches, "2024-01-02").withColumn("notified_at", F.lit(None).cast("timestamp"))
    mails = {r.idempotency_key: r for r in A.outbox(A.pending_events(events)).collect()}
    first, second = mails["1:k"], mails["2:l"]
    assert "asked $100.00, wanted at most $120.50" in first.text
    assert first.subject == 'Market price alert: Creed A<"b">&' and first.price_text == "$100.00"
    assert ">Creed A&lt;&quot;b&quot;&gt;&amp;</a>" in first.html
    assert "raw &lt;i&gt;" in first.html
    assert (second.display_name, second.price_text) == ("target", "price unknown")


def test_intake(spark):
    asked = spark.createDataFrame(
        [("a@x", "DEAL", "t", 1.0)] * 2 + [(None, "DEAL", "t", 1.0), ("a@x", None, "t", None)],
        "email string, type string, target_name string, threshold double",
    )
    new = A.new_alerts(asked, "2024-01-02").collect()
    # Equal requests are alerts of their own.
    assert len(new) == 2 and len({r.alert_id for r in new}) == 2 and all(r.active for r in new)
    numbered = asked.withColumn("request_id", F.monotonically_increasing_id())
    ids = [{r.alert_id for r in A.new_alerts(numbered, "2024-01-02").collect()} for _ in range(2)]
    assert ids[0] == ids[1] and len(ids[0]) == 2
    assert A.split_intake(asked)[1].count() == 2


# ---- index ---------------------------------------------------------------------------------------


def index_frame(spark):
    return spark.createDataFrame(
        [
            ("CREED", "AVENTUS", None, 250.0, None, 0.5, 200.0, 20.0, 3, -50.0),
            ("ARMAF", "CLUB", None, 30.0, None, 0.5, 35.0, 0.0, 3, 5.0),
            ("CREED", "GIT", None, 99.0, None, 0.5, None, None, None, None),
            (None, "NAN", None, 99.0, None, 0.5, 1.0, 1.0, 1, math.nan),
            ("ZARA", "AVENTUS", None, 1.0, None, 0.5, 1.0, 1.0, 1, 0.0),
        ],
        schemas.MARKET_INDEX,
    )


def test_browse(spark):
    index = index_frame(spark)
    assert [r.reddit_name for r in browse.listing(index).collect()] == [
        "GIT", "NAN", "AVENTUS", "AVENTUS", "CLUB",
    ]
    assert [r.brand for r in browse.search(index, "aven").collect()] == ["CREED", "ZARA"]
    assert browse.search(index, "").count() == 5
    assert [r.brand for r in browse.suggest_brands(index, "r").collect()] == [
        "CREED", "ZARA", "ARMAF",
    ]
    assert [r.reddit_name for r in browse.suggest_names(index, "a").collect()] == [
        "NAN", "AVENTUS", "AVENTUS",
    ]
    assert [r.reddit_name for r in browse.trending(index, 2).collect()] == ["GIT", "NAN"]
    shown = {(r.brand, r.reddit_name): r for r in browse.display(index, 1.0).collect()}
    assert shown["CREED", "AVENTUS"].quote_text == "180.00"
    assert shown["CREED", "AVENTUS"].badge == "DEAL"
    assert shown["CREED", "GIT"].quote_text == "N/A"


def test_publish(spark, tmp_path):
    table = market.index_table(spark, str(tmp_path / "index"))
    index = index_frame(spark)
    assert market.publish(table, index) == 4
    assert market.publish(table, index) == 0
    changed = index.withColumn("match_score", F.lit(0.9)).filter("reddit_name = 'GIT'")
    assert market.publish(table, changed) == 1
    rows = {r.reddit_name: r for r in table.read().collect()}
    assert rows["AVENTUS"].brand == "ZARA" and rows["GIT"].match_score == 0.9
    assert rows["NAN"].weighted_price_diff is None


# ---- pages ---------------------------------------------------------------------------------------


PAGE = """
<html><head><style>p{}</style></head><body>
<h1 id="product-h1-product-name"> Vibrato <b>EDP</b> &amp; co </h1><br>
<span class="a brand-name x">Sospiro</span>
<div class="child-products-container">
 <a class="child-product" href="/v1"><span class="item-size">1 oz</span><i class="item-price">$1</i></a>
 <a href="http://h/v2" class="x child-product selected"><span class="item-size">3.4 oz</span>
  <i class="item-price">$2</i></a>
 <a class="child-products" href="/no">no</a>
</div>
<div class="now-price"><img src=x><span>$3</span></div>
<div class="retail-wrapper"><span class="retail-label">Retail:</span><span>$9.00</span></div>
</body></html>
"""


def test_page_fields():
    fields = pages.page_fields(PAGE)
    assert fields == {
        "product": "Vibrato EDP & co", "brand": "Sospiro", "size": "3.4 oz",
        "discount_price": "$2", "retail_price": "$9.00", "has_header": True, "has_brand": True,
    }
    plain = PAGE.replace("selected", "").replace("item-price", "other")
    assert pages.page_fields(plain)["size"] == "1 oz"
    assert pages.page_fields(plain)["discount_price"] == "$3"
    assert pages.page_fields(plain.replace("now-price", "q"))["discount_price"] == ""
    assert pages.page_fields(None)["has_header"] is False
    assert pages.page_fields("<p><b>x</p></i><span class='brand-name'>B</span>")["brand"] == "B"


def test_retail_rows(spark):
    captured = spark.createDataFrame(
        [("u1", PAGE), ("u1", PAGE), ("u2", PAGE.replace("brand-name", "x")), ("u3", "<p>"),
         ("u4", None)],
        "url string, html string",
    )
    products = pages.read_products(captured)
    assert [r.url for r in pages.retail_rows(products).collect()] == ["u1"]
    assert {r.url for r in pages.retail_rows(products, lenient=True).collect()} == {"u1", "u2"}
    rejected = {r.url: r.reason for r in pages.rejected_pages(products).collect()}
    assert rejected == {"u2": "no brand", "u3": "no header", "u4": "no header"}
    urls = pages.variant_urls(captured.limit(1)).orderBy("pos").collect()
    assert [r.variant_url for r in urls] == ["https://www.jomashop.com/v1", "http://h/v2"]
    alone = pages.variant_urls(captured.filter("url = 'u3'")).collect()
    assert [r.variant_url for r in alone] == ["u3"]


def test_product_links(spark):
    html = """<ul><li class="productItem big"><a class="other" href="/0">x</a>
      <a class="productName-link" href="/b"></a><a class="productImg-link" href='/a'></a></li>
      <li class="productItem"><a href="/c" class="x itemLink"></a></li>
      <li class="productItemX"><a class="itemLink" href="/d"></a></li>
      <li class="productItem"><a class="itemLink" href=""></a></li></ul>"""
    df = spark.createDataFrame([(2, html), (1, html)], "page int, html string")
    links = pages.product_links(df, "page")
    assert [r.link for r in links.filter("page = 1").orderBy("pos").collect()] == ["/a", "/c"]
    first = pages.first_seen_links(links, "page").collect()
    assert {(r.link, r.page) for r in first} == {("/a", 1), ("/c", 1)}
