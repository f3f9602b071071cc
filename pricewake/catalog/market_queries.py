"""Queries over cleaned listings, market statistics, matches and the index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewake.catalog import inputs as I
from pricewake.catalog import sqltext as S
from pricewake.functions.text import market_name
from pricewake.operators import cleaning as C
from pricewake.operators import similarity, stats
from pricewake.operators.keyed import changed_rows, first_by
from pricewake.plans import browse, grams, market
from pricewake.session import scratch_path, written

DIGITS = 4


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


# ---- cleaning ------------------------------------------------------------------


def number_coercion(spark, sf):
    """Prices, fills and sizes written as text, some of them no numbers."""
    raw = I.table(spark, sf, "lineitem").selectExpr(f"{I.KEY} AS listing_key", *_TEXT_NUMBERS)
    return C.coerce_numbers(raw, "price", "size", "fill_percent")


_TEXT_NUMBERS = [
    "CASE WHEN l_linestatus = 'F' THEN ' ' || CAST(l_quantity AS VARCHAR(30)) || '  ' "
    "ELSE l_returnflag END AS price",
    "CASE WHEN l_discount = 0 THEN 'nan' WHEN l_tax = 0 THEN '12d' "
    "ELSE CAST(l_linenumber AS VARCHAR(30)) END AS size",
    "CASE WHEN l_tax = 0.08 THEN '1,5' WHEN l_tax = 0.01 THEN '-.5e1' "
    "ELSE CAST(l_discount AS VARCHAR(30)) END AS fill_percent",
]
NUMBER_COERCION = f"""
WITH raw AS (SELECT {I.KEY} AS listing_key, {", ".join(_TEXT_NUMBERS)} FROM lineitem)
SELECT listing_key, {S.number("price")} AS price, {S.number("size")} AS size,
  {S.number("fill_percent")} AS fill_percent
FROM raw
"""


def string_trim(spark, sf):
    raw = I.table(spark, sf, "customer").selectExpr(
        "c_custkey",
        "char(9) || c_name || ' ' || char(160) AS c_name",
        "'  ' || c_mktsegment || char(10) AS c_mktsegment",
        "c_acctbal",
    )
    return C.strip_strings(raw)


STRING_TRIM = "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer"


def rows_dedup(spark, sf):
    """Exact copies: each order twice, reduced to three columns."""
    orders = I.table(spark, sf, "orders").selectExpr(
        "' ' || o_orderstatus AS status", "o_orderpriority", "o_custkey"
    )
    return C.tidy_rows(orders.unionByName(orders))


ROWS_DEDUP = """
SELECT DISTINCT upper(o_orderstatus) AS status, o_orderpriority, o_custkey FROM orders
"""


def status_domain(spark, sf):
    rows = I.listings(spark, sf).selectExpr("listing_key", "' ' || status || ' ' AS status")
    return C.tidy_rows(rows)


STATUS_DOMAIN = f"""
WITH {I.LISTINGS_SQL}
SELECT listing_key, nullif(upper(status), '') AS status FROM listings
"""

_GAPS = {
    "listing_key": "listing_key",
    "frag_name": "CASE WHEN size = 7 THEN NULL ELSE frag_name || ' [x] #' END",
    "size": "CASE WHEN fill_percent = 100 THEN NULL ELSE size END",
    "price": "CASE WHEN status = 'SOLD' THEN NULL ELSE price END",
}


def _gaps(spark, sf):
    return I.listings(spark, sf).selectExpr(*[f"{sql} AS {n}" for n, sql in _GAPS.items()])


_GAPS_SQL = f"{I.LISTINGS_SQL}, gaps AS (SELECT {I._columns(_GAPS)} FROM listings)"


def required_fields(spark, sf):
    return C.required_rows(_gaps(spark, sf))


REQUIRED_FIELDS = f"""
WITH {_GAPS_SQL}
SELECT listing_key, {S.plain_name("frag_name")} AS frag_name, size, price
FROM gaps WHERE frag_name IS NOT NULL AND size IS NOT NULL AND price IS NOT NULL
"""


def price_or_size(spark, sf):
    rows = _gaps(spark, sf).withColumns(
        {
            "brand": F.lit(" b "),
            "status": F.lit(" s"),
            "frag_name": F.concat("frag_name", F.lit("\t")),
        }
    )
    return C.has_price_or_size(rows)


PRICE_OR_SIZE = f"""
WITH {_GAPS_SQL}
SELECT listing_key, frag_name, size, price, 'b' AS brand, 's' AS status
FROM gaps WHERE size IS NOT NULL OR price IS NOT NULL
"""


def full_bottles(spark, sf):
    return C.full_bottles(I.listings(spark, sf)).select(
        "listing_key", "brand", "frag_name", "clean_name", "size", "price", "fill_percent"
    )


FULL_BOTTLES_SQL = f"""
full_bottles AS (
  SELECT listing_key, upper({S.strip("brand")}) AS brand, {S.strip("frag_name")} AS frag_name,
    {S.market_name("frag_name")} AS clean_name, size, price, fill_percent
  FROM listings
  WHERE (fill_percent >= 90 OR fill_percent IS NULL) AND (size >= 29 OR size IS NULL)
    AND NOT coalesce(contains(lower(frag_name), 'decant'), false))
"""
FULL_BOTTLES = f"""
WITH {I.LISTINGS_SQL}, {FULL_BOTTLES_SQL}
SELECT * FROM full_bottles
"""


def retail_clean(spark, sf):
    return C.clean_retail(I.retail(spark, sf)).select(
        "url", "brand", "product", "discount_price", "price", "extracted_size"
    )


RETAIL_CLEAN_SQL = f"""
catalogue AS (
  SELECT url, ord, upper({S.strip("brand")}) AS brand, upper({S.strip("product")}) AS product,
    translate(discount_price, '$,', '') AS discount_price,
    {S.number("translate(discount_price, '$,', '')")} AS price
  FROM retail)
"""
RETAIL_CLEAN = f"""
WITH {I.RETAIL_SQL}, {RETAIL_CLEAN_SQL}
SELECT url, brand, product, discount_price, price, {S.retail_size("product")} AS extracted_size
FROM catalogue
"""

# ---- statistics ------------------------------------------------------------------


def plain_stats(spark, sf):
    rows = stats.plain_stats(C.full_bottles(I.listings(spark, sf)))
    return _rounded(rows, "reddit_avg_price", "reddit_std")


PLAIN_STATS_SQL = """
plain AS (
  SELECT brand, clean_name, avg(price) AS reddit_avg_price, count(price) AS reddit_count,
    stddev_samp(price) AS reddit_std
  FROM full_bottles GROUP BY brand, clean_name)
"""
PLAIN_STATS = f"""
WITH {I.LISTINGS_SQL}, {FULL_BOTTLES_SQL}, {PLAIN_STATS_SQL}
SELECT brand, clean_name, {S.rounded("reddit_avg_price")} AS reddit_avg_price, reddit_count,
  {S.rounded("reddit_std")} AS reddit_std
FROM plain
"""


def seller_weight(spark, sf):
    rows = stats.weighted_rows(I.listings(spark, sf))
    return rows.groupBy("frag_name", F.round("weight", DIGITS).alias("weight")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("normalized_price").alias("least"),
        F.max("normalized_price").alias("most"),
    )


WEIGHTED_ROWS_SQL = f"""
weighted AS (
  SELECT frag_name, weight, normalized_price FROM (
    SELECT {S.market_name("frag_name")} AS frag_name, {S.seller_weight("flair")} AS weight,
      {S.full_bottle_price("price", "fill_percent")} AS normalized_price
    FROM listings)
  WHERE normalized_price IS NOT NULL AND weight > 0)
"""
SELLER_WEIGHT = f"""
WITH {I.LISTINGS_SQL}, {WEIGHTED_ROWS_SQL}
SELECT frag_name, {S.rounded("weight")} AS weight, count(*) AS rows,
  min(normalized_price) AS least, max(normalized_price) AS most
FROM weighted GROUP BY ALL
"""


def weighted_stats(spark, sf):
    rows = stats.weighted_stats(I.listings(spark, sf))
    return _rounded(rows, "weighted_avg_price", "weighted_std_dev", "total_sales_volume_proxy")


# Two passes over the rows: the mean first, then the squares around it.
WEIGHTED_STATS_SQL = """
means AS (
  SELECT frag_name, sum(weight * normalized_price) / sum(weight) AS mean, count(*) AS n,
    sum(weight) AS w
  FROM weighted GROUP BY frag_name),
weighted_stats AS (
  SELECT frag_name, any_value(mean) AS weighted_avg_price,
    sqrt(sum(weight * (normalized_price - mean) * (normalized_price - mean)) / any_value(w))
      AS weighted_std_dev,
    any_value(n) AS listing_count, any_value(w) AS total_sales_volume_proxy
  FROM weighted JOIN means USING (frag_name) GROUP BY frag_name)
"""
# Listings before, after a first and after a second batch of changes: new ones, edited prices, items, fills and
# sellers, and some that are gone.
_MOMENT_STEPS = {
    0: ("size <> 3", {}),
    1: ("size <> 5", {"price": "price * 1.5", "flair": "CASE WHEN size = 7 THEN 'Sales:9' ELSE flair END"}),
    2: ("size <> 3", {"price": "price * 2", "frag_name": "CASE WHEN size = 7 THEN frag_name || ' X' ELSE frag_name END"}),
}


_STEP_NAMES = ("listing_key", "flair", "frag_name", "price", "fill_percent", "size")


def _step_columns(step):
    changed = _MOMENT_STEPS[step][1]
    return [f"{changed[c]} AS {c}" if c in changed else c for c in _STEP_NAMES]


def maintained_moments(spark, sf):
    """Statistics kept as sums: a start, then two batches of changes; no listing that stayed is read again."""
    # Read by every step: written once, with the columns that the states have.
    listings = written(I.listings(spark, sf).select(*_STEP_NAMES), "listings")
    moments = market.moments_table(spark, scratch_path(spark, "moments"))
    start = listings.filter(_MOMENT_STEPS[0][0]).selectExpr(*_step_columns(0))
    market.apply_changes(moments, start.limit(0), start)
    # All states stand over one shuffle by key, whatever rows they have.
    by_key = listings.repartition("listing_key")
    fields = ("listing_key", "flair", "frag_name", "price", "fill_percent", "there")
    states = [
        by_key.selectExpr(*_step_columns(n), f"{keep} AS there").select(*fields)
        for n, (keep, _) in _MOMENT_STEPS.items()
    ]
    steps = [
        changed_rows(*pair, ["listing_key"], "there").select(F.lit(n).alias("step"), "before", "after")
        for n, pair in enumerate(zip(states, states[1:]))
    ]
    changed = written(reduce(DataFrame.unionByName, steps), "changed")
    for n in range(len(steps)):
        rows = changed.filter(F.col("step") == n)
        market.apply_changes(
            moments,
            rows.filter(F.col("before").isNotNull()).select("before.*"),
            rows.filter(F.col("after").isNotNull()).select("after.*"),
        )
    return _rounded(
        market.maintained_stats(moments), "weighted_avg_price", "weighted_std_dev", "total_sales_volume_proxy"
    )


MAINTAINED_MOMENTS = f"""
WITH {I.LISTINGS_SQL.replace("listings AS", "listings_as_posted AS", 1)},
listings AS (
  SELECT {", ".join(_step_columns(2))} FROM listings_as_posted WHERE {_MOMENT_STEPS[2][0]}),
{WEIGHTED_ROWS_SQL}, {WEIGHTED_STATS_SQL}
SELECT frag_name, {S.rounded("weighted_avg_price")} AS weighted_avg_price,
  {S.rounded("weighted_std_dev")} AS weighted_std_dev, listing_count,
  {S.rounded("total_sales_volume_proxy")} AS total_sales_volume_proxy
FROM weighted_stats
"""

WEIGHTED_STATS = f"""
WITH {I.LISTINGS_SQL}, {WEIGHTED_ROWS_SQL}, {WEIGHTED_STATS_SQL}
SELECT frag_name, {S.rounded("weighted_avg_price")} AS weighted_avg_price,
  {S.rounded("weighted_std_dev")} AS weighted_std_dev, listing_count,
  {S.rounded("total_sales_volume_proxy")} AS total_sales_volume_proxy
FROM weighted_stats
"""

# ---- matches ---------------------------------------------------------------------------


def _retail_match(spark, sf):
    return market.retail_match(I.listings(spark, sf), I.retail(spark, sf))


def fuzzy_match(spark, sf):
    return _rounded(
        _retail_match(spark, sf), "match_score", "reddit_avg", "jomashop_price", "price_diff"
    )


# The score: longest common piece, then the same left and right of it.
MATCH_SQL = """
candidates AS (
  SELECT DISTINCT clean_name AS a, product AS p FROM plain JOIN catalogue USING (brand)),
steps AS (
  SELECT a, p, a AS x, p AS y, CAST(0 AS BIGINT) AS m FROM candidates
  UNION ALL
  SELECT a, p, u.x, u.y, u.m FROM (
    SELECT a, p, unnest([
      {'x': substr(x, 1, instr(x, s) - 1), 'y': substr(y, 1, instr(y, s) - 1), 'm': length(s)},
      {'x': substr(x, instr(x, s) + length(s)), 'y': substr(y, instr(y, s) + length(s)), 'm': 0}
    ]) AS u
    FROM (
      SELECT a, p, x, y, list_filter(
        flatten([[substr(x, i, l) FOR i IN range(1, length(x) - l + 2)]
                 FOR l IN range(length(x), 0, -1)]), lambda t: contains(y, t))[1] AS s
      FROM steps WHERE x <> '' AND y <> '')
    WHERE s IS NOT NULL)),
scores AS (
  SELECT a, p, CAST(2 AS DOUBLE) * sum(m) / (length(a) + length(p)) AS score
  FROM steps GROUP BY a, p),
matched AS (
  SELECT brand, clean_name AS reddit_name, product AS jomashop_name, score AS match_score,
    reddit_avg_price AS reddit_avg, reddit_count, price AS jomashop_price, url AS jomashop_url,
    price - reddit_avg_price AS price_diff
  FROM plain JOIN catalogue USING (brand) JOIN scores ON a = clean_name AND p = product
  WHERE score > 0.4
  QUALIFY row_number() OVER (PARTITION BY brand, clean_name ORDER BY score DESC, ord) = 1)
"""
_MATCH_CHAIN = f"""
WITH RECURSIVE {I.LISTINGS_SQL}, {FULL_BOTTLES_SQL}, {PLAIN_STATS_SQL}, {I.RETAIL_SQL},
{RETAIL_CLEAN_SQL}, {MATCH_SQL}
"""
FUZZY_MATCH = f"""
{_MATCH_CHAIN}
SELECT brand, reddit_name, jomashop_name, {S.rounded("match_score")} AS match_score,
  {S.rounded("reddit_avg")} AS reddit_avg, reddit_count,
  {S.rounded("jomashop_price")} AS jomashop_price, jomashop_url,
  {S.rounded("price_diff")} AS price_diff
FROM matched
"""


def best_scores(spark, sf):
    """Best product per item name when every part is in one brand: one hot block."""
    parts = I.table(spark, sf, "part")
    names = parts.select(F.lit("ALL").alias("brand"), F.upper("p_name").alias("clean_name"))
    products = parts.select(
        F.lit("ALL").alias("brand"),
        F.upper(F.concat_ws(" ", "p_type", "p_name", "p_brand")).alias("product"),
        F.col("p_partkey").alias("ord"),
    )
    best = similarity.best_matches(names.distinct(), products)
    return _rounded(best.drop("brand"), "match_score")


BEST_SCORES = f"""
WITH RECURSIVE plain AS (
  SELECT DISTINCT 'ALL' AS brand, upper(p_name) AS clean_name, 0 AS reddit_avg_price,
    0 AS reddit_count FROM part),
catalogue AS (
  SELECT 'ALL' AS brand, upper(p_type || ' ' || p_name || ' ' || p_brand) AS product,
    0 AS price, p_partkey AS url, p_partkey AS ord FROM part),
{MATCH_SQL}
SELECT reddit_name AS clean_name, jomashop_name AS product, jomashop_url AS ord,
  {S.rounded("match_score")} AS match_score
FROM matched
"""


def crowded_match(spark, sf):
    """As many different names as parts in one brand, against all parts; too many pairs for SQL."""
    parts = I.table(spark, sf, "part")
    names = parts.select(
        F.lit("ALL").alias("brand"), F.upper(F.concat_ws(" ", "p_name", "p_brand", "p_partkey")).alias("clean_name")
    )
    products = parts.select(
        F.lit("ALL").alias("brand"),
        F.upper(F.concat_ws(" ", "p_type", "p_name", "p_brand", "p_partkey")).alias("product"),
        F.col("p_partkey").alias("ord"),
    )
    return _rounded(similarity.best_matches(names, products).drop("brand"), "match_score")


# ---- index -----------------------------------------------------------------------------

_INDEX_NUMBERS = (
    "jomashop_price", "match_score", "weighted_avg_price", "weighted_std_dev",
    "weighted_price_diff",
)


def _market_index(spark, sf):
    return market.market_index(I.listings(spark, sf), I.retail(spark, sf))


def rounded_index(index):
    return _rounded(index, *_INDEX_NUMBERS)


def market_index(spark, sf):
    """The flagship: clean, match, weigh, join."""
    return rounded_index(_market_index(spark, sf))


_INDEX_SQL = """
index_rows AS (
  SELECT brand, reddit_name, jomashop_name, jomashop_price, jomashop_url, match_score,
    weighted_avg_price, weighted_std_dev, listing_count,
    weighted_avg_price - jomashop_price AS weighted_price_diff
  FROM matched LEFT JOIN weighted_stats ON reddit_name = frag_name)
"""
_ROUND_INDEX = ", ".join(
    f"{S.rounded(c)} AS {c}" if c in _INDEX_NUMBERS else c
    for c in (
        "brand", "reddit_name", "jomashop_name", "jomashop_price", "jomashop_url", "match_score",
        "weighted_avg_price", "weighted_std_dev", "listing_count", "weighted_price_diff",
    )
)
MARKET_INDEX_CHAIN = f"{_MATCH_CHAIN}, {WEIGHTED_ROWS_SQL}, {WEIGHTED_STATS_SQL}, {_INDEX_SQL}"
MARKET_INDEX = f"{MARKET_INDEX_CHAIN} SELECT {_ROUND_INDEX} FROM index_rows"


def catalogue_index(spark, sf):
    """Index rows for every catalogue item by its own name, without similarity."""
    parts = I.table(spark, sf, "part")
    # Some names stand in the catalogue only: no listing, no market price.
    name = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, " extrait").otherwise(""))
    items = parts.select(
        F.upper("p_brand").alias("brand"),
        market_name(name).alias("reddit_name"),
        F.upper(F.concat_ws(" ", "p_name", "p_type")).alias("jomashop_name"),
        F.col("p_retailprice").alias("jomashop_price"),
        F.concat(F.lit("https://shop.example/p/"), F.col("p_partkey")).alias("jomashop_url"),
        F.lit(1.0).alias("match_score"),
        "p_partkey",
    )
    matched = first_by(items, ["brand", "reddit_name"], F.col("p_partkey")).drop("p_partkey")
    return market.weighted_index(matched, stats.weighted_stats(I.listings(spark, sf)))


CATALOGUE_INDEX_CHAIN = f"""
WITH {I.LISTINGS_SQL}, {WEIGHTED_ROWS_SQL}, {WEIGHTED_STATS_SQL},
matched AS (
  SELECT upper(p_brand) AS brand, {S.market_name("p_name || CASE WHEN p_size % 3 = 0 THEN ' extrait' ELSE '' END")} AS reddit_name,
    upper(p_name || ' ' || p_type) AS jomashop_name, p_retailprice AS jomashop_price,
    'https://shop.example/p/' || p_partkey AS jomashop_url, CAST(1 AS DOUBLE) AS match_score
  FROM part
  QUALIFY row_number() OVER (PARTITION BY brand, reddit_name ORDER BY p_partkey) = 1),
{_INDEX_SQL}
"""


def weighted_index(spark, sf):
    return _rounded(catalogue_index(spark, sf), *_INDEX_NUMBERS)


WEIGHTED_INDEX = f"{CATALOGUE_INDEX_CHAIN} SELECT {_ROUND_INDEX} FROM index_rows"


def index_publish(spark, sf):
    """One row per name, of two brands the last."""
    return _rounded(market.index_rows(catalogue_index(spark, sf)), *_INDEX_NUMBERS)


INDEX_PUBLISH = f"""
{CATALOGUE_INDEX_CHAIN}
SELECT {_ROUND_INDEX} FROM index_rows
QUALIFY row_number() OVER (PARTITION BY reddit_name ORDER BY brand DESC) = 1
"""



def index_publish_counts(spark, sf):
    """Rows new or changed by three publications through the table: all, none, those of dearer items."""
    index = written(catalogue_index(spark, sf), "index")
    table = market.index_table(spark, scratch_path(spark, "index"))
    dearer = index.withColumn(
        "weighted_avg_price", F.col("weighted_avg_price") * F.when(F.col("reddit_name").contains("R"), 2).otherwise(1)
    )
    counts = [market.publish(table, rows) for rows in (index, index, dearer)]
    return spark.createDataFrame(list(enumerate(counts)), "publication int, published long")


INDEX_PUBLISH_COUNTS = f"""
{CATALOGUE_INDEX_CHAIN},
published AS MATERIALIZED (
  SELECT * FROM index_rows
  QUALIFY row_number() OVER (PARTITION BY reddit_name ORDER BY brand DESC) = 1)
SELECT 0 AS publication, count(*) AS published FROM published
UNION ALL SELECT 1, 0
UNION ALL SELECT 2, count(*) FROM published WHERE contains(reddit_name, 'R') AND weighted_avg_price <> 0
"""

_LIST_ORDER = "weighted_price_diff ASC NULLS FIRST, reddit_name, brand"
_LISTED = ", ".join(
    f"{S.rounded(c)} AS {c}" if c in _INDEX_NUMBERS else c for c in browse.LISTED
)
_LISTED_NUMBERS = [c for c in browse.LISTED if c in _INDEX_NUMBERS]


def index_listing(spark, sf):
    return _rounded(browse.listing(catalogue_index(spark, sf)), *_LISTED_NUMBERS)


INDEX_LISTING = f"{CATALOGUE_INDEX_CHAIN} SELECT {_LISTED} FROM index_rows ORDER BY {_LIST_ORDER}"


def search(spark, sf):
    return _rounded(browse.search(catalogue_index(spark, sf), "Ring"), *_LISTED_NUMBERS)


SEARCH = f"""
{CATALOGUE_INDEX_CHAIN}
SELECT {_LISTED} FROM index_rows
WHERE contains(lower(reddit_name), 'ring') OR coalesce(contains(lower(brand), 'ring'), false)
"""


def brand_suggest(spark, sf):
    return browse.suggest_brands(catalogue_index(spark, sf), "Brand#1")


BRAND_SUGGEST = f"""
{CATALOGUE_INDEX_CHAIN},
ranked AS (SELECT brand, row_number() OVER (ORDER BY {_LIST_ORDER}) AS place FROM index_rows)
SELECT brand FROM ranked WHERE contains(lower(brand), 'brand#1')
GROUP BY brand ORDER BY min(place) LIMIT 3
"""


def name_suggest(spark, sf):
    return browse.suggest_names(catalogue_index(spark, sf), "bolt")


NAME_SUGGEST = f"""
{CATALOGUE_INDEX_CHAIN}
SELECT reddit_name, brand FROM index_rows WHERE contains(lower(reddit_name), 'bolt')
ORDER BY {_LIST_ORDER} LIMIT 5
"""


def _grams(spark, sf):
    return grams.GramIndex(spark, scratch_path(spark, "grams")).build(catalogue_index(spark, sf))


def gram_search(spark, sf):
    """The same search through postings."""
    return _rounded(_grams(spark, sf).search("Ring"), *_LISTED_NUMBERS)


def gram_brand_suggest(spark, sf):
    return _grams(spark, sf).suggest_brands("Brand#1")


def gram_name_suggest(spark, sf):
    return _grams(spark, sf).suggest_names("bolt")


def trending(spark, sf):
    return _rounded(browse.trending(catalogue_index(spark, sf)), "weighted_avg_price")


TRENDING = f"""
{CATALOGUE_INDEX_CHAIN}
SELECT reddit_name, {S.rounded("weighted_avg_price")} AS weighted_avg_price FROM index_rows
ORDER BY {_LIST_ORDER} LIMIT 5
"""


def index_display(spark, sf):
    shown = browse.display(catalogue_index(spark, sf), sigmas=0.5)
    return _rounded(shown, "volatility").drop("quote_text").withColumn(
        "has_quote", F.col("quote").isNotNull()
    )


INDEX_DISPLAY = f"""
{CATALOGUE_INDEX_CHAIN},
shown AS (
  SELECT *, coalesce(jomashop_price, 0) <> 0 AND coalesce(weighted_price_diff, 0) <> 0 AS known,
    CASE WHEN coalesce(weighted_avg_price, 0) <> 0 AND coalesce(weighted_std_dev, 0) <> 0
      THEN round(weighted_avg_price - 0.5 * weighted_std_dev, 2) END AS quote
  FROM index_rows)
SELECT reddit_name, brand, round(weighted_avg_price, 0) AS market_price,
  round(weighted_std_dev, 0) AS spread, round(jomashop_price, 0) AS retail_price,
  round(CAST(least(coalesce(weighted_std_dev, 0) /
    CASE WHEN coalesce(weighted_avg_price, 0) = 0 THEN 1 ELSE weighted_avg_price END * 500, 100)
    AS DOUBLE), 4) AS volatility,
  CASE WHEN known AND weighted_price_diff < 0 THEN 'DEAL' WHEN known THEN 'HIGH' END AS badge,
  quote, quote IS NOT NULL AS has_quote
FROM shown
"""

QUERIES = {
    "market_index": (market_index, MARKET_INDEX),
    "weighted_index": (weighted_index, WEIGHTED_INDEX),
    "number_coercion": (number_coercion, NUMBER_COERCION),
    "string_trim": (string_trim, STRING_TRIM),
    "rows_dedup": (rows_dedup, ROWS_DEDUP),
    "status_domain": (status_domain, STATUS_DOMAIN),
    "required_fields": (required_fields, REQUIRED_FIELDS),
    "price_or_size": (price_or_size, PRICE_OR_SIZE),
    "full_bottles": (full_bottles, FULL_BOTTLES),
    "retail_clean": (retail_clean, RETAIL_CLEAN),
    "plain_stats": (plain_stats, PLAIN_STATS),
    "seller_weight": (seller_weight, SELLER_WEIGHT),
    "maintained_moments": (maintained_moments, MAINTAINED_MOMENTS),
    "index_publish_counts": (index_publish_counts, INDEX_PUBLISH_COUNTS),
    "weighted_stats": (weighted_stats, WEIGHTED_STATS),
    "fuzzy_match": (fuzzy_match, FUZZY_MATCH),
    "best_scores": (best_scores, BEST_SCORES),
    "crowded_match": (crowded_match, None),
    "index_publish": (index_publish, INDEX_PUBLISH),
    "index_listing": (index_listing, INDEX_LISTING),
    "search": (search, SEARCH),
    "brand_suggest": (brand_suggest, BRAND_SUGGEST),
    "name_suggest": (name_suggest, NAME_SUGGEST),
    "gram_search": (gram_search, SEARCH),
    "gram_brand_suggest": (gram_brand_suggest, BRAND_SUGGEST),
    "gram_name_suggest": (gram_name_suggest, NAME_SUGGEST),
    "trending": (trending, TRENDING),
    "index_display": (index_display, INDEX_DISPLAY),
}
