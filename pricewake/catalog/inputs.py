"""Domain tables derived from the standard tables.

Column expressions are plain ANSI text that Spark and DuckDB both read, so a
query and its SQL twin start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewake.functions.brands import BRANDS

NOW = "2024-03-01 00:00:00"
EARLIER = "2024-02-01 00:00:00"

_NAMES = [b for b in BRANDS if "'" not in b]
_NAME_LIST = "|".join(_NAMES)


def _brand_at(number: str) -> str:
    return f"split_part('{_NAME_LIST}', '|', CAST({number} % {len(_NAMES)} + 1 AS INT))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame, *keys: str, rows_per_task: int = 100_000) -> DataFrame:
    """The same rows in as many tasks as their number asks for, and at least one a core.

    A file of one row group is one task, however long what follows takes for each row.
    """
    found = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-found // rows_per_task), min(cores, -(-found // 1000)), 1)
    return rows.repartition(tasks, *keys)


def _columns(expressions: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in expressions.items())


def _select(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(sql).alias(name) for name, sql in expressions.items()])


# ---- listings: one per order line ---------------------------------------------

KEY = (
    "CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_partkey AS VARCHAR(20)) || '-' || "
    "CAST(l_suppkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(20)) || '-' || "
    "CAST(CAST(l_quantity AS INT) AS VARCHAR(20))"
)
LISTING = {
    "author": "'Customer ' || CAST(o_custkey AS VARCHAR(20))",
    "flair": "CASE WHEN o_orderpriority = '5-LOW' THEN NULL "
    "ELSE 'Legacy:0/Buys:1/Sales:' || CAST(sales AS VARCHAR(20)) END",
    "brand": "' ' || p_brand",
    "frag_name": "p_name || CASE WHEN l_tax = 0.08 THEN ' Decant' ELSE ' (' || p_type || ')' END",
    "size": "CAST(p_size AS DOUBLE)",
    # The ratio keeps means away from the ties that two engines round differently.
    "price": "l_extendedprice * 100000 / (l_quantity * 100003)",
    "fill_percent": "CASE WHEN l_linestatus = 'O' AND l_discount = 0 THEN NULL "
    "ELSE LEAST(2 * l_quantity, 100.0) END",
    "status": "CASE l_returnflag WHEN 'R' THEN 'SOLD' WHEN 'A' THEN 'available' ELSE '' END",
    "listing_key": KEY,
    "post_url": "'https://swap.example/' || " + KEY,
    "raw_text": "p_brand || ' ' || p_name || ' ' || CAST(p_size AS VARCHAR(20)) || 'ml'",
    "post_title": "'[WTS] ' || p_type || ' (Bottle)'",
}


def listings(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """``dealt`` out to many tasks for what takes long for each row."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    sales = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("sales"))
    rows = table(spark, sf_dir, "lineitem")
    if dealt:
        rows = spread(rows, "l_orderkey", "l_linenumber")
    lines = (
        rows.join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
        .join(orders.join(sales, "o_custkey"), F.expr("l_orderkey = o_orderkey"))
    )
    return _select(lines, LISTING)


LISTINGS_SQL = f"""
sales AS (SELECT o_custkey, count(*) AS sales FROM orders GROUP BY o_custkey),
listings AS (
  SELECT {_columns(LISTING)}
  FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN orders ON l_orderkey = o_orderkey JOIN sales USING (o_custkey))
"""

# ---- retail catalogue: one row per part ------------------------------------------

RETAIL = {
    "brand": "lower(p_brand) || ' '",
    "product": "' ' || p_name || ' ' || p_type || ' ' || CAST(p_size AS VARCHAR(20)) || ' ml'",
    "size": "''",
    # Dollars with a thousands comma, and now and then no number.
    "discount_price": "CASE WHEN p_retailprice >= 1000 THEN '$' || "
    "CAST(CAST(FLOOR(p_retailprice / 1000) AS INT) AS VARCHAR(20)) || ',' || "
    "LPAD(CAST(CAST(FLOOR(p_retailprice) AS INT) % 1000 AS VARCHAR(20)), 3, '0') || '.' || "
    "LPAD(CAST(CAST(ROUND(p_retailprice * 100, 0) AS BIGINT) % 100 AS VARCHAR(20)), 2, '0') "
    "WHEN p_size = 50 THEN 'call' "
    "ELSE '$' || CAST(p_retailprice AS VARCHAR(30)) END",
    "retail_price": "'$' || CAST(p_retailprice AS VARCHAR(30))",
    "url": "'https://shop.example/p/' || CAST(p_partkey AS VARCHAR(20))",
    "ord": "p_partkey",
}


def retail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "part"), RETAIL)


RETAIL_SQL = f"retail AS (SELECT {_columns(RETAIL)} FROM part)"

# ---- posts written from order lines -----------------------------------------------

_B1 = _brand_at("l_partkey")
_B2 = _brand_at("l_suppkey")
_SIZE = "CAST(p_size AS VARCHAR(20))"
_QUANTITY = "CAST(CAST(l_quantity AS INT) AS VARCHAR(20))"
_DOLLARS = "CAST(CAST(FLOOR(l_extendedprice / l_quantity) AS INT) AS VARCHAR(20))"
SALE_POST = {
    "title": "CASE l_returnflag WHEN 'N' THEN '[WTS] ' || p_name || ' (Bottle)' "
    "WHEN 'A' THEN '[wts] ' || p_name || ' (bottles)' ELSE '[WTB] ' || p_name || ' (bottle)' END",
    "author": "'Seller ' || CAST(l_suppkey AS VARCHAR(20))",
    "flair": "CASE l_linestatus WHEN 'O' THEN 'Legacy:0/Buys:1/Sales:' || "
    "CAST(l_suppkey AS VARCHAR(20)) ELSE NULL END",
    "date": "CAST(l_orderkey AS DOUBLE) * 100 + l_linenumber",
    "url": "'https://swap.example/' || " + KEY,
}
_STRIKE = "CASE l_linestatus WHEN 'F' THEN '~~' ELSE '' END"
_LINES = [
    f"{_STRIKE} || {_B1} || ' ' || p_name || ' (' || p_type || ') ' || {_SIZE} || 'ml - $' || "
    f"{_DOLLARS} || {_STRIKE}",
    f"'  * ' || upper({_B2}) || ' ' || p_name || ' ' || {_QUANTITY} || '/50 mL ' || {_QUANTITY} "
    "|| '% $1,' || LPAD(CAST(l_linenumber AS VARCHAR(20)), 3, '0') || '.50 BNIB, see level '",
    "'pics https://imgur.com/a/' || CAST(l_partkey AS VARCHAR(20))",
    f"'Also ' || p_type || ' 7.5ml for $' || {_QUANTITY} || '.25, ' || p_name || ' ≈' || "
    f"{_QUANTITY} || 'ml of ' || {_SIZE} || 'ml and 😀 ' || {_B1} || ' tester listed 🚢 $ 30'",
    "'CONUS only please'",
]


def _body(lf: str, crlf: str) -> str:
    a, b, c, d, e = _LINES
    return f"{a} || {lf} || {b} || {crlf} || {crlf} || {c} || {lf} || {d} || {lf} || {e}"


def sale_posts(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """``dealt`` out to many tasks for what reads the texts; without it in the tasks, and files, that the table has."""
    lines = table(spark, sf_dir, "lineitem")
    if dealt:
        lines = spread(lines, "l_orderkey", "l_linenumber")
    lines = lines.join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
    return _select(lines, {**SALE_POST, "body": _body("char(10)", "char(13) || char(10)")})


SALE_POSTS_SQL = f"""
posts AS (
  SELECT {_columns({**SALE_POST, "body": _body("chr(10)", "chr(13) || chr(10)")})}
  FROM lineitem JOIN part ON l_partkey = p_partkey)
"""

# ---- posts that hold whole documents -------------------------------------------------

DOC_POST = {
    "title": "CASE lang WHEN 'en' THEN '[WTS] ' || source || ' (Bottle)' "
    "WHEN 'fr' THEN '[wts] ' || source || ' (bottles)' "
    "WHEN 'de' THEN '[WTS] ' || source || ' (decant)' "
    "ELSE '[WTB] ' || source || ' (bottle)' END",
    "body": "text",
    "author": "source",
    "flair": "CASE WHEN lang = 'en' THEN 'Legacy:0/Buys:1/Sales:7' END",
    "date": "CAST(n_chars AS DOUBLE)",
    "url": "'doc/' || CAST(doc_id AS VARCHAR(20))",
}


def doc_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "documents"), DOC_POST)


DOC_POSTS_SQL = f"posts AS (SELECT {_columns(DOC_POST)} FROM documents)"

# ---- product pages: one per part --------------------------------------------------------

PAGE = {
    "url": "'https://shop.example/p/' || CAST(p_partkey AS VARCHAR(20))",
    "html": "'<!DOCTYPE html><html><body><nav><a class=\"menu\" href=\"/x\">x</a>"
    # A link of the class, but in no container.
    "<a class=\"child-product\" href=\"/other\">other</a></nav>' || "
    "CASE WHEN p_size = 1 THEN '' ELSE "
    "'<h1 id=\"product-h1-product-name\"> <b>' || p_name || '</b> &amp; ' || p_type || ' </h1>' "
    "END || "
    "CASE WHEN p_size = 2 THEN '' ELSE '<p class=\"x brand-name\">' || p_brand || '<br></p>' END "
    "|| '<div class=\"child-products-container\">' || "
    "CASE WHEN p_size = 3 THEN '' ELSE "
    "'<a class=\"child-product\" href=\"/v/' || CAST(p_partkey AS VARCHAR(20)) || '\">"
    "<span class=\"item-size\">1 ml</span></a>"
    "<a class=\"child-product selected\" href=\"http://v.example/' || CAST(p_size AS VARCHAR(20)) "
    "|| '\"><span class=\"item-size\"> ' || CAST(p_size AS VARCHAR(20)) || ' ml</span>"
    "<span class=\"item-price\">$' || CAST(p_retailprice AS VARCHAR(30)) || '</span></a>' END "
    "|| '</div><div class=\"now-price\"><img src=\"a\"><span>$5</span></div>"
    "<div class=\"retail-wrapper\"><span class=\"retail-label\">Retail</span>"
    "<span>$' || CAST(p_retailprice AS VARCHAR(30)) || '</span></div></body></html>'",
}


# Pages take far longer a row than the table they are built from.
PAGES_PER_TASK = 5_000


def _parts_for_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part"), "p_partkey", rows_per_task=PAGES_PER_TASK)


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(_parts_for_pages(spark, sf_dir), PAGE)


# ---- catalogue pages: one per part ---------------------------------------------------------

CATALOGUE_PAGE = {
    "page_id": "p_partkey",
    "html": "'<ul><li class=\"ad\"><a class=\"itemLink\" href=\"/ad\">ad</a></li>"
    "<li class=\"productItem big\"><ul><li>' || p_brand || '</li></ul>' || "
    "CASE WHEN p_size % 2 = 0 THEN '<a class=\"productName-link\" data-href=\"/no\" href=\"/n/' || "
    "CAST(p_partkey AS VARCHAR(20)) || '\">name</a>' ELSE '' END || "
    "CASE WHEN p_size % 3 = 0 THEN '<a class=\"x productImg-link\" href=\"/i?a=1&amp;b=' || "
    "CAST(p_partkey AS VARCHAR(20)) || '\">image</a>' ELSE '' END || "
    "'</li></ul><a class=\"itemLink\" href=\"/end\">end</a>'",
}


def catalogue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(_parts_for_pages(spark, sf_dir), CATALOGUE_PAGE)


# ---- alerts: one per customer ---------------------------------------------------------------

ALERT = {
    "alert_id": "CAST(c_custkey AS VARCHAR(20))",
    "email": "CASE WHEN c_nationkey = 24 THEN NULL ELSE lower(c_name) || '@mail.example' END",
    "type": "CASE c_mktsegment WHEN 'BUILDING' THEN 'rare' WHEN 'MACHINERY' THEN 'other' "
    "ELSE 'Deal' END",
    "target_name": "CASE WHEN c_nationkey = 23 THEN NULL "
    "WHEN c_mktsegment = 'BUILDING' THEN p_brand || ' ' || p_name || ' ' "
    "|| CAST(p_size AS VARCHAR(20)) || 'ml' "
    "ELSE p_name END",
    "threshold": "CASE WHEN c_nationkey = 22 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) / 10 END",
    "created_at": f"CAST('{EARLIER}' AS TIMESTAMP)",
    "active": "CASE WHEN c_acctbal < 0 THEN false WHEN c_acctbal < 500 THEN NULL ELSE true END",
}


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "part"), F.expr("c_custkey = p_partkey"), "left"
    )
    return _select(rows, ALERT)


ALERTS_SQL = f"""
alerts AS (
  SELECT {_columns(ALERT)} FROM customer LEFT JOIN part ON c_custkey = p_partkey)
"""
