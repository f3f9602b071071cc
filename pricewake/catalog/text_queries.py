"""Queries over post text and page captures."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewake.catalog import inputs as I
from pricewake.catalog import sqltext as S
from pricewake.functions import text as X
from pricewake.functions.brands import ALIASES, BRANDS
from pricewake.operators import brands
from pricewake.operators import pages as PG
from pricewake.operators import posts as PO

# ---- posts, lines, fragments -------------------------------------------------


def post_filter(spark, sf):
    posts = I.doc_posts(spark, sf).unionByName(I.sale_posts(spark, sf))
    title = F.col("title")
    return posts.select(
        "url",
        *[X.is_sale_post(title, m).alias(m) for m in ("strict", "plural", "any")],
    )


_MODES = ", ".join(f'{S.is_sale_post("title", m)} AS "{m}"' for m in ("strict", "plural", "any"))
POST_FILTER = f"""
WITH {I.DOC_POSTS_SQL}, {I.SALE_POSTS_SQL.replace("posts AS", "sales AS")},
every AS (SELECT url, title FROM posts UNION ALL SELECT url, title FROM sales)
SELECT url, {_MODES} FROM every
"""


def line_split(spark, sf):
    return PO.post_lines(I.doc_posts(spark, sf), "url")


_LINES = f"""
WITH {I.DOC_POSTS_SQL},
lines AS (
  SELECT url, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS line_no, unnest(l) AS line
  FROM (SELECT url, {S.lines("body")} AS l FROM posts))
"""
LINE_SPLIT = f"{_LINES} SELECT url, line_no, line FROM lines"


def fragment_split(spark, sf):
    docs = PO.post_fragments(I.doc_posts(spark, sf), "url")
    sales = PO.post_fragments(I.sale_posts(spark, sf), "url")
    return docs.unionByName(sales).drop("line")


def _fragments_sql(source: str) -> str:
    return f"""
SELECT url, line_no, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS fragment_no,
  unnest(f) AS fragment, line
FROM (
  SELECT url, line_no, line, {S.fragments("line")} AS f
  FROM (
    SELECT url, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS line_no, unnest(l) AS line
    FROM (SELECT url, {S.lines("body")} AS l FROM {source})))
"""


FRAGMENT_SPLIT = f"""
WITH {I.DOC_POSTS_SQL}, {I.SALE_POSTS_SQL.replace("posts AS", "sales AS")}
SELECT url, line_no, fragment_no, fragment FROM ({_fragments_sql("posts")})
UNION ALL
SELECT url, line_no, fragment_no, fragment FROM ({_fragments_sql("sales")})
"""


def emoji_removal(spark, sf):
    return I.sale_posts(spark, sf).select("url", X.without_emoji(F.col("body")).alias("body"))


EMOJI_REMOVAL = f"""
WITH {I.SALE_POSTS_SQL} SELECT url, {S.without_emoji("body")} AS body FROM posts
"""


def noise_filter(spark, sf):
    docs = PO.informative_lines(I.doc_posts(spark, sf), "url")
    return docs.unionByName(PO.informative_lines(I.sale_posts(spark, sf), "url"))


def _kept_sql(source: str) -> str:
    return f"""
SELECT url, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS line_no, unnest(l) AS line
FROM (SELECT url, {S.kept_lines("body")} AS l FROM {source})
"""


NOISE_FILTER = f"""
WITH {I.DOC_POSTS_SQL}, {I.SALE_POSTS_SQL.replace("posts AS", "sales AS")}
SELECT url, line_no, line, {S.is_struck("line")} AS struck
FROM (({_kept_sql("posts")}) UNION ALL ({_kept_sql("sales")}))
"""


def strike_flag(spark, sf):
    lines = PO.post_lines(I.sale_posts(spark, sf), "url")
    flag = X.is_struck(F.col("line"))
    return lines.select(
        "url",
        "line_no",
        F.when(flag, "SOLD").otherwise(X.status_of(F.col("line"))).alias("status"),
    )


STRIKE_FLAG = f"""
WITH {I.SALE_POSTS_SQL},
lines AS (
  SELECT url, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS line_no, unnest(l) AS line
  FROM (SELECT url, {S.lines("body")} AS l FROM posts))
SELECT url, line_no,
  CASE WHEN {S.is_struck("line")} THEN 'SOLD' ELSE {S.status_of("line")} END AS status
FROM lines
"""


def line_batches(spark, sf):
    posts = PO.sale_posts(I.doc_posts(spark, sf), "any")
    return PO.line_batches(posts, "url")


def _batches_sql(keep: str, mode: str) -> str:
    return f"""
SELECT {keep}, CAST(floor(pos / 10) AS INTEGER) AS batch, CAST(count(*) AS INTEGER) AS line_count,
  string_agg(line, chr(10) ORDER BY pos) AS text
FROM (
  SELECT {keep}, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line
  FROM (SELECT {keep}, {S.kept_lines("body")} AS l FROM posts
        WHERE {S.is_sale_post("title", mode)}))
GROUP BY {keep}, batch
"""


LINE_BATCHES = f"WITH {I.DOC_POSTS_SQL} {_batches_sql('url', 'any')}"


def extraction_requests(spark, sf):
    posts = PO.sale_posts(I.doc_posts(spark, sf), "plural")
    batches = PO.line_batches(posts, "url", "author", "flair")
    return PO.extraction_requests(batches).select("url", "batch", "request")


_KNOWN = ", ".join(dict.fromkeys([c for _, c in ALIASES] + list(BRANDS)))
_LEAD = (
    "List every item offered for sale in the lines below.\n"
    "Answer with one JSON array and nothing else, one object per item, with the keys\n"
    "author, flair, brand, frag_name, size (ml), price (USD), fill_percent (0-100), "
    "status (SOLD, AVAILABLE, LISTED or null). Unknown values are null.\n"
    "Text between ~~ and ~~ is SOLD. Skip links, emoji and remarks.\n"
    f"Known brands: {_KNOWN}\n"
)


def _json_field(name: str) -> str:
    return (
        f"CASE WHEN {name} IS NULL THEN '{{}}' "
        f"ELSE '{{\"{name}\":' || CAST(to_json({name}) AS VARCHAR) || '}}' END"
    )


EXTRACTION_REQUESTS = f"""
WITH {I.DOC_POSTS_SQL}, batches AS ({_batches_sql("url, author, flair", "plural")})
SELECT url, batch, {S.quoted(_LEAD)} || 'author: ' || {_json_field("author")} || chr(10) ||
  'flair: ' || {_json_field("flair")} || chr(10) || 'lines:' || chr(10) || text AS request
FROM batches
"""

# Replies: plain arrays, arrays inside other words, and replies without any.
_REPLY = {
    "url": "CAST(conv_id AS VARCHAR(20)) || '/' || CAST(turn AS VARCHAR(20))",
    "reply": "CASE role WHEN 'user' THEN '[{\"brand\": \"Creed\", \"size_ml\": ' || "
    "CAST(turn AS VARCHAR(20)) || ', \"price_usd\": 12.5}, {\"brand\": null, "
    "\"frag_name\": \"n ' || CAST(conv_id AS VARCHAR(20)) || '\"}]' "
    "WHEN 'assistant' THEN text || ' [{\"frag_name\": \"x\", \"status\": \"SOLD\", "
    "\"fill_percent\": ' || CAST(turn AS VARCHAR(20)) || '}] so much for that' "
    "ELSE '{\"brand\": \"no array\"}' END",
}


def _replies(spark, sf):
    return I.table(spark, sf, "conversations").selectExpr(
        *[f"{sql} AS {name}" for name, sql in _REPLY.items()]
    )


def reply_listings(spark, sf):
    return PO.reply_listings(_replies(spark, sf), "url").drop("author", "flair", "raw_text")


_DOCS_SQL = f"""
replies AS (SELECT {", ".join(f"{s} AS {n}" for n, s in _REPLY.items())} FROM conversations),
docs AS (
  SELECT url, reply,
    CASE WHEN json_valid(trim(reply)) THEN trim(reply)
      ELSE regexp_extract(reply, '(?s)(\\[.*\\]|\\{{.*\\}})', 1) END AS doc
  FROM replies)
"""
REPLY_LISTINGS = f"""
WITH {_DOCS_SQL},
items AS (
  SELECT url, CAST(generate_subscripts(j, 1) - 1 AS INTEGER) AS item_no, unnest(j) AS j
  FROM (SELECT url, CAST(CASE WHEN json_valid(doc) THEN doc END AS JSON[]) AS j
        FROM docs WHERE json_valid(doc) AND starts_with(doc, '[')))
SELECT url, item_no, j->>'brand' AS brand, j->>'frag_name' AS frag_name,
  CAST(j->>'size_ml' AS DOUBLE) AS size_ml, CAST(j->>'price_usd' AS DOUBLE) AS price_usd,
  CAST(j->>'fill_percent' AS DOUBLE) AS fill_percent, j->>'status' AS status
FROM items
"""


def reply_rejects(spark, sf):
    return PO.rejected_replies(_replies(spark, sf), "url")


REPLY_REJECTS = f"""
WITH {_DOCS_SQL}
SELECT url, reply FROM docs WHERE NOT (json_valid(doc) AND starts_with(doc, '['))
"""

# ---- fields ----------------------------------------------------------------------

_FRAGMENTS = f"WITH {I.SALE_POSTS_SQL}, f AS ({_fragments_sql('posts')})"


def _sale_fragments(spark, sf):
    return PO.post_fragments(I.sale_posts(spark, sf), "url").drop("line")


def _over_fragments(**fields):
    def run(spark, sf):
        rows = _sale_fragments(spark, sf)
        return rows.select(
            "url", "line_no", "fragment_no", *[make(F.col("fragment")).alias(n)
                                               for n, make in fields.items()]
        )

    return run


def _fragment_sql(**fields: str) -> str:
    columns = ", ".join(f"{sql} AS {name}" for name, sql in fields.items())
    return f"{_FRAGMENTS} SELECT url, line_no, fragment_no, {columns} FROM f"


def brand_lookup(spark, sf):
    lines = PO.post_lines(I.doc_posts(spark, sf), "url")
    return lines.select("url", "line_no", X.brand_of(F.lower("line")).alias("brand"))


BRAND_LOOKUP = f"{_LINES} SELECT url, line_no, {S.brand_of('line')} AS brand FROM lines"


def brand_alias(spark, sf):
    return PO.fragment_texts(I.sale_posts(spark, sf), "url")


BRAND_ALIAS = f"""
{_FRAGMENTS},
found AS (SELECT *, {S.alias_of("fragment")} AS hit FROM f)
SELECT url, line_no, fragment_no, hit.canonical AS brand,
  {S.without_alias("fragment", "hit.alias")} AS text
FROM found
"""


def name_clean(spark, sf):
    rows = _sale_fragments(spark, sf).withColumn("brand", X.brand_of(F.lower("fragment")))
    name = X.clean_item_name(X.without_brand(F.col("fragment"), F.col("brand")))
    return rows.select("url", "line_no", "fragment_no", "brand", name.alias("frag_name"))


NAME_CLEAN = f"""
{_FRAGMENTS},
b AS (SELECT *, {S.brand_of("fragment")} AS brand FROM f)
SELECT url, line_no, fragment_no, brand,
  {S.clean_item_name(S.without_brand("fragment", "brand"))} AS frag_name
FROM b
"""

size_parse = _over_fragments(size_ml=X.size_ml)
SIZE_PARSE = _fragment_sql(size_ml=S.size_ml("fragment"))
price_parse = _over_fragments(price_usd=X.price_usd)
PRICE_PARSE = _fragment_sql(price_usd=S.price_usd("fragment"))


def fill_parse(spark, sf):
    rows = _sale_fragments(spark, sf).withColumn("size_ml", X.size_ml(F.col("fragment")))
    fill = X.fill_percent(F.col("fragment"), F.col("size_ml"))
    return rows.select("url", "line_no", "fragment_no", fill.alias("fill_percent"))


FILL_PARSE = _fragment_sql(fill_percent=S.fill_percent("fragment", f"({S.size_ml('fragment')})"))
status_parse = _over_fragments(status=X.status_of)
STATUS_PARSE = _fragment_sql(status=S.status_of("fragment"))


def listing_extract(spark, sf):
    rows = PO.extract_listings(I.sale_posts(spark, sf), mode="plural")
    return rows.drop("post_title", "post_date")


def extracted_sql(mode: str) -> str:
    """CTE ``extracted`` over CTE ``posts``."""
    return f"""
frags AS ({_fragments_sql("posts")}),
fields AS (
  SELECT url, line_no, fragment_no, fragment AS raw_text, {S.brand_of("fragment")} AS brand,
    {S.size_ml("fragment")} AS size_ml, {S.price_usd("fragment")} AS price_usd,
    CASE WHEN {S.is_struck("line")} THEN 'SOLD' ELSE {S.status_of("fragment")} END AS status
  FROM frags),
extracted AS (
  SELECT author, flair, brand,
    {S.clean_item_name(S.without_brand("raw_text", "brand"))} AS frag_name, size_ml, price_usd,
    {S.fill_percent("raw_text", "size_ml")} AS fill_percent, status, raw_text, url AS post_url,
    title AS post_title, date AS post_date,
    url || '#' || CAST(row_number() OVER (PARTITION BY url ORDER BY line_no, fragment_no) - 1
      AS VARCHAR) AS listing_key
  FROM fields JOIN posts USING (url)
  WHERE {S.is_sale_post("title", mode)}
    AND (coalesce(price_usd, 0) <> 0 OR coalesce(size_ml, 0) <> 0))
"""


LISTING_EXTRACT = f"""
WITH {I.SALE_POSTS_SQL}, {extracted_sql("plural")}
SELECT * EXCLUDE (post_title, post_date) FROM extracted
"""


def text_normalise(spark, sf):
    return I.table(spark, sf, "documents").select(
        "doc_id", X.search_text(F.col("text")).alias("text")
    )


TEXT_NORMALISE = f"SELECT doc_id, {S.search_text('text')} AS text FROM documents"

# ---- pages -----------------------------------------------------------------------


def link_extract(spark, sf):
    pages = I.table(spark, sf, "pages")
    return PG.product_links(pages, "page_id", item_class=None, link_classes=())


_LINKS = """
links AS (
  SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos,
    nullif(regexp_extract(regexp_extract(item, '(?is)<a\\b[^>]*>', 0),
      '(?is)\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1), '') AS link
  FROM (SELECT page_id, generate_subscripts(items, 1) AS pos, unnest(items) AS item
        FROM (SELECT page_id, regexp_extract_all(html, '(?is)<li\\b[^>]*>(.*?)</li>', 1) AS items
              FROM pages)))
"""
LINK_EXTRACT = f"WITH {_LINKS} SELECT * FROM links WHERE link IS NOT NULL"


def link_first_seen(spark, sf):
    return PG.first_seen_links(link_extract(spark, sf), "page_id")


LINK_FIRST_SEEN = f"""
WITH {_LINKS}
SELECT link, page_id, pos FROM links WHERE link IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY link ORDER BY page_id, pos) = 1
"""


def catalogue_links(spark, sf):
    """Links of the shop's own list pages, chosen by class and by place."""
    pages = I.catalogue_pages(spark, sf)
    by_class = PG.product_links(pages, "page_id").withColumn("chosen", F.lit("class"))
    by_place = PG.product_links(pages, "page_id", document_order=True)
    return by_class.unionByName(by_place.withColumn("chosen", F.lit("place")))


CATALOGUE_LINKS = """
WITH p AS (
  SELECT p_partkey AS page_id, CASE WHEN p_size % 2 = 0 THEN '/n/' || p_partkey END AS name,
    CASE WHEN p_size % 3 = 0 THEN '/i?a=1&b=' || p_partkey END AS image FROM part)
SELECT page_id, 0 AS pos, coalesce(image, name) AS link, 'class' AS chosen FROM p
WHERE coalesce(image, name) IS NOT NULL
UNION ALL
SELECT page_id, 0, coalesce(name, image), 'place' FROM p WHERE coalesce(image, name) IS NOT NULL
"""


def variant_expand(spark, sf):
    captured = I.table(spark, sf, "pages")
    return PG.variant_urls(captured, "page_id", variant=None, container=None).unionByName(
        PG.variant_urls(I.product_pages(spark, sf), F.lit(-1).cast("bigint").alias("page_id"))
    )


VARIANT_EXPAND = f"""
WITH captured AS (
  SELECT page_id, url, list_filter(list_transform(
      regexp_extract_all(html, '(?is)<a\\b[^>]*>', 0), lambda t:
      nullif(regexp_extract(t, '(?is)\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1), '')),
      lambda h: h IS NOT NULL) AS v
  FROM pages),
urls AS (
  SELECT page_id, CASE WHEN len(v) = 0 THEN [url] ELSE list_transform(v, lambda h:
    CASE WHEN starts_with(h, 'http') THEN h ELSE '{PG.SITE}' || h END) END AS u
  FROM captured
  UNION ALL
  SELECT -1, CASE WHEN p_size = 3 THEN ['https://shop.example/p/' || p_partkey]
    ELSE ['{PG.SITE}/v/' || p_partkey, 'http://v.example/' || p_size] END
  FROM part)
SELECT page_id, CAST(generate_subscripts(u, 1) - 1 AS INTEGER) AS pos, unnest(u) AS variant_url
FROM urls
"""


def retail_pages(spark, sf):
    return PG.retail_rows(PG.read_products(I.product_pages(spark, sf)))


RETAIL_PAGES = """
SELECT DISTINCT p_brand AS brand, p_name || ' & ' || p_type AS product,
  CASE WHEN p_size = 3 THEN '' ELSE p_size || ' ml' END AS size,
  CASE WHEN p_size = 3 THEN '$5' ELSE '$' || p_retailprice END AS discount_price,
  '$' || p_retailprice AS retail_price, 'https://shop.example/p/' || p_partkey AS url
FROM part WHERE p_size NOT IN (1, 2)
"""


def retail_page_rejects(spark, sf):
    return PG.rejected_pages(PG.read_products(I.product_pages(spark, sf)))


RETAIL_PAGE_REJECTS = """
SELECT 'https://shop.example/p/' || p_partkey AS url,
  CASE p_size WHEN 1 THEN 'no header' ELSE 'no brand' END AS reason
FROM part WHERE p_size IN (1, 2)
"""

# As many aliases as parts; those of small numbers stand inside others, and the order decides.
_ALIAS_ORD = "CAST((p_partkey * 7919) % 100003 AS BIGINT)"
_ALIAS_TEXT = "'Lot of PART ' || l_partkey || ' by ' || l_suppkey || ', was Part ' || (l_partkey * 3 % 50000)"


def alias_table(spark, sf):
    """First alias out of a table of them, for every text; a part's number is an alias."""
    dim = I.table(spark, sf, "part").selectExpr(
        f"{_ALIAS_ORD} AS ord", "'pArt ' || p_partkey AS alias", "p_brand AS canonical"
    )
    texts = I.table(spark, sf, "lineitem").selectExpr(f"{I.KEY} AS listing_key", f"{_ALIAS_TEXT} AS text")
    return brands.attach_first_alias(texts, dim).drop("text")


ALIAS_TABLE = f"""
WITH texts AS (SELECT {I.KEY} AS listing_key, {_ALIAS_TEXT} AS text FROM lineitem),
dim AS (SELECT {_ALIAS_ORD} AS ord, 'pArt ' || p_partkey AS alias, p_brand AS canonical FROM part),
-- Aliases differ in their number, so that a text holds those whose number begins a number of its own.
held AS (
  SELECT DISTINCT text, left(n, length) AS number FROM (
    SELECT text, unnest(regexp_extract_all(lower(text), 'part ([0-9]+)', 1)) AS n FROM texts),
    range(1, 12) r(length) WHERE length <= length(n)),
firsts AS (
  SELECT text, min(ord) AS alias_ord, min_by(alias, ord) AS alias, min_by(canonical, ord) AS canonical
  FROM held JOIN dim ON alias = 'pArt ' || number GROUP BY text)
SELECT listing_key, alias_ord, alias, canonical FROM texts LEFT JOIN firsts USING (text)
"""

QUERIES = {
    "alias_table": (alias_table, ALIAS_TABLE),
    "post_filter": (post_filter, POST_FILTER),
    "line_split": (line_split, LINE_SPLIT),
    "fragment_split": (fragment_split, FRAGMENT_SPLIT),
    "emoji_removal": (emoji_removal, EMOJI_REMOVAL),
    "noise_filter": (noise_filter, NOISE_FILTER),
    "strike_flag": (strike_flag, STRIKE_FLAG),
    "line_batches": (line_batches, LINE_BATCHES),
    "extraction_requests": (extraction_requests, EXTRACTION_REQUESTS),
    "reply_listings": (reply_listings, REPLY_LISTINGS),
    "reply_rejects": (reply_rejects, REPLY_REJECTS),
    "brand_lookup": (brand_lookup, BRAND_LOOKUP),
    "brand_alias": (brand_alias, BRAND_ALIAS),
    "name_clean": (name_clean, NAME_CLEAN),
    "size_parse": (size_parse, SIZE_PARSE),
    "price_parse": (price_parse, PRICE_PARSE),
    "fill_parse": (fill_parse, FILL_PARSE),
    "status_parse": (status_parse, STATUS_PARSE),
    "listing_extract": (listing_extract, LISTING_EXTRACT),
    "text_normalise": (text_normalise, TEXT_NORMALISE),
    "link_extract": (link_extract, LINK_EXTRACT),
    "catalogue_links": (catalogue_links, CATALOGUE_LINKS),
    "link_first_seen": (link_first_seen, LINK_FIRST_SEEN),
    "variant_expand": (variant_expand, VARIANT_EXPAND),
    "retail_pages": (retail_pages, RETAIL_PAGES),
    "retail_page_rejects": (retail_page_rejects, RETAIL_PAGE_REJECTS),
}
