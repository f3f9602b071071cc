"""Queries over files, keyed tables and the incremental ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewake import schemas
from pricewake.catalog import inputs as I
from pricewake.catalog import sqltext as S
from pricewake.catalog.market_queries import (
    CATALOGUE_INDEX_CHAIN,
    MARKET_INDEX,
    catalogue_index,
    rounded_index,
)
from pricewake.catalog.text_queries import extracted_sql
from pricewake.operators.keyed import keep_first, merge_by_key
from pricewake.plans import market
from pricewake.session import scratch_path, written
from pricewake.sources import files
from pricewake.sources.tables import KeyedTable
from pricewake.streaming import ingest as J

DIGITS = 4

# ---- files: written, read back, compared with their source -----------------------


def posts_csv(spark, sf):
    """Whole documents as quoted CSV, line breaks and quotes included."""
    path = scratch_path(spark, "posts-csv")
    files.write_csv(I.doc_posts(spark, sf), path, schemas.POSTS_RAW.names)
    return files.read_posts_csv(spark, path)


POSTS_CSV = f"WITH {I.DOC_POSTS_SQL} SELECT title, body, author, flair, date, url FROM posts"


def retail_csv(spark, sf):
    path = scratch_path(spark, "retail-csv")
    files.write_csv(I.retail(spark, sf), path, schemas.RETAIL.names)
    return files.read_retail_csv(spark, path)


RETAIL_CSV = f"""
WITH {I.RETAIL_SQL}
SELECT brand, product, nullif(size, '') AS size, discount_price, retail_price, url FROM retail
"""



def files_to_index(spark, sf):
    """Catalogue and listing files as they lie there, to the market index.

    The catalogue stands in two files of different column order, and it holds each part a second
    time, so that the best score is always reached twice: the earlier row of the files wins.
    """
    shop, posts = scratch_path(spark, "shop"), scratch_path(spark, "posts")
    rows = I.retail(spark, sf).coalesce(1).sortWithinPartitions("ord")
    names = schemas.RETAIL.names
    # Files are read in the order of their paths.
    files.write_csv(rows.withColumn("retail_price", F.lit("first")), f"{shop}/1", names)
    files.write_csv(rows.withColumn("url", F.lit("again")), f"{shop}/2", names[::-1])
    files.write_csv(I.listings(spark, sf), posts, [*schemas.LISTINGS_BATCH.names])
    catalogue = files.read_retail_csv(spark, f"{shop}/*", ordered=True)
    # Read by both statistics, and by their filters: fields are cut and typed once.
    listed = written(schemas.to_batch_names(files.read_listings_csv(spark, posts)), "listed")
    index = market.market_index(listed, catalogue)
    return rounded_index(index)


FILES_TO_INDEX = MARKET_INDEX


_BATCH = schemas.LISTINGS_BATCH.names


def listings_json(spark, sf):
    path = scratch_path(spark, "listings-json")
    files.write_json(I.listings(spark, sf).select(*_BATCH), path, compression="gzip")
    return files.read_listings_json(spark, path, as_array=False)


LISTINGS_JSON = f"WITH {I.LISTINGS_SQL} SELECT {', '.join(_BATCH)} FROM listings"


def listings_json_array(spark, sf):
    """The same listings as the elements of arrays that many tasks read."""
    path = scratch_path(spark, "arrays")
    rows = I.listings(spark, sf).select(F.to_json(F.struct(*_BATCH), {"ignoreNullFields": "false"}).alias("value"))
    rows.write.option("lineSep", ",\n").text(path)
    return files.read_listings_json(spark, path)


def json_to_csv(spark, sf):
    source, target = scratch_path(spark, "listings-json"), scratch_path(spark, "listings-csv")
    files.write_json(I.listings(spark, sf).select(*_BATCH), source, compression="gzip")
    files.json_to_csv(spark, source, target, as_array=False)
    return files.read_listings_csv(spark, target)


# CSV keeps no difference between an empty text and none.
JSON_TO_CSV = f"""
WITH {I.LISTINGS_SQL}
SELECT author, flair, brand, frag_name, size, price, fill_percent,
  nullif(status, '') AS status
FROM listings
"""


def nan_to_null(spark, sf):
    raw = I.table(spark, sf, "events").selectExpr(
        "event_id",
        "CASE WHEN event_type = 'error' THEN CAST('NaN' AS DOUBLE) ELSE value END AS value",
        "CASE WHEN event_type = 'view' THEN CAST('NaN' AS FLOAT) ELSE CAST(1 AS FLOAT) END AS f",
    )
    return files.without_nan(raw)


NAN_TO_NULL = """
SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value,
  CASE WHEN event_type <> 'view' THEN CAST(1 AS FLOAT) END AS f
FROM events
"""


def table_probe(spark, sf):
    """The count, and whether the sample is a row of the table."""
    customers = I.table(spark, sf, "customer").select("c_custkey", "c_name")
    probed = files.probe(customers)
    name = F.get_json_object("sample", "$.c_name").alias("c_name")
    found = probed.select("row_count", name).join(customers.select("c_name").distinct(), "c_name", "left_semi")
    return found.select("row_count", F.lit(True).alias("sample_is_a_row"))


TABLE_PROBE = "SELECT count(*) AS row_count, true AS sample_is_a_row FROM customer"

# ---- keyed rows --------------------------------------------------------------------

_USER = {
    "user_id": "user_id",
    "event_type": "event_type",
    "value": "value",
    "ts": "ts",
    "event_id": "event_id",
    "first_seen": "ts",
}


def _user_rows(spark, sf):
    return I.table(spark, sf, "events").selectExpr(*[f"{s} AS {n}" for n, s in _USER.items()])


def _old_users(spark, sf):
    """State before the batch: the clicks, one row per user, with a column of its own."""
    rows = _user_rows(spark, sf).filter("event_type = 'click'")
    best = rows.groupBy("user_id").agg(
        F.max(F.struct("event_id", "event_type", "value", "ts")).alias("r"),
        F.min("ts").alias("first_seen"),
        F.sum("value").alias("clicked"),
    )
    return best.select(
        "user_id", "r.event_type", "r.value", "r.ts", "r.event_id", "first_seen",
        F.round("clicked", DIGITS).alias("clicked"),
    )


def upsert_latest(spark, sf):
    batch = _user_rows(spark, sf).filter("event_type <> 'click'")
    merged = merge_by_key(
        _old_users(spark, sf), batch, ["user_id"], ["first_seen"], [F.col("event_id")]
    )
    return merged.withColumnRenamed("_change", "change")


_UPSERT_SQL = """
old AS (
  SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value,
    max_by(ts, event_id) AS ts, max(event_id) AS event_id, min(ts) AS first_seen,
    round(sum(value), 4) AS clicked
  FROM events WHERE event_type = 'click' GROUP BY user_id),
new AS (
  SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value,
    max_by(ts, event_id) AS ts, max(event_id) AS event_id, min_by(ts, event_id) AS first_seen
  FROM events WHERE event_type <> 'click' GROUP BY user_id),
merged AS (
  SELECT coalesce(new.user_id, old.user_id) AS user_id,
    CASE WHEN new.user_id IS NULL THEN old.event_type ELSE new.event_type END AS event_type,
    CASE WHEN new.user_id IS NULL THEN old.value ELSE new.value END AS value,
    CASE WHEN new.user_id IS NULL THEN old.ts ELSE new.ts END AS ts,
    CASE WHEN new.user_id IS NULL THEN old.event_id ELSE new.event_id END AS event_id,
    CASE WHEN old.user_id IS NULL THEN new.first_seen ELSE old.first_seen END AS first_seen,
    old.clicked AS clicked,
    CASE WHEN new.user_id IS NULL THEN 'kept' WHEN old.user_id IS NULL THEN 'inserted'
      ELSE 'modified' END AS change
  FROM old FULL JOIN new ON old.user_id = new.user_id)
"""
UPSERT_LATEST = f"WITH {_UPSERT_SQL} SELECT * FROM merged"


def keyed_table(spark, sf):
    """The same upsert through a stored table: two commits, then the second one again."""
    old = _old_users(spark, sf)
    table = KeyedTable(
        spark, scratch_path(spark, "users"), old.schema, ["user_id"], ["first_seen"]
    )
    table.upsert(old)
    batch = _user_rows(spark, sf).filter("event_type <> 'click'")
    for _ in range(2):
        table.upsert(batch, order=[F.col("event_id")])
    return table.read()


KEYED_TABLE = f"WITH {_UPSERT_SQL} SELECT * EXCLUDE (change) FROM merged"


def history_keep_first(spark, sf):
    """Old feed plus new feed, first row per address; one address is very frequent."""
    rows = I.table(spark, sf, "events").selectExpr(
        "CASE WHEN event_type = 'click' THEN 'all clicks' ELSE CAST(user_id AS VARCHAR(20)) END "
        "AS url",
        "event_id",
        "event_type",
        "value",
    )
    late = F.col("value") < 5
    return keep_first(rows.filter(late), rows.filter(~late), ["url"], "event_id")


HISTORY_KEEP_FIRST = """
WITH feed AS (
  SELECT CASE WHEN event_type = 'click' THEN 'all clicks' ELSE CAST(user_id AS VARCHAR) END AS url,
    event_id, event_type, value FROM events)
SELECT url, event_id, event_type, value FROM feed
QUALIFY row_number() OVER (PARTITION BY url ORDER BY value >= 5, event_id) = 1
"""


def newest_n(spark, sf):
    return J.newest_posts(I.sale_posts(spark, sf), 10).select("url", "title", "date")


NEWEST_N = f"""
WITH {I.SALE_POSTS_SQL}
SELECT url, title, date FROM posts ORDER BY date DESC, url LIMIT 10
"""


def newest_stream(spark, sf):
    """The newest posts of a feed whose files land out of order, a file at a time, the latest files first."""
    root = scratch_path(spark, "feed")
    # Each file is a batch of its own.
    posts = I.sale_posts(spark, sf, dealt=False).withColumn("scraped_at", F.lit(I.EARLIER).cast("timestamp"))
    for part in (2, 0, 1):
        posts.filter(F.pmod(F.xxhash64("url"), F.lit(3)) == part).write.mode("append").json(f"{root}/landing")
    feed = J.read_landing(spark, f"{root}/landing", files_per_batch=1, latest_first=True, max_file_age="7d")
    newest = J.NewestPosts(spark, f"{root}/newest", 10)
    newest.start(feed, f"{root}/checkpoint").awaitTermination()
    return newest.read().select("url", "title", "date")


# ---- ingest --------------------------------------------------------------------------


def _feed(spark, sf):
    """Sale posts as they land: every post once, the sellers' open ones again later, as sold."""
    posts = I.sale_posts(spark, sf).withColumn("scraped_at", F.lit(I.EARLIER).cast("timestamp"))
    again = (
        posts.filter(F.col("flair").isNotNull())
        .withColumn("body", F.concat(F.lit("~~"), "body"))
        .withColumn("scraped_at", F.lit(I.NOW).cast("timestamp"))
    )
    lost = posts.filter(F.col("flair").isNull()).withColumn("url", F.lit(""))
    return posts, again.unionByName(lost)


_FEED_SQL = f"""
{I.SALE_POSTS_SQL.replace("posts AS", "first_posts AS")},
posts AS (
  SELECT title, CASE WHEN flair IS NULL THEN body ELSE '~~' || body END AS body, author, flair,
    date, url,
    CAST(CASE WHEN flair IS NULL THEN '{I.EARLIER}' ELSE '{I.NOW}' END AS TIMESTAMP) AS scraped_at
  FROM first_posts)
"""


def _both(spark, sf):
    first, second = _feed(spark, sf)
    return first.unionByName(second)


def ingest_posts(spark, sf):
    rows = J.post_rows(J.enrich_posts(_both(spark, sf)))
    return rows.drop("body")


INGEST_POSTS = f"""
WITH {_FEED_SQL}, {extracted_sql("any")},
counts AS (SELECT post_url AS url, count(*) AS n FROM extracted GROUP BY post_url)
SELECT title, author, flair, date, url, scraped_at, 'reddit' AS source,
  'fragranceswap' AS subreddit, 'rules' AS cleaned_with,
  coalesce(n, 0) AS cleaned_listing_count, scraped_at AS created_in_db_at
FROM posts LEFT JOIN counts USING (url)
"""


def ingest_listings(spark, sf):
    return J.listing_rows(J.enrich_posts(_both(spark, sf))).drop("post_title", "raw_text")


_LISTING_COLUMNS = """
  author, flair, brand, frag_name, size_ml, price_usd, fill_percent, status, post_url, post_date,
  listing_key
"""
INGEST_LISTINGS = f"""
WITH {_FEED_SQL}, {extracted_sql("any")}
SELECT {_LISTING_COLUMNS}, scraped_at, 'rules' AS cleaned_with, scraped_at AS created_in_db_at
FROM extracted JOIN (SELECT url AS post_url, scraped_at FROM posts) USING (post_url)
"""


# Extractor replies: two batches for every sale post of a seller, one of them struck out.
_REPLY_BATCHES = {
    "url": "url",
    "batch": "1",
    "reply": "'[{\"frag_name\": \"' || author || '\", \"price_usd\": ' || "
    "CAST(CAST(date AS INT) AS VARCHAR(20)) || '}]'",
}
_FIRST_BATCH = {
    "url": "url",
    "batch": "0",
    "reply": "'So: [{\"brand\": \"Creed\", \"size_ml\": 50, \"raw_text\": \"~~x~~\", "
    "\"status\": \"LISTED\"}, {\"brand\": null}]'",
}


def ingest_replies(spark, sf):
    """Listings of the doc posts from replies, not from the rules."""
    posts = I.doc_posts(spark, sf).withColumn("scraped_at", F.lit(I.NOW).cast("timestamp"))
    batches = [
        posts.selectExpr(*[f"{sql} AS {name}" for name, sql in fields.items()])
        for fields in (_REPLY_BATCHES, _FIRST_BATCH)
    ]
    enriched = J.enrich_posts(
        posts, cleaned_with="extractor", replies=batches[0].unionByName(batches[1])
    )
    return J.listing_rows(enriched).select(
        "listing_key", "brand", "frag_name", "size_ml", "price_usd", "status", "cleaned_with"
    )


INGEST_REPLIES = f"""
WITH {I.DOC_POSTS_SQL}
SELECT url || '#' || n AS listing_key, CASE n WHEN 0 THEN 'Creed' END AS brand,
  CASE n WHEN 2 THEN author END AS frag_name,
  CASE n WHEN 0 THEN CAST(50 AS DOUBLE) END AS size_ml, CASE n WHEN 2 THEN date END AS price_usd,
  CASE n WHEN 0 THEN 'SOLD' END AS status, 'extractor' AS cleaned_with
FROM posts, (SELECT unnest([0, 1, 2]) AS n) WHERE contains(upper(title), '[WTS]')
"""


def _tables(spark):
    root = scratch_path(spark, "ingest")
    return J.Ingest(
        J.posts_table(spark, f"{root}/posts"),
        J.listings_table(spark, f"{root}/listings"),
    )


def ingest_summary(spark, sf):
    """Counts of two ingest runs, the second with newer versions of posts."""
    job = _tables(spark)
    for batch in _feed(spark, sf):
        job.run(batch)
    return spark.createDataFrame(
        [(i, *[int(s[c]) for c in _COUNTS]) for i, s in enumerate(job.summaries)],
        "run int, " + ", ".join(f"{c} bigint" for c in _COUNTS),
    )


_COUNTS = (
    "scraped", "skipped_without_url", "posts_upserted", "posts_modified", "listings_extracted",
    "listings_upserted", "listings_modified",
)
INGEST_SUMMARY = f"""
WITH {_FEED_SQL}, {extracted_sql("any")}
SELECT 0 AS run, (SELECT count(*) FROM posts) AS scraped, CAST(0 AS BIGINT) AS skipped_without_url,
  (SELECT count(*) FROM posts) AS posts_upserted, CAST(0 AS BIGINT) AS posts_modified,
  (SELECT count(*) FROM extracted) AS listings_extracted,
  (SELECT count(*) FROM extracted) AS listings_upserted, CAST(0 AS BIGINT) AS listings_modified
UNION ALL
SELECT 1, (SELECT count(*) FROM posts), (SELECT count(*) FROM posts WHERE flair IS NULL), 0, (SELECT count(*) FROM posts WHERE flair IS NOT NULL),
  (SELECT count(*) FROM extracted WHERE flair IS NOT NULL), 0,
  (SELECT count(*) FROM extracted WHERE flair IS NOT NULL)
"""


POSTS_PER_FILE = 50_000


def _landed(spark, sf, feed, folder):
    """Land the batches of a feed as packed files; returns the number of files of each."""
    # A packed file is read by one task. Every batch has as many posts as there are order lines.
    number = max(2, -(-I.table(spark, sf, "lineitem").count() // POSTS_PER_FILE))
    for batch in feed:
        files.write_json(batch.repartition(number, "url"), folder, mode="append", compression="gzip")
    return number


def _streamed(spark, sf, feed):
    """The listing table after a stream over landed files, several batches of them."""
    root = scratch_path(spark, "stream")
    number = _landed(spark, sf, feed, f"{root}/landing")
    job = _tables(spark)
    posts = J.read_landing(spark, f"{root}/landing", files_per_batch=number)
    query = J.start(posts, job, f"{root}/checkpoint")
    query.awaitTermination()
    return job.listings.read().drop("post_title", "raw_text")


def ingest_stream(spark, sf):
    return _streamed(spark, sf, _feed(spark, sf))


def ingest_reversed(spark, sf):
    """The newer versions land first: the older ones replace nothing."""
    return _streamed(spark, sf, reversed(_feed(spark, sf)))


INGEST_STREAM = f"""
WITH {_FEED_SQL}, {extracted_sql("any")}
SELECT {_LISTING_COLUMNS}, scraped_at, 'rules' AS cleaned_with,
  CAST('{I.EARLIER}' AS TIMESTAMP) AS created_in_db_at
FROM extracted JOIN (SELECT url AS post_url, scraped_at FROM posts) USING (post_url)
"""


_FEW_ALERTS = {
    "alert_id": "CAST(n_nationkey AS VARCHAR(20))",
    "email": "n_name",
    "type": "CASE WHEN n_regionkey < 2 THEN 'Rare' ELSE 'deal' END",
    "target_name": "upper(p_name)",
    "threshold": "CAST(n_regionkey AS DOUBLE) / 100",
    "created_at": f"CAST('{I.EARLIER}' AS TIMESTAMP)",
    "active": "n_nationkey <> 3",
}


def stream_alerts(spark, sf):
    """The whole chain on a stream: ingest, match alerts against the index, queue events."""
    root = scratch_path(spark, "chain")
    number = _landed(spark, sf, _feed(spark, sf), f"{root}/landing")
    job = _tables(spark)
    job.alerts = J.alerts_table(spark, f"{root}/alerts")
    job.index = market.index_table(spark, f"{root}/index")
    job.events = J.events_table(spark, f"{root}/events")
    nations = I.table(spark, sf, "nation").join(
        I.table(spark, sf, "part"), F.expr("n_nationkey = p_partkey")
    )
    job.alerts.upsert(nations.selectExpr(*[f"{s} AS {n}" for n, s in _FEW_ALERTS.items()]))
    market.publish(job.index, catalogue_index(spark, sf))
    posts = J.read_landing(spark, f"{root}/landing", files_per_batch=number)
    J.start(posts, job, f"{root}/checkpoint").awaitTermination()
    return job.events.read().select(
        "event_key", "alert_type", "target_name", "listing.price_usd", "matched_at",
        "notified_at", "created_at",
    )


STREAM_ALERTS = f"""
{CATALOGUE_INDEX_CHAIN}, {_FEED_SQL}, {extracted_sql("any")},
published AS (
  SELECT * FROM index_rows
  QUALIFY row_number() OVER (PARTITION BY reddit_name ORDER BY brand DESC) = 1),
few AS (
  SELECT {", ".join(f"{s} AS {n}" for n, s in _FEW_ALERTS.items())}
  FROM nation JOIN part ON n_nationkey = p_partkey),
ready AS (
  SELECT alert_id, upper(type) AS alert_type, target_name, threshold,
    {S.search_text("target_name")} AS target
  FROM few WHERE active),
baseline AS (
  SELECT target, weighted_avg_price AS a, weighted_std_dev AS d
  FROM (SELECT DISTINCT target FROM ready)
  JOIN published ON contains({S.search_text("reddit_name")}, target)
  QUALIFY row_number() OVER (PARTITION BY target ORDER BY brand, reddit_name) = 1),
hay AS (
  SELECT listing_key, price_usd, flair, {S.search_text("brand")} || ' ' || {S.search_text("frag_name")}
    || ' ' || {S.search_text("raw_text")} || ' ' || {S.search_text("post_title")} AS hay
  FROM extracted)
SELECT alert_id || ':' || listing_key AS event_key, alert_type, target_name, price_usd,
  -- Judged again only with a newer version of its post.
  CAST(CASE WHEN flair IS NULL THEN '{I.EARLIER}' ELSE '{I.NOW}' END AS TIMESTAMP) AS matched_at,
  CAST(NULL AS TIMESTAMP) AS notified_at, CAST('{I.EARLIER}' AS TIMESTAMP) AS created_at
FROM ready LEFT JOIN baseline USING (target) JOIN hay ON contains(hay, target)
WHERE alert_type = 'RARE' OR price_usd <= a - threshold * d
"""

QUERIES = {
    "posts_csv": (posts_csv, POSTS_CSV),
    "retail_csv": (retail_csv, RETAIL_CSV),
    "listings_json": (listings_json, LISTINGS_JSON),
    "listings_json_array": (listings_json_array, LISTINGS_JSON),
    "json_to_csv": (json_to_csv, JSON_TO_CSV),
    "nan_to_null": (nan_to_null, NAN_TO_NULL),
    "table_probe": (table_probe, TABLE_PROBE),
    "upsert_latest": (upsert_latest, UPSERT_LATEST),
    "keyed_table": (keyed_table, KEYED_TABLE),
    "history_keep_first": (history_keep_first, HISTORY_KEEP_FIRST),
    "newest_n": (newest_n, NEWEST_N),
    "newest_stream": (newest_stream, NEWEST_N),
    "ingest_posts": (ingest_posts, INGEST_POSTS),
    "ingest_listings": (ingest_listings, INGEST_LISTINGS),
    "ingest_replies": (ingest_replies, INGEST_REPLIES),
    "ingest_summary": (ingest_summary, INGEST_SUMMARY),
    "ingest_stream": (ingest_stream, INGEST_STREAM),
    "ingest_reversed": (ingest_reversed, INGEST_STREAM),
    "files_to_index": (files_to_index, FILES_TO_INDEX),
    "stream_alerts": (stream_alerts, STREAM_ALERTS),
}
