"""Declared schemas of every table. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
}


def _schema(columns: str) -> T.StructType:
    """Columns as ``name type, ...``; usable before there is a session."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


POSTS_RAW = _schema(
    "title string, body string, author string, flair string, date double, url string"
)
POSTS = _schema(
    "title string, body string, author string, flair string, date double, url string, "
    "scraped_at timestamp, source string, subreddit string, cleaned_with string, "
    "cleaned_listing_count bigint, created_in_db_at timestamp"
)
LISTINGS = _schema(
    "author string, flair string, brand string, frag_name string, size_ml double, "
    "price_usd double, fill_percent double, status string, raw_text string, "
    "post_url string, post_title string, post_date double, scraped_at timestamp, "
    "cleaned_with string, listing_key string, created_in_db_at timestamp"
)
LISTINGS_BATCH = _schema(
    "author string, flair string, brand string, frag_name string, size double, "
    "price double, fill_percent double, status string"
)
EXTRACTED = _schema(
    "author string, flair string, brand string, frag_name string, size_ml double, "
    "price_usd double, fill_percent double, status string, raw_text string"
)
RETAIL_PAGES = _schema("url string, html string")
RETAIL = _schema(
    "brand string, product string, size string, discount_price string, "
    "retail_price string, url string"
)
RETAIL_MATCH = _schema(
    "brand string, reddit_name string, jomashop_name string, match_score double, "
    "reddit_avg double, reddit_count bigint, jomashop_price double, "
    "jomashop_url string, price_diff double"
)
MARKET_INDEX = _schema(
    "brand string, reddit_name string, jomashop_name string, jomashop_price double, "
    "jomashop_url string, match_score double, weighted_avg_price double, "
    "weighted_std_dev double, listing_count bigint, weighted_price_diff double"
)
ALERTS = _schema(
    "alert_id string, email string, type string, target_name string, "
    "threshold double, created_at timestamp, active boolean"
)
_MATCHED_LISTING = _schema(
    "brand string, frag_name string, price_usd double, post_url string, raw_text string"
)
ALERT_EVENTS = T.StructType(
    [
        *_schema(
            "event_key string, alert_id string, alert_type string, email string, "
            "target_name string, listing_key string"
        ).fields,
        T.StructField("listing", _MATCHED_LISTING),
        *_schema(
            "reason string, matched_at timestamp, notified_at timestamp, "
            "resend_response string, created_at timestamp"
        ).fields,
    ]
)
# What each alert was last judged with; ``target_price`` is null where it cannot match.
ALERT_TARGETS = _schema("alert_id string, alert_type string, target string, target_price double")
# Sums from which the weighted statistics of an item follow; empty cells have n = 0.
MOMENTS = _schema("frag_name string, anchor double, n bigint, w double, s1 double, s2 double")

# Older extracts use other names for the same fields.
LISTING_RENAMES = {
    "name": "frag_name",
    "fragrance_name": "frag_name",
    "size_ml": "size",
    "price_usd": "price",
    "post_url": "url",
}


def to_batch_names(listings: DataFrame) -> DataFrame:
    """Rename the fields of any listing layout to ``frag_name, size, price, url``."""
    taken = set(listings.columns)
    renames = {
        old: new
        for old, new in LISTING_RENAMES.items()
        if old in taken and new not in taken
    }
    return listings.withColumnsRenamed(renames)
