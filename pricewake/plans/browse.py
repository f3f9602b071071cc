"""Reading the index: listing, search, suggestions and display columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewake.functions import pricing as P
from pricewake.sources.files import without_nan

# --- fixed values ---
LISTED = [
    "brand", "reddit_name", "jomashop_name", "jomashop_price", "jomashop_url",
    "weighted_avg_price", "weighted_std_dev", "listing_count", "weighted_price_diff",
]
BRAND_SUGGESTIONS = 3
NAME_SUGGESTIONS = 5
TRENDING = 5
# --- end of fixed values ---


def _order() -> list[Column]:
    """Best deals first, rows without a difference before them."""
    return [F.asc_nulls_first("weighted_price_diff"), F.asc("reddit_name"), F.asc("brand")]


def listing(index: DataFrame) -> DataFrame:
    return without_nan(index.select(*LISTED)).orderBy(*_order())


def _has(column: str, term: str) -> Column:
    return F.coalesce(F.contains(F.lower(column), F.lower(F.lit(term))), F.lit(False))


def search(index: DataFrame, term: str) -> DataFrame:
    """Rows whose name or brand contains the term; an empty term finds all."""
    rows = without_nan(index.select(*LISTED))
    return rows.filter(_has("reddit_name", term) | _has("brand", term)).orderBy(*_order())


def suggest_brands(index: DataFrame, term: str, limit: int = BRAND_SUGGESTIONS) -> DataFrame:
    """Matching brands in the order in which the listing first shows them."""
    rows = without_nan(index.select("brand", "reddit_name", "weighted_price_diff"))
    # False before true: a missing difference comes first, as in the listing.
    place = F.struct(
        F.col("weighted_price_diff").isNotNull().alias("known"),
        "weighted_price_diff",
        "reddit_name",
    )
    return (
        rows.filter((F.col("brand") != "") & _has("brand", term))
        .groupBy("brand")
        .agg(F.min(place).alias("_place"))
        .orderBy("_place", "brand")
        .limit(limit)
        .select("brand")
    )


def suggest_names(index: DataFrame, term: str, limit: int = NAME_SUGGESTIONS) -> DataFrame:
    rows = without_nan(index.select(*LISTED))
    return (
        rows.filter(_has("reddit_name", term))
        .orderBy(*_order())
        .limit(limit)
        .select("reddit_name", "brand")
    )


def trending(index: DataFrame, limit: int = TRENDING) -> DataFrame:
    rows = without_nan(index.select(*LISTED))
    return rows.orderBy(*_order()).limit(limit).select("reddit_name", "weighted_avg_price")


def display(index: DataFrame, sigmas: float = 1.0) -> DataFrame:
    """Whole-dollar figures, volatility bar, badge and alert quote per row."""
    avg, std = F.col("weighted_avg_price"), F.col("weighted_std_dev")
    return without_nan(index).select(
        "reddit_name",
        "brand",
        F.round(avg, 0).alias("market_price"),
        F.round(std, 0).alias("spread"),
        F.round("jomashop_price", 0).alias("retail_price"),
        P.volatility(avg, std).alias("volatility"),
        P.deal_badge(F.col("jomashop_price"), F.col("weighted_price_diff")).alias("badge"),
        P.target_quote(avg, std, sigmas).alias("quote"),
        P.quote_text(P.target_quote(avg, std, sigmas)).alias("quote_text"),
    )
