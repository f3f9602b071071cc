"""Cleaning of listings and of the retail catalogue: projections and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewake.functions import text as X

# --- fixed values ---
FULL_FILL = 90
MIN_SIZE = 29
DECANT = "decant"
# --- end of fixed values ---


def coerce_numbers(df: DataFrame, *columns: str) -> DataFrame:
    """Text to double, bad numbers to null; doubles lose their NaN."""
    typed = {f.name: f.dataType for f in df.schema}
    return df.withColumns(
        {
            c: X.number(F.col(c))
            if isinstance(typed[c], T.StringType)
            else X.nan_to_null(F.col(c).cast("double"))
            for c in columns
        }
    )


def strip_strings(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            X.strip(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def tidy_rows(listings: DataFrame) -> DataFrame:
    """Trimmed text, exact copies dropped, statuses upper case with blanks as null."""
    return (
        strip_strings(listings)
        .distinct()
        .withColumn("status", X.blank_to_null(F.upper("status")))
    )


def required_rows(listings: DataFrame) -> DataFrame:
    """Rows that name an item, a size and a price, under a plain name."""
    return listings.dropna(subset=["frag_name", "size", "price"]).withColumn(
        "frag_name", X.plain_name(F.col("frag_name"))
    )


def has_price_or_size(listings: DataFrame) -> DataFrame:
    """Trimmed rows with a price or a size."""
    trimmed = listings.withColumns(
        {c: X.strip(F.col(c)) for c in ("brand", "frag_name", "status")}
    )
    return trimmed.filter(F.col("price").isNotNull() | F.col("size").isNotNull())


def full_bottles(
    listings: DataFrame, min_fill: float = FULL_FILL, min_size: float = MIN_SIZE
) -> DataFrame:
    """Listings of full bottles (columns ``brand, frag_name, size, price, fill_percent``).

    Unknown fill or size passes. Adds ``clean_name``, the key of the item.
    """
    fill, size = F.col("fill_percent"), F.col("size")
    decant = F.coalesce(F.contains(F.lower("frag_name"), F.lit(DECANT)), F.lit(False))
    return (
        coerce_numbers(listings, "price", "size", "fill_percent")
        .filter((fill >= min_fill) | fill.isNull())
        .filter((size >= min_size) | size.isNull())
        .filter(~decant)
        .withColumns(
            {
                "brand": F.upper(X.strip(F.col("brand"))),
                "frag_name": X.strip(F.col("frag_name")),
            }
        )
        .withColumn("clean_name", X.market_name(F.col("frag_name")))
    )


def clean_retail(retail: DataFrame) -> DataFrame:
    """Catalogue rows with a numeric ``price`` and the size text of the title."""
    return retail.withColumns(
        {
            "discount_price": F.translate("discount_price", "$,", ""),
            "brand": F.upper(X.strip(F.col("brand"))),
            "product": F.upper(X.strip(F.col("product"))),
        }
    ).withColumns(
        {
            "price": X.number(F.col("discount_price")),
            "extracted_size": X.retail_size(F.col("product")),
        }
    )
