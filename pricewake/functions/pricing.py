"""Price expressions: seller weight, fill, volatility, badges and quotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---
SALES = r"Sales:(\d+)"
FLAT_SALES = 15
LOG_SLOPE = 450.0
LOG_OFFSET = -993.0
VOLATILITY_SCALE = 500
VOLATILITY_MAX = 100
# --- end of fixed values ---


def seller_sales(flair: Column) -> Column:
    """Sales that a flair claims; none claimed is 0, and no flair at all counts as one sale."""
    claimed = F.regexp_extract(flair, SALES, 1).try_cast("double")
    return F.when(flair.isNull(), F.lit(1.0)).otherwise(F.coalesce(claimed, F.lit(0.0)))


def weight_of_sales(sales: Column) -> Column:
    """Trust in a seller: squared sales up to 15, then a slow logarithm."""
    return F.when(sales <= FLAT_SALES, sales * sales).otherwise(
        F.lit(LOG_SLOPE) * F.ln(sales) + F.lit(LOG_OFFSET)
    )


def seller_weight(flair: Column) -> Column:
    return weight_of_sales(seller_sales(flair))


def fill_share(fill: Column) -> Column:
    """Percent of a bottle that is left; unknown means full, more than full is full."""
    full = F.lit(100.0)
    return F.least(F.nanvl(F.coalesce(fill, full), full), full)


def full_bottle_price(price: Column, fill: Column) -> Column:
    """Price scaled to a full bottle; with none left it is unknown."""
    share = fill_share(fill)
    return F.when(share > 0, F.try_divide(price, share / 100.0))


def volatility(avg: Column, std: Column) -> Column:
    """Spread against the mean on a 0..100 bar."""
    base = F.when(F.coalesce(avg, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(avg)
    return F.least(
        F.coalesce(std, F.lit(0.0)) / base * VOLATILITY_SCALE, F.lit(float(VOLATILITY_MAX))
    )


def deal_badge(retail_price: Column, diff: Column) -> Column:
    known = (F.coalesce(retail_price, F.lit(0.0)) != 0) & (F.coalesce(diff, F.lit(0.0)) != 0)
    return F.when(known & (diff < 0), F.lit("DEAL")).when(known, F.lit("HIGH"))


def target_quote(avg: Column, std: Column, sigmas) -> Column:
    """The price a number of deviations below the mean, or null (shown as N/A)."""
    known = (F.coalesce(avg, F.lit(0.0)) != 0) & (F.coalesce(std, F.lit(0.0)) != 0)
    sigmas = sigmas if isinstance(sigmas, Column) else F.lit(float(sigmas))
    return F.when(known, F.round(avg - sigmas * std, 2))


def quote_text(quote: Column) -> Column:
    return F.when(quote.isNull(), F.lit("N/A")).otherwise(F.format_string("%.2f", quote))
