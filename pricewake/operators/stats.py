"""Market statistics per item."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewake.functions import pricing as P
from pricewake.functions.text import market_name

_STEPS_PER_OCTAVE = 16


def plain_stats(listings: DataFrame) -> DataFrame:
    """Mean, count and sample deviation of price by brand and item."""
    return (
        listings.filter(F.col("brand").isNotNull() & F.col("clean_name").isNotNull())
        .groupBy("brand", "clean_name")
        .agg(
            F.avg("price").alias("reddit_avg_price"),
            F.count("price").alias("reddit_count"),
            F.stddev_samp("price").alias("reddit_std"),
        )
    )


def weighted_rows(listings: DataFrame) -> DataFrame:
    """Rows that count towards the index: a full-bottle price and a trusted seller.

    Reads ``flair, frag_name, price, fill_percent``.
    """
    price, fill = F.col("price"), F.col("fill_percent")
    # Tested on the raw columns: a filter on the finished ones would work each
    # of them out twice.
    usable = listings.filter(
        F.col("frag_name").isNotNull()
        & price.isNotNull()
        & ~F.isnan(price)
        & (P.fill_share(fill) > 0)
    )
    sold = usable.select(
        market_name(F.col("frag_name")).alias("frag_name"),
        P.full_bottle_price(price, fill).alias("normalized_price"),
        P.seller_sales(F.col("flair")).alias("_sales"),
    )
    # Without sales there is no weight, and with any the weight is positive.
    return sold.filter(F.col("_sales") > 0).select(
        "frag_name", P.weight_of_sales(F.col("_sales")).alias("weight"), "normalized_price"
    )


def _anchor(value: Column) -> Column:
    """A round number close to the value, the same for all values near it."""
    step = F.floor(F.log2(F.abs(value)) * _STEPS_PER_OCTAVE) / _STEPS_PER_OCTAVE
    return F.coalesce(F.signum(value) * F.pow(F.lit(2.0), step), F.lit(0.0))


def moment_cells(
    rows: DataFrame,
    keys: Sequence[str],
    value: str = "normalized_price",
    weight: str = "weight",
) -> DataFrame:
    """(keys, anchor, n, w, s1, s2): sums per key and anchor, which add up over any parts of the rows.

    Squares of raw prices would cancel badly, and a second pass would read and
    shuffle every row again. Instead each row is measured from an anchor that
    its own price determines, sums are kept per (key, anchor) and combined
    before the shuffle. A key with a third of all rows shrinks to a few hundred sums in every map task.
    """
    v, w, anchor = F.col(value), F.col(weight), F.col("anchor")
    off = v - anchor
    return (
        rows.withColumn("anchor", _anchor(v))
        .groupBy(*keys, "anchor")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(w).alias("w"),
            F.sum(w * off).alias("s1"),
            F.sum(w * off * off).alias("s2"),
        )
    )


def stats_of_cells(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted mean, population deviation, count and weight of every key from its ``moment_cells``."""
    # Prices span at most a few thousand anchors, so this list is bounded.
    cell = F.struct("anchor", "w", "s1", "s2")
    merged = cells.groupBy(*keys).agg(
        F.sum("n").alias("listing_count"),
        F.array_sort(F.collect_list(cell)).alias("cells"),
    )

    def total(term) -> Column:
        return F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + term(c))

    merged = merged.withColumn("total_weight", total(lambda c: c["w"])).withColumn(
        "mean", total(lambda c: c["anchor"] * c["w"] + c["s1"]) / F.col("total_weight")
    )
    squares = total(
        lambda c: c["s2"]
        - 2 * (F.col("mean") - c["anchor"]) * c["s1"]
        + (F.col("mean") - c["anchor"]) * (F.col("mean") - c["anchor"]) * c["w"]
    )
    variance = F.greatest(squares / F.col("total_weight"), F.lit(0.0))
    return merged.select(
        *keys,
        F.col("mean").alias("weighted_avg_price"),
        F.sqrt(variance).alias("weighted_std_dev"),
        "listing_count",
        F.col("total_weight").alias("total_sales_volume_proxy"),
    )


def weighted_moments(
    rows: DataFrame,
    keys: Sequence[str],
    value: str = "normalized_price",
    weight: str = "weight",
) -> DataFrame:
    """Weighted mean and population deviation in one pass over the rows."""
    return stats_of_cells(moment_cells(rows, keys, value, weight), keys)


SUMS = ("n", "w", "s1", "s2")


def signed_cells(
    before: DataFrame,
    after: DataFrame,
    keys: Sequence[str],
    value: str = "normalized_price",
    weight: str = "weight",
) -> DataFrame:
    """What a batch of changes does to ``moment_cells``: rows as they were go out, rows as they are come in.

    An insert has no row in ``before``, a deletion none in ``after``, an edit one in each.
    """
    came = moment_cells(after, keys, value, weight)
    gone = moment_cells(before, keys, value, weight).withColumns({c: -F.col(c) for c in SUMS})
    return came.unionByName(gone).groupBy(*keys, "anchor").agg(*[F.sum(c).alias(c) for c in SUMS])


def merge_cells(cells: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored cells with signed ones added; cells without a row left have all sums zero.

    What a cell holds lies within a sixteenth of an octave of its anchor, so sums of rows that went leave
    rounding of the last digits only, and nothing once the cell is empty.
    """
    sums = cells.unionByName(changes).groupBy(*keys, "anchor").agg(*[F.sum(c).alias(c) for c in SUMS])
    full = F.col("n") > 0
    return sums.withColumns({c: F.when(full, F.col(c)).otherwise(F.col(c) * 0) for c in SUMS})


def weighted_stats(listings: DataFrame) -> DataFrame:
    return weighted_moments(weighted_rows(listings), ["frag_name"])
