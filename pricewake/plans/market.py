"""From listings and catalogue to the published market index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewake import schemas
from pricewake.operators.cleaning import clean_retail, full_bottles
from pricewake.operators.keyed import latest_by
from pricewake.operators.similarity import MIN_SCORE, match_retail
from pricewake.operators.stats import (
    merge_cells,
    plain_stats,
    signed_cells,
    stats_of_cells,
    weighted_rows,
    weighted_stats,
)
from pricewake.session import written
from pricewake.sources.files import without_nan
from pricewake.sources.tables import KeyedTable


def retail_match(listings: DataFrame, retail: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Items of full-bottle listings next to their best retail product.

    ``retail`` is the raw catalogue plus ``ord``, its row order.
    """
    return match_retail(plain_stats(full_bottles(listings)), clean_retail(retail), min_score)


def weighted_index(matched: DataFrame, stats: DataFrame) -> DataFrame:
    """Retail side joined to the weighted statistics of its item, where there are any.

    Both keys are market names. ``weighted_price_diff`` is market minus retail:
    negative means a deal.
    """
    joined = matched.join(
        stats.withColumnRenamed("frag_name", "reddit_name"), "reddit_name", "left"
    )
    diff = F.col("weighted_avg_price") - F.col("jomashop_price")
    return joined.withColumn("weighted_price_diff", diff).select(*schemas.MARKET_INDEX.names)


def market_index(listings: DataFrame, retail: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The whole chain: clean, match, weigh, join.

    The match writes its steps, so jobs run before the first action on the result.
    """
    return weighted_index(retail_match(listings, retail, min_score), weighted_stats(listings))


def index_rows(index: DataFrame) -> DataFrame:
    """Index rows as published: one per name; of two brands the last one stays."""
    return latest_by(without_nan(index), ["reddit_name"], F.col("brand"))


def index_table(spark: SparkSession, path: str, **options) -> KeyedTable:
    return KeyedTable(spark, path, schemas.MARKET_INDEX, ["reddit_name"], **options)


def publish(table: KeyedTable, index: DataFrame) -> int:
    """Upsert the index by name; returns how many rows are new or changed."""
    counts = table.upsert(index_rows(index))
    return counts["inserted"] + counts["modified"]


# ---- an index kept up to date without reading all listings ------------------------

ITEM = ["frag_name"]


def moments_table(spark: SparkSession, path: str, **options) -> KeyedTable:
    return KeyedTable(spark, path, schemas.MOMENTS, [*ITEM, "anchor"], **options)


def apply_changes(moments: KeyedTable, before: DataFrame, after: DataFrame) -> DataFrame:
    """Add a batch of changed listings to the stored sums; returns the items it touched.

    ``before`` has the listings of the batch as they were stored (those that were), ``after`` as they
    are now (those that are left), in batch names. Work and writing follow the batch: listings that did not change are
    not read. A batch is to be applied once; ``before`` equal to ``after`` changes nothing.
    """
    changes = written(
        signed_cells(weighted_rows(before), weighted_rows(after), ITEM).filter(
            (F.col("n") != 0) | (F.col("w") != 0) | (F.col("s1") != 0) | (F.col("s2") != 0)
        ),
        "moment-changes",
    )
    stored = moments.read().join(changes.select(*ITEM, "anchor"), [*ITEM, "anchor"], "left_semi")
    moments.upsert(merge_cells(stored, changes, ITEM))
    return changes.select(*ITEM).distinct()


def maintained_stats(moments: KeyedTable, items: DataFrame | None = None) -> DataFrame:
    """``weighted_stats`` of all items, or of some, from the stored sums."""
    cells = moments.read().filter(F.col("n") > 0)
    if items is not None:
        cells = cells.join(items, ITEM, "left_semi")
    return stats_of_cells(cells, ITEM)


def refresh_index(index: KeyedTable, matched: DataFrame, moments: KeyedTable, items: DataFrame) -> int:
    """Publish the index rows of some items anew; returns how many are new or changed."""
    touched = matched.join(items.withColumnRenamed("frag_name", "reddit_name"), "reddit_name", "left_semi")
    return publish(index, weighted_index(touched, maintained_stats(moments, items)))
