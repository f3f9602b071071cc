"""Proportional stratified interleaving of documents into shards, in expressions only.

Within its source every row has a rank in a seeded shuffle; the fractional rank
(rank + offset of the source) / rows of the source spreads each source evenly over [0, 1).
Ordered by it, any stretch of rows holds every source in its share, give or take one row, and the
order is cut into shards whose row counts differ by one at most.

Neither order is made by one task: rows fall into buckets of their shuffle key, then of
their fractional rank; buckets are counted, counts are summed up in order, and rows are only
ordered inside their bucket. Texts are read once and not shuffled. Rows that are equal in
all that is kept of them are one row with a number of copies until the ranks stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewake.session import written

LAW = "rows"
PER_BUCKET = 4096
UNIT = float(1 << 53)


def _fraction(*columns, seed: int):
    """A hash of the columns as a double in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11) / F.lit(UNIT)


def _bucket(fraction, buckets: int):
    return F.least(F.floor(fraction * buckets), F.lit(buckets - 1)).cast("long")


def shard_rows(
    docs: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 17,
    per_bucket: int = PER_BUCKET,
) -> DataFrame:
    """One row per document: id, ``source``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``.

    ``size`` is the text's UTF-8 bytes plus 16, the law is ``rows``: shards from 0 with row
    counts at most one apart, slots gapless from 0. A null text counts as empty; a null source is
    a source; null ids stay null; repeated rows are placed each, next to none of their copies if the
    source is large. Fewer rows than shards leave shards empty; an empty table gives no rows.
    Columns other than id, text and source are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    fields = ["id", "source", "size", "text_crc32"]
    counted = slim.groupBy(*fields).agg(F.count(F.lit(1)).alias("copies"))
    counted = written(counted.withColumn("u", _fraction("id", "size", "text_crc32", seed=seed)), "shard-rows")
    total = counted.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // per_bucket))
    placed = counted.withColumn("bucket", _bucket(F.col("u"), buckets))

    # Rank within the source: rows of earlier buckets, then the order inside the bucket.
    sizes = placed.groupBy("source", "bucket").agg(F.sum("copies").alias("rows"))
    whole = Window.partitionBy("source")
    earlier = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col("source").alias("of_source"),
        F.col("bucket").alias("of_bucket"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"),
        F.sum("rows").over(whole).alias("of_all"),
    )
    inside = (
        Window.partitionBy("source", "bucket")
        .orderBy("u", "id", "size", "text_crc32")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = placed.withColumn("within", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(
        sizes, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("bucket") == F.col("of_bucket"))
    )
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    offset = _fraction("source", seed=seed + 1)
    spread = ranked.select(*fields, "u", F.col("before").alias("b"), "within", "of_all", copy).withColumn(
        "f", (F.col("b") + F.col("within") + F.col("copy") + offset) / F.col("of_all")
    )
    spread = spread.select(*fields, "copy", "f", _bucket(F.col("f"), buckets).alias("bucket"))

    # Place in the whole order, the same way.
    spread = written(spread, "shard-spread")
    sizes = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col("bucket").alias("of_bucket"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("bucket").orderBy("f", *fields, "copy")
    number = F.col("before") + F.col("within") - 1
    placed = spread.withColumn("within", F.row_number().over(inside)).join(
        sizes, F.col("bucket") == F.col("of_bucket")
    )
    cut = placed.withColumn("at", number.cast("long")).withColumn(
        "shard", F.expr(f"at * {shards} div {max(1, total)}")
    )
    first = F.expr(f"(shard * {max(1, total)} + {shards - 1}) div {shards}")
    return cut.select(
        F.col("id").alias(id_col),
        "source",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("at") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
