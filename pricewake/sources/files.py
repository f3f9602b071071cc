"""File readers and writers. Every reader declares its schema."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewake import schemas
from pricewake.functions.text import nan_to_null, number
from pricewake.sources import splits

# Layouts of one kind of file that may stand side by side.
MAX_HEADERS = 1000


def _typed(name: str, kind: T.DataType) -> Column:
    """A text column as the declared type; what is no plain number is null."""
    value = F.col(name)
    return number(value).cast(kind) if isinstance(kind, T.NumericType) else value.try_cast(kind)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, required=(), ordered: bool = False
) -> DataFrame:
    """CSV files whose columns are taken by name, whatever their order in each file.

    Columns of ``schema`` that a file lacks come back as null, but a missing
    ``required`` one is an error. Numbers are plain decimals; anything else is null.
    Quoted fields hold line breaks and doubled quotes; a large file is read by many tasks all the same, and what
    crosses their borders is put together (``sources.splits``). Only the different headers reach the driver, at most
    ``MAX_HEADERS``; file names never do, and may hold any character. ``ordered`` adds ``ord``, a text that
    sorts rows by file and place.
    """
    found = splits.records(spark, path, splits.CsvLines)
    known = splits.headers(found, MAX_HEADERS)
    # The first record of a file is its header.
    body = found.filter((F.col("block") != 0) | (F.col("place") != 0))
    parsed = []
    for file, text in known:
        names = next(csv.reader([text.lstrip("\ufeff").removesuffix("\r")]), [])
        missing = [name for name in required if name not in names]
        if missing:
            raise ValueError(f"{file} has no column {', '.join(missing)}")
        fields = ", ".join(f"c{i} string" for i in range(len(names)))
        record = F.when(F.col("header") == text, F.col("record"))
        parsed.append((names, F.from_csv(record, fields, {"escape": '"', "quote": '"'})))
    columns = [f"p{i}" for i in range(len(parsed))]
    rows = body.select("*", *[parse.alias(c) for c, (_, parse) in zip(columns, parsed, strict=True)])

    def value(field: T.StructField) -> Column:
        held = [
            _typed(f"{c}.c{names.index(field.name)}", field.dataType)
            for c, (names, _) in zip(columns, parsed, strict=True)
            if field.name in names
        ]
        return (F.coalesce(*held) if held else F.lit(None).cast(field.dataType)).alias(field.name)

    place = [F.lpad(F.col(c).cast("string"), 19, "0") for c in ("block", "place")]
    order = [F.concat_ws("|", "file", *place).alias("ord")] if ordered else []
    return rows.select(*[value(field) for field in schema], *order)


def read_posts_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.POSTS_RAW, required=("title", "body"))


def read_retail_csv(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    return read_csv(spark, path, schemas.RETAIL, ("brand", "product"), ordered)


def read_listings_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.LISTINGS_BATCH)


def read_listings_json(spark: SparkSession, path: str, as_array: bool = True) -> DataFrame:
    """Extracted listings: one JSON array per file, or one object per line.

    Large files of either form are read by many tasks; the objects of an array are found by ``sources.splits``.
    """
    if not as_array:
        return spark.read.schema(schemas.LISTINGS_BATCH).json(path)
    found = splits.records(spark, path, splits.JsonObjects)
    parsed = F.from_json("record", schemas.LISTINGS_BATCH)
    return found.select(parsed.alias("row")).select("row.*")


def in_file_order(df: DataFrame) -> DataFrame:
    """Add ``ord``, a text that sorts rows by file, split and line, for "first" rules.

    For frames straight from files; a union no longer knows where its rows came from.
    """
    row = F.lpad(F.monotonically_increasing_id().cast("string"), 19, "0")
    start = F.lpad(F.col("_metadata.file_block_start").cast("string"), 19, "0")
    return df.select("*", F.concat_ws("|", F.col("_metadata.file_path"), start, row).alias("ord"))


def write_csv(df: DataFrame, path: str, columns=None, mode: str = "overwrite") -> None:
    rows = df.select(*columns) if columns else df
    rows.write.mode(mode).options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "none") -> None:
    """One object per line. A compressed file is read by one task, so there have to be many of them."""
    df.write.mode(mode).option("ignoreNullFields", False).option("compression", compression).json(path)


def write_parquet(df: DataFrame, path: str, columns=None, mode: str = "overwrite") -> None:
    (df.select(*columns) if columns else df).write.mode(mode).parquet(path)


def json_to_csv(spark: SparkSession, source: str, target: str, as_array: bool = True) -> None:
    write_csv(read_listings_json(spark, source, as_array), target)


def without_nan(df: DataFrame) -> DataFrame:
    """Every floating NaN becomes null, as stored tables know only null."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            nan_to_null(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, floating)
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def probe(df: DataFrame) -> DataFrame:
    """One row: how many rows there are, and any one of them as JSON."""
    fields = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    # Only one row of all columns is read; the count needs none of them.
    sample = df.limit(1).select(
        F.lit(0).cast("long").alias("rows"),
        F.to_json(fields, {"ignoreNullFields": "false"}).alias("sample"),
    )
    count = df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(None).cast("string").alias("sample"))
    return count.unionAll(sample).agg(F.sum("rows").alias("row_count"), F.max("sample").alias("sample"))
