"""Records of large files whose records can hold the separator: CSV with quoted line breaks, JSON arrays.

A file is read in the blocks that Spark makes of it, as pieces between separators. Whether a piece starts inside a
quoted text, and how deep in objects, depends on everything before it. So one pass sums every block up: where it
ends if it starts outside a quoted text, and where if inside. A block's sums are one row; composed along each file they
give the true start of every block. The second pass cuts each block into records on its own. Records that cross
blocks come as fragments, at most two a block, which are joined at the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewake.session import written

# A record without a quoted end runs to the end of its file.
_FIELD_END = re.compile(r'(?:[^"]|"")*"(?!")')
_ESCAPED = re.compile(r"\\.", re.DOTALL)


class CsvLines:
    """Pieces are lines; a record ends with a line that ends outside quotes."""

    separator = "\n"
    headed = True

    @staticmethod
    def after(piece: str, quoted: bool) -> tuple[bool, int]:
        """Whether the piece ends inside quotes, and the change of depth (none)."""
        if '"' not in piece:
            return quoted, 0
        at = 0
        while True:
            if quoted:
                end = _FIELD_END.match(piece, at)
                if end is None:
                    return True, 0
                at = end.end()
            # Quotes open at the start of a field only.
            elif piece.startswith('"', at):
                quoted, at = True, at + 1
                continue
            at = piece.find(",", at) + 1
            quoted = False
            if not at:
                return False, 0

    @staticmethod
    def whole(quoted: bool, depth: int) -> bool:
        return not quoted

    @staticmethod
    def record(text: str) -> str | None:
        text = text.removesuffix("\r").replace("\r\n", "\n")
        return text or None


class JsonObjects:
    """Pieces end before a closing brace; a record is an object that stands in nothing but the array."""

    separator = "}"
    headed = False

    @staticmethod
    def after(piece: str, quoted: bool) -> tuple[bool, int]:
        if "\\" in piece:
            piece = _ESCAPED.sub("", piece)
        # Every second part stands outside quotes.
        parts = piece.split('"')
        depth = "".join(parts[quoted::2]).count("{")
        quoted = quoted == (len(parts) % 2 == 1)
        return quoted, depth if quoted else depth - 1

    @staticmethod
    def whole(quoted: bool, depth: int) -> bool:
        return not quoted and depth <= 0

    @staticmethod
    def record(text: str) -> str | None:
        start = text.find("{")
        # Behind the last object stands the end of the array only.
        return text[start:] + "}" if start >= 0 else None


def _pieces(spark: SparkSession, path: str, kind) -> DataFrame:
    """(file, block, line, value); files and folders are named as Spark names them and never opened by that name."""
    return spark.read.text(path, lineSep=kind.separator).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(file, block, place in the block, row, value) of rows that come in order."""
    last, place = None, 0
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("file", "block", "value")]
        for i, (file, block, value) in enumerate(zip(*columns, strict=True)):
            place = place + 1 if (file, block) == last else 0
            last = (file, block)
            yield file, block, place, (batch, i), value or ""


def _summed(pieces: DataFrame, kind) -> DataFrame:
    """One row per block: (file, block, out_quoted, out_depth, in_quoted, in_depth, header)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["file", "block", "out_quoted", "out_depth", "in_quoted", "in_depth", "header"],
            )

        for file, block, place, _, value in _runs(batches):
            if place == 0:
                if len(rows) >= 1000:
                    yield out()
                    rows.clear()
                # The first line of a file is read whole into its row.
                rows.append([file, block, False, 0, True, 0, value if kind.headed and block == 0 else None])
            row = rows[-1]
            for at in (2, 4):
                row[at], change = kind.after(value, row[at])
                row[at + 1] += change
        yield out()

    schema = "file string, block long, out_quoted boolean, out_depth long, in_quoted boolean, in_depth long, header string"
    return pieces.select("file", "block", "value").mapInArrow(add, schema)


def _starts(sums: DataFrame) -> DataFrame:
    """(file, block, quoted, depth, header): how every block starts. A group has one row per block of a file."""

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        quoted, depth, starts = False, 0, []
        for row in rows.itertuples():
            starts.append((quoted, depth))
            quoted, change = (row.in_quoted, row.in_depth) if quoted else (row.out_quoted, row.out_depth)
            depth += change
        # Each block with the header of its file.
        return pd.DataFrame(
            {
                "file": rows.file,
                "block": rows.block,
                "quoted": [bool(q) for q, _ in starts],
                "depth": [d for _, d in starts],
                "header": rows.header.iloc[0],
            }
        )

    return sums.groupBy("file").applyInPandas(compose, "file string, block long, quoted boolean, depth long, header string")


def _cut(placed: DataFrame, kind) -> DataFrame:
    """(file, block, place, header, part, record): whole records, and the first and last fragments of blocks.

    ``part`` is ``whole``, ``end`` (of a record that began before), ``start`` or ``middle``.
    """
    names = ["file", "block", "place", "header", "part", "record"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now = None
        held: list[str] = []
        quoted, depth, since, begun, header = False, 0, 0, False, None

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
            )

        def close() -> None:
            if held:
                rows.append((*now, since, header, "start" if begun else "middle", kind.separator.join(held)))
                held.clear()

        for file, block, place, (batch, i), value in _runs(batches):
            if place == 0:
                close()
                now = (file, block)
                quoted, depth = batch.column("quoted")[i].as_py(), batch.column("depth")[i].as_py()
                header = batch.column("header")[i].as_py()
                # A block that starts within a record first gives the end of that.
                begun, since = kind.whole(quoted, depth), 0
            if not held:
                since = place
            held.append(value)
            quoted, change = kind.after(value, quoted)
            depth += change
            if kind.whole(quoted, depth):
                text = kind.separator.join(held)
                record = kind.record(text) if begun else text
                if record is not None:
                    rows.append((*now, since, header, "whole" if begun else "end", record))
                held.clear()
                begun = True
            if len(rows) >= 4096:
                yield out()
                rows.clear()
        close()
        yield out()

    return placed.mapInArrow(
        cut, "file string, block long, place long, header string, part string, record string"
    )


def _joined(fragments: DataFrame, kind) -> DataFrame:
    """Records that cross blocks, from fragments: at most two rows a block."""
    along = Window.partitionBy("file").orderBy("block", "place")
    begin = F.when(F.col("part") == "start", F.struct("block", "place"))
    owner = F.last(begin, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    text = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("block", "place", "record"))), lambda r: r["record"]),
        kind.separator,
    )
    clean = F.udf(kind.record, "string", useArrow=False)
    return (
        fragments.withColumn("owner", owner)
        .groupBy("file", "header", "owner")
        .agg(text.alias("record"))
        .select("file", "owner.block", "owner.place", "header", clean("record").alias("record"))
        .filter(F.col("record").isNotNull())
    )


def records(spark: SparkSession, path: str, kind) -> DataFrame:
    """(file, block, place, header, record) of all files below a path; large files are read by many tasks.

    ``header`` is the first line of a file of lines, null in others. The record's place is where it starts, so that (file, block, place)
    orders the records of a file. Empty lines are no records. The sums of the blocks are written below
    ``spark.checkpoint.dir``; they meet the pieces in a join that the planner broadcasts as long as they are few.
    """
    pieces = _pieces(spark, path, kind)
    starts = written(_starts(_summed(pieces, kind)), "block-starts")
    placed = pieces.join(starts, ["file", "block"]).sortWithinPartitions("file", "block", "line")
    found = written(_cut(placed.select("file", "block", "value", "quoted", "depth", "header"), kind), "records")
    # One record a block at most; written, as the records are read several times.
    crossing = written(_joined(found.filter(F.col("part") != "whole"), kind), "crossing-records")
    return found.filter(F.col("part") == "whole").drop("part").unionByName(crossing)


def headers(found: DataFrame, most: int) -> list[tuple[str, str]]:
    """The different headers with the first file of each; more than ``most`` are an error."""
    rows = found.groupBy("header").agg(F.min("file").alias("file")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} different headers")
    return sorted((row["file"], row["header"]) for row in rows)
