"""Removal of repeated stretches of lines, in DataFrame expressions only.

A text is cut at places its own lines choose: two lines that follow each other (blank ones between them left out)
are a boundary unless the rolling hash over their hashes is a multiple of ``divisor``. What stands around a boundary, its
two lines and the blank ones between them, is the smallest multi-line chunk. It depends on nothing
else, so an inserted line moves no chunk but those it parts, and the same passage gives the same chunks wherever
it stands.

A chunk that stands elsewhere too is grown: the two lines next to it that are no boundary join in if they
are repeated as well. So a repeated passage of any length goes from its first line to its last, at all places but the
first. Chunks are counted by hash; before a line goes, its chunk's bytes are compared with those at the first place.

``drop_repeated_passages`` has no boundaries: every window of ``min_lines`` lines that are not blank counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewake.operators.membership import key_filter
from pricewake.session import written

# One pair of lines in so many is no boundary.
DIVISOR = 64
MIN_LINES = 2
# Rows of a repeated chunk that meet its first place in one group; more are dealt out.
CROWD = 256
_MODULUS = (1 << 31) - 1


def line_hash(line: Column) -> Column:
    """28 bits of the line's MD5, blanks at the ends left out."""
    return F.conv(F.substring(F.md5(F.trim(line).cast("binary")), 1, 7), 16, 10).cast("long")


def _named(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a one-element array and a lambda give it a name."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _stretch(lines: Column, start: Column, stop: Column) -> Column:
    return F.array_join(F.slice(lines, start + 1, stop - start + 1), "\n")


def line_chunks(lines: Column, divisor: int = DIVISOR) -> Column:
    """(place, start, stop, hash, boundary) of every two lines that follow each other."""

    def of(lines: Column) -> Column:
        def pairs(filled: Column) -> Column:
            def pair(first: Column, k: Column) -> Column:
                second = F.element_at(filled, k + 2)
                rolled = (first["hash"] * 31 + second["hash"]) % _MODULUS
                return F.struct(
                    k.alias("place"),
                    first["at"].alias("start"),
                    second["at"].alias("stop"),
                    F.xxhash64(_stretch(lines, first["at"], second["at"])).alias("hash"),
                    (rolled % divisor != 0).alias("boundary"),
                )

            return F.transform(F.slice(filled, 1, F.greatest(F.size(filled) - 1, F.lit(0))), pair)

        hashed = F.transform(
            lines, lambda line, i: F.when(F.trim(line) != "", F.struct(i.alias("at"), line_hash(line).alias("hash")))
        )
        return _named(F.filter(hashed, lambda line: line.isNotNull()), pairs)

    return _named(lines, of)


def _repeated(places: DataFrame) -> DataFrame:
    """The places whose hash stands at several places."""
    several = places.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("hash")
    return places.join(several, "hash", "left_semi")


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    divisor: int = DIVISOR,
) -> DataFrame:
    """One row per document: id, ``n_lines``, ``n_chunks``, ``removed_chunks``, ``removed_lines``,
    ``text`` without the removed lines.

    A chunk is removed when equal bytes stand in another place; of all places the first by id, then by line,
    keeps it. A null text stays null and has no lines; an empty text is one line. Rows equal in id and text
    are one document and are treated alike; ids that are null come first. Other columns are not read. Work on a text
    grows with its lines, however long it is. Should two different chunks share a 64-bit hash, the bytes
    tell them apart and the later one stays. Whole texts are shuffled only of documents that hold the first
    place of a repeated chunk or lose one; the rest is places and hashes. Steps are written below ``spark.checkpoint.dir``.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    rows = rows.withColumn("doc", F.xxhash64("id", "text_hash"))
    lines = F.split("text", "\n", -1)
    places = rows.filter(F.col("text").isNotNull()).select(
        "doc", "id", "text_hash", F.inline(line_chunks(lines, divisor))
    )
    anchors = written(_repeated(places.filter("boundary")), "repeated-chunks")
    # The neighbours of repeated chunks that are no boundary themselves.
    beside = anchors.select("doc", F.explode(F.array(F.col("place") - 1, F.col("place") + 1)).alias("place"))
    grown = _repeated(places.filter(~F.col("boundary")).join(beside.distinct(), ["doc", "place"], "left_semi"))
    again = written(anchors.unionByName(grown.select(anchors.columns)), "again")

    at = F.struct("id", "text_hash", "start")
    firsts = written(
        again.groupBy("hash")
        .agg(
            F.min(F.struct(at.alias("at"), "doc", "stop")).alias("first"),
            F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("parts"),
        )
        .select("hash", "first.at", "first.doc", "first.stop", "parts"),
        "first-places",
    )
    kept_there = firsts.groupBy("doc").agg(F.collect_set(F.struct("hash", "at.start", "stop")).alias("holds"))
    first_doc = key_filter(firsts.select("doc").distinct(), "doc")
    # Equal rows are one document, and give the same bytes twice.
    chunks = (
        rows.filter(first_doc(F.col("doc")))
        .join(kept_there, "doc")
        .select(
            F.inline(
                _named(
                    lines,
                    lambda lines: F.transform(
                        "holds",
                        lambda c: F.struct(c["hash"].alias("hash"), _stretch(lines, c["start"], c["stop"]).alias("chunk")),
                    ),
                )
            )
        )
        .groupBy("hash")
        .agg(F.min("chunk").alias("chunk"))
    )
    # A chunk that very many documents hold is dealt out by document. Unhinted: the planner broadcasts the
    # few crowded hashes if they are few, else splits them.
    crowded = firsts.filter("parts > 1").select("hash", "parts")
    salt = F.pmod(F.col("doc"), F.coalesce("parts", F.lit(1))).cast("int")
    known = firsts.select("hash", "at", "parts").join(chunks, "hash").select(
        "hash", "at", "chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")
    )
    removed = (
        again.select("doc", "hash", "start", "stop", at.alias("here"))
        .join(crowded, "hash", "left")
        .withColumn("salt", salt)
        .join(known, ["hash", "salt"])
        .filter(~F.col("here").eqNullSafe(F.col("at")))
        .groupBy("doc")
        .agg(F.collect_set(F.struct("start", "stop", "chunk")).alias("found"))
    )
    removed = written(removed, "removed")
    loses = key_filter(removed.select("doc"), "doc")

    def valid(lines: Column) -> Column:
        return F.filter("found", lambda c: _stretch(lines, c["start"], c["stop"]) == c["chunk"])

    def left(lines: Column) -> Column:
        gone = F.flatten(F.transform("gone", lambda c: F.sequence(c["start"], c["stop"])))
        stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.transform(stays, lambda i: F.element_at(lines, i + 1))

    none = F.col("text").isNull()
    n_lines = F.when(none, 0).otherwise(F.size(lines)).cast("long").alias("n_lines")
    n_chunks = F.size(F.filter(line_chunks(lines, divisor), lambda c: c["boundary"]))
    n_chunks = F.when(none, 0).otherwise(n_chunks).cast("long").alias("n_chunks")
    touched = (
        rows.filter(loses(F.col("doc")))
        .join(removed, "doc", "left")
        .withColumn("gone", F.when(F.col("found").isNotNull(), _named(lines, valid)))
        .withColumn("kept", F.when(F.col("gone").isNotNull(), _named(lines, left)))
    )
    whole = F.col("kept").isNull()
    changed = touched.select(
        F.col("id").alias(id_col),
        n_lines,
        n_chunks,
        F.when(whole, 0).otherwise(F.size("gone")).cast("long").alias("removed_chunks"),
        F.when(whole, 0).otherwise(F.size(lines) - F.size("kept")).cast("long").alias("removed_lines"),
        F.when(whole, F.col("text")).otherwise(F.array_join("kept", "\n")).alias("text"),
    )
    zero = F.lit(0).cast("long")
    untouched = rows.filter(~loses(F.col("doc"))).select(
        F.col("id").alias(id_col),
        n_lines,
        n_chunks,
        zero.alias("removed_chunks"),
        zero.alias("removed_lines"),
        "text",
    )
    return changed.unionByName(untouched)


def line_windows(lines: Column, min_lines: int) -> Column:
    """(start, stop, key) of every ``min_lines`` consecutive lines that are not blank, blank ones between
    them included; the key is the SHA-256 of the bytes."""

    def windows(lines: Column) -> Column:
        def of(filled: Column) -> Column:
            def window(start: Column, k: Column) -> Column:
                stop = F.element_at(filled, k + min_lines)
                text = F.array_join(F.slice(lines, start + 1, stop - start + 1), "\n")
                return F.struct(
                    start.alias("start"), stop.alias("stop"), F.unhex(F.sha2(text, 256)).alias("key")
                )

            return F.transform(F.slice(filled, 1, F.greatest(F.size(filled) - (min_lines - 1), F.lit(0))), window)

        numbers = F.transform(lines, lambda line, i: F.when(F.trim(line) != "", i))
        return F.element_at(F.transform(F.array(F.filter(numbers, lambda i: i.isNotNull())), of), 1)

    return F.element_at(F.transform(F.array(lines), windows), 1)


def drop_repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES
) -> DataFrame:
    """One row per document: id, ``n_lines``, ``removed_lines``, ``text`` without the removed lines.

    Every passage of ``min_lines`` or more lines that are not blank goes, from its first to its last such
    line, where equal bytes stand at a place before, by id, then by line. So a passage of any length goes
    whole, and the first place of every line stays. Windows are compared by SHA-256, so only digests and
    places are shuffled. Nulls, empty texts and equal rows are treated as by ``drop_repeated_lines``.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    lines = F.split("text", "\n", -1)
    places = (
        rows.filter(F.col("text").isNotNull())
        .select("id", "text_hash", F.explode(line_windows(lines, min_lines)).alias("w"))
        .select("id", "text_hash", "w.*", F.xxhash64("w.key").alias("hash"))
    )
    repeated = places.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("hash")
    again = written(places.join(repeated, "hash", "left_semi"), "repeated-windows")
    at = F.struct("id", "text_hash", "start")
    first = again.groupBy("key").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.filter(F.col("n") > 1).select("key", "first")
    removed = (
        again.withColumn("at", at)
        .join(first, "key")
        .filter(~F.col("at").eqNullSafe(F.col("first")))
        .groupBy(F.col("id").alias("of"), F.col("text_hash").alias("of_hash"))
        .agg(F.collect_set(F.struct("start", "stop")).alias("gone"))
    )
    marked = rows.join(
        removed,
        F.col("id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash")),
        "left",
    )

    def left(lines: Column) -> Column:
        gone = F.flatten(F.transform("gone", lambda w: F.sequence(w["start"], w["stop"])))
        stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.transform(stays, lambda i: F.element_at(lines, i + 1))

    whole = F.col("gone").isNull()
    marked = marked.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)))
    marked = marked.withColumn("kept", F.when(~whole, F.element_at(F.transform(F.array(lines), left), 1)))
    return marked.select(
        F.col("id").alias(id_col),
        F.col("n_lines").cast("long").alias("n_lines"),
        F.when(whole, 0).otherwise(F.col("n_lines") - F.size("kept")).cast("long").alias("removed_lines"),
        F.when(whole, F.col("text")).otherwise(F.array_join("kept", "\n")).alias("text"),
    )
