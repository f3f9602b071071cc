"""SimHash near-duplicates by multi-index hashing.

Every text gets a 64-bit fingerprint: a bit is set when it is set in more than half of
the hashes of the text's word shingles. Fingerprints that differ in at most three bits
are linked; classes are the connected components of the links.

Links are found between distinct fingerprints only, so copies cost one row however many
they are. A fingerprint is cut into two 32-bit segments. Of at most three differing bits
one segment holds at most one, so that each segment's table is searched for the segment
itself and for its ball of radius one. Of two values one bit apart exactly one has
the bit clear, so probing with the clear bits set meets each pair once.

A segment value that many fingerprints share is cut into blocks, and every pair of
blocks is a task of bounded size that returns a spanning forest of its links, not the
links: components stay the same, and no group is ever expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewake.llm.components import components
from pricewake.llm.tokens import pa_type
from pricewake.session import written

SEED = 42
SHINGLE = 3
MAX_BITS = 3
SEGMENTS = 2
SEGMENT_BITS = 32
# Rows of one segment value that are joined as they are; above it, blocks of that many.
DIRECT = 64
BLOCK = 1024


def shingle_hashes(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of the UTF-8 text's words, repeats included.

    ``bytes`` lowers A-Z alone and splits at ASCII white space alone.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, size = xxhash.xxh64_intdigest, len(words) - width + 1
    spans = zip(starts[:size].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, size)


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number; zero where the text has no words."""
    hashes = shingle_hashes(text, width)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    set_bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(set_bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int = SHINGLE) -> DataFrame:
    """(id, text_hash, fp) of every row; one pass over whole texts, no shuffle."""
    text = F.col(text_col).cast("string")
    slim = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text")
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text.as_py(), width) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), pa.array(found, pa.int64())],
                names=["id", "text_hash", "fp"],
            )

    return slim.mapInArrow(sign, f"id {pa_type(slim)}, text_hash long, fp long")


def _segment(fp, number: int):
    mask = F.lit((1 << SEGMENT_BITS) - 1)
    return F.shiftrightunsigned(fp, SEGMENT_BITS * number).bitwiseAND(mask)


def _entries(fps: DataFrame) -> DataFrame:
    """(part, value, fp): every fingerprint under each of its segment values."""
    both = [
        F.struct(F.lit(n).alias("part"), _segment(F.col("fp"), n).alias("value"))
        for n in range(SEGMENTS)
    ]
    return fps.select("fp", F.explode(F.array(*both)).alias("at")).select(
        "at.part", "at.value", "fp"
    )


def _ball(entries: DataFrame) -> DataFrame:
    """(part, value, fp): each entry under the values that set one of its clear bits."""
    bits = F.array(*[F.lit(1 << bit).cast("long") for bit in range(SEGMENT_BITS)])
    clear = F.filter(bits, lambda bit: F.col("value").bitwiseAND(bit) == 0)
    return entries.select("part", F.explode(clear).alias("bit"), "value", "fp").select(
        "part", F.col("value").bitwiseOR(F.col("bit")).alias("value"), "fp"
    )


def _forest(members: np.ndarray, others: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the near pairs between two lists of fingerprints."""
    nodes, where = np.unique(np.concatenate([members, others]), return_inverse=True)
    rows, columns = where[: len(members)], where[len(members) :]
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    right = others.view(np.uint64)
    for row, fp in zip(rows.tolist(), members.view(np.uint64), strict=True):
        near = columns[np.bitwise_count(right ^ fp) <= max_bits]
        for column in near.tolist():
            a, b = root(row), root(column)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((int(nodes[row]), int(nodes[column])))
    return links


def near_links(
    fps: DataFrame, max_bits: int = MAX_BITS, direct: int = DIRECT, block: int = BLOCK
) -> DataFrame:
    """(a, b) between distinct fingerprints, with the components of all pairs within
    ``max_bits``: every near pair of a segment value that few share, and a spanning
    forest of the others.
    """
    if max_bits >= 2 * SEGMENTS:
        raise ValueError(f"segments with a ball of one bit prove at most {2 * SEGMENTS - 1} bits")
    entries = written(_entries(fps), "segments")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_bits

    sizes = entries.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
    many = written(sizes.filter(F.col("n") > direct), "crowded")
    few = entries.join(many, ["part", "value"], "left_anti")
    table = few.withColumnRenamed("fp", "other")
    # A pair with an equal segment has both members in the table: one order is enough.
    probes = _ball(entries).withColumn("equal", F.lit(False)).unionByName(
        few.withColumn("equal", F.lit(True))
    )
    plain = (
        probes.join(table, ["part", "value"])
        .filter(near & (~F.col("equal") | (F.col("fp") < F.col("other"))))
        .select(F.col("fp").alias("a"), F.col("other").alias("b"))
    )

    # Crowded values: the table's rows in blocks, against themselves and against probes.
    crowded = entries.join(many, ["part", "value"]).withColumn("probe", F.lit(False))
    visits = _ball(entries).join(many, ["part", "value"]).withColumn("probe", F.lit(True))
    visit_sizes = visits.groupBy("part", "value").agg(F.count(F.lit(1)).alias("m"))
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    visit_blocks = F.ceil(F.coalesce(F.col("m"), F.lit(0)) / F.lit(block)).cast("int")
    shape = many.join(visit_sizes, ["part", "value"], "left").select(
        "part", "value", blocks.alias("cells"), visit_blocks.alias("visit_cells")
    )
    own = F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int")
    as_row = F.transform(
        F.sequence(own, F.col("cells") - 1), lambda c: F.struct(own.alias("row"), c.alias("col"), F.lit(0).alias("side"))
    )
    as_col = F.transform(
        F.sequence(F.lit(0), own), lambda r: F.struct(r.alias("row"), own.alias("col"), F.lit(1).alias("side"))
    )
    guest = F.pmod(F.xxhash64("fp"), F.col("visit_cells")).cast("int")
    as_guest = F.transform(
        F.sequence(F.lit(0), F.col("cells") - 1),
        lambda c: F.struct((-1 - guest).alias("row"), c.alias("col"), F.lit(0).alias("side")),
    )
    as_host = F.when(
        F.col("visit_cells") > 0,
        F.transform(
            F.sequence(F.lit(0), F.col("visit_cells") - 1),
            lambda g: F.struct((-1 - g).alias("row"), own.alias("col"), F.lit(1).alias("side")),
        ),
    ).otherwise(F.array().cast("array<struct<row:int,col:int,side:int>>"))
    members = crowded.drop("n").join(shape, ["part", "value"])
    placed = members.select(
        "part", "value", "fp", F.explode(F.concat(as_row, as_col, as_host)).alias("at")
    ).unionByName(
        visits.drop("n").join(shape, ["part", "value"]).select(
            "part", "value", "fp", F.explode(as_guest).alias("at")
        )
    )
    placed = placed.select("part", "value", "at.row", "at.col", "at.side", "fp")

    def forest(rows: pd.DataFrame) -> pd.DataFrame:
        left = rows.fp[rows.side == 0].to_numpy(np.int64)
        right = rows.fp[rows.side == 1].to_numpy(np.int64)
        return pd.DataFrame(_forest(left, right, max_bits), columns=["a", "b"], dtype="int64")

    dense = placed.groupBy("part", "value", "row", "col").applyInPandas(forest, "a long, b long")
    return plain.unionByName(dense).filter(F.col("a") != F.col("b"))


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int, max_bits: int, direct: int, block: int):
    """The signed documents, and (fp, class_fp, least): the first member of each fingerprint's class."""
    signed = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    # Members in order: the smallest id first, those without an id last.
    member = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")
    fps = written(signed.groupBy("fp").agg(F.min(member).alias("least")), "distinct-fps")
    links = near_links(fps.select("fp"), max_bits, direct, block)
    labels = components(links, "a", "b").withColumnRenamed("node", "fp")
    classes = fps.join(labels, "fp", "left").withColumn("class_fp", F.coalesce("component", "fp"))
    least = classes.groupBy("class_fp").agg(F.min("least").alias("least"))
    return signed, classes.select("fp", "class_fp").join(least, "class_fp")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE,
    max_bits: int = MAX_BITS,
    direct: int = DIRECT,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits), ``component_id``, ``class_fp``.

    ``component_id`` is the smallest id that links reach, the document itself included;
    ``class_fp`` names the class by its smallest fingerprint, also where no member has
    an id. A null or empty text has fingerprint zero and is linked like any other; fewer
    words than ``width`` make one shingle. Repeated rows are returned each; null ids are
    never the smallest, and a class without any id has a null ``component_id``. Other
    columns are not read. Texts are read once and never shuffled; all later steps hold
    numbers only. Writes its steps below ``spark.checkpoint.dir``.
    """
    signed, classes = _classes(docs, id_col, text_col, width, max_bits, direct, block)
    return signed.join(classes, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("least.id").alias("component_id"),
        "class_fp",
    )


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE,
    max_bits: int = MAX_BITS,
    direct: int = DIRECT,
    block: int = BLOCK,
) -> DataFrame:
    """One document of each class with all its columns: that with the smallest id.

    Of rows equal in id and text one stays, whichever; a class without ids keeps one of its rows.
    """
    _, classes = _classes(docs, id_col, text_col, width, max_bits, direct, block)
    kept = classes.groupBy("class_fp").agg(F.min("least").alias("least"))
    kept = kept.select(F.col("least.id").alias("kept_id"), F.col("least.text_hash").alias("kept_hash"))
    packed = docs.select(
        F.struct("*").alias("row"),
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"),
    )
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash"))
    return packed.join(kept, same, "left_semi").dropDuplicates(["id", "text_hash"]).select("row.*")
