"""First alias of a table that occurs in a text, by hashes of the parts of a text.

``functions.text.brand_of`` and ``alias_of`` keep their list in the plan, which suits a few hundred names. Here
the list is a table (``ord, alias, canonical``) of any size. It is cut into parts of bounded bytes; a part is shipped
to the tasks as Arrow columns, and a batch of texts meets all its aliases at once: places where no alias can begin are
left out by the first bytes, and from the others a hash for each length that an alias has is looked up. Hits are
compared in full. Of the aliases that stand anywhere in the text the least ``ord`` wins, also one that
stands inside another. Parts follow one another, so no list is ever too long; the text stays where it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Aliases that are shipped to the tasks at a time.
PART_BYTES = 128 << 20
# The bytes of an alias's beginning that are looked at first, and the bits of the table of beginnings.
BEGIN_BYTES, BEGIN_BITS = 4, 20
# An odd number has an inverse among the whole numbers of 64 bits.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (and the last ends); null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, ends, data = texts.buffers()
    starts = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


class _Hashes:
    """Hashes of parts of a row of bytes, the same wherever a part stands."""

    def __init__(self, data: np.ndarray):
        powers = np.full(len(data) + 1, BASE, np.uint64)
        powers[0] = 1
        back = np.full(len(data) + 1, _INVERSE, np.uint64)
        back[0] = 1
        # All of it wraps at 64 bits.
        self._back = np.cumprod(back)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.cumprod(powers)[:-1], out=self._sums[1:])

    def of(self, starts: np.ndarray, sizes) -> np.ndarray:
        mixed = (self._sums[starts + sizes] - self._sums[starts]) * self._back[starts]
        mixed ^= mixed >> np.uint64(32)
        mixed *= _MIX
        return mixed ^ (mixed >> np.uint64(32))


def _beginnings(data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A number for the first ``size`` bytes of each part, below 2**BEGIN_BITS."""
    found = np.zeros(len(starts), np.uint32)
    for i in range(size):
        found = found * np.uint32(256) + data[starts + i]
    return (found * np.uint32(0x9E3779B1)) >> np.uint32(32 - BEGIN_BITS)


class Aliases:
    """A part of the table, ``ord, low, alias, canonical`` with each ``low`` once, to be looked up.

    It is made once and its ``vars`` are shipped, which any executor can read, so that a task has nothing to build.
    """

    @classmethod
    def shipped(cls, state: dict) -> Aliases:
        found = cls.__new__(cls)
        vars(found).update(state)
        return found

    def __init__(self, part: pa.Table):
        self.part = part.sort_by([("ord", "ascending"), ("alias", "ascending")]).combine_chunks()
        self._data, self._starts = _bytes_of(self._column("low"))
        sizes = np.diff(self._starts)
        hashes = _Hashes(self._data).of(self._starts[:-1], sizes)
        self.lengths = np.unique(sizes)
        self._begin = int(min(BEGIN_BYTES, self.lengths[0]))
        self._begins = np.zeros(1 << BEGIN_BITS, bool)
        self._begins[_beginnings(self._data, self._starts[:-1], self._begin)] = True
        # Ranks in the order of their hashes, and where those with the same upper bits begin.
        self._ranks = np.argsort(hashes, kind="stable").astype(np.int32)
        self._hashes = hashes[self._ranks]
        bits = max(len(hashes).bit_length(), 1)
        self._shift = np.uint64(64 - bits)
        self._slots = np.searchsorted(self._hashes >> self._shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def _column(self, name: str) -> pa.Array:
        column = self.part.column(name)
        return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)

    def _same_hash(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``hashes``, rank) for each alias that has it."""
        slot = (hashes >> self._shift).astype(np.int64)
        at, stop, which = self._slots[slot], self._slots[slot + 1], np.arange(len(hashes))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        while len(which):
            open_ = at < stop
            at, stop, which = at[open_], stop[open_], which[open_]
            same = self._hashes[at] == hashes[which]
            found.append((which[same], self._ranks[at[same]]))
            at = at + 1
        return np.concatenate([w for w, _ in found]), np.concatenate([r for _, r in found])

    def _stands_at(self, data: np.ndarray, places: np.ndarray, ranks: np.ndarray, length: int) -> np.ndarray:
        """Whether these aliases, all of one length, stand at these places in full."""
        same = np.ones(len(places), bool)
        starts = self._starts[ranks]
        for i in range(length):
            same &= data[places + i] == self._data[starts + i]
        return same

    def first_ranks(self, lows: pa.Array, word_bound: bool) -> np.ndarray:
        """The least rank of an alias that occurs in each text, -1 if none does; between no letters or digits if ``word_bound``."""
        data, starts = _bytes_of(lows)
        none = len(self._ranks)
        best = np.full(len(lows), none, np.int64)
        row = np.repeat(np.arange(len(lows)), np.diff(starts))
        end = starts[1:][row]
        places = np.arange(len(data))
        places = places[places + self._begin <= end]
        places = places[self._begins[_beginnings(data, places, self._begin)]]
        hashes, whole = _Hashes(data), data.tobytes() if word_bound else b""

        def alone(place: int, length: int) -> bool:
            of, after = row[place], place + length
            around = whole[starts[of] : place].decode()[-1:], whole[after : starts[of + 1]].decode()[:1]
            return not any(c.isalnum() for c in around)

        for length in self.lengths.tolist() if len(places) else ():
            inside = places[places + length <= end[places]]
            which, ranks = self._same_hash(hashes.of(inside, length))
            at = inside[which]
            kept = self._stands_at(data, at, ranks, length)
            at, ranks = at[kept], ranks[kept]
            if word_bound:
                kept = [i for i, place in enumerate(at.tolist()) if alone(place, length)]
                at, ranks = at[kept], ranks[kept]
            np.minimum.at(best, row[at], ranks)
        return np.where(best == none, -1, best)


def _parts(dim: DataFrame, part_bytes: int) -> Iterator[dict | None]:
    """The table in parts of about ``part_bytes``, dealt by a hash of the alias, each lowered one once."""
    known = dim.select(
        F.col("ord").cast("long").alias("ord"), F.lower("alias").alias("low"), "alias", "canonical"
    ).filter(F.col("ord").isNotNull() & (F.col("low") != ""))
    size = known.agg(F.sum(F.octet_length("low") + F.octet_length("alias") + 64)).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    for i in range(parts):
        rows = known.filter(F.pmod(F.xxhash64("low"), F.lit(parts)) == i)
        first = F.min(F.struct("ord", "alias", "canonical")).alias("first")
        part = rows.groupBy("low").agg(first).select("first.ord", "low", "first.alias", "first.canonical").toArrow()
        yield vars(Aliases(part)) if part.num_rows else None


def attach_first_alias(
    rows: DataFrame,
    dim: DataFrame,
    text: str = "text",
    word_bound: bool = False,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``rows`` with ``alias_ord``, ``alias`` and ``canonical`` of the first alias in order that the text contains.

    In any letter case; nulls where there is none, and for null texts. ``dim`` has ``ord`` (a whole number, the order),
    ``alias`` and ``canonical``; empty aliases and those without an order never match, and of rows with one ``ord`` the
    smallest alias counts. No row is shuffled. Columns may have any name but those three.
    """
    spark = rows.sparkSession
    names = rows.columns
    plain = rows.toDF(*[f"c{i}" for i in range(len(names))])
    low = F.lower(F.col(f"c{names.index(text)}").cast("string"))
    hit = F.lit(None).cast("struct<ord:long,alias:string,canonical:string>")
    found = plain.withColumns({"_low": low, "_hit": hit})
    for part in _parts(dim, part_bytes):
        shipped = spark.sparkContext.broadcast(part)
        found = found.mapInArrow(_look(shipped, word_bound), found.schema)
    return found.select(
        *[F.col(f"c{i}").alias(name) for i, name in enumerate(names)],
        F.col("_hit.ord").alias("alias_ord"),
        F.col("_hit.alias").alias("alias"),
        F.col("_hit.canonical").alias("canonical"),
    )


def _look(shipped, word_bound: bool):
    names = ("ord", "alias", "canonical")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Aliases.shipped(shipped.value) if shipped.value else None
        for batch in batches:
            if known is None or not batch.num_rows:
                yield batch
                continue
            at = batch.schema.get_field_index("_hit")
            ranks = known.first_ranks(batch.column(batch.schema.get_field_index("_low")), word_bound)
            ranks = pa.array(ranks, mask=ranks < 0)
            kind, before = batch.schema.field(at).type, batch.column(at)
            fields = [known.part.column(c).take(ranks).combine_chunks().cast(kind.field(c).type) for c in names]
            if before.null_count < len(before):
                was = [pc.struct_field(before, [c]) for c in names]
                nearer = pc.or_kleene(
                    pc.less(fields[0], was[0]), pc.and_kleene(pc.equal(fields[0], was[0]), pc.less(fields[1], was[1]))
                )
                mine = pc.and_kleene(pc.is_valid(fields[0]), pc.or_kleene(pc.is_null(was[0]), nearer))
                fields = [pc.if_else(pc.fill_null(mine, False), new, old) for new, old in zip(fields, was, strict=True)]
            hits = pa.StructArray.from_arrays(fields, fields=list(kind), mask=pc.is_null(fields[0]))
            columns = [batch.column(i) if i != at else hits for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return look


BRAND_DIM = T.StructType(
    [T.StructField("ord", T.LongType()), T.StructField("alias", T.StringType()), T.StructField("canonical", T.StringType())]
)
