"""A filter of bounded size that says which values cannot be among a set of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits for each key, and the least and most bits of a filter (as powers of two).
BITS_PER_KEY = 12
LEAST_BITS, MOST_BITS = 10, 23


def _places(value: Column, power: int) -> list[Column]:
    """Three bit places of a value, from parts of one hash."""
    h = F.xxhash64(value)
    mask = F.lit((1 << power) - 1).cast("long")
    return [F.shiftrightunsigned(h, shift).bitwiseAND(mask) for shift in (0, 20, 41)]


def key_filter(keys: DataFrame, column: str, most_bits: int = MOST_BITS):
    """A function ``Column -> Column`` that is true for every key and false for most other values.

    The bits are set by an aggregate of at most 2**most_bits / 64 rows and reach the tasks as one value of a
    scalar subquery, so that a filter on it runs in the scan's stage, below any exchange. ``keys`` is read
    twice: once to be counted. Beyond the largest size the filter lets more pass, never less. Null is no key.
    """
    known = keys.filter(F.col(column).isNotNull())
    wanted = max(BITS_PER_KEY * known.count(), 1)
    power = min(max((wanted - 1).bit_length(), LEAST_BITS), most_bits)
    slot_bit = [
        F.struct(F.shiftrightunsigned(p, 6).alias("slot"), p.bitwiseAND(F.lit(63).cast("long")).alias("bit"))
        for p in _places(F.col(column), power)
    ]
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at.bit").cast("int"))
    set_bits = known.select(F.explode(F.array(*slot_bit)).alias("at")).select(
        F.col("at.slot").alias("slot"), bit.alias("bits")
    )
    blank = keys.sparkSession.range(1 << (power - 6)).select(
        F.col("id").alias("slot"), F.lit(0).cast("long").alias("bits")
    )
    slots = blank.unionByName(set_bits).groupBy("slot").agg(F.bit_or("bits").alias("bits"))
    ordered = F.array_sort(F.collect_list(F.struct("slot", "bits")))
    bits = slots.agg(F.transform(ordered, lambda s: s["bits"]).alias("bits")).scalar()

    def may_hold(value: Column) -> Column:
        tests = F.lit(True)
        for place in _places(value, power):
            word = F.get(bits, F.shiftrightunsigned(place, 6).cast("int"))
            in_word = place.bitwiseAND(F.lit(63).cast("long")).cast("int")
            tests = tests & (F.call_function("shiftright", word, in_word).bitwiseAND(F.lit(1).cast("long")) == 1)
        return value.isNotNull() & tests

    return may_hold
