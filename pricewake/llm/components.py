"""Connected components of links, as rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewake.session import written

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    """Count and two 64-bit checksums of the links; one row to the driver."""
    return tuple(
        edges.agg(
            F.count(F.lit(1)),
            F.bit_xor(F.xxhash64("high", "low")),
            F.bit_xor(F.xxhash64("low", "high", F.lit(1))),
        ).first()
    )


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): for every node of a link the smallest node it is joined to.

    Alternates the large-star and small-star steps until no link changes; the number
    of rounds grows with the logarithm of the longest path. Each round is two
    aggregates, combined before the shuffle, and two joins, so a node with very many
    links is one row after the aggregate and a split partition in the join. Every round
    is written below ``spark.checkpoint.dir``. Null ends, loops and repeats are
    left out; no links give no rows.
    """
    a, b = F.col(left), F.col(right)
    edges = (
        links.filter(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"))
        .distinct()
    )
    edges = written(edges, "links")
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        # Each node's larger neighbours move to its smallest neighbour (or itself) ...
        least = edges.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("least"))
        large = edges.join(least, F.col("low") == F.col("node"), "left").select(
            "high", F.coalesce("least", "low").alias("low")
        )
        # ... then the smaller ones, with the node, to the smallest of them.
        large = written(large.distinct(), "large-star")
        least = large.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("least"))
        joined = large.join(least, F.col("high") == F.col("node"))
        small = joined.select(F.col("low").alias("high"), F.col("least").alias("low")).unionByName(
            joined.select("high", F.col("least").alias("low"))
        )
        after = written(small.filter(F.col("high") != F.col("low")).distinct(), "small-star")
        edges, seen = after, state
        state = _state(edges)
        if state == seen:
            break
    else:
        raise RuntimeError(f"links still change after {MAX_ROUNDS} rounds")
    stars = edges.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("component"))
    roots = edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return stars.unionByName(roots)
