"""Mixing sources by temperature, in DataFrame expressions only.

A source with token share p gets the weight p^a / sum of all p^a. The exponent a is bisected
to meet a target entropy of the weights, or a limit on how often any source's tokens
are repeated. Each source's weight times the budget is then filled with its documents: whole
passes as often as they fit, and one part of a pass, the first documents of a
seeded permutation of the source. The permutation is a hash of the document's id, its
blocks are ranges of that hash; the block totals say in which block the budget ends, and only
that block is put in order. So a source with a third of all rows is no single task's work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewake.session import written

# Exponents are whole multiples of limit / 2^20, found 5 bits at a time.
STEPS = 1 << 20
FAN = 32
PER_BLOCK = 4096
HASH_RANGE = 1 << 48
# Uses of a document that one row is expanded to at a time.
USES = 1024
WORD = r"[^ \t\n\x0B\f\r]+"


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space, as the measure of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(key: Column, epoch: Column, seed: int) -> Column:
    """A document's place in the permutation of an epoch: 48 bits of a hash."""
    named = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key)
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 12), 16, 10).cast("long")


def row_key(id_col: str, text_col: str) -> Column:
    """What names a document: its id, or where it has none its text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.md5(text.cast("binary"))))


def source_totals(rows: DataFrame) -> DataFrame:
    """(source, tokens, n) of rows with source and tokens."""
    return rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))


def bisect_exponent(
    totals: DataFrame,
    budget: int,
    entropy: float | None = None,
    repetition: float | None = None,
    limit: float = 8.0,
) -> float:
    """The exponent that meets the targets, a multiple of ``limit`` / 2^20 (1 / 2^20 for repetition).

    ``entropy`` (0 to 1) is a share of the entropy of equal weights: the largest exponent up to
    ``limit`` that reaches it. ``repetition`` is how often a source's tokens may be used:
    the smallest exponent up to 1 that keeps to it. With both, the larger of the two, so the
    limit holds, if need be at a lower entropy. No target gives 1, a budget no exponent can
    fit gives 1. Every round is one small aggregate over the sources for 32 exponents at once.
    """
    shares = totals.filter(F.col("tokens") > 0)
    n, tokens = shares.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    if n < 2 or (entropy is None and repetition is None):
        return 1.0
    p = shares.select((F.col("tokens") / F.lit(float(tokens))).alias("p"), "tokens")

    def measured(numbers: list[int], scale: float) -> dict[int, tuple[float, float]]:
        tried = F.explode(F.array(*[F.lit(x) for x in numbers])).alias("number")
        power = F.pow("p", F.col("number") * F.lit(scale / STEPS))
        rows = (
            p.select("p", "tokens", tried)
            .withColumn("w", power)
            .groupBy("number")
            .agg(
                F.sum("w").alias("z"),
                F.sum(F.col("w") * F.log("w")).alias("wlogw"),
                F.max(F.col("w") / F.col("tokens")).alias("most"),
            )
            .collect()
        )
        return {
            r["number"]: (math.log(r["z"]) - r["wlogw"] / r["z"], budget * r["most"] / r["z"]) for r in rows
        }

    def search(holds, scale: float) -> int | None:
        """The largest number for which the condition holds, as it does for all below."""
        low, step = 0, STEPS // FAN
        found = measured([0], scale)[0]
        if not holds(*found):
            return None
        while step:
            tried = [low + step * i for i in range(1, FAN + 1) if low + step * i <= STEPS]
            results = measured(tried, scale) if tried else {}
            low = max([low, *(x for x in tried if holds(*results[x]))])
            step //= FAN
        return low

    best = []
    if entropy is not None:
        target = entropy * math.log(n)
        found = search(lambda h, _: h >= target - 1e-12, limit)
        best.append((found or 0) * limit / STEPS)
    if repetition is not None:
        found = search(lambda _, r: r > repetition + 1e-12, 1.0)
        best.append(0.0 if found is None else min(STEPS, found + 1) / STEPS)
    return max(best)


def source_plan(
    totals: DataFrame, exponent: float, budget: int, per_block: int = PER_BLOCK
) -> DataFrame:
    """(source, tokens, weight, target, passes, rest, blocks) of each source with tokens."""
    with_tokens = totals.filter(F.col("tokens") > 0)
    all_tokens = with_tokens.agg(F.coalesce(F.sum("tokens"), F.lit(1))).first()[0]
    power = F.pow(F.col("tokens") / F.lit(float(all_tokens)), F.lit(exponent))
    weighed = with_tokens.withColumn("power", power)
    z = weighed.agg(F.coalesce(F.sum("power"), F.lit(1.0))).first()[0]
    return (
        weighed.withColumn("weight", F.col("power") / F.lit(z))
        .withColumn("target", F.floor(F.col("weight") * F.lit(float(budget))).cast("long"))
        .withColumn("passes", F.expr("target div tokens"))
        .withColumn("rest", F.col("target") % F.col("tokens"))
        .withColumn("blocks", F.ceil(F.col("n") / F.lit(per_block)).cast("long"))
        .select("source", "tokens", "weight", "target", "passes", "rest", "blocks")
    )


def block_of(h: Column, blocks: Column) -> Column:
    return F.floor(h * blocks / F.lit(float(HASH_RANGE))).cast("long")


def last_keys(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """``plan`` with ``last``: the largest permutation key that the part of a pass takes.

    Documents of one key are taken together or not at all, and the budget is never exceeded.
    """
    named = plan.select(F.col("source").alias("of"), "passes", "rest", "blocks")
    keyed = (
        rows.join(named, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("h", order_key(F.col("key"), F.col("passes"), seed))
        .groupBy("source", "rest", "blocks", "h")
        .agg(F.sum("tokens").alias("tokens"))
        .withColumn("block", block_of(F.col("h"), F.col("blocks")))
    )
    keyed = written(keyed, "mix-keys")
    blocks = keyed.groupBy("source", "rest", "block").agg(F.sum("tokens").alias("tokens"))
    upto = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        blocks.withColumn("upto", F.sum("tokens").over(upto))
        .filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("tokens") <= F.col("rest")))
        .groupBy(F.col("source").alias("of"))
        .agg(F.min(F.struct("block", (F.col("upto") - F.col("tokens")).alias("before"))).alias("end"))
        .select("of", F.col("end.block").alias("end_block"), F.col("end.before").alias("before"))
    )
    within = Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    inside = keyed.join(
        ends, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("end_block"))
    )
    cut = (
        inside.withColumn("upto", F.col("before") + F.sum("tokens").over(within))
        .groupBy(F.col("source").alias("of"), "end_block")
        .agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("h"))).alias("last_h"))
    )
    # Nothing of the last block: everything of the blocks before it.
    named = plan.join(cut, F.col("source").eqNullSafe(F.col("of")), "left")
    first_of_block = F.ceil(F.col("end_block") * F.lit(float(HASH_RANGE)) / F.col("blocks")).cast("long")
    last = F.coalesce("last_h", first_of_block - 1, F.lit(-1).cast("long"))
    return written(named.select(*plan.columns, last.alias("last")), "mix-plan")


def plan_mix(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    source_col: str,
    budget: int | None,
    entropy: float | None,
    repetition: float | None,
    seed: int,
    per_block: int,
) -> tuple[DataFrame, DataFrame, float]:
    """The documents' (id, source, key, tokens), the plan of the sources, and the exponent."""
    rows = written(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            row_key(id_col, text_col).alias("key"),
            words(F.col(text_col).cast("string")).alias("tokens"),
        ),
        "mix-rows",
    )
    totals = written(source_totals(rows), "mix-totals")
    if budget is None:
        budget = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    exponent = bisect_exponent(totals, budget, entropy, repetition)
    plan = source_plan(totals, exponent, budget, per_block)
    return rows, last_keys(rows, plan, seed), exponent


def _copies(plan_row_key: Column, seed: int) -> Column:
    """How often a document is used: the whole passes, and the part of one if it is in it."""
    part = order_key(plan_row_key, F.col("passes"), seed) <= F.col("last")
    return F.col("passes") + part.cast("long")


def _each_use(used: DataFrame, plan: DataFrame) -> DataFrame:
    """A row for each of ``copies`` uses, numbered from 0 in ``use``.

    Where a source is used more than ``USES`` times, ranges of uses are cut finer and finer, and dealt over the
    tasks in between, so that no row is expanded to more than ``USES`` at once, however many there are.
    """
    most = 1 + plan.agg(F.coalesce(F.max("passes"), F.lit(0))).first()[0]
    ranges = used.filter(F.col("copies") > 0).withColumn("from", F.lit(0).cast("long")).withColumn("upto", F.col("copies"))
    sizes = []
    while USES ** (len(sizes) + 1) < most:
        sizes.append(USES ** (len(sizes) + 1))
    for size in reversed(sizes):
        ranges = (
            ranges.withColumn("from", F.explode(F.sequence("from", F.col("upto") - 1, F.lit(size).cast("long"))))
            .withColumn("upto", F.least(F.col("from") + size, F.col("upto")))
            .repartition("key", "from")
        )
    return ranges.withColumn("use", F.explode(F.sequence("from", F.col("upto") - 1))).drop("from", "upto")


def mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    budget: int | None = None,
    entropy: float | None = None,
    repetition: float | None = None,
    seed: int = 11,
    per_block: int = PER_BLOCK,
) -> DataFrame:
    """One row per use of a document: id, ``source``, ``n_tokens``, ``weight``, ``epoch``, ``block``.

    ``budget`` tokens (words) are drawn, by default as many as there are; a source never gets more than
    its weight's share and falls short of it by less than the document that no longer fits.
    ``epoch`` counts the source's passes from 0, ``block`` is the block of that
    epoch's permutation. A null source is a source; a null or empty text has no
    tokens and is used in whole passes only, or where its key comes before the last one taken; a source
    without tokens has no weight and is not used; rows with equal ids share their place, rows without an
    id take that of their text. Empty tables give no rows. Other columns are not read. Without a repetition limit a
    source of few tokens comes as often as its weight asks, however often that is. Very long
    texts are counted whole.
    """
    rows, plan, _ = plan_mix(docs, id_col, text_col, source_col, budget, entropy, repetition, seed, per_block)
    named = plan.select(F.col("source").alias("of"), "weight", "passes", "blocks", "last")
    used = rows.join(named, F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", _copies(F.col("key"), seed))
    return (
        _each_use(used, plan)
        .withColumnRenamed("use", "epoch")
        .select(
            F.col("id").alias(id_col),
            "source",
            F.col("tokens").alias("n_tokens"),
            F.round("weight", 6).alias("weight"),
            "epoch",
            block_of(order_key(F.col("key"), F.col("epoch"), seed), F.col("blocks")).alias("block"),
        )
    )


def mix_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    budget: int | None = None,
    entropy: float | None = None,
    repetition: float | None = None,
    seed: int = 11,
    per_block: int = PER_BLOCK,
) -> DataFrame:
    """The documents themselves, each as often as ``mixture`` uses it, with all their columns.

    Documents meet only the table of sources, so their texts are not shuffled while that table is
    small enough for the planner to broadcast.
    """
    _, plan, _ = plan_mix(docs, id_col, text_col, source_col, budget, entropy, repetition, seed, per_block)
    packed = docs.select(
        F.struct("*").alias("row"),
        F.col(source_col).cast("string").alias("source"),
        row_key(id_col, text_col).alias("key"),
    )
    named = plan.select(F.col("source").alias("of"), "passes", "last")
    used = packed.join(named, F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", _copies(F.col("key"), seed))
    return _each_use(used, plan).select("row.*")
