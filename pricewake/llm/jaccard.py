"""Exact n-gram Jaccard join of whole texts by set relations.

A text is the set of its distinct word shingles; two texts link when the intersection is at
least ``percent`` of the union. Equal sets are one from the start.

Prefix lists. In one global order a linked pair shares tokens among its first ones, so that only a prefix of
each set is indexed. The order is by hash, after frequent tokens have been moved to the end:
``HOT_TOKENS`` at most are shipped, and any order gives the same links. Sets whose prefix reaches into
frequent tokens are copies of something common: those with the same first such token form a class,
and a class stands in a list once, with the range of its sizes and positions.

Skipping in the lists. Entries of a list that agree in size and position form a block. Size window and
position bound are tested once for two blocks, and all their pairs are passed over together. What is left is
counted by pair: both sets know how many tokens of their prefixes they must share.

Answers from answers. A cell holds an inverted index of one class and the sets to be compared with
it. They are taken in order, and the overlaps of a set are those of the one before, less the
lists of the tokens that went, plus the lists of those that came. Overlaps are exact; a cell returns a
spanning forest of its links and the number of links of each set, never the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewake.llm.components import components
from pricewake.llm.tokens import pa_type
from pricewake.session import written

WIDTH = 4
PERCENT = 85
# Frequent tokens that are moved behind the others: the most that are shipped to the tasks.
HOT_TOKENS = 1 << 18
# Tokens that a task counts at a time, and how often one must stand among them to be reported.
COUNT_TOKENS = 1 << 22
COUNT_LEAST = 3
# Rows of a list, tokens of a block of a class, tokens compared with it in one cell.
LIST = 4096
BLOCK_TOKENS = 1 << 14
CELL_TOKENS = 1 << 15
MEMO = 1 << 20

_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


class Shingler:
    """Sorted distinct 64-bit tokens of texts; distinct words are hashed once per task."""

    def __init__(self, width: int):
        self.width, self.memo = width, {}
        self.factors = [np.uint64(pow(_FACTORS[i % 4], i // 4 + 1, 1 << 64)) for i in range(width)]

    def tokens(self, text: bytes | None) -> np.ndarray:
        # ``bytes`` lowers A-Z alone and splits at ASCII white space alone.
        words = (text or b"").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < self.width:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for word in words:
            if word not in memo:
                memo[word] = xxhash.xxh64_intdigest(word)
        hashes = np.fromiter((memo[w] for w in words), np.uint64, len(words))
        size = len(words) - self.width + 1
        mixed = np.zeros(size, np.uint64)
        for i, factor in enumerate(self.factors):
            mixed += hashes[i : i + size] * factor
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed)


def set_key(tokens: np.ndarray) -> int:
    """One signed 64-bit number for a set; sets are told apart by it."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def need(n, percent: int):
    """The least overlap of a linked pair as far as one size tells."""
    return -(-percent * n // 100)


def overlap(total, percent: int):
    """The least overlap of a linked pair, by the sum of both sizes."""
    return -(-percent * total // (100 + percent))


def _signed(tokens: np.ndarray) -> pa.Array:
    return pa.array(tokens.view(np.int64), pa.int64())


def _survey(slim: DataFrame, width: int) -> DataFrame:
    """One row per document (id, text_hash, n, key), and rows (token, times) of tokens that a task meets often."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, held, size = Shingler(width), set(), [], 0

        def often() -> pa.RecordBatch:
            tokens, times = np.unique(np.concatenate(held or [np.empty(0, np.uint64)]), return_counts=True)
            tokens, times = tokens[times >= COUNT_LEAST], times[times >= COUNT_LEAST]
            blank = [pa.nulls(len(tokens), kind) for kind in (ids, pa.int64(), pa.int32(), pa.int64())]
            return pa.RecordBatch.from_arrays([*blank, _signed(tokens), pa.array(times, pa.int64())], names=names)

        names = ["id", "text_hash", "n", "key", "token", "times"]
        ids = pa.null()
        for batch in batches:
            ids = batch.schema.field("id").type
            sizes, keys = [], []
            for text in batch.column("text"):
                tokens = shingler.tokens(text.as_py())
                key = set_key(tokens) if len(tokens) else None
                sizes.append(len(tokens))
                keys.append(key)
                if key is not None and key not in seen:
                    seen.add(key)
                    held.append(tokens)
                    size += len(tokens)
                if size >= COUNT_TOKENS:
                    yield often()
                    seen, held, size = set(), [], 0
            both = [batch.column("id"), batch.column("text_hash"), pa.array(sizes, pa.int32()), pa.array(keys, pa.int64())]
            blank = [pa.nulls(len(sizes), pa.int64())] * 2
            yield pa.RecordBatch.from_arrays(both + blank, names=names)
        if held:
            yield often()

    kind = pa_type(slim)
    return slim.mapInArrow(look, f"id {kind}, text_hash long, n int, key long, token long, times long")


def _frequent(found: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, at most ``most``, sorted, with their counts; a bounded collect."""
    totals = written(
        found.filter(F.col("token").isNotNull()).groupBy("token").agg(F.sum("times").alias("times")), "frequent"
    )
    # Counts in quarter powers of two: a few hundred rows tell how far down the bound reaches.
    step = F.floor(4 * F.log2("times")).cast("int")
    sizes = totals.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    least, total = None, 0
    for row in sizes:
        total += row["count"]
        if total > most:
            break
        least = row["step"]
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    rows = totals.filter(step >= least).toArrow()
    tokens = rows.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows.column("times").to_numpy()[order]


def _prefixes(slim: DataFrame, width: int, percent: int, hot, list_rows: int) -> DataFrame:
    """(key, n, class, prefix, cells) of every text with words, prefix tokens in global order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, (frequent, counts) = Shingler(width), hot.value
        for batch in batches:
            keys, sizes, classes, prefixes, cells = [], [], [], [], []
            for text in batch.column("text"):
                tokens = shingler.tokens(text.as_py())
                n = len(tokens)
                if not n:
                    continue
                times = np.zeros(n, np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
                    times = np.where(frequent[at] == tokens, counts[at], 0)
                order = np.argsort(times, kind="stable")[: n - need(n, percent) + 1]
                first = tokens[order].view(np.int64)
                common = np.flatnonzero(times[order])
                parts = -(-times[order] // list_rows)
                keys.append(set_key(tokens))
                sizes.append(n)
                classes.append(int(first[common[0]]) if len(common) else None)
                prefixes.append(first)
                cells.append(np.maximum(parts, 1).astype(np.int32) if parts.max(initial=0) > 1 else None)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    pa.array(sizes, pa.int32()),
                    pa.array(classes, pa.int64()),
                    pa.array(prefixes, pa.list_(pa.int64())),
                    pa.array(cells, pa.list_(pa.int32())),
                ],
                names=["key", "n", "class", "prefix", "cells"],
            )

    return slim.mapInArrow(cut, "key long, n int, class long, prefix array<long>, cells array<int>")


def _in_blocks(sets: DataFrame, block_tokens: int) -> DataFrame:
    """The sets with ``block`` and ``many``: classes in blocks of bounded size, every other set on its own."""
    classed = sets.filter(F.col("class").isNotNull())
    parts = F.ceil(F.sum(F.col("n").cast("long")) / F.lit(block_tokens)).alias("parts")
    classes = classed.groupBy("class").agg(F.count(F.lit(1)).alias("members"), parts)
    classed = classed.join(classes.filter("members > 1"), "class", "left")
    salted = F.xxhash64("class", F.pmod(F.xxhash64("key"), F.col("parts")))
    return (
        classed.withColumn("block", F.when(F.col("parts").isNotNull(), salted).otherwise(F.col("key")))
        .withColumn("many", F.col("parts").isNotNull())
        .drop("members", "parts", "class")
        .unionByName(
            sets.filter(F.col("class").isNull())
            .withColumn("block", F.col("key"))
            .withColumn("many", F.lit(False))
            .drop("class")
        )
    )


def _postings(blocked: DataFrame) -> DataFrame:
    """(token, cell, side, block, n_lo, n_hi, rest): the lists, those of very frequent tokens cut into cells."""
    flat = blocked.select("block", "many", "n", "cells", F.posexplode("prefix").alias("pos", "token")).select(
        "token",
        "block",
        "many",
        "n",
        (F.col("n") - F.col("pos")).alias("rest"),
        F.coalesce(F.get("cells", F.col("pos")), F.lit(1)).alias("parts"),
    )
    alone = flat.filter(~F.col("many")).select(
        "token", "parts", "block", F.col("n").alias("n_lo"), F.col("n").alias("n_hi"), "rest"
    )
    together = (
        flat.filter("many")
        .groupBy("token", "block")
        .agg(
            F.max("parts").alias("parts"),
            F.min("n").alias("n_lo"),
            F.max("n").alias("n_hi"),
            F.max("rest").alias("rest"),
        )
    )
    entries = alone.unionByName(together)
    own = F.pmod(F.xxhash64("block"), F.col("parts")).cast("int")
    other = F.sequence(F.lit(0), F.col("parts") - 1)
    long = entries.filter("parts > 1").withColumn("own", own)
    long = long.select("*", F.explode(other).alias("j")).select(
        "token",
        (F.least("own", "j") * F.col("parts") + F.greatest("own", "j")).alias("cell"),
        F.when(F.col("own") != F.col("j"), F.col("own")).otherwise(F.lit(-1)).alias("side"),
        "block",
        "n_lo",
        "n_hi",
        "rest",
    )
    # In a cell of two parts the rows of one part carry their part, else -1.
    short = entries.filter("parts = 1").select(
        "token", F.lit(0).alias("cell"), F.lit(-1).alias("side"), "block", "n_lo", "n_hi", "rest"
    )
    return short.unionByName(long)


def _pairs(firsts: np.ndarray, ends: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for every i and firsts[i] <= j < ends[i], in portions."""
    counts = np.maximum(ends - firsts, 0)
    total = np.cumsum(counts)
    start = 0
    while start < len(counts):
        done = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + most, "right")))
        here = counts[start:stop]
        left = np.repeat(np.arange(start, stop), here)
        right = np.arange(len(left)) - np.repeat(np.cumsum(here) - here, here) + firsts[left]
        yield left, right
        start = stop


def skip_pairs(columns: dict[str, np.ndarray], percent: int, most: int = 1 << 21) -> Iterator[tuple]:
    """(a, b, least) of entries that can be linked, for whole lists sorted by token, cell, sizes and rest.

    Blocks of entries with equal sizes and position are tested once for all their pairs.
    """
    token, cell, side, block, n_lo, n_hi, rest = columns.values()
    if not len(token):
        return
    new_list = np.ones(len(token), bool)
    new_list[1:] = (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])
    new_run = new_list.copy()
    for values in (n_lo, n_hi, rest):
        new_run[1:] |= values[1:] != values[:-1]
    starts = np.flatnonzero(new_run)
    ends = np.append(starts[1:], len(token))
    lists = np.cumsum(new_list)[starts]
    lo, hi, left_over = n_lo[starts], n_hi[starts], rest[starts]
    # Blocks of a list by rising size: partners end where sizes grow too large.
    places = (lists << 32) + lo
    limit = np.searchsorted(places, (lists << 32) + 100 * hi // percent, "right")
    for x, y in _pairs(np.arange(len(starts)), limit, most):
        x, y = x[keep := (x != y) | (ends[x] - starts[x] > 1)], y[keep]
        fits = 100 * np.minimum(hi[x], hi[y]) >= percent * np.maximum(lo[x], lo[y])
        least_rest = need(np.maximum(lo[x], lo[y]), percent)
        fits &= np.minimum(left_over[x], left_over[y]) >= least_rest
        x, y = x[fits], y[fits]
        least = overlap(lo[x] + lo[y], percent) - need(np.maximum(hi[x], hi[y]), percent) + 1
        # Entries of the first block, each with all of the second (or those behind it, in its own).
        for p, i in _pairs(starts[x], ends[x], most):
            own = x[p] == y[p]
            for q, j in _pairs(np.where(own, i + 1, starts[y[p]]), ends[y[p]], most):
                i_, p_ = i[q], p[q]
                ok = ((side[i_] < 0) | (side[i_] != side[j])) & (block[i_] != block[j])
                a, b = block[i_[ok]], block[j[ok]]
                yield np.minimum(a, b), np.maximum(a, b), np.maximum(least[p_[ok]], 1)


def _candidates(postings: DataFrame, percent: int) -> DataFrame:
    """(a, b) of blocks that share enough tokens of their prefixes."""
    names = ["token", "cell", "side", "block", "n_lo", "n_hi", "rest"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {name: np.empty(0, np.int64) for name in names}

        def out(columns: dict) -> Iterator[pa.RecordBatch]:
            for found in skip_pairs(columns, percent):
                kinds = (pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, kind) for x, kind in zip(found, kinds, strict=True)], names=["a", "b", "least"]
                )

        for batch in batches:
            rows = {
                name: np.concatenate([held[name], batch.column(name).to_numpy().astype(np.int64)]) for name in names
            }
            token, cell = rows["token"], rows["cell"]
            new = np.flatnonzero((token[1:] != token[:-1]) | (cell[1:] != cell[:-1])) + 1
            last = int(new[-1]) if len(new) else 0
            yield from out({name: values[:last] for name, values in rows.items()})
            held = {name: values[last:] for name, values in rows.items()}
        yield from out(held)

    lists = postings.select(names).repartition("token", "cell").sortWithinPartitions("token", "cell", "n_lo", "n_hi", "rest")
    found = lists.mapInArrow(meet, "a long, b long, least int")
    shared = found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("least").alias("least"))
    return shared.filter(F.col("shared") >= F.col("least")).select("a", "b")


class Lists:
    """An inverted index over whole sets, for overlaps with all of them."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = len(sets)
        owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.owners = owners[order]
        self.tokens, self.starts = np.unique(tokens[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(tokens))

    def tally(self, tokens: np.ndarray) -> np.ndarray:
        """How many of the tokens each set holds."""
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        at = at[self.tokens[at] == tokens]
        starts, sizes = self.starts[at], self.ends[at] - self.starts[at]
        places = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        return np.bincount(self.owners[places], minlength=self.size)

    def overlaps(self, probes: list[np.ndarray]) -> Iterator[np.ndarray]:
        """Overlaps of each probe with all sets, from those of the probe before where that is less work."""
        before, counts = np.empty(0, np.uint64), np.zeros(self.size, np.int64)
        for tokens in probes:
            gone = np.setdiff1d(before, tokens, assume_unique=True)
            come = np.setdiff1d(tokens, before, assume_unique=True)
            if len(gone) + len(come) < len(tokens):
                counts = counts - self.tally(gone) + self.tally(come)
            else:
                counts = self.tally(tokens)
            before = tokens
            yield counts


def _solver(percent: int):
    def solve(table: pa.Table) -> pa.Table:
        columns = {name: table.column(name).to_pylist() for name in ("probe", "key", "block", "copies", "tokens")}
        rows = sorted(
            {(p, b, k): (len(t), c, t) for p, k, b, c, t in zip(*columns.values(), strict=True)}.items(),
            key=lambda row: (row[0][:2], row[1][0], row[0][2]),
        )
        sets = [(p, b, k, c, np.frombuffer(t, np.uint64)) for (p, b, k), (_, c, t) in rows]
        index = [row for row in sets if not row[0]]
        probes = [row for row in sets if row[0]]
        parent, links = {}, {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        if index and probes:
            own, keys = index[0][1], np.array([row[2] for row in index])
            copies, sizes = np.array([row[3] for row in index]), np.array([len(row[4]) for row in index])
            overlaps = Lists([row[4] for row in index]).overlaps([row[4] for row in probes])
            for (_, block, key, times, tokens), counts in zip(probes, overlaps, strict=True):
                linked = 100 * counts >= percent * (sizes + len(tokens) - counts)
                if block == own:
                    linked &= keys < key
                for i in np.flatnonzero(linked).tolist():
                    other = int(keys[i])
                    links[key] = links.get(key, 0) + int(copies[i])
                    links[other] = links.get(other, 0) + times
                    a, b = root(key), root(other)
                    parent[max(a, b)] = min(a, b)
        nodes = list(links)
        return pa.table(
            [
                pa.array(nodes, pa.int64()),
                pa.array([root(x) for x in nodes], pa.int64()),
                pa.array([links[x] for x in nodes], pa.int64()),
            ],
            names=["node", "root", "links"],
        )

    return solve


def _linked(pairs: DataFrame, blocked: DataFrame, sets: DataFrame, percent: int, cell_tokens: int) -> DataFrame:
    """(node, root, links): for every cell the sets with links, a root of theirs, and how many documents they link to."""
    load = blocked.groupBy(F.col("block").alias("b")).agg(F.sum(F.col("n").cast("long")).alias("tokens"))
    parts = F.ceil(F.sum("tokens") / F.lit(cell_tokens)).cast("int").alias("parts")
    shape = pairs.join(load, "b").groupBy("a").agg(parts)
    cells = written(
        pairs.join(shape, "a").withColumn("cell", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts"),
        "cells",
    )
    tokens = ["key", "block", "copies", "tokens"]
    index = cells.select("a", "cell").distinct().join(sets, F.col("a") == F.col("block"))
    probes = cells.join(sets, F.col("b") == F.col("block"))
    rows = index.select("a", "cell", F.lit(False).alias("probe"), *tokens).unionByName(
        probes.select("a", "cell", F.lit(True).alias("probe"), *tokens)
    )
    return rows.groupBy("a", "cell").applyInArrow(_solver(percent), "node long, root long, links long")


def jaccard_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    percent: int = PERCENT,
    hot_tokens: int = HOT_TOKENS,
    list_rows: int = LIST,
    block_tokens: int = BLOCK_TOKENS,
    cell_tokens: int = CELL_TOKENS,
) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id``, ``n_links``.

    ``component_id`` is the smallest id that links reach, the document's own included; ``n_links``
    counts the other documents it links to, copies included. A text with fewer words than
    ``width`` has them all as its one shingle; a text without words (null, empty, blank) has no
    shingles and links with nothing, not even its like. Repeated rows are returned each and link with each other;
    null ids are never the smallest, and a class without any id has a null ``component_id``. Very long texts
    are whole sets; a set is held by one task at a time. Other columns are not read.

    No step collects a list, class or component: the sizes ``list_rows``, ``block_tokens`` and ``cell_tokens``
    lay the work out, ``hot_tokens`` bounds the order that is shipped; none changes the result. Shingles and sets are told
    apart by 64-bit hashes. Texts are read three times: for keys and frequent tokens, for prefixes, and those with
    candidates for whole sets. Writes its steps below ``spark.checkpoint.dir``.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    slim = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text")
    )
    found = written(_survey(slim, width), "set-keys")
    members = found.filter(F.col("token").isNull()).select("id", "text_hash", "n", "key")
    hot = spark.sparkContext.broadcast(_frequent(found, hot_tokens))
    sets = _prefixes(slim, width, percent, hot, list_rows).dropDuplicates(["key"])
    blocked = written(_in_blocks(written(sets, "prefixes"), block_tokens), "set-blocks")
    crowds = blocked.filter("many").groupBy("block").count().filter("count > 1")
    pairs = written(
        _candidates(_postings(blocked), percent).unionByName(
            crowds.select(F.col("block").alias("a"), F.col("block").alias("b"))
        ),
        "candidates",
    )

    # Whole sets of all blocks that take part, from the text of one document each.
    member = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")
    kinds = written(
        members.filter("n > 0").groupBy("key").agg(F.min(member).alias("least"), F.count(F.lit(1)).alias("copies")),
        "sets",
    )
    asked = pairs.select(F.col("a").alias("block")).unionByName(pairs.select(F.col("b").alias("block"))).distinct()
    wanted = (
        blocked.join(asked, "block", "left_semi")
        .select("key", "block")
        .join(kinds, "key")
        .select("block", "copies", F.col("least.id").alias("least_id"), F.col("least.text_hash").alias("least_hash"))
    )
    same = F.col("id").eqNullSafe(F.col("least_id")) & (F.col("text_hash") == F.col("least_hash"))
    texts = slim.join(wanted, same).select("block", "copies", "text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            tokens = [shingler.tokens(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([set_key(t) for t in tokens], pa.int64()),
                    batch.column("block"),
                    batch.column("copies"),
                    pa.array([t.tobytes() for t in tokens], pa.binary()),
                ],
                names=["key", "block", "copies", "tokens"],
            )

    whole_sets = written(texts.mapInArrow(whole, "key long, block long, copies long, tokens binary"), "whole-sets")
    linked = written(_linked(pairs, blocked, whole_sets, percent, cell_tokens), "linked")

    labels = components(linked, "node", "root").withColumnRenamed("node", "key")
    counts = linked.groupBy(F.col("node").alias("key")).agg(F.sum("links").alias("links"))
    classes = kinds.join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = classes.groupBy("component").agg(F.min("least").alias("first"))
    known = (
        classes.join(least, "component")
        .join(counts, "key", "left")
        .select(
            "key",
            F.col("first.id").alias("component_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    columns = [F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id", "n_links"]
    return (
        members.filter("n > 0")
        .join(known, "key")
        .select(columns)
        .unionByName(
            members.filter("n = 0")
            .withColumn("component_id", F.col("id"))
            .withColumn("n_links", F.lit(0).cast("long"))
            .select(columns)
        )
    )
