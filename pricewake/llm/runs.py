"""Runs of periodic text, by tiles of every period octave.

A run is a stretch of words with smallest period q, at least three periods and ``MIN_LENGTH`` words long, that cannot
be extended. Where it stands, words q apart are equal; that interval is at least as long as the step of
q's octave, so that it holds one of the octave's boundaries, which stand a step apart.

Documents are exploded into tiles: a boundary of an octave with a step of words on its left and a step and a period on its
right. Tiles overlap, and hold all that one boundary can say. Only boundaries next to which a short stretch of
words comes back within the octave become tiles. A tile is solved on its own: Z-functions to the right and to the left of the boundary
give for every period how far equality reaches, and which periods are multiples of a smaller one.
The fragments are shuffled by document and period, and overlapping ones are stitched to runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewake.llm.tokens import pa_type
from pricewake.session import written

MIN_LENGTH = 24
MIN_PERIODS = 3
# Periods below are one octave; its step is twice that, as the least interval is MIN_LENGTH less the period.
FIRST = 8


def octaves(n: int) -> Iterator[tuple[int, int, int]]:
    """(least period, first period above, step) as far as three periods fit into ``n`` words."""
    low, high = 1, FIRST
    while low * MIN_PERIODS <= n:
        yield low, high, max(high, 2 * FIRST)
        low, high = high, 2 * high


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def gram_groups(numbers: np.ndarray, width: int) -> np.ndarray:
    """A number for the ``width`` words (a power of two) from every place; equal stretches get equal ones."""
    mixed = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    size = 1
    while size < width:
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = mixed[:-size] + mixed[size:] * np.uint64(0x94D049BB133111EB)
        size *= 2
    return mixed


def repeats(numbers: np.ndarray) -> bool:
    """Whether any stretch of ``2 * FIRST`` words comes back: without one there is no run."""
    if len(numbers) < MIN_LENGTH:
        return False
    grams = np.sort(gram_groups(numbers, 2 * FIRST))
    return bool((grams[1:] == grams[:-1]).any())


class _Returns:
    """Whether the words from a place come back at a distance within a range."""

    def __init__(self, numbers: np.ndarray, width: int):
        self.n = len(numbers) + 1
        self.size = max(len(numbers) - width + 1, 0)
        grams = gram_groups(numbers, width) if self.size else np.empty(0, np.uint64)
        self.group = np.unique(grams, return_inverse=True)[1].astype(np.int64)
        self.keys = np.sort(self.group * self.n + np.arange(self.size))

    def within(self, places: np.ndarray, low: int, high: int) -> np.ndarray:
        ok = (places >= 0) & (places < self.size)
        out = np.zeros(len(places), bool)
        at = places[ok]
        base = self.group[at] * self.n
        found = np.searchsorted(self.keys, base + np.minimum(at + low, self.n - 1))
        inside = found < len(self.keys)
        inside[inside] = self.keys[found[inside]] < (base + np.minimum(at + high, self.n))[inside]
        out[ok] = inside
        return out


def tiles(numbers: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(least period, step, boundary, first word, words) of every tile that can hold a fragment."""
    n = len(numbers)
    returns = {width: _Returns(numbers, width) for width in (FIRST, 2 * FIRST)}
    for low, high, step in octaves(n):
        # Of an interval of a step's length half or more lies on one side of the boundary.
        width = FIRST if step < 4 * FIRST else 2 * FIRST
        bounds = np.arange(0, n, step)
        near = returns[width].within(bounds, low, high) | returns[width].within(bounds - width, low, high)
        for bound in bounds[near].tolist():
            first = max(bound - step, 0)
            words = numbers[first : bound + step + high]
            # A tile that has a smaller period as a whole holds multiples of that only.
            again = np.flatnonzero(words[1:low] == words[0])
            if any((words[d + 1 :] == words[: -d - 1]).all() for d in again[:4].tolist()):
                continue
            yield low, step, bound, first, words


def z_function(s: list[int]) -> list[int]:
    """For every place the length of the longest common prefix of s and what starts there."""
    n = len(s)
    z = [0] * n
    if not n:
        return z
    z[0] = n
    left = right = 0
    head = s[0]
    for i in range(1, n):
        if i < right:
            known = z[i - left]
            if known < right - i:
                z[i] = known
                continue
            k = right - i
        elif s[i] != head:
            continue
        else:
            k = 1
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def solve(low: int, step: int, bound: int, first: int, words: list[int]) -> list[tuple[int, int, int]]:
    """(period, start, end) of the fragments at the boundary: words from start to end recur a period later.

    Clipped to a step on either side. Periods that are multiples of a smaller one are left out.
    """
    high = 2 * low if low > 1 else FIRST
    here = bound - first
    after = words[here:]
    ahead = z_function(after)
    before = words[:here][::-1]
    whole = words[: here + high][::-1]
    back = z_function([*before, -1, *whole])
    out = []
    for q in range(low, min(high, len(after))):
        if not ahead[q]:
            continue
        # The word before the boundary's partner, counted from the end of what is reversed.
        place = len(before) + 1 + len(whole) - (here + q)
        right, left = min(ahead[q], step), min(back[place], step) if before else 0
        if left + right < step:
            continue
        if any(q % d == 0 and ahead[d] >= q - d for d in range(1, q // 2 + 1)):
            continue
        out.append((q, bound - left, bound + right))
    return out


def _screened(slim: DataFrame, active: bool) -> DataFrame:
    """(id, text_hash, text) of the documents in which words come back, or of the others; words joined by a space."""
    kind = pa_type(slim)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            for i, text in enumerate(batch.column("text")):
                # ``bytes`` splits at ASCII white space alone.
                words = (text.as_py() or b"").split()
                if repeats(word_numbers(words)) == active:
                    rows.append(i)
                    texts.append(b" ".join(words).decode())
            kept = batch.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [kept.column("id"), kept.column("text_hash"), pa.array(texts, pa.string())],
                names=["id", "text_hash", "text"],
            )

    return slim.mapInArrow(screen, f"id {kind}, text_hash long, text string")


def _tiles(docs: DataFrame) -> DataFrame:
    kind = pa_type(docs)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = list(tiles(word_numbers(batch.column("text")[i].as_py().encode().split())))
                for at in range(0, len(found), 256):
                    part = found[at : at + 256]
                    same = pa.array([i] * len(part), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("id").take(same),
                            batch.column("text_hash").take(same),
                            *[pa.array([row[j] for row in part], pa.int32()) for j in range(4)],
                            pa.array([row[4].tobytes() for row in part], pa.binary()),
                        ],
                        names=["id", "text_hash", "low", "step", "bound", "first", "words"],
                    )

    schema = f"id {kind}, text_hash long, low int, step int, bound int, first int, words binary"
    return docs.mapInArrow(explode, schema)


def _fragments(tiled: DataFrame) -> DataFrame:
    kind = pa_type(tiled)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            numbers = [batch.column(name).to_pylist() for name in ("low", "step", "bound", "first")]
            for i, words in enumerate(batch.column("words")):
                here = solve(*(column[i] for column in numbers), np.frombuffer(words.as_py(), np.int32).tolist())
                rows += [i] * len(here)
                found += here
            same = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(same),
                    batch.column("text_hash").take(same),
                    *[pa.array([row[j] for row in found], pa.int32()) for j in range(3)],
                ],
                names=["id", "text_hash", "period", "start", "stop"],
            )

    return tiled.mapInArrow(each, f"id {kind}, text_hash long, period int, start int, stop int")


def stitched(fragments: DataFrame) -> DataFrame:
    """(id, text_hash, start, length, period) of runs, from fragments of a document and period that touch."""
    place = Window.partitionBy("id", "text_hash", "period").orderBy("start", "stop")
    reached = F.max("stop").over(place.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reached.isNull() | (F.col("start") > reached), 1).otherwise(0)
    joined = (
        fragments.withColumn("new", new)
        .withColumn("run", F.sum("new").over(place.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("id", "text_hash", "period", "run")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    )
    length = F.col("stop") - F.col("start") + F.col("period")
    least = F.greatest(F.lit(MIN_LENGTH), MIN_PERIODS * F.col("period"))
    return joined.withColumn("length", length).filter(F.col("length") >= least).select(
        "id", "text_hash", "start", "length", "period"
    )


def keep_words(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run (start, length, period) holds after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    dropped = np.cumsum(gone)[: len(words)] > 0
    return [word for word, drop in zip(words, dropped.tolist(), strict=True) if not drop]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``runs`` (start, length, period; longs, by start, then period), ``text``.

    ``text`` has the words that no run holds after its first period, joined by a space. Words are what stands
    between ASCII white space, numbered from 0; a null, empty or blank text has none, no runs and an empty text.
    Repeated rows are returned each, null ids too. Other columns are not read. Very long texts become tiles that
    many tasks share, whatever their length; a document's runs come together only to cut its text. Tiles and
    fragments are shuffled, whole texts only of documents in which sixteen words come back. Those are written below
    ``spark.checkpoint.dir``, as are their runs.
    """
    text = F.col(text_col).cast("string")
    slim = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text")
    )
    active = written(_screened(slim, True), "repeating")
    # Tiles of one long document are dealt over all tasks.
    tiled = _tiles(active).repartition("id", "text_hash", "low", "bound")
    runs = stitched(_fragments(tiled)).groupBy("id", "text_hash").agg(
        F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in ("start", "period", "length")]))).alias("runs")
    )
    runs = written(runs, "runs").withColumnsRenamed({"id": "run_id", "text_hash": "run_hash"})
    same = F.col("id").eqNullSafe(F.col("run_id")) & (F.col("text_hash") == F.col("run_hash"))
    found = active.join(runs, same, "left").select("id", "text", "runs")
    kind = pa_type(slim)
    item = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, texts = [], []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                spans = [(run["start"], run["length"], run["period"]) for run in own or []]
                lists.append([dict(zip(("start", "length", "period"), span, strict=True)) for span in spans])
                texts.append(" ".join(keep_words(text.split(" "), spans)) if spans else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(lists, pa.list_(item)), pa.array(texts, pa.string())],
                names=["id", "runs", "text"],
            )

    schema = f"id {kind}, runs array<struct<start:long,length:long,period:long>>, text string"
    none = F.array().cast("array<struct<start:bigint,length:bigint,period:bigint>>")
    return (
        found.mapInArrow(cut, schema)
        .unionByName(_screened(slim, False).select("id", none.alias("runs"), "text"))
        .withColumnRenamed("id", id_col)
    )
