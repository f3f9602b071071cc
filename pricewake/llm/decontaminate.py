"""Benchmark decontamination: BM25 retrieval of test items by block-max WAND.

The test items make an inverted index of word pairs. A posting's impact is its BM25
score divided by the item's best possible score, so that one threshold serves all items.
Every training text is cut into passages of two chunks of words, one chunk apart; a chunk
is as long as the longest item, so each place an item can stand in lies within some passage.
Each passage is a query. The sum of its terms' largest impacts, WAND's first test, is taken
for all passages of a batch at once; those that pass it run block-max WAND, which
retrieves every item above the threshold. A retrieved item is a leak when the passage
holds at least ``overlap`` of the five-word shingles of its question and of its answer;
an item without an answer of its own is all question.

Items come in blocks of bounded size, one index and one pass over the texts each, so the
index that is shipped to the tasks has a bound however many items there are.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pricewake.llm.rows import keep_rows
from pricewake.llm.tokens import byte_groups, pa_type

K1, B = 1.2, 0.75
CHUNK = 64
POSTINGS = 64
SHINGLE = 5
OVERLAP = 0.8
THRESHOLD = 0.5
ITEMS_PER_BLOCK = 20_000
BYTES_PER_BLOCK = 16 << 20
GROUP_BYTES = 2 << 20
_EPS = 1e-9

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def split_item(text: str | None) -> tuple[str, str]:
    """Question and answer of an item without an answer of its own: all of it is the question."""
    return text or "", ""


def shingles(words: list[str], width: int = SHINGLE) -> set[tuple[str, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def share_found(wanted: set[tuple[str, ...]], words: list[str], width: int = SHINGLE) -> float:
    """Share of the shingles that stand in the words; 1 where there are none."""
    if not wanted:
        return 1.0
    found = set()
    for size in {len(x) for x in wanted}:
        found |= wanted & {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
    return len(found) / len(wanted)


@dataclass
class Index:
    """Inverted index of one block of items."""

    ids: list
    questions: list[set]
    answers: list[set]
    vocabulary: dict[str, int]
    keys: np.ndarray  # sorted term keys; a term's number is its place
    largest: np.ndarray  # largest impact of each term
    postings: list[tuple[list[int], list[float], list[float]]]  # items, impacts, block maxima
    chunk: int
    single: bool  # whether items of one word made terms of one word

    @classmethod
    def build(cls, items: list[tuple], chunk: int = CHUNK) -> Index:
        """From (id, question, answer); items without words take no part."""
        kept, texts = [], []
        for item, question, answer in items:
            q, a = words_of(question), words_of(answer)
            if q or a:
                kept.append((item, shingles(q), shingles(a)))
                texts.append(q + a)
        vocabulary: dict[str, int] = {}
        for words in texts:
            for word in words:
                vocabulary.setdefault(word, len(vocabulary))
        terms = []
        for words in texts:
            ids = [vocabulary[word] for word in words]
            pairs = zip(ids, ids[1:], strict=False)
            # A pair has the key (a + 1) * size + b, a lone word its number below size.
            keys = [(a + 1) * len(vocabulary) + b for a, b in pairs] or ids
            terms.append(Counter(keys))
        frequency = Counter(key for counts in terms for key in counts)
        mean = sum(c.total() for c in terms) / max(1, len(terms))
        lists = defaultdict(list)
        for number, counts in enumerate(terms):
            norm = K1 * (1 - B + B * counts.total() / mean)
            scores = {
                key: math.log(1 + (len(terms) - frequency[key] + 0.5) / (frequency[key] + 0.5))
                * tf * (K1 + 1) / (tf + norm)
                for key, tf in counts.items()
            }
            best = sum(scores.values())
            for key, score in scores.items():
                lists[key].append((number, score / best))
        order = sorted(lists)
        postings = []
        for key in order:
            impacts = [impact for _, impact in lists[key]]
            tops = [max(impacts[i : i + POSTINGS]) for i in range(0, len(impacts), POSTINGS)]
            postings.append(([number for number, _ in lists[key]], impacts, tops))
        return cls(
            [x[0] for x in kept],
            [x[1] for x in kept],
            [x[2] for x in kept],
            vocabulary,
            np.array(order, np.int64),
            np.array([max(impacts) for _, impacts, _ in postings]),
            postings,
            max([chunk, *map(len, texts)]),
            any(len(words) == 1 for words in texts),
        )

    def terms(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(place, term) of every index term in the words, by place."""
        get = self.vocabulary.get
        ids = np.fromiter((get(word, -1) for word in words), np.int64, len(words))
        if not len(ids) or not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        places, keys = both, (ids[both] + 1) * len(self.vocabulary) + ids[both + 1]
        if self.single:
            known = np.flatnonzero(ids >= 0)
            places, keys = np.concatenate([places, known]), np.concatenate([keys, ids[known]])
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        places, at = places[hit], at[hit]
        order = np.argsort(places, kind="stable")
        return places[order], at[order]

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: every item whose score reaches the threshold, exactly."""
        need = threshold - _EPS
        cursors = [[self.postings[t][0][0], 0, t] for t in terms]
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, cursor in enumerate(cursors):
                bound += self.largest[cursor[2]]
                if bound >= need:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # What the blocks that can hold the item allow, and how far they reach.
            bound, reach = 0.0, len(self.ids)
            for _, position, t in cursors[: pivot + 1]:
                items, _, tops = self.postings[t]
                place = bisect_left(items, item, position)
                if place < len(items):
                    block = place // POSTINGS
                    bound += tops[block]
                    reach = min(reach, items[min(len(items), (block + 1) * POSTINGS) - 1])
            if bound < need:
                target = reach + 1
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
            elif cursors[0][0] == item:
                score = sum(
                    self.postings[t][1][position] for at, position, t in cursors[: pivot + 1] if at == item
                )
                if score >= need:
                    found.append((item, float(score)))
                target = item + 1
            else:
                target = item
            cursors = [
                moved
                for i, cursor in enumerate(cursors)
                if (moved := self._moved(cursor, target) if i <= pivot else cursor)
            ]
        return found

    def _moved(self, cursor: list, target: int) -> list | None:
        if cursor[0] >= target:
            return cursor
        items = self.postings[cursor[2]][0]
        place = bisect_left(items, target, cursor[1])
        return [items[place], place, cursor[2]] if place < len(items) else None

    def leaks(self, texts: list[str | None], threshold: float, overlap: float) -> list[tuple]:
        """(text, item, score, question, answer, first word) of the best passage of each leak."""
        cut = [words_of(text) for text in texts]
        out = []
        for number, words in enumerate(cut):
            places, terms = self.terms(words)
            if not len(places):
                continue
            chunks = places // self.chunk
            sums = np.bincount(chunks, self.largest[terms])
            bounds = sums + np.append(sums[1:], 0.0)
            best: dict[int, tuple] = {}
            for passage in np.flatnonzero(bounds >= threshold - _EPS).tolist():
                first = passage * self.chunk
                a, b = np.searchsorted(places, [first, first + 2 * self.chunk])
                hits = self.search(np.unique(terms[a:b]).tolist(), threshold)
                own = words[first : first + 2 * self.chunk + 1]
                for item, score in hits:
                    if item in best and best[item][0] >= score:
                        continue
                    question = share_found(self.questions[item], own)
                    answer = share_found(self.answers[item], own)
                    if question >= overlap and answer >= overlap:
                        best[item] = (score, question, answer, first)
            out += [(number, item, *best[item]) for item in sorted(best)]
        return out


def item_blocks(items: DataFrame, id_col: str, question_col: str, answer_col: str | None):
    """The items as lists of (id, question, answer), each block of bounded size."""
    columns = [F.col(id_col).alias("id"), F.col(question_col).cast("string").alias("question")]
    columns += [F.col(answer_col).cast("string").alias("answer")] if answer_col else []
    rows = items.select(*columns).filter(F.col("question").isNotNull())
    size = F.octet_length("question") + (F.coalesce(F.octet_length("answer"), F.lit(0)) if answer_col else 0)
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS_PER_BLOCK), -(-total // BYTES_PER_BLOCK))
    place = F.pmod(F.xxhash64(*rows.columns), F.lit(blocks))
    for block in range(blocks if n else 0):
        found = sorted(rows.filter(place == block).collect(), key=lambda r: (r["id"] is None, r["id"], r["question"]))
        yield [
            (row["id"], row["question"], row["answer"]) if answer_col else (row["id"], *split_item(row["question"]))
            for row in found
        ]


def _groups(texts: pa.Array) -> Iterator[tuple[int, list]]:
    sizes = pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0).to_pylist()
    for start, stop in byte_groups(sizes, GROUP_BYTES):
        yield start, texts.slice(start, stop - start).to_pylist()


def leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    question_col: str = "text",
    answer_col: str | None = None,
    threshold: float = THRESHOLD,
    overlap: float = OVERLAP,
) -> DataFrame:
    """One row per document and leaked item: ids, ``score``, ``question_overlap``,
    ``answer_overlap``, ``first_word`` of the best passage (the first of equal ones).

    Without ``answer_col`` the whole item is the question: it is verified as one, and ``answer_overlap``
    is 1. Null or empty texts leak nothing; null items and items without words match nothing; parts of under five
    words count as one shingle. Repeated rows and items are matched each, null ids
    stay null, other columns are not read, empty tables give no rows. Texts are read
    once per block of items and never shuffled.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    item_type = items.select(F.col(item_col).alias("id")).schema["id"].dataType
    item_arrow = to_arrow_type(item_type)
    schema = (
        f"id {pa_type(slim)}, item {item_type.simpleString()}, score double, question_overlap double, "
        "answer_overlap double, first_word long"
    )
    result = None
    for block in item_blocks(items, item_col, question_col, answer_col):
        shipped = docs.sparkSession.sparkContext.broadcast(Index.build(block))

        def scan(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            kinds = (pa.float64(), pa.float64(), pa.float64(), pa.int64())
            for batch in batches:
                found = []
                for start, texts in _groups(batch.column("text")):
                    found += [(start + x[0], *x[1:]) for x in index.leaks(texts, threshold, overlap)]
                if not found:
                    continue
                ids = batch.column("id").take(pa.array([x[0] for x in found], pa.int64()))
                numbers = [pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds, 2)]
                items_found = pa.array([index.ids[x[1]] for x in found], item_arrow)
                yield pa.RecordBatch.from_arrays(
                    [ids, items_found, *numbers],
                    names=["id", "item", "score", "question_overlap", "answer_overlap", "first_word"],
                )

        part = slim.mapInArrow(scan, schema)
        result = part if result is None else result.unionAll(part)
    if result is None:
        result = docs.sparkSession.createDataFrame([], schema)
    return result.withColumnsRenamed({"id": id_col, "item": item_col})


def drop_leaks(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    question_col: str = "text",
    answer_col: str | None = None,
    threshold: float = THRESHOLD,
    overlap: float = OVERLAP,
) -> DataFrame:
    """The documents without a leaked item, by the search of ``leaks``.

    Rows pass through with all their columns; no shuffle, no join on an id, so null and repeated ids
    are no special case.
    """
    for block in item_blocks(items, item_col, question_col, answer_col):
        shipped = docs.sparkSession.sparkContext.broadcast(Index.build(block))

        def mask(shipped=shipped):
            index = shipped.value

            def passes(texts: pa.Array) -> list[bool]:
                clean = [True] * len(texts)
                for start, group in _groups(texts):
                    for found in index.leaks(group, threshold, overlap):
                        clean[start + found[0]] = False
                return clean

            return passes

        docs = keep_rows(docs, text_col, mask)
    return docs
