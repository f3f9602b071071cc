"""Hard negatives by an inverted multi-index.

A vector is cut into two halves. Each half has a codebook, fitted on a bounded sample; a pair of codewords is a
cell. Within an index block the vectors lie in the order of their cells, and each codeword has a radius: the
largest distance of a member's half from it. The half-score of an anchor and a codeword, up and down by the norm
of the anchor's half times the radius, bounds what the members' halves can score.

A search walks the cells by falling sum of both upper half-scores, as a multi-sequence heap gives them.
A cell whose lower bound lies above every window is passed over, all others are scored in full. The search
stops once the next sum is below what every list or window still needs: nothing later can belong to it.

First the positives of every anchor, then, with their scores, the windows of its negatives. Index blocks are
read where they are stored, anchors are shipped in passes of bounded size.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewake.llm.passes import PASS_BYTES, matrix, query_passes, vector_width
from pricewake.session import written

POSITIVES = 5
NEGATIVES = 5
# A negative scores between these shares (in percent) of its positive.
LOW, HIGH = 80, 100
BLOCK = 8192
CODEWORDS = 16
# Rows that the codebooks are fitted on (those with the smallest hash of the id), and rounds of the fit.
SAMPLE = 16_384
ROUNDS = 8
# Rows that a search scores at a time.
PORTION = 256


def fit_codebook(points: np.ndarray, codewords: int, rounds: int = ROUNDS) -> np.ndarray:
    """Means of at most ``codewords`` groups; starts from points far from those before."""
    points = points.astype(np.float64)
    words = points[:1]
    near = ((points - words[0]) ** 2).sum(1)
    while len(words) < codewords and near.max(initial=0) > 0:
        words = np.vstack([words, points[near.argmax()]])
        near = np.minimum(near, ((points - words[-1]) ** 2).sum(1))
    for _ in range(rounds):
        own = nearest(points, words)
        sums = np.zeros_like(words)
        np.add.at(sums, own, points)
        sizes = np.bincount(own, minlength=len(words))
        words = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], words)
    return words


def nearest(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(1) - 2 * points @ words.T).argmin(1)


class Cells:
    """An index block: rows in the order of their cells, with the radii of both codebooks."""

    def __init__(self, ids, labels, vectors, starts, radii, books):
        self.ids, self.labels = ids, labels
        # Whole numbers below 2^53 are exact.
        self.vectors = vectors.astype(np.float64)
        self.starts, self.radii, self.books = starts, radii, books
        self.half = books[0].shape[1]

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, books) -> Cells:
        half = books[0].shape[1]
        halves = (vectors[:, :half].astype(np.float64), vectors[:, half:].astype(np.float64))
        owns = [nearest(points, words) for points, words in zip(halves, books, strict=True)]
        radii = []
        for points, words, own in zip(halves, books, owns, strict=True):
            # A codeword without members has no radius and its cells are never visited.
            radius = np.full(len(words), -np.inf)
            np.maximum.at(radius, own, np.sqrt(((points - words[own]) ** 2).sum(1)))
            radii.append(radius)
        cell = owns[0] * len(books[1]) + owns[1]
        order = np.lexsort((ids, cell))
        starts = np.searchsorted(cell[order], np.arange(len(books[0]) * len(books[1]) + 1))
        return cls(ids[order], labels[order], vectors[order], starts, radii, books)

    def _half_scores(self, query: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each half the codewords by falling upper bound, those bounds, and the lower ones."""
        for part, words, radius in zip((query[: self.half], query[self.half :]), self.books, self.radii, strict=True):
            middle, reach = words @ part, np.sqrt(part @ part) * radius
            # A little wider, for rounding.
            slack = 1e-9 * (np.abs(middle) + np.abs(np.where(np.isfinite(reach), reach, 0)) + 1)
            order = np.argsort(-(middle + reach), kind="stable")
            order = order[np.isfinite(radius[order])]
            yield order, (middle + reach + slack)[order], (middle - reach - slack)[order]

    def walk(
        self, query: np.ndarray, needed: Callable[[], float], highest: float = np.inf
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and scores of the rows of cells by falling bound, until it is below ``needed()``.

        Cells that lie wholly above ``highest`` are passed over.
        """
        (rows, up1, low1), (columns, up2, low2) = self._half_scores(query)
        if not len(rows) or not len(columns):
            return
        heap, waiting, size = [(-(up1[0] + up2[0]), 0, 0)], [], 0
        width = len(self.books[1])
        while heap and -heap[0][0] >= needed():
            _, i, j = heapq.heappop(heap)
            if j == 0 and i + 1 < len(rows):
                heapq.heappush(heap, (-(up1[i + 1] + up2[0]), i + 1, 0))
            if j + 1 < len(columns):
                heapq.heappush(heap, (-(up1[i] + up2[j + 1]), i, j + 1))
            cell = rows[i] * width + columns[j]
            a, b = self.starts[cell], self.starts[cell + 1]
            if a == b or low1[i] + low2[j] > highest:
                continue
            waiting.append(np.arange(a, b))
            size += b - a
            if size >= PORTION:
                places = np.concatenate(waiting)
                yield places, (self.vectors[places] @ query).astype(np.int64)
                waiting, size = [], 0
        if waiting:
            places = np.concatenate(waiting)
            yield places, (self.vectors[places] @ query).astype(np.int64)

    def positives(self, own: int, label: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, id) of the ``k`` best rows of the label, the anchor left out."""
        best: list[tuple[int, int]] = []
        for places, scores in self.walk(query, lambda: -best[-1][0] if len(best) == k else -np.inf):
            ok = (self.labels[places] == label) & (self.ids[places] != own)
            best = sorted(best + list(zip((-scores[ok]).tolist(), self.ids[places[ok]].tolist(), strict=True)))[:k]
        return [(-score, id_) for score, id_ in best]

    def windows(self, label: int, query: np.ndarray, scores: list[int], k: int, low: int, high: int) -> list[list]:
        """For each positive score the ``k`` best (score, id) of other labels within its window."""
        found: list[list[tuple[int, int]]] = [[] for _ in scores]
        # 100 * negative from low * positive to high * positive; a window can be empty.
        spans = [(-(-low * s // 100), high * s // 100) for s in scores]
        live = [w for w, (a, b) in enumerate(spans) if a <= b]
        if not live:
            return found

        def needed() -> float:
            return min(-found[w][-1][0] if len(found[w]) == k else spans[w][0] for w in live)

        for places, values in self.walk(query, needed, max(spans[w][1] for w in live)):
            other = self.labels[places] != label
            places, values = places[other], values[other]
            for w in live:
                ok = (values >= spans[w][0]) & (values <= spans[w][1])
                if ok.any():
                    more = list(zip((-values[ok]).tolist(), self.ids[places[ok]].tolist(), strict=True))
                    found[w] = sorted(found[w] + more)[:k]
        return [[(-score, id_) for score, id_ in rows] for rows in found]


def labelled_vectors(rows: DataFrame, id_col: str, vector_col: str, label, factor: float) -> DataFrame:
    """(id, label, vector) with components floor(factor * x).

    Rows without an id, a label or a vector, or with a null or non-finite component, are left out. Of rows with one
    id the smallest (vector, label) counts.
    """
    finite = F.forall("raw", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    raw = rows.select(
        F.col(id_col).cast("long").alias("id"),
        label.cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("raw"),
    ).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("raw").isNotNull() & finite)
    vector = F.transform("raw", lambda v: F.floor(F.lit(factor) * v).cast("long"))
    least = F.min(F.struct(vector.alias("vector"), "label"))
    return raw.groupBy("id").agg(least.alias("least")).select("id", "least.label", "least.vector")


def build_cells(vectors: DataFrame, books, width: int, blocks: int) -> DataFrame:
    """One row per block of (id, label, vector): its rows in the order of their cells."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    placed = vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        values = matrix(rows.vector, width)
        cells = Cells.build(rows.id.to_numpy(np.int64), rows.label.to_numpy(np.int64), values, shared.value)
        values = cells.vectors.astype(np.int64)
        least = np.result_type(*map(np.min_scalar_type, (values.min(initial=0), values.max(initial=0))))
        parts = {
            "ids": cells.ids.astype(np.int64),
            "labels": cells.labels.astype(np.int64),
            "vectors": values.astype(least),
            "starts": cells.starts.astype(np.int64),
            "radii": np.concatenate(cells.radii),
        }
        stored = {name: [part.tobytes()] for name, part in parts.items()}
        return pd.DataFrame({"block": [int(rows.block.iloc[0])], "kind": [least.str], **stored})

    schema = "block int, kind string, ids binary, labels binary, vectors binary, starts binary, radii binary"
    return written(placed.groupBy("block").applyInPandas(build, schema), "multi-index")


def _stored(batch: pa.RecordBatch, i: int, books, width: int) -> Cells:
    row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
    ids, labels, starts = (np.frombuffer(row[name], np.int64) for name in ("ids", "labels", "starts"))
    radii = np.frombuffer(row["radii"], np.float64)
    vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(len(ids), width)
    return Cells(ids, labels, vectors, starts, (radii[: len(books[0])], radii[len(books[0]) :]), books)


def _visit(index: DataFrame, shipped, search, schema: str) -> DataFrame:
    """``search(cells, shipped queries)`` for every block of the index, read where it is stored."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, width, asked = shipped.value
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(search(_stored(batch, i, books, width), asked))
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    names = [field.split()[0] for field in schema.split(", ")]
    return index.mapInArrow(visit, schema)


def mine(
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    block: int = BLOCK,
    codewords: int = CODEWORDS,
    sample: int = SAMPLE,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score).

    Both inputs are (id long, label long, vector array<long>), as ``labelled_vectors`` gives them; anchors are rows
    of ``vectors``. An anchor's positives are its ``positives`` best other rows of the same label by inner
    product; for each, the first ``negatives`` rows of other labels that score from ``low`` to ``high`` percent of
    the positive. Higher scores come first, ties go to the smaller id; fewer rows give fewer results,
    and a negative positive score has an empty window. Missing trailing components are zero. Empty inputs give no rows.

    Codebooks are fitted on the ``sample`` rows with the smallest hash of their id; they only say where the search
    looks first. Every row is indexed and all results are exact below 2^53. The index and the results of every
    pass over it are written below ``spark.checkpoint.dir``; a task holds one block, the driver one pass of anchors.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    vectors = written(vectors.select("id", "label", "vector"), "labelled")
    n, width = vectors.count(), vector_width(vectors)
    if not n:
        return spark.createDataFrame([], schema)
    some = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()
    points = matrix(some.column("vector").to_pylist(), width)
    half = (width + 1) // 2
    books = (fit_codebook(points[:, :half], codewords), fit_codebook(points[:, half:], codewords))
    index = build_cells(vectors, books, width, max(1, -(-n // block)))

    def likes(cells: Cells, asked: list) -> Iterator[tuple]:
        for id_, label, query in asked:
            for score, other in cells.positives(id_, label, query, positives):
                yield id_, other, score

    def between(cells: Cells, asked: list) -> Iterator[tuple]:
        for id_, label, query, pairs in asked:
            found = cells.windows(label, query, [score for _, score in pairs], negatives, low, high)
            for (other, score), rows in zip(pairs, found, strict=True):
                for value, negative in rows:
                    yield id_, other, score, negative, value

    results = []
    for asked in query_passes(anchors.select("id", "label", "vector"), width, pass_bytes):
        queries = matrix(asked.column("vector").to_pylist(), width).astype(np.float64)
        ids, labels = asked.column("id").to_pylist(), asked.column("label").to_pylist()
        shipped = spark.sparkContext.broadcast((books, width, list(zip(ids, labels, queries, strict=True))))
        near = _visit(index, shipped, likes, "anchor_id long, id long, score long")
        best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
        # At most ``positives`` rows an anchor of the pass.
        firsts = near.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives).collect()
        own: dict[int, list] = {}
        for row in firsts:
            own.setdefault(row.anchor_id, []).append((row.id, row.score))
        windows = [(i, label, q, own[i]) for i, label, q in zip(ids, labels, queries, strict=True) if i in own]
        shipped = spark.sparkContext.broadcast((books, width, windows))
        fields = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
        hard = _visit(index, shipped, between, fields)
        first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
        ranked = hard.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= negatives)
        results.append(written(ranked.select(*[field.split()[0] for field in schema.split(", ")]), "negatives"))
    out = results[0] if results else spark.createDataFrame([], schema)
    for part in results[1:]:
        out = out.unionByName(part)
    return out
