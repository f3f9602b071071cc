"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors hold whole numbers. The index of a block of vectors is a list of posting segments: the vectors
whose value in one dimension has one quantised size (half powers of two), with those values. Segments are
kept by falling size, so the first ones say most about the scores.

Queries of a batch process the segments level by level into one accumulator per vector and query. What
a vector's open postings can still add or take away is at most the norm of its open values times the norm of
the query, and the index knows the former after every level. A search stops only when that proves that all
but a few vectors are below the k-th best score; those few, the possible members, are scored exactly.

Index blocks are read where they are stored, and queries are shipped to them in passes of bounded size, so no task and
no broadcast grows with the input and no copy of the index is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewake.llm.passes import PASS_BYTES, matrix, query_passes, vector_width
from pricewake.session import written

K = 20
BLOCK = 8192
QUERY_BATCH = 64
# A search stops when at most this share of a block (or ``LEFT`` times the wanted results) is left to score.
SHARE_LEFT = 1 / 32
LEFT = 4


class Block:
    """The impact-ordered index of one block of vectors."""

    def __init__(self, ids, docs, values, levels, dims, starts, width: int):
        self.ids, self.docs, self.values = ids, docs, values
        self.levels, self.dims, self.starts = levels, dims, np.append(starts, len(docs))
        self.vectors = np.zeros((len(ids), width), np.int64)
        self.vectors[docs, np.repeat(dims, np.diff(self.starts))] = values
        squares = values.astype(np.float64) ** 2
        rest = np.bincount(docs, squares, len(ids))
        # Norm of each vector's open values after each level, a little up for rounding.
        self.open = {}
        for level, first, stop in self.by_level():
            a, b = self.starts[first], self.starts[stop]
            rest = rest - np.bincount(docs[a:b], squares[a:b], len(ids))
            self.open[level] = np.sqrt(np.maximum(rest, 0)) * (1 + 1e-9)

    @staticmethod
    def segments(vectors: np.ndarray) -> tuple[np.ndarray, ...]:
        """Postings and segments of a matrix: docs, values; levels, dims, starts."""
        docs, dims = np.nonzero(vectors)
        values = vectors[docs, dims]
        levels = np.floor(2 * np.log2(np.abs(values))).astype(np.int32)
        order = np.lexsort((docs, dims, -levels))
        docs, dims, values, levels = docs[order], dims[order], values[order], levels[order]
        new = np.ones(len(docs), bool)
        new[1:] = (np.diff(levels) != 0) | (np.diff(dims) != 0)
        starts = np.flatnonzero(new)
        return docs.astype(np.int32), values, levels[starts], dims[starts].astype(np.int32), starts

    def by_level(self) -> Iterator[tuple[int, int, int]]:
        """(level, first segment, end segment) by falling level."""
        edges = [0, *(np.flatnonzero(np.diff(self.levels)) + 1).tolist(), len(self.levels)]
        for first, stop in zip(edges, edges[1:], strict=False):
            if stop > first:
                yield int(self.levels[first]), first, stop

    def search(self, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the places and exact scores of the vectors that can be among its ``k`` best."""
        n, batch = len(self.ids), len(queries)
        norms = np.sqrt((queries.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
        largest = norms.max(initial=0) * np.sqrt((self.vectors.astype(np.float64) ** 2).sum(1)).max(initial=0)
        # Whole numbers below 2^24 are exact in single precision.
        kind = np.float32 if largest < 1 << 23 else np.float64
        found = np.zeros((n, batch), kind)
        weights, values = queries.T.astype(kind), self.values.astype(kind)
        possible = None
        enough = max(k * LEFT, int(n * SHARE_LEFT))
        for level, first, stop in self.by_level() if n > enough else ():
            for segment in range(first, stop):
                a, b = self.starts[segment], self.starts[segment + 1]
                found[self.docs[a:b]] += values[a:b, None] * weights[self.dims[segment]]
            if 2 * self.starts[stop] >= len(self.docs):
                rest = self.open[level][:, None] * norms
                kth = np.partition(found - rest, n - k, axis=0)[n - k]
                possible = found + rest >= kth
                if possible.sum() <= enough * batch:
                    break
        for i, query in enumerate(queries):
            left = np.arange(n) if possible is None else np.flatnonzero(possible[:, i])
            yield left, self.vectors[left] @ query


def quantised(vectors: DataFrame, id_col: str, vector_col: str, factor: float = 64.0) -> DataFrame:
    """(id, vector) with components floor(factor * x); null, non-finite and id-less rows left out."""
    x = F.col("raw")
    finite = F.forall("raw", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("raw"))
        .filter(F.col("id").isNotNull() & x.isNotNull() & finite)
        .select("id", F.transform(x, lambda v: F.floor(F.lit(factor) * v).cast("long")).alias("vector"))
    )


def build_index(vectors: DataFrame, blocks: int) -> DataFrame:
    """One row per block of (id, vector): ids, flat vectors, and the order of every dimension."""
    width = vector_width(vectors)
    placed = vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        docs, values, levels, dims, starts = Block.segments(matrix(rows.vector, width))
        parts = {
            "ids": rows.id.to_numpy(np.int64),
            "docs": docs,
            "values": values,
            "levels": levels,
            "dims": dims,
            "starts": starts.astype(np.int64),
        }
        least = np.result_type(*map(np.min_scalar_type, (values.min(initial=0), values.max(initial=0))))
        parts["values"] = values.astype(least)
        stored = {name: [part.tobytes()] for name, part in parts.items()}
        return pd.DataFrame({"block": [int(rows.block.iloc[0])], "width": [width], "kind": [least.str], **stored})

    schema = (
        "block int, width int, kind string, ids binary, docs binary, values binary, "
        "levels binary, dims binary, starts binary"
    )
    return written(placed.groupBy("block").applyInPandas(build, schema), "impact-index")


def _stored(batch: pa.RecordBatch, i: int) -> Block:
    row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
    kinds = {"ids": np.int64, "docs": np.int32, "values": row["kind"], "levels": np.int32, "dims": np.int32, "starts": np.int64}
    parts = {name: np.frombuffer(row[name], kind) for name, kind in kinds.items()}
    return Block(**parts, width=row["width"])


def _nearest(shipped, k: int):
    """The ``k`` best of every index block for every query of a pass."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns, vectors = shipped.value
        for batch in batches:
            for i in range(batch.num_rows):
                here, rows = _stored(batch, i), []
                asked = vectors[:, : here.vectors.shape[1]]
                for start in range(0, len(asked), QUERY_BATCH):
                    # One more, as the query's own row may be among the best and is not wanted.
                    best = here.search(asked[start : start + QUERY_BATCH], k + 1)
                    for own, (places, scores) in zip(owns[start : start + QUERY_BATCH].tolist(), best, strict=True):
                        ids = here.ids[places]
                        scores, ids = scores[ids != own], ids[ids != own]
                        order = np.lexsort((ids, -scores))[:k]
                        rows.append((np.full(len(order), own), ids[order], scores[order]))
                columns = [np.concatenate([row[c] for row in rows]) if rows else [] for c in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"]
                )

    return search


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    block: int = BLOCK,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): every query's k largest inner products.

    Both inputs are (id long, vector array<long>) as ``quantised`` gives them. A query's own id
    is no candidate; ties go to the smaller id; fewer candidates give fewer rows. Of rows with
    one id the smallest vector counts. Missing trailing components are zero. Empty
    inputs give no rows. Scores are exact below 2^53. The index, and the results of every pass of queries over it,
    are written below ``spark.checkpoint.dir``; a task holds one block of the index, the driver one pass.
    """
    spark = vectors.sparkSession
    once = vectors.groupBy("id").agg(F.min("vector").alias("vector"))
    blocks = max(1, -(-once.count() // block))
    index = build_index(once, blocks)
    asked = written(queries.groupBy("id").agg(F.min("vector").alias("vector")), "queries")
    # A query's components beyond the index's meet nothing.
    width = vector_width(once)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    results = []
    for part in query_passes(asked, width, pass_bytes):
        rows = matrix(part.column("vector").to_pylist(), width)
        shipped = spark.sparkContext.broadcast((part.column("id").to_numpy(), rows))
        found = index.mapInArrow(_nearest(shipped, k), "query_id long, vec_id long, score long")
        ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        results.append(written(ranked.select("query_id", "rank", "vec_id", "score"), "nearest"))
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = results[0]
    for part in results[1:]:
        out = out.unionByName(part)
    return out
