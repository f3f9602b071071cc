"""Queries of bounded size that visit an index where it is stored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Query vectors that are shipped to the tasks at a time.
PASS_BYTES = 16 << 20


def vector_width(vectors: DataFrame) -> int:
    """Components of the longest vector."""
    return vectors.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0]


def matrix(column, width: int) -> np.ndarray:
    """Lists of whole numbers as the rows of a matrix; missing trailing components are zero."""
    out = np.zeros((len(column), width), np.int64)
    for row, values in zip(out, column, strict=True):
        row[: min(len(values), width)] = values[:width]
    return out


def query_passes(queries: DataFrame, width: int, pass_bytes: int = PASS_BYTES) -> Iterator[pa.Table]:
    """The rows of (id, vector, ...) in tables of about ``pass_bytes``, dealt by a hash of the id.

    Each pass reads the index once, where it is stored: what is shipped is the pass, whose size does not
    grow with the input, and no copy of the index is made or shuffled.
    """
    parts = max(1, -(-queries.count() * max(width, 1) * 8 // pass_bytes))
    part = F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(parts))
    for i in range(parts):
        found = queries.filter(part == i).toArrow()
        if found.num_rows:
            yield found.sort_by("id")
