"""Rows that pass through Arrow functions with all their columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def keep_rows(docs: DataFrame, text_col: str, mask: Callable[[], Callable[[pa.Array], list[bool]]]) -> DataFrame:
    """The rows whose text passes, with all columns, whatever they are called; no shuffle.

    ``mask`` is called once per task and gives the function from a batch's texts to booleans.
    """
    names = docs.columns
    place = names.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = mask()
        for batch in batches:
            texts = pc.cast(batch.column(place), pa.string())
            yield batch.filter(pa.array(passes(texts), pa.bool_()))

    return plain.mapInArrow(keep, plain.schema).toDF(*names)
