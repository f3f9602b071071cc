"""Small tables with every awkward case, and brute-force versions."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark".split()

AWKWARD = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        # Names that the operators use inside.
        T.StructField("id", T.StringType()),
        T.StructField("key", T.IntegerType()),
        T.StructField("row", T.StringType()),
        T.StructField("fp", T.DoubleType()),
        T.StructField("block", T.StringType()),
        T.StructField("use", T.StringType()),
        T.StructField("a.b", T.StringType()),
    ]
)


def awkward(spark, rows=None):
    """Documents with nulls, empty, very long, equal and repeated texts, and clashing columns."""
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(500)]
    long = " ".join(random.choices(vocabulary, k=30_000))
    base = [
        (1, "alpha beta gamma delta", "en", "a"),
        (1, "alpha beta gamma delta", "en", "a"),
        (2, "alpha beta gamma delta", "de", "b"),
        (3, None, "en", "a"),
        (4, "", "en", None),
        (5, "   \n\t ", None, "b"),
        (6, long, "de", "b"),
        (7, long + " tail", "de", "b"),
        (None, "no id here at all", "en", "a"),
        (None, None, None, None),
        (8, "!!! ??? 123", "en", "a"),
        (9, "x", "en", "c"),
        (10, "line one\nline two\nline three\nline four", "en", "c"),
        (11, "é" * 5000 + " ÀÉ", "fr", "c"),
    ]
    rows = base if rows is None else rows
    return spark.createDataFrame(
        [(*row, f"i{n}", n, "r", float(n), "b", "u", "dot") for n, row in enumerate(rows)], AWKWARD
    )


def empty(spark):
    return spark.createDataFrame([], AWKWARD)


def bag(rows) -> Counter:
    return Counter(map(tuple, rows))


def groups(labels: dict) -> set[frozenset]:
    """The classes of a labelling, whatever the labels are."""
    out: dict = {}
    for node, label in labels.items():
        out.setdefault(label, set()).add(node)
    return {frozenset(x) for x in out.values()}


def joined(nodes, links) -> dict:
    """Smallest node of each node's component."""
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
