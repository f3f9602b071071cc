import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from helpers import SF, awkward, empty, groups, joined
from pyspark.sql import functions as F

from pricewake.llm import simhash
from pricewake.llm.components import components

BLANK = " \t\n\x0b\x0c\r"


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in BLANK:
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    roots = joined(range(len(rows)), near)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[roots[n]] = min(i, least.get(roots[n], i))
    return Counter((i, f"{fps[n]:016x}", least.get(roots[n])) for n, (i, _) in enumerate(rows))


@pytest.mark.parametrize("direct,block", [(64, 1024), (1, 3)])
def test_like_brute_force(spark, direct, block):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    rows += [(500, None), (501, ""), (502, "A"), (503, "a"), (504, "x y"), (505, "X\x0by\x1fz  ")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, docs.schema), direct=direct, block=block)
    assert Counter(tuple(r[:3]) for r in got.collect()) == brute(rows)


@pytest.mark.parametrize("direct,block", [(0, 4), (5, 7), (1000, 10)])
def test_links_of_crowds(spark, direct, block):
    """Crowds of near fingerprints, and chains of them, by plain joins and by blocks."""
    random.seed(direct)
    fps = set()
    for _ in range(25):
        centre = random.getrandbits(64)
        for _ in range(random.randint(1, 30)):
            fp = centre
            for bit in random.sample(range(64), random.randint(0, 4)):
                fp ^= 1 << bit
            fps.add(fp)
            centre = fp if random.random() < 0.2 else centre
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), direct=direct, block=block)
    pairs = [(r.a, r.b) for r in links.collect()]
    mask = (1 << 64) - 1
    assert all(((a ^ b) & mask).bit_count() <= 3 for a, b in pairs)
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 3]
    assert groups(joined(signed, pairs)) == groups(joined(signed, near))
    if direct == 1000:
        assert {(min(p), max(p)) for p in pairs} == set(near)


def test_components_like_union_find(spark):
    random.seed(9)
    links = [(random.randint(0, 200), random.randint(0, 200)) for _ in range(120)]
    links += [(i, i + 1) for i in range(300, 420)] + [(500, i) for i in range(501, 560)]
    links += [(7, 7), (None, 3), (4, None), links[0]]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components(df, "a", "b").collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert got == joined({x for link in real for x in link}, real)
    assert components(df.filter("a < 0"), "a", "b").count() == 0


def test_one_of_each_class_stays(spark):
    rows = awkward(spark)
    kept = simhash.keep_one(rows)
    assert kept.columns == rows.columns
    got = Counter(r.doc_id for r in kept.collect())
    found = simhash.near_duplicates(rows).collect()
    classes = {r.class_fp for r in found}
    assert sum(got.values()) == len(classes)
    assert got == Counter(
        min((r.doc_id for r in found if r.class_fp == c and r.doc_id is not None), default=None) for c in classes
    )
    assert simhash.keep_one(empty(spark)).count() == 0 and simhash.near_duplicates(empty(spark)).count() == 0


def test_text_is_not_shuffled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit("x"))
    plan = simhash.near_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.replace("text_hash", "")
