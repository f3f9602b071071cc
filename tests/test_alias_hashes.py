"""A large alias table meets the texts in few passes, by hashes that are confirmed in full."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricewake.operators import brands as B


@pytest.mark.parametrize("letters", ["ab", "abcdé 1"])
@pytest.mark.parametrize("word_bound", [False, True])
def test_first_ranks_like_plain_search(letters, word_bound):
    rng = random.Random(len(letters))
    for _ in range(40):
        lows = sorted({"".join(rng.choices(letters, k=rng.randrange(1, 7))) for _ in range(rng.randrange(1, 40))})
        rows = [{"ord": rng.randrange(50), "low": x, "alias": x.upper(), "canonical": "c"} for x in lows]
        known = B.Aliases.shipped(vars(B.Aliases(pa.Table.from_pylist(rows))))
        texts = [None if rng.random() < 0.1 else "".join(rng.choices(letters, k=rng.randrange(15))) for _ in range(60)]

        def holds(text, low):
            at = -1
            while text is not None and (at := text.find(low, at + 1)) >= 0:
                around = (text[at - 1 : at] if at else "", text[at + len(low) : at + len(low) + 1])
                if not word_bound or not any(c.isalnum() for c in around):
                    return True
            return False

        want = [next((i for i, r in enumerate(known.part.to_pylist()) if holds(t, r["low"])), -1) for t in texts]
        # A slice of a batch has its own beginning.
        assert known.first_ranks(pa.array(texts).slice(7), word_bound).tolist() == want[7:]


def test_equal_hashes_are_told_apart():
    rows = [{"ord": i, "low": low, "alias": low, "canonical": "c"} for i, low in enumerate(["abcd", "abce", "xbcd"])]
    known = B.Aliases(pa.Table.from_pylist(rows))
    # All of them and whatever a text holds now have one hash.
    known._same_hash = lambda hashes: (np.repeat(np.arange(len(hashes)), 3), np.tile(np.arange(3), len(hashes)))
    assert known.first_ranks(pa.array(["abce", "zabcdz", "abcz", "xbcd abce", None, ""]), False).tolist() == [1, 0, -1, 1, -1, -1]


def test_a_large_table_is_met_in_one_pass(spark):
    """Passes over the texts follow the bytes of the table: 150,000 short aliases were two."""
    dim = spark.range(150_000).selectExpr("id * 7919 % 100003 AS ord", "'pArt ' || id AS alias", "'c' || id AS canonical")
    texts = spark.range(300).selectExpr("'Lot of PART ' || id * 499 || ', part x' AS text")
    found = B.attach_first_alias(texts, dim)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    held = texts.select("text", F.regexp_extract("text", "[0-9]+", 0).alias("n"))
    want = {}
    for text, n in held.collect():
        numbers = [int(n[:i]) for i in range(1, len(n) + 1)]
        want[text] = min((x * 7919 % 100003, f"pArt {x}", f"c{x}") for x in numbers if x < 150_000 and str(x) == n[: len(str(x))])
    assert {r.text: (r.alias_ord, r.alias, r.canonical) for r in found.collect()} == want
