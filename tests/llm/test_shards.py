import zlib
from collections import Counter

import pytest
import xxhash
from helpers import SF, awkward, empty

from pricewake.llm import shards


@pytest.mark.parametrize("per_bucket", [10, 4096])
def test_law_and_mixture(spark, per_bucket):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = shards.shard_rows(docs, 7, per_bucket=per_bucket).collect()
    texts = {r.doc_id: r for r in docs.collect()}
    assert sorted(r.doc_id for r in got) == sorted(texts)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sorted(sizes) == list(range(7))
    share = Counter(r.source for r in got)
    by = Counter((r.shard, r.source) for r in got)
    for shard in range(7):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sizes[shard]))
        for source, n in share.items():
            assert abs(by[shard, source] - n / 7) <= 2
    for r in got:
        raw = (texts[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)


def test_like_one_sort(spark):
    """Buckets change nothing: the same places as ordering all rows at once."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    places = [
        {(r.doc_id, r.shard, r.slot) for r in shards.shard_rows(docs, 5, per_bucket=n).collect()} for n in (3, 50, 10**6)
    ]
    assert places[0] == places[1] == places[2]


def fraction(*values):
    """A chained 64-bit hash of longs (8 bytes), texts, and a seed (4 bytes), as a number in [0, 1)."""
    h = 42
    for value, width in values:
        if value is not None:
            raw = value.encode() if width is None else value.to_bytes(width, "little", signed=True)
            h = xxhash.xxh64_intdigest(raw, h)
    return (h >> 11) / (1 << 53)


def brute(rows, shards_wanted, seed=17):
    """Rank by hash within the source, fractional rank, one sort, cut: (id, source, size, crc, shard, slot)."""
    fields = []
    for i, text, source in rows:
        raw = (text or "").encode()
        fields.append((i, source, len(raw) + 16, zlib.crc32(raw)))
    spread = []
    for source in {f[1] for f in fields}:
        own = [(fraction((i, 8), (size, 8), (crc, 8), (seed, 4)), i, size, crc) for i, s, size, crc in fields if s == source]
        offset = fraction((source, None), (seed + 1, 4))
        copies = Counter()
        for rank, (_, i, size, crc) in enumerate(sorted(own)):
            spread.append(((rank + offset) / len(own), i, source or "", size, crc, copies[i, size, crc], source))
            copies[i, size, crc] += 1
    out, total = set(), len(spread)
    for at, (_, i, _, size, crc, copy, source) in enumerate(sorted(spread)):
        shard = at * shards_wanted // total
        out.add((i, source, size, crc, shard, at - -(-shard * total // shards_wanted)))
    return out


@pytest.mark.parametrize("shards_wanted", [1, 7, 300])
def test_like_brute_force(spark, shards_wanted):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    rows = [tuple(r) for r in docs.collect()] + [(900, None, None), (901, "", "s"), (902, "é", "s"), (5, "copy", "s"), (5, "copy", "s")]
    df = spark.createDataFrame(rows, docs.schema)
    for per_bucket in (9, 4096):
        got = shards.shard_rows(df, shards_wanted, per_bucket=per_bucket).collect()
        assert {(r.doc_id, r.source, r.size, r.text_crc32, r.shard, r.slot) for r in got} == brute(rows, shards_wanted)
        assert len(got) == len(rows)


def test_hot_source_and_copies(spark):
    rows = [(1, "same", "en", "hot")] * 50 + [(i, f"t{i}", "en", f"s{i}") for i in range(2, 40)]
    got = shards.shard_rows(awkward(spark, rows), 4, per_bucket=5).collect()
    assert len(got) == 88
    assert {Counter(r.shard for r in got)[s] for s in range(4)} == {22}
    hot = Counter(r.shard for r in got if r.source == "hot")
    # The 38 sources of one row each stand anywhere, the large one evenly around them.
    assert all(8 <= hot[s] <= 17 for s in range(4))


def test_awkward(spark):
    got = shards.shard_rows(awkward(spark), 40).collect()
    assert len(got) == awkward(spark).count()
    assert all(r.slot == 0 for r in got) and len({r.shard for r in got}) == len(got)
    assert shards.shard_rows(empty(spark), 3).count() == 0
