import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import SF, awkward, empty

from pricewake.llm import queries, runs

BLANK = " \t\n\x0b\x0c\r"


def words_of(text):
    for c in BLANK:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(words):
    """(start, length, period) of all runs: every period, every stretch, the smallest period of each."""
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x = np.array([names[w] for w in words], np.int64)
    n, best = len(x), {}
    for q in range(1, n // 3 + 1):
        same = np.concatenate([[0], (x[:-q] == x[q:]).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(same))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a + q >= max(24, 3 * q):
                best.setdefault((a, b - a + q), q)
    return sorted((a, length, q) for (a, length), q in best.items())


def collapse(words, found):
    gone = {i for a, length, q in found for i in range(a + q, a + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_texts(seed):
    random.seed(seed)
    letters = [f"w{i}" for i in range(40)]
    texts = []
    for p in [1, 1, 2, 3, 5, 7, 8, 9, 12, 15, 16, 17, 23, 31, 32, 33, 60, 64, 100, 127, 150]:
        for few in (2, 40):
            unit = random.choices(letters[:few], k=p)
            times = random.choice([2, 3, 4, 9, 30])
            head, tail = (random.choices(letters, k=random.randrange(90)) for _ in range(2))
            body = (unit * (times + 1))[: p * times + random.randrange(p)]
            texts.append(head + body + tail)
    unit = random.choices(letters, k=11)
    texts.append((unit * 4)[:40] + ["x"] + unit * 6 + ["y"] * 30 + ["x", "y"] * 40)
    texts.append([c for k in range(400) for c in ("abaab"[k % 5],)])
    fib = ["a", "a b"]
    for _ in range(12):
        fib.append(f"{fib[-1]} {fib[-2]}")
    texts.append(fib[-1].split())
    texts += [random.choices("ab", k=600), ["one"] * 23, ["one"] * 24, ["one"] * 5000, ["a", "b"] * 12, ["a", "b"] * 11]
    return [" ".join(t) for t in texts]


def test_like_brute_force(spark):
    texts = periodic_texts(5)
    rows = list(enumerate(texts)) + [(500, "\n".join(texts[3].split())), (501, texts[4] + "   z")]
    got = runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = {i: (words_of(t), brute(words_of(t))) for i, t in rows}
    assert {r.doc_id: [tuple(x) for x in r.runs] for r in got} == {i: found for i, (_, found) in want.items()}
    assert {r.doc_id: r.text for r in got} == {i: collapse(*both) for i, both in want.items()}
    assert sum(len(found) for _, found in want.values()) > 60


@pytest.mark.parametrize("seed", range(6))
def test_tiles_and_stitching_without_spark(seed):
    """Every interval of a run is the union of its fragments."""
    for text in periodic_texts(100 + seed):
        words = text.split()
        numbers = runs.word_numbers([w.encode() for w in words])
        parts = {}
        for low, step, bound, first, tile in runs.tiles(numbers):
            for q, a, b in runs.solve(low, step, bound, first, tile.tolist()):
                parts.setdefault(q, []).append((a, b))
        found = []
        for q, spans in parts.items():
            merged = []
            for a, b in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            found += [(a, b - a + q, q) for a, b in merged if b - a + q >= max(24, 3 * q)]
        assert sorted(found) == brute(words)
        assert found == [] or runs.repeats(numbers)


def test_z_function():
    random.seed(1)
    for n in [0, 1, 2, 50, 300]:
        s = random.choices([1, 2], k=n)
        z = runs.z_function(s)
        for i in range(n):
            k = 0
            while i + k < n and s[k] == s[i + k]:
                k += 1
            assert z[i] == k


def planted(doc_id, text):
    words = words_of(text)
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_query_like_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for doc_id, text in docs:
        words = planted(doc_id, text)
        found = brute(words)
        top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        listed = "".join(f"{a},{length},{q}\n" for a, length, q in found)
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (listed, collapse(words, found))]
        want[doc_id] = (len(found), *top, top[0] is not None and 1000 * top[1] // top[2] or None, *digests)
    df = queries.op12_periodic_runs(spark, SF)
    got = {r.doc_id: tuple(r)[1:] for r in df.collect()}
    assert got == want and any(row[0] for row in want.values())


def test_awkward_documents(spark):
    docs = awkward(spark)
    got = runs.periodic_runs(docs)
    assert got.columns == ["doc_id", "runs", "text"]
    want = Counter()
    for r in docs.collect():
        words = words_of(r.text)
        found = brute(words) if len(words) < 2000 else []
        want[r.doc_id, tuple(found), collapse(words, found)] += 1
    assert Counter((r.doc_id, tuple(map(tuple, r.runs)), r.text) for r in got.collect()) == want
    assert runs.periodic_runs(empty(spark)).count() == 0


def test_time_grows_with_length():
    """A repeated word fills every tile; only the first octave keeps any."""
    numbers = runs.word_numbers([b"x"] * 100_000)
    kept = list(runs.tiles(numbers))
    assert {low for low, *_ in kept} == {1}
