import hashlib
import random
import time
from collections import Counter

from helpers import awkward, empty

from pricewake.llm import lines


def pairs_of(body, divisor=64):
    """(start, stop, text, boundary) of all two filled lines that follow each other."""
    filled = [i for i, line in enumerate(body) if line.strip(" ")]
    hashes = [int(hashlib.md5(body[i].strip(" ").encode()).hexdigest()[:7], 16) for i in filled]
    return [
        (i, j, "\n".join(body[i : j + 1]), (a * 31 + b) % ((1 << 31) - 1) % divisor != 0)
        for i, j, a, b in zip(filled, filled[1:], hashes, hashes[1:])
    ]


def brute(rows, divisor=64):
    bodies = {i: t.split("\n") for i, t in sorted(rows) if t is not None}
    pairs = {i: pairs_of(body, divisor) for i, body in bodies.items()}
    times = Counter(text for found in pairs.values() for _, _, text, boundary in found if boundary)
    anchors = {(i, k) for i, found in pairs.items() for k, p in enumerate(found) if p[3] and times[p[2]] > 1}
    beside = [
        (i, k) for i, found in pairs.items() for k, p in enumerate(found)
        if not p[3] and ((i, k - 1) in anchors or (i, k + 1) in anchors)
    ]
    near = Counter(pairs[i][k][2] for i, k in beside)
    again = anchors | {(i, k) for i, k in beside if near[pairs[i][k][2]] > 1}
    seen, out = set(), {i: (0, 0, 0, 0, None) for i, t in rows if t is None}
    for i, body in bodies.items():
        gone, chunks = set(), 0
        for k, (start, stop, text, _) in enumerate(pairs[i]):
            if (i, k) not in again:
                continue
            if text in seen:
                gone |= set(range(start, stop + 1))
                chunks += 1
            seen.add(text)
        kept = "\n".join(line for k, line in enumerate(body) if k not in gone)
        out[i] = (len(body), sum(p[3] for p in pairs[i]), chunks, len(gone), kept)
    return out


def test_like_brute_force(spark):
    random.seed(3)
    passages = [[f"p{k} line {j} {random.random()}" for j in range(random.randint(2, 12))] for k in range(6)]
    rows = []
    for i in range(150):
        body = [f"own {i} {j}" for j in range(random.randint(0, 4))]
        for passage in random.sample(passages, random.randint(0, 3)):
            body += passage + [""] * random.randint(0, 2)
        rows.append((i, "\n".join(body)))
    rows += [(200, None), (201, ""), (202, "\n\n\n"), (203, rows[0][1]), (204, "a\nb\n" * 3000)]
    for divisor in (64, 3):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = lines.drop_repeated_lines(df, divisor=divisor).collect()
        want = brute(rows, divisor)
        assert len(got) == len(rows)
        for r in got:
            assert tuple(r[1:]) == want[r.doc_id], r.doc_id
        assert sum(r.removed_chunks for r in got) > 50


def recall(spark, rows):
    """Removed lines of the maximal repeated runs, and how many removed lines are in none."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.removed_lines for r in lines.drop_repeated_lines(df).collect()}
    want = {i: len(gone) for i, gone in maximal_runs(rows).items()}
    assert all(got[i] <= n for i, n in want.items())
    return sum(got.values()) / sum(want.values())


def test_recall_of_repeated_runs(spark):
    """At least nine tenths of the lines of repeated runs of two or more lines, short runs included."""
    random.seed(11)
    passages = [[f"p{k} line {j}" for j in range(random.choice([2, 2, 2, 3, 3, 4, 9]))] for k in range(400)]
    rows = []
    for i in range(300):
        body = []
        for passage in random.sample(passages, 4):
            body += [f"own {i} {random.random()}", *passage]
        rows.append((i, "\n".join(body)))
    assert recall(spark, rows) >= 0.95
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").distinct()
    # Of equal texts one, so that whole copies do not carry the figure.
    texts = sorted({t: i for i, t in sorted((tuple(r) for r in docs.collect()), reverse=True)}.items(), key=lambda r: r[1])
    found = recall(spark, [(i, t) for t, i in texts])
    assert found >= 0.9
    print('recall over distinct texts', found)


def test_time_per_line_is_flat(spark):
    """Two equal texts each: a text of a hundred thousand lines takes no more a line than a short one."""
    seconds = {}
    for n in (5_000, 100_000):
        body = "\n".join(f"line {k}" for k in range(n))
        df = spark.createDataFrame([(1, body), (2, "x\n" + body)], "doc_id long, text string")
        lines.drop_repeated_lines(df.filter("doc_id < 0")).count()
        start = time.perf_counter()
        got = {r.doc_id: r.removed_lines for r in lines.drop_repeated_lines(df).collect()}
        seconds[n] = time.perf_counter() - start
        assert got == {1: 0, 2: n} and sum(got.values()) == n
    assert seconds[100_000] < 10 * seconds[5_000] + 5


def test_boundaries_resist_shifts(spark):
    random.seed(4)
    passage = [f"shared {random.random()}" for _ in range(60)]
    rows = [(1, "\n".join(passage)), (2, "\n".join(["one more line", *passage]))]
    got = {r.doc_id: r for r in lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].removed_lines == 0 and got[2].removed_lines == 60


def test_awkward(spark):
    got = lines.drop_repeated_lines(awkward(spark)).collect()
    assert len(got) == awkward(spark).count()
    # Equal rows are one document, so neither is a copy of the other.
    twice = lines.drop_repeated_lines(awkward(spark, [(1, "a\nb\nc\nd", "en", "s")] * 2)).collect()
    assert [r.removed_chunks for r in twice] == [0, 0]
    nulls = awkward(spark, [(None, "a\nb\nc\nd\n", "en", "s"), (None, "a\nb\nc\nd\nother", "en", "s")])
    assert sorted(r.removed_lines > 1 for r in lines.drop_repeated_lines(nulls).collect()) == [False, True]
    assert lines.drop_repeated_lines(empty(spark)).count() == 0


def maximal_runs(rows):
    """Lines of every maximal equal run with two or more filled lines that starts at an earlier place, too."""
    places = [(i, text.split("\n")) for i, text in sorted(rows) if text is not None]
    at = {}
    for d, (_, body) in enumerate(places):
        for k, line in enumerate(body):
            at.setdefault(line, []).append((d, k))
    gone = {i: set() for i, _ in rows}
    for d, (i, body) in enumerate(places):
        for k, line in enumerate(body):
            for e, m in at[line]:
                if (e, m) >= (d, k):
                    break
                other, n = places[e][1], 0
                while k + n < len(body) and m + n < len(other) and body[k + n] == other[m + n]:
                    n += 1
                filled = [k + x for x in range(n) if body[k + x].strip(" ")]
                if len(filled) >= 2:
                    gone[i].update(range(filled[0], filled[-1] + 1))
    return gone


def test_passages_like_brute_force(spark):
    random.seed(7)
    passages = [[f"p{k} line {j}" for j in range(random.randint(2, 5))] for k in range(20)]
    rows = []
    for i in range(150):
        body = []
        for passage in random.sample(passages, random.randint(0, 4)):
            body += [f"own {i} {random.random()}"] * random.randint(0, 1) + [random.choice(("", "  ", "p"))]
            a = random.randint(0, len(passage) - 1)
            body += passage[a:] if random.random() < 0.3 else [x for y in passage for x in (y, *[""] * (a % 2))]
        rows.append((i, "\n".join(body)))
    rows += [(200, None), (201, ""), (202, "\n\n\n"), (203, rows[0][1]), (204, "a\nb\n" * 300), (205, "c"), (206, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = lines.drop_repeated_passages(df)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    got, want = {r.doc_id: r for r in found.collect()}, maximal_runs(rows)
    for i, text in rows:
        body = [] if text is None else text.split("\n")
        kept = "\n".join(x for k, x in enumerate(body) if k not in want[i])
        assert tuple(got[i][1:]) == (len(body), len(want[i]), None if text is None else kept), i
    chunked = lines.drop_repeated_lines(df).collect()
    assert sum(map(len, want.values())) >= sum(r.removed_lines for r in chunked)


def test_passages_short_and_awkward(spark):
    # Two lines between foreign ones: nearly no chunk is as short and cut just there.
    rows = [(i, f"before {i}\nshared one\nshared two\nafter {i}") for i in range(20)]
    got = lines.drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.removed_lines for r in got} == {i: 2 if i else 0 for i in range(20)}
    assert len(lines.drop_repeated_passages(awkward(spark)).collect()) == awkward(spark).count()
    twice = lines.drop_repeated_passages(awkward(spark, [(1, "a\nb\nc", "en", "s")] * 2)).collect()
    assert [r.removed_lines for r in twice] == [0, 0]
    nulls = awkward(spark, [(None, "a\nb\nc", "en", "s"), (None, "a\nb\nd", "en", "s")])
    assert sorted(r.removed_lines for r in lines.drop_repeated_passages(nulls).collect()) == [0, 2]
    assert lines.drop_repeated_passages(empty(spark)).count() == 0
