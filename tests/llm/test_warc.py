import base64
import gzip
import hashlib
import random
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from pricewake.llm import warc

PAGES = "page_id long, url string, html string, id string, size int, type string"


def made(n):
    return [warc.record(str(i), f"http://x/{i}", "response", warc.digest_of(b), len(b), None, b) for i, b in n]


def pages(spark):
    rows = [
        (1, "http://a/1", "<p>same</p>"),
        (2, "http://a/2", "<p>same</p>"),
        (3, None, "<p>same</p>"),
        (4, "http://a/4\r\nX: y", "other é 日本"),
        (5, "u", None),
        (6, "u", ""),
        (None, "u", "other é 日本"),
        (None, "u", "alone"),
        (7, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n"),
        (8, "u", "x" * 300_000),
        (9, "u", "twice"),
        (9, "u", "twice"),
    ]
    return spark.createDataFrame([(*r, "i", 1, "t") for r in rows], PAGES)


def test_round_trip(spark):
    got = warc.archive_round_trip(pages(spark)).withColumn("page", warc.id_of(F.col("record_id")))
    rows = got.withColumn("to", warc.id_of(F.col("refers_to"))).collect()
    assert all(r.kind == "record" for r in rows) and len(rows) == 12
    want = Counter()
    for r in pages(spark).collect():
        raw = (r.html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        to = {"<p>same</p>": 3, "other é 日本": 4, "": 6}.get(r.html or "")
        to = None if to == r.page_id else to
        kind = "response" if to is None else "revisit"
        want[(None if r.page_id is None else str(r.page_id), len(raw), digest, kind, None if to is None else str(to), None if to else raw)] += 1
    assert Counter((r.page, r.payload_bytes, r.digest, r.type, r.to, None if r.payload is None else bytes(r.payload)) for r in rows) == want


def test_threshold_and_empty(spark):
    some = warc.archive_round_trip(pages(spark), least=8).filter("type = 'revisit'").collect()
    assert len(some) == 3
    assert warc.archive_round_trip(pages(spark).filter("page_id > 99")).count() == 0


def test_archives_are_plain_gzip(spark, tmp_path):
    warc.write_archives(pages(spark), str(tmp_path / "out"))
    parts = [p for p in Path(tmp_path / "out").iterdir() if p.name.startswith("part-")]
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in parts if p.stat().st_size)
    assert whole.count(b"WARC-Record-ID: ") == 12


def entries(data):
    return [(kind, a, b) for kind, a, b, _ in warc.salvage(data)]


def test_salvage_of_damaged_archives():
    random.seed(6)
    bodies = [(i, bytes(random.choices(b"abcdef <>\r\n", k=random.randint(0, 2000)))) for i in range(40)]
    for zipped in (True, False):
        parts = [warc.member(r) if zipped else r for r in made(bodies)]
        starts = [sum(map(len, parts[:i])) for i in range(len(parts) + 1)]
        whole = b"".join(parts)
        assert [k for k, _, _ in entries(whole)] == ["record"] * 40
        # A byte changed, a stretch wiped, a stretch missing, junk in between, the end cut off.
        for case in range(60):
            i = random.randrange(1, 39)
            a, b = starts[i], starts[i + 1]
            at = random.randrange(a, b)
            damaged = [
                whole[:at] + bytes([whole[at] ^ 0xFF]) + whole[at + 1 :],
                whole[:a] + b"\0" * (b - a) + whole[b:],
                whole[:a] + whole[min(a + 30, b - 1) :],
                whole[:a] + b"junk \x1f\x8b\x08 WARC/1.1\r\n" + whole[a:],
                whole[: b - 3],
            ][case % 5]
            found = list(warc.salvage(damaged))
            records = [what.headers["warc-record-id"] for kind, *_, what in found if kind == "record"]
            good = {f"<urn:page:{n}>" for n in range(40)}
            lost = good - set(records)
            if case % 5 == 4:
                assert len(lost) == 40 - i
            elif case % 5 == 3:
                assert not lost
            else:
                assert lost <= {f"<urn:page:{i}>"} and len(records) >= 39
            assert any(kind == "gap" for kind, *_ in found) or not lost
            for kind, _, _, what in found:
                if kind == "record" and what.headers["warc-record-id"] in good:
                    n = int(what.headers["warc-record-id"][10:-1])
                    assert what.payload == bodies[n][1]
            spans = [(x[1], x[2]) for x in found]
            assert spans[0][0] == 0 and spans[-1][1] == len(damaged)
            assert all(p[1] == q[0] for p, q in zip(spans, spans[1:]))


def test_gaps_are_logged(spark, tmp_path):
    parts = [warc.member(r) for r in made([(1, b"one"), (2, b"two"), (3, b"three")])]
    parts[1] = parts[1][:20] + b"\xff\xff" + parts[1][22:]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(parts))
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    rows = warc.read_archives(spark, str(tmp_path)).orderBy("first_byte").collect()
    assert [r.kind for r in rows] == ["record", "gap", "record"]
    assert (rows[1].first_byte, rows[1].end_byte) == (len(parts[0]), len(parts[0]) + len(parts[1])) and rows[1].reason


def one_member(records):
    return gzip.compress(b"".join(records), mtime=0)


def ids(found):
    return [what.headers["warc-record-id"] for kind, *_, what in found if kind == "record"]


def test_members_with_several_records():
    random.seed(9)
    bodies = [(i, bytes(random.choices(b"abcdef <>", k=random.randint(500, 3000)))) for i in range(12)]
    raw = made(bodies)
    parts = [one_member(raw[:5]), warc.member(raw[5]), one_member(raw[6:])]
    whole = b"".join(parts)
    found = list(warc.salvage(whole))
    assert ids(found) == [f"<urn:page:{i}>" for i in range(12)] and all(kind == "record" for kind, *_ in found)
    spans = [(x[1], x[2]) for x in found]
    assert spans[0][0] == 0 and spans[-1][1] == len(whole) and all(p[1] == q[0] for p, q in zip(spans, spans[1:]))
    # A record broken before it was packed: its neighbours in the member stay, and the gap says where.
    broken = raw[:2] + [raw[2].replace(b"Content-Length", b"Content-Langth", 1)] + raw[3:5]
    found = list(warc.salvage(one_member(broken) + parts[1]))
    assert ids(found) == [f"<urn:page:{i}>" for i in (0, 1, 3, 4, 5)]
    (gap,) = [x for x in found if x[0] == "gap"]
    start = len(raw[0]) + len(raw[1])
    assert f"bytes {start} to {start + len(broken[2])} of the member" in gap[3]


def test_front_of_a_damaged_member():
    random.seed(10)
    bodies = [(i, bytes(random.choices(b"abcdef <>", k=3000))) for i in range(30)]
    raw = made(bodies)
    packed = one_member(raw[:20])
    tail = [warc.member(r) for r in raw[20:]]
    for at in (len(packed) // 3, len(packed) // 2, len(packed) - 6):
        damaged = packed[:at] + bytes([packed[at] ^ 0x5A]) + packed[at + 1 :]
        found = list(warc.salvage(damaged + b"".join(tail)))
        got = ids(found)
        assert got[-10:] == [f"<urn:page:{i}>" for i in range(20, 30)]
        front = got[:-10]
        # Those before the damage, but for one or two at its edge, and what decodes again behind it.
        before = max(0, 20 * at // len(packed) - 3)
        assert front[:before] == [f"<urn:page:{i}>" for i in range(before)] and len(set(front)) == len(front) < 20
        assert all(what.payload == dict(bodies)[int(what.headers["warc-record-id"][10:-1])] for k, *_, what in found if k == "record")
        gaps = [x for x in found if x[0] == "gap"]
        assert (gaps[0][1], gaps[-1][2]) == (0, len(damaged))


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, "u", rng.randbytes(20_000).hex()) for i in range(60)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(table, str(tmp_path / "out"), file_bytes=160_000)
    sizes = [p.stat().st_size for p in Path(tmp_path / "out").iterdir() if p.name.startswith("part-")]
    assert len(sizes) > 6 and max(sizes) < 160_000 + warc.BLOCKS * 26_000
    warc.write_archives(table, str(tmp_path / "small"), file_bytes=64)
    got = warc.read_archives(spark, str(tmp_path / "out")).collect()
    assert all(r.kind == "record" for r in got)
    assert {bytes(r.payload).decode() for r in got} == {r[2] for r in rows} and len(got) == 60
    again = warc.read_archives(spark, str(tmp_path / "small"))
    assert again.count() == 60


def test_rows_that_are_surely_revisits():
    same = warc._surely_revisits([3, 1, None, 3, 2, None], list("aaaabb"), [5, 5, 5, 5, 5, 5], 0)
    assert same == [False, True, True, False, False, True]
    assert warc._surely_revisits([3, 1], list("aa"), [5, 5], 6) == [False, False]
    assert warc._surely_revisits([float("nan"), 1.0, 2.0], list("aaa"), [5] * 3, 0) == [False, True, False]


def test_payloads_of_revisits_stay_behind(spark, tmp_path):
    rng = random.Random(6)
    html = rng.randbytes(50_000).hex()
    table = spark.createDataFrame([(i, "u", html) for i in range(100)], "page_id long, url string, html string").coalesce(1)
    got = warc.archive_round_trip(table).collect()
    assert [r.type for r in sorted(got, key=lambda r: r.type)] == ["response"] + ["revisit"] * 99
    assert [bytes(r.payload).decode() for r in got if r.payload] == [html]
    assert {r.payload_bytes for r in got} == {100_000}
