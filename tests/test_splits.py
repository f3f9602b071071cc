"""Large files by many tasks: records that cross blocks, odd file names, headers."""

import csv
import json
import random

import pytest

from pricewake import schemas
from pricewake.catalog import table_queries
from pricewake.sources import files, splits

TEXT = ["plain", "two\nlines", 'a "quoted" word', "comma, here", "", "\n\n", 'ends with "', "é ñ", "x" * 90, "{ } [ ]", "\\", '\\"']


@pytest.fixture
def small_blocks(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "300")
    yield
    for n, value in zip(names, before):
        spark.conf.set(n, value)


def listings(seed, n):
    rng = random.Random(seed)
    return [
        {"author": rng.choice(TEXT), "flair": None, "brand": rng.choice(TEXT), "frag_name": f"n{i} " + rng.choice(TEXT),
         "size": 50.0, "price": float(i), "fill_percent": None, "status": rng.choice(TEXT)}
        for i in range(n)
    ]


def blocks(spark, path, kind):
    return splits.records(spark, path, kind).select("file", "block").distinct().count()


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_csv_like_the_plain_reader(spark, tmp_path, small_blocks, ending):
    rows = listings(1, 120)
    names = [*schemas.LISTINGS_BATCH.names]
    path = tmp_path / "one.csv"
    with path.open("w", newline="") as out:
        writer = csv.writer(out, lineterminator=ending)
        writer.writerow(names)
        writer.writerows([[row[c] for c in names] for row in rows])
        out.write(ending)
    plain = spark.read.schema(schemas.LISTINGS_BATCH).options(header=True, multiLine=True, escape='"').csv(str(path))
    got = files.read_csv(spark, str(path), schemas.LISTINGS_BATCH, ordered=True)
    assert blocks(spark, str(path), splits.CsvLines) > 10
    ordered = [tuple(r)[:-1] for r in got.orderBy("ord").collect()]
    assert ordered == [tuple(r) for r in plain.collect()] and len(ordered) == 120


@pytest.mark.parametrize("form", [{"indent": 2}, {}, {"separators": (",", ":")}])
def test_json_like_the_plain_reader(spark, tmp_path, small_blocks, form):
    rows = listings(2, 120)
    rows[3]["other"] = {"deep": [{"a": "}"}, {"b": '{"'}]}
    path = tmp_path / "one.json"
    path.write_text(json.dumps(rows, **form))
    plain = spark.read.schema(schemas.LISTINGS_BATCH).option("multiLine", True).json(str(path))
    got = files.read_listings_json(spark, str(path))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[5]) == sorted(map(tuple, plain.collect()), key=lambda r: r[5])
    assert got.count() == 120 and blocks(spark, str(path), splits.JsonObjects) > 10


def test_one_record_longer_than_blocks(spark, tmp_path, small_blocks):
    long = "\n".join(f"line {i}, \"{i}\"" for i in range(300))
    path = tmp_path / "long.csv"
    with path.open("w", newline="") as out:
        csv.writer(out).writerows([["title", "body"], ["a", "first"], ["b", long], ["c", "last"]])
    got = {r.title: r.body for r in files.read_posts_csv(spark, str(path)).collect()}
    assert got == {"a": "first", "b": long, "c": "last"}
    (tmp_path / "long.json").write_text(json.dumps([{"brand": "a"}, {"brand": long}, {"brand": "c"}]))
    assert [r.brand for r in files.read_listings_json(spark, str(tmp_path / "long.json")).collect()].count(long) == 1


@pytest.mark.parametrize("name", ["with blank", "per%20cent", "a+b", "hash#tag", "é", "semi;colon", "100%"])
def test_paths_of_any_name(spark, tmp_path, name):
    folder = tmp_path / name
    folder.mkdir()
    (folder / f"{name}.csv").write_text("title,body\nx,y\n")
    (folder / "2.csv").write_text("body,title,author\nq,p,z\n")
    got = {(r.title, r.body, r.author) for r in files.read_posts_csv(spark, str(folder)).collect()}
    assert got == {("x", "y", None), ("p", "q", "z")}


def test_empty_and_broken_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert files.read_listings_csv(spark, str(tmp_path / "empty.csv")).count() == 0
    assert files.read_listings_csv(spark, str(tmp_path / "empty.csv")).columns == schemas.LISTINGS_BATCH.names
    (tmp_path / "head.csv").write_text("﻿title,body")
    assert files.read_posts_csv(spark, str(tmp_path / "head.csv")).count() == 0
    (tmp_path / "inch.csv").write_text('title,body\n5" tall,b\nc,"open\nto the end\n')
    got = {r.title: r.body for r in files.read_posts_csv(spark, str(tmp_path / "inch.csv")).collect()}
    assert got['5" tall'] == "b" and got["c"].startswith("open\nto the end")
    (tmp_path / "none.json").write_text("[]")
    assert files.read_listings_json(spark, str(tmp_path / "none.json")).count() == 0


@pytest.mark.parametrize("kind", [splits.CsvLines, splits.JsonObjects])
def test_sums_of_parts_are_sums_of_the_whole(kind):
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choices('",{}a\\', k=30)) if kind is splits.JsonObjects else "".join(rng.choices('",a\n', k=30))
        state, depth = False, 0
        for piece in text.split(kind.separator):
            state, change = kind.after(piece, state)
            depth += change
        both = {start: (start, 0) for start in (False, True)}
        cut = rng.randrange(len(text.split(kind.separator)) + 1)
        for start in both:
            for piece in text.split(kind.separator)[cut:]:
                quoted, change = kind.after(piece, both[start][0])
                both[start] = (quoted, both[start][1] + change)
        first, down = False, 0
        for piece in text.split(kind.separator)[:cut]:
            first, change = kind.after(piece, first)
            down += change
        assert (state, depth) == (both[first][0], down + both[first][1])


def test_objects_carry_no_header(spark, tmp_path):
    path = tmp_path / "one.json"
    path.write_text(json.dumps(listings(4, 20)))
    assert splits.records(spark, str(path), splits.JsonObjects).filter("header IS NOT NULL").count() == 0


def test_quotes_and_depth_like_letter_by_letter():
    def plainly(piece, quoted):
        depth, skip = -1, False
        for ch in piece:
            if skip or ch == "\\":
                skip = not skip
            elif ch == '"':
                quoted = not quoted
            elif ch == "{" and not quoted:
                depth += 1
        return quoted, depth + 1 if quoted else depth

    rng = random.Random(5)
    for _ in range(5000):
        piece = "".join(rng.choice('\\"{[a\n, ') for _ in range(rng.randrange(12)))
        for quoted in (False, True):
            assert splits.JsonObjects.after(piece, quoted) == plainly(piece, quoted)


def test_listing_files_are_cut_into_fields_once(spark):
    """Both statistics of the index read stored rows, not the records."""
    index = table_queries.files_to_index(spark, "/root/testdata/sf0.001")
    assert "from_csv" not in index._jdf.queryExecution().optimizedPlan().toString()
