import json
import math
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewake import schemas
from pricewake.operators.keyed import merge_by_key
from pricewake.session import scratch_path, shared_dir
from pricewake.sources import files, tables
from pricewake.sources.tables import KeyedTable
from pricewake.streaming import ingest as J

SCHEMA = T.StructType(
    [
        T.StructField("k", T.StringType()),
        T.StructField("v", T.LongType()),
        T.StructField("own", T.StringType()),
        T.StructField("born", T.LongType()),
    ]
)


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(shared_dir(spark))


# ---- files -------------------------------------------------------------------


def test_posts_csv(spark, tmp_path):
    path = tmp_path / "posts.csv"
    path.write_text(
        'url,title,extra,body,date\nu1,"a ""b""",x,"l1\nl2",1.5\nu2,t,,,bad\n', encoding="utf-8"
    )
    got = files.read_posts_csv(spark, str(path)).orderBy("url").collect()
    assert [(r.title, r.body, r.date, r.author) for r in got] == [
        ('a "b"', "l1\nl2", 1.5, None), ("t", None, None, None),
    ]
    path.write_text("title,text\na,b\n")
    with pytest.raises(ValueError, match="body"):
        files.read_posts_csv(spark, str(path))


def test_listings_json_to_csv(spark, tmp_path):
    source = tmp_path / "in.json"
    items = [
        {"brand": "A", "frag_name": "x\ny", "size": 50, "price": 1.5, "status": None},
        {"brand": None, "frag_name": ' "q" ', "size": None, "price": None, "author": "me"},
    ]
    source.write_text(json.dumps(items, indent=2))
    target = str(tmp_path / "out")
    files.json_to_csv(spark, str(source), target)
    back = rows_of(files.read_listings_csv(spark, target).select("frag_name", "size", "author"))
    assert back == {("x\ny", 50.0, None), (' "q" ', None, "me")}


def test_file_order(spark, tmp_path):
    for name, start in (("a.csv", 0), ("b.csv", 100)):
        lines = "\n".join(f"b,p{start + i},,,,u" for i in range(50))
        (tmp_path / name).write_text(f"brand,product,size,discount_price,retail_price,url\n{lines}")
    raw = (
        spark.read.option("header", True).schema(schemas.RETAIL).csv(str(tmp_path))
    )
    ordered = files.in_file_order(raw).orderBy("ord").select("product").collect()
    assert [r.product for r in ordered] == [f"p{s + i}" for s in (0, 100) for i in range(50)]


def test_without_nan_and_probe(spark):
    df = spark.createDataFrame([(1, math.nan, "b"), (2, 1.0, "a")], "i int, x double, s string")
    clean = files.without_nan(df)
    assert rows_of(clean) == {(1, None, "b"), (2, 1.0, "a")}
    probed = files.probe(clean).first()
    assert probed.row_count == 2 and json.loads(probed.sample) == {"i": 1, "x": None, "s": "b"}


def test_rename_layer(spark):
    old = spark.createDataFrame([("n", 1.0, 2.0, "u")], "name string, size_ml double, "
                                "price_usd double, post_url string")
    assert schemas.to_batch_names(old).columns == ["frag_name", "size", "price", "url"]


# ---- keyed tables ----------------------------------------------------------------


def make(spark, tmp_path, **options):
    return KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], ["born"], **options)


def test_upsert(spark, tmp_path):
    table = make(spark, tmp_path)
    assert table.read().count() == 0 and table.version() == 0
    first = spark.createDataFrame([("a", 1, "x", 1), ("b", 2, "y", 1)], SCHEMA)
    assert table.upsert(first) == {"inserted": 2, "modified": 0, "matched": 0, "deleted": 0}
    batch = spark.createDataFrame([("b", None, 9), ("c", 3, 9)], "k string, v bigint, born bigint")
    assert table.upsert(batch)["modified"] == 1
    expected = {("a", 1, "x", 1), ("b", None, "y", 1), ("c", 3, None, 9)}
    assert rows_of(table.read()) == expected
    again = table.upsert(batch)
    assert (again["inserted"], again["modified"], again["matched"]) == (0, 0, 2)
    assert rows_of(table.read()) == expected
    assert table.upsert(batch.limit(0)) == {
        "inserted": 0, "modified": 0, "matched": 0, "deleted": 0,
    }
    with pytest.raises(ValueError, match="nope"):
        table.upsert(batch.withColumn("nope", F.lit(1)))
    with pytest.raises(ValueError, match="without a key"):
        table.upsert(batch.withColumn("k", F.lit(None).cast("string")))
    assert rows_of(table.read()) == expected


def test_batch_order_does_not_matter(spark, tmp_path):
    data = [(f"k{i % 7}", i, "s", i) for i in range(60)]
    results = []
    for name, shuffled in (("x", data), ("y", data[::-1])):
        table = KeyedTable(spark, str(tmp_path / name), SCHEMA, ["k"], ["born"])
        table.upsert(spark.createDataFrame(shuffled, SCHEMA), order=[F.col("v")])
        results.append(rows_of(table.read()))
    assert results[0] == results[1]
    assert {r[1] for r in results[0]} == set(range(53, 60))
    assert {r[3] for r in results[0]} == set(range(7))


def folder_bytes(folder):
    return sum(f.stat().st_size for f in Path(folder).rglob("*.parquet"))


def test_an_upsert_writes_its_batch_only(spark, tmp_path):
    table = make(spark, tmp_path)
    table.upsert(spark.range(50_000).selectExpr("'k' || id AS k", "id AS v", "uuid() AS own", "1L AS born"))
    for v in (98, 99):
        table.upsert(spark.createDataFrame([("k3", v, "s", 1)], SCHEMA))
    sizes = [folder_bytes(f) for f in sorted((tmp_path / "t").glob("change-*"))]
    assert len(sizes) == 3 and max(sizes[1:]) < sizes[0] / 100
    assert table.read().count() == 50_000
    assert rows_of(table.read().filter("k = 'k3'")) == {("k3", 99, "s", 1)}


def test_compaction_changes_no_row(spark, tmp_path):
    table, plain = make(spark, tmp_path / "a"), make(spark, tmp_path / "b")
    plain.compact()
    for n in range(4):
        batch = [(f"k{(n * i) % 11}", n, f"s{i}", n) for i in range(8)]
        gone = spark.createDataFrame([(f"s{n}",)], "own string") if n % 2 else None
        counts = []
        for t in (table, plain):
            frame = spark.createDataFrame(batch, SCHEMA)
            counts.append(t.upsert(frame, [F.col("own")], replace=gone))
        assert counts[0] == counts[1]
        version = table.version()
        table.compact(2)
        assert table.version() == version == plain.version()
        assert rows_of(table.read()) == rows_of(plain.read())
    table.compact()
    table.compact()
    assert rows_of(table.read()) == rows_of(plain.read())
    # What the last but one compaction replaced is gone.
    assert len(list((tmp_path / "a" / "t").iterdir())) < len(list((tmp_path / "b" / "t").iterdir())) + 1


def test_unfinished_commit_is_invisible(spark, tmp_path):
    table = make(spark, tmp_path)
    table.upsert(spark.createDataFrame([("a", 1, "x", 1)], SCHEMA))
    table.upsert(spark.createDataFrame([("a", 2, "x", 1)], SCHEMA))
    # As a job leaves it that died before its end.
    (tmp_path / "t" / f"change-{2:012d}" / "_SUCCESS").unlink()
    assert rows_of(table.read()) == {("a", 1, "x", 1)} and table.version() == 1
    table.upsert(spark.createDataFrame([("a", 3, "x", 1)], SCHEMA))
    assert rows_of(table.read()) == {("a", 3, "x", 1)} and table.version() == 3


def test_rival_commit_fails(spark, tmp_path, monkeypatch):
    table = make(spark, tmp_path)
    table.upsert(spark.createDataFrame([("a", 1, "x", 1)], SCHEMA))
    monkeypatch.setattr(KeyedTable, "_numbers", lambda *a: [])
    with pytest.raises(Exception, match="(?i)exists"):
        table.upsert(spark.createDataFrame([("a", 2, "x", 1)], SCHEMA))
    monkeypatch.undo()
    assert rows_of(table.read()) == {("a", 1, "x", 1)}


# ---- ingest ------------------------------------------------------------------------


def posts(spark, rows):
    return spark.createDataFrame(
        [(t, b, "me", f, 1.0, u, datetime.fromisoformat(at)) for t, b, f, u, at in rows], J.LANDING
    )


FIRST = [
    ("[WTS] a", "Creed Aventus 50ml $100\nDior Sauvage 50ml $60", "Sales:3", "u1", "2024-01-01"),
    ("[WTS] b", "Zara 30ml $5", None, "u2", "2024-01-01"),
    ("[WTB] c", "Zara 30ml $5", None, "u3", "2024-01-01"),
    ("[WTS] d", "Zara 30ml $5", None, None, "2024-01-01"),
]
SECOND = [
    ("[WTS] a", "~~Creed Aventus 50ml $100~~", "Sales:3", "u1", "2024-01-02"),
    ("[WTS] a", "old copy 1ml", "Sales:3", "u1", "2024-01-01"),
    ("[WTS] e", "nothing here", "Sales:3", "u4", "2024-01-02"),
]


def job(spark, root, **options):
    root = str(root)
    return J.Ingest(
        J.posts_table(spark, f"{root}/posts"),
        J.listings_table(spark, f"{root}/listings"),
        J.alerts_table(spark, f"{root}/alerts"),
        KeyedTable(spark, f"{root}/index", schemas.MARKET_INDEX, ["reddit_name"]),
        J.events_table(spark, f"{root}/events"),
        **options,
    )


def with_alerts(spark, ingest):
    at = datetime(2024, 1, 1)
    ingest.alerts.upsert(
        spark.createDataFrame(
            [("1", "a@x", "RARE", "aventus", None, at, True),
             ("2", "b@x", "DEAL", "sauvage", 1.0, at, None)], schemas.ALERTS
        )
    )
    ingest.index.upsert(
        spark.createDataFrame(
            [("DIOR", "SAUVAGE", None, 90.0, None, 0.5, 80.0, 10.0, 5, -10.0)],
            schemas.MARKET_INDEX,
        )
    )
    return ingest


def test_ingest_two_batches(spark, tmp_path):
    ingest = with_alerts(spark, job(spark, tmp_path, full=True))
    one = ingest.run(posts(spark, FIRST))
    assert one == {
        "scraped": 4, "skipped_without_url": 1, "posts_upserted": 3, "posts_modified": 0,
        "listings_extracted": 3,
        "listings_upserted": 3, "listings_modified": 0, "alerts_checked": 2, "alerts_skipped": 0,
        "matches": 2, "events_upserted": 2, "events_modified": 0,
    }
    # Send what is pending, then ingest newer posts: sent events stay sent.
    mails = ingest.notify("2024-01-01")
    assert {r.idempotency_key for r in mails.collect()} == {"1:u1#0", "2:u1#1"}
    replies = mails.select(
        F.col("idempotency_key").alias("event_key"), F.lit("ok").alias("response")
    ).filter("event_key = '1:u1#0'")
    unknown = spark.createDataFrame([("x:y", "ok")], "event_key string, response string")
    assert ingest.acknowledge(replies.union(unknown), "2024-01-01 10:00:00") == 1
    two = ingest.run(posts(spark, SECOND))
    assert (two["posts_upserted"], two["posts_modified"]) == (1, 1)
    assert (two["events_upserted"], two["events_modified"]) == (0, 2)
    assert [r.idempotency_key for r in ingest.notify("2024-01-02").collect()] == ["2:u1#1"]
    stored = {r.listing_key: r for r in ingest.listings.read().collect()}
    # The shorter new version leaves the second listing of the old one behind.
    assert set(stored) == {"u1#0", "u1#1", "u2#0"}
    assert stored["u1#0"].status == "SOLD"
    assert stored["u1#0"].created_in_db_at == datetime(2024, 1, 1)
    assert stored["u1#0"].scraped_at == datetime(2024, 1, 2)
    saved = {r.url: r for r in ingest.posts.read().collect()}
    assert saved["u4"].cleaned_listing_count == 0 and saved["u1"].cleaned_listing_count == 1


def test_replaced_posts_lose_stale_listings(spark, tmp_path):
    ingest = job(spark, tmp_path, replace_post=True)
    ingest.events = None
    ingest.run(posts(spark, FIRST))
    gone = [("[WTS] b", "withdrawn", None, "u2", "2024-01-03")]
    ingest.run(posts(spark, SECOND + gone))
    assert {r.listing_key for r in ingest.listings.read().collect()} == {"u1#0"}


def test_older_posts_alert_and_replace_nothing(spark, tmp_path):
    ingest = with_alerts(spark, job(spark, tmp_path, replace_post=True))
    sold = [("[WTS] a", "~~Creed Aventus 50ml $100~~", "Sales:3", "u1", "2024-01-02")]
    ingest.run(posts(spark, sold))
    before = rows_of(ingest.events.read().select("event_key"))
    ingest.run(posts(spark, FIRST))
    assert {r.listing_key for r in ingest.listings.read().collect()} == {"u1#0", "u2#0"}
    assert rows_of(ingest.events.read().select("event_key")) == before


def test_ingest_from_replies(spark, tmp_path):
    ingest = job(spark, tmp_path, cleaned_with="extractor")
    ingest.events = None
    replies = spark.createDataFrame(
        [
            ("u1", 1, '[{"frag_name": "B", "price_usd": 2}]'),
            ("u1", 0, 'Here: [{"frag_name": "A", "raw_text": "~~A 5ml~~", "status": "LISTED"}]'),
            ("u1", 2, "no idea"),
            ("u3", 0, '[{"frag_name": "not for sale"}]'),
        ],
        "url string, batch int, reply string",
    )
    counts = ingest.run(posts(spark, FIRST), replies=replies)
    assert (counts["posts_upserted"], counts["listings_upserted"]) == (3, 2)
    rows = {r.listing_key: (r.frag_name, r.status, r.price_usd, r.cleaned_with)
            for r in ingest.listings.read().collect()}
    assert rows == {
        "u1#0": ("A", "SOLD", None, "extractor"), "u1#1": ("B", None, 2.0, "extractor"),
    }


def test_ingest_without_cleaning(spark, tmp_path):
    ingest = job(spark, tmp_path, clean=False)
    ingest.events = None
    counts = ingest.run(posts(spark, FIRST))
    assert (counts["posts_upserted"], counts["listings_extracted"]) == (3, 0)
    assert {r.cleaned_with for r in ingest.posts.read().collect()} == {None}


def test_rearm(spark, tmp_path):
    ingest = with_alerts(spark, job(spark, tmp_path, rearm=True, full=True))
    ingest.run(posts(spark, FIRST))
    keys = ingest.events.read().select("event_key", F.lit("ok").alias("response"))
    assert ingest.acknowledge(keys, "2024-01-01") == 2
    assert ingest.notify("2024-01-01").count() == 0
    ingest.run(posts(spark, SECOND))
    assert ingest.notify("2024-01-02").count() == 2


@pytest.mark.parametrize("copies", [False, True])
def test_stream_in_batches_is_one_batch(spark, tmp_path, copies):
    landing = str(tmp_path / "landing")
    for part in (FIRST, SECOND):
        posts(spark, part).coalesce(1).write.mode("append").json(landing)
    results = []
    for files_per_batch in (1, 10):
        root = tmp_path / f"run{files_per_batch}"
        ingest = with_alerts(spark, job(spark, root))
        feed = J.read_landing(spark, landing, copies, files_per_batch)
        J.start(feed, ingest, str(root / "checkpoint")).awaitTermination()
        # Nothing new has landed: the second start changes nothing.
        version = ingest.posts.version()
        J.start(feed, ingest, str(root / "checkpoint")).awaitTermination()
        assert ingest.posts.version() == version
        results.append(rows_of(ingest.posts.read().drop("created_in_db_at")))
    assert results[0] == results[1] and len(results[0]) == 4


def test_newest_posts(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("b", 3.0), ("c", 3.0), ("d", None)], "url string, date double"
    )
    assert [r.url for r in J.newest_posts(df, 3).collect()] == ["b", "c", "a"]


def test_scratch_does_not_grow(spark, tmp_path):
    from pricewake.session import scratch_mark

    ingest = with_alerts(spark, job(spark, tmp_path))
    mark, folder = scratch_mark(), Path(shared_dir(spark))
    sizes = []
    for _ in range(2):
        ingest.run(posts(spark, FIRST))
        sizes.append(len(list(folder.iterdir())))
    assert scratch_mark() == mark and sizes[0] == sizes[1]


def test_only_new_listings_are_judged(spark, tmp_path):
    ingest = with_alerts(spark, job(spark, tmp_path))
    assert ingest.run(posts(spark, FIRST))["matches"] == 2
    # The second batch touches the post of one event; the other event is left as it was.
    assert ingest.run(posts(spark, SECOND))["matches"] == 1
    ingest.alerts.upsert(ingest.alerts.read().withColumn("threshold", F.col("threshold") + 0.1))
    # Changed alerts meet all stored listings again.
    assert ingest.run(posts(spark, SECOND))["matches"] == 2


def test_failed_evaluation_is_repeated_over_all_listings(spark, tmp_path, monkeypatch):
    ingest = with_alerts(spark, job(spark, tmp_path))
    assert ingest.run(posts(spark, FIRST))["matches"] == 2
    ingest.alerts.upsert(ingest.alerts.read().withColumn("threshold", F.col("threshold") + 0.1))

    def lost(*_):
        raise RuntimeError("executors lost")

    with monkeypatch.context() as patched:
        patched.setattr(ingest, "evaluate", lost)
        with pytest.raises(RuntimeError):
            ingest.run(posts(spark, SECOND))
    # The alerts changed before the failed run, so the next one still owes them all stored listings.
    assert ingest.run(posts(spark, SECOND))["matches"] == 2


def test_fixed_batch_is_neither_copied_nor_shuffled_into_an_empty_table(spark, tmp_path):
    schema = "k string, v string, first string, at int"
    made = lambda rows: spark.createDataFrame(rows, schema)
    names = []

    def table(folder):
        return KeyedTable(spark, str(tmp_path / folder), made([]).schema, ["k"], ["first"], version_by="at")

    batches = [[("a", "1", "x", 1), ("b", "2", "x", 2)], [("b", "3", "w", 1), ("c", "4", "y", 1), ("a", "5", "y", 2)]]
    plain, fixed = table("plain"), table("fixed")
    real = tables.written
    tables.written = lambda df, name: names.append(name) or real(df, name)
    try:
        for batch in batches:
            want = plain.upsert(made(batch))
            copied = len(names)
            assert fixed.upsert(made(batch), fixed=True) == want and len(names) == copied
    finally:
        tables.written = real
    assert sorted(fixed.read().collect()) == sorted(plain.read().collect()) and fixed.read().count() == 3
    old = table("none").read()
    plan = merge_by_key(old, made(batches[0]), ["k"], ["first"], version="at", unique=True)
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r._change for r in plan.collect()) == ["inserted", "inserted"]


def test_landed_files_are_packed_and_many(spark, tmp_path, monkeypatch):
    from pricewake.catalog import inputs, table_queries

    sf = "/root/testdata/sf0.001"
    lines = inputs.table(spark, sf, "lineitem").count()
    monkeypatch.setattr(table_queries, "POSTS_PER_FILE", 1000)
    feed = table_queries._feed(spark, sf)
    number = table_queries._landed(spark, sf, feed, str(tmp_path / "landing"))
    found = [p.name for p in (tmp_path / "landing").iterdir() if p.name.startswith("part-")]
    assert number == -(-lines // 1000) > 2 and len(found) == 2 * number and all(n.endswith(".json.gz") for n in found)
    assert spark.read.json(str(tmp_path / "landing")).count() == 2 * lines
