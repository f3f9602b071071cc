import random

from helpers import SF, awkward, empty
from pyspark.sql import functions as F

from pricewake.llm import decontaminate as dc


def brute(docs, items, threshold, overlap):
    """Every passage against every item by plain BM25 over word pairs."""
    index = dc.Index.build(items)
    impacts = [{} for _ in index.ids]
    for key, (numbers, values, _) in zip(index.keys.tolist(), index.postings):
        for number, value in zip(numbers, values):
            impacts[number][key] = value
    out = set()
    for doc, text in docs:
        words = dc.words_of(text)
        size = len(index.vocabulary)
        ids = [index.vocabulary.get(w) for w in words]
        for item in range(len(index.ids)):
            best = None
            for first in range(0, max(1, len(words)), index.chunk):
                part = ids[first : first + 2 * index.chunk + 1]
                keys = {
                    (a + 1) * size + b for a, b in zip(part, part[1:]) if a is not None and b is not None
                }
                if index.single:
                    keys |= {a for a in part[: 2 * index.chunk] if a is not None}
                score = sum(v for k, v in impacts[item].items() if k in keys)
                own = words[first : first + 2 * index.chunk + 1]
                q, a = dc.share_found(index.questions[item], own), dc.share_found(index.answers[item], own)
                if score >= threshold - 1e-9 and q >= overlap and a >= overlap:
                    if best is None or round(score, 9) > round(best[0], 9):
                        best = (score, q, a, first)
            if best:
                out.add((doc, index.ids[item], round(best[0], 6), best[1], best[2], best[3]))
    return out


def test_like_brute_force(spark):
    random.seed(2)
    vocabulary = [f"w{i}" for i in range(60)]
    items = []
    for i in range(80):
        q = " ".join(random.choices(vocabulary, k=random.randint(3, 30)))
        items.append((i, q + "?", " ".join(random.choices(vocabulary, k=random.randint(0, 6)))))
    items += [(90, "single", ""), (91, "", ""), (92, None, "x")]
    docs = []
    for i in range(120):
        words = random.choices(vocabulary, k=random.randint(0, 400))
        for _ in range(random.randint(0, 3)):
            item = random.choice(items[:80])
            place = random.randint(0, len(words))
            leak = f"{item[1]} {item[2]}".split()
            if random.random() < 0.4:
                leak[random.randrange(len(leak))] = "changed"
            words[place:place] = leak
        docs.append((i, " ".join(words)))
    docs.append((500, "a single word"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    item_df = spark.createDataFrame(items, "item_id long, q string, a string")
    for threshold, overlap in ((0.5, 0.8), (0.3, 0.6)):
        got = dc.leaks(df, item_df, question_col="q", answer_col="a", threshold=threshold, overlap=overlap)
        found = {(r[0], r[1], round(r[2], 6), *r[3:]) for r in got.collect()}
        known = [(i, q, a or "") for i, q, a in items if q is not None]
        assert found == brute(docs, known, threshold, overlap) and len(found) > 30


def test_search_is_exact():
    random.seed(8)
    items = [(i, " ".join(random.choices("abcdefgh", k=12)), "") for i in range(400)]
    index = dc.Index.build(items)
    for _ in range(60):
        terms = sorted(random.sample(range(len(index.keys)), random.randint(1, 40)))
        for threshold in (0.1, 0.3, 0.6):
            scores = {}
            for t in terms:
                for number, value in zip(*index.postings[t][:2]):
                    scores[number] = scores.get(number, 0) + value
            want = {(n, round(s, 9)) for n, s in scores.items() if s >= threshold - 1e-9}
            assert {(n, round(s, 9)) for n, s in index.search(terms, threshold)} == want


def test_planted_passages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    clean = dc.drop_leaks(docs, items)
    assert dc.leaks(clean, items).count() == 0
    text = items.first().text
    planted = clean.limit(5).withColumn("text", F.concat(F.lit("Some words before. "), F.lit(text.upper()), F.lit(" and after")))
    assert dc.drop_leaks(planted, items).count() == 0
    assert dc.leaks(planted, items).count() >= 5
    lost = docs.count() - clean.count()
    assert lost == dc.leaks(docs, items).select("doc_id").distinct().count()
    # Pieces of items, and items in many words of their own, are no leaks.
    half = clean.limit(3).withColumn("text", F.lit(" ".join(text.split()[: len(text.split()) // 2])))
    assert dc.drop_leaks(half, items).count() == 3


def test_blocks_of_items(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = {tuple(r[:2]) for r in dc.leaks(docs, items).collect()}
    monkeypatch.setattr(dc, "ITEMS_PER_BLOCK", 7)
    assert {tuple(r[:2]) for r in dc.leaks(docs, items).collect()} == whole


def test_awkward(spark):
    items = spark.createDataFrame(
        [(1, "Alpha beta. Gamma delta"), (1, "Alpha beta. Gamma delta"), (None, "x"), (2, None), (3, ""), (4, "!?")],
        "item_id long, text string",
    )
    rows = awkward(spark)
    got = dc.leaks(rows, items).collect()
    assert sorted((r.doc_id, r.item_id or 0) for r in got) == [(1, 1)] * 4 + [(2, 1)] * 2 + [(9, 0)]
    kept = dc.drop_leaks(rows, items)
    assert kept.columns == rows.columns and kept.count() == rows.count() - 4
    assert dc.leaks(empty(spark), items).count() == 0
    none = items.filter("item_id > 99")
    assert dc.leaks(rows, none).count() == 0 and dc.drop_leaks(rows, none).count() == rows.count()


def test_edited_last_sentence(spark):
    """Every single-word edit, and the cut of a short last sentence, that keeps 0.8 of the whole item leaks."""
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = [(r.item_id, r.text) for r in items.collect()]
    rows += [(900, "Which of the rivers of the old country runs north to the sea all year? The Ob."), (901, "Yes. No.")]
    docs, want = [], set()
    for item, text in rows:
        words = dc.words_of(text)
        whole = dc.shingles(words)
        edits = [words[:i] + ["changed"] + words[i + 1 :] for i in range(len(words))]
        edits += [words[:-2]] if len(words) > 2 else []
        for edit in edits:
            if dc.share_found(whole, edit) >= 0.8:
                want.add((len(docs), item))
            docs.append((len(docs), "before it " + " ".join(edit) + " behind it"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    item_df = spark.createDataFrame(rows, "item_id long, text string")
    got = dc.leaks(df, item_df).collect()
    assert want and want == {(r.doc_id, r.item_id) for r in got}
    assert {r.answer_overlap for r in got} == {1.0}
    assert dc.drop_leaks(df, item_df).count() == len(docs) - len({doc for doc, _ in want})
    # An answer of its own is still checked on its own.
    real = spark.createDataFrame([(900, rows[-2][1][:-7], "The Ob.")], "item_id long, text string, answer string")
    near = spark.createDataFrame([(1, rows[-2][1][:-7] + "The Don.")], "doc_id long, text string")
    assert dc.leaks(near, real, answer_col="answer").count() == 0 and dc.leaks(near, item_df).count() == 1
