"""Each stage against a brute-force version over all its predecessor kept."""

from collections import Counter

import corpus_pipeline
from helpers import SF, awkward, empty
from test_simhash import brute as brute_classes

from pricewake.llm import decontaminate as dc
from pricewake.llm import language, mixing


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, after = docs.collect(), stage(spark, docs, SF)
        rows = after.collect()
        if name != "shard":
            assert after.columns == docs.columns
            content = {tuple(r) for r in before}
            assert all(tuple(r) in content for r in rows)
        got = Counter(r.doc_id for r in rows)
        if name == "language":
            model = language.train(docs)
            want = Counter()
            for r in before:
                sums, words, _ = model.label([r.text])
                known = 0
                for word in language.words_of(r.text):
                    grams = language.grams_of(word)
                    found = sum(g in model.features for g in grams) + (word in model.lexicon)
                    known += word in model.lexicon or found >= 0.75 * len(grams)
                n = len(words[0])
                if n and sums[0].max() / n >= corpus_pipeline.MIN_LANGUAGE_SCORE and known + 3 >= 0.6 * (n + 3):
                    want[r.doc_id] += 1
            assert got == want
        elif name == "near_copies":
            classes = brute_classes([(r.doc_id, r.text) for r in before])
            assert got == Counter(i for i, _, component in classes if i == component)
        elif name == "decontaminate":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            parts = [tuple(dc.shingles(dc.words_of(x)) for x in dc.split_item(t)) for t in items]
            want = Counter()
            for r in before:
                words = dc.words_of(r.text)
                if not any(dc.share_found(q, words) >= 0.8 and dc.share_found(a, words) >= 0.8 for q, a in parts):
                    want[r.doc_id] += 1
            assert got == want
        elif name == "mix":
            assert got == Counter(r.doc_id for r in mixing.mixture(docs, entropy=0.95, repetition=4.0).collect())
        else:
            sizes = Counter(r.shard for r in rows)
            assert got == Counter(r.doc_id for r in before)
            assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(40)) <= 1
        if name != "shard":
            docs = spark.createDataFrame(rows, after.schema)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {r.law for r in rows} == {"rows"}


def test_awkward(spark):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (awkward(spark), empty(spark)):
            out = stage(spark, docs, SF)
            if name != "shard":
                assert out.columns == docs.columns
            assert out.count() <= 5 * max(1, docs.count())
