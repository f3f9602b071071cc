"""A task of the language model holds little more than a group of its texts."""

import random
import tracemalloc

import pyarrow as pa

from pricewake.llm import language


def test_peak_of_a_batch(monkeypatch):
    draw = random.Random(5)
    words = {x: ["".join(draw.choices("abcdefgh" if x == "a" else "klmnopqr", k=5)) for _ in range(300)] for x in "ab"}
    spans = [(x, draw.choices(words[x], k=40)) for x in "ab" for _ in range(40)]
    model = language.fit(spans, rounds=2)
    texts = pa.array([" ".join(draw.choices(words[draw.choice("ab")], k=400)) for _ in range(900)])

    def peak():
        tracemalloc.start()
        labels = [row[0] for row in language._scan(model, texts)]
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top, labels

    now, labels = peak()
    monkeypatch.setattr(language, "GROUP_BYTES", 1 << 20)
    before, same = peak()
    assert labels == same
    assert now < 0.5 * before and now < 64 << 20
