import public_tokenizers
import pytest
import sentencepiece
from helpers import SF, awkward, empty
from tokenizers import Tokenizer

from pricewake.llm import tokens

TRICKY = [
    "it's 12 o'clock<|endoftext|>x <|startoftext|>",
    "tab\tand\nline\r\n  many   blanks ",
    "nbsp here em ​zero",
    "é ́lone Σ ΑΣ ß İ",
    "\x1c\x1d control \x85 nel",
    "日本語 text 😀😀 mixed",
    "a" * 3000,
    "word " * 30_000,
]


def whole(path, texts):
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(x) for x in model.encode(texts)]
    tokenizer = Tokenizer.from_file(path)
    return [len(x) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_like_the_library(spark, name):
    path = public_tokenizers.path(name)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(100 + r.doc_id, r.text) for r in docs.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in tokens.token_counts(df, path, batch_bytes=5000, piece_bytes=900, memo=200).collect()}
    for (i, text), n in zip(rows, whole(path, [t for _, t in rows]), strict=True):
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len(text.encode()), n > 2048)


def test_awkward(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = tokens.token_counts(awkward(spark), path).collect()
    assert len(got) == awkward(spark).count()
    assert all((r.n_bytes, r.n_tokens, r.over_limit) == (0, 0, False) for r in got if r.doc_id in (3, 4))
    assert sum(r.doc_id == 1 for r in got) == 2 and sum(r.doc_id is None for r in got) == 2
    assert tokens.token_counts(empty(spark), path).count() == 0
