"""Token counts of whole texts with a public tokenizer.

Batches are encoded in Arrow functions that return lengths only. Texts are grouped
by bytes, not by rows, and cut at places where no token can cross:

* A tokenizer that drops white space (``drops_space``) never joins what stands on
  two sides of a space. Texts are cut at every space, each distinct piece of a batch
  is encoded once, and a bounded memo keeps the counts of pieces seen before.
* Any other ``tokenizers`` file: only texts above ``piece_bytes`` are cut, before
  a single space that stands between two ASCII letters, and the space stays with the
  right piece. Byte-level vocabularies start a new word there.
* A SentencePiece model gets whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 1 << 20
PIECE_BYTES = 1 << 16
MEMO = 200_000
# A vocabulary is shipped to the tasks; a file above this is no vocabulary.
VOCABULARY_BYTES = 64 << 20

_BETWEEN_LETTERS = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


def byte_groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes each; a larger row stands alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def safe_pieces(text: str, most: int) -> list[str]:
    """Cut a long text before spaces between letters, into pieces near ``most`` characters."""
    if len(text) <= most:
        return [text]
    pieces, start = [], 0
    while len(text) - start > most:
        cut = _BETWEEN_LETTERS.search(text, start + most)
        if not cut:
            break
        pieces.append(text[start : cut.start()])
        start = cut.start()
    return [*pieces, text[start:]]


def drops_space(spec: dict) -> bool:
    """Whether the tokenizer's own splitting throws white space away."""
    steps = spec.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    first = steps[0] if steps else {}
    return (
        first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and bool(first.get("invert"))
        and r"\s" in str(first.get("pattern"))
    )


class Counter:
    """Counts the tokens of texts; one per Python worker task."""

    def __init__(self, content: bytes, sentencepiece: bool, piece_bytes: int, memo: int):
        self.piece_bytes, self.most = piece_bytes, memo
        self.memo: dict[str, int] = {}
        if sentencepiece:
            import sentencepiece as sp

            model = sp.SentencePieceProcessor(model_proto=content)
            self.count = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.count = self._words if drops_space(json.loads(content)) else self._pieces

    def _lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, texts: list[str]) -> list[int]:
        memo, cut = self.memo, [text.split(" ") for text in texts]
        new = list(dict.fromkeys(w for words in cut for w in words if w not in memo))
        memo.update(zip(new, self._lengths(new), strict=True))
        lengths = [sum(map(memo.__getitem__, words)) for words in cut]
        if len(memo) > self.most:
            memo.clear()
        return lengths

    def _pieces(self, texts: list[str]) -> list[int]:
        cut = [safe_pieces(text, self.piece_bytes) for text in texts]
        lengths = iter(self._lengths([piece for pieces in cut for piece in pieces]))
        return [sum(next(lengths) for _ in pieces) for pieces in cut]


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
    batch_bytes: int = BATCH_BYTES,
    piece_bytes: int = PIECE_BYTES,
    memo: int = MEMO,
) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_tokens``, ``over_limit``.

    No begin, end or added special tokens, no truncation, no padding; special strings
    inside a text count as the library counts them by default. A null or empty text has
    no bytes and no tokens. Repeated rows are counted each; a null id stays null; other
    columns are not read. One pass over the texts, no shuffle; a task holds one
    Arrow batch, ``batch_bytes`` of it as text at a time, and at most ``memo``
    counts plus those of one batch.
    """
    with open(tokenizer_path, "rb") as file:
        content = file.read(VOCABULARY_BYTES + 1)
    if len(content) > VOCABULARY_BYTES:
        raise ValueError(f"{tokenizer_path} is larger than a vocabulary can be")
    shipped = docs.sparkSession.sparkContext.broadcast(content)
    pieces = str(tokenizer_path).endswith(".model")
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = pa_type(slim)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shipped.value, pieces, piece_bytes, memo)
        for batch in batches:
            texts = batch.column("text")
            sizes = pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0)
            lengths: list[int] = []
            for start, stop in byte_groups(sizes.to_pylist(), batch_bytes):
                part = texts.slice(start, stop - start).to_pylist()
                lengths += counter.count([text or "" for text in part])
            tokens = pa.array(lengths, pa.int64())
            over = pc.greater(tokens, limit)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), sizes, tokens, over],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    schema = f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean"
    return slim.mapInArrow(count, schema).withColumnRenamed("id", id_col)


def pa_type(df: DataFrame, column: str = "id") -> str:
    """The column's type as DDL."""
    return df.schema[column].dataType.simpleString()
