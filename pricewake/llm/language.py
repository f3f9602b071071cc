"""Language of texts, word by word, with a linear-chain conditional random field.

A word's features are the 2- to 4-grams of ``^word$``, those at the ends being its
affixes, and its entry in a lexicon learned from the training words. Label weights of
the features and of the transitions are fitted by the gradient of the conditional
likelihood; forward-backward gives each word its label probabilities, so text that
switches language inside is labelled in parts. A text's language is the label with the
largest sum over its words.

A transition has three weights a label: to stay in it, to leave it, to enter it. So a step costs
as many operations as there are labels, and what few changes of language a sample holds
is enough to learn them. Changes are taught by joined spans of two languages.

Words are runs of letters. The chain is cut every ``SPAN`` words, so that spans of many
texts go through forward-backward side by side in numpy, and a very long text is
many spans. Emissions of words seen before come from a bounded memo.

Training takes a bounded sample, ``per_label`` documents and ``spans_per_doc`` spans of
each; prediction covers all words of all texts. The features are sized per label, and each label
brings its own most frequent ones.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewake.llm.rows import keep_rows
from pricewake.llm.tokens import byte_groups, pa_type

SPAN = 64
GRAMS = (2, 3, 4)
UNKNOWN = "und"
PER_LABEL = 300
SPANS_PER_DOC = 8
MAX_LABELS = 8_192
FEATURES_PER_LABEL = 10_000
LEXICON_PER_LABEL = 1_000
MAX_WEIGHTS = 1 << 24
# Spans times labels that a sample is held to; it is at least one span a label.
SAMPLE_WORK = 1_000_000
# One joined span of two languages for so many spans of one.
JOIN_EVERY = 2
MEMO_CELLS = 400_000
# Numbers in the largest array of a training step.
STEP = 1 << 22
GROUP_BYTES = 1 << 18
MIN_KNOWN = 0.6
# So many known words are lent to every text, as a few unknown ones say little.
LENT = 3

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """The lower-cased letter runs; none where the text has no letter."""
    words = _WORD.findall((text or "").lower())
    return words if any(c.isalpha() for word in words for c in word) else []


def grams_of(word: str) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]


def forward_backward(
    emit: np.ndarray, lengths: np.ndarray, move: np.ndarray, start: np.ndarray, count: bool = True
):
    """Posteriors (spans, SPAN, labels) of spans sorted by falling length.

    ``emit``, ``move`` and ``start`` are scores, not probabilities. The rows of ``move`` are to stay in a label, to
    leave it and to enter it; from one label to another both of the latter count. Also returns the
    expected number of each, zero unless they are to be counted, and the log-likelihood normaliser of every span.
    """
    spans, most, labels = emit.shape
    top = emit.max(axis=2, keepdims=True)
    weight = np.exp(emit - top)
    stay, leave, enter = np.exp(move)
    alive = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(most + 1)]
    ahead = np.zeros_like(weight)
    scale = np.ones((spans, most))
    ahead[:, 0] = weight[:, 0] * np.exp(start)
    scale[:, 0] = ahead[:, 0].sum(1)
    ahead[:, 0] /= scale[:, :1]
    for t in range(1, most):
        n = alive[t]
        if not n:
            break
        last = ahead[:n, t - 1]
        out = last * leave
        step = (last * stay + (out.sum(1, keepdims=True) - out) * enter) * weight[:n, t]
        scale[:n, t] = step.sum(1)
        ahead[:n, t] = step / scale[:n, t, None]
    behind = np.ones_like(weight)
    moves = np.zeros((3, labels))
    for t in range(most - 2, -1, -1):
        n = alive[t + 1]
        if not n:
            continue
        later = weight[:n, t + 1] * behind[:n, t + 1] / scale[:n, t + 1, None]
        into = later * enter
        others = into.sum(1, keepdims=True) - into
        behind[:n, t] = later * stay + leave * others
        if not count:
            continue
        last = ahead[:n, t]
        out = last * leave
        moves[0] += (last * later).sum(0) * stay
        moves[1] += (out * others).sum(0)
        moves[2] += (into * (out.sum(1, keepdims=True) - out)).sum(0)
    live = np.arange(most)[None, :] < lengths[:, None]
    posterior = ahead * behind * live[:, :, None]
    normaliser = ((np.log(scale) + top[:, :, 0]) * live).sum(1)
    return posterior, moves, normaliser


def spans_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text number of each span, by falling length."""
    ends = np.cumsum(sizes)
    counts = -(-sizes // SPAN)
    owner = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = (ends - sizes)[owner] + number * SPAN
    length = np.minimum(SPAN, ends[owner] - start)
    order = np.argsort(-length, kind="stable")
    return start[order], length[order], owner[order]


@dataclass
class Model:
    """Weights of a trained field; ``labels`` is empty where nothing could be learned."""

    labels: list[str]
    features: dict[str, int]
    lexicon: dict[str, int]
    weights: np.ndarray
    move: np.ndarray
    start: np.ndarray
    _rows: dict[str, int] = field(default_factory=dict)
    _scores: list[np.ndarray] = field(default_factory=list)

    def indices(self, word: str) -> list[int]:
        get = self.features.get
        found = [i for i in map(get, grams_of(word)) if i is not None]
        entry = self.lexicon.get(word)
        return found if entry is None else [*found, entry]

    def is_known(self, word: str, rows: list[int]) -> bool:
        """Whether the word is in the lexicon, or at least three quarters of its n-grams are features."""
        # As many as grams_of gives, without making them.
        grams = sum(max(0, len(word) + 3 - n) for n in GRAMS)
        return word in self.lexicon or 4 * len(rows) >= 3 * grams

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Label scores of distinct words, and in the last column whether they are known."""
        rows = [self.indices(word) for word in words]
        known = [self.is_known(word, row) for word, row in zip(words, rows, strict=True)]
        entries = _Entries([row or [0] for row in rows])
        return np.column_stack((entries.scores(self.weights), known))

    def emissions(self, words: list[str]) -> np.ndarray:
        """Label scores of each word, through the memo, and whether it is known."""
        if len(self._rows) * len(self.labels) > MEMO_CELLS:
            self._rows, self._scores = {}, []
        rows = self._rows
        new = list(dict.fromkeys(word for word in words if word not in rows))
        if new:
            for number, word in enumerate(new, len(rows)):
                rows[word] = number
            self._scores.append(self.word_scores(new))
            self._scores = [np.concatenate(self._scores)]
        ids = np.fromiter(map(rows.__getitem__, words), np.int64, len(words))
        return self._scores[0][ids]

    def label(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Summed label probabilities of each text, the probabilities of its words, and how many words are known."""
        cut = [words_of(text) for text in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        labels = len(self.labels)
        sums = np.zeros((len(texts), labels))
        empty = [np.zeros((0, labels))] * len(texts)
        if not labels or not sizes.sum():
            return sums, empty, np.zeros(len(texts))
        scores = self.emissions([word for words in cut for word in words])
        start, length, owner = spans_of(sizes)
        at = np.minimum(start[:, None] + np.arange(SPAN), len(scores) - 1)
        live = np.arange(SPAN)[None, :] < length[:, None]
        flat = np.zeros((len(scores), labels))
        emit = np.ascontiguousarray(scores[:, :labels])
        # Spans are independent; with many labels a few at a time.
        step = max(1, STEP // (SPAN * labels))
        for a in range(0, len(at), step):
            part = slice(a, a + step)
            posterior, _, _ = forward_backward(emit[at[part]], length[part], self.move, self.start, False)
            by_span = posterior.sum(1)
            for i in range(labels):
                sums[:, i] += np.bincount(owner[part], by_span[:, i], len(texts))
            flat[at[part][live[part]]] = posterior[live[part]]
        known = np.bincount(np.repeat(np.arange(len(sizes)), sizes), scores[:, labels], len(texts))
        return sums, np.split(flat, np.cumsum(sizes)[:-1]), known


def _slices(sizes: np.ndarray, labels: int) -> Iterator[tuple[int, int]]:
    """Stretches of groups with at most ``STEP`` cells together, or one group."""
    if not len(sizes):
        return
    ends = np.cumsum(sizes) * labels // STEP
    edges = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(sizes)]
    yield from zip(edges, edges[1:], strict=False)


def _group_sums(values: Callable[[slice], np.ndarray], sizes: np.ndarray, labels: int) -> np.ndarray:
    """Sums over consecutive groups of rows, which are fetched a slice at a time; no group is empty."""
    first = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), labels))
    for a, b in _slices(sizes, labels):
        low, high = first[a], first[b - 1] + sizes[b - 1]
        out[a:b] = np.add.reduceat(values(slice(low, high)), first[a:b] - low, axis=0)
    return out


class _Entries:
    """Which weights each of some words has, and the sums in both directions."""

    def __init__(self, rows: list[list[int]]):
        self.sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self.flat = np.fromiter((i for row in rows for i in row), np.int64, int(self.sizes.sum()))
        self.share = 1 / np.sqrt(self.sizes)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the weights of each word, over the root of their number."""
        sums = _group_sums(lambda part: weights[self.flat[part]], self.sizes, weights.shape[1])
        return sums * self.share[:, None]

    def turned(self) -> _Entries:
        """Also sorted by weight, for ``add_back``."""
        order = np.argsort(self.flat, kind="stable")
        self.owners = np.repeat(np.arange(len(self.sizes)), self.sizes)[order]
        self.used, self.uses = np.unique(self.flat, return_counts=True)
        return self

    def add_back(self, by_word: np.ndarray, up: np.ndarray) -> None:
        """Add what each word says to all its weights."""
        by_word = by_word * self.share[:, None]
        up[self.used] += _group_sums(lambda part: by_word[self.owners[part]], self.uses, up.shape[1])


class _Step:
    """Spans of words that one step of training takes together, by falling length."""

    def __init__(self, spans: list[tuple[list[int], list[str]]], weight: list[float], model: Model):
        self.length = np.array([len(words) for _, words in spans])
        shape = (len(spans), int(self.length.max()))
        self.live = np.arange(shape[1])[None, :] < self.length[:, None]
        types = {word: i for i, word in enumerate(dict.fromkeys(w for _, words in spans for w in words))}
        self.at, self.gold = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        self.at[self.live] = [types[word] for _, words in spans for word in words]
        self.gold[self.live] = [label for gold, _ in spans for label in gold]
        self.weight = np.array(weight)
        self.entries = _Entries([model.indices(word) or [0] for word in types]).turned()
        self.order = np.argsort(self.at[self.live], kind="stable")
        self.uses = np.bincount(self.at[self.live], minlength=len(types))
        a, b = self.gold[:, :-1][self.live[:, 1:]], self.gold[:, 1:][self.live[:, 1:]]
        labels = len(model.labels)
        self.seen = np.stack(
            [np.bincount(x, minlength=labels) for x in (a[a == b], a[a != b], b[a != b])]
        )

    def add(self, model: Model, up: list[np.ndarray]) -> None:
        """Add the gradient of these spans."""
        labels = len(model.labels)
        scores = self.entries.scores(model.weights)
        off, moves, _ = forward_backward(scores[self.at], self.length, model.move, model.start)
        np.negative(off, out=off)
        spans, places = np.nonzero(self.live)
        off[spans, places, self.gold[self.live]] += 1
        off *= self.weight[:, None, None]
        cells = off[self.live]
        by_word = _group_sums(lambda part: cells[self.order[part]], self.uses, labels)
        self.entries.add_back(by_word, up[0])
        up[1] += self.seen - moves
        up[2] += off[:, 0].sum(0)


def joined_spans(spans: list[tuple[str, list[str]]]) -> list[tuple[list[str], list[str]]]:
    """Spans that change language: starts of two of different labels, 3 to 32 words each where they have them.

    One for ``JOIN_EVERY`` given ones, less where the drawn pairs have one label. Returns (labels, words).
    """
    drawn = sorted(spans, key=lambda x: (zlib.crc32(" ".join(x[1]).encode()), x[0], x[1]))
    out = []
    for i in range(len(drawn) // JOIN_EVERY):
        (a, front), (b, back) = drawn[i], drawn[len(drawn) - 1 - i]
        if a != b:
            mark = zlib.crc32(f"{i}".encode())
            front, back = front[: 3 + mark % 30], back[: 3 + (mark >> 8) % 30]
            out.append(([a] * len(front) + [b] * len(back), front + back))
    return out


def _own_first(counts: list[Counter], most: int, least: int) -> list[str]:
    """At most ``most`` entries, the labels taking turns with their next most frequent one.

    Only what is counted at least ``least`` times over all labels.
    """
    total: Counter = Counter()
    for own in counts:
        total.update(own)
    rank: dict[str, int] = {}
    for own in counts:
        for place, (entry, _) in enumerate(sorted(own.items(), key=lambda x: (-x[1], x[0]))):
            if place < rank.get(entry, place + 1):
                rank[entry] = place
    fit = [entry for entry in rank if total[entry] >= least]
    return sorted(fit, key=lambda x: (rank[x], -total[x], x))[:most]


def fit(
    spans: list[tuple[str, list[str]]],
    rounds: int = 30,
    rate: float = 0.3,
    decay: float = 1e-4,
    features_per_label: int = FEATURES_PER_LABEL,
    lexicon_per_label: int = LEXICON_PER_LABEL,
    max_weights: int = MAX_WEIGHTS,
) -> Model:
    """Fit the field to spans of words with one label each, and to joined ones, by Adam on the likelihood.

    There are ``features_per_label`` n-grams and ``lexicon_per_label`` words for each label, and each label brings its
    own most frequent ones. With very many labels ``max_weights`` (weights are entries times
    labels) leaves fewer, in the same order; it bounds the memory of the driver and what is shipped.
    """
    spans = [(label, words) for label, words in spans if words]
    labels = sorted({label for label, _ in spans})
    if not labels:
        none = np.zeros((1, 0))
        return Model([], {}, {}, none, np.zeros((3, 0)), np.zeros(0))
    number = {label: i for i, label in enumerate(labels)}
    words_by: list[Counter] = [Counter() for _ in labels]
    for label, words in spans:
        words_by[number[label]].update(words)
    grams_by = [Counter(gram for word in own for gram in set(grams_of(word))) for own in words_by]
    entries = max(2, max_weights // len(labels))
    n_words = min(lexicon_per_label * len(labels), entries // 4)
    often = _own_first(words_by, n_words, 5)
    common = _own_first(grams_by, min(features_per_label * len(labels), entries - len(often)), 2)
    # Row 0 belongs to words without a known feature and learns the prior.
    features = {gram: i for i, gram in enumerate(common, 1)}
    lexicon = {word: i for i, word in enumerate(often, 1 + len(common))}
    size = 1 + len(features) + len(lexicon)
    model = Model(
        labels,
        features,
        lexicon,
        np.zeros((size, len(labels))),
        np.zeros((3, len(labels))),
        np.zeros(len(labels)),
    )
    # Every label weighs the same, however many spans it has.
    held = Counter(label for label, _ in spans)
    plain = [([number[x]] * len(words), words, len(spans) / len(labels) / held[x]) for x, words in spans]
    mixed = [([number[x] for x in own], words, 1.0) for own, words in joined_spans(spans)]
    taught = sorted(plain + mixed, key=lambda x: (-len(x[1]), x[0], x[1]))
    many = max(1, STEP // (SPAN * len(labels)))
    steps = [
        _Step([x[:2] for x in taught[i : i + many]], [x[2] for x in taught[i : i + many]], model)
        for i in range(0, len(taught), many)
    ]
    total = sum(len(words) * weight for _, words, weight in taught)
    # Moves are not weighted by label: a few numbers that all labels share.
    plainly = total / max(1, sum(len(words) for _, words, _ in taught))
    params = [model.weights, model.move, model.start]
    means = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for turn in range(1, rounds + 1):
        up = [np.zeros_like(p) for p in params]
        for step in steps:
            step.add(model, up)
        up[1] *= plainly
        for p, up_p, (m, v) in zip(params, up, means, strict=True):
            g = up_p / total - decay * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return model


def held_out(id_col: str) -> Column:
    """Whether a document is kept out of training: crc32 of its id's text, modulo 4, is 2."""
    part = F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2
    return F.coalesce(part, F.lit(False))


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_label: int = PER_LABEL,
    spans_per_doc: int = SPANS_PER_DOC,
    max_labels: int = MAX_LABELS,
    **options,
) -> Model:
    """Learn from documents that are not held out and have a language.

    Per label about ``per_label`` documents are drawn by a hash of the id, and of each at most
    ``spans_per_doc`` spans from all over its text. That sample, a few megabytes whatever the input,
    is the only text that reaches the driver. With more than 20 labels fewer are drawn of each, so that spans times labels
    stay below ``SAMPLE_WORK``, but one document at least. Of more than ``max_labels`` values of the
    language column, the most frequent ones are learned. Without a usable row the model has no labels.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
    ).filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out("id"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").take(max_labels)
    if not counts:
        return fit([])
    room = max(1, SAMPLE_WORK // len(counts) ** 2)
    spans_per_doc = min(spans_per_doc, room)
    per_label = min(per_label, room // spans_per_doc)
    # Not fewer than a few are to be expected of a label, as a draw by hash may give none.
    wanted = max(per_label, 4)
    spark = docs.sparkSession
    share = spark.createDataFrame(
        [(row["lang"], min(1.0, wanted / row["count"])) for row in counts], "lang string, share double"
    )
    draw = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = (
        rows.join(F.broadcast(share), "lang")
        .filter(draw < F.col("share"))
        .select(F.col("id").cast("string").alias("key"), "text", "lang")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, str, str]] = []
            for key, text, lang in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = words_of(text)
                starts = range(0, len(words), SPAN)
                ranked = sorted((zlib.crc32(f"{key}:{s}".encode()), s) for s in starts)
                for rank, s in ranked[:spans_per_doc]:
                    out.append((rank, lang, " ".join(words[s : s + SPAN])))
            kinds = (pa.int64(), pa.string(), pa.string())
            columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["rank", "lang", "words"])

    spans = drawn.mapInArrow(cut, "rank long, lang string, words string")
    # Twice what is to be expected: a bound that holds where one id has very many rows.
    most = 2 * wanted * spans_per_doc * len(counts)
    found = spans.orderBy("rank", "lang", "words").limit(most).collect()
    return fit([(row["lang"], row["words"].split(" ")) for row in found], **options)


def _scan(model: Model, texts: pa.Array):
    """(label, score, words, share of known words) of each text, a group of bytes at a time."""
    sizes = pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0).to_pylist()
    # The scores of a group's words are its largest array.
    limit = max(1, GROUP_BYTES * 4 // max(4, len(model.labels)))
    for start, stop in byte_groups(sizes, limit):
        sums, words, known = model.label(texts.slice(start, stop - start).to_pylist())
        for total, probabilities, sure in zip(sums, words, known, strict=True):
            if not len(probabilities):
                yield UNKNOWN, 0.0, probabilities, 0.0
            else:
                best = int(total.argmax())
                score = min(1.0, max(0.0, float(total[best] / len(probabilities))))
                yield model.labels[best], score, probabilities, float(sure / len(probabilities))


def _runs(model: Model, probabilities: np.ndarray) -> list[dict]:
    if not len(probabilities):
        return []
    best = probabilities.argmax(1)
    edges = np.flatnonzero(np.diff(best)) + 1
    starts, stops = np.concatenate(([0], edges)), np.concatenate((edges, [len(best)]))
    return [
        {"start": int(a), "stop": int(b), "lang": model.labels[best[a]]}
        for a, b in zip(starts, stops, strict=True)
    ]


def predict(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, ``lang_pred``, ``score`` (0 to 1), ``n_words``, ``runs``, ``known``.

    ``runs`` are the stretches of words of one language, words numbered from 0. ``known`` is the share of words that
    the lexicon has, or three quarters of whose n-grams are features. A null text,
    one without a letter, or a model without labels gives ``und`` with score 0 and no runs.
    Only the text is an input of a prediction. Repeated rows are labelled each, a null id
    stays null, other columns are not read, ties go to the smaller label. One pass, no
    shuffle; a task holds one Arrow batch and ``GROUP_BYTES`` of text with its scores.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    run = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            found = [
                (lang, score, len(p), _runs(own, p), known)
                for lang, score, p, known in _scan(own, batch.column("text"))
            ]
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.list_(run), pa.float64())
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *columns], names=["id", "lang_pred", "score", "n_words", "runs", "known"]
            )

    schema = (
        f"id {pa_type(slim)}, lang_pred string, score double, n_words long, "
        "runs array<struct<start:long,stop:long,lang:string>>, known double"
    )
    return slim.mapInArrow(label, schema).withColumnRenamed("id", id_col)


def keep_known(
    docs: DataFrame,
    model: Model,
    min_score: float = 0.5,
    min_known: float = MIN_KNOWN,
    text_col: str = "text",
) -> DataFrame:
    """The documents with a recognised language: not ``und``, a score of at least ``min_score``, and a share of
    known words of at least ``min_known``, ``LENT`` known words added.

    The score compares the learned languages with each other; the known words tell text in none of them, however
    few languages were learned; a neighbour in the same script shares many n-grams and can pass. Rows pass through with all their columns, whatever those are called; no shuffle. A model
    without labels recognises nothing.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def mask():
        own = shipped.value
        return lambda texts: [
            lang != UNKNOWN
            and score >= min_score
            and known * len(words) + LENT >= min_known * (len(words) + LENT)
            for lang, score, words, known in _scan(own, texts)
        ]

    return keep_rows(docs, text_col, mask)
