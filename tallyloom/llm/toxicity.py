"""Toxicity by multiple-instance learning: only documents have labels, sentences get the scores.

A document is a bag of sentences. A sentence's probability is a logistic function of its words
(each word counts once a sentence, through the word itself and its beginnings); a document's is the
noisy-or of its sentences, 1 - prod(1 - p). Training follows the gradient of the document loss into
the sentences, so that the sentences which explain a label take the blame. The same scores then
locate the offending sentences.

The fit sees a bounded sample: up to MAX_POSITIVE and MAX_NEGATIVE labelled documents in the order
of a seeded hash, and of each class as many of these, whole and whatever their length, as begin
within the first MAX_CHARS characters. The rest runs on all rows: the model, a few thousand word
weights, is broadcast.

Defined cases: null and empty texts have no sentence: they score the model's prior for an empty
sentence, as any document does at least. Labels that are null, or whose documents are missing, are
left out; a document labelled twice counts as toxic if any label says so. With no label of one
class at all every score is 0. Repeated rows give repeated rows; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import slices, whole_text

MAX_POSITIVE = 2_500
MAX_NEGATIVE = 5_000
MAX_CHARS = 12_000_000
#: A feature enters if its documents are toxic so many standard deviations more (or less) often
#: than all are, and if it occurs in so many documents: most words say nothing.
LEAST_DOCUMENTS = 5
LEAST_DEVIATION = 5.0
EPOCHS = 240
RATE = 0.08
RIDGE = 2e-4
THRESHOLD = 0.7
#: Words remembered with their weight by a worker.
REMEMBERED = 200_000

SENTENCE = re.compile(r"[^.!?\n|]+")
WORD = re.compile(r"[^\W\d_]+")


def parts(word: str) -> list[str]:
    """Features of a word: itself and its beginnings of four to eight letters."""
    return [word, *(f"{word[:k]}-" for k in range(4, min(8, len(word)) + 1))]


def sentences(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """Start, end and distinct lower-case words of each sentence that has any."""
    for m in SENTENCE.finditer(text):
        words = set(WORD.findall(m.group().lower()))
        if words:
            yield m.start(), m.end(), words


class Model:
    """bias and the weights of features."""

    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias = bias
        self.weights = weights

    def word(self, word: str) -> float:
        get = self.weights.get
        return sum(get(p, 0.0) for p in parts(word))


class _Words(dict):
    """word -> weight, remembered up to a bound."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = self.model.word(word)
        return value


def fit(texts: list[str], labels: list[int]) -> Model:
    """Noisy-or logistic model of documents, by Adam on the whole sample."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(-math.inf, {})
    words: dict[str, int] = {}
    rows, bounds, owner = [], [0], []
    seen: Counter[str] = Counter()
    toxic: Counter[str] = Counter()
    for d, text in enumerate(texts):
        bags = [set()] + [w for _, _, w in sentences(text)]  # the empty sentence carries the prior
        found = {p for bag in bags for w in bag for p in parts(w)}
        seen.update(found)
        if y[d] > 0:
            toxic.update(found)
        for bag in bags:
            rows += [words.setdefault(w, len(words)) for w in sorted(bag)]
            bounds.append(len(rows))
            owner.append(d)
    base = y.mean()
    names = sorted(p for p, n in seen.items() if n >= LEAST_DOCUMENTS and abs(toxic[p] - n * base) >= LEAST_DEVIATION * math.sqrt(n * base * (1 - base)))
    index = {p: i for i, p in enumerate(names)}
    word_of, feature = [], []
    for w, k in words.items():
        for p in parts(w):
            if p in index:
                word_of.append(k)
                feature.append(index[p])
    word_of, feature = np.array(word_of, np.int64), np.array(feature, np.int64)
    rows, owner = np.array(rows, np.int64), np.array(owner, np.int64)
    sentence = np.repeat(np.arange(len(owner)), np.diff(bounds))
    w, b = np.zeros(len(names)), -5.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    # Rare positives weigh as much in sum as the negatives.
    weight = np.where(y > 0, max(1.0, (y == 0).sum() / y.sum()), 1.0) / len(y)
    for step in range(1, EPOCHS + 1):
        by_word = np.bincount(word_of, w[feature], len(words))
        z = np.clip(b + np.bincount(sentence, by_word[rows], len(owner)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = np.bincount(owner, np.log1p(-p), len(y))  # log of the chance that no sentence is toxic
        none = np.exp(np.minimum(clean, -1e-9))
        # d loss / d z of a sentence: p for a clean document, -p * none / (1 - none) for a toxic one
        slope = np.where(y > 0, -none / (1 - none), 1.0) * weight
        g = p * slope[owner]
        by_word = np.bincount(rows, g[sentence], len(words))
        grad = np.append(np.bincount(feature, by_word[word_of], len(names)) + RIDGE / 100 * w, g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
        w, b = w - move[:-1], b - move[-1]
    return Model(float(b), {n: float(x) for n, x in zip(names, w, strict=True) if abs(x) > 1e-3})


def _none(z: float) -> float:
    """log(1 - sigmoid(z))"""
    return -(z + math.log1p(math.exp(-z))) if z > 0 else -math.log1p(math.exp(z))


def score_text(text: str, model: Model, words: dict[str, float]) -> tuple[float, int, int, float]:
    """Score, and the start, end and probability of the worst sentence (-1, -1, 0 without any)."""
    bias = model.bias
    none, worst, span = _none(bias), -math.inf, (-1, -1)
    for start, end, bag in sentences(text):
        z = bias + sum(map(words.__getitem__, bag))
        none += _none(z)
        if z > worst:
            worst, span = z, (start, end)
    top = 1 - math.exp(_none(worst)) if worst > -math.inf else 0.0
    return min(1.0, max(0.0, -math.expm1(none))), *span, top


def training_sample(docs: DataFrame, labels: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, toxic, text of the bounded sample; rows with crc32(doc_id) mod 3 = 1 never enter."""
    marks = labels.where("toxic is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = marks.join(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id")
    order = F.xxhash64(F.lit(seed), "doc_id")
    drawn = known.where("toxic = 1").orderBy(order, "doc_id").limit(MAX_POSITIVE).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(MAX_NEGATIVE))
    texts = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    # A window over the bounded sample only.
    before = Window.partitionBy("toxic").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return texts.withColumn("before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).where(F.col("before") < MAX_CHARS).select("doc_id", "toxic", "text")


def train(docs: DataFrame, labels: DataFrame, seed: int = 0) -> Model:
    rows = training_sample(docs, labels, seed).toPandas().sort_values("doc_id")
    return fit(rows["text"].tolist(), rows["toxic"].tolist())


SCORED = "doc_id long, score double, worst_start int, worst_end int, worst_p double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the worst sentence of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        words = _Words(own)
        for batch in slices(batches):
            rows = [score_text(t, own, words) for t in batch.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = [pa.float64(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [f.split()[0] for f in SCORED.split(", ")])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(work, SCORED)


def locate(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, start, end, p of every sentence with probability at least `least` (code points)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        words = _Words(own)
        for batch in slices(batches):
            out: list[list] = [[], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for start, end, bag in sentences(text):
                    p = 1 - math.exp(_none(own.bias + sum(map(words.__getitem__, bag))))
                    if p >= least:
                        for column, value in zip(out, (doc_id, start, end, p), strict=True):
                            column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "start", "end", "p"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(work, "doc_id long, start int, end int, p double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the worst sentence of every row of docs."""
    scored = score(docs, train(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst_start", "worst_end", "worst_p")
