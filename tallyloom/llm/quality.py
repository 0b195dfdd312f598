"""Quality by co-training two views of a page.

The content view measures the text (case, symbols, repetition, word forms, line layout), the metadata
view what is stated of the page and never reads the text (source, language, stated length). Each
view has its own logistic classifier. Over ROUNDS rounds each labels the unlabelled rows it is
surest of and hands them to the other view's training set. Then both are calibrated on labelled
rows that neither was trained on (Platt), and a logistic combination of the calibrated views, fitted
on the same rows, scores every document.

The fits see MAX_LABELLED labelled rows, in the order of a seeded hash, and what the views hand each
other: of all unlabelled rows, which every round scores on Spark, the MAX_GIVEN surest of each class.
They are feature vectors of fixed length, written once for all rows; texts never reach the driver.
Feature vectors come from whole texts, and all rows are scored.

Defined cases: null text counts as empty, null source and language as values of their own, null
n_chars as a stated length of its own kind. Labels that are null or without a document are left out; a document
labelled twice takes the lower label. With no label of one class every score is 1 and every row is
kept. Repeated rows give repeated rows; extra columns pass through keep(); an empty table gives no
rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import durable, release, rows_of, slices, unused, whole_text

MAX_LABELLED = 9_000
ROUNDS = 4
#: Rows of each class that a view hands on in a round, the surest of all, and how sure it must be.
MAX_GIVEN = 225
SURE = 0.97
RIDGE = 1e-3
KEEP = 0.5
HASHED = 16

SYMBOLS = "!|#$%&*=+~^<>{}[]\\@_"
TEXT_FEATURES = 6 + len(SYMBOLS) + 10 + 6
#: Stated lengths are told apart by powers of four.
LENGTHS = 12
META_FEATURES = 2 * HASHED + 2 + LENGTHS


def text_view(text: str) -> list[float]:
    """Content of a whole text in TEXT_FEATURES numbers."""
    chars = max(1, len(text))
    words = text.split()
    n = max(1, len(words))
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    upper, lower, digits = int(raw[65:91].sum()), int(raw[97:123].sum()), int(raw[48:58].sum())
    counts = [text.count(c) for c in SYMBOLS]
    shouted = sum(map(str.isupper, words))
    twins = sum(map(eq, words, words[1:]))
    distinct = len(set(words))
    ends = sum(text.count(e) for e in (". ", ".\n")) + text.endswith(".")
    sizes = [len(x) for x in text.split("\n")]
    return [
        upper / max(1, upper + lower), digits / chars, 1 - int(raw[:128].sum()) / chars, shouted / n, twins / n, 1 - distinct / n,
        *(np.sqrt(c / n) for c in counts),
        np.log1p(sum(counts)), np.log1p(n), chars / n / 10, ends / n, text.count(",") / n, float(shouted > 0), float(twins > 2), np.log1p(twins), np.log1p(shouted), float(sum(counts) > 0.2 * n),
        np.log1p(len(text)), np.log1p(len(sizes)), np.log1p(max(sizes)), np.log1p(len(text) / len(sizes)), sum(s < 30 for s in sizes) / len(sizes), int(raw.sum()) / chars - 1,
    ]


def _mark(value: str | None) -> list[float]:
    out = [0.0] * HASHED
    out[0 if value is None else 1 + zlib.crc32(value.encode()) % (HASHED - 1)] = 1.0
    return out


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    """Page metadata in META_FEATURES numbers: where from, which language, how long by its own account."""
    size = max(0, n_chars or 0)
    length = [0.0] * LENGTHS
    length[min(LENGTHS - 1, size.bit_length() // 2)] = 1.0
    return [*_mark(source), *_mark(lang), np.log1p(size), float(n_chars is None), *length]


def _vectors(text, source, lang, n_chars) -> np.ndarray:
    return np.array([text_view(t) + meta_view(s, g, c) for t, s, g, c in zip(text, source, lang, n_chars, strict=True)], float).reshape(-1, TEXT_FEATURES + META_FEATURES)


class Logistic:
    """Ridge logistic regression on standardised features, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = RIDGE):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        weight = np.full(len(y), 1.0) if weight is None else weight
        z = self._inputs(x)
        self.w = np.zeros(z.shape[1])
        penalty = ridge * weight.sum() * np.append(np.ones(z.shape[1] - 1), 1e-6)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            grad = z.T @ (weight * (p - y)) + penalty * self.w
            curve = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty + 1e-9)
            step = np.linalg.solve(curve, grad)
            self.w -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-6:
                break

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._inputs(x) @ self.w, -30, 30)

    def p(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def _balanced(y: np.ndarray) -> np.ndarray:
    return np.where(y > 0, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))


VIEWS = (slice(0, TEXT_FEATURES), slice(TEXT_FEATURES, None))


class CoTrained:
    """Two view classifiers, their calibrations and the combination."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, surest: Callable):
        """x, y: labelled rows; held marks those kept for calibration; surest: what _surest() gives of the unlabelled ones."""
        views = VIEWS
        sets = [(x[~held], y[~held]) for _ in views]
        taken: set[int] = set()
        self.views, self.exchanged = views, []
        for _ in range(ROUNDS):
            models = [Logistic(sx[:, v], sy, _balanced(sy)) for v, (sx, sy) in zip(views, sets, strict=True)]
            found, given = surest(models, taken), [0, 0]
            for k, other in ((0, 1), (1, 0)):
                for label in (1.0, 0.0):
                    # A row goes to one view only, the first that asks for it.
                    new = [r for r in found if r["view"] == k and r["label"] == label and r["doc_id"] not in taken][:MAX_GIVEN]
                    taken.update(r["doc_id"] for r in new)
                    given[k] += len(new)
                    if new:
                        sets[other] = np.concatenate([sets[other][0], np.array([r["vector"] for r in new])]), np.concatenate([sets[other][1], np.full(len(new), label)])
            self.exchanged.append(tuple(given))
            if not sum(given):
                break
        self.models = [Logistic(sx[:, v], sy, _balanced(sy)) for v, (sx, sy) in zip(views, sets, strict=True)]
        raw = [m.logit(x[held][:, v])[:, None] for m, v in zip(self.models, views, strict=True)]
        self.calibrations = [Logistic(r, y[held]) for r in raw]
        self.combined = Logistic(np.column_stack([c.logit(r) for c, r in zip(self.calibrations, raw, strict=True)]), y[held])

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Content, metadata and combined probability of good quality."""
        logits = [c.logit(m.logit(x[:, v])[:, None]) for m, c, v in zip(self.models, self.calibrations, self.views, strict=True)]
        return *(1 / (1 + np.exp(-z)) for z in logits), self.combined.p(np.column_stack(logits))


VECTOR = "doc_id long, vector array<double>"
#: Lists of tasks that are merged at once.
MERGED = 64


def _sample(docs: DataFrame, labels: DataFrame, seed: int) -> tuple[pd.DataFrame, DataFrame]:
    """The drawn labelled rows, and a table of all unlabelled ones."""
    order = F.xxhash64(F.lit(seed), "doc_id")
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    drawn = marks.join(ids, "doc_id").orderBy(order, "doc_id").limit(MAX_LABELLED).withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 3 == 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            b = batch.to_pydict()
            rows = _vectors(b["text"], b["source"], b["lang"], b["n_chars"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(rows), pa.list_(pa.float64()))], ["doc_id", "vector"])

    # Texts become vectors where they are read; only vectors are joined.
    rows = docs.where("doc_id is not null").select("doc_id", whole_text().alias("text"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    vectors = durable(rows.mapInArrow(work, VECTOR), "quality-vectors")
    found = vectors.join(F.broadcast(drawn), "doc_id").toPandas()
    named = durable(labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "quality-labelled")
    pool = durable(rows_of(vectors, named, "doc_id", "left_anti"), "quality-pool")
    release(vectors, named)
    return found.sort_values("doc_id", kind="stable").drop_duplicates("doc_id"), pool


GIVEN = "view int, label double, sure double, doc_id long, vector array<double>"


def _surest(pool: DataFrame, seed: int) -> Callable:
    """A function of both models and the rows handed on so far: of all others the surest, for each view and class.

    A task keeps its own surest and Spark merges the tasks' lists. Twice MAX_GIVEN rows, as those
    that both views want go to one. Rows of one doc_id count once.
    """
    names = [f.split()[0] for f in GIVEN.split(", ")]
    most = 2 * MAX_GIVEN

    def surest(models: list[Logistic], taken: set[int]) -> list:
        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, float], tuple] = {}
            for batch in batches:
                ids = batch.column(0).to_numpy()
                x = batch.column(1).flatten().to_numpy().reshape(-1, TEXT_FEATURES + META_FEATURES)
                free = np.flatnonzero(~np.isin(ids, list(taken)))
                for k, v in enumerate(VIEWS):
                    p = models[k].p(x[free][:, v])
                    for label, sure in ((1.0, p), (0.0, 1 - p)):
                        some = np.flatnonzero(sure >= SURE)
                        rows = (sure[some], ids[free[some]], x[free[some]])
                        if (k, label) in held:
                            rows = tuple(np.concatenate(both) for both in zip(held[k, label], rows, strict=True))
                        order = np.lexsort((rows[1], -rows[0]))[:most]
                        held[k, label] = tuple(r[order] for r in rows)
            for (k, label), (sure, ids, x) in held.items():
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.int32()), pa.array([label] * n, pa.float64()), pa.array(sure), pa.array(ids), pa.array(list(x), pa.list_(pa.float64()))], names)

        order = [F.desc("sure"), F.xxhash64(F.lit(seed), "doc_id"), "doc_id"]
        found = pool.mapInArrow(best, GIVEN).withColumn("some", F.spark_partition_id() % MERGED)
        for keys in (["view", "label", "some"], ["view", "label"]):
            found = found.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= most)
        return found.orderBy("view", "label", "nth").collect()

    return surest


def train(docs: DataFrame, labels: DataFrame, seed: int = 0) -> CoTrained | None:
    """The classifiers, or None without labels of both classes in both folds."""
    known, pool = _sample(docs, labels, seed)
    try:
        for part in (known[known["held"].astype(bool)], known[~known["held"].astype(bool)]):
            if part["quality"].nunique() < 2:
                return None
        x = np.array(known["vector"].tolist(), float).reshape(-1, TEXT_FEATURES + META_FEATURES)
        return CoTrained(x, (known["quality"] > 0).to_numpy(float), known["held"].to_numpy(bool), _surest(pool, seed))
    finally:
        release(pool)


SCORES = ("content_score", "metadata_score", "score")


def _view(model: CoTrained) -> Column:
    """The three scores of a row as a struct."""

    @F.pandas_udf("content_score double, metadata_score double, score double")
    def view(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        sizes = [None if pd.isna(n) else int(n) for n in n_chars]
        return pd.DataFrame(dict(zip(SCORES, model.score(_vectors(text, source, lang, sizes)), strict=True)))

    return view(whole_text(), F.col("source"), F.col("lang"), F.col("n_chars").cast("long"))


def scored(docs: DataFrame, model: CoTrained | None) -> DataFrame:
    """docs with content_score, metadata_score and score (P of good quality) in place of any columns so called."""
    own = docs.drop(*SCORES)
    if model is None:
        return own.withColumns({c: F.lit(1.0) for c in SCORES})
    view = unused(own, "_view")
    return own.withColumn(view, _view(model)).select(*own.columns, *(F.col(view)[c].alias(c) for c in SCORES))


def keep(docs: DataFrame, labels: DataFrame, least: float = KEEP) -> DataFrame:
    """The rows of docs whose score is at least `least`, with all columns of docs, whatever their names."""
    model = train(docs, labels)
    return docs if model is None else docs.where(_view(model)["score"] >= least)
