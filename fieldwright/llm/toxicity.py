"""Toxicity by a chain of linear classifiers.

The chain predicts the label table's categories one after the other; each later model also gets the
earlier categories' probabilities. It is trained with out-of-fold predictions of these, so that it sees
them as unsure as they will be on new documents.

Features are the presence of words and of word beginnings, lower-cased. The labelled sample is bounded in rows
(``TRAIN_ROWS``), not in their texts: the features of whole texts are made and counted by class on the executors, and
of each row only those come to the driver that some model selects, where the small models are fitted. Both classes
of a category weigh the same, whatever their shares in the sample. All documents are scored on the executors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwright.llm.common import by_batch, materialize, released

#: At most so many labelled documents are learned from: of each category's two classes, those with the least hash of their doc_id.
TRAIN_ROWS = 6000
FOLDS = 4
SELECTED = 3000
#: The least difference of a feature between the classes, in standard errors.
SURE = 1.5
#: Gradient steps, their length, and the ridge penalty.
STEPS, RATE, PENALTY = 150, 0.3, 1e-3
PREFIXES = (4, 5, 6)
LETTERS = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    """Hashes (signed 64-bit) of a word and of its beginnings."""
    names = ["=" + word, *(word[:n] for n in PREFIXES if len(word) > n)]
    return [xxhash.xxh64_intdigest(n) - (1 << 63) for n in names]


def text_words(text: str | None) -> set[str]:
    return set(LETTERS.findall((text or "").lower()))


@dataclass
class Linear:
    """Weights by feature hash."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float
    earlier: np.ndarray


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear] = field(default_factory=list)


class Sample:
    """Rows of feature hashes as one sparse matrix; columns are the distinct hashes."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.hashes, self.column = np.unique(np.concatenate([*rows, np.zeros(0, np.int64)]), return_inverse=True)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.n = len(rows)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(sample: Sample, y: np.ndarray, earlier: np.ndarray, use: np.ndarray) -> tuple[Linear, np.ndarray]:
    """A ridge-penalised logistic regression on the rows ``use``; also the probabilities of all rows.

    The ``SELECTED`` features whose share differs most between the classes take part. Gradient steps
    with momentum, a fixed number, so reruns agree.
    """
    marked = use[sample.row]
    size = len(sample.hashes)
    positive = np.bincount(sample.column[marked & (y[sample.row] == 1)], minlength=size)
    negative = np.bincount(sample.column[marked & (y[sample.row] == 0)], minlength=size)
    n1, n0 = max(1, int(y[use].sum())), max(1, int((1 - y[use]).sum()))
    p1, p0 = positive / n1, negative / n0
    score = np.abs(p1 - p0) / np.sqrt((p1 + p0) / 2 * (1 / n1 + 1 / n0) + 1e-9)
    score[positive + negative < 2] = 0
    chosen = np.sort(np.argsort(-score, kind="stable")[:SELECTED])
    chosen = chosen[score[chosen] >= SURE]
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))
    inside = place[sample.column] >= 0
    row, col = sample.row[inside], place[sample.column[inside]]
    # a feature's log odds between the classes scale it, so that telling ones are learned first
    odds = np.log((positive[chosen] + 0.5) / (n1 + 1)) - np.log((negative[chosen] + 0.5) / (n0 + 1))
    value = odds[col]
    k = earlier.shape[1]
    w, e, b = np.zeros(len(chosen)), np.zeros(k), 0.0
    vw, ve, vb = np.zeros_like(w), np.zeros_like(e), 0.0
    weight = use * np.where(y == 1, 0.5 / n1, 0.5 / n0)
    logit = lambda: np.bincount(row, weights=w[col] * value, minlength=sample.n) + earlier @ e + b
    for _ in range(STEPS):
        error = (sigmoid(logit()) - y) * weight
        gw = np.bincount(col, weights=error[row] * value, minlength=len(chosen)) + PENALTY * w
        vw = 0.9 * vw - RATE * gw
        ve = 0.9 * ve - 1.0 * (earlier.T @ error + 1e-4 * e)
        vb = 0.9 * vb - 1.0 * error.sum()
        w, e, b = w + vw, e + ve, b + vb
    w = w * odds
    return Linear(sample.hashes[chosen], w, float(b), e), sigmoid(logit())


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, fold: np.ndarray, categories: list[str]) -> Chain:
    """labels: a row per document, a column per category; fold: of each row. Without rows or with one class only the bias decides."""
    chain, sample = Chain(categories), Sample(rows)
    everything = np.ones(sample.n, bool)
    earlier = np.zeros((sample.n, 0))
    for j in range(len(categories)):
        y = labels[:, j].astype(float)
        model, _ = fit(sample, y, earlier, everything)
        chain.models.append(model)
        if j + 1 < len(categories):
            out = np.zeros(sample.n)
            for f in range(FOLDS):
                out[fold == f] = fit(sample, y, earlier, fold != f)[1][fold == f]
            earlier = np.column_stack([earlier, out])
    return chain


def selected(features: DataFrame, names: list[str]) -> np.ndarray:
    """Sorted hashes of the features that some model of the chain selects: of each category over all rows, and of all but the last over the rows outside each fold.

    features: (fold, one column per category, features), a row per labelled document. The scores are those of ``fit``.
    """
    classes = [(name, y, f) for name in names for y in (1, 0) for f in range(FOLDS)]
    column = {c: f"n{i}" for i, c in enumerate(classes)}
    number = lambda c: F.sum(F.when((F.col(c[0]) == c[1]) & (F.col("fold") == c[2]), 1).otherwise(0)).alias(column[c])
    totals = features.agg(*map(number, classes)).first()
    counts = materialize(features.select("fold", *names, F.explode("features").alias("feature")).groupBy("feature").agg(*map(number, classes)), "counts")
    found = []
    for j, name in enumerate(names):
        for left_out in [None, *range(FOLDS)] if j + 1 < len(names) else [None]:
            used = [f for f in range(FOLDS) if f != left_out]
            n1, n0 = (max(1, sum(totals[column[name, y, f]] or 0 for f in used)) for y in (1, 0))
            with1, with0 = (reduce(lambda a, b: a + b, [F.col(column[name, y, f]) for f in used]) for y in (1, 0))
            p1, p0 = with1 / n1, with0 / n0
            score = F.abs(p1 - p0) / F.sqrt((p1 + p0) / 2 * (1 / n1 + 1 / n0) + 1e-9)
            # a hair below fit's bound, as sums may differ in the last digit
            sure = counts.where(with1 + with0 >= 2).select("feature", score.alias("score")).where(F.col("score") >= SURE - 1e-6)
            found.append(np.array([r[0] for r in sure.orderBy(F.desc("score"), "feature").limit(SELECTED).collect()], np.int64))
    released(counts)
    return np.unique(np.concatenate([np.zeros(0, np.int64), *found]))


def train(docs: DataFrame, labels: DataFrame, categories: list[tuple[str, str]]) -> Chain:
    """Fits the chain. categories: (name, SQL condition over labels), in the order of the chain.

    Labelled rows with a null in a condition or without a document are left out; of repeated ids the
    row counts that is greatest in the order of its categories, and of several documents of an id the one with the least
    text. No labelled row: all probabilities are 0.
    """
    names = [n for n, _ in categories]
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.expr(f"cast({c} as int)").alias(n) for n, c in categories]).dropna()
    marks = marks.groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names])
    last = names[-1]
    # each class of the last category gets half of the bound; TakeOrdered, so that no task sorts all labels
    picked = [marks.where(F.col(last) == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS // 2) for v in (1, 0)]
    picked = picked[0].union(picked[1]).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int"))

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = [np.unique(np.array([h for w in text_words(t) for h in word_features(w)], np.int64)) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), *[batch.column(i) for i in range(2, batch.num_columns)], pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "fold", *names, "features"])

    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    sample = sample.groupBy("doc_id", "fold", *names).agg(F.min("text").alias("text")).select("doc_id", "text", "fold", *names)
    schema = "doc_id long, fold int, " + ", ".join(f"{n} int" for n in names)
    features = materialize(sample.mapInArrow(by_batch(hashed), schema + ", features array<long>"), "features")
    chosen = selected(features, names)

    def kept(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = [x[np.isin(x, chosen, assume_unique=True)].tobytes() for x in (np.asarray(v.values, np.int64) for v in batch.column(batch.num_columns - 1))]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lists, pa.binary())], batch.schema.names)

    rows = sorted(features.mapInArrow(by_batch(kept), schema + ", features binary").collect(), key=lambda r: r["doc_id"])
    released(features)
    if not rows:
        empty = np.zeros(0, np.int64)
        return Chain(names, [Linear(empty, np.zeros(0), -40.0, np.zeros(j)) for j in range(len(names))])
    values = np.array([[r[n] for n in names] for r in rows], int)
    return fit_chain([np.frombuffer(r["features"], np.int64) for r in rows], values, np.array([r["fold"] for r in rows]), names)


class Scorer:
    """Probabilities of a chain for texts; a word's weights are looked up once."""

    def __init__(self, chain: Chain) -> None:
        self.chain = chain
        self.hashes = np.unique(np.concatenate([m.hashes for m in chain.models]))
        self.weights = np.zeros((len(self.hashes), len(chain.models)))
        for j, m in enumerate(chain.models):
            at = np.searchsorted(self.hashes, m.hashes)
            self.weights[at, j] = m.weights
        self.place = {int(h): i for i, h in enumerate(self.hashes)}
        self.known: dict[str, tuple[int, ...]] = {}

    def features(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 250_000:
                self.known.clear()
            found = self.known[word] = tuple(self.place[h] for h in word_features(word) if h in self.place)
        return found

    def score(self, text: str | None) -> list[float]:
        at = list({i for w in text_words(text) for i in self.features(w)})
        sums = self.weights[at].sum(axis=0)
        out: list[float] = []
        for j, m in enumerate(self.chain.models):
            x = sums[j] + m.bias + float(np.dot(m.earlier, out))
            out.append(float(sigmoid(np.array(x))))
        return out


#: The chain's categories over the label table: what is poor is told first and helps to tell what is toxic.
CATEGORIES = [("low_quality", "quality = 0"), ("toxic", "toxic = 1")]


def _scored(chain: Chain):
    """The struct of a text's probabilities as a function of a column."""
    names = chain.categories
    scorers: list[Scorer] = []

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def scored(text: pd.Series) -> pd.DataFrame:
        if not scorers:
            scorers.append(Scorer(chain))
        return pd.DataFrame([scorers[0].score(t) for t in text], columns=names, dtype=float)

    return scored


def toxicity(docs: DataFrame, labels: DataFrame, categories: list[tuple[str, str]] = CATEGORIES) -> DataFrame:
    """``docs`` with a column toxicity, a struct of each category's probability.

    Trained on those of ``docs`` that ``labels`` covers. Null and empty texts have no features, so the
    bias decides. Repeated rows are scored alike; null doc_ids are scored but not learned from. Very long texts are
    learned from and scored whole. A column of that name in the input is replaced, others stay. No documents: no rows.
    """
    chain = train(docs, labels, categories)
    return docs.drop("toxicity").withColumn("toxicity", _scored(chain)(F.col("text").cast("string")))


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose probability of the last category is below the threshold, with all their columns, of whatever name.

    Nulls, repeated rows, empty and very long texts as in ``toxicity``. No documents: no rows; no labels: all documents.
    """
    chain = train(docs, labels, CATEGORIES)
    return docs.where(_scored(chain)(F.col("text").cast("string")).getField(CATEGORIES[-1][0]) < threshold)
