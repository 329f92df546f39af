"""Operator 3: quality classifier, a regularised quadratic discriminant.

Each whole text becomes a vector of transformed statistics (log lengths and
smoothed log-odds of shares, so that the classes look more like Gaussians).
Labelled rows that are not held out give each class a mean and a covariance;
the covariance is shrunk towards its diagonal and a multiple of the identity.
The score is the logistic of the difference of the classes' log-densities plus
the log prior odds, from Mahalanobis distances by cached Cholesky factors.

All labelled rows are used: tasks add up moments, Spark sums them by class, and
the driver gets a fixed number of sums. Texts are read once and only their
statistics meet the labels. The text alone is scored;
labels, lang, source and doc_id are never features.

Null and empty texts have a score like any other (their statistics are the
smoothed zeros); a very long text is read whole, in time that grows as its
length. Labels other than 0 and 1 and null labels teach nothing; a
document with several labels counts once for each. Repeated documents
each get a row; an empty table gives no rows; other columns are ignored,
whatever they are called. With labels of fewer than two
classes the score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

THRESHOLD = 0.3
SHRINKAGE = 0.1
FLOOR = 0.1
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*@^~_=+<>/\\{}[]")] = True
_UPPER = slice(65, 91)
_LOWER = slice(97, 123)


def _odds(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)))


def features(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), len(data)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, high = int(count[_UPPER].sum()), int(count[_LOWER].sum()), int(count[128:].sum())
    solid = size - int(count[[32, 9, 10, 11, 12, 13]].sum())
    lowered = data.lower().split()
    kinds = len(set(lowered))
    same = sum(map(eq, lowered, lowered[1:]))
    short = sum(map((4).__gt__, map(len, words)))
    return [
        float(np.log(n + 1)),
        float(np.log((solid + 1) / (n + 1))),
        _odds(int(count[_SYMBOL].sum()), solid),
        _odds(int(count[33]), n),
        _odds(int(count[124]), n),
        _odds(upper, upper + lower + high),
        _odds(int(count[48:58].sum()), solid),
        _odds(same, max(n - 1, 0)),
        float(np.log((kinds + 1) / (n + 1) ** 0.8)),
        _odds(short, n),
        _odds(int(count[46]), n),
        _odds(int(count[44]), n),
        _odds(int(count[10]), n),
        float(np.log((high + 1) / (solid + 1))),
    ]


N = len(features(""))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x) with the features of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N)


class Model:
    def __init__(self, total: np.ndarray, shrinkage: float = SHRINKAGE, floor: float = FLOOR):
        n = total[:, 0]
        self.constant = None
        if (n < 2).any():
            self.constant = float(n[1] / n.sum()) if n.sum() else 0.5
            return
        self.mean = total[:, 1 : 1 + N] / n[:, None]
        self.inverse, self.base = [], []
        for c in (0, 1):
            cov = total[c, 1 + N :].reshape(N, N) / n[c] - np.outer(self.mean[c], self.mean[c])
            diagonal = np.maximum(np.diag(cov), 0)
            cov = (1 - shrinkage) * cov + shrinkage * np.diag(diagonal) + floor * np.eye(N)
            factor = np.linalg.cholesky(cov)
            self.inverse.append(np.linalg.inv(factor))
            self.base.append(np.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = [self.base[c] - 0.5 * (((x - self.mean[c]) @ self.inverse[c].T) ** 2).sum(axis=1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def _moments(pairs: DataFrame) -> DataFrame:
    """For (label, x): by class the sums of 1, x and the products of x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + N + N * N))
        for batch in batches:
            label, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for c in (0, 1):
                own = x[label == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["label", "m"])

    sums = pairs.mapInArrow(run, "label int, m array<double>")
    return sums.select("label", F.posexplode("m").alias("k", "v")).groupBy("label", "k").agg(F.sum("v").alias("v"))


def learn(stats: DataFrame, labels: DataFrame, label: str = "quality", **options) -> Model:
    """Fit on every labelled row that is not held out."""
    known = labels.filter(~held_out() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    total = np.zeros((2, 1 + N + N * N))
    for row in _moments(stats.join(known, "doc_id").select("label", "x")).collect():  # 2 (1 + N + N * N) rows
        total[row.label, row.k] = row.v
    return Model(total, **options)


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): the probability of label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], ["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column("text")]).reshape(-1, N)
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
