"""Operator 4: a quality classifier of supervised subword embeddings.

Each hashed character n-gram and each hashed word has a learned vector. A document is the average of its n-gram vectors,
plus the average of its word vectors, plus a vector for the share of words that repeat the word before; a softmax over
two classes follows. Everything is trained here by numpy stochastic gradient descent (Adagrad steps, one document each).
Scoring folds vectors and softmax weights into one number per bucket, which changes no score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm import ngrams as ng
from sylva.llm.common import held_out, map_batches, prepare, texts_of
from sylva.llm.sampling import training_rows

BITS = 16
SIZES = (3, 4, 5)
ROWS = 2 * (1 << BITS) + 1
#: Bound of the training sample, in documents of each class.
PER_CLASS = 1200
THRESHOLD = 0.7


def features(text: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets of the n-grams, buckets of the words, and the share of words that repeat the word before them."""
    raw = ng.as_bytes(text)
    grams = np.concatenate([ng.ngrams(raw, n, BITS) for n in SIZES])
    words = ng.words(raw)
    again = float((words[1:] == words[:-1]).mean()) if len(words) > 1 else 0.0
    return grams, (words >> np.uint64(64 - BITS)).astype(np.int64) + (1 << BITS), again


def _sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    grams, words, again = features(text)
    rows, counts = np.unique(grams, return_counts=True)
    wrows, wcounts = np.unique(words, return_counts=True)
    idx = np.concatenate([rows.astype(np.int64), wrows, [ROWS - 1]])
    return idx.astype(np.int32), np.concatenate([counts / max(1, len(grams)), wcounts / max(1, len(words)), [again]]).astype(np.float16)


@dataclass
class Model:
    """Per bucket, what it adds to the logit of class 1 over class 0; and the constant."""

    table: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        grams, words, again = features(text)
        z = self.bias + again * float(self.table[-1])
        if len(grams):
            z += float(self.table[grams].mean())
        if len(words):
            z += float(self.table[words].mean())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(rows: list[tuple[str, int]], counts: dict[int, int], dim: int = 8, epochs: int = 6, rate: float = 0.3, seed: int = 7) -> Model:
    """Fit on (text, 0 or 1); the class shares among all training rows correct those of a balanced sample.

    With no rows of one class, every score is the share of class 1 (0.5 without any rows).
    """
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    if not n1 or not n0 or len({y for _, y in rows}) < 2:
        p = np.clip(n1 / (n0 + n1), 1e-3, 1 - 1e-3) if n0 + n1 else 0.5
        return Model(np.zeros(ROWS, np.float32), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    docs = [_sparse(t) for t, _ in rows]
    y = np.array([int(v) for _, v in rows])
    vectors = rng.uniform(-1 / dim, 1 / dim, (ROWS, dim)).astype(np.float32)
    weights, bias = rng.normal(0, 0.1, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen, wseen, bseen = np.full(ROWS, 1e-3, np.float32), np.float32(1e-2), np.float32(1e-2)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(docs)):
            idx, share = docs[i][0], docs[i][1].astype(np.float32)
            hidden = share @ vectors[idx]
            z = hidden @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = weights @ p
            grad = np.outer(hidden, p)
            wseen += float((grad**2).mean())
            bseen += float((p**2).mean())
            weights -= step * 0.3 * grad / np.sqrt(wseen)
            bias -= step * 0.3 * p / np.sqrt(bseen)
            row_grad = share * np.float32(np.sqrt((back**2).mean()))
            seen[idx] += row_grad**2
            vectors[idx] -= (step * share / np.sqrt(seen[idx]))[:, None] * back[None, :]
    table = vectors @ (weights[:, 1] - weights[:, 0])
    m1 = int(y.sum())
    shift = np.log((n1 / n0) / (m1 / (len(y) - m1)))
    return Model(table.astype(np.float32), float(bias[1] - bias[0] + shift))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Train on a sample bounded by per_class documents of each class."""
    return train(*training_rows(docs, labels, "quality", per_class, "quality"))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text, ...).

    Null text counts as empty, which has a score as any text has. Repeated rows have rows of their own with one score; a null
    id stays null and is not held out; a score equal to the threshold is predicted 1. Texts of any length are read whole;
    an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = [shared.value.score(t) for t in texts_of(batch)]
        arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "score", "predicted"])

    slim = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_batches(slim, run, "doc_id long, held_out boolean, score double, predicted int")


def filter_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns, whatever their names.

    Null text is scored as empty; repeated rows go or stay together, as do ties at the threshold, which stay; an empty table
    gives no rows.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([shared.value.score(t) >= threshold for t in texts_of(batch)], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels))
