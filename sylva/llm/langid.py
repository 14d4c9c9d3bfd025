"""Operator 7: language identification by error-correcting output codes.

Each language has a codeword of signs. For each bit a binary classifier over hashed byte n-grams predicts the sign;
decoding sums, over the bits, each bit's training reliability times its logistic loss against a codeword, and the
codeword of least loss names the language. A narrow lead over the second marks the text as ambiguous.
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

BITS = 13
SIZES = (1, 2, 3)
#: Bound of the training sample, in documents of each language.
PER_LANGUAGE = 400
#: Below this score a text is ambiguous.
AMBIGUOUS = 0.5
UNKNOWN = "und"


def features(text: str) -> np.ndarray:
    """Shares of the n-gram buckets of a text, case folded for ASCII."""
    raw = ng.as_bytes(text.lower())
    counts = np.zeros(1 << BITS, np.float32)
    for n in SIZES:
        if len(g := ng.ngrams(raw, n, BITS)):
            counts += np.bincount(g, minlength=1 << BITS).astype(np.float32) / len(g)
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def codewords(k: int, seed: int = 11) -> np.ndarray:
    """k sign rows that differ from one another in many bits, with both signs in every column where k > 1."""
    if k == 1:
        return np.ones((1, 1))
    if k <= 5:  # all splits of the languages into two parts
        masks = np.arange(1, 1 << (k - 1))
        return np.array([[1 if i and m >> (i - 1) & 1 else -1 for m in masks] for i in range(k)])
    rng, best, far = np.random.default_rng(seed), None, -1
    width = 8 + 5 * int(np.ceil(np.log2(k)))
    for _ in range(50):
        code = rng.choice([-1, 1], (k, width))
        code[:, np.abs(code.sum(0)) == k] *= np.where(np.arange(k) % 2, 1, -1)[:, None]
        apart = (width - code @ code.T + 2 * width * np.eye(k)).min()
        if apart > far:
            best, far = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    reliability: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the decoder's confidence in it, 0 to 1."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        margin = features(text) @ self.weights + self.bias
        loss = np.logaddexp(0, -self.code * margin) @ self.reliability
        p = np.exp(loss.min() - loss)
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def train(rows: list[tuple[str, str]], epochs: int = 12, rate: float = 0.5, seed: int = 5) -> Model:
    """Fit one logistic classifier per bit by stochastic gradient descent; without rows every text is `und`."""
    rows = [(t, y) for t, y in rows if has_letter(t)]
    languages = sorted({y for _, y in rows})
    code = codewords(len(languages)) if languages else np.zeros((0, 1))
    width = code.shape[1]
    if not rows:
        return Model([], code, np.zeros((1 << BITS, width), np.float32), np.zeros(width), np.ones(width))
    x = np.stack([(1024 * features(t)).astype(np.float16) for t, _ in rows])  # half precision: the sample stays in the driver
    parts = np.array_split(np.arange(len(rows)), max(1, len(rows) // 256))
    mean = sum(x[p].sum(0, dtype=np.float32) for p in parts) / len(rows)
    scale = 1 / (np.sqrt(sum(((x[p] - mean) ** 2).sum(0, dtype=np.float32) for p in parts) / len(rows)) + 1)
    y = code[[languages.index(v) for _, v in rows]].astype(np.float32)
    rng, w, b = np.random.default_rng(seed), np.zeros((1 << BITS, width), np.float32), np.zeros(width, np.float32)
    for epoch in range(epochs):
        for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 32)):
            xb = (x[batch] - mean) * scale
            z = y[batch] * (xb @ w + b)
            g = -y[batch] / (1 + np.exp(np.clip(z, -30, 30)))
            step = rate * (1 - epoch / epochs) / len(batch)
            w -= (step / 30) * (xb.T @ g) + 1e-5 * w
            b -= step * g.sum(0)
    right = sum(((((x[p] - mean) * scale) @ w + b) * y[p] > 0).sum(0) for p in parts) / len(rows)
    reliability = np.log((right + 0.01) / (1.01 - right)).clip(0.1, 5)
    w = w * scale[:, None]
    return Model(languages, code, (1024 * w).astype(np.float32), b - mean @ w, reliability / reliability.mean())


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Train on a sample bounded by per_language documents of each language value, and over all of them (sampling.py)."""
    return train(training_rows(docs, docs.select("doc_id", "lang"), "lang", per_language, "language")[0])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for each row of docs (doc_id, text, ...).

    Null, empty or letterless text is `und` with score 0. Repeated rows have rows of their own with one answer; a null id stays
    null and is not held out; of codewords that are equally near the first language in order wins, and its score is at most
    one half. Texts of any length are read whole; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [shared.value.predict(t) for t in texts_of(batch)]
        arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[1] < AMBIGUOUS for g in got], pa.bool_())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    slim = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_batches(slim, run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def filter_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose language is found and not ambiguous, with all their columns, whatever their names.

    Null, empty and letterless texts go; repeated rows go or stay together; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = (shared.value.predict(t) for t in texts_of(batch))
        return batch.filter(pa.array([lang != UNKNOWN and score >= AMBIGUOUS for lang, score in got], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
