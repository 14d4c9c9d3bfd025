"""Operator 5: toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

The features: densities of a lexicon learned from the training rows (whole words and word beginnings, plain and after
undoing obfuscation), closeness of lexicon words to second-person words, shares of capitals, punctuation and obfuscated
words, and length. The lexicon that makes the features of a training row is learned from the other half of the sample,
so the trees see densities as honest as those of new texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm import ngrams as ng
from sylva.llm.boosting import Boosted, Isotonic, boost, isotonic
from sylva.llm.common import held_out, map_batches, prepare, texts_of
from sylva.llm.sampling import training_rows

#: Bound of the training sample, in documents of each class.
PER_CLASS = 4000
THRESHOLD = 0.3
#: Log odds from which a unit belongs to the lexicon, and how much leaves shrink.
LEAST_ODDS, RIDGE = 1.5, 2.0
PREFIXES = (4, 5, 6)
NEAR = 6
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine sie ihr ihre usted ustedes ti tus su sus vosotros".split()
#: Signs that stand for letters in disguised words.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}

_letters = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_unmasked = bytes(ord(LEET[chr(b)]) if chr(b) in LEET else _letters[b] for b in range(256))
_upper, _alpha, _digit, _loud, _sign = (np.array([f(chr(b)) if b < 128 else False for b in range(256)]) for f in (str.isupper, str.isalpha, str.isdigit, "!?".__contains__, "#$%&*@^~|_+=<>{}[]\\".__contains__))
_masked = re.compile(rb"(?<=[A-Za-z])[0134578@$!*.\-_+|]{1,2}(?=[A-Za-z])")
_spaced = re.compile(rb"(?<![A-Za-z])(?:[A-Za-z][ .\-_*]){2,}[A-Za-z](?![A-Za-z])")
_joiners = re.compile(rb"[ .\-_*|]")


def _spans(raw: bytes, table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.frombuffer(b" " + raw.translate(table) + b" ", np.uint8)
    return a, *ng.word_spans(a)


def units(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a text, and per word those of its beginnings (0 where the word is shorter)."""
    a, s, e = _spans(raw, _letters)
    words = ng.span_hashes(a, s, e)
    heads = np.zeros((len(PREFIXES), len(s)), np.uint64)
    for k, n in enumerate(PREFIXES):
        long = e - s > n
        heads[k, long] = ng.span_hashes(a, s[long], s[long] + n) + np.uint64(n)
    return words, heads


_second = np.sort(ng.words(ng.as_bytes(" ".join(SECOND_PERSON))))


@dataclass
class Lexicon:
    """Sorted hashes of words and word beginnings, with the log odds of the toxic class given each."""

    keys: np.ndarray
    odds: np.ndarray

    def __post_init__(self):
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """The log odds of each hash; 0 for those not in the lexicon."""
        out = np.zeros(h.shape)
        maybe = self.gate[(h >> np.uint64(48)).astype(np.int64)]
        if maybe.any():
            some = h[maybe]
            at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[at] == some, self.odds[at], 0)
        return out


def learn_lexicon(texts: list[str], y: np.ndarray, least: float = LEAST_ODDS) -> Lexicon:
    """Units of toxic texts: smoothed log odds of at least `least`, and more support than chance gives any of so many units.

    Support is the log likelihood ratio of a unit's share of toxic texts against the share among all texts. How many units
    there can be follows from the bounded sample.
    """
    found: list[list[np.ndarray]] = [[], []]
    for t, v in zip(texts, y, strict=True):
        words, heads = units(t.encode("utf-8", "replace"))
        found[int(v)].append(np.unique(np.concatenate([words, heads.ravel()])))
    none = [np.zeros(0, np.uint64)]
    toxic, n = np.unique(np.concatenate(found[1] or none), return_counts=True)
    toxic, n = toxic[(n >= 3) & (toxic > 0)], n[(n >= 3) & (toxic > 0)]
    clean, m = np.unique(np.concatenate(found[0] or none), return_counts=True)
    at = np.minimum(np.searchsorted(clean, toxic), max(0, len(clean) - 1))
    other = np.where(clean[at] == toxic, m[at], 0) if len(clean) else np.zeros(len(toxic))
    odds = np.log((n + 0.5) / (len(found[1]) + 1)) - np.log((other + 0.5) / (len(found[0]) + 1))
    share, p = len(found[1]) / (len(found[0]) + len(found[1])), n / (n + other)
    support = n * np.log(p / share) + np.where(other > 0, other * np.log(np.maximum(1 - p, 1e-12) / max(1 - share, 1e-12)), 0)
    keep = np.flatnonzero((odds >= least) & (support >= 1 + np.log(max(1, len(clean) + len(toxic)))))
    return Lexicon(toxic[keep], odds[keep])


def features(text: str, lexicon: Lexicon) -> np.ndarray:
    raw = text.encode("utf-8", "replace")
    a = np.frombuffer(raw, np.uint8)
    words, heads = units(raw)
    masked, hidden = len(_masked.findall(raw)), 0
    if masked or _spaced.search(raw):  # what counts below is the text without its disguise
        shown = int((lexicon(words) > 0).sum())
        words, heads = units(_spaced.sub(lambda m: _joiners.sub(b"", m[0]), _masked.sub(lambda m: m[0].translate(_unmasked).replace(b" ", b""), raw)))
        hidden = int((lexicon(words) > 0).sum()) - shown
    n = max(1, len(words))
    plain, head = lexicon(words), lexicon(heads).max(0) if len(words) else np.zeros(0)
    hits = np.flatnonzero(plain)
    near = 0
    if len(hits):
        you = np.flatnonzero(_second[np.minimum(np.searchsorted(_second, words), len(_second) - 1)] == words)
        if len(you):
            right = you[np.minimum(np.searchsorted(you, hits), len(you) - 1)]
            left = you[np.maximum(np.searchsorted(you, hits) - 1, 0)]
            near = int((np.minimum(abs(right - hits), abs(left - hits)) <= NEAR).sum())
    both = np.maximum(plain, head)
    size, letters = max(1, len(a)), max(1, int(_alpha[a].sum()))
    return np.array([
        len(hits) / n, plain.sum() / n, float(plain.max(initial=0)), min(len(hits), 20), np.sort(plain)[-3:].sum(),
        (head > 0).sum() / n, head.sum() / n, float(head.max(initial=0)), np.sort(both)[-3:].sum(), both.sum() / n, min(int((both > 3).sum()), 20), (both > 3).sum() / n,
        hidden / n, min(max(hidden, 0), 10), near / n, min(near, 10),
        _upper[a].sum() / letters, _loud[a].sum() / size, _sign[a].sum() / size, _digit[a].sum() / size, masked / n, np.log1p(len(words)),
    ])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boosted
    calibration: Isotonic

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return np.clip(self.calibration(self.trees(np.stack([features(t, self.lexicon) for t in texts]))), 0, 1)


def train(rows: list[tuple[str, int]], counts: dict[int, int], seed: int = 3, least: float = LEAST_ODDS, ridge: float = RIDGE, **settings) -> Model:
    """Fit on (text, 0 or 1); class weights restore the shares among all training rows.

    With fewer than four rows of either class every score is the share of class 1 (0 without rows). `least` goes to the
    lexicon and other settings to boost(); choose() compares them over training rows alone (the README says which were so chosen).
    """
    texts, y = [t for t, _ in rows], np.array([int(v) for _, v in rows])
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    if min(int(y.sum()), len(y) - int(y.sum())) < 4:
        share = n1 / (n0 + n1) if n0 + n1 else 0.0
        return Model(Lexicon(np.zeros(1, np.uint64), np.zeros(1)), Boosted(0.0), Isotonic(np.zeros(0), np.full(1, share), 0.0))
    weight = np.where(y == 1, n1 / y.sum(), n0 / (len(y) - y.sum()))
    weight = weight / weight.mean()
    rng, half = np.random.default_rng(seed), np.zeros(len(y), np.int64)
    for v in (0, 1):
        own = rng.permutation(np.flatnonzero(y == v))
        half[own[::2]] = 1
    x = np.zeros((len(y), len(features("", Lexicon(np.zeros(1, np.uint64), np.zeros(1))))))
    for k in (0, 1):
        lexicon = learn_lexicon([t for t, f in zip(texts, half, strict=True) if f != k], y[half != k], least)
        for i in np.flatnonzero(half == k):
            x[i] = features(texts[i], lexicon)
    apart = np.zeros(len(y))
    for k in (0, 1):
        apart[half == k] = boost(x[half != k], y[half != k], weight[half != k], ridge=ridge, **settings)(x[half == k])
    return Model(learn_lexicon(texts, y, least), boost(x, y, weight, ridge=ridge, **settings), isotonic(apart, y, weight))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Train on a sample bounded by per_class documents of each class."""
    return train(*training_rows(docs, labels, "toxic", per_class, "toxicity"))


def choose(rows: list[tuple[str, int]], grid: list[dict], folds: int = 3) -> list[tuple[float, dict]]:
    """The log loss of each setting over folds of training rows, best first: what settings are chosen by.

    Rows are training_rows(), so nothing of the held-out fold is seen; the folds are by the rows' place.
    """
    out = []
    for settings in grid:
        loss = 0.0
        for k in range(folds):
            own, other = rows[k::folds], [r for j in range(folds) if j != k for r in rows[j::folds]]
            ones = sum(int(v) for _, v in other)
            p = np.clip(train(other, {1: ones, 0: len(other) - ones}, **settings).score([t for t, _ in own]), 1e-3, 1 - 1e-3)
            y = np.array([int(v) for _, v in own])
            loss -= float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())
        out.append((loss / max(1, len(rows)), settings))
    return sorted(out, key=lambda x: x[0])


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
        s = shared.value.score(texts_of(batch))
        arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "score", "predicted"])

    slim = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_batches(slim, run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels))
