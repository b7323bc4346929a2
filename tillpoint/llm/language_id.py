"""Operator 3: language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of code points of the lower-cased text, hashed to BUCKETS, with
logarithmic term frequency, inverse document frequency and unit length. Document frequencies are counted over
all training documents. The weights are fitted by follow-the-regularised-leader (proximal, elastic net: l1
makes them sparse, l2 keeps them small) on a bounded stable sample (SAMPLE_DOCS documents, shared out evenly between the
languages), and one temperature is fitted on a fifth of the sample kept out of that.

Null text, or one without a letter: `und` with score 0; without any training document every text is `und`.
Null and repeated doc_ids keep a row each; other columns are ignored; an empty table gives no rows.
"""
from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.common import crc_mod, small_batches, stable_sample, text_chunks

BITS = 15
BUCKETS = 1 << BITS
SAMPLE_DOCS, EPOCHS = 4000, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01

_LETTER = re.compile(r"[^\W\d_]")


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed 1- to 3-grams of a text."""
    c = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    one = c * np.uint32(2654435761)
    grams = [one]
    if len(c) > 1:
        two = (one[:-1] ^ (one[1:] >> np.uint32(7))) * np.uint32(2246822519) + np.uint32(1)
        grams.append(two)
        if len(c) > 2:
            grams.append((two[:-1] ^ (one[2:] >> np.uint32(11))) * np.uint32(3266489917) + np.uint32(2))
    return np.bincount(np.concatenate(grams) >> np.uint32(32 - BITS), minlength=BUCKETS)


def tf_idf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values), the values of unit length."""
    counts = ngram_counts(text)
    at = np.flatnonzero(counts)
    values = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt(values @ values)
    return at, values / norm if norm > 0 else values


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], classes: np.ndarray, n_classes: int, epochs: int = EPOCHS,
             alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, seed: int = 7) -> np.ndarray:
    """Weights (BUCKETS, classes) by FTRL-proximal with per-coordinate rates."""
    z, n = np.zeros((BUCKETS, n_classes)), np.zeros((BUCKETS, n_classes))

    def weights(at) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            p = softmax(x @ w)
            p[classes[i]] -= 1
            g = x[:, None] * p[None, :]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(slice(None))


def fit_temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """Temperature with the least negative log-likelihood, by golden-section search on its logarithm."""
    if not len(logits):
        return 1.0

    def loss(log_t: float) -> float:
        return -np.log(softmax(logits / np.exp(log_t))[np.arange(len(classes)), classes] + 1e-12).mean()

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class Model:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.classes or not _LETTER.search(text):
            return "und", 0.0
        at, x = tf_idf(text, self.idf)
        p = softmax((x @ self.weights[at]) / self.temperature)
        best = int(p.argmax())
        return self.classes[best], float(p[best])


def inverse_frequencies(train: DataFrame) -> np.ndarray:
    """Smoothed idf of every bucket over all rows of `train` (texts); at most BUCKETS sums reach the driver."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(BUCKETS + 1, np.int64)
        for _, texts in text_chunks(batches, "text"):
            for t in texts:
                df[:BUCKETS] += ngram_counts(t) > 0
                n += 1
        df[BUCKETS] = n  # the last bucket counts the documents
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], ["bucket", "df"])

    df = np.zeros(BUCKETS + 1)
    for r in train.select("text").mapInArrow(tally, "bucket int, df bigint").groupBy("bucket").agg(F.sum("df").alias("df")).collect():
        df[r.bucket] = r.df
    return np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1


def train_language_model(docs: DataFrame, is_training: Column, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Model from the text and non-null lang of the rows where `is_training` holds."""
    small_batches(docs.sparkSession)
    train = docs.where(is_training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    classes = sorted(r.lang for r in train.select("lang").distinct().collect())
    if not classes:
        return Model([], np.ones(BUCKETS), np.zeros((BUCKETS, 0)), 1.0)
    idf = inverse_frequencies(train)
    sample = stable_sample(train.select("doc_id", "text", "lang"), F.col("doc_id"), max(50, sample_docs // len(classes)), by="lang")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, wanted = [], []
        place = {c: i for i, c in enumerate(classes)}
        for batch, texts in text_chunks(batches, "text"):
            rows += [tf_idf(t, idf) for t in texts]
            wanted += [place[v] for v in batch.column("lang").to_pylist()]
        wanted = np.array(wanted, np.int64)
        held = np.arange(len(rows)) % 5 == 4
        inside = np.flatnonzero(~held)
        w = fit_ftrl([rows[i] for i in inside], wanted[inside], len(classes))
        logits = np.array([x @ w[at] for at, x in (rows[i] for i in np.flatnonzero(held))]).reshape(-1, len(classes))
        at = np.flatnonzero(np.abs(w).sum(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array([json.dumps(fit_temperature(logits, wanted[held]))]), pa.array([at.astype("<i4").tobytes()], pa.binary()),
             pa.array([w[at].astype("<f8").tobytes()], pa.binary())], ["temperature", "at", "w"])

    # the bounded sample alone is gathered: one task fits on it
    row = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", "text")).mapInArrow(fit, "temperature string, at binary, w binary").collect()[0]
    weights = np.zeros((BUCKETS, len(classes)))
    weights[np.frombuffer(row.at, "<i4")] = np.frombuffer(row.w, "<f8").reshape(-1, len(classes))
    return Model(classes, idf, weights, json.loads(row.temperature))


def identify_languages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, "text"):
            got = [shared.value.predict(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([g[0] for g in got], pa.string()),
                                              pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id bigint, lang_pred string, score double")


def held_out() -> Column:
    return crc_mod("doc_id", 5) == 0
