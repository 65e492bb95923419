"""Quality classifier: hashed word n-grams, logistic regression by FTRL-proximal.

Features are words, single punctuation marks and their bigrams, hashed into SIZE slots,
weighted log(1 + count) and scaled to length one.  A bigram of a token with itself has
one slot of its own.  Training runs over a bounded sample (TRAIN_ROWS labelled documents);
scoring is a sparse dot product per document, without any shuffle.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm.common import bounded_batches, held_out, utf8_list
from countloom.llm.samples import labelled

SIZE = 1 << 18
#: Bound of the training sample.
TRAIN_ROWS = 6_000
EPOCHS = 6
TOKENS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]")
SAME = 1  # slot of a token after itself


def features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text; slot 0 is the constant."""
    tokens = TOKENS.findall(raw)
    if not tokens:
        return np.zeros(1, np.int32), np.ones(1, np.float32)
    one = np.fromiter(map(crc32, tokens), np.uint64, len(tokens))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(40)
    mask = np.uint64(SIZE - 1)
    slots = np.concatenate([one & mask, np.where(one[:-1] == one[1:], np.uint64(SAME), two & mask)]).astype(np.int64)
    slots[(slots == 0)] = 2
    if len(slots) < SIZE // 8:
        slots, counts = np.unique(slots, return_counts=True)
    else:
        counts = np.bincount(slots, minlength=SIZE)
        slots = np.flatnonzero(counts)
        counts = counts[slots]
    values = np.log1p(counts)
    values /= np.sqrt((values * values).sum())
    return np.concatenate([[0], slots]).astype(np.int32), np.concatenate([[1.0], values]).astype(np.float32)


class Ftrl:
    """Follow the regularised leader, per coordinate, for the logistic loss."""

    def __init__(self, size: int = SIZE, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.02):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, slots=slice(None)) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, slots: np.ndarray, values: np.ndarray, y: int) -> None:
        w = self.weights(slots)
        p = 1 / (1 + np.exp(-np.clip(w @ values, -35, 35)))
        g = (p - y) * values
        sigma = (np.sqrt(self.n[slots] + g * g) - np.sqrt(self.n[slots])) / self.alpha
        self.z[slots] += g - sigma * w
        self.n[slots] += g * g


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights by slot; without examples all zero (every score 0.5)."""
    model = Ftrl()
    for _ in range(epochs):
        for slots, values, y in examples:
            model.learn(slots, values, y)
    return model.weights().astype(np.float32)


def _extract(batches):
    for batch in batches:
        found = [features(t or b"") for t in utf8_list(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))],
            ["doc_id", "y", "slots", "vals"],
        )


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learned from at most `rows` labelled documents outside the evaluation fold."""
    sample = labelled(docs, labels, label, rows).mapInArrow(_extract, "doc_id bigint, y int, slots array<int>, vals array<float>")
    got = sample.toArrow()
    order = np.argsort([crc32(str(i).encode()) for i in got.column("doc_id").to_pylist()], kind="stable")
    y, slots, values = got.column("y").to_pylist(), got.column("slots"), got.column("vals")
    return fit([(slots[i].values.to_numpy(), values[i].values.to_numpy(), y[i]) for i in order.tolist()])


def _score(bc, batches):
    weights = bc.value
    for batch in batches:
        sums = np.zeros(batch.num_rows)
        for i, t in enumerate(utf8_list(batch.column(1))):
            slots, values = features(t or b"")
            sums[i] = weights[slots] @ values
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))))], ["doc_id", "score"])


def score(docs: DataFrame, weights: np.ndarray, *, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null and empty texts have the constant feature only and get its score; very long texts are scored whole.  Repeated
    rows get equal scores; other columns, whatever their names, are not read; without training documents every score
    is 0.5; an empty table has no rows.  Ties: a score of the threshold is predicted 1, equal scores are no order.
    """
    bounded_batches(docs.sparkSession)
    bc = docs.sparkSession.sparkContext.broadcast(weights)  # SIZE weights, whatever the input
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    scored = rows.mapInArrow(lambda batches: _score(bc, batches), "doc_id bigint, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
