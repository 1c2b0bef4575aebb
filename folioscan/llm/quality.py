"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Training reads at most ``most`` labelled documents (a documented bound, drawn
by hash), whole texts, on the driver. Scoring is a sparse dot product for
each document; the weights that go to the executors have a fixed size.

Defined results
    null or empty text      the score of the bias alone
    very long texts         scored whole, features scaled to length 1
    a tie at ``threshold``  predicted 1
    null doc_id             scored, not held out; never a training row
    no labels               score 0.5 for all
    repeated rows           a score for each; one of them is trained on
    empty table             an empty result
    extra columns           ignored
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, release

from .textmodel import Ftrl, collected, labelled, ngram_features, sigmoid


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    bits: int

    def score(self, text: bytes | None) -> float:
        index, value = ngram_features(text, self.bits)
        return float(sigmoid(self.weights[index] @ value + self.bias))


def fit(pairs, labels, bits: int = 20, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, seed: int = 9) -> Model:
    """Trains on (index, value) pairs and 0/1 labels; the bias is the last coordinate."""
    learner = Ftrl((1 << bits) + 1, alpha, beta, l1, l2)
    bias = np.array([1 << bits])
    order = np.random.default_rng(seed)
    for _ in range(epochs if len(labels) else 0):
        for i in order.permutation(len(labels)):
            index, value = pairs[i]
            index, value = np.concatenate((index, bias)), np.append(value, 1.0)
            weights = learner.at(index)
            gradient = (sigmoid(weights @ value) - labels[i]) * value
            learner.update(index, gradient, weights)
    whole = learner.weights()
    return Model(whole[:-1], float(whole[-1]), bits)


def train(docs: DataFrame, labels: DataFrame, most: int = 8000, keep=None, bits: int = 20, **how) -> Model:
    pairs, marks = collected(labelled(docs, labels, "quality", most, keep), lambda text: ngram_features(text, bits))
    model = fit(pairs, marks, bits, **how)
    del pairs
    release()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text)."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([model.score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(freeing(run), "doc_id long, score double")


def held_out(column: str = "doc_id"):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4)) == 2


def graded(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted); labels of held-out documents are never read."""
    out = score(docs, train(docs, labels, keep=~held_out()))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
