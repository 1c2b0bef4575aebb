"""Toxicity: a cumulative-link ordinal regression over sparse text features.

Grades run from 0 (not toxic) to ``len(cuts) + 1``. One weight vector f(x) is
shared by all thresholds t_1 < t_2 < ..: P(grade <= k) = sigmoid(t_k - f(x)).
The output is the expected severity, the sum of P(grade > k).

Labels say only whether a document is toxic, so the grades of the training
rows come from how much toxic wording they hold: features that the labelled
sample shows far more often in toxic rows are counted (a word of over five
letters as itself and as its stem) and the count is cut at fixed amounts. The
amount is that of the whole text, so of two toxic texts of one density the
longer one has the higher grade; texts that are not toxic have grade 0 at any
length. Training reads at most ``most`` labelled documents (a documented
bound, drawn by hash), whole texts, on the driver; scoring is a sparse dot
product for each document.

Features are hashed words and five-letter word beginnings (stems that carry
endings), each with a log count that no length of text dilutes.

Defined results
    null or empty text   no features: the severity of the bias alone
    very long texts      scored whole; log counts keep them from adding up
    a tie at ``reject``  rejected
    null doc_id          scored; never a training row
    no labels            severity 0 for all
    repeated rows        a score for each; one of them is trained on
    empty table          an empty result
    extra columns        ignored; without_toxic() returns them
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, release

from .textmodel import Ftrl, collected, labelled, sigmoid

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEM = 5


def features(text: bytes | None, bits: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and word beginnings of a text with their log counts."""
    count: dict[bytes, int] = {}
    for word in _WORD.findall((text or b"").lower()):
        count[word] = count.get(word, 0) + 1
    stems: dict[bytes, int] = {}
    for word, n in count.items():
        if len(word) > _STEM:
            stem = b"^" + word[:_STEM]
            stems[stem] = stems.get(stem, 0) + n
    count |= stems
    if not count:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    slot = (np.fromiter(map(crc32, count), np.uint64, len(count)) * _MIX) >> np.uint64(64 - bits)
    index, at = np.unique(slot.astype(np.int32), return_inverse=True)
    return index, np.log1p(np.bincount(at, np.fromiter(count.values(), np.float64, len(count)))).astype(np.float32)


def severity_grades(pairs, toxic: np.ndarray, size: int, cuts: tuple) -> np.ndarray:
    """A grade for each row: 0 where not toxic, else 1 and one more for each amount of telling features in ``cuts`` that is passed."""
    with_it, without = np.zeros(size), np.zeros(size)
    for (index, _), mark in zip(pairs, toxic):
        (with_it if mark else without)[index] += 1
    share = (with_it + 0.5) / (toxic.sum() + 1) / ((without + 0.5) / ((toxic == 0).sum() + 1))
    telling = (with_it >= 4) & (share > 12)
    grades = np.zeros(len(pairs), np.int64)
    for i, (index, value) in enumerate(pairs):
        if toxic[i]:
            amount = np.expm1(value[telling[index]]).sum()
            grades[i] = 1 + sum(amount > cut for cut in cuts)
    return grades


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int

    def severity(self, text: bytes | None) -> float:
        index, value = features(text, self.bits)
        return float(sigmoid(self.weights[index] @ value - self.thresholds).sum())


def fit(pairs, grades: np.ndarray, levels: int, bits: int = 20, epochs: int = 8, alpha: float = 0.5, l1: float | None = None, l2: float = 0.2, rate: float = 0.02, seed: int = 4) -> Model:
    """Maximises the ordinal likelihood, row by row; thresholds are a first value and positive gaps, so they stay ordered.

    Weights are not negative, so harmless words never hide a toxic one. ``l1``
    grows with the number of rows unless it is given.
    """
    l1 = min(6.0, max(0.5, 2e-3 * len(grades))) if l1 is None else l1
    learner = Ftrl(1 << bits, alpha, 1.0, l1, l2, rising=True)
    first, gaps = 1.0, np.zeros(levels - 1)
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in draw.permutation(len(grades)):
            index, value = pairs[i]
            weights = learner.at(index)
            f = float(weights @ value)
            t = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
            y = grades[i]
            high = sigmoid(t[y] - f) if y < levels else 1.0
            low = sigmoid(t[y - 1] - f) if y > 0 else 0.0
            p = max(high - low, 1e-9)
            learner.update(index, (1.0 - high - low) * value, weights)
            push = np.zeros(levels)  # of the log likelihood, by threshold
            if y < levels:
                push[y] += high * (1 - high) / p
            if y > 0:
                push[y - 1] -= low * (1 - low) / p
            push = np.clip(push, -5, 5)
            first += rate * push.sum()
            gaps += rate * np.exp(gaps) * np.cumsum(push[::-1])[::-1][1:]
            gaps = np.clip(gaps, -6, 3)
    t = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
    return Model(learner.weights(), t, bits)


def train(docs: DataFrame, labels: DataFrame, most: int = 8000, cuts: tuple = (2.0, 6.0), bits: int = 20, **how) -> Model:
    pairs, toxic = collected(labelled(docs, labels, "toxic", most), lambda text: features(text, bits))
    if not len(toxic):
        return Model(np.zeros(1 << bits, np.float32), np.full(len(cuts) + 1, 100.0), bits)
    model = fit(pairs, severity_grades(pairs, toxic, 1 << bits, cuts), len(cuts) + 1, bits, **how)
    del pairs
    release()  # the driver's memory is small beside the sample's features
    return model


def score(docs: DataFrame, model: Model, reject: float = 0.2) -> DataFrame:
    """(doc_id, severity, toxic) for every row of ``docs``; toxic where the expected severity reaches ``reject``."""

    def run(batches):
        for batch in batches:
            found = np.array([model.severity(t) for t in batch.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found), pa.array(found >= reject)], names=["doc_id", "severity", "toxic"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(freeing(run), "doc_id long, severity double, toxic boolean")


def graded(docs: DataFrame, labels: DataFrame, reject: float = 0.2) -> DataFrame:
    return score(docs, train(docs, labels), reject)


def without_toxic(docs: DataFrame, labels: DataFrame, reject: float = 0.2) -> DataFrame:
    """The rows of ``docs`` below the severity that rejects, all columns kept; nothing is shuffled."""
    model = train(docs, labels)
    at = docs.columns.index("text")
    schema = docs.schema

    def run(batches):
        for batch in batches:
            stays = [model.severity((t or "").encode("utf-8")) < reject for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(freeing(run), schema)
