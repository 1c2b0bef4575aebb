"""Sparse hashed text features and models trained on a bounded sample of labelled rows."""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing

_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+|\n")
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: Tokens for what hashing words alone would hide: capitals, a word or a line that repeats.
_CAPS, _AGAIN, _LINE = b"\0caps", b"\0again", b"\0line"


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words and runs of punctuation in order, with marks after capitals and repeats."""
    out: list[bytes] = []
    last, line, lines = b"", [], set()
    for token in _TOKEN.findall(text):
        if token == b"\n":
            if line:
                whole = b" ".join(line)
                if whole in lines:
                    out.append(_LINE)
                lines.add(whole)
                line = []
            continue
        low = token.lower()
        line.append(low)
        out.append(low)
        if token != low and len(token) > 1 and token.upper() == token:
            out.append(_CAPS)
        if low == last:
            out.append(_AGAIN)
        last = low
    if line and b" ".join(line) in lines:
        out.append(_LINE)
    return out


def counted(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    index, count = np.unique(slots, return_counts=True)
    return index.astype(np.int32), count


def ngram_features(text: bytes | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed word unigrams and bigrams with log counts, scaled to length 1; nothing for an empty text."""
    words = tokens(text or b"")
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    one = np.fromiter(map(crc32, words), np.uint64, len(words))
    two = (one[:-1] * np.uint64(31) + one[1:] + np.uint64(1)) * _MIX
    index, count = counted(np.concatenate(((one * _MIX) >> np.uint64(64 - bits), two >> np.uint64(64 - bits))))
    value = np.log1p(count)
    return index, (value / np.sqrt(value @ value)).astype(np.float32)


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, keep=None) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled documents, those with the smallest hashes of doc_id.

    A doc_id with several labels takes the largest one; of repeated documents
    one is taken. The ids are broadcast: there are at most ``most`` of them.
    """
    own = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    own = own.filter(keep) if keep is not None else own
    ids = own.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def collected(rows: DataFrame, features) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Features and labels of a bounded set of rows, on the driver, in order of doc_id."""

    def run(batches):
        for batch in batches:
            found = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0].tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary()), batch.column(2)], names=["doc_id", "index", "value", "label"])

    table = rows.mapInArrow(freeing(run), "doc_id long, index binary, value binary, label int").toArrow().sort_by("doc_id")
    pairs = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v in zip(table.column("index").to_pylist(), table.column("value").to_pylist())]
    return pairs, table.column("label").to_numpy().astype(np.int64)


class Ftrl:
    """Per-coordinate follow-the-regularised-leader updates; ``weights`` come from the sums z and n."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float, rising: bool = False):
        """``rising``: no weight is below 0, so a feature can only add to the sum."""
        self.z, self.n, self.rising = np.zeros(size), np.zeros(size), rising
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def at(self, index) -> np.ndarray:
        z = self.z[index]
        push = np.minimum(z + self.l1, 0.0) if self.rising else np.maximum(np.abs(z) - self.l1, 0.0) * np.sign(z)
        return -push / ((self.beta + np.sqrt(self.n[index])) / self.alpha + self.l2)

    def update(self, index, gradient, weights) -> None:
        square = gradient * gradient
        n = self.n[index]
        step = (np.sqrt(n + square) - np.sqrt(n)) / self.alpha
        self.z[index] += gradient - step * weights
        self.n[index] = n + square

    def weights(self) -> np.ndarray:
        return self.at(slice(None)).astype(np.float32)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
