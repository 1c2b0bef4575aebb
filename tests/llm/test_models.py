import math
import random
import re
from zlib import crc32

import numpy as np
import pytest

from folioscan.llm import quality, queries, textmodel, toxicity

DOCS = "doc_id long, text string, score double, label int"
LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    bad = ["zqwort", "zqlump", "zqgrub", "zqtoad"]
    docs, labels = [], []
    for i in range(1200):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 90))]
        toxic, good = int(i % 8 == 0), int(i % 5 > 0)
        for _ in range(rng.randrange(1, 9) if toxic else 0):
            text[rng.randrange(len(text))] = rng.choice(bad)
        if not good:
            text = [w + "###" for w in text]
        docs.append((i, " ".join(text)))
        labels.append((i, good, toxic))
    return docs, labels


def frames(spark, corpus):
    docs, labels = corpus
    return spark.createDataFrame([(*d, 0.5, 9) for d in docs], DOCS), spark.createDataFrame([(*l, "clash") for l in labels], LABELS)


def test_held_out_quality_and_labels_that_are_not_read(spark, corpus):
    docs, labels = frames(spark, corpus)
    got = {r.doc_id: r for r in quality.graded(docs, labels).collect()}
    truth = {i: q for i, q, _ in corpus[1]}
    held = [i for i in got if got[i].held_out]
    assert held == [i for i in got if crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert all(r.predicted == (r.score >= 0.7) for r in got.values())
    flipped = [(i, 1 - q if got[i].held_out else q, t) for i, q, t in corpus[1]]
    again = {r.doc_id: r.score for r in quality.graded(docs, frames(spark, (corpus[0], flipped))[1]).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_severity_separates_and_rises(spark, corpus):
    docs, labels = frames(spark, corpus)
    got = {r.doc_id: r for r in toxicity.graded(docs, labels).collect()}
    truth = {i: t for i, _, t in corpus[1]}
    assert sum(got[i].toxic == bool(t) for i, t in truth.items()) >= 0.98 * len(truth)
    model = toxicity.train(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    base = " ".join(["abc"] * 30)
    one, many = model.severity((base + " zqwort").encode(), ), model.severity((base + " zqwort zqlump zqgrub zqtoad" * 4).encode())
    assert model.severity(base.encode()) < one < many <= len(model.thresholds)
    assert one == model.severity((base * 50 + " zqwort").encode()) or model.severity((base * 50 + " zqwort").encode()) >= 0.2


def test_severity_of_rows_that_were_not_trained_on(spark, corpus):
    """Two thirds of the labels are read; the others are graded."""
    docs, labels = frames(spark, corpus)
    got = {r.doc_id: r for r in toxicity.graded(docs, labels.filter("doc_id % 3 <> 1")).collect()}
    held = {i: t for i, _, t in corpus[1] if i % 3 == 1}
    caught = sum(got[i].toxic for i, t in held.items() if t)
    assert caught >= 0.95 * sum(held.values())
    assert sum(got[i].toxic for i, t in held.items() if not t) <= 0.01 * len(held)
    assert min(got[i].severity for i, t in held.items() if t and got[i].toxic) > max(got[i].severity for i, t in held.items() if not t and not got[i].toxic)


def test_severity_equals_a_dense_ordinal_model(spark, sf):
    """The query's scores against sums of logistic thresholds over dense feature vectors."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.severity for r in queries.op4_toxicity(spark, sf).collect()}
    for r in docs.collect():
        words = re.findall(rb"[0-9a-z\x80-\xff]+", (r.text or "").encode().lower())
        count = {}
        for token in words + [b"^" + w[:5] for w in words if len(w) > 5]:
            slot = crc32(token) * 0x9E3779B97F4A7C15 % (1 << 64) >> 64 - model.bits
            count[slot] = count.get(slot, 0) + 1
        f = sum(float(model.weights[k]) * math.log1p(n) for k, n in count.items())
        chances = [1 / (1 + math.exp(min(40, max(-40, t - f)))) for t in model.thresholds]
        assert got[r.doc_id] == pytest.approx(sum(chances), abs=1e-4)
        assert all(a >= b for a, b in zip(chances, chances[1:]))


def test_rejecting_keeps_rows_and_columns(spark, corpus):
    docs, labels = frames(spark, corpus)
    kept = toxicity.without_toxic(docs.withColumn("other", docs["label"]), labels)
    assert kept.columns == ["doc_id", "text", "score", "label", "other"]
    toxic = {r.doc_id for r in toxicity.graded(docs, labels).filter("toxic").collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in corpus[0]} - toxic


def test_odd_rows_and_empty_tables(spark, corpus):
    labels = frames(spark, corpus)[1]
    odd = spark.createDataFrame([(None, None, 0.1, 1), (1, "", 0.1, 1), (1, "", 0.1, 1), (2, "ab " * 60000, 0.1, 1), (3, "\n\n###", 0.1, 1)], DOCS)
    for out in (quality.graded(odd, labels), toxicity.graded(odd, labels)):
        rows = out.collect()
        assert len(rows) == 5 and all(r[1] is not None for r in rows)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in quality.graded(odd, none).collect()} == {0.5}
    assert {r.toxic for r in toxicity.graded(odd, none).collect()} == {False}
    empty = spark.createDataFrame([], DOCS)
    assert quality.graded(empty, labels).count() == 0 and toxicity.graded(empty, labels).count() == 0


def test_null_labels_and_repeated_labels(spark):
    docs = spark.createDataFrame([(i, "a b c", 0.0, 0) for i in range(6)], DOCS)
    labels = spark.createDataFrame([(1, None, None, ""), (2, 1, 0, ""), (2, 0, 1, ""), (None, 1, 1, ""), (99, 1, 1, "")], LABELS)
    rows = textmodel.labelled(docs, labels, "toxic", 10).collect()
    assert [(r.doc_id, r.label) for r in rows] == [(2, 1)]


def test_sparse_scores_equal_a_dense_product(spark, sf):
    rng = np.random.default_rng(3)
    model = quality.Model(rng.normal(size=1 << 12).astype(np.float32), -0.3, 12)
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    for r in quality.score(rows, model).join(rows, "doc_id").limit(50).collect():
        index, value = textmodel.ngram_features(r.text.encode(), 12)
        dense = np.zeros(1 << 12)
        dense[index] = value
        assert r.score == pytest.approx(1 / (1 + np.exp(-(dense @ model.weights - 0.3))), abs=1e-5)


def test_ftrl_follows_the_closed_form():
    learner = textmodel.Ftrl(3, 0.5, 1.0, 0.1, 0.2)
    at, grads, weights = np.array([1]), [], []
    for g in (0.9, -0.2, 0.7):
        w = learner.at(at)
        learner.update(at, np.array([g]), w)
        grads.append(g)
        weights.append(float(w[0]))
    n = np.cumsum([0] + [g * g for g in grads])
    z = sum(g - (np.sqrt(n[i + 1]) - np.sqrt(n[i])) / 0.5 * weights[i] for i, g in enumerate(grads))
    assert learner.at(at)[0] == pytest.approx(-(z - np.sign(z) * 0.1) / ((1 + np.sqrt(n[-1])) / 0.5 + 0.2))
    assert learner.weights()[0] == 0


def test_queries_cover_the_whole_table(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert queries.op9_quality(spark, sf).count() == n
    assert queries.op4_toxicity(spark, sf).count() == n
