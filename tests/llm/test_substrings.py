import hashlib
import random

import numpy as np
import pytest

from folioscan.llm import queries, substrings, suffixes

DOCS = "doc_id long, text string, n_chars int, digest string, kept string"


def made(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), "clash", "clash") for r in rows], DOCS)


def slow(rows, window=50):
    big = (1 << 63) - 1
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - window + 1):
            s = b[p : p + window]
            first[s] = min(first.get(s, big), big if d is None else d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if first[b[p : p + window]] < (big if d is None else d):
                gone[p : p + window] = b"\1" * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(seed, count=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    passages = [" ".join(word() for _ in range(rng.randrange(8, 60))) for _ in range(8)]
    rows = []
    for i in range(count):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randrange(1, 50))) for _ in range(rng.randrange(1, 6))]
        rows.append((rng.randrange(1000) * 100 + i, rng.choice([" ", "\n", ""]).join(parts)))
    for i, text in list(rows)[::7]:
        at = rng.randrange(len(text))
        rows += [(i + 50, text), (i + 51, text[:at] + "#" + text[at + 1 :]), (i + 52, text[at:] + text[:at])]
    return rows


@pytest.mark.parametrize("how", [{}, {"chunk_bytes": 3000, "bucket_bytes": 4000, "bucket_keys": 50}, {"chunk_bytes": 20000, "bucket_bytes": 50000, "most_bytes": 2000}, {"chunk_bytes": 1500, "bucket_bytes": 1000, "bucket_keys": 20, "fan": 4}, {"chunk_bytes": 1500, "bucket_bytes": 900, "bucket_keys": 20, "fan": 3, "most_bytes": 600}])
def test_planted_passages_against_brute_force(spark, how):
    rows = texts(len(how) + 1)
    assert sorted(map(tuple, substrings.digested(made(spark, rows), **how).collect()), key=str) == slow(rows)


def test_rows_sent_grow_with_the_bytes(spark, monkeypatch):
    """Four times the documents: chunks send about four times the rows, though chunks and buckets both grow by four."""
    kept, sent = substrings.stored, {}

    def counting(frame, name, *codec):
        out = kept(frame, name, *codec)
        sent.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(substrings, "stored", counting)
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    shared = [" ".join(word() for _ in range(12)) for _ in range(400)]
    for count in (60, 240):
        rows = [(i, " ".join([" ".join(word() for _ in range(30)), shared[rng.randrange(count)], shared[rng.randrange(count)]])) for i in range(count)]
        assert sorted(map(tuple, substrings.digested(made(spark, rows), chunk_bytes=1000, bucket_bytes=1000, bucket_keys=70, fan=4).collect()), key=str) == slow(rows)
    for name in ("key_cells", "piece_cells"):
        small, large = sent[name]
        assert large <= 6 * small, (name, small, large)


def test_odd_rows(spark):
    long = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(200))
    rows = [
        (9, long), (3, long), (3, long), (None, long), (None, "x" + long), (7, None), (8, ""), (1, "a" * 49), (2, "a" * 49), (4, "b" * 50), (5, "b" * 5000), (6, "c" + "b" * 50 + "c"), (10, "ab" * 3000), (11, "ba" * 25),
        (12, "\0" * 60 + "é" * 40), (13, "\0" * 70 + "é" * 40 + "z"), (14, long + long), (14, long[::-1] + long), (15, long[:50] + long[100:150]), (16, long[:100]), (17, long[50:100] + long[:50]), (20, "a" * 300000), (21, "b" + "a" * 100000),
    ]
    assert sorted(map(tuple, substrings.digested(made(spark, rows)).collect()), key=str) == slow(rows)
    assert substrings.digested(made(spark, [])).count() == 0
    assert substrings.digested(made(spark, [(1, None), (2, "short")])).count() == 2


def test_texts_spans_and_columns(spark):
    passage = "é".join(str(i) for i in range(40))
    rows = [(1, passage), (2, "before " + passage + " after"), (3, "own text that stands alone"), (4, passage)]
    docs = made(spark, rows)
    out = substrings.cleaned(docs)
    assert out.schema == docs.schema
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == passage and got[2].text == "before  after" and got[3].text == rows[2][1] and got[4].text == ""
    assert got[2].n_chars == len("before  after") and {r.digest for r in got.values()} == {"clash"}
    spans = {r.id: r.spans for r in substrings.removals(docs).collect()}
    size = len(passage.encode())
    assert [(s.begin, s.end) for s in spans[2]] == [(7, 7 + size)] and [(s.begin, s.end) for s in spans[4]] == [(0, size)] and set(spans) == {2, 4}


def test_all_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op10_substrings(spark, sf).collect()), key=str) == slow(rows)


def test_suffix_order_and_prefixes_against_sorting():
    rng = random.Random(7)
    for n in [0, 1, 2, 3, 10, 200, 2000]:
        for letters in (b"a", b"ab", bytes(range(256)), b"\0\1", b"abcdefgh"):
            text = bytes(rng.choice(letters) for _ in range(n))
            words = suffixes.big_words(np.frombuffer(text, np.uint8))
            order = suffixes.suffix_array(np.frombuffer(text, np.uint8), words)
            cut = lambda p: text[p : p + suffixes.DEPTH].ljust(suffixes.DEPTH, b"\0")
            assert sorted(order.tolist()) == list(range(n))
            keys = [cut(p) for p in order]
            assert keys == sorted(keys)
            for limit in (50, 48, 33):
                want = [next((k for k in range(limit) if a[k] != b[k]), limit) for a, b in zip(keys, keys[1:])]
                assert suffixes.common_prefixes(order, words, limit).tolist() == want


def test_types_by_definition():
    rng = random.Random(1)
    for _ in range(200):
        text = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 30)))
        want = [text[i:] < text[i + 1 :] for i in range(len(text))]
        assert suffixes.smaller_than_next(np.frombuffer(text, np.uint8)).tolist() == want


def test_bucket_hash_equals_the_one_of_spark(spark):
    from pyspark.sql import functions as F

    values = [0, 1, -1, 1 << 40, (3 << 40) | (5 << 22) | 9, -(1 << 62)]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(F.hash("v")).collect()]
    assert substrings.spark_hash(np.array(values)).tolist() == want
    assert all(substrings.spark_hash(np.array([substrings.chunk_name(t, 3, 7)]))[0] % 7 == t % 7 for t in range(9))
