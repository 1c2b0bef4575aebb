import random
import re

import pytest

from folioscan.llm import mixing, queries

DOCS = "doc_id long, text string, source string, size int, target string"


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], DOCS)


def slow_targets(rows):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        free -= over
    return sizes, out


def checked(rows, got):
    sizes, target = slow_targets(rows)
    assert len(got) == len(rows)
    taken, largest = {}, {}
    by_id = {(r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))): r[2] for r in rows}
    for r in got:
        source = by_id[r.doc_id, r.size]
        assert r.source_size == sizes[source] and r.target == pytest.approx(target[source])
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source] = taken.get(source, 0) + r.taken
        largest[source] = max(largest.get(source, 0), r.size)
    for source in sizes:
        assert abs(taken[source] - target[source]) <= largest[source] + 1e-6
    return taken, target


def test_all_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = queries.op5_mixing(spark, sf).collect()
    checked(rows, got)
    again = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet").repartition(7)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_tree_of_several_levels_stays_near_the_target(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 60), "big" if i % 3 else rng.choice("abcdefg")) for i in range(3000)]
    got = mixing.mix(made(spark, rows), fan_in=8).collect()
    taken, target = checked(rows, got)
    assert abs(taken["big"] - target["big"]) < 60


def test_nulls_empty_repeated_and_odd_sources(spark):
    rows = [(1, None, "b"), (2, "", "b"), (3, "a b c", "b"), (None, "one two", None), ((1 << 62) + 1, "u v w", None), (5, "x " * 5000, "\U0001f600"), (6, "y " * 10, "￿"), (7, "z", ""), (7, "z", ""), (8, "q r s", "b")]
    got = mixing.mix(made(spark, rows)).collect()
    checked(rows, got)


def test_equal_rows_never_fill_a_leaf(spark):
    rng = random.Random(3)
    rows = [(7, "a b c d e f g", "big")] * 700 + [(None, "one two", "big")] * 300 + [(i, "w " * rng.randrange(1, 60), "big" if i % 3 else rng.choice("abc")) for i in range(1000, 2000)]
    rounding = mixing._round

    def seen(fan_in):
        inner = rounding(fan_in)

        def run(frame):
            assert len(frame) <= 40 * fan_in
            return inner(frame)

        return run

    mixing._round = seen
    try:
        got = mixing.mix(made(spark, rows), fan_in=16).collect()
        again = mixing.mix(made(spark, rows).repartition(5), fan_in=16).collect()
    finally:
        mixing._round = rounding
    taken, target = checked(rows, got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    seven = [r.copies for r in got if r.doc_id == 7]
    assert len(seven) == 700 and max(seven) - min(seven) <= 1
    assert abs(taken["big"] - target["big"]) <= 60


def test_no_words_and_no_rows(spark):
    assert mixing.mix(made(spark, [])).count() == 0
    got = mixing.mix(made(spark, [(1, None, None), (2, " ", "a")])).collect()
    assert {(r.size, r.source_size, r.target, r.taken) for r in got} == {(0, 0, 0.0, 0)}


def test_pivotal_keeps_sums_and_chances():
    rng = random.Random(4)
    sizes = [rng.randrange(1, 50) for _ in range(40)]
    shares = [rng.random() for _ in sizes]
    mass = sum(s * p for s, p in zip(sizes, shares))
    hits = [0] * 40
    for run in range(2000):
        out = mixing.pivotal(sizes, shares, [run * 1000 + i for i in range(40)])
        open_ones = [p for p in out if 0 < p < 1]
        assert len(open_ones) <= 1 and sum(s * p for s, p in zip(sizes, out)) == pytest.approx(mass)
        hits = [h + p for h, p in zip(hits, out)]
    assert all(abs(h / 2000 - p) < 0.06 for h, p in zip(hits, shares))
