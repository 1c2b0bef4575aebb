"""The set join against all pairs."""

import random

import pytest

from folioscan.llm import jaccard
from folioscan.llm.common import table
from folioscan.llm.simhash import shingle_set


def plain(rows, percent=85, shingle=4):
    """Every pair of distinct sets compared, components by flooding."""
    sets = [shingle_set((t or "").encode(), shingle) for _, t in rows]
    distinct = sorted(set(sets), key=lambda s: (len(s), sorted(s)))
    near = {s: {s} for s in distinct}
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if percent * len(b) > 100 * len(a):
                break
            if a and 100 * len(a & b) >= percent * len(a | b):
                near[a].add(b)
                near[b].add(a)
    ids, root = {}, {}
    for (d, _), s in zip(rows, sets, strict=True):
        ids.setdefault(s, []).append(d)
    for s in distinct:
        if s in root:
            continue
        group, todo = {s}, [s]
        while todo:
            for x in near[todo.pop()] - group:
                group.add(x)
                todo.append(x)
        least = min((d for x in group for d in ids[x] if d is not None), default=None)
        root.update(dict.fromkeys(group, least))
    return sorted(((d, len(s), root[s] if s else d) for (d, _), s in zip(rows, sets, strict=True)), key=str)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def groups(seed, sizes, copies, edits, vocabulary=400):
    """Texts in groups of near copies, chains of copies of copies among them."""
    rng = random.Random(seed)
    out = []
    for size in sizes:
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(size)]
        out.append(base)
        for _ in range(copies):
            new = list(rng.choice([base, out[-1]]))
            for _ in range(rng.randrange(edits)):
                i = rng.randrange(len(new) + 1)
                new[i : i + rng.randrange(2)] = [f"w{rng.randrange(vocabulary)}"] * rng.randrange(2)
            out.append(new)
    rng.shuffle(out)
    return [(i, " ".join(x)) for i, x in enumerate(out)]


def test_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    assert told(jaccard.joined(docs)) == plain([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("limit", [None, 0, 20])
def test_groups_of_near_copies(spark, limit):
    rows = groups(5, [6, 8, 10, 13, 15, 17, 19, 22, 27, 33, 60, 140, 400], 40, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = told(jaccard.joined(df, limit=limit, tile=16))
    assert found == plain(rows)
    assert len({c for _, _, c in found}) < len(found) - 100  # there are many links


@pytest.mark.parametrize("seed", range(3))
def test_many_small_sets(spark, seed):
    rows = groups(seed, [5 + i % 22 for i in range(60)], 8, 3, vocabulary=12)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert told(jaccard.joined(df)) == plain(rows)


def test_a_large_group_gives_few_rows(spark):
    """Round one gives about a row for each near copy, round two only what is not in one component."""
    rows = groups(9, [150], 500, 12, vocabulary=5000)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    members, classes, links = jaccard.linked(df, tile=128)
    assert told(jaccard.joined(df)) == plain(rows)
    assert links.count() < 12 * len(rows)


def test_odd_rows(spark):
    rows = [(None, "one two three four five six"), (7, "ONE two\tthree four five\nsix"), (7, "other words of another text here"), (8, ""), (9, None), (8, " \n"), (3, "just two"), (4, "just  two"), (None, ""), (5, "lonely words of no copy")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, node int, token string")
    assert told(jaccard.joined(df)) == plain(rows)
    assert jaccard.joined(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_thresholds():
    for percent in (50, 80, 85, 100):
        bound = jaccard.Threshold(percent)
        for s in range(1, 40):
            for t in range(s, 60):
                shared = next((o for o in range(t + 1) if 100 * o >= percent * (s + t - o)), None)
                assert bound.shared(s, t) == shared
                assert (shared <= s) == (bound.least(t) <= s) == (t <= bound.largest(s))


def test_boundary():
    bound = jaccard.Threshold()
    assert bound.boundary({20: 1000, 30: 10}, 1.0) < bound.boundary({20: 1000, 30: 10}, 1e5)
    assert bound.boundary({}, 5.0) == jaccard.LARGEST_LIGHT
