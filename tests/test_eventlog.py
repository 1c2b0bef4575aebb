"""The event log against a walk over the same events: bounds, restarts, replays from any batch, late appends."""

import random

import pytest

from folioscan.streaming import eventlog

EVENTS = "at_ms long, seq long, size long, name string"


def made(n, seed=1, start=0):
    rng, at, out = random.Random(seed), start, []
    for i in range(n):
        at += rng.choice([0, 0, 1, 10, 400])
        out.append((at, i, rng.choice([0, 1, 5, 50]), f"n{i}"))
    return out


def walked(rows, items, size, span):
    """Batches as lists of rows."""
    out = []
    for row in rows:
        if out and len(out[-1]) < items and sum(r[2] or 0 for r in out[-1]) + (row[2] or 0) <= size and (row[0] or 0) - (out[-1][0][0] or 0) < span:
            out[-1].append(row)
        else:
            out.append([row])
    return out


def taken(spark, log, home, **how):
    seen = {}
    eventlog.run(spark, log, home, lambda frame, number: seen.__setitem__(number, sorted(map(tuple, frame.collect()), key=lambda r: (r[0] is not None, r[0], r[1]))), **how)
    return seen


@pytest.mark.parametrize("bounds", [{"items": 20, "size": 10**9, "span": 10**9}, {"items": 10**9, "size": 300, "span": 10**9}, {"items": 10**9, "size": 10**9, "span": 3_000}, {"items": 20, "size": 250, "span": 1_500}])
def test_batches_keep_their_bounds(spark, tmp_path, bounds):
    rows = made(150)
    shuffled = rows[:]
    random.Random(3).shuffle(shuffled)
    log = str(tmp_path / "log")
    assert eventlog.append(spark.createDataFrame(shuffled, EVENTS), log, segment=17) == 150
    got = taken(spark, log, str(tmp_path / "a"), **bounds)
    assert [got[n] for n in sorted(got)] == walked(rows, **bounds)


def test_restarts_appends_and_replays(spark, tmp_path):
    bounds, log, home = {"items": 40, "size": 700, "span": 5_000}, f"file:{tmp_path}/log", f"file:{tmp_path}/a"
    rows = made(200)
    eventlog.append(spark.createDataFrame(rows, EVENTS), log, segment=50)
    want = walked(rows, **bounds)
    got = taken(spark, log, home, once=True, **bounds)
    assert got == {0: want[0]}
    got |= taken(spark, log, home, once=True, **bounds)  # another run, one batch further
    assert got == {0: want[0], 1: want[1]}
    got |= taken(spark, log, home, **bounds)
    assert [got[n] for n in range(len(got))] == want
    assert taken(spark, log, home, **bounds) == {}  # nothing is new
    more = made(90, seed=5, start=rows[-1][0])  # appended later: no batch takes both
    assert eventlog.append(spark.createDataFrame(more, EVENTS), log) == 290
    later = taken(spark, log, home, **bounds)
    assert [later[n] for n in sorted(later)] == walked(more, **bounds) and min(later) == len(want)
    start = sum(map(len, want[:3]))  # a new stream from the start of the fourth batch
    again = taken(spark, log, str(tmp_path / "b"), first=start, **bounds)
    assert [again[n] for n in range(len(want) - 4)] == want[3:-1]


def test_a_batch_that_failed_is_the_same_again(spark, tmp_path):
    bounds, log, home, seen = {"items": 25, "size": 10**9, "span": 10**9}, str(tmp_path / "log"), str(tmp_path / "a"), []
    eventlog.append(spark.createDataFrame(made(100), EVENTS), log, segment=10)

    def fails(frame, number):
        seen.append((number, frame.count()))
        if number == 2:
            raise ValueError("lost")

    with pytest.raises(Exception, match="lost"):
        eventlog.run(spark, log, home, fails, **bounds)
    again = taken(spark, log, home, **bounds)
    assert seen == [(0, 25), (1, 25), (2, 25)] and {n: len(r) for n, r in again.items()} == {2: 25, 3: 25}


def test_empty_log_nulls_and_one_large_event(spark, tmp_path):
    log = str(tmp_path / "log")
    assert eventlog.length(log) == 0 and taken(spark, log, str(tmp_path / "a")) == {}
    assert eventlog.append(spark.createDataFrame([], EVENTS), log) == 0
    rows = [(None, 1, None, None), (None, 1, None, None), (5, 2, 10**12, "large"), (5, 3, 1, "small")]
    assert eventlog.append(spark.createDataFrame(rows, EVENTS), log) == 4
    got = taken(spark, log, str(tmp_path / "b"))
    assert [len(got[n]) for n in sorted(got)] == [2, 1, 1]


@pytest.mark.parametrize("bounds", [{"items": 20, "size": 10**9, "span": 10**9}, {"items": 10**9, "size": 90, "span": 10**9}, {"items": 30, "size": 250, "span": 1_500}])
def test_a_micro_batch_of_many_batches(spark, tmp_path, bounds):
    """Numbers go on over micro-batches, restarts, other values of ``ahead``, late appends and a failure; few jobs are started."""
    log, home, got, seen = str(tmp_path / "log"), str(tmp_path / "a"), {}, []
    rows = [(None, 0, None, "null"), *made(150)]
    eventlog.append(spark.createDataFrame(rows, EVENTS), log, segment=17)

    def handle(frame, number):
        seen.append(number)
        held = {}
        for *row, batch in frame.collect():
            held.setdefault(batch, []).append(tuple(row))
        if seen.count(number) == 1 and number == 1:
            raise ValueError("lost")
        got.update(held)

    want = walked(rows, **bounds)
    order = lambda: [sorted(got[n], key=lambda r: (r[0] is not None, r[0], r[1])) for n in sorted(got)]
    eventlog.run(spark, log, home, handle, once=True, ahead=2, **bounds)
    assert order() == want[:2] and sorted(got) == [0, 1]
    with pytest.raises(Exception, match="lost"):
        eventlog.run(spark, log, home, handle, ahead=3, **bounds)
    more = made(40, seed=5)  # older than the end of the log
    eventlog.append(spark.createDataFrame(more, EVENTS), log)
    eventlog.run(spark, log, home, handle, ahead=100, **bounds)
    assert sorted(got) == list(range(len(got))) and order()[: len(want) - 1] == want[:-1]
    assert len(seen) == 4 and sum(map(len, got.values())) == 191
