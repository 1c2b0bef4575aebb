"""Resumable reconcile: each range is read once, stops lose nothing, removals come last."""

import random

import pytest

from folioscan.operators.inventory import difference
from folioscan.streaming.reconcile import Reconcile

STATE = "path string, size_bytes long, modified_at_ms double"


def states(spark, n=300):
    rng = random.Random(3)
    disk, index = {}, {}
    for i in range(n):
        path = f"/r/{rng.choice('abc')}/{i:03d}"
        if rng.random() < 0.8:
            index[path] = (i, 1.0)
        if rng.random() < 0.8:
            disk[path] = (i + (rng.random() < 0.2), 1.0)
    disk["/other/x"] = index["/other/y"] = (1, 1.0)
    return [spark.createDataFrame([(p, *v) for p, v in s.items()], STATE) for s in (disk, index)]


def test_rounds_with_stops_equal_the_whole_comparison(spark):
    disk, index = states(spark)
    want = {tuple(r) for r in difference(disk, index).filter("change <> 'same' and path like '/r/%'").collect()}
    home = Reconcile.begin(disk, index, "/r", range_rows=60).home
    n = Reconcile(spark, home).ranges
    got, read, seen = set(), [], []
    assert n >= 5

    def take(found, first):
        seen.append(first)
        got.update(tuple(r) for r in found.collect())

    def fails(found, first):
        raise ConnectionError("stopped")

    more, k = True, 0
    while more:
        r = Reconcile(spark, home)  # a new process each time
        if k == 2:
            with pytest.raises(ConnectionError):
                r.round(fails)
            assert Reconcile(spark, home).frontier == k
        with pytest.raises(RuntimeError, match="has not been compared"):
            r.removals()
        r = Reconcile(spark, home)
        more = r.round(take)
        read += r.ranges_read
        k += 1
    assert read == seen == list(range(n))
    r = Reconcile(spark, home)
    assert r.complete and not r.round(take)
    assert got == {x for x in want if x[1] != "removed"}
    gone = {r.path for r in r.removals().collect()}
    assert gone == {p for p, c in want if c == "removed"}
    kept = {x.path for x in r.removals(["/r/a"], spark.createDataFrame([(max(gone),)], "path string")).collect()}
    assert kept == {p for p in gone if not p.startswith("/r/a/")} - {max(gone)}


def test_a_round_reads_its_ranges_only(spark):
    disk, index = states(spark)
    r = Reconcile.begin(disk, index, "/r", range_rows=60)
    plan = r._changes(1, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(range" in plan
    empty = Reconcile.begin(disk.limit(0), index.limit(0), "/r")
    assert empty.round(lambda found, first: None) is False and empty.removals().count() == 0
