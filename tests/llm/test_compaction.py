"""Bin-packed compaction against a plain version of its rules, and its files themselves."""

import datetime
import hashlib
import math
import os
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from folioscan.llm import compaction
from folioscan.llm.common import table

EPOCH = datetime.date(1970, 1, 1)


def plain(rows, columns):
    """The contract, row by row and file by file."""
    total = len(rows)
    s = lambda x: 1 + total // x
    days = defaultdict(list)
    for r in rows:
        days[(r["arrived_at"].date() - EPOCH).days if r["arrived_at"] else None].append(r)
    out = []
    for day, mine in days.items():
        files = defaultdict(list)
        for r in mine:
            h = zlib.crc32(b"" if r["click_id"] is None else str(r["click_id"]).encode())
            files[h // 16 % (1 + len(mine) // s(150)), min(h % 4, h // 4 % 4)].append(r)
        for k in files:
            files[k].sort(key=lambda r: ((r["arrived_at"] is not None, r["arrived_at"]), (r["click_id"] is not None, r["click_id"] or 0)))
        groups = []
        for k in sorted((k for k in files if len(files[k]) < s(600)), key=lambda k: (-len(files[k]), k)):
            for g in groups:
                if sum(len(files[x]) for x in g) + len(files[k]) <= s(400):
                    g.append(k)
                    break
            else:
                groups.append([k])
        for g in [*groups, *([k] for k in files if len(files[k]) >= s(600))]:
            body = [r for k in g for r in files[k]]
            ids = [r["click_id"] for r in body if r["click_id"] is not None]
            cents = sum(math.floor(100 * r["value"] + 0.5) for r in body if r["value"] is not None and math.isfinite(r["value"]))
            sha = hashlib.sha256(",".join("" if r["click_id"] is None else str(r["click_id"]) for r in body).encode()).hexdigest()
            out.append((day, *g[0], len(body), min(ids, default=None), max(ids, default=None), cents, ",".join(f"{a}-{b}" for a, b in g), sha, ",".join(columns), len(g) > 1))
    return sorted(out, key=str)


def told(df):
    return sorted((tuple(r)[:10] + (r["rewritten"],) for r in df.collect()), key=str)


def place(path):
    return path.replace("file://", "")


def test_whole_table_and_files(spark):
    clicks = table(spark, "/root/testdata/sf0.01", "clicks")
    found = compaction.compacted(clicks)
    rows = found.collect()
    assert told(found) == plain([r.asDict() for r in clicks.collect()], clicks.columns)
    assert any(r["rewritten"] for r in rows) and not all(r["rewritten"] for r in rows)
    folder = os.path.dirname(place(rows[0]["path"]))
    assert sorted(os.listdir(folder)) == sorted(os.path.basename(r["path"]) for r in rows)
    for r in rows:
        got = pq.read_table(place(r["path"]))
        assert got.column_names == clicks.columns and got.num_rows == r["n_rows"]
    back = spark.read.parquet(os.path.dirname(rows[0]["path"]))
    assert back.schema == clicks.schema
    assert back.exceptAll(clicks).count() == clicks.exceptAll(back).count() == 0


def test_files_that_stay_are_not_touched(spark):
    clicks = table(spark, "/root/testdata/sf0.001", "clicks")
    from folioscan.llm.common import fresh_path

    folder = fresh_path(spark, "untouched")
    rows = compaction.write_daily(clicks, folder)
    fs, base = compaction.opened(folder)
    bytes_of = lambda: {n: open(f"{base}/{n}", "rb").read() for n in compaction.names(folder)}
    before, files = bytes_of(), compaction.manifest(spark, folder)
    compaction.merge(spark, folder, compaction.packed(files, rows))
    after = bytes_of()
    kept = set(before) & set(after)
    assert kept and all(before[n] == after[n] for n in kept)
    assert {f["sources"] for f in compaction.manifest(spark, folder)} >= {f["sources"] for f in files if f["name"] in kept}
    compaction.merge(spark, folder, compaction.packed(files, rows)[:0])  # nothing to do
    assert bytes_of() == after


def test_odd_rows(spark):
    at = datetime.datetime(2024, 3, 1, 12)
    schema = "click_id long, arrived_at timestamp_ntz, value double, day string, FOLIO_lot string, folio_piece int"
    rows = [(i % 7 if i % 11 else None, at + datetime.timedelta(hours=i) if i % 5 else None, [1.005, None, float("nan"), float("inf"), -2.5][i % 5], "d", "l", i) for i in range(300)]
    rows += rows[:40]
    df = spark.createDataFrame(rows, schema)
    assert told(compaction.compacted(df)) == plain([r.asDict() for r in df.collect()], df.columns)


def test_empty_and_single(spark):
    schema = "click_id long, arrived_at timestamp_ntz, value double"
    empty = compaction.compacted(spark.createDataFrame([], schema))
    assert empty.count() == 0 and "ids_sha256" in empty.columns
    one = compaction.compacted(spark.createDataFrame([(5, datetime.datetime(1969, 12, 31), 1.0)], schema)).collect()
    assert [(r["day"], r["n_rows"], r["cents"], r["rewritten"]) for r in one] == [(-1, 1, 100, False)]


@pytest.mark.parametrize("sizes", [[5, 5, 5], [1] * 20, [9, 2, 7, 3, 3, 8, 1]])
def test_first_fit_decreasing(sizes):
    files = [{"day": i % 2, "lot": i, "piece": 0, "n_rows": n} for i, n in enumerate(sizes)]
    groups = compaction.packed(files, 3600, small=400, full=400)  # both 10 rows
    assert sorted(f["lot"] for g in groups for f in g) == [i for i, n in enumerate(sizes) if n < 10]
    assert all(sum(f["n_rows"] for f in g) <= 10 and len({f["day"] for f in g}) == 1 for g in groups)


def test_a_second_attempt_changes_nothing(spark):
    """Both steps of a merge may run again, as they do after a lost executor."""
    clicks = table(spark, "/root/testdata/sf0.001", "clicks").withColumn("more", F.lit(1))
    from folioscan.llm.common import fresh_path

    folder = fresh_path(spark, "again")
    rows = compaction.write_daily(clicks, folder)
    assert compaction.write_daily(clicks, folder) == rows
    files = compaction.manifest(spark, folder)
    fs, base = compaction.opened(folder)
    open(f"{base}/.left-by-an-attempt", "w").close()
    compaction.merge(spark, folder, compaction.packed(files, rows))
    assert sum(f["n_rows"] for f in compaction.manifest(spark, folder)) == rows == clicks.count()
    assert all(n[0] not in "._" for n in os.listdir(base))
