from pyspark.sql import functions as F

from folioscan.functions.paths import ignore_rules
from folioscan.streaming import live


def test_intake(spark):
    rows = [(None, False, False), ("", True, False), ("a/ignore.rules", False, False), ("a/x.log", False, False), ("a/.git/x", False, False), ("a/b", False, True), ("a/b.txt", False, False)]
    df = spark.createDataFrame(rows, "rel_path string, is_folder boolean, is_link boolean")
    got = [r.intake for r in live.intake(df, ignore_rules("*.log")).collect()]
    assert got == ["rescan", "reconcile", "reconcile", "excluded", "excluded", "excluded", "path"]


def test_stability(spark):
    seen = {"same": [(0, 1), (2000, 1)], "soon": [(0, 1), (1000, 1)], "moved": [(0, 1), (1500, 2), (2500, 2)], "once": [(7, 1)], "settled": [(0, 1), (100, 2), (1700, 2)], "never": [(i * 10, i) for i in range(7)]}
    rows = [(p, at, size, 0.0, 1) for p, all_ in seen.items() for at, size in all_]
    df = spark.createDataFrame(rows, "path string, at long, size long, modified double, inode long")
    got = {r.path: (r.state, r.changes, r.next_at) for r in live.stability(df).collect()}
    assert got == {"same": ("stable", 0, None), "soon": ("deferred", 0, 2000), "moved": ("deferred", 1, 4500), "once": ("deferred", 0, 1007), "settled": ("stable", 1, None), "never": ("given-up", 6, None)}


def test_deletions_need_proof(spark):
    gone = spark.createDataFrame([("/r", "/r/a/x"), ("/r", "/r/b/x"), ("/off", "/off/a/x")], "root string, path string")
    online, readable = spark.createDataFrame([("/r",)], "root string"), spark.createDataFrame([("/r/a",), ("/off/a",)], "folder string")
    assert {r.path: r.action for r in live.deletions(gone, online, readable).collect()} == {"/r/a/x": "delete", "/r/b/x": "DELETE_UNCONFIRMED", "/off/a/x": "DELETE_UNCONFIRMED"}


def test_reconcile_keeps_what_it_cannot_see(spark):
    schema = "path string, size_bytes long, modified_at_ms double"
    index = spark.createDataFrame([("/r/a", 1, 1.0), ("/r/b", 1, 1.0), ("/r/c/x", 1, 1.0), ("/r/d/x", 1, 1.0), ("/r/e", 1, 1.0), ("/q/a", 1, 1.0)], schema)
    disk = spark.createDataFrame([("/r/a", 1, 1.0), ("/r/b", 2, 1.0), ("/r/n", 1, 1.0)], schema)
    pending = spark.createDataFrame([("/r/d/x",)], "path string")
    got = {r.path: r.change for r in live.reconciled(disk, index, "/r", ["/r/c"], pending).collect()}
    assert got == {"/r/a": "same", "/r/b": "changed", "/r/n": "added", "/r/c/x": "kept", "/r/d/x": "kept", "/r/e": "removed"}


def test_stream_of_a_key_in_many_frames(spark, tmp_path):
    """A key with more rows than one frame holds, in no order."""
    rows = spark.range(3_000).select((F.col("id") % 2).alias("user_id"), F.timestamp_millis(1_700_000_000_000 + (F.col("id") * 7919 % 3_001) * 900).alias("ts"), F.col("id").alias("event_id"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "100")
    try:
        got = live.replayed(spark, f"{tmp_path}/events.parquet", "user_id", 2_000, 30_000)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, live.debounced(rows, "user_id", quiet=2_000, forced=30_000).collect()))
    finally:
        spark.conf.set(limit, before)
