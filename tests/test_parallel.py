"""Sequential rules as parallel plans: chunk starts by doubling, the throttle by segments, percentiles of bounded samples."""

import random

import pytest
from pyspark.sql import functions as F

from folioscan import catalog, oracle_sql
from folioscan.operators import chunks, timings
from folioscan.streaming import live


def test_chunks_by_doubling(spark):
    rng = random.Random(4)
    docs = {d: ["".join(rng.choice("ab\U0001f600é") for _ in range(rng.choice([0, 1, 5, 30, 90]))) for _ in range(n)] for d, n in enumerate([1, 2, 3, 50, 400, 0, 7])}
    rows = [(d, 3 * i, text) for d, texts in docs.items() for i, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "document_id int, ordinal int, content string").repartition(5)
    for limit in (40, 100, 10**6):
        got = {(r.document_id, r.ordinal): (r.size, r.chunk) for r in chunks.chunked(df, limit).collect()}
        want = {}
        for d, texts in docs.items():
            sizes = [len(t.encode("utf-16-be")) // 2 for t in texts]
            want |= {(d, 3 * i): (s, c) for i, (s, c) in enumerate(zip(sizes, chunks.chunk_numbers(sizes, limit), strict=True)) if c is not None}
        assert got == want
    assert chunks.chunked(df.limit(0), 40).count() == 0


def test_prepared_groups_by_doubling(spark):
    rng, rows, want = random.Random(7), [], {}
    for root, n in (("a", 300), ("b", 1), ("c", 60)):
        number, held, count = 0, 0, 0
        for i in range(n):
            size = rng.choice([None, 0, 3, 40, 90, 150])
            if count == 6 or count and held + (size or 0) > 100:
                number, held, count = number + 1, 0, 0
            held, count = held + (size or 0), count + 1
            rows.append((root, f"p{i}", size, i))
            want[root, f"p{i}"] = number
    df = spark.createDataFrame(rows, "root string, path string, chars int, seq int").repartition(5)
    assert {(r.root, r.path): r.group for r in live.prepared_groups(df, 6, 100).collect()} == want
    assert live.prepared_groups(df.limit(0), 6, 100).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_throttle_by_segments(spark, seed):
    rng = random.Random(seed)
    rows, want = [], []
    for key in range(6):
        at, times = 0, []
        for _ in range(rng.randrange(1, 300)):
            at += rng.choice([0, 500, 2_000, 6_000, 70_000, 200_000])
            times.append(at)
        rows += [(f"k{key}", t) for t in times]
        want.append((f"k{key}", len(times), sum(live.throttle(times))))
    df = spark.createDataFrame(rows, "key string, ms long").select("key", F.timestamp_millis("ms").alias("ts"))
    assert sorted(map(tuple, live.rescans(df, "key").collect())) == sorted(want)


def test_one_key_is_many_segments(spark):
    rows = [("hot", 100_000 * i + j * 1000) for i in range(200) for j in range(12)]
    df = spark.createDataFrame(rows, "key string, ms long").select("key", F.timestamp_millis("ms").alias("ts"))
    assert tuple(live.rescans(df, "key").first()) == ("hot", 2400, sum(live.throttle([t for _, t in rows])))
    requests = spark.createDataFrame([("a", 5), ("b", 9), ("a", 11), ("c", 2)], "key string, at long")
    assert [r.key for r in live.kept_keys(requests, 2).collect()] == ["a", "b"]


def test_percentiles_of_a_bounded_sample(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") < 59_990, "hot").otherwise("few").alias("key"), (F.col("id") % 1000).cast("double").alias("value"), "id")
    assert timings.sampled(rows, "key", 500).groupBy("key").count().orderBy("key").collect()[1]["count"] == 500
    got = {r.key: r for r in timings.summary(rows, "key", "value", 2000).collect()}
    assert got["few"].p50 == 994.0 and got["few"].n == 10 and got["hot"].n == 59_990 and got["hot"].most == 999.0
    assert abs(got["hot"].p50 - 500) < 60 and abs(got["hot"].p95 - 950) < 30
    plan = timings.sampled(rows, "key", 500)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before and behind the shuffle


def test_rules_of_many_roots(spark):
    """As one root after the other with its own rules."""
    from folioscan.functions import paths

    texts = {"/a": "*.log\nbuild/\n/src/**/x?.txt", "/b": "doc*/\n*.TXT", "/c": "# none"}
    names = ["x.log", "build", "build/y.txt", "src/x1.txt", "src/d/e/x2.txt", "docs/a.log", "docs", "A.txt", "sub\\\\build\\\\z.md", "docsfile"]
    rows = [(r, n, f) for r in (*texts, "/d") for n in names for f in (False, True)]
    df = spark.createDataFrame(rows, "root string, relative string, is_folder boolean")
    got = {tuple(r)[:3]: r.pattern for r in paths.ignored_by_roots(df, paths.rule_table(spark, texts)).select("root", "relative", "is_folder", "pattern").collect()}
    want = {}
    for root in (*texts, "/d"):
        mine = df.filter(F.col("root") == root)
        want |= {tuple(r)[:3]: r.pattern for r in mine.withColumn("pattern", paths.ignored_by("relative", F.col("is_folder"), paths.ignore_rules(texts.get(root, "")))).collect()}
    assert got == want and len(got) == len(rows) and len({p for p in got.values() if p}) == 5


@pytest.mark.parametrize("name", ["ignore_rules_roots", "chunk_assignment", "rescan_throttle", "intake_batches", "prepared_groups", "html_blocks", "html_titles", "timing_percentiles", "live_status", "stream_queue", "reconcile_resumed"])
def test_twins(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "events", "pages"):
        con.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    found = catalog.QUERIES[name](spark, sf)
    columns = sorted(found.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({oracle_sql.ORACLE_SQL[name]})").fetchall() if hasattr(oracle_sql, "ORACLE_SQL") else con.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, found.select(*columns).collect()), key=str) == sorted(want, key=str)


def test_percentiles_of_all_rows(spark):
    """Exact, with more rows of a key than a sample holds, few distinct values, nulls, a null key and keys of one row or none."""
    value = F.when(F.col("id") % 50 == 7, None).otherwise((F.col("id") * 7919 % 60_013).cast("double"))
    rows = spark.range(60_000).select(F.lit("hot").alias("key"), value.alias("value"))
    rows = rows.union(spark.range(50_000).select(F.lit(None).cast("string"), F.when(F.col("id") < 40_000, 1.0).otherwise(2.0)))
    rows = rows.union(spark.createDataFrame([("one", 3.0), ("none", None)], "key string, value double"))
    held: dict = {}
    for key, v in rows.collect():
        held.setdefault(key, []).extend([] if v is None else [v])
    nearest = lambda v, p: sorted(v)[max(1, -(-len(v) * p // 100)) - 1] if v else None
    got = {r.key: (r.n, r.p50, r.p95) for r in timings.summary(rows, "key", "value").collect()}
    assert got == {k: (len(v), nearest(v, 50), nearest(v, 95)) for k, v in held.items()}
