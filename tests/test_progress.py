"""Status rows of a stream that is replayed, with late rows and a restart."""

import datetime

from pyspark.sql import functions as F

from folioscan.streaming import progress

T0 = datetime.datetime(2024, 1, 1)


def test_rows_of_a_replayed_stream(spark, tmp_path):
    put = lambda seconds: spark.createDataFrame([(s % 3, T0 + datetime.timedelta(seconds=s)) for s in seconds], "key int, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    runs = []

    def run(heard):
        source = spark.readStream.schema("key int, at timestamp").parquet(str(tmp_path / "in")).withWatermark("at", "10 seconds")
        counts = source.observe("seen", F.count(F.lit(1)).alias("n")).groupBy("key", F.window("at", "5 seconds")).count()
        query = counts.writeStream.format("noop").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        runs.append(str(query.runId))
        assert heard.wait(runs[-1])

    with progress.listening(spark) as heard:
        put(range(60))
        run(heard)
        put([100])
        run(heard)
        put([3, 4, 101])  # two of them behind the watermark
        run(heard)
        rows = heard.table(spark)
        told = progress.status(rows).collect()
        assert len(told) == 1 and (told[0].runs, told[0].rows, told[0].dropped) == (3, 64, 2)
        assert told[0].watermark == T0 + datetime.timedelta(seconds=90) or told[0].watermark == T0 + datetime.timedelta(seconds=91)
        assert told[0].state_rows >= 1 and told[0].slowest > 0
        assert '"n": 60' in rows.filter("rows = 60").first().observed
        heard.append(spark, str(tmp_path / "status"))
        assert not heard.rows
    stored = spark.read.parquet(str(tmp_path / "status"))
    assert stored.select(F.sum("rows")).first()[0] == 64 and {r.run for r in stored.collect()} == set(runs)


def test_a_bounded_number_of_rows():
    heard = progress.Progress(most=3)
    for b in range(10):
        heard.rows.append((b,))
    assert [r[0] for r in heard.rows] == [7, 8, 9]
