"""Live status from the streams themselves: each batch's rates, lateness and state, as rows of a table.

A listener on the session hears of every batch of its streams. It keeps the
newest ``most`` rows, and hands them over as a frame or appends them to a
table; what a stream observes (``DataFrame.observe``) comes along as JSON.
"""

from __future__ import annotations

import json
from collections import deque
from contextlib import contextmanager
from datetime import datetime
from threading import Condition

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

ROWS = "query string, name string, run string, batch long, at timestamp, rows long, rows_a_second double, done_a_second double, millis long, watermark timestamp, behind_seconds double, state_rows long, state_bytes long, dropped long, observed string"


def _time(text: str | None):
    return datetime.fromisoformat(text.replace("Z", "+00:00")) if text and not text.startswith("1970") else None


def row_of(progress: dict) -> tuple:
    """One row of ROWS from the progress of a batch: sums over its sources and state operators."""
    times, states = progress.get("eventTime") or {}, progress.get("stateOperators") or []
    mark, newest = _time(times.get("watermark")), _time(times.get("max"))
    total = lambda records, key: sum(max(0, r.get(key) or 0) for r in records)
    sources = progress.get("sources") or []
    return (
        progress["id"], progress.get("name"), progress["runId"], progress["batchId"], _time(progress["timestamp"]), total(sources, "numInputRows"), float(progress.get("inputRowsPerSecond") or 0), float(progress.get("processedRowsPerSecond") or 0),
        int((progress.get("durationMs") or {}).get("triggerExecution", 0)), mark, (newest - mark).total_seconds() if mark and newest else None,
        total(states, "numRowsTotal"), total(states, "memoryUsedBytes"), total(states, "numRowsDroppedByWatermark"), json.dumps(progress.get("observedMetrics") or {}, sort_keys=True),
    )


class Progress(StreamingQueryListener):
    """The newest batches of all streams of a session."""

    def __init__(self, most: int = 10_000):
        self.rows: deque[tuple] = deque(maxlen=most)
        self.ended: set[str] = set()
        self._news = Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self._news:
            self.rows.append(row_of(json.loads(event.progress.json)))

    def onQueryTerminated(self, event) -> None:
        with self._news:
            self.ended.add(str(event.runId))
            self._news.notify_all()

    def wait(self, run: str, seconds: float = 30.0) -> bool:
        """Until all is heard of a run that has ended; what a listener hears comes a little later than what happens."""
        with self._news:
            return self._news.wait_for(lambda: run in self.ended, seconds)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), ROWS)

    def append(self, spark: SparkSession, path: str) -> None:
        """Appends the rows to a table and forgets them."""
        with self._news:
            rows, _ = list(self.rows), self.rows.clear()
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(path)


@contextmanager
def listening(spark: SparkSession, most: int = 10_000):
    """A Progress that hears the streams of the session while the block runs."""
    heard = Progress(most)
    spark.streams.addListener(heard)
    try:
        yield heard
    finally:
        spark.streams.removeListener(heard)


def status(progress: DataFrame) -> DataFrame:
    """One row a query: batches, rows, slowest batch, rows dropped as too late, and watermark, lag and state of its newest batch."""
    newest = F.max_by(F.struct("watermark", "behind_seconds", "state_rows", "state_bytes"), F.struct("at", "batch")).alias("newest")
    totals = progress.groupBy("query").agg(F.count_distinct("run").alias("runs"), F.count("*").alias("batches"), F.sum("rows").alias("rows"), F.max("millis").alias("slowest"), F.sum("dropped").alias("dropped"), newest)
    return totals.select("query", "runs", "batches", "rows", "slowest", "dropped", "newest.*")
