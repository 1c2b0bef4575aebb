"""A reconcile that can stop and go on: both states are sorted once, each round reads the next ranges only.

``begin`` deals the paths of both states to ranges, the same for both, and
writes them sorted, a folder for each range: the one pass over both states. A
round reads the next ranges and no others, compares them by a merge of their
rows, hands the changes to its caller and then writes the frontier. A stop before that repeats the round;
a stop after it goes on behind it. Removals are kept back until every range of
the scope has been seen, as only then it is known that nothing was missed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import below
from ..plans.scratch import shared
from ..plans.snapshot import SnapshotStore

CHANGES = "path string, change string"
#: Rows of both states in a range, about.
RANGE_ROWS = 100_000
_ROW = "path string, size_bytes long, modified_at_ms double, here boolean"


class Reconcile:
    """One reconcile of a scope, in the folder ``home``; a new object on the same folder goes on where the last one stopped."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home.rstrip("/")
        self._files = SnapshotStore(spark, self.home)  # small files that are created once
        self.ranges_read: list[int] = []

    @classmethod
    def begin(cls, disk: DataFrame, index: DataFrame, scope: str, home: str | None = None, range_rows: int = RANGE_ROWS) -> Reconcile:
        """Writes both states (path, size_bytes, modified_at_ms) of a scope in ranges of paths."""
        spark = disk.sparkSession
        home = home or f"{shared(spark)}/reconcile-{uuid.uuid4().hex}"
        one = lambda rows, here: rows.filter(below("path", scope)).select("path", F.col("size_bytes").cast("long"), F.col("modified_at_ms").cast("double"), F.lit(here).alias("here"))
        both = one(disk, True).unionByName(one(index, False))
        ranges = max(1, -(-both.count() // range_rows))
        dealt = both.repartitionByRange(ranges, "path").sortWithinPartitions("path", "here").withColumn("range", F.spark_partition_id())
        dealt.sortWithinPartitions("range", "path", "here").write.option("compression", "zstd").partitionBy("range").parquet(f"{home}/rows")
        self = cls(spark, home)
        self._files._create(f"{self.home}/plan/{1:012d}.json", f'{{"ranges": {ranges}}}\n')
        return self

    @property
    def ranges(self) -> int:
        return self._files._small("plan", 1)["ranges"]

    @property
    def frontier(self) -> int:
        """The first range that no round has finished."""
        last = self._files._newest("frontier")
        return last["next"] if last else 0

    @property
    def complete(self) -> bool:
        return self.frontier >= self.ranges

    def _changes(self, first: int, behind: int) -> DataFrame:
        """(path, change) of some ranges: added, changed or removed."""
        rows = self.spark.read.schema(f"{_ROW}, range int").parquet(f"{self.home}/rows").filter(F.col("range").between(first, behind - 1))
        self.ranges_read += range(first, behind)

        def merged(batches):
            """The rows of a path stand together, the index's before the disk's."""
            held = None
            for batch in batches:
                out = []
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held is not None and held[0] == row[0]:
                        if held[1:3] != row[1:3]:
                            out.append((row[0], "changed"))
                        held = None
                        continue
                    if held is not None:
                        out.append((held[0], "added" if held[3] else "removed"))
                    held = row
                yield _changed(out)
            if held is not None:
                yield _changed([(held[0], "added" if held[3] else "removed")])

        # a range may be several splits of files, so the rows of these ranges are dealt once more
        return rows.select("path", "size_bytes", "modified_at_ms", "here", "range").repartition("range").sortWithinPartitions("range", "path", "here").drop("range").mapInArrow(merged, CHANGES)

    def round(self, handle: Callable[[DataFrame, int], None], most: int = 1) -> bool:
        """Compares the next ``most`` ranges, gives added and changed paths to ``handle`` with the number of the first range, and moves the frontier.

        ``handle`` may see a round twice, under the same number. True if there is more to do.
        """
        first = self.frontier
        behind = min(self.ranges, first + most)
        if first >= behind:
            return False
        self._changes(first, behind).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.home}/changes/from={first}")
        found = self.spark.read.schema(CHANGES).parquet(f"{self.home}/changes/from={first}")
        handle(found.filter("change <> 'removed'"), first)
        self._files._create(f"{self.home}/frontier/{first + 1:012d}.json", f'{{"next": {behind}}}\n')
        return behind < self.ranges

    def removals(self, unreadable: list[str] = (), pending: DataFrame | None = None) -> DataFrame:
        """(path) of the documents that are gone; those below folders that could not be read, and at or above pending paths, stay."""
        if not self.complete:
            raise RuntimeError(f"range {self.frontier} of {self.ranges} has not been compared")
        gone = self.spark.read.schema(f"{CHANGES}, from int").parquet(f"{self.home}/changes").filter("change = 'removed'").select("path")
        for folder in unreadable:
            gone = gone.filter(~below("path", folder))
        return gone if pending is None else gone.join(pending.select("path"), "path", "left_anti")


def _changed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], names=["path", "change"])
