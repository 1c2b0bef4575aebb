"""Events as a log that streams take up in bounded batches, from any place on.

``append`` writes events in order as segments of at most ``SEGMENT`` rows and
then an index of them (one row a segment); an index folder counts when it is
whole, so an append that failed leaves nothing that is read. The offset of a
stream is the number of a row in the log.

Where a batch ends depends on the log and on where it starts only: it takes
rows while they are at most ``items``, together at most ``size`` bytes and less
than ``span`` milliseconds behind its first one, and one row at least. So a
replay from the start of any batch gives the same batches. Finding that place
reads two columns of the segments that the batch touches; the rows themselves
are read by tasks, one a segment.

A micro-batch of Spark takes one batch, or (``ahead``) up to so many, each row
with the number of its batch, so that small batches do not cost a job each.

Spark does not tell a source where a stream that starts again stands, so the
reader notes the end of every batch that is planned in a ``cursor`` beside the
checkpoint. Spark has written that end to its own log before and plans an
unfinished batch again with the same ends, so both never part.

The folders have to be ones that pyarrow reaches (mounted, or by its own
remote filesystems).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StructField

#: Rows of a segment at most.
SEGMENT = 10_000
# Rows, bytes and milliseconds of a batch.
ITEMS, SIZE, SPAN = 500, 8_000_000, 5_000


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _generations(log: str) -> list[tuple[int, str]]:
    """(first row, folder) of the parts of the index that are whole, in order."""
    store, path = _place(f"{log}/index")
    whole = [i for i in store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)) if i.base_name == "_SUCCESS"]
    folders = [i.path.rpartition("/")[0] for i in whole]
    return sorted((int(f.rpartition("/")[2]), f) for f in folders)


def _segments(log: str, row: int) -> Iterator[tuple[int, int, str]]:
    """(first row, end, file) of the segments that hold ``row`` or rows behind it, in order, read as far as they are asked for."""
    store, _ = _place(log)
    parts = _generations(log)
    begun = max((n for n, (first, _) in enumerate(parts) if first <= row), default=0)
    for _, folder in parts[begun:]:
        scan = ds.dataset(folder, filesystem=store, format="parquet").scanner(columns=["first", "end", "file"], filter=ds.field("end") > row, batch_readahead=1, fragment_readahead=1)
        for batch in scan.to_batches():
            yield from zip(*(batch.column(c).to_pylist() for c in ("first", "end", "file")), strict=True)


def length(log: str) -> int:
    """Rows of the log."""
    parts = _generations(log)
    if not parts:
        return 0
    return max((end for _, end, _ in _segments(log, parts[-1][0])), default=parts[-1][0])


def append(events: DataFrame, log: str, segment: int = SEGMENT) -> int:
    """Puts events (at_ms, seq, size, ..) behind those of the log, by at_ms and seq, nulls first; returns the rows of the log.

    One writer at a time. An event that is older than the end of the log stands
    behind it all the same: a log is in order of arrival.
    """
    spark, first = events.sparkSession, length(log)
    name = f"{first:020d}-{uuid.uuid4().hex}"
    order = events.repartitionByRange("at_ms", "seq").sortWithinPartitions("at_ms", "seq")
    order.write.option("maxRecordsPerFile", segment).option("compression", "zstd").parquet(f"{log}/rows/{name}")
    part, piece = (F.regexp_extract("file", p, 1).cast("long") for p in (r"part-(\d+)-", r"\.?c(\d+)\."))
    files = spark.read.schema(events.schema).parquet(f"{log}/rows/{name}").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"))
    end = F.sum("rows").over(Window.orderBy(part, piece)) + first  # one row a segment
    index = files.withColumn("end", end).select((F.col("end") - F.col("rows")).alias("first"), "end", F.concat(F.lit(f"rows/{name}/"), "file").alias("file"))
    index.coalesce(1).sortWithinPartitions("first").write.mode("overwrite").parquet(f"{log}/index/{first:020d}")
    return length(log)


@dataclass
class _Rows(InputPartition):
    file: str
    start: int
    stop: int
    batches: list[tuple[int, int]]  # where a batch ends in the segment, and its number


class EventLogReader(DataSourceStreamReader):
    def __init__(self, options, schema):
        self.log, self.cursor, self.first = options["log"], options["cursor"], int(options.get("first", 0))
        self.bounds = [int(options.get(k, v)) for k, v in (("items", ITEMS), ("size", SIZE), ("span", SPAN))]
        self.ahead, self.schema = int(options.get("ahead", 0)), schema

    def initialOffset(self) -> dict:
        return {"row": self.first, "batch": 0}

    def latestOffset(self) -> dict:
        row, number = self._noted()
        for row in islice(self.ends(row), max(1, self.ahead)):
            number += 1
        return {"row": row, "batch": number}

    def ends(self, row: int) -> Iterator[int]:
        """The ends of the batches from a row on, in order; the last one is the end of the log."""
        items, most, span = self.bounds
        store, base = _place(self.log)
        start, held, begun, here = row, 0, None, row
        for first, _, file in _segments(self.log, row):
            table = pq.read_table(f"{base}/{file}", columns=["at_ms", "size"], filesystem=store).slice(row - first if row > first else 0)
            # a segment is in order of time, nulls first
            nulls, n, here = table.column("at_ms").null_count, len(table), max(first, row)
            times = table.column("at_ms").drop_null().to_numpy()
            sums = np.concatenate([[0], np.cumsum(table.column("size").fill_null(0).to_numpy())])
            at = 0
            while at < n:
                if begun is None and max(at, nulls) < n:
                    begun = int(times[max(at, nulls) - nulls])
                bounds = [start + items - here, np.searchsorted(sums, most - held + sums[at], "right") - 1]
                bounds += [] if begun is None else [nulls + np.searchsorted(times, min(begun + span, np.iinfo(np.int64).max))]
                stop = int(max(min(bounds), at, start + 1 - here))
                if stop >= n:
                    held += int(sums[n] - sums[at])
                    break
                yield here + stop
                start, held, begun, at = here + stop, 0, None, stop
            here += n
        if here > start:
            yield here

    def partitions(self, start: dict, end: dict) -> list[_Rows]:
        self._note(end)
        cuts = [*takewhile(lambda row: row < end["row"], self.ends(start["row"])), end["row"]] if self.ahead else [end["row"]]
        out, k = [], 0
        for first, stop, file in _segments(self.log, start["row"]):
            if first >= end["row"]:
                break
            batches, stop = [], min(stop, end["row"])
            while not batches or batches[-1][0] < stop - first:
                batches.append((min(stop, cuts[k]) - first, start.get("batch", 0) + k))
                k += cuts[k] <= stop
            out.append(_Rows(file, max(0, start["row"] - first), stop - first, batches))
        return out

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        store, base = _place(self.log)
        names = [name for name in self.schema.names if not (self.ahead and name == "batch")]
        table = pq.read_table(f"{base}/{partition.file}", columns=names, filesystem=store)
        table = table.slice(partition.start, partition.stop - partition.start)
        if self.ahead:
            stops, numbers = zip(*partition.batches)
            table = table.append_column("batch", pa.array(np.repeat(numbers, np.diff(stops, prepend=partition.start))))
        yield from table.select(self.schema.names).cast(to_arrow_schema(self.schema)).to_batches()

    def _noted(self) -> tuple[int, int]:
        """(row, number) of the batch that is planned next."""
        store, path = _place(self.cursor)
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return self.first, 0
        with store.open_input_stream(path) as file:
            row, _, number = file.read().decode().partition(" ")
        return int(row), int(number or 0)

    def _note(self, end: dict) -> None:
        store, path = _place(self.cursor)
        store.create_dir(path.rpartition("/")[0])
        with store.open_output_stream(f"{path}.new") as file:
            file.write(f"{end['row']} {end.get('batch', 0)}".encode())
        store.move(f"{path}.new", path)


class EventLog(DataSource):
    """``spark.readStream.format("event_log")`` with the options log, cursor, first, items, size, span and ahead."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def streamReader(self, schema) -> EventLogReader:
        return EventLogReader(self.options, schema)


def run(spark: SparkSession, log: str, home: str, handle: Callable[[DataFrame, int], None], first: int = 0, once: bool = False, ahead: int = 0, **bounds: int) -> None:
    """Hands the batches of a log to ``handle(frame, number)``, from where the stream of ``home`` stands to the end of the log, or (``once``) one batch.

    With ``ahead`` a frame holds up to so many batches, its column ``batch`` the number of each row's (from 0, in the whole stream).

    ``first`` is the row at which a new stream begins; ``bounds`` are items, size and span.
    A batch may be handed over again after a failure, under the same number.
    """
    if not length(log):
        return
    spark.dataSource.register(EventLog)
    schema = spark.read.option("recursiveFileLookup", "true").parquet(f"{log}/rows").schema
    if ahead:
        schema = schema.add(StructField("batch", LongType()))
    source = spark.readStream.format("event_log").schema(schema).options(log=log, cursor=f"{home}/cursor/row", first=first, ahead=ahead, **bounds).load()
    writer = source.writeStream.foreachBatch(handle).option("checkpointLocation", f"{home}/checkpoint")
    if once:  # a source without limits of its own is asked for its newest offset once
        writer.trigger(availableNow=True).start().awaitTermination()
        return
    query = writer.start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
