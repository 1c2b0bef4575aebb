"""Helpers that several corpus operators use.

Every path goes through Spark's own readers and writers, so inputs and
intermediate tables may live in any store that Spark can open.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession

#: Stands for a null id inside operators: larger than any id that a table holds.
NULL_ID = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent and Spark runs in one process (tests) a
    temporary folder stands in; it is also set as the checkpoint folder of the
    context. On a cluster no machine-local folder is ever used.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="folioscan-"))
    return context.getCheckpointDir().rstrip("/")


#: For the dropped_after() that is open in this thread or task: the intermediate folders made since.
_SCOPE: ContextVar[list[str] | None] = ContextVar("folioscan_scope", default=None)


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    made = _SCOPE.get()
    if made is not None:
        made.append(path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate folder and the table over it, if there is one."""
    name = path.rpartition("/")[2].replace("-", "_")
    if spark.catalog.tableExists(name):
        spark.sql(f"DROP TABLE {name}")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def dropped_after(spark: SparkSession):
    """Deletes what operators store inside the block when it ends: write the result inside, frames of it can not be computed afterwards."""
    made: list[str] = []
    before = _SCOPE.set(made)
    try:
        yield
    finally:
        _SCOPE.reset(before)
        for path in made:
            drop(spark, path)


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back.

    This cuts the lineage with files that outlive the executors that wrote
    them, so a lost executor costs a re-read and never a recomputation.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_and_told(df: DataFrame, name: str, **told) -> tuple[DataFrame, dict]:
    """The same with aggregates of the rows, taken while they are written."""
    seen = Observation()
    out = stored(df.observe(seen, *[c.alias(k) for k, c in told.items()]), name)
    return out, seen.get


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(columns, *wanted: str) -> list[str]:
    """Names for helper columns that no column of a table has, in any case of letters."""
    taken, found = {c.lower() for c in columns}, []
    for name in wanted:
        given, n = f"folio_{name}", 0
        while given in taken:
            given, n = f"folio_{name}_{n}", n + 1
        taken.add(given)
        found.append(given)
    return found


def word_list(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes; bytes.split() splits at just these six characters."""
    return text.split()


def lower_ascii(text: bytes) -> bytes:
    """A-Z to a-z; bytes.lower() leaves every other byte as it is."""
    return text.lower()


def release() -> None:
    """Gives memory that this process no longer uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def settle(spark: SparkSession) -> None:
    """Lets the driver collect its garbage: Spark drops shuffles and broadcasts of steps that are over only when their frames are collected."""
    gc.collect()
    spark._jvm.System.gc()


def freeing(batches_of):
    """Wraps a function on batches: Python workers are kept between tasks, so each task ends with a release()."""

    @wraps(batches_of)
    def run(batches):
        try:
            yield from batches_of(batches)
        finally:
            release()

    return run
