"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: For the dropped_after() that is open in this thread: the folders made since.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scratch_scope", default=None)


def shared(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir`` or set as the context's checkpoint folder; there is no machine-local stand-in."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return path.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate data; an open dropped_after() deletes it."""
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    made = _SCOPE.get()
    if made is not None:
        made.append(path)
    return path


@contextmanager
def dropped_after(spark: SparkSession):
    """Deletes what is stored inside the block when it ends, also after an error; frames over it can not be computed afterwards."""
    made: list[str] = []
    before = _SCOPE.set(made)
    try:
        yield
    finally:
        _SCOPE.reset(before)
        for path in made:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Writes a frame once and reads it back: what follows never computes it again, whichever executors are lost."""
    spark = frame.sparkSession
    path = fresh(spark, name)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
