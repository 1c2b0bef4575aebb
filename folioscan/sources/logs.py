"""Log files as tables: session logs and rotated trace logs."""

from __future__ import annotations

import glob
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How many files and how much of them is read.
SESSION_FILES, SESSION_BYTES = 200, 64 << 20
TRACE_FILES, TRACE_BYTES, TRACE_ROWS = 5, 2 << 20, 500

TRACE = "type string, status string, startedAt string, completedAt string, durationMs double, phasesMs map<string, double>, counts map<string, double>"


def session_lines(spark: SparkSession, folder: str, pattern: str = "rollout-*.jsonl") -> DataFrame:
    """(session, line, value) of the newest session logs by path; larger files than 64 MiB are left out.

    The logs are listed first and only the chosen ones, at most 200, are opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    chosen = [r.path for r in files.filter(F.col("length") <= SESSION_BYTES).select("path").orderBy(F.col("path").desc()).limit(SESSION_FILES).collect()]
    if not chosen:
        return spark.createDataFrame([], "session string, line int, value string")
    rows = spark.read.option("wholetext", True).text(chosen).withColumn("session", F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/"))
    return rows.select("session", F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))


def read_traces(spark: SparkSession, folder: str, kind: str | None = None, status: str | None = None, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """(the newest traces, the number of lines that are no traces) of the rotated files below ``folder``."""
    lines = spark.read.option("recursiveFileLookup", True).text(folder).filter("value <> ''")
    parsed = lines.select(F.from_json("value", TRACE).alias("t"))
    good = F.col("t.type").isin("search", "answer") & F.col("t.completedAt").isNotNull()
    errors = parsed.agg(F.sum(F.when(F.coalesce(good, F.lit(False)), 0).otherwise(1)).alias("parse_errors"))
    rows = parsed.filter(good).select("t.*")
    rows = rows.filter(F.col("type") == kind) if kind else rows
    rows = rows.filter(F.col("status") == status) if status else rows
    return rows.orderBy(F.col("completedAt").desc()).limit(min(TRACE_ROWS, max(1, limit))), errors


def append_traces(traces: DataFrame, folder: str) -> None:
    """Appends traces as JSON lines, one new file a call."""
    traces.coalesce(1).write.mode("append").json(folder)


def kept_files(files: DataFrame) -> DataFrame:
    """Of files (path, length, modified_at) the newest that rotation keeps: five, and no more than 2 MiB each."""
    return files.filter(F.col("length") <= TRACE_BYTES).orderBy(F.col("modified_at").desc(), F.col("path").desc()).limit(TRACE_FILES)


def rotated(folder: str, files: int = TRACE_FILES, size: int = TRACE_BYTES) -> list[str]:
    """Deletes the older trace files of a folder on this machine until ``files`` are left, and those above ``size``; returns what went."""
    found = [(os.stat(p).st_mtime_ns, os.stat(p).st_size, p) for p in glob.glob(f"{folder}/*.json*")]
    small = sorted((f for f in found if f[1] <= size), reverse=True)
    gone = [f[2] for f in found if f[1] > size] + [f[2] for f in small[files:]]
    for path in gone:
        os.remove(path)
    return sorted(gone)


# Fixed value: bytes of an index profile.
PROFILE_BYTES = 1 << 20


def write_profile(path: str, status: dict, roots: list[str]) -> None:
    """Writes counts of an index for a report: roots under the names R1, R2, .., no paths, never over an existing file, 1 MiB at most."""
    names = {root: f"R{i}" for i, root in enumerate(sorted(roots), 1)}
    shown = {k: v for k, v in status.items() if k in ("schemaVersion", "dataVersion", "counts", "extensions")}
    text = json.dumps(shown | {"roots": sorted(names.values()), "issues": len(status.get("issues", []))}, sort_keys=True) + "\n"
    if len(text.encode("utf-8")) > PROFILE_BYTES:
        raise ValueError("the profile is too large")
    with open(path, "x", encoding="utf-8") as out:
        out.write(text)
