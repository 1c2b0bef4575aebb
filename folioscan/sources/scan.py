"""Lists a folder tree level by level: folders of a level are a table, and each task lists its share of them.

Nothing of the tree is held by the driver but the folders that could not be
read. Folders that a rule keeps out are not entered; links are never followed.
The tree has to be mounted on the executors.
"""

from __future__ import annotations

import os
import stat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..plans.scratch import stored

ENTRIES = "path string, is_folder boolean, is_link boolean, size_bytes long, modified_at_ms double, failed boolean"
#: Folders that one task lists at least, so that a level of few folders is few tasks.
FOLDERS_A_TASK = 64

# Folders of the operating system that are never a root.
SYSTEM = ("/bin", "/boot", "/dev", "/etc", "/lib", "/lib64", "/proc", "/run", "/sbin", "/sys")


class RootError(ValueError):
    def __init__(self, code: str, path: str):
        super().__init__(f"{code}: {path}")
        self.code = code


def validated(path: str, is_folder=os.path.isdir, exists=os.path.exists) -> str:
    """The folder as an absolute path without a trailing slash; RootError if it cannot be a root."""
    root = os.path.normpath(path) if path.startswith("/") else ""
    if not root:
        raise RootError("ROOT_NOT_ABSOLUTE", path)
    if any(paths.covers(s, root) for s in SYSTEM):
        raise RootError("ROOT_IS_SYSTEM", root)
    if not exists(root):
        raise RootError("ROOT_NOT_FOUND", root)
    if not is_folder(root):
        raise RootError("ROOT_NOT_A_FOLDER", root)
    return root


def entries_of(folder: str) -> list[tuple]:
    """ENTRIES of one folder; a folder that cannot be read gives itself with ``failed``, an entry that is gone by now nothing."""
    out = []
    try:
        with os.scandir(folder) as found:
            for entry in found:
                try:
                    info = entry.stat(follow_symlinks=False)
                except FileNotFoundError:
                    continue
                link = stat.S_ISLNK(info.st_mode)
                folder_ = stat.S_ISDIR(info.st_mode)
                if link or folder_ or stat.S_ISREG(info.st_mode):
                    out.append((entry.path, folder_, link, info.st_size, float(info.st_mtime_ns // 1_000_000), False))
    except OSError:
        out.append((folder, True, False, 0, 0.0, True))
    return out


def _level(folders: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in ENTRIES.split(", ")]
    types = [pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.float64(), pa.bool_()]

    def run(batches):
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = entries_of(folder)
                for lo in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 10_000]), types)], names=names)

    return folders.select("path").mapInArrow(run, ENTRIES)


def seen_again(files: DataFrame) -> DataFrame:
    """(path, size_bytes, modified_at_ms) of the files (path) as they are now; those that are gone are left out."""

    def run(batches):
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    info = os.stat(path, follow_symlinks=False)
                    rows.append((path, info.st_size, float(info.st_mtime_ns // 1_000_000)))
                except OSError:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 3, (pa.string(), pa.int64(), pa.float64()), strict=True)], names=["path", "size_bytes", "modified_at_ms"])

    return files.select("path").mapInArrow(run, "path string, size_bytes long, modified_at_ms double")


def scanned(spark: SparkSession, start: str, root: str, rules: list, own=lambda path: F.lit(False), rules_file: str | None = None) -> tuple[DataFrame, list[str]]:
    """((path, relative, filename, extension, size_bytes, modified_at_ms, rule) of each file and each folder kept out below ``start``, folders that could not be read).

    ``rule`` is null for sources. Folders that could not be read are few by nature; they come back to the driver as protected scopes.
    """
    folders, kept, failed = spark.createDataFrame([(start,)], "path string"), None, []
    relative = F.expr(f"substr(path, {len(root.rstrip('/')) + 2})")
    while True:
        rows = _level(folders).withColumn("relative", relative)
        artifact = own("path") | (F.col("relative") == rules_file if rules_file else F.lit(False))
        rows = stored(rows.withColumn("rule", F.when(~F.col("failed"), paths.excluded_by("relative", F.col("is_folder"), F.col("is_link"), artifact, rules))), "scan")
        failed += [r.path for r in rows.filter("failed").select("path").collect()]
        files = rows.filter("not failed and (not is_folder or rule is not null)")
        kept = files if kept is None else kept.unionByName(files)
        inner = rows.filter("is_folder and not failed and rule is null").select("path")
        n = inner.count()
        if not n:
            break
        folders = inner.repartition(max(1, min(10_000, n // FOLDERS_A_TASK)))
    name = F.element_at(F.split("path", "/"), -1)
    shown = kept.select("path", "relative", name.alias("filename"), F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)).alias("extension"), "size_bytes", "modified_at_ms", "rule")
    return shown, sorted(failed)
