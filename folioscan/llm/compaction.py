"""Executed bin-packed compaction: many small Parquet files a day become few, by a plan over their footers.

1. ``write_daily`` deals the rows into files by (day, lot, piece): one shuffle
   by that key, an external sort inside the tasks, and an Arrow task that
   streams its sorted rows and opens a new file at every change of the key.
   What a file is (day, lot, piece, its sources) stands in its footer.
2. ``manifest`` reads the footers in parallel tasks.
3. ``packed`` goes through the manifest on the driver: first-fit decreasing
   within each day, a linear scan over the groups that are open.
4. ``merge`` runs one Arrow task for each group, which streams its sources one
   after the other into one file below ``_staged``. Only when all of them are
   there, a second job moves them into place and deletes their sources; both
   steps can be repeated, so a lost executor costs its own tasks only.

What goes through the driver is one row a file. File sizes are shares of the
table (``share(rows, x)``), so a table has at most 4 * (days + ``parts``)
files, however many rows it has. The counts by day that are broadcast have a
row for each day of the calendar at most.

Files are written through ``pyarrow.fs``: local and mounted folders, HDFS (also
viewfs), S3, GCS. A file appears under its name only when it is whole.

Defined results
    null time            a day of its own (null), written as ``none``
    null id              counts as the empty text in the hash and in ids_sha256
    null, NaN, infinite value   0 cents
    repeated rows        all kept; equal (time, id) stand in any order
    empty table          no file, no rows
    columns named like the helpers   the helpers take other names
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, freeing, fresh_path

#: Bytes of Arrow data that make a row group.
GROUP_BYTES = 32 << 20
STAGED = "_staged"
MARKS = ("day", "lot", "piece", "sources")


def share(rows: int, x: int) -> int:
    """S(x): rows that a file of a 1/x share of the table may hold."""
    return 1 + rows // x


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the folder's place in it."""
    local = re.match(r"file:/+(.*)", folder)
    if local or "://" not in folder:
        return pafs.LocalFileSystem(), "/" + local[1] if local else folder
    return pafs.FileSystem.from_uri(folder)


class _Writer:
    """Streams batches into one file that gets its name when it is closed."""

    def __init__(self, fs: pafs.FileSystem, path: str, schema: pa.Schema, marks: dict[str, str]):
        self.fs, self.path = fs, path
        where, _, name = path.rpartition("/")
        self.at = f"{where}/.{name}.{uuid.uuid4().hex}"
        told = (schema.metadata or {}) | {f"folio.{k}".encode(): v.encode() for k, v in marks.items()}
        self.out = pq.ParquetWriter(self.at, schema.with_metadata(told), filesystem=fs, compression="zstd")
        self.held: list[pa.RecordBatch] = []
        self.bytes = self.rows = 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.held.append(batch)
        self.bytes += batch.nbytes
        self.rows += batch.num_rows
        if self.bytes >= GROUP_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            table = pa.Table.from_batches(self.held)
            self.out.write_table(table.cast(self.out.schema), row_group_size=max(1, table.num_rows))
        self.held, self.bytes = [], 0

    def close(self) -> int:
        self._flush()
        self.out.close()
        self.fs.move(self.at, self.path)
        return self.rows


def write_daily(df: DataFrame, folder: str, time: str = "arrived_at", key: str = "click_id", parts: int = 150) -> int:
    """Writes ``df`` to the new ``folder``, a file for each (day, lot, piece) that occurs; returns the rows of the table."""
    spark, columns = df.sparkSession, df.columns
    day, lot, piece, hashed, of_day, same_day = free_names(columns, "day", "lot", "piece", "hash", "of_day", "same_day")
    dated = df.withColumn(day, F.unix_date(F.col(f"`{time}`").cast("date")))
    days = dated.groupBy(day).count().collect()
    rows = sum(n for _, n in days)
    if not rows:
        return 0
    a_lot = share(rows, parts)
    counts = spark.createDataFrame([(d, 1 + n // a_lot) for d, n in days], f"{same_day} int, {of_day} long")
    dealt = (
        dated.join(F.broadcast(counts), F.col(day).eqNullSafe(F.col(same_day)))
        .withColumn(hashed, F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")))
        .withColumn(lot, F.floor(F.col(hashed) / 16) % F.col(of_day))
        .withColumn(piece, F.least(F.col(hashed) % 4, F.floor(F.col(hashed) / 4) % 4))
        .select(*[F.col(f"`{c}`") for c in columns], day, lot, piece)
        .repartition(day, lot, piece).sortWithinPartitions(day, lot, piece, f"`{time}`", f"`{key}`")
    )
    width = len(columns)

    @freeing
    def files(batches):
        fs, base = opened(folder)
        fs.create_dir(base, recursive=True)
        now, out = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = [batch.column(width + i).to_pylist() for i in range(3)]
            keys = list(zip(*marks, strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            body = batch.select(range(width))
            for b, e in zip(cuts[:-1], cuts[1:], strict=True):
                if keys[b] != now:
                    if out is not None:
                        yield _written(out)
                    now = keys[b]
                    d, n, p = ("none" if x is None else str(x) for x in now)
                    out = _Writer(fs, f"{base}/day-{d}-lot-{n}-piece-{p}.parquet", body.schema, {"day": d, "lot": n, "piece": p, "sources": f"{n}-{p}"})
                out.add(body.slice(b, e - b))
        if out is not None:
            yield _written(out)

    dealt.mapInArrow(files, "path string, n_rows long").write.format("noop").mode("overwrite").save()
    return rows


def _written(out: _Writer) -> pa.RecordBatch:
    rows = out.close()
    return pa.RecordBatch.from_pydict({"path": [out.path], "n_rows": [rows]})


def names(folder: str) -> list[str]:
    """The data files of a folder; hidden ones are left out, as Spark does."""
    fs, base = opened(folder)
    return sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if x.is_file and x.base_name[0] not in "._")


def _tasks(spark: SparkSession, rows: list[tuple], schema: str, most: int) -> DataFrame:
    """Rows of a plan, at most ``most`` tasks."""
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, min(len(rows), most))), schema)


def _footer(file: pq.ParquetFile) -> dict:
    told = file.metadata.metadata or {}
    marks = {k: told.get(f"folio.{k}".encode(), b"").decode() for k in MARKS}
    return {k: None if marks[k] in ("", "none") else int(marks[k]) for k in MARKS[:3]} | {"sources": marks["sources"], "n_rows": file.metadata.num_rows}


def manifest(spark: SparkSession, folder: str) -> list[dict]:
    """name, day, lot, piece, sources and n_rows of each file, from the footers, which tasks read."""

    def read(batches):
        fs, base = opened(folder)
        for batch in batches:
            found = []
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(f"{base}/{name}") as f, pq.ParquetFile(f) as file:
                    found.append({"name": name} | _footer(file))
            yield pa.RecordBatch.from_pylist(found, pa.schema([("name", pa.string()), ("day", pa.int64()), ("lot", pa.int64()), ("piece", pa.int64()), ("sources", pa.string()), ("n_rows", pa.int64())]))

    there = [(n,) for n in names(folder)]
    if not there:
        return []
    return [r.asDict() for r in _tasks(spark, there, "name string", 64).mapInArrow(read, "name string, day long, lot long, piece long, sources string, n_rows long").collect()]


def packed(files: list[dict], rows: int, small: int = 600, full: int = 400) -> list[list[dict]]:
    """Groups of the files under ``share(rows, small)`` rows: first-fit decreasing within each day, ``share(rows, full)`` rows a group at most."""
    under, most = share(rows, small), share(rows, full)
    groups: list[list[dict]] = []
    of_day: dict = {}
    for f in sorted((f for f in files if f["n_rows"] < under), key=lambda f: (-f["n_rows"], f["lot"] or 0, f["piece"] or 0)):
        opened_here = of_day.setdefault(f["day"], [])
        for g in opened_here:
            if g["n_rows"] + f["n_rows"] <= most:
                break
        else:
            g = {"n_rows": 0, "files": []}
            opened_here.append(g)
            groups.append(g["files"])
        g["files"].append(f)
        g["n_rows"] += f["n_rows"]
    return groups


def merge(spark: SparkSession, folder: str, groups: list[list[dict]]) -> None:
    """Replaces each group of several files by one, its files one after the other."""
    plan = [(i, g[0]["name"].replace(".parquet", ".merged.parquet"), [f["name"] for f in g]) for i, g in enumerate(g for g in groups if len(g) > 1)]
    if not plan:
        return

    @freeing
    def concatenated(batches):
        fs, base = opened(folder)
        fs.create_dir(f"{base}/{STAGED}", recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                out, sources = None, []
                for name in row["sources"]:
                    with fs.open_input_file(f"{base}/{name}") as f, pq.ParquetFile(f) as file:
                        marks = file.metadata.metadata or {}
                        sources.append(marks[b"folio.sources"].decode())
                        if out is None:
                            first = {k: marks[f"folio.{k}".encode()].decode() for k in MARKS[:3]}
                            schema = file.schema_arrow
                            out = _Writer(fs, f"{base}/{STAGED}/{row['name']}", schema, first | {"sources": ""})
                        for part in file.iter_batches(batch_size=1 << 16):
                            out.add(part)
                out.out.add_key_value_metadata({"folio.sources": ",".join(sources)})
                yield _written(out)

    def placed(batches):
        fs, base = opened(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if fs.get_file_info(f"{base}/{STAGED}/{row['name']}").is_file:
                    fs.move(f"{base}/{STAGED}/{row['name']}", f"{base}/{row['name']}")
                for name in row["sources"]:
                    if fs.get_file_info(f"{base}/{name}").is_file:
                        fs.delete_file(f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"path": batch.column(1), "n_rows": pa.array([0] * batch.num_rows, pa.int64())})

    work = "k long, name string, sources array<string>"
    for step, most in ((concatenated, len(plan)), (placed, 64)):
        _tasks(spark, plan, work, most).mapInArrow(step, "path string, n_rows long").write.format("noop").mode("overwrite").save()
    _swept(folder)


def _swept(folder: str) -> None:
    """Takes away what attempts that failed have left: their files carry hidden names."""
    fs, base = opened(folder)
    for x in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
        if x.base_name == STAGED:
            fs.delete_dir(x.path)
        elif x.base_name.startswith("."):
            fs.delete_file(x.path)


def digests(spark: SparkSession, folder: str, before: dict[str, int], key: str = "click_id", value: str = "value") -> DataFrame:
    """A row for each file of ``folder``, from its footer and its rows in order; ``before``: the names of files that were there before the compaction."""
    shown = folder if "://" in folder else re.sub(r"^file:/+|^/", "file:///", folder)
    fields = pa.schema([("day", pa.int64()), ("lot", pa.int64()), ("piece", pa.int64()), ("n_rows", pa.int64()), ("min_click_id", pa.int64()), ("max_click_id", pa.int64()), ("cents", pa.int64()), ("sources", pa.string()), ("ids_sha256", pa.string()), ("columns", pa.string()), ("path", pa.string()), ("rewritten", pa.bool_())])

    @freeing
    def read(batches):
        fs, base = opened(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{base}/{row['name']}") as f, pq.ParquetFile(f) as file:
                    told = _footer(file)
                    sha, lead, low, high, cents = hashlib.sha256(), "", None, None, 0
                    for part in file.iter_batches(batch_size=1 << 16, columns=[key, value]):
                        ids, money = part.column(key), part.column(value)
                        sha.update((lead + ",".join(pc.fill_null(ids.cast(pa.string()), "").to_pylist())).encode())
                        lead = ","
                        ends = pc.min_max(ids).as_py()
                        low = min((x for x in (low, ends["min"]) if x is not None), default=None)
                        high = max((x for x in (high, ends["max"]) if x is not None), default=None)
                        v = np.floor(100 * pc.fill_null(money.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False) + 0.5)
                        cents += int(v[np.isfinite(v)].astype(np.int64).sum())
                    columns = ",".join(file.schema_arrow.names)
                yield pa.RecordBatch.from_pylist([told | {"min_click_id": low, "max_click_id": high, "cents": cents, "ids_sha256": sha.hexdigest(), "columns": columns, "path": f"{shown}/{row['name']}", "rewritten": not row["old"]}], fields)

    schema = "day long, lot long, piece long, n_rows long, min_click_id long, max_click_id long, cents long, sources string, ids_sha256 string, columns string, path string, rewritten boolean"
    there = [(n, n in before) for n in names(folder)]
    if not there:
        return spark.createDataFrame([], schema)
    return _tasks(spark, there, "name string, old boolean", 200).mapInArrow(read, schema)


def compacted(df: DataFrame, time: str = "arrived_at", key: str = "click_id", value: str = "value") -> DataFrame:
    """Writes ``df`` into a new folder of the shared one, compacts it there and returns a row for each file that is left."""
    spark = df.sparkSession
    folder = fresh_path(spark, "compacted")
    rows = write_daily(df, folder, time, key)
    files = manifest(spark, folder)
    merge(spark, folder, packed(files, rows))
    return digests(spark, folder, {f["name"]: f["n_rows"] for f in files}, key, value)
