"""Immutable snapshots with a manifest: a new version becomes current by one small write.

Documents and blocks are dealt to buckets by document id; a version names the
folders of each bucket of each table. A change of some documents writes the
buckets that hold them and no others; the new version shares the rest with the
one before. Postings are dealt by gram, so that a look-up reads the buckets of
its grams only; a change appends to them. What they say of documents that have
changed or gone stays until they are made anew: postings may name too many
candidates, never too few, and candidates are always checked. A bucket holds about ``target`` documents: when a collection
has outgrown its buckets the next change deals everything to more of them
(at most ``MOST``), so each document is dealt anew a few times only.

Writers work without locks. A writer names the version that it has ``read``;
when it commits, versions that others have made since are looked at:

* no bucket of documents was touched by both: its change is put on top of theirs;
* else the documents that differ in the buckets that both touched are compared
  with its own: the same document, or the same path, is a ``Conflict``, and the
  writer reads again and repeats its work; others do not disturb it.

Ids come from ranges that are reserved under the collection before anything is
committed, so two writers never give one id to two documents. A manifest entry
is created under its number and never replaced: of two writers that commit at
the same moment one looks again, and only what readers see is decided there.

``ledger`` holds the last batch of each stream that writes (its name and
number): a batch that is handed over again, after a restart, changes nothing.
"""

from __future__ import annotations

import json
import os
import struct
import time
import uuid

import xxhash
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Tables and the column whose hash deals their rows to buckets; None: one folder.
TABLES = {"documents": "id", "blocks": "document_id", "postings": "gram", "roots": None}
#: Tables that a change only adds to.
APPENDED = ("postings",)
BUCKET = "__bucket"
#: Buckets of a small collection, and the most that a manifest names.
LEAST, MOST = 32, 4096
#: Ids that narrowed() lists in a filter.
LISTED = 1000


#: How often a writer whose version was taken by another one puts its change on top of that one before it gives up.
TRIES = 20
#: Folders that no version names are kept so long, as their writer may still be at work; milliseconds.
GRACE = 3_600_000


class Conflict(RuntimeError):
    """Another writer has changed what this one was working on."""


class _Taken(Conflict):
    """Another writer has made the version of this number."""


class SnapshotStore:
    """Tables below ``path``/v-<id>/ and one entry for each version below ``path``/manifest."""

    def __init__(self, spark: SparkSession, path: str, target: int = 50_000):
        self.spark, self.path, self.target = spark, path.rstrip("/"), target
        self._held: tuple[int, int] = (-1, 0)

    # -- files ---------------------------------------------------------------------------------------

    def _place(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _create(self, path: str, text: str) -> None:
        """Writes a small file that must not exist yet."""
        place, files = self._place(path)
        try:
            if files.getScheme() == "file":  # its create() is not atomic
                local = place.toUri().getPath()
                os.makedirs(os.path.dirname(local), exist_ok=True)
                draft = f"{os.path.dirname(local)}/.{uuid.uuid4().hex}"
                with open(draft, "w", encoding="utf-8") as out:
                    out.write(text)
                try:
                    os.link(draft, local)  # whole at once, and only if it is not there
                finally:
                    os.remove(draft)
                return
            stream = files.create(place, False)
        except FileExistsError as found:
            raise _Taken(path) from found
        except Exception as found:  # noqa: BLE001  the exception of the JVM that says the file exists
            if "AlreadyExists" in str(found):
                raise _Taken(path) from found
            raise
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()

    def _numbers(self, folder: str) -> list[int]:
        """The numbers of the small files of a folder, in order."""
        place, files = self._place(f"{self.path}/{folder}")
        if not files.exists(place):
            return []
        names = [s.getPath().getName() for s in files.listStatus(place)]
        return sorted(int(n.partition(".")[0]) for n in names if n[0] != "." and n.endswith(".json"))

    def _small(self, folder: str, number: int) -> dict | None:
        """One small file; None while its writer is still at it, or if it has just gone."""
        place, files = self._place(f"{self.path}/{folder}/{number:012d}.json")
        try:
            stream = files.open(place)
        except Py4JJavaError as gone:
            if "FileNotFound" in str(gone):
                return None
            raise
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text.endswith("\n") else None

    def _manifest(self, after: int = 0) -> list[dict]:
        return [e for n in self._numbers("manifest") if n > after and (e := self._small("manifest", n)) is not None]

    def _newest(self, folder: str) -> dict | None:
        return next((e for n in reversed(self._numbers(folder)) if (e := self._small(folder, n)) is not None), None)

    # -- reading -------------------------------------------------------------------------------------

    def version(self) -> int:
        found = self._newest("manifest")
        return found["data_version"] if found else 0

    def _entry(self, version: int | None = None) -> dict:
        found = self._newest("manifest") if version is None else self._small("manifest", version)
        if not found:
            raise LookupError("no such snapshot")
        return found

    def _table(self, entry: dict, name: str, only: list[str] | None = None) -> DataFrame:
        if name not in entry["tables"]:
            raise LookupError("no such snapshot")
        schema = StructType.fromJson(entry["tables"][name]["schema"])
        parts = [p for b, paths in sorted(entry["tables"][name]["parts"].items()) if only is None or b in only for p in paths]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self._table(self._entry(version), name)

    @staticmethod
    def _buckets_of(keys: list[int], buckets: int) -> list[str]:
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        return sorted({str(signed(xxhash.xxh64_intdigest(struct.pack("<q", k), 42)) % buckets) for k in keys})  # as Spark hashes a long

    def documents(self, version: int) -> int:
        """How many documents a version has."""
        if self._held[0] != version:
            self._held = (version, self.read("documents", version).count())
        return self._held[1]

    def lookup(self, name: str, keys: list[int], version: int | None = None) -> DataFrame:
        """The rows of a table whose bucket key, a long, is one of ``keys``: only their buckets are read."""
        entry = self._entry(version)
        column, buckets = TABLES[name], entry["buckets"]
        return self._table(entry, name, self._buckets_of(keys, buckets)).filter(F.col(column).isin(sorted(set(keys))))

    def narrowed(self, name: str, ids: DataFrame | None, version: int | None = None) -> DataFrame:
        """The rows of a table that is dealt by document id, of some documents (one column) or of all: only their buckets are read.

        Up to ``LISTED`` ids are fetched and become a filter that Parquet applies
        to its row groups; of more only the numbers of their buckets are.
        """
        entry, key = self._entry(version), TABLES[name]
        if ids is None:
            return self._table(entry, name)
        ids = ids.toDF("_id")
        few = [r[0] for r in ids.distinct().limit(LISTED + 1).collect()]
        if len(few) <= LISTED:
            return self._table(entry, name, self._buckets_of(few, entry["buckets"])).filter(F.col(key).isin(few))
        only = sorted(str(r.b) for r in ids.select(self._bucket("_id", entry["buckets"]).alias("b")).distinct().collect())
        return self._table(entry, name, only).join(ids, F.col(key) == F.col("_id"), "left_semi")

    # -- writing -------------------------------------------------------------------------------------

    @staticmethod
    def _bucket(column: str, buckets: int):
        return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")

    def _buckets_for(self, documents: int) -> int:
        wanted = LEAST
        while wanted < MOST and wanted * self.target < documents:
            wanted *= 2
        return wanted

    def _written(self, name: str, table: DataFrame, folder: str, buckets: int) -> dict:
        """Writes a table and returns its folders by bucket."""
        key = TABLES[name]
        if key is None:
            table.write.option("compression", "zstd").parquet(f"{folder}/{name}")
            return {"0": [f"{folder}/{name}"]}
        # rebalanced: small buckets share a task, a large one is split over several; postings are sorted so that a look-up reads few row groups
        dealt = table.withColumn(BUCKET, self._bucket(key, buckets)).hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, *[c for c in ("gram", key, "ordinal") if c in table.columns])
        dealt.write.option("compression", "zstd").partitionBy(BUCKET).parquet(f"{folder}/{name}")
        place, files = self._place(f"{folder}/{name}")
        names = [s.getPath().getName() for s in files.listStatus(place)]
        return {n.partition("=")[2]: [f"{folder}/{name}/{n}"] for n in names if n.startswith(f"{BUCKET}=")}

    def _finish(self, before: dict | None, tables: dict, buckets: int, touched: list[str] | None = None, batch: tuple[str, int] | None = None) -> int:
        """Creates the next version. ``touched``: the buckets of documents that it writes, None for all."""
        number = (before["data_version"] if before else 0) + 1
        ledger = dict(before.get("ledger", {})) if before else {}
        if batch:
            ledger[batch[0]] = batch[1]
        entry = {"schema_version": 3, "data_version": number, "buckets": buckets, "tables": tables, "touched": touched, "ledger": ledger}
        self._create(f"{self.path}/manifest/{number:012d}.json", json.dumps(entry) + "\n")
        return number

    def reserved(self, n: int) -> int:
        """The first of ``n`` ids that no other writer gets; the range is taken by one small file, whose number must not exist yet."""
        for _ in range(1000):
            last = self._newest("ids")
            if last is None:
                held = self.read("documents").agg(F.max("id")).first()[0] if self.version() else None
                last = {"number": 0, "next": (held or 0) + 1}
            try:
                self._create(f"{self.path}/ids/{last['number'] + 1:012d}.json", json.dumps({"number": last["number"] + 1, "next": last["next"] + n}) + "\n")
                return last["next"]
            except _Taken:
                continue
        raise Conflict(f"{self.path}/ids")

    def written(self, batch: tuple[str, int]) -> bool:
        """Whether this batch of a stream, or a later one, is in the newest version."""
        found = self._newest("manifest")
        return bool(found) and found.get("ledger", {}).get(batch[0], -1) >= batch[1]

    def commit(self, read: int | None = None, **tables: DataFrame) -> int:
        """Writes whole tables as a new version; those not given stay as the version before has them.

        New buckets need all tables that the version before has. With ``read`` it
        is a Conflict if that is not the newest version any more.
        """
        folder, before = f"{self.path}/v-{uuid.uuid4().hex}", self._newest("manifest")
        if read is not None and read != (before["data_version"] if before else 0):
            raise Conflict(f"version {read} is not the newest")
        places = dict(before["tables"]) if before else {}
        dealt = {n for n in (*places, *tables) if TABLES[n]}  # tables that are dealt to buckets
        whole = "documents" in tables and dealt <= set(tables)
        buckets = self._buckets_for(tables["documents"].count()) if whole or not before and "documents" in tables else before["buckets"] if before else LEAST
        for name, table in tables.items():
            places[name] = {"schema": json.loads(table.schema.json()), "parts": self._written(name, table, folder, buckets)}
        return self._finish(before, places, buckets, None if "documents" in tables else [])

    def _differing(self, read: dict, newest: dict, only: list[str] | None) -> DataFrame:
        """(id, path) of the documents of some buckets that are not the same in both versions."""
        old, new = (self._table(e, "documents", only if read["buckets"] == newest["buckets"] else None) for e in (read, newest))
        new = new.select(*old.columns)
        return old.exceptAll(new).unionByName(new.exceptAll(old)).select("id", "path")

    def _checked(self, read: int, newest: dict, touched: list[str] | None, dead: DataFrame, fresh: DataFrame | None) -> None:
        """Conflict if a version after ``read`` has changed a document of this change, or has added a path of it."""
        since = [e for e in self._manifest(read) if e["data_version"] <= newest["data_version"]]
        theirs: set[str] | None = set()
        for e in since:
            theirs = None if theirs is None or e.get("touched") is None else theirs | set(e["touched"])
        only = touched if theirs is None else sorted(theirs) if touched is None else sorted(theirs & set(touched))
        if fresh is None and only == []:
            return  # disjoint buckets, and no path that others may have added under another id
        try:
            before = self._entry(read)
        except LookupError as gone:
            raise Conflict(f"version {read} is not kept any more") from gone
        changed = self._differing(before, newest, None if theirs is None else sorted(theirs))
        mine = dead.select("id").unionByName(fresh.select("id")) if fresh is not None else dead.select("id")
        clash = changed.join(mine, "id", "left_semi").select("path")
        if fresh is not None:
            clash = clash.union(changed.join(fresh.select("path"), "path", "left_semi").select("path"))
        met = clash.first()
        if met is not None:
            raise Conflict(f"{met.path} has changed since version {read}")

    def patch(self, gone: DataFrame, roots: DataFrame | None = None, read: int | None = None, batch: tuple[str, int] | None = None, forgotten: list[str] | None = None, moved: DataFrame | None = None, **fresh: DataFrame) -> int:
        """A new version without the documents of ``gone`` (id) and with the ``fresh`` rows of the tables; only touched buckets are written.

        A document that changes is both gone and fresh. ``moved``: rows of known
        documents that replace theirs while blocks and postings stay. ``roots``
        and ``forgotten`` (names) are put on top of the roots of the newest
        version. ``read``: the version that all this was worked out from.
        ``batch``: name and number of a stream's batch, which commits once.
        """
        for _ in range(TRIES):
            if batch and self.written(batch):
                return self.version()
            folder = f"{self.path}/v-{uuid.uuid4().hex}"
            try:
                return self._patched(folder, gone, roots, read, batch, forgotten or [], moved, fresh)
            except _Taken:
                self._drop(folder)
            except Conflict:
                self._drop(folder)
                raise
        raise Conflict(f"{TRIES} times another writer was faster")

    def _drop(self, folder: str) -> None:
        place, files = self._place(folder)
        files.delete(place, True)

    def _patched(self, folder: str, gone: DataFrame, roots: DataFrame | None, read: int | None, batch, forgotten: list[str], moved: DataFrame | None, fresh: dict) -> int:
        before = self._entry()
        tables, buckets = dict(before["tables"]), before["buckets"]
        dead = gone.select(F.col("id").cast("long").alias("id")).distinct()
        wanted = buckets
        if "documents" in fresh:
            wanted = self._buckets_for(self._table(before, "documents").count() + fresh["documents"].count())
        numbers = lambda rows: sorted(str(r.b) for r in rows.distinct().collect())  # noqa: E731  buckets are few
        if wanted > buckets:
            only, buckets, retouched = None, wanted, None
        else:
            touched = dead.select(self._bucket("id", buckets).alias("b"))
            for name, rows in fresh.items():
                touched = touched if name in APPENDED else touched.union(rows.select(self._bucket(TABLES[name], buckets)))
            only = numbers(touched)
            retouched = only if moved is None else sorted({*only, *numbers(moved.select(self._bucket("id", buckets).alias("b")))})
        if read is not None and read != before["data_version"]:
            self._checked(read, before, retouched if buckets == before["buckets"] else None, dead if moved is None else dead.union(moved.select("id")), fresh.get("documents"))
        for name, key in TABLES.items():
            if key is None or name not in tables:
                continue
            if name in APPENDED and only is not None:
                if name in fresh:
                    parts = dict(tables[name]["parts"])
                    for b, paths in self._written(name, fresh[name], folder, buckets).items():
                        parts[b] = [*parts.get(b, []), *paths]
                    tables[name] = tables[name] | {"parts": parts}
                continue
            mine = retouched if name == "documents" else only
            if mine == []:
                continue
            old = self._table(before, name, mine)
            replaced = dead.union(moved.select("id")) if name == "documents" and moved is not None else dead
            left = old if name in APPENDED else old.join(replaced.withColumnRenamed("id", key), key, "left_anti").select(*old.columns)
            whole = left.unionByName(fresh[name].select(*old.columns)) if name in fresh else left
            if name == "documents" and moved is not None:
                whole = whole.unionByName(moved.join(dead, "id", "left_anti").select(*old.columns))
            kept = {} if mine is None else {b: p for b, p in tables[name]["parts"].items() if b not in mine}
            tables[name] = tables[name] | {"parts": kept | self._written(name, whole, folder, buckets)}
        if roots is not None or forgotten:
            now = self._table(before, "roots") if "roots" in tables else None
            for name in [*forgotten, *([r.root for r in roots.select("root").collect()] if roots is not None else [])]:
                now = now.filter(F.col("root") != name) if now is not None else None
            whole = roots if now is None else now if roots is None else now.unionByName(roots)
            tables["roots"] = {"schema": json.loads(whole.schema.json()), "parts": self._written("roots", whole, folder, buckets)}
        return self._finish(before, tables, buckets, retouched, batch)

    def upsert(self, documents: DataFrame, blocks: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Replaces whole documents by path, ids kept; repeated ordinals of a document fail it.

        ``batch``: name and number of a stream's batch; handed over again it changes nothing.
        """
        if not blocks.groupBy("document_id", "ordinal").count().filter("count > 1").isEmpty():
            raise ValueError("a document has an ordinal twice")
        read = self.version()
        if not read:
            return self.commit(documents=documents, blocks=blocks)
        if batch and self.written(batch):
            return read
        old = self.read("documents", read)
        kept_id = old.select("path", F.col("id").alias("old_id"))
        placed = documents.join(kept_id, "path", "left").withColumn("new_id", F.coalesce("old_id", "id"))
        new = placed.withColumn("id", F.col("new_id")).select(*old.columns)
        renamed = blocks.join(placed.select(F.col("id").alias("document_id"), "new_id"), "document_id").withColumn("document_id", F.col("new_id")).select(*blocks.columns)
        return self.patch(new.select("id"), read=read, batch=batch, documents=new, blocks=renamed)

    def touch(self, documents: DataFrame, read: int | None = None) -> int:
        """Replaces the rows of known documents by id and leaves their blocks and postings as they are."""
        return self.patch(documents.select("id").limit(0), read=read, moved=documents)

    def remove(self, gone: DataFrame) -> int:
        """Drops the documents of ``gone`` (path), their blocks and postings."""
        read = self.version()
        return self.patch(self.read("documents", read).join(gone.select("path"), "path", "left_semi").select("id"), read=read)

    def compact(self, keep: int = 1, grace: int = GRACE) -> int:
        """Deletes what only versions before the last ``keep`` use, and folders of writers that never came to commit; the number of folders that went.

        A folder that no version names goes once it is ``grace`` milliseconds old: its writer may still be at work.
        """
        found = self._manifest()
        entries = lambda chosen: {p for e in chosen for t in e["tables"].values() for paths in t["parts"].values() for p in paths}
        old = found[: max(0, len(found) - keep)]
        kept = entries(found[len(old) :])
        gone = entries(old) - kept
        for path in gone:
            self._drop(path)
        for entry in old:
            place, files = self._place(f"{self.path}/manifest/{entry['data_version']:012d}.json")
            files.delete(place, False)
        for number in self._numbers("ids")[:-2]:
            place, files = self._place(f"{self.path}/ids/{number:012d}.json")
            files.delete(place, False)
        place, files = self._place(self.path)
        used = {p.rpartition("/v-")[2].partition("/")[0] for p in kept}
        lost = [s.getPath().toString() for s in files.listStatus(place) if s.getPath().getName().startswith("v-") and s.getPath().getName()[2:] not in used and s.getModificationTime() <= time.time() * 1000 - grace]
        for path in lost:
            self._drop(path)
        return len(gone) + len(lost)
