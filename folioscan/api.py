"""A collection on disk: index folders, keep them fresh, search, export passages, explain paths."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import paths
from .functions.text import normalized, parse_types
from .operators import context, inventory, postings, search
from .plans.scratch import dropped_after, stored
from .plans.snapshot import Conflict, SnapshotStore
from .sources import parsers, scan
from .streaming.live import verified_again, with_back_off

#: The file of a root that holds its ignore rules.
RULES_FILE = "ignore.rules"

DOCUMENTS = "id long, root string, path string, filename string, extension string, size_bytes long, modified_at_ms double, status string, error_code string, error_message string, parse_version int, indexed_at_ms double, filename_norm string"
BLOCKS = "document_id long, ordinal int, heading string, content string, location_kind string, location_value string, heading_norm string, content_norm string"
ROOTS = "root string, trashed boolean, synced_at_ms double"


class Collection:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, SnapshotStore(spark, path)
        self._status: dict | None = None
        if not self.store.version():
            empty = {"documents": DOCUMENTS, "blocks": BLOCKS, "postings": postings.PACKED, "roots": ROOTS}
            self.store.commit(**{name: spark.createDataFrame([], schema) for name, schema in empty.items()})

    # -- roots ---------------------------------------------------------------------------------------

    def roots(self, version: int | None = None) -> list[str]:
        return sorted(r.root for r in self.store.read("roots", version).filter("not trashed").collect())

    def scope(self, path: str) -> tuple[str, str | None]:
        """(the longest registered root that covers the path, the path itself if it lies below that root)."""
        covering = [r for r in self.roots() if paths.covers(r, path)]
        if not covering:
            raise LookupError(f"no root covers {path}")
        root = max(covering, key=lambda r: len(paths.parts(r)))
        return root, None if paths.parts(root) == paths.parts(path) else path

    def _root(self, root: str, trashed: bool) -> DataFrame:
        return self.spark.createDataFrame([(root, trashed, time.time() * 1000)], ROOTS)

    def trash(self, root: str) -> int:
        """Drops the documents of a root and remembers it; index() restores it, purge() forgets it."""
        read = self.store.version()
        gone = self.store.read("documents", read).filter(F.col("root") == root)
        return self.store.patch(gone.select("id"), roots=self._root(root, True), read=read)

    def restore(self, root: str) -> dict:
        """Takes a root out of the trash and indexes it anew."""
        if self.store.read("roots").filter((F.col("root") == root) & F.col("trashed")).isEmpty():
            raise LookupError(f"not in the trash: {root}")
        return self.index(root)

    def trashed(self) -> list[str]:
        return sorted(r.root for r in self.store.read("roots").filter("trashed").collect())

    def purge(self) -> int:
        """Forgets the roots in the trash; their documents are gone since trash()."""
        return self.store.patch(self.spark.createDataFrame([], "id long"), forgotten=self.trashed())

    # -- index ---------------------------------------------------------------------------------------

    def _listed(self, start: str, root: str) -> tuple[DataFrame, list[str]]:
        """(files and folders kept out below ``start``, folders that could not be read); contents are not read."""
        try:
            with open(f"{root}/{RULES_FILE}", encoding="utf-8") as file:
                rules = file.read()
        except FileNotFoundError:
            rules = ""
        own = lambda path: paths.below(path, self.store.path.removeprefix("file:"))
        return scan.scanned(self.spark, start, root, paths.ignore_rules(rules), own, RULES_FILE)

    def _numbered(self, rows: DataFrame) -> DataFrame:
        """(path, n): consecutive numbers from 0 in order of path, by a range partitioning and a count for each partition."""
        ranged = stored(rows.repartitionByRange("path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id()), "numbered")
        sizes = {r.part: r["count"] for r in ranged.groupBy("part").count().collect()}
        start, begins = 0, []
        for part in sorted(sizes):
            begins.append((part, start))
            start += sizes[part]
        offsets = self.spark.createDataFrame(begins, "part int, start long")
        place = F.row_number().over(Window.partitionBy("part").orderBy("path"))
        return ranged.withColumn("place", place).join(F.broadcast(offsets), "part").select("path", (F.col("start") + F.col("place") - 1).alias("n"))

    def index(self, folder: str, rebuild: bool = False, allow_empty: bool = False) -> dict:
        """Like refreshed(), repeated after growing delays where another writer has changed the same documents meanwhile."""

        def once() -> dict:
            with dropped_after(self.spark):
                return self.refreshed(folder, rebuild, allow_empty)

        return with_back_off(once, Conflict)

    def refreshed(self, folder: str, rebuild: bool = False, allow_empty: bool = False) -> dict:
        """Brings the index of a folder up to date; only files that need it are read. Returns counts of what was done.

        Files that changed while they were read are not committed (``changed_meanwhile``); the next run reads them.

        Documents below folders that could not be read stay. A root without a
        single file is an error while the index has documents of it, as under a
        mount point whose volume is missing, unless ``allow_empty``.
        """
        folder = scan.validated(folder)
        version = self.store.version()
        plan = paths.plan_root(folder, self.roots(version))
        start = plan.subtree or plan.root
        listed, protected = self._listed(start, plan.root)
        disk = listed.filter("rule is null")
        old = self.store.read("documents", version)
        inside = old.filter(paths.below("path", start))
        if not allow_empty and disk.isEmpty() and not protected and not inside.isEmpty():
            raise scan.RootError("ROOT_IS_EMPTY", start)
        chosen = stored(inventory.classified(disk, inside, rebuild), "chosen")
        reasons = {r.reason: r["count"] for r in chosen.groupBy("reason").count().collect()}
        gone = stored(inventory.missing(inside, disk, start, protected).select("id", "path", "protected"), "gone")
        removed = {r.protected: r["count"] for r in gone.groupBy("protected").count().collect()}
        skipped = {r.rule: r["count"] for r in listed.filter("rule is not null").groupBy("rule").count().collect()}
        told = {"plan": plan.kind, "reasons": reasons, "removed": removed.get(False, 0), "protected": removed.get(True, 0), "unreadable": protected, "skipped": skipped}
        if set(reasons) <= {"unchanged"} and not told["removed"] and plan.kind in ("existing", "subtree"):
            return told | {"version": version, "committed": {}, "read": 0, "changed_meanwhile": 0}  # nothing to write, so no new version
        due = chosen.filter("action <> 'skip'").select("path", "action", "reason").join(disk, "path")
        read = parsers.read_listed(due.filter("action = 'parse'"))
        known = due.filter("action = 'metadata'").select("path", "filename", "extension", "size_bytes", "modified_at_ms", F.lit("unsupported").alias("status"))
        read = stored(read.unionByName(known, allowMissingColumns=True), "read")
        checked = verified_again(read, scan.seen_again(read.select("path")))
        read = stored(checked.filter("commit").drop("commit"), "checked")
        meanwhile = checked.count() - read.count()
        fresh = read.join(old.select("path", F.col("id").alias("old_id")), "path", "left")
        added = stored(fresh.filter("old_id is null").select("path"), "added")
        n = added.count()
        base = self.store.reserved(n) if n else 0
        numbered = self._numbered(added)
        fresh = stored(fresh.join(numbered, "path", "left").withColumn("id", F.coalesce("old_id", F.col("n") + base)), "fresh")
        new = fresh.select("id", F.lit(plan.root).alias("root"), "path", "filename", "extension", "size_bytes", "modified_at_ms", "status", "error_code", "error_message", F.lit(inventory.TEXT_VERSION).alias("parse_version"), F.lit(time.time() * 1000).alias("indexed_at_ms"), normalized("filename").alias("filename_norm"))
        parts = fresh.select(F.col("id").alias("document_id"), F.inline("blocks"))
        parts = stored(parts.withColumn("heading_norm", normalized("heading")).withColumn("content_norm", normalized("content")), "blocks")
        grams = postings.packed(postings.gram_postings(parts, 1, 2, 3, headings=True))
        dead = gone.filter("not protected").select("id").union(new.select("id"))
        moved = old.filter(F.col("root").isin(*plan.merged)).join(dead, "id", "left_anti").withColumn("root", F.lit(plan.root)).select(*old.columns) if plan.merged else None
        version = self.store.patch(dead, roots=self._root(plan.root, False), read=version, forgotten=list(plan.merged), moved=moved, documents=new, blocks=parts, postings=grams)
        committed = {r.reason: r["count"] for r in due.join(new.select("path"), "path", "left_semi").groupBy("reason").count().collect()}
        return told | {"version": version, "committed": committed, "read": read.filter("status <> 'unsupported'").count(), "changed_meanwhile": meanwhile}

    # -- use -----------------------------------------------------------------------------------------

    def session(self, text: str, mode: str = "phrase", field: str = "all", sort: str = "relevance", types: str | None = None, under: str | None = None) -> search.Session:
        root, subtree = self.scope(under) if under else (None, None)
        what = search.Search(text, mode, field, sort, tuple(parse_types(types)) if types else (), (), root, subtree)
        version = self.store.version()
        return search.Session(self.store.read("documents", version), self._blocks(version), what, version, self.store.version, self._postings(version))

    def _blocks(self, version: int):
        return lambda documents: self.store.narrowed("blocks", documents, version)

    def _postings(self, version: int) -> postings.Index:
        return postings.Index(lambda grams: self.store.lookup("postings", grams, version), self.store.documents(version))

    def page(self, text: str, number: int, size: int = 20, **how) -> DataFrame:
        """A page of at most 50 of the first 500 results, as tools ask for them."""
        session = self.session(text, **how)
        return search.with_reference(search.limited_page(session.found(), number, size)).orderBy("position")

    def compact(self, keep: int = 1) -> int:
        """Makes the postings anew and deletes what only older versions than the last ``keep`` use."""
        def anew() -> int:
            read = self.store.version()
            return self.store.commit(read=read, postings=postings.packed(postings.gram_postings(self.store.read("blocks", read), 1, 2, 3, headings=True)))

        with_back_off(anew, Conflict)
        return self.store.compact(keep)

    def search(self, text: str, limit: int = 20, **how) -> DataFrame:
        return search.with_reference(self.session(text, **how).first(limit)).orderBy("position")

    def context(self, selected: list[tuple[str, str]], form: str = "md", **how) -> str:
        version = self.store.version()
        return context.rendered(context.bundle(self.store.read("documents", version), self._blocks(version), selected, version=version, current=self.store.version, postings=self._postings(version), **how), form)

    def status(self) -> dict:
        """Counts of the newest version; they are kept until there is another one."""
        version = self.store.version()
        if self._status is not None and self._status["dataVersion"] == version:
            return self._status
        docs = self.store.read("documents", version)
        self._status = {
            "schemaVersion": 1, "dataVersion": version, "roots": self.roots(), "counts": {r.status: r.n for r in inventory.counted(docs, "status", inventory.STATUSES).collect()},
            "extensions": {r.extension: r["count"] for r in docs.groupBy("extension").count().collect()},
            "issues": [r.asDict() for r in docs.filter(F.col("status").isin("error", "encrypted")).orderBy("path").limit(100).select("path", "status", "error_code").collect()],
        }
        return self._status

    def explain(self, path: str) -> str:
        """outside-root, excluded, unindexed, parse-failed, filename-only or indexed."""
        try:
            root, _ = self.scope(path)
        except LookupError:
            return "outside-root"
        row = self.store.read("documents").filter(F.col("path") == path).select("status").first()
        if row is None:
            listed = self._listed(root, root)[0].filter("rule is not null").filter(paths.below(F.lit(path), F.col("path")))
            return "unindexed" if listed.isEmpty() else "excluded"
        return {"indexed": "indexed", "unsupported": "filename-only", "no_text": "filename-only"}.get(row.status, "parse-failed")
