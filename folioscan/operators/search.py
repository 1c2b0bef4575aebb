"""Ranked search over an inventory and its blocks.

Match classes: 4 the whole query is the file name, 3 the file name holds all
terms, 2 a heading does, 1 a block does; with several terms 1 as well where
file name and blocks hold them between them. Blocks are reduced to one row a
document before the join, and only blocks with a hit are shuffled. With
postings of a stored collection only the blocks of documents that hold the
rarest grams of a term are read: their buckets, and of these the row groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from threading import Lock

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import below
from ..functions.text import query_terms
from ..plans.scratch import stored
from .postings import Postings, candidates

REASONS = ("content", "heading", "filename contains", "filename equals")
FAST_TOTAL = 500


@dataclass(frozen=True)
class Search:
    text: str
    mode: str = "phrase"  # or all-terms
    field: str = "all"  # filename, content
    sort: str = "relevance"  # filename, modified
    types: tuple = ()
    statuses: tuple = ()
    root: str | None = None
    subtree: str | None = None


def path_order(column: str | Column = "path") -> Column:
    """Sorts paths by UTF-16 code units."""
    return F.encode(column, "UTF-16BE")


def order(sort: str, rank: str = "rank") -> list[Column]:
    newest, path = F.col("modified_at_ms").desc(), path_order().asc()
    return {"relevance": [F.col(rank).desc(), newest, path], "filename": [path, newest], "modified": [newest, path]}[sort]


def in_scope(docs: DataFrame, search: Search) -> DataFrame:
    if search.types:
        docs = docs.filter(F.col("extension").isin(*search.types))
    if search.statuses:
        docs = docs.filter(F.col("status").isin(*search.statuses))
    if search.root:
        docs = docs.filter(F.col("root") == search.root)
    return docs.filter(below("path", search.subtree)) if search.subtree else docs


def _all(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, flags)


def _any(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)


def _count(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [f.cast("int") for f in flags])


def evidence(blocks: DataFrame, terms: list[str]) -> DataFrame:
    """One row a document with a hit: first heading and content block with all terms, the terms seen, the block that covers most."""
    has_heading = F.coalesce(F.col("heading") != "", F.lit(False))
    heading = [has_heading & F.coalesce(F.col("heading_norm").contains(t), F.lit(False)) for t in terms]
    content = [F.col("content_norm").contains(t) for t in terms]
    hit = [h | c for h, c in zip(heading, content)]
    by_heading = _any(heading)
    coverage = F.when(by_heading, _count(heading)).otherwise(_count(content))
    best = F.struct(coverage.alias("coverage"), by_heading.cast("int").alias("by_heading"), (-F.col("ordinal")).alias("before"))
    return blocks.filter(_any(hit)).groupBy("document_id").agg(
        F.min(F.when(_all(heading), F.col("ordinal"))).alias("heading_at"), F.min(F.when(_all(content), F.col("ordinal"))).alias("content_at"),
        F.max(F.when(coverage > 0, best)).alias("best"), *[F.bool_or(h).alias(f"seen{i}") for i, h in enumerate(hit)],
    )


#: Blocks as a table, or a function that gives the blocks of some documents (document_id; None: of all).
Blocks = DataFrame | Callable[[DataFrame | None], DataFrame]


def narrowed(blocks: Blocks, documents: DataFrame | None) -> DataFrame:
    if callable(blocks):
        return blocks(documents)
    return blocks if documents is None else blocks.join(documents, "document_id", "left_semi")


def matches(docs: DataFrame, blocks: Blocks, search: Search, postings: Postings | None = None) -> DataFrame:
    """Every matching document with rank, source, ordinal and reason; not ordered. ``postings`` (of contents and headings) prune the blocks."""
    query, terms = query_terms(search.text, search.mode)
    docs = in_scope(docs, search)
    if search.field != "filename":
        found = None if postings is None else candidates(postings, *terms)
        blocks = narrowed(blocks, found)
    name = F.col("filename_norm")
    if search.field == "content":
        name_rank = F.lit(0)
    else:
        name_rank = F.when(name == query, 4).when(_all([name.contains(t) for t in terms]), 3).otherwise(0)
    docs = docs.withColumn("name_rank", name_rank)
    if search.field == "filename":
        out = docs.filter("name_rank > 0").withColumn("rank", F.col("name_rank")).withColumn("by", F.lit("filename")).withColumn("ordinal", F.lit(None).cast("int"))
    else:
        found = docs.join(evidence(blocks, terms), F.col("id") == F.col("document_id"), "left")
        known = [F.coalesce(f"seen{i}", F.lit(False)) | (F.lit(search.field != "content") & name.contains(t)) for i, t in enumerate(terms)]
        spread = F.lit(search.mode == "all-terms") & F.col("best").isNotNull()
        enough = _all(known) if search.mode == "all-terms" else F.lit(True)
        rank = F.when(F.col("name_rank") > 0, F.col("name_rank")).when(~enough, 0).when(F.col("heading_at").isNotNull(), 2).when(F.col("content_at").isNotNull() | spread, 1).otherwise(0)
        by = F.when(F.col("name_rank") > 0, "filename").when(F.col("heading_at").isNotNull(), "heading").when(F.col("content_at").isNotNull(), "content").when(F.col("best.by_heading") == 1, "heading").otherwise("content")
        at = F.when(F.col("name_rank") == 0, F.coalesce("heading_at", "content_at", -F.col("best.before")))
        out = found.withColumn("rank", rank).filter("rank > 0").withColumn("by", by).withColumn("ordinal", at)
    reason = F.element_at(F.array(*[F.lit(r + (" (all terms)" if search.mode == "all-terms" and r != REASONS[3] else "")) for r in REASONS]), F.col("rank"))
    return out.select("id", "path", "filename", "extension", "status", "modified_at_ms", "rank", "by", "ordinal", reason.alias("reason"))


def top(found: DataFrame, sort: str = "relevance", limit: int = 20, rank: str = "rank") -> DataFrame:
    """The first rows in order, with their position; a top-k, never a whole sort. The window sees these rows only."""
    if limit <= 0:
        raise ValueError("the limit must be positive")
    first = found.orderBy(*order(sort, rank)).limit(limit)
    return first.withColumn("position", F.row_number().over(Window.orderBy(*order(sort, rank))))


def page(found: DataFrame, number: int, size: int, sort: str = "relevance", total: int | None = None, rank: str = "rank") -> DataFrame:
    """One page with positions. Errors only if there are results but not that many pages; they are counted where the page is empty."""
    if number <= 0 or size <= 0:
        raise ValueError("page and page size must be positive")
    shown = top(found, sort, number * size, rank).filter(F.col("position") > (number - 1) * size)
    if total is None and number > 1:
        shown = stored(shown, "page")
        total = found.count() if shown.isEmpty() else None
    if total and number > max(1, -(-total // size)):
        raise ValueError(f"there are {max(1, -(-total // size))} pages")
    return shown


def total(found: DataFrame, exact: bool, page_end: int = 0) -> DataFrame:
    """(total, relation): fast totals stop at max(500, page_end) rows and are ``gte`` from there on."""
    if exact:
        return found.agg(F.count("*").alias("total")).withColumn("relation", F.lit("eq"))
    target = max(FAST_TOTAL, page_end)
    return found.select("id").limit(target).agg(F.count("*").alias("total")).withColumn("relation", F.when(F.col("total") < target, "eq").otherwise("gte"))


# Results that pages can reach, and the largest pages of tools and of the workbench.
REACHABLE, TOOL_PAGE, WORKBENCH_PAGE = 500, 50, 20


def limited_page(found: DataFrame, number: int, size: int, most: int = TOOL_PAGE, sort: str = "relevance") -> DataFrame:
    """A page for clients that may only reach the first 500 results, with pages of at most ``most``; beyond it is empty."""
    if not 1 <= size <= most:
        raise ValueError(f"pages have 1 to {most} results")
    if number <= 0:
        raise ValueError("page and page size must be positive")
    return top(found, sort, min(number * size, REACHABLE)).filter(F.col("position") > (number - 1) * size)


def phases(docs: DataFrame, blocks: DataFrame, search: Search, postings: Postings | None = None) -> list[DataFrame]:
    """The matches by class, best first: whole file names, parts of file names, headings, contents. Nothing runs until one is read."""
    classes = []
    if search.field != "content":
        names = matches(docs, blocks, Search(**(search.__dict__ | {"field": "filename"})))
        classes += [names.filter("rank = 4"), names.filter("rank = 3")]
    if search.field != "filename":
        rest = matches(docs, blocks, search, postings)
        classes += [rest.filter("rank = 2"), rest.filter("rank = 1")]
    return classes


def phased(docs: DataFrame, blocks: DataFrame, search: Search, limit: int = 20, postings: Postings | None = None) -> DataFrame:
    """The first ``limit`` by relevance; a class is only looked at if those before it do not fill the result.

    The classes are searched one after the other with a small job each, which
    is the point: a query that file names answer never reads a block.
    """
    taken, missing = None, limit
    for found in phases(docs, blocks, search, postings):
        part = found.orderBy(*order("relevance")).limit(missing)
        rows = docs.sparkSession.createDataFrame(part.collect(), part.schema)  # at most ``limit`` rows
        taken = rows if taken is None else taken.unionByName(rows)
        missing -= rows.count()
        if missing <= 0:
            break
    return top(taken, "relevance", limit)


def refined(before: DataFrame, docs: DataFrame, blocks: DataFrame, search: Search, postings: Postings | None = None) -> DataFrame:
    """A new condition over the documents of ``before``; types, root and subtree no longer apply.

    The rank of the first layer is carried along as ``first_rank``: with the
    other sort keys it gives the order of that layer, without numbering rows.
    """
    kept_rank = "first_rank" if "first_rank" in before.columns else "rank"
    ids = before.select("id", F.col(kept_rank).alias("first_rank"))
    inside = docs.join(ids, "id", "left_semi")
    own = narrowed(blocks, ids.select(F.col("id").alias("document_id")))
    kept = matches(inside, own, Search(**(search.__dict__ | {"types": (), "root": None, "subtree": None})), postings)
    return kept.join(ids, "id")


def with_reference(found: DataFrame) -> DataFrame:
    """The stable reference: the id and the first 16 hex digits of the SHA-256 of the path."""
    return found.withColumn("reference", F.concat_ws("-", F.col("id").cast("string"), F.substring(F.sha2(F.col("path"), 256), 1, 16)))


def preview_id(path: str | Column, key: bytes) -> Column:
    """An identifier of a path that only holders of ``key`` can make: HMAC-SHA256 in hex, by built-in functions."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    c = F.col(path) if isinstance(path, str) else path
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(c, "UTF-8")), 256))), 256)


class Latest:
    """Runs searches for a client that wants only its newest one: a new search interrupts the one that still runs."""

    def __init__(self, spark: SparkSession, workers: int = 4):
        self.spark, self._number, self._lock = spark, 0, Lock()
        self._pool = ThreadPoolExecutor(workers)

    def submit(self, found: DataFrame) -> Future:
        with self._lock:
            before, self._number = f"search-{id(self)}-{self._number}", self._number + 1
            mine = f"search-{id(self)}-{self._number}"
        self.spark.sparkContext.cancelJobGroup(before)

        def run():
            self.spark.sparkContext.setJobGroup(mine, "search", interruptOnCancel=True)
            return found.collect()

        return self._pool.submit(run)


class Session:
    """Layers of refinement over one pinned version of the data, all in the order of the first layer."""

    def __init__(self, docs: DataFrame, blocks: DataFrame, search: Search, version=None, current=lambda: None, postings: Postings | None = None):
        self._docs, self._blocks, self._postings, self._version, self._current = docs, blocks, postings, version, current
        first = matches(docs, blocks, search, postings)
        self._layers = [(search, first.withColumn("first_rank", F.col("rank")))]

    def _checked(self) -> DataFrame:
        if self._current() != self._version:
            raise RuntimeError("SEARCH_INDEX_CHANGED")
        return self._layers[-1][1]

    @property
    def conditions(self) -> list[str]:
        return [s.text for s, _ in self._layers]

    def append(self, text: str) -> DataFrame:
        before = self._checked()
        search = Search(**(self._layers[0][0].__dict__ | {"text": text}))
        self._layers.append((search, refined(before, self._docs, self._blocks, search, self._postings)))
        return self.results()

    def back(self) -> DataFrame:
        if len(self._layers) > 1:
            self._layers.pop()
        return self.results()

    def reset(self) -> DataFrame:
        del self._layers[1:]
        return self.results()

    def found(self) -> DataFrame:
        """All results, not ordered."""
        return self._checked()

    def results(self) -> DataFrame:
        """All results in order."""
        return self._checked().orderBy(*order(self._layers[0][0].sort, "first_rank"))

    def first(self, limit: int) -> DataFrame:
        return top(self._checked(), self._layers[0][0].sort, limit, "first_rank")

    def page(self, number: int, size: int) -> DataFrame:
        return page(self._checked(), number, size, self._layers[0][0].sort, rank="first_rank").orderBy("position")
