"""Passages of a result page: which blocks to show for each document, and their snippets.

Everything here runs on the documents of one page (or a stated list of ids),
which reach the blocks by a semi-join.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import earliest, normalize, snippet

MOST_TERMS = 4


def _term_hits(blocks: DataFrame, terms: list[str]):
    has = F.coalesce(F.col("heading") != "", F.lit(False))
    heading = [has & F.coalesce(F.col("heading_norm").contains(t), F.lit(False)) for t in terms]
    return heading, [F.col("content_norm").contains(t) for t in terms]


def hit_blocks(blocks: DataFrame, terms: list[str]) -> DataFrame:
    """Blocks with a hit, the terms in it (in text order) and the text to show: the heading and the content as far as either holds a term."""
    heading, content = _term_hits(blocks, terms)
    any_heading, any_content = reduce(lambda a, b: a | b, heading), reduce(lambda a, b: a | b, content)
    shown = lambda kind: F.concat_ws("\n", F.when(any_heading, F.col(f"heading{kind}")), F.when(any_content, F.col(f"content{kind}")))
    # hits are hits of the normal form, so their order is that of the normal form too
    places = [F.struct(F.instr("source_norm", t).alias("at"), F.lit(i).alias("i"), F.lit(t).alias("term")) for i, t in enumerate(terms)]
    rows = blocks.filter(any_heading | any_content).withColumn("source", shown("")).withColumn("source_norm", shown("_norm"))
    return rows.withColumn("terms", F.transform(F.array_sort(F.filter(F.array(*places), lambda p: p["at"] > 0)), lambda p: p["term"])).drop("source_norm")


def of_ids(blocks: DataFrame, results: DataFrame) -> DataFrame:
    return blocks.join(results.select(F.col("id").alias("document_id")), "document_id", "left_semi")


def phrase_passages(results: DataFrame, blocks: DataFrame, query: str, field: str = "all") -> DataFrame:
    """At most two blocks a document: the one that ranked it first, then by ordinal; none for a search of file names."""
    blocks = blocks.filter(F.lit(field != "filename"))
    hits = hit_blocks(of_ids(blocks, results), [query]).join(results.select(F.col("id").alias("document_id"), F.col("ordinal").alias("chosen")), "document_id")
    first = Window.partitionBy("document_id").orderBy((F.col("ordinal") == F.coalesce("chosen", F.lit(-1))).desc(), "ordinal")
    return hits.withColumn("place", F.row_number().over(first)).filter("place <= 2").select("document_id", "place", "ordinal", "heading", "location_value", "source")


def all_terms_passages(results: DataFrame, blocks: DataFrame, terms: list[str]) -> DataFrame:
    """For each of the first four terms the block nearest to a block of another term; neighbours become one passage.

    Distance to the nearest other block comes from the last one before and the
    first one after, over blocks in order, so no pairs of blocks are made.
    """
    shown = terms[:MOST_TERMS]
    hits = hit_blocks(of_ids(blocks, results), shown)
    rows = hits.select("document_id", "ordinal", "heading", "location_value", "source", "terms")
    up = Window.partitionBy("document_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("document_id").orderBy("ordinal").rowsBetween(1, Window.unboundedFollowing)
    parts = []
    for i, term in enumerate(shown):
        others = F.size(F.array_except("terms", F.array(F.lit(term)))) > 0
        other = F.when(others, F.col("ordinal"))
        near = F.least(F.when(others, F.lit(0)), F.col("ordinal") - F.last(other, True).over(up), F.first(other, True).over(down) - F.col("ordinal"))
        rows = rows.withColumn(f"near{i}", F.coalesce(near, F.lit(1 << 30)))
        parts.append(F.struct(F.lit(i).alias("i"), F.lit(term).alias("term"), F.array_contains("terms", term).alias("has"), F.col(f"near{i}").alias("near")))
    far = rows.withColumn("part", F.explode(F.array(*parts))).filter("part.has")
    nearest = Window.partitionBy("document_id", "part.i").orderBy("part.near", "ordinal")
    chosen = far.withColumn("n", F.row_number().over(nearest)).filter("n = 1")
    merged = chosen.groupBy("document_id", "ordinal").agg(F.first("heading").alias("heading"), F.first("location_value").alias("location_value"), F.first("source").alias("source"), F.collect_list(F.struct("part.i", "part.term")).alias("own"))
    by = Window.partitionBy("document_id").orderBy("ordinal")
    island = F.sum(F.when(F.col("ordinal") == F.lag("ordinal").over(by) + 1, 0).otherwise(1)).over(by)
    return merged.withColumn("passage", island).groupBy("document_id", "passage").agg(
        F.min("ordinal").alias("ordinal"), F.min_by("heading", "ordinal").alias("heading"), F.min_by("location_value", "ordinal").alias("location_value"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "source"))), lambda x: x["source"]), "\n").alias("source"),
        F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("own"))), lambda x: x["term"]), ",").alias("terms"),
    )


def with_snippets(passages: DataFrame, terms: list[str]) -> DataFrame:
    """Adds snippet and snippet_truncated for the earliest term of ``source``; for rows of a page."""

    @F.pandas_udf("snippet string, truncated boolean")
    def cut(sources: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([snippet(s, earliest(s, terms)) if s is not None and any(t in normalize(s) for t in terms) else (s, False) for s in sources], columns=["snippet", "truncated"])

    return passages.withColumn("_s", cut("source")).withColumn("snippet", F.col("_s.snippet")).withColumn("snippet_truncated", F.col("_s.truncated")).drop("_s")


def _rank(row: dict, covered: set) -> tuple:
    return -len(set(row["matched"]) - covered), -len(row["matched"]), -row["rank"], row["ordinal"]


def context_passages(results: DataFrame, blocks: DataFrame, terms: list[str], limit: int = 3) -> DataFrame:
    """For each document up to ``limit`` blocks, taken greedily: most terms not yet covered, most terms, headings first, ordinal."""
    heading, content = _term_hits(blocks, terms)
    any_heading = reduce(lambda a, b: a | b, heading)
    picked = [F.when(F.when(any_heading, h).otherwise(c), F.lit(t)) for t, h, c in zip(terms, heading, content)]
    rows = of_ids(blocks, results).select(
        "document_id", "ordinal", F.when(any_heading, 2).otherwise(1).alias("rank"), F.col("location_value").alias("location"), F.when(any_heading, F.col("heading")).otherwise(F.col("content")).alias("source"), F.array_compact(F.array(*picked)).alias("matched"),
    ).filter("size(matched) > 0")

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        left = frame.sort_values("ordinal").to_dict("records")
        covered: set = set()
        out = []
        while left and len(out) < limit:
            at = min(range(len(left)), key=lambda i: _rank(left[i], covered))
            best = left.pop(at)
            covered |= set(best["matched"])
            text, cut = snippet(best["source"], earliest(best["source"], list(best["matched"])))
            out.append({"document_id": best["document_id"], "place": len(out) + 1, "ordinal": best["ordinal"], "rank": best["rank"], "location": best["location"], "snippet": text, "snippet_truncated": cut})
        return pd.DataFrame(out)

    return rows.groupBy("document_id").applyInPandas(choose, "document_id long, place int, ordinal int, rank int, location string, snippet string, snippet_truncated boolean")
