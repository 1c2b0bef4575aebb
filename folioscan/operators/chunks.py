"""Chunks and payloads: how blocks are laid out for storage.

A chunk takes blocks of a document in order until the next one would pass its
size; a payload is one distinct text, whichever blocks hold it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.doubling import most, numbered, passed
from ..plans.scratch import stored

# Fixed value: UTF-16 units that a chunk holds.
CHUNK = 64 << 10


def chunk_numbers(sizes: list[int], limit: int = CHUNK) -> list[int | None]:
    """The chunk of each block, from 0; None for empty blocks, which are in no chunk.

    Each block takes its size and one unit for a separator; a block that would
    end behind the limit starts a new chunk, one that is larger has its own.
    """
    out: list[int | None] = []
    number, held, begun = 0, 0, False
    for size in sizes:
        if not size:
            out.append(None)
            continue
        if begun and held + size > limit:
            number, held = number + 1, 0
        out.append(number)
        held, begun = held + size + 1, True
    return out


def chunked(blocks: DataFrame, limit: int = CHUNK) -> DataFrame:
    """(document_id, ordinal, size, chunk) of blocks (document_id, ordinal, content) that are not empty, sizes in UTF-16 units.

    Where a chunk that starts at a block would end is a search in the running
    sums of the sizes, done for all blocks at once by one sort. Which of these
    starts are really reached from the first block is found by doubling: each
    round joins the starts that are known with steps twice as long. So the
    rounds grow with the logarithm of the chunks of a document, and no document
    is gone through block by block. Documents that fit into one chunk, most of
    them, take no round.
    """
    units = (F.octet_length(F.encode("content", "UTF-16BE")) / 2).cast("long")
    by = Window.partitionBy("document_id").orderBy("ordinal")
    rows = blocks.select("document_id", "ordinal", (units + 1).alias("size")).filter("size > 1")
    rows = stored(rows.withColumn("k", F.row_number().over(by)).withColumn("end", F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0))), "running")
    totals = rows.groupBy("document_id").agg(F.max("end").alias("total"), F.max("k").alias("last")).filter(F.col("total") > limit + 1)
    large = rows.join(totals.select("document_id"), "document_id", "left_semi")
    steps = passed(large, "document_id", limit + 1).filter("to is not null").select("document_id", "from", F.greatest("to", F.col("from") + 1).alias("next"))
    found = numbered(rows, "document_id", steps, most(totals, F.least(F.ceil(2 * F.col("total") / limit) + 2, F.col("last"))), "chunk")
    return found.select("document_id", "ordinal", (F.col("size") - 1).alias("size"), "chunk")


def payloads(blocks: DataFrame) -> DataFrame:
    """(payload, content_norm, n_blocks): each distinct text of the blocks under the SHA-256 of its normal form."""
    return blocks.groupBy(F.sha2("content_norm", 256).alias("payload"), "content_norm").agg(F.count("*").alias("n_blocks"))


def holding(blocks: DataFrame, term: str) -> DataFrame:
    """(document_id, ordinal) of the blocks with a term: distinct payloads are searched once, then joined to where they stand."""
    found = payloads(blocks).filter(F.col("content_norm").contains(term)).select("payload")
    placed = blocks.select("document_id", "ordinal", F.sha2("content_norm", 256).alias("payload"))
    return placed.join(found, "payload").select("document_id", "ordinal")
