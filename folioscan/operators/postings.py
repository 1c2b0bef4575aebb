"""Gram postings: which documents hold which substrings of one to three code points.

Postings narrow a search to candidates, which are then checked exactly. A gram
is kept as one number, each code point as a digit of 21 bits (plus one, so
that grams of different lengths differ); nothing is lost by that. The distinct
grams of a document are found with numpy over its blocks in one row, so no
(gram, document) pair is made twice and none is shuffled to be made distinct.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LARGEST = 3
#: Grams of a term that are looked up; they are spread over the term and only narrow the search.
LOOKED_UP = 8

POSTINGS = "gram long, document_id long"
#: Stored postings: documents ``first`` to ``last`` that hold a gram, ``n`` of them, as steps from one to the next of 32 bits.
PACKED = "gram long, n int, first long, last long, steps binary"
#: Documents of one packed row at most.
PACK = 4096
#: Grams that a search looks up, the rarest of its term.
RAREST = 3
#: A term whose rarest gram stands in more than this share of the documents is searched without postings.
FREQUENT = 0.25


def number(gram: str) -> int:
    return reduce(lambda n, c: n << 21 | ord(c) + 1, gram, 0)


def gram(number: int) -> str:
    out = ""
    while number:
        number, digit = number >> 21, number & 0x1FFFFF
        out = chr(digit - 1) + out
    return out


@F.pandas_udf(StringType())
def gram_text(numbers: pd.Series) -> pd.Series:
    return numbers.map(gram)


def numbers_of(texts: list[str], sizes, wanted: np.ndarray | None = None) -> np.ndarray:
    """The distinct grams of some texts, sorted, or those of ``wanted``; none goes over the end of a text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    ends = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
    found = []
    for n in sizes:
        at = np.flatnonzero(np.arange(len(points)) + n <= ends)
        grams = reduce(lambda key, k: key << 21 | points[at + k], range(1, n), points[at])
        found.append(grams if wanted is None else grams[np.isin(grams, wanted)])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def gram_postings(blocks: DataFrame, *sizes: int, headings: bool = False, terms: tuple = ()) -> DataFrame:
    """POSTINGS: each distinct gram of ``sizes`` code points of a document's blocks (document_id, content_norm, heading_norm).

    With ``terms`` only the grams that candidates() looks up for them leave the tasks.
    """
    asked = {g for t in terms for g in query_grams(t)}
    wanted = np.array([number(g) for g in asked], np.int64) if terms else None
    sizes = [n for n in sizes if not terms or any(len(g) == n for g in asked)]
    texts = [F.col("content_norm"), F.col("heading_norm")] if headings else [F.col("content_norm")]
    whole = blocks.groupBy("document_id").agg(F.flatten(F.collect_list(F.array_compact(F.array(*texts)))).alias("texts"))
    names = [c.split()[0] for c in POSTINGS.split(", ")]

    def run(batches):
        for batch in batches:
            for document, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = numbers_of(texts, sizes, wanted)
                if terms and not len(grams):
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.int64()), pa.array(np.full(len(grams), document, np.int64))], names=names)

    return whole.mapInArrow(run, POSTINGS)


def packed(postings: DataFrame) -> DataFrame:
    """PACKED rows of postings; a gram of very many documents is spread over tasks and rows."""
    names = [c.split()[0] for c in PACKED.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def rows(gram: np.ndarray, document: np.ndarray) -> pa.RecordBatch:
        far = np.diff(document, prepend=document[:1])
        cut = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (far[1:] >= 1 << 32))))
        cut = np.concatenate([np.arange(a, b, PACK) for a, b in zip(cut, [*cut[1:], len(gram)], strict=True)])
        end = np.concatenate((cut[1:], [len(gram)]))
        steps = [far[a + 1 : b].astype("<u4").tobytes() for a, b in zip(cut, end, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((gram[cut], end - cut, document[cut], document[end - 1], steps), types, strict=True)], names=names)

    def run(batches):
        gram, document = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            gram, document = (np.concatenate((held, batch.column(i).to_numpy())) for i, held in enumerate((gram, document)))
            once = np.concatenate(([True], (gram[1:] != gram[:-1]) | (document[1:] != document[:-1])))[: len(gram)]
            gram, document = gram[once], document[once]
            if len(gram) > 16 * PACK:  # the last gram may go on
                whole = int(np.searchsorted(gram, gram[-1])) or len(gram) // PACK * PACK
                yield rows(gram[:whole], document[:whole])
                gram, document = gram[whole:], document[whole:]
        if len(gram):
            yield rows(gram, document)

    return postings.repartitionByRange("gram", "document_id").sortWithinPartitions("gram", "document_id").mapInArrow(run, PACKED)


def unpacked(rows: DataFrame) -> DataFrame:
    """POSTINGS of PACKED rows."""

    def run(batches):
        for batch in batches:
            for gram, n, first, _, steps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                document = first + np.concatenate(([0], np.cumsum(np.frombuffer(steps, "<u4"), dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, gram, np.int64)), pa.array(document)], names=["gram", "document_id"])

    return rows.select(*[c.split()[0] for c in PACKED.split(", ")]).mapInArrow(run, POSTINGS)


class Index:
    """Packed postings of a stored collection, as searches use them: the rarest grams of a term, and only the rows of these."""

    def __init__(self, lookup: Callable[[list[int]], DataFrame], documents: int):
        self.lookup, self.documents = lookup, documents

    def candidates(self, *terms: str) -> DataFrame | None:
        """(document_id) of the documents that may hold one of the terms; None where so many may that a scan is the shorter way.

        One job asks for the frequencies of all grams, summed by gram; lists
        are read of the rarest ones only. A gram that is nowhere ends it.
        """
        wanted = {t: [number(g) for g in query_grams(t)] for t in terms}
        every = sorted({g for grams in wanted.values() for g in grams})
        often = {r.gram: r.n for r in self.lookup(every).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        chosen = {t: sorted(grams, key=lambda g: often.get(g, 0))[:RAREST] for t, grams in wanted.items()}
        if any(often.get(grams[0], 0) > FREQUENT * self.documents for grams in chosen.values()):
            return None
        held = [grams for grams in chosen.values() if all(g in often for g in grams)]
        some = sorted({g for grams in held for g in grams})
        if not some:
            return self.lookup([]).select(F.col("first").alias("document_id")).limit(0)
        return _holding(unpacked(self.lookup(some)), held)


def query_grams(term: str, most: int = LOOKED_UP) -> list[str]:
    """Grams that a text with the term must hold: of 3 code points, or as many as the term has, ``most`` of them from all over the term."""
    n = min(LARGEST, len(term))
    every = list(dict.fromkeys(term[i : i + n] for i in range(len(term) - n + 1)))
    return [every[i] for i in sorted({k * (len(every) - 1) // max(1, most - 1) for k in range(most)})] if len(every) > most else every


def _holding(rows: DataFrame, wanted: list[list[int]]) -> DataFrame:
    """(document_id) of the documents that hold all grams of one of the lists: one aggregation."""
    held = []
    for grams in wanted:
        bit = F.coalesce(*[F.when(F.col("gram") == g, 1 << i) for i, g in enumerate(grams)], F.lit(0))
        held.append(F.bit_or(bit) == (1 << len(grams)) - 1)
    return rows.groupBy("document_id").agg(reduce(lambda a, b: a | b, held).alias("all")).filter("all").select("document_id")


#: Postings as a table, or those of a stored collection.
Postings = DataFrame | Index


def candidates(postings: Postings, *terms: str) -> DataFrame | None:
    """(document_id) of documents that hold every gram of one of the terms; None: all documents have to be searched.

    A row that stands there twice counts once, so postings that were added to stay right.
    """
    if isinstance(postings, Index):
        return postings.candidates(*terms)
    wanted = [[number(g) for g in query_grams(t)] for t in terms]
    return _holding(postings.filter(F.col("gram").isin(sorted({g for grams in wanted for g in grams}))), wanted)


def verified(blocks: DataFrame, postings: DataFrame, term: str) -> DataFrame:
    """(document_id, ordinal) of the first block with the term, read from the candidates only."""
    narrowed = blocks.join(candidates(postings, term), "document_id", "left_semi")
    return narrowed.filter(F.col("content_norm").contains(term)).groupBy("document_id").agg(F.min("ordinal").alias("ordinal"))
