"""Quality rules with cross-document line frequency.

One pass over the texts gives the base counts and, for each row, its distinct
normalised lines as hashes with their numbers of words. A line's frequency on
a host (the source) is the number of distinct documents of that host that hold
it. Lines above the limit are boilerplate and are removed; a document that the
base rules let pass is kept unless its boilerplate leaves it depleted.

Limit: more than ``least`` documents and more than ``share`` of the host's
documents. Depleted: fewer than ``left_words`` words left, or less than
``left_share`` of its words.

Normalised line: A-Z lower-cased, digits as 0, words joined by single spaces;
its XXH64 stands for it. Windows of repeated words are found by 64-bit hashes
and then compared word by word.

Counting is a distinct of (host, line, document) and then a sum of partial
counts, so a line that a third of all rows hold is counted in every task and
added up once; boilerplate lines meet the rows in a join of shuffled sides,
which the adaptive skew join can split.

Defined results
    null or empty text   counts of 0, base_failed (it has under 20 words)
    very long texts      measured whole
    null source          a host of its own
    null doc_id          each such row is a document of its own
    repeated doc_id      one document a host, whatever the texts; each row gets
                         its own verdict
    a tie at a limit     stays: only more than the limit is boilerplate, only
                         less than what must be left is depleted
    empty table          an empty result
    extra columns        ignored; without_boilerplate() returns them
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, stored

_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in _SYMBOLS)
_CONTINUED = bytes(b for b in range(256) if not 0x80 <= b < 0xC0)
_DIGITS = bytes.maketrans(b"123456789", b"000000000")
_WINDOW = 8

ROW = "doc_id long, source string, row long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of 8 words that are found twice or more in the text."""
    n = len(words) - _WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    window = np.zeros(n, np.uint64)
    for k in range(_WINDOW):
        window = window * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
        window ^= window >> np.uint64(29)
    order = np.argsort(window, kind="stable")
    pair = np.flatnonzero(window[order[1:]] == window[order[:-1]])
    if not len(pair):
        return 0
    one, two = order[pair], order[pair + 1]
    if all((ids[one + k] == ids[two + k]).all() for k in range(_WINDOW)):
        at = np.unique(np.concatenate((one, two)))
    else:  # two windows with one hash: the words decide
        held: dict[tuple, list[int]] = {}
        for i in np.unique(np.concatenate((one, two))).tolist():
            held.setdefault(tuple(words[i : i + _WINDOW]), []).append(i)
        at = np.array([i for places in held.values() if len(places) > 1 for i in places], np.int64)
    edge = np.zeros(len(words) + 1, np.int64)
    edge[at] += 1
    np.add.at(edge, at + _WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def normal_line(line: bytes) -> bytes:
    return b" ".join(line.lower().translate(_DIGITS).split())


def measured(text: bytes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, hashes of the normalised lines, words in them."""
    words = text.split()
    chars = sum(map(len, words)) - len(text.translate(None, _CONTINUED))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    held: dict[int, int] = {}
    for line in lines:
        normal = normal_line(line)
        key = xxhash.xxh64_intdigest(normal)
        held[key] = held.get(key, 0) + normal.count(b" ") + 1
    keys = np.fromiter(held, np.uint64, len(held)).view(np.int64)
    return len(words), chars, len(text.translate(None, _NOT_SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), keys.tolist(), list(held.values())


def base_counts(docs: DataFrame) -> DataFrame:
    """ROW for every row of ``docs`` (doc_id, text, source)."""
    types = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(batches):
        for batch in batches:
            columns = list(zip(*[measured(t or b"") for t in batch.column(3).to_pylist()])) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), batch.column(2), *[pa.array(c, t) for c, t in zip(columns, types)]], names=[c.split()[0] for c in ROW.split(", ")])

    return docs.select("doc_id", "source", F.monotonically_increasing_id().alias("row"), F.col("text").cast("binary").alias("text")).mapInArrow(freeing(run), ROW)


def frequent_lines(rows: DataFrame, least: int, share: float) -> DataFrame:
    """(host, frequent, n_documents): the lines above the limit on each host of stored ``rows`` (source, doc_id, row, lines)."""
    rows = rows.withColumn("document", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.col("row"))))
    hosts = rows.groupBy(F.col("source").alias("on")).agg(F.count_distinct("document").alias("documents"))
    lines = rows.select("source", "document", F.explode("lines").alias("line")).groupBy("source", "line").agg(F.count_distinct("document").alias("n_documents")).filter(F.col("n_documents") > least)
    over = F.col("n_documents") > F.col("documents") * F.lit(share)
    return lines.join(hosts, lines["source"].eqNullSafe(hosts["on"])).filter(over).select(F.col("source").alias("host"), F.col("line").alias("frequent"), "n_documents")


def verdicts(docs: DataFrame, least: int = 10, share: float = 0.05, left_words: int = 8, left_share: float = 0.3) -> DataFrame:
    """Base counts, base_failed, n_boilerplate_words and kept for every row of ``docs``."""
    rows = stored(base_counts(docs), "lines")
    lines = rows.select("source", F.col("row").alias("of"), F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("source", "of", "x.lines", "x.line_words")
    frequent = frequent_lines(rows, least, share)
    removed = (
        lines.join(frequent, lines["source"].eqNullSafe(frequent["host"]) & (lines["lines"] == frequent["frequent"]))
        .groupBy("of").agg(F.sum("line_words").alias("n_boilerplate_words"))
    )
    out = rows.drop("lines", "line_words").join(removed, F.col("row") == F.col("of"), "left")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    gone = F.coalesce("n_boilerplate_words", F.lit(0)).cast("long")
    left = F.col("n_words") - gone
    kept = ~failed & (left >= left_words) & (left >= F.col("n_words") * F.lit(left_share))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), gone.alias("n_boilerplate_words"))


def without_boilerplate(docs: DataFrame, least: int = 10, share: float = 0.05) -> DataFrame:
    """``docs`` with the boilerplate lines of their host taken out of the text; all rows and columns stay."""
    rows = stored(base_counts(docs), "lines")
    lines = rows.select("source", "doc_id", "row", F.explode("lines").alias("line"))
    frequent = frequent_lines(rows, least, share)
    # rows of one host and document lose the same lines, so they need not be told apart
    hit = lines.join(frequent, lines["source"].eqNullSafe(frequent["host"]) & (lines["line"] == frequent["frequent"]))
    bad = hit.groupBy(F.col("source").alias("__folio_of"), F.col("doc_id").alias("__folio_with")).agg(F.collect_set("line").alias("__folio_bad"))

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, bad: pd.Series) -> pd.Series:
        def clean(text, drop):
            if text is None or drop is None or not len(drop):
                return text
            drop = set(np.asarray(drop, np.int64).view(np.uint64).tolist())
            return "\n".join(x for x in text.split("\n") if xxhash.xxh64_intdigest(normal_line(x.encode("utf-8"))) not in drop)

        return texts.combine(bad, clean)

    joined = docs.join(bad, docs["source"].eqNullSafe(bad["__folio_of"]) & docs["doc_id"].eqNullSafe(bad["__folio_with"]), "left")
    return joined.select(*[cleaned("text", "__folio_bad").alias("text") if c == "text" else docs[c] for c in docs.columns])
