"""The corpus pipeline over documents: each stage is written as Parquet and read again as the next one's docs.

1. toxicity        rows at or above the rejecting severity go
2. simhash         of each group of near copies (five-word shingles, 0.8 or more) the smallest doc_id stays
3. substrings      bytes that repeat 50-byte strings of a smaller doc_id are cut out of the texts
4. decontaminate   rows that hold a test item go
5. mixing          words that the mix takes of each row that is left

Stages 1 to 4 return the columns of documents.

Defined results
    null or empty text   severity of the bias; such rows are copies of each
                         other (one stays); nothing to cut, no test item, size 0
    very long texts      read whole by every stage
    null doc_id          each such row is a document of its own; ids count as
                         the largest where strings are cut
    repeated rows        rows equal in id and text are one after stage 2
    repeated doc_id      rows with other texts stay, each with its own result
    null source          a source of its own, the last one
    ties                 the smallest doc_id stays, the first copy keeps a string
    empty tables         an empty result; without labels or items nothing is
                         rejected by these
    extra columns        returned by stages 1 to 4, whatever their names
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscan.llm import decontaminate, mixing, simhash, substrings, toxicity
from folioscan.llm.common import drop, dropped_after, fresh_path, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, **simhash.EIGHTY_PERCENT)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.cleaned(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", without_toxic),
    ("simhash", without_near_copies),
    ("substrings", without_repeats),
    ("decontaminate", without_leaks),
    ("mixing", mixed),
]

#: SQL has neither the models nor the alignment; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage has stored on the way is deleted once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        with dropped_after(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
