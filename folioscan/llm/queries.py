"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from . import alignment, compaction, decontaminate, extract, jaccard, licenses, linefreq, mixing, quality, simhash, substrings, toxicity, warc
from .common import table


def op1_warc(spark, sf_dir):
    return warc.page_records(table(spark, sf_dir, "pages"))


def op2_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_linefreq(spark, sf_dir):
    return linefreq.verdicts(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark, sf_dir):
    return toxicity.graded(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_licenses(spark, sf_dir):
    return licenses.labelled(table(spark, sf_dir, "documents"))


def op8_extract(spark, sf_dir):
    return extract.page_texts(table(spark, sf_dir, "pages"))


def op9_quality(spark, sf_dir):
    return quality.graded(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_substrings(spark, sf_dir):
    return substrings.digested(table(spark, sf_dir, "documents"))


def op11_jaccard(spark, sf_dir):
    return jaccard.joined(table(spark, sf_dir, "documents"))


def op12_alignment(spark, sf_dir):
    return alignment.aligned(table(spark, sf_dir, "documents"))


def op13_compaction(spark, sf_dir):
    return compaction.compacted(table(spark, sf_dir, "clicks"))


QUERIES = {"op1_warc": op1_warc, "op2_simhash": op2_simhash, "op3_linefreq": op3_linefreq, "op4_toxicity": op4_toxicity, "op5_mixing": op5_mixing, "op6_decontaminate": op6_decontaminate, "op7_licenses": op7_licenses, "op8_extract": op8_extract, "op9_quality": op9_quality, "op10_substrings": op10_substrings, "op11_jaccard": op11_jaccard, "op12_alignment": op12_alignment, "op13_compaction": op13_compaction}
