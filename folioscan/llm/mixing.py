"""Mixes sources to target weights by pivotal dependent rounding.

Every document of a source is to be taken target / source_size times on
average. The whole part is taken as it is; the fractional parts are rounded
together: two documents trade mass, counted in words, at random until one of
them is taken wholly or not at all, so the words of the source stay the same
in every step. Documents go to leaves by hash, each leaf leaves one
fractional document at most, and these residuals are combined level by level
up a tree of fixed fan-in. What is left at the root is at most one document
a source, and a small one, as each group trades from its largest document down.

A leaf holds about ``fan_in`` documents whatever the size of the source, so a
source with a third of all rows only has more leaves. Rows that are equal in
id, source and text are one entry with a number: of n such rows with the
fraction p, floor(n p) are taken wholly and one carries the rest on, so they
never fill a leaf however many they are. Random numbers come from hashes of
the documents: reruns and other partitionings give the same rows.

The targets come from windows over one row a source (see targets()).

Defined results
    null or empty text   size 0, taken 0
    very long texts      counted whole; each group trades from its largest
                         document down
    null source          a source of its own, the last one
    null doc_id          a document like others
    repeated rows        each row is a document
    equal marks          documents with one mark trade in order of their ids
    empty table          an empty result
    extra columns        ignored
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"

_GOLD, _A, _B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_FULL = (1 << 64) - 1
#: Equal rows that are written out at once.
_BLOCK = 10_000


def uniform(*parts: int) -> float:
    """A number in [0, 1) that depends on the parts only."""
    x = 0
    for part in parts:
        x = (x + part + _GOLD) & _FULL
        x = ((x ^ (x >> 30)) * _A) & _FULL
        x = ((x ^ (x >> 27)) * _B) & _FULL
        x ^= x >> 31
    return (x >> 11) / float(1 << 53)


def pivotal(sizes, shares, marks) -> list[float]:
    """Rounds ``shares`` to 0.0 or 1.0, all but one at most, keeping the sum of sizes * shares.

    ``marks`` are integers that the random choices depend on. Sizes are positive.
    """
    out = [float(s) for s in shares]
    held = -1
    for i, share in enumerate(out):
        if share <= 0.0 or share >= 1.0:
            continue
        if held < 0:
            held = i
            continue
        p, q, m, n = out[held], share, sizes[held], sizes[i]
        up, down = min(m * (1 - p), n * q), min(m * p, n * (1 - q))
        if uniform(marks[held], marks[i]) * (up + down) < down:
            full, empty = up == m * (1 - p), up == n * q
            p, q = (1.0 if full else p + up / m), (0.0 if empty else q - up / n)
        else:
            empty, full = down == m * p, down == n * (1 - q)
            p, q = (0.0 if empty else p - down / m), (1.0 if full else q + down / n)
        p, q = (x if 1e-12 < x < 1 - 1e-12 else float(round(x)) for x in (p, q))
        out[held], out[i] = p, q
        held = held if 0.0 < p < 1.0 else i if 0.0 < q < 1.0 else -1
    return out


def targets(sized: DataFrame, weights: tuple = (3, 1, 2), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, docs, place, target) for each source of ``sized`` (source, size).

    With sources in order of cap / weight, the level after the first k stop at
    their cap is (budget - their caps) / (weights of the rest); it rises as
    long as sources must stop and falls afterwards, so the level is its maximum.
    The windows run over one row a source, in one task: 40 bytes each, so ten
    million sources are 400 MB, which Spark spills.
    """
    own = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("place"), F.lit(len(weights))) + 1)
    own = own.withColumn("place", order - 1).withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(cap))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * F.lit(budget) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    own = own.withColumn("level", left / rest)
    own = own.withColumn("target", F.least("most", F.max("level").over(every) * F.col("weight")))
    return own.select("source", "source_size", "docs", "place", "target")


def _round(fan_in: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "mark", "doc_id"], ascending=[False, True, True], kind="stable", na_position="last").reset_index(drop=True)
        frame["share"] = pivotal(frame["size"].tolist(), frame["share"].tolist(), (frame["mark"].to_numpy(np.int64).view(np.uint64)).tolist())
        frame["node"] = frame["node"] // fan_in
        return frame

    return run


def mix(docs: DataFrame, weights: tuple = (3, 1, 2), budget: float = 1.5, cap: float = 2.0, fan_in: int = 4096, seed: int = 5) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of ``docs`` (doc_id, text, source)."""
    sized = stored(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("mark")), "sized")
    goal = stored(targets(sized, weights, budget, cap), "targets").withColumnRenamed("source", "from")
    equal = sized.groupBy("doc_id", "source", "size", "mark").agg(F.count("*").alias("rows"))
    rows = equal.join(goal, equal["source"].eqNullSafe(goal["from"])).drop("from")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    node = F.pmod(F.col("mark"), F.ceil(F.col("docs") / fan_in))
    kind = docs.schema["doc_id"].dataType
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would turn integers with nulls into floats
    mass = F.when(F.col("size") > 0, (times - F.floor(times)) * F.col("rows")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(times)).withColumn("up", F.floor(mass)).withColumn("share", mass - F.floor(mass)).withColumn("node", node).drop("docs")
    open_share = (F.col("share") > 0) & (F.col("share") < 1)
    done, level = [rows.filter(~open_share)], rows.filter(open_share)
    leaves = -(-(goal.agg(F.max("docs")).first()[0] or 0) // fan_in)
    while True:
        level = stored(level.groupBy("place", "node").applyInPandas(_round(fan_in), level.schema), "rounded")
        done.append(level.filter(~open_share))
        level = level.filter(open_share)
        if leaves <= 1:
            break
        leaves = -(-leaves // fan_in)
    last = F.udf(lambda mark, share: 1.0 if uniform(mark & _FULL, seed) < share else 0.0, "double")
    done.append(level.withColumn("share", last("mark", "share")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    most = sized.groupBy("doc_id", "source", "size", "mark").count().agg(F.max("count")).first()[0] or 0
    out = out.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / _BLOCK))))
    out = out.repartition("mark", "block") if most > _BLOCK else out
    out = out.withColumn("number", F.explode(F.sequence(F.col("block") * _BLOCK, F.least(F.col("rows"), (F.col("block") + 1) * _BLOCK) - 1)))
    extra = F.when(F.col("number") < F.col("up"), 1).when(F.col("number") == F.col("up"), F.col("share")).otherwise(0)
    copies = (F.col("whole") + extra).cast("long")
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
