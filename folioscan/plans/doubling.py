"""Where groups begin that take rows in order until a bound is passed, found by doubling instead of a walk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored


def passed(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, from, to) for each row (key, k, size, end: running sum): the first row at which a group that starts there passes the limit; null: none.

    A search in the running sums for all rows at once, by one sort.
    """
    asked = rows.select(key, (F.col("end") - F.col("size") + limit).alias("at"), F.lit(0).alias("is_end"), F.col("k").alias("from"), F.lit(None).cast("int").alias("own"))
    ends = rows.select(key, F.col("end").alias("at"), F.lit(1), F.lit(None).cast("int"), "k")
    behind = Window.partitionBy(key).orderBy(F.col("at").desc(), "is_end").rowsBetween(Window.unboundedPreceding, 0)
    return asked.union(ends).withColumn("to", F.min("own").over(behind)).filter("is_end = 0").select(key, "from", "to")


def numbered(rows: DataFrame, key: str, steps: DataFrame, groups: int, number: str) -> DataFrame:
    """Adds the number of its group, from 0, to each row (key, k from 1 on).

    ``steps`` (key, from, next) names the start that follows each row if that is
    a start. Each round joins the starts that are known with steps twice as long,
    so ``groups``, a bound on the groups of a key, takes its logarithm in rounds.
    """
    starts = rows.filter("k = 1").select(key, "k")
    steps = stored(steps, "steps")
    for _ in range(max(0, groups - 1).bit_length()):
        further = starts.join(steps.withColumnRenamed("from", "k"), [key, "k"]).select(key, F.col("next").alias("k"))
        starts = stored(starts.union(further), "starts")
        then = steps.select(key, F.col("from").alias("next"), F.col("next").alias("end"))
        steps = stored(steps.join(then, [key, "next"]).select(key, "from", F.col("end").alias("next")), "steps")
    by = Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.join(starts.withColumn("start", F.lit(1)), [key, "k"], "left")
    return marked.withColumn(number, (F.sum(F.coalesce("start", F.lit(0))).over(by) - 1).cast("int")).drop("start")


def most(frame: DataFrame, bound: Column) -> int:
    return int(frame.agg(F.max(bound)).first()[0] or 0)
