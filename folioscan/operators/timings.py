"""Timings: nearest-rank percentiles, slowest files, phase totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# Fixed value: samples of a key where a bounded sample is asked for.
SAMPLED = 20_000


def sampled(samples: DataFrame, key: str, limit: int = SAMPLED) -> DataFrame:
    """At most ``limit`` rows of each key: those with the smallest hashes of the whole row, all rows of a key with fewer.

    Samples of parts of the data merge into that of the whole: Spark cuts each
    task's rows to ``limit`` before it shuffles them, and again behind that, so a
    key with all rows costs each task as much as any other. Equal rows have one hash.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in samples.columns])))
    return samples.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place")


# How far around a percentile, as a share of the rows, the bounds are guessed, and how exact the guess is.
AROUND, GUESS = 0.005, 1_000


def percentiles(samples: DataFrame, key: str, value: str, *shares: float) -> DataFrame:
    """(_key, p0, p1, ..): exact nearest-rank percentiles of ``value`` by ``key``.

    Approximate percentiles cut the values of a key into ranges; whatever they
    are, counts by range tell exactly in which one a rank lies, and only the
    distinct values of that range are put in order. With good guesses that is a
    hundredth of the rows for each percentile.
    """
    rows = samples.filter(F.col(value).isNotNull()).select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    at = sorted({min(1.0, max(0.0, p + d)) for p in shares for d in (-AROUND, AROUND)})
    cuts = rows.groupBy("_key").agg(F.percentile_approx("_value", at, GUESS).alias("_cuts")).withColumnRenamed("_key", "_k")
    place = sum((F.when(F.col("_value") > F.get("_cuts", F.lit(i)), 1).otherwise(0) for i in range(len(at))), F.lit(0))
    dealt = rows.join(F.broadcast(cuts), F.col("_key").eqNullSafe(F.col("_k"))).select("_key", "_value", place.alias("_range"))
    up = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    sizes = dealt.groupBy("_key", "_range").agg(F.count("*").alias("_n")).withColumn("_end", F.sum("_n").over(up)).withColumn("_all", F.sum("_n").over(Window.partitionBy("_key")))
    ranks = [F.greatest(F.ceil(F.col("_all") * F.lit(p)), F.lit(1)) for p in shares]
    asked = sizes.select("_key", "_range", (F.col("_end") - F.col("_n")).alias("_before"), "_end", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), r.alias("rank")) for i, r in enumerate(ranks)])).alias("_ask"))
    asked = asked.filter((F.col("_ask.rank") > F.col("_before")) & (F.col("_ask.rank") <= F.col("_end"))).select(F.col("_key").alias("_k"), F.col("_range").alias("_r"), (F.col("_ask.rank") - F.col("_before")).alias("_rank"), F.col("_ask.i").alias("_i"))
    near = dealt.join(F.broadcast(asked), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r")))
    counts = near.groupBy("_key", "_i", "_rank", "_value").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_key", "_i").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0))
    found = counts.withColumn("_upto", upto).filter(F.col("_upto") >= F.col("_rank"))
    return found.groupBy("_key").agg(*[F.min(F.when(F.col("_i") == i, F.col("_value"))).alias(f"p{i}") for i in range(len(shares))])


def summary(samples: DataFrame, key: str, value: str, limit: int | None = None) -> DataFrame:
    """Count, p50, p95 and maximum of ``value`` by ``key``, with two decimals; percentiles are nearest-rank, with ``limit`` of a bounded sample where a key has more rows."""
    whole = samples.groupBy(key).agg(F.count(value).alias("n"), F.round(F.max(value), 2).alias("most"))
    held = samples if limit is None else sampled(samples.filter(F.col(value).isNotNull()), key, limit)
    ranks = percentiles(held, key, value, 0.5, 0.95).select("_key", F.round("p0", 2).alias("p50"), F.round("p1", 2).alias("p95"))
    return whole.join(ranks, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, "n", "p50", "p95", "most")


def slowest(samples: DataFrame, value: str, ident: str, limit: int = 20) -> DataFrame:
    return samples.orderBy(F.col(value).desc(), F.col(ident)).limit(limit)


def last_samples(samples: DataFrame, key: str, time: str, ident: str, limit: int = 32) -> DataFrame:
    """The newest ``limit`` samples of each key."""
    newest = Window.partitionBy(key).orderBy(F.col(time).desc(), F.col(ident).desc())
    return samples.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= limit)


def phase_rollup(records: DataFrame, key: str, phase: str, value: str) -> DataFrame:
    """(key, phase, inclusive, self, bottleneck): what each phase of a trace took, with and without the phases inside it.

    Phases are named by path, ``parent/child``. What a phase took by itself is
    its total less that of its children, never below 0; the bottleneck of a
    trace is the phase that took most by itself, the first by name where several did.
    """
    totals = records.groupBy(F.col(key).alias("key"), F.col(phase).alias("phase")).agg(F.sum(value).alias("inclusive"))
    parent = F.regexp_extract("phase", "^(.*)/[^/]*$", 1)
    inner = totals.filter(F.col("phase").contains("/")).groupBy(F.col("key").alias("k"), parent.alias("p")).agg(F.sum("inclusive").alias("inner"))
    rows = totals.join(inner, (F.col("key") == F.col("k")) & (F.col("phase") == F.col("p")), "left")
    rows = rows.withColumn("self", F.greatest(F.col("inclusive") - F.coalesce("inner", F.lit(0.0)), F.lit(0.0)))
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.col("self").desc(), "phase"))
    return rows.select(F.col("key").alias(key), "phase", F.round("inclusive", 2).alias("inclusive"), F.round("self", 2).alias("self"), (first == 1).alias("bottleneck"))


def error_counts(samples: DataFrame, code: str = "code") -> DataFrame:
    """(code, n, last_at) of watcher errors (code, at), most frequent first by the caller's order."""
    return samples.filter(F.col(code).isNotNull()).groupBy(F.col(code).alias("code")).agg(F.count("*").alias("n"), F.max("at").alias("last_at"))
