"""Keeping an inventory fresh: reasons to read a file again, differences between snapshots, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, below

# States of a document, reasons to read it again, extensions that are read, those that are read as text.
STATUSES = ("indexed", "no_text", "unsupported", "too_large", "encrypted", "error")
REASONS = ("rebuild", "added", "source-changed", "error-retry", "text-upgrade", "unsupported-retry", "unchanged")
READ = (".md", ".txt", ".xml", ".java", ".sql", ".js", ".docx", ".pptx", ".xlsx", ".xlsm", ".odt", ".rtf", ".csv", ".pdf", ".doc", ".xls", ".mht", ".mhtml", ".html", ".htm", ".xhtml", ".adoc", ".msg", ".vsd")
READ_AS_TEXT = (".txt", ".md", ".adoc", ".xml", ".java", ".sql", ".js")
TEXT_VERSION = 1


def upgrade_needed(extension: Column, status: Column, version: Column) -> Column:
    return extension.isin(*READ_AS_TEXT) & (status != "too_large") & (F.coalesce(version, F.lit(0)) < TEXT_VERSION)


def classified(disk: DataFrame, index: DataFrame, rebuild: bool = False) -> DataFrame:
    """path, extension, reason, action for every file on disk (path, extension, size_bytes, modified_at_ms) against the index."""
    old = index.select("path", F.col("status").alias("old_status"), F.col("parse_version").alias("old_version"), F.col("size_bytes").alias("old_size"), F.col("modified_at_ms").alias("old_time"))
    rows = disk.join(old, "path", "left")
    reason = (
        F.when(F.lit(rebuild), "rebuild").when(F.col("old_status").isNull(), "added")
        .when((F.col("old_size") != F.col("size_bytes")) | (F.col("old_time") != F.col("modified_at_ms")), "source-changed")
        .when(F.col("old_status") == "error", "error-retry")
        .when(upgrade_needed(F.col("extension"), F.col("old_status"), F.col("old_version")), "text-upgrade")
        .when((F.col("old_status") == "unsupported") & F.col("extension").isin(*READ), "unsupported-retry").otherwise("unchanged")
    )
    action = F.when(F.col("reason") == "unchanged", "skip").when(~F.col("extension").isin(*READ), "metadata").otherwise("parse")
    return rows.withColumn("reason", reason).withColumn("action", action).select("path", "extension", "reason", "action")


def counted(rows: DataFrame, column: str, values: tuple) -> DataFrame:
    """(column, n) for each of the fixed values, zeros included."""
    fixed = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return fixed.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def difference(disk: DataFrame, index: DataFrame) -> DataFrame:
    """path and change (added, removed, changed, same) by a full outer join of two snapshots."""
    a = disk.select("path", F.col("size_bytes").alias("now_size"), F.col("modified_at_ms").alias("now_time"))
    b = index.select("path", F.col("size_bytes").alias("old_size"), F.col("modified_at_ms").alias("old_time"))
    same = (F.col("now_size") == F.col("old_size")) & (F.col("now_time") == F.col("old_time"))
    change = F.when(F.col("old_size").isNull(), "added").when(F.col("now_size").isNull(), "removed").when(same, "same").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def missing(index: DataFrame, known: DataFrame, scope: str, protected: list[str]) -> DataFrame:
    """Indexed documents below ``scope`` that are no longer known, and whether a folder that could not be read protects them."""
    gone = index.filter(below("path", scope)).join(known.select("path"), "path", "left_anti")
    safe = F.lit(False)
    for folder in protected:
        safe = safe | below("path", folder)
    return gone.withColumn("protected", safe)


def owned(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """The longest registered root that covers each path (null if none): an equi-join on the folders above it."""
    above = paths.select("path", F.explode(ancestors("path")).alias("root"))
    best = above.join(roots.select("root"), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.join(best, "path", "left")


def explained(paths: DataFrame, index: DataFrame, roots: DataFrame, rule: Column) -> DataFrame:
    """path and state: outside-root, excluded, unindexed, parse-failed, filename-only or indexed; ``rule`` is an expression on path and root."""
    rows = owned(paths, roots).withColumn("rule", rule).join(index.select("path", "status"), "path", "left")
    state = (
        F.when(F.col("root").isNull(), "outside-root").when(F.col("rule").isNotNull(), "excluded").when(F.col("status").isNull(), "unindexed")
        .when(F.col("status").isin("error", "encrypted", "too_large"), "parse-failed").when(F.col("status") != "indexed", "filename-only").otherwise("indexed")
    )
    return rows.select("path", state.alias("state"), "rule")
