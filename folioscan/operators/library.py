"""A small library of recent and pinned files, groups and saved searches."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# How many entries each list keeps.
RECENT, PINNED, GROUPS, ITEMS, SEARCHES = 100, 100, 50, 200, 100


def name_key(name: str) -> str:
    """The key under which group names are unique; ValueError if the name is empty, too long or has control characters."""
    shown = unicodedata.normalize("NFKC", name).strip()
    if not 1 <= len(shown) <= 80 or any(unicodedata.category(c) == "Cc" for c in shown):
        raise ValueError("a name has 1 to 80 characters and no control characters")
    return shown.lower()


def recent(uses: DataFrame, keep: int = RECENT) -> DataFrame:
    """The last use and the number of uses of each path, for the ``keep`` paths used last."""
    last = uses.groupBy("path").agg(F.max("used_at").alias("last_used_at"), F.max_by("action", F.struct("used_at", "use_id")).alias("last_action"), F.count("*").alias("uses"))
    return last.orderBy(F.col("last_used_at").desc(), "path").limit(keep)


def upserted(old: DataFrame, new: DataFrame, key: str, time: str, keep: int) -> DataFrame:
    """The newest row of each key of both tables, the ``keep`` newest in all."""
    newest = Window.partitionBy(key).orderBy(F.col(time).desc())
    rows = old.unionByName(new).withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
    return rows.orderBy(F.col(time).desc(), key).limit(keep)


class Full(ValueError):
    """A list of the library has no room for another entry."""


def added(old: DataFrame, new: DataFrame, key: str, most: int) -> DataFrame:
    """``old`` with the ``new`` rows in place of those with the same key; Full if that makes more than ``most``.

    For lists that a user keeps by hand, such as pinned files and saved
    searches, where nothing may fall out by itself. They are small by nature.
    """
    rows = old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new)
    if rows.limit(most + 1).count() > most:
        raise Full(f"more than {most} entries")
    return rows


def removed(old: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return old.join(gone.select(key), key, "left_anti").select(*old.columns)


# Fixed value: files that can be dropped in at once.
IMPORTED = 20


def imported(files: DataFrame, terms: list[str], query: str, most: int = IMPORTED) -> DataFrame:
    """(path, rank, imported) of files dropped in (path, filename_norm) whose names match: 4 as a whole, 3 with all terms."""
    if files.limit(most + 1).count() > most:
        raise Full(f"more than {most} files")
    name = F.col("filename_norm")
    rank = F.when(name == query, 4).when(reduce(lambda a, b: a & b, [name.contains(t) for t in terms]), 3)
    return files.withColumn("rank", rank).filter("rank is not null").select("path", "rank", F.lit(True).alias("imported"))


def groups_with_items(groups: DataFrame, items: DataFrame, keep: int = ITEMS) -> DataFrame:
    """Each group with its paths, at most ``keep`` by position; empty groups stay."""
    at = Window.partitionBy("group_id").orderBy("added_at", "path")
    rows = items.withColumn("n", F.row_number().over(at)).filter(F.col("n") <= keep)
    held = rows.groupBy("group_id").agg(F.count("*").alias("n_items"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "path"))), lambda x: x["path"]), "\n").alias("paths"))
    return groups.join(held, "group_id", "left").select("group_id", "name", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("paths", F.lit("")).alias("paths"))
