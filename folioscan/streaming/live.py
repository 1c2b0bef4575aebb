"""Live updates: debounce, a deduplicated work queue, throttled rescans, fair batches.

The batch forms define the results; the streaming forms keep the same state
per key and can be replayed, so writers only have to be idempotent.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.paths import IgnoreRule, ancestors, below, excluded_by
from ..operators.inventory import difference
from ..operators.timings import summary
from ..plans.doubling import most as largest
from ..plans.doubling import numbered, passed
from ..plans.scratch import fresh, shared, stored

# Fixed values, in milliseconds and rows.
QUIET, FORCED = 1_500, 15_000
OLDEST, NEWEST = 400, 100
OVERFLOW = 10_000
COOL_DOWN, WINDOW, PER_WINDOW, BACK_OFF = 5_000, 60_000, 4, (5_000, 15_000, 60_000)
KEYS = 1_024


def millis(column: str = "ts"):
    return F.unix_millis(F.col(column).cast("timestamp"))


def quiet_bursts(events: DataFrame, key: str, ts: str = "ts", quiet: int = QUIET) -> DataFrame:
    """(key, burst, started, ended, n): events of a key with less than ``quiet`` between neighbours."""
    by = Window.partitionBy(key).orderBy(ts, "event_id")
    gap = millis(ts) - F.lag(millis(ts)).over(by)
    rows = events.withColumn("new", F.when(gap < quiet, 0).otherwise(1)).withColumn("burst", F.sum("new").over(by))
    return rows.groupBy(key, "burst").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n"))


def debounce(times: list[int], quiet: int = QUIET, forced: int = FORCED) -> list[tuple[int, int, int, int]]:
    """(first, last, events, due) of each update: due after ``quiet`` without an event, ``forced`` after the first at the latest."""
    out: list[tuple[int, int, int, int]] = []
    for t in sorted(times):
        if out and t < out[-1][3]:
            first, _, n, _ = out[-1]
            out[-1] = (first, t, n + 1, min(t + quiet, first + forced))
        else:
            out.append((t, t, 1, min(t + quiet, t + forced)))
    return out


def debounced(events: DataFrame, key: str, ts: str = "ts", quiet: int = QUIET, forced: int = FORCED) -> DataFrame:
    """(key, first, last, n, due) of the updates of each key.

    A pause of ``quiet`` always ends an update, so pauses cut the events of a
    key into bursts by a window. A burst shorter than ``forced`` is one update;
    only the events of longer ones are gone through one after the other, each
    burst by itself.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = debounce(frame["at"].tolist(), quiet, forced)
        return pd.DataFrame([(frame["key"].iloc[0], *r) for r in rows], columns=["key", "first", "last", "n", "due"])

    by = Window.partitionBy("key").orderBy("at")
    rows = events.select(F.col(key).cast("string").alias("key"), millis(ts).alias("at")).withColumn("gap", F.col("at") - F.lag("at").over(by))
    rows = rows.withColumn("burst", F.sum(F.when(F.col("gap") < quiet, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    bursts = rows.groupBy("key", "burst").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))
    short = bursts.filter(F.col("last") - F.col("first") < forced)
    short = short.select("key", "first", "last", "n", F.least(F.col("last") + quiet, F.col("first") + forced).alias("due"))
    long = rows.join(bursts.filter(F.col("last") - F.col("first") >= forced).select("key", "burst"), ["key", "burst"], "left_semi")
    return short.union(long.groupBy("key", "burst").applyInPandas(run, "key string, first long, last long, n long, due long"))


def debounced_stream(events: DataFrame, key: str, ts: str = "ts", quiet: int = QUIET, forced: int = FORCED, late: str = "10 minutes") -> DataFrame:
    """The same over a stream with event time; the state of a key is its open update."""

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        done = []
        if state.hasTimedOut:
            done, held = [held], None
        # Spark hands over the rows of a key in any order and cuts them into frames where it likes
        parts = [frame["at"].to_numpy() for frame in frames]
        for at in np.sort(np.concatenate(parts)).tolist() if parts else ():
            if held is not None and at < held[3]:
                held = (held[0], max(held[1], at), held[2] + 1, min(max(held[1], at) + quiet, held[0] + forced))
            else:
                done += [held] if held is not None else []
                held = (at, at, 1, min(at + quiet, at + forced))
        if held is None:
            state.remove()
        else:
            state.update(held)
            state.setTimeoutTimestamp(max(held[3], state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(name[0], *d) for d in done], columns=["key", "first", "last", "n", "due"])

    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).select(F.col(key).cast("string").alias("key"), millis(ts).alias("at"), ts)
    return rows.groupBy("key").applyInPandasWithState(run, "key string, first long, last long, n long, due long", "first long, last long, n long, due long", "append", GroupStateTimeout.EventTimeTimeout)


def work_queue(events: DataFrame) -> DataFrame:
    """One item for each (root, rel_path) of events (root, rel_path, kind, reason, at, seq): repeats raise the generation, an event never becomes an expansion."""
    when = F.struct("at", "seq")
    last = F.max_by("reason", when)
    firm = F.max_by("reason", F.when(F.col("reason") != "expand", when))
    return events.groupBy("root", "rel_path").agg(
        F.count("*").alias("generation"), F.max_by("kind", when).alias("kind"), F.when((last == "expand") & (firm == "event"), "event").otherwise(last).alias("reason"), F.min("at").alias("created_at"),
    )


def acknowledged(queue: DataFrame, acks: DataFrame) -> DataFrame:
    """The queue without items whose generation an ack (root, rel_path, up_to) covers."""
    done = acks.groupBy("root", "rel_path").agg(F.max("up_to").alias("up_to"))
    return queue.join(done, ["root", "rel_path"], "left").filter(F.col("up_to").isNull() | (F.col("generation") > F.col("up_to"))).drop("up_to")


def overflowed(queue: DataFrame, limit: int = OVERFLOW) -> DataFrame:
    """Roots with more than ``limit`` path items keep one dirty-scope marker instead."""
    sizes = queue.groupBy("root").agg(F.sum((F.col("kind") == "path").cast("long")).alias("n"), F.min("created_at").alias("since"))
    marker = sizes.filter(F.col("n") > limit).select("root", F.lit("").alias("rel_path"), F.lit("dirty-scope").alias("kind"), F.lit("overflow").alias("reason"), F.col("since").alias("created_at"))
    small = sizes.filter(F.col("n") <= limit).select("root")
    kept = queue.join(small, "root", "left_semi").unionByName(queue.filter("kind <> 'path'").join(marker.select("root"), "root", "left_semi"))
    return kept.select("root", "rel_path", "kind", "reason", "created_at").unionByName(marker)


def fair_batch(queue: DataFrame, oldest: int = OLDEST, newest: int = NEWEST) -> DataFrame:
    """Per root the oldest and the newest items, events before expansions, deferred ones (column deferred) last; at most oldest + newest."""
    room = oldest + newest
    group = Window.partitionBy("root", "expand", "deferred")
    rows = queue.withColumn("expand", F.col("reason") == "expand").select("root", "rel_path", "reason", "expand", "deferred", "created_at")
    up, down = group.orderBy("created_at", "rel_path"), group.orderBy(F.col("created_at").desc(), F.col("rel_path").desc())
    first = rows.withColumn("n", F.row_number().over(up)).filter(F.col("n") <= room).drop("n")
    last = rows.withColumn("n", F.row_number().over(down)).filter(F.col("n") <= newest).drop("n")
    few = first.union(last).distinct()  # bounded for each root; both parts are limited before they are shuffled
    late = F.row_number().over(down) <= newest
    place = Window.partitionBy("root").orderBy("expand", "deferred", F.when(F.col("deferred") | F.col("late"), 0).otherwise(1), "created_at", "rel_path")
    return few.withColumn("late", late).withColumn("place", F.row_number().over(place)).filter(F.col("place") <= room).drop("late", "place")


@dataclass
class Throttle:
    """Decides about requests for a rescan, one key at a time; all times in milliseconds.

    ============================================  ========  ==============================================
    request                                       accepted  next request is allowed
    ============================================  ========  ==============================================
    before the allowed time                       no        as before
    when the window has room                      yes       ``cool`` later
    when the window is full                       no        after the next delay of ``back_off``
    ============================================  ========  ==============================================

    A window opens with the first request after the last one has run out and has room for ``most`` accepted requests.
    A clock that was set back starts everything anew.
    """

    cool: int = COOL_DOWN
    window: int = WINDOW
    most: int = PER_WINDOW
    back_off: tuple = BACK_OFF
    opened: float = float("-inf")
    room: int = 0
    allowed: float = float("-inf")
    refused: int = 0  # full windows met so far

    def request(self, now: int) -> bool:
        if now < self.opened:
            self.opened, self.allowed, self.refused = float("-inf"), now, 0
        if now >= self.opened + self.window:
            self.opened, self.room = now, self.most
        open_now = now >= self.allowed
        if open_now and self.room:
            self.room -= 1
            self.allowed = now + self.cool
        elif open_now:
            self.allowed = now + self.back_off[min(self.refused, len(self.back_off) - 1)]
            self.refused += 1
            return False
        return open_now


def throttle(times: list[int], **limits) -> list[bool]:
    """Which of the requests for a rescan are accepted."""
    state = Throttle(**limits)
    return [state.request(now) for now in times]


def rescans(events: DataFrame, key: str, ts: str = "ts", **limits) -> DataFrame:
    """(key, requests, accepted): what the throttle makes of the requests of each key.

    After a pause as long as the window and the longest delay nothing is left
    of what was before but the number of full windows met, and of that only
    whether it is 0, 1, .. or enough for the longest delay. So pauses cut the
    requests of a key into segments, which tasks work on by themselves, once
    for each of these few states that they may start in. The state only grows,
    so where it changes are the first segments that leave it: minima by key put
    the segments together.
    """
    plain = Throttle(**limits)
    pause, last = max(plain.window, *plain.back_off, plain.cool), len(plain.back_off) - 1

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        times, rows = sorted(frame["at"].tolist()), []
        for entry in range(last + 1):
            state = Throttle(**limits, refused=entry)
            rows.append((frame["key"].iloc[0], int(frame["segment"].iloc[0]), entry, len(times), sum(map(state.request, times)), min(state.refused, last)))
        return pd.DataFrame(rows, columns=["key", "segment", "entry", "requests", "accepted", "leaves"])

    by = Window.partitionBy("key").orderBy("at")
    rows = events.select(F.col(key).cast("string").alias("key"), millis(ts).alias("at")).withColumn("gap", F.col("at") - F.lag("at").over(by))
    rows = rows.withColumn("segment", F.sum(F.when(F.col("gap") < pause, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    maps = stored(rows.select("key", "segment", "at").groupBy("key", "segment").applyInPandas(run, "key string, segment long, entry int, requests long, accepted long, leaves int"), "segments")
    # (key, entry, since): from which segment on a key is in which state; a state may be skipped
    now = maps.groupBy("key").agg(F.min("segment").alias("since")).select("key", F.lit(0).alias("entry"), "since")
    reached = now
    for entry in range(last):
        here = now.filter(F.col("entry") == entry).select("key", "entry", "since")
        left = maps.join(here, ["key", "entry"]).filter((F.col("segment") >= F.col("since")) & (F.col("leaves") > entry))
        then = left.groupBy("key").agg(F.min_by(F.col("leaves"), "segment").alias("entry"), (F.min("segment") + 1).alias("since"))
        reached, now = reached.union(then), now.union(then)
    spans = reached.withColumn("until", F.lead("since").over(Window.partitionBy("key").orderBy("since", "entry")))
    own = maps.join(spans, ["key", "entry"]).filter((F.col("segment") >= F.col("since")) & (F.col("until").isNull() | (F.col("segment") < F.col("until"))))
    return own.groupBy("key").agg(F.sum("requests").alias("requests"), F.sum("accepted").alias("accepted"))


def kept_keys(requests: DataFrame, limit: int = KEYS) -> DataFrame:
    """(key, last_at) of the ``limit`` keys that asked last: of what a throttle remembers the keys that were not used longest go first."""
    return requests.groupBy("key").agg(F.max("at").alias("last_at")).orderBy(F.col("last_at").desc(), "key").limit(limit)


def absorbed(pending: DataFrame) -> DataFrame:
    """Pending paths without those below another pending path: an anti-join on the folders above."""
    above = pending.select("path", F.explode(F.slice(ancestors("path"), 1, F.greatest(F.size(ancestors("path")) - 1, F.lit(0)))).alias("folder"))
    covered = above.join(pending.select(F.col("path").alias("folder")).distinct(), "folder", "left_semi").select("path").distinct()
    return pending.join(covered, "path", "left_anti")


def orphans(registered: DataFrame, *states: DataFrame) -> DataFrame:
    """(root): the roots that any of the state tables (root, ..) names and that are not registered (root)."""
    named = reduce(DataFrame.union, [s.select("root") for s in states]).distinct()
    return named.join(registered.select("root"), "root", "left_anti")


def purged(state: DataFrame, registered: DataFrame) -> DataFrame:
    """A state table (root, ..) without the rows of roots that are not registered."""
    return state.join(F.broadcast(registered.select("root").distinct()), "root", "left_semi")


def replayed(spark: SparkSession, path: str, key: str, quiet: int, forced: int) -> DataFrame:
    """Runs the stream over the files at ``path`` to their end and returns all updates: those that it wrote and those still open.

    The sink is a folder beside the checkpoint; each micro-batch overwrites its
    own sub-folder, so a batch that is run again leaves the same files. An
    update that no later event closes is read from the state of the stream.
    Events more than the lateness behind the newest one of an earlier batch are
    dropped by the stream; the number is in its progress (numRowsDroppedByWatermark).
    """
    home = f"{shared(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    glob = f"{path[:-1]}[{path[-1]}]"
    source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(glob)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/out/batch={number}")

    run = debounced_stream(source, key, quiet=quiet, forced=forced).writeStream.foreachBatch(write).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.read.parquet(f"{home}/out").drop("batch")
    held = spark.read.format("statestore").load(f"{home}/checkpoint").select("key.*", "value.groupState.*")
    return out.unionByName(held.select(*out.columns))


def intake(events: DataFrame, rules: list[IgnoreRule], rules_file: str = "ignore.rules") -> DataFrame:
    """Adds ``intake`` to events (rel_path, is_folder, is_link): excluded, rescan (no name), reconcile (the root or its rules changed) or path.

    Excluded events are known from their names alone, before anything is read.
    """
    name = F.coalesce(F.col("rel_path"), F.lit(""))
    rule = excluded_by(name, F.col("is_folder"), F.col("is_link"), F.lit(False), rules)
    own = F.element_at(F.split(name, "/"), -1) == rules_file
    return events.withColumn("intake", F.when(F.col("rel_path").isNull(), "rescan").when((name == "") | own, "reconcile").when(rule.isNotNull(), "excluded").otherwise("path"))


def intake_counts(events: DataFrame, rules: list[IgnoreRule], rules_file: str = "ignore.rules") -> DataFrame:
    """(intake, n): how many events came in and what became of them."""
    return intake(events, rules, rules_file).groupBy("intake").agg(F.count("*").alias("n"))


# What is done about the time in which nothing watched, rows and characters that one batch prepares,
# entries of a folder that one round takes, milliseconds between reconciles and delays of a writer that met another one.
POLICIES = ("ask", "auto", "off")
BATCH_ITEMS, BATCH_CHARS, BATCH_MILLIS = 50, 8_000_000, 250
EXPAND_BUDGET, RECONCILE_BUDGET = 2_000, 500
BETWEEN_RECONCILES, PERIODIC = 5_000, 6 * 3_600_000
WRITER_DELAYS = (1, 2, 5, 10, 30)
HANDLES = 128


def downtime_gaps(roots: DataFrame, opened_at: int, policy: str = "ask") -> DataFrame:
    """(root, kind, reason, created_at, action) for each root (root, watched_until) that nothing watched up to ``opened_at``.

    ``auto`` reconciles, ``ask`` waits for an answer, ``off`` only records the
    gap; a root that was never watched has none.
    """
    if policy not in POLICIES:
        raise ValueError(f"no such policy: {policy}")
    action = {"auto": "reconcile", "ask": "waiting", "off": "recorded"}[policy]
    gaps = roots.filter(F.col("watched_until") < opened_at)
    return gaps.select("root", F.lit("downtime-gap").alias("kind"), F.lit("not-watched").alias("reason"), F.lit(opened_at).cast("long").alias("created_at"), F.lit(action).alias("action"))


def expanded(folders: DataFrame, listing: DataFrame, budget: int = EXPAND_BUDGET) -> tuple[DataFrame, DataFrame]:
    """One round of the work items that are folders (root, folder, after): (paths of this round, state of the folders).

    Paths come in order from behind ``after`` (null: the first), ``budget`` a
    folder; the state says where the next round goes on. Only a ``complete``
    folder may lose documents, as only then all of its entries were seen.
    """
    rows = folders.join(listing.select("root", "folder", "path"), ["root", "folder"]).filter("after is null or path > after")
    place = F.row_number().over(Window.partitionBy("root", "folder").orderBy("path"))
    taken = rows.withColumn("n", place).filter(F.col("n") <= budget + 1)
    state = taken.groupBy("root", "folder").agg(F.max(F.when(F.col("n") <= budget, F.col("path"))).alias("next"), (F.max("n") <= budget).alias("complete"))
    state = folders.join(state, ["root", "folder"], "left").select("root", "folder", F.coalesce("next", "after").alias("after"), F.coalesce("complete", F.lit(True)).alias("complete"))
    return taken.filter(F.col("n") <= budget).select("root", "folder", "path"), state


def prepared_groups(items: DataFrame, most: int = BATCH_ITEMS, chars: int = BATCH_CHARS) -> DataFrame:
    """(root, path, group): items (root, path, chars, seq) in order, a new group after ``most`` items or before ``chars`` are passed.

    An item without ``chars`` counts none. The starts of the groups come by
    doubling, no root is walked through; what waits for a root is bounded by
    the overflow rule.
    """
    by = Window.partitionBy("root").orderBy("seq", "path")
    rows = items.select("root", "path", F.coalesce(F.col("chars").cast("long"), F.lit(0)).alias("size"), F.row_number().over(by).alias("k"))
    rows = stored(rows.withColumn("end", F.sum("size").over(Window.partitionBy("root").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))), "waiting")
    full = F.col("from") + most
    steps = passed(rows, "root", chars).select("root", "from", F.least(full, F.greatest("to", F.when(F.col("to").isNotNull(), F.col("from") + 1))).alias("next"))
    totals = rows.groupBy("root").agg(F.max("end").alias("total"), F.max("k").alias("last"))
    bound = largest(totals, F.least(F.ceil(2 * F.col("total") / chars) + F.ceil(F.col("last") / most) + 2, F.col("last")))
    return numbered(rows, "root", steps, bound, "group").select("root", "path", "group")


def next_turn(now: int, reconciled_at: int | None, reconcile_waits: bool, local_waits: bool) -> str:
    """What the worker does next: reconciling and local work take turns, with ``BETWEEN_RECONCILES`` between two reconciles while local work waits."""
    rested = reconciled_at is None or now - reconciled_at >= BETWEEN_RECONCILES
    if reconcile_waits and (rested or not local_waits):
        return "reconcile"
    return "local" if local_waits else "idle"


def periodic_due(roots: DataFrame, now: int, every: int = PERIODIC) -> DataFrame:
    """Roots (root, reconciled_at) whose last reconcile is ``every`` or more ago, or that never had one."""
    return roots.filter(F.col("reconciled_at").isNull() | (now - F.col("reconciled_at") >= every)).select("root")


def reconcile_round(changes: DataFrame, after: str | None, budget: int = RECONCILE_BUDGET) -> DataFrame:
    """The next ``budget`` changes (path, change) in order of path behind the checkpoint ``after``; the last path is the next checkpoint, fewer rows the end."""
    left = changes.filter(F.col("change") != "same")
    return (left if after is None else left.filter(F.col("path") > after)).orderBy("path").limit(budget)


def verified_again(prepared: DataFrame, now: DataFrame) -> DataFrame:
    """Adds ``commit`` to prepared documents (path, size_bytes, modified_at_ms): whether the file is still the one that was read.

    Reading and parsing take no lock; what has changed meanwhile goes back to the queue.
    """
    seen = now.select("path", F.col("size_bytes").alias("_size"), F.col("modified_at_ms").alias("_time"))
    same = (F.col("_size") == F.col("size_bytes")) & (F.col("_time") == F.col("modified_at_ms"))
    return prepared.join(seen, "path", "left").withColumn("commit", F.coalesce(same, F.lit(False))).drop("_size", "_time")


def with_back_off(write, conflict: type[Exception], delays: tuple = WRITER_DELAYS, sleep=time.sleep):
    """The result of ``write()``; where another writer was faster it is tried again after growing delays."""
    for delay in delays:
        try:
            return write()
        except conflict:
            sleep(delay)
    return write()


def watch_plan(folders: DataFrame, handles: int = HANDLES) -> DataFrame:
    """(root, mode, n): a root with few folders directly below it (root, folder) is watched by a handle each, others by one coarse handle."""
    n = folders.groupBy("root").agg(F.count("folder").alias("n"))
    return n.select("root", F.when(F.col("n") + 1 <= handles, "split").otherwise("coarse").alias("mode"), F.when(F.col("n") + 1 <= handles, F.col("n") + 1).otherwise(1).cast("long").alias("n"))


def live_status(queue: DataFrame, samples: DataFrame, now: str) -> DataFrame:
    """Per root, under the anonymous names R1, R2, ..: items that wait, the age of the oldest in seconds, nearest-rank percentiles of its samples (root, value)."""
    depth = queue.groupBy("root").agg(F.count("*").alias("waiting"), F.min("created_at").alias("oldest"))
    times = summary(samples, "root", "value")
    rows = depth.join(times, "root", "full_outer")
    name = F.concat(F.lit("R"), F.row_number().over(Window.orderBy("root")))  # one row a root
    age = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("oldest").cast("timestamp"))
    return rows.select(name.alias("name"), F.coalesce("waiting", F.lit(0)).alias("waiting"), age.alias("oldest_seconds"), F.coalesce("n", F.lit(0)).alias("n"), "p50", "p95")


# Fixed values, in milliseconds: delays after which a file that keeps changing is looked at again; then it is given up.
LOOK_AGAIN = (1_000, 2_000, 5_000, 15_000, 30_000)


def stability(observed: DataFrame, quiet: int = QUIET) -> DataFrame:
    """(path, state, changes, next_at) from observations (path, at, size, modified, inode).

    Stable: the last two observations agree and lie ``quiet`` apart. Else it
    is deferred with a growing delay, and given up after the last one; the
    index keeps what it has.
    """
    by = Window.partitionBy("path").orderBy("at")
    identity = F.struct("size", "modified", "inode")
    rows = observed.withColumn("identity", identity).withColumn("before", F.lag(identity).over(by))
    rows = rows.withColumn("changed", F.col("before").isNotNull() & (F.col("before") != F.col("identity"))).withColumn("run", F.sum(F.col("changed").cast("int")).over(by))
    runs = rows.groupBy("path", "run").agg(F.min("at").alias("since"), F.max("at").alias("until"))
    last = runs.groupBy("path").agg(F.max("run").alias("changes"), F.max_by(F.struct("since", "until"), "run").alias("last"))
    held = F.col("last.until") - F.col("last.since") >= quiet
    state = F.when(held, "stable").when(F.col("changes") >= len(LOOK_AGAIN), "given-up").otherwise("deferred")
    delay = F.element_at(F.array(*[F.lit(d) for d in LOOK_AGAIN]), F.least(F.col("changes") + 1, F.lit(len(LOOK_AGAIN))).cast("int"))
    return last.select("path", state.alias("state"), "changes", F.when(state == "deferred", F.col("last.until") + delay).alias("next_at"))


def deletions(gone: DataFrame, online: DataFrame, readable: DataFrame) -> DataFrame:
    """Adds ``action`` to missing paths (root, path): delete, or keep as DELETE_UNCONFIRMED where the root is offline or the folder cannot be read."""
    parent = F.regexp_replace("path", "/[^/]*$", "")
    rows = gone.withColumn("_parent", parent).join(online.select("root", F.lit(True).alias("_online")), "root", "left").join(readable.select(F.col("folder").alias("_parent"), F.lit(True).alias("_readable")), "_parent", "left")
    safe = F.coalesce("_online", F.lit(False)) & F.coalesce("_readable", F.lit(False))
    return rows.withColumn("action", F.when(safe, "delete").otherwise("DELETE_UNCONFIRMED")).select(*gone.columns, "action")


def reconciled(disk: DataFrame, index: DataFrame, scope: str, unreadable: list[str], pending: DataFrame) -> DataFrame:
    """(path, change) of a whole comparison of a scope: removals only where no folder failed to be read and nothing is pending at or below the path."""
    found = difference(disk.filter(below("path", scope)), index.filter(below("path", scope)))
    safe = F.lit(True)
    for folder in unreadable:
        safe = safe & ~below("path", folder)
    busy = pending.select(F.explode(ancestors("path")).alias("path")).union(pending.select("path")).distinct().withColumn("_busy", F.lit(True))
    rows = found.join(busy, "path", "left")
    change = F.when((F.col("change") == "removed") & (~safe | F.coalesce("_busy", F.lit(False))), "kept").otherwise(F.col("change"))
    return rows.select("path", change.alias("change"))
