"""Pairs of similar sets without all pairs as rows: parity signatures, lists in tiles, forests of the nearest.

A signature has the parities of a set's hashes by their last bits. Two
signatures differ in no more bits than the sets differ in elements, so a pair
whose signatures differ in more bits than linked sets may is left out exactly.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, stored_and_told

#: Sizes for which subsets are thought of at all.
LARGEST_LIGHT = 48
SIGNATURE_WORDS = 16
#: A subset is a row that is hashed and shuffled; a step along a list compares two numbers of one task. What the first costs in the second.
SUBSET_COST = 20
#: Keys of lists above a tile are broadcast up to this number, 16 bytes each; beyond it they are joined.
BROADCAST_KEYS = 400_000


class Threshold:
    """Integer arithmetic of 100 * |A & B| >= percent * |A | B|."""

    def __init__(self, percent: int = 85):
        self.percent = percent

    def shared(self, s, t):
        """The least number of common shingles of linked sets of s and t shingles."""
        return (self.percent * (s + t) + 99 + self.percent) // (100 + self.percent)

    def least(self, n):
        """The smallest size that can link with n."""
        return (self.percent * n + 99) // 100

    def largest(self, n):
        return 100 * n // self.percent

    def prefix(self, n):
        """Of its shingles in the common order so many hold one of every set that can link with it."""
        return n - self.least(n) + 1

    def subset_sizes(self, n: int, limit: int) -> list[tuple[int, int, int]]:
        """(s, t, subset size) of the pairs of sizes up to ``limit`` that a class of n shingles takes part in; equal sets are one class already."""
        found = [(n, t, self.shared(n, t)) for t in range(n, min(limit, self.largest(n)) + 1)]
        found += [(s, n, self.shared(s, n)) for s in range(self.least(n), n)]
        return [(s, t, o) for s, t, o in found if o <= s and not s == t == o]

    def subsets(self, n: int, limit: int) -> int:
        return sum(comb(n, o) for _, _, o in self.subset_sizes(n, limit))

    def boundary(self, sizes: dict[int, int], list_length: float) -> int:
        """The size up to which subsets cost less than lists; ``sizes``: classes by size, up to LARGEST_LIGHT."""
        lists = [sizes.get(n, 0) * self.prefix(n) * list_length for n in range(LARGEST_LIGHT + 1)]
        costs = [SUBSET_COST * sum(sizes.get(n, 0) * self.subsets(n, limit) for n in range(1, limit + 1)) + sum(lists[limit + 1 :]) for limit in range(LARGEST_LIGHT + 1)]
        return min(range(len(costs)), key=lambda limit: (costs[limit], -limit))


def signature(hashes: np.ndarray) -> bytes:
    """Parities of the shingles by the last bits of their hash."""
    bits = np.bincount((hashes & np.uint64(64 * SIGNATURE_WORDS - 1)).astype(np.int64), minlength=64 * SIGNATURE_WORDS) & 1
    return np.packbits(bits.astype(bool)).tobytes()


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node linked to it) that join the same nodes as the links (a, b)."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def nearest_forest(a: np.ndarray, b: np.ndarray, apart: np.ndarray, sure: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (a, b, apart) that join the same nodes: a forest of the pairs within ``sure`` bits, and of the rest one of smallest distances.

    Each round takes the closest pair of every group (ties by place) and unites the groups, so there are few rounds.
    """
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    close = apart <= sure
    group = np.arange(len(nodes))

    def unite(p, q):
        node, root = forest(p, q)
        to = np.arange(len(nodes))
        to[node] = root
        return node, root, to

    node, root, to = unite(x[close], y[close])
    group = to[group]
    out = [(nodes[node], nodes[root], np.zeros(len(node), np.int64))]
    order = np.argsort(apart, kind="stable")
    x, y, apart = x[order], y[order], apart[order]
    while True:
        other = group[x] != group[y]
        x, y, apart = x[other], y[other], apart[other]
        if not len(x):
            break
        _, first = np.unique(np.stack((group[x], group[y]), axis=1).reshape(-1), return_index=True)
        chosen = np.unique(first // 2)
        out.append((nodes[x[chosen]], nodes[y[chosen]], apart[chosen]))
        group = unite(group[x[chosen]], group[y[chosen]])[2][group]
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def _whole_groups(batches):
    """Tables of whole groups (column gid) from sorted batches."""
    held: list = []
    for batch in batches:
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        ids = table.column("gid").to_numpy()
        cut = len(ids) - int((ids[::-1] != ids[-1]).argmax()) if len(ids) and (ids != ids[-1]).any() else 0
        held = table.slice(cut).to_batches()
        if cut:
            yield table.slice(0, cut)
    if held:
        yield pa.Table.from_batches(held)


def _passing(bound: Threshold, limit: int, gid, side, node, root, n, place, sign):
    """(i, j, bits apart) of the rows of one group that may link."""

    def kept(i, j):
        a, b = n[i], n[j]
        shared = bound.shared(a, b)
        ok = (node[i] != node[j]) & (root[i] != root[j]) & (np.maximum(a, b) > limit) & (np.minimum(a - place[i], b - place[j]) >= shared)
        ok &= (100 * np.minimum(a, b) >= bound.percent * np.maximum(a, b)) & ((side[i] != side[j]) | (side[i] == 2))
        i, j, most = i[ok], j[ok], (a + b - 2 * shared)[ok]
        apart = np.bitwise_count(sign[i] ^ sign[j]).sum(axis=1, dtype=np.int64)
        close = apart <= most
        return i[close], j[close], apart[close]

    starts = np.flatnonzero(np.concatenate(([True], gid[1:] != gid[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(gid)])))
    start_of, small = np.repeat(starts, sizes), np.repeat(sizes <= 48, sizes)
    found = [(np.zeros(0, np.int64),) * 3]
    for step in range(1, min(48, int(sizes.max(initial=0)))):
        i = np.flatnonzero(small[:-step] & (start_of[:-step] == start_of[step:]))
        if len(i):
            found.append(kept(i, i + step))
    for s, size in zip(starts[sizes > 48], sizes[sizes > 48], strict=True):
        for lo in range(s, s + size, 64):
            i, j = np.meshgrid(np.arange(lo, min(lo + 64, s + size)), np.arange(lo, s + size), indexing="ij")
            upper = i < j
            found.append(kept(i[upper], j[upper]))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def near_pairs(entries: DataFrame, bound: Threshold, limit: int, tile: int, every: bool) -> DataFrame:
    """(a, b) of the pairs of a list (token, class, node, root, n, place, sign) that may link: all, or a forest of the nearest."""
    hot, told = stored_and_told(entries.groupBy("token").agg(F.count("*").alias("of")).filter(F.col("of") > tile), "hot", rows=F.count(F.lit(1)))
    rows = entries.join(F.broadcast(hot) if told["rows"] <= BROADCAST_KEYS else hot, "token", "left")
    tiles = F.ceil(F.coalesce("of", F.lit(1)) / tile).cast("int")
    own = F.pmod(F.xxhash64("node"), tiles).cast("int")
    dealt = rows.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other")).select(
        F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")).alias("gid"), "node", "root", "n", "place", "sign",
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
    )

    @freeing
    def run(batches):
        for table in _whole_groups(batches):
            gid, side, node, root, n, place = (table.column(c).to_numpy() for c in ("gid", "side", "node", "root", "n", "place"))
            sign = np.frombuffer(b"".join(table.column("sign").to_pylist()), np.uint64).reshape(-1, SIGNATURE_WORDS)
            i, j, apart = _passing(bound, limit, gid, side, node, root, n, place, sign)
            if not len(i):
                continue
            if every:
                a, b = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]), axis=1)
            else:
                a, b, _ = nearest_forest(node[i], node[j], apart, -1)
                a, b = np.minimum(a, b), np.maximum(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.repartition("gid").sortWithinPartitions("gid").mapInArrow(run, "a long, b long").distinct()
