"""Connected components of a distributed edge list.

Large-star and small-star steps: every step keeps the components and never
adds edges, and the steps end, as the sum over all edges of the smaller node
falls until nothing changes.

A node with very many edges is never one task's work. Nodes with more than
``most`` edges are few (``most`` grows with the edges so that at most
``LARGE`` of them can exist), so their minima are broadcast and their edges
stay where they are; the other nodes meet their minima in a shuffled join in
which no key has more than ``most`` rows.

Defined results
    no edges                    no rows
    loops (a, a)                dropped; a node with no other edge gives no row
    repeated, reversed edges    count once
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, stored, stored_and_told

#: The largest number of nodes whose minima are broadcast, 16 bytes each.
LARGE = 100_000


def _star(edges: DataFrame, large: bool, most: int) -> DataFrame:
    """One large-star or small-star step on edges (a, b)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.filter("b < a")
    sizes = both.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n")).select("a", F.least("a", "least").alias("least"), "n")
    of_many = sizes.filter(F.col("n") > most).select(F.col("a").alias("hub"), F.col("least").alias("hub_least"))
    met = both.join(F.broadcast(of_many), F.col("a") == F.col("hub"), "left")
    few = met.filter("hub is null").select("a", "b").join(sizes.filter(F.col("n") <= most).select("a", "least"), "a").select("a", "b", "least")
    met = few.union(met.filter("hub is not null").select("a", "b", F.col("hub_least").alias("least")))
    if large:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("least").alias("b")).union(sizes.select("a", F.col("least").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, most: int = 64) -> DataFrame:
    """(node, root) for each node with an edge; root is the smallest node of its component.

    Each step is written to the shared folder, so the lineage stays one step
    deep. ``most``: edges that a node may have before its minimum is broadcast.
    """
    told = {"rows": F.count(F.lit(1)), "sum": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    low_first = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, found = stored_and_told(low_first, "edges", **told)
    seen = None
    while found["rows"] and found != seen:
        limit = max(most, 2 * found["rows"] // LARGE)
        wide = stored(_star(now, True, limit), "edges")
        seen = found
        now, found = stored_and_told(_star(wide, False, limit), "edges", **told)
        settle(edges.sparkSession)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
