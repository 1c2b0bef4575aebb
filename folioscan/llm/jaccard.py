"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets, and its classes.

Equal sets are one class. Classes of at most ``limit`` shingles are light: for
each pair of sizes (s, t) that can link, a class gives all its subsets of just
the size that such a pair must share, and classes with one subset in common
are linked: by a star, so thousands of them give as many rows. Heavier classes
scan inverted lists: the lists of a set's rarest shingles (its prefix) hold
every set that can link with it, lighter ones too. ``limit`` is where the cost
of subsets passes that of the lists (``boundary``).

Lists are not turned into pairs. Within a list a pair has to pass the length
and the position filter and a bound from parity signatures: the bits in which
two signatures differ are no more than the shingles in which the sets differ.
Round one takes a forest of the nearest such pairs of every list, and the texts
decide about each of them. Round two takes all pairs that pass and are not yet
in one component. So every link is checked or lies inside a component already;
nothing is left out, and a group of n near copies gives about n rows.

Shingles are ordered by how often their hash bucket occurs (``BUCKETS`` counts,
a fixed number), then by hash: any fixed order gives the right result, a rare
prefix gives short lists. Sets are compared by 64-bit shingle hashes, classes
and subsets are known by 128 bits.

Defined results
    null text, no words   an empty set, linked with nothing; component_id is doc_id
    fewer words           the whole sequence is the one shingle
    very long texts       whole; hashed one by one
    null doc_id           component_id is the least id reachable, null if there is none
    repeated doc_id       each row is a document; they are not linked by the id
    equal texts           one class, whatever their number
    empty table           no rows
    columns with other names   ignored
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, lower_ascii, stored, stored_and_told, word_list
from .components import components
from .hashing import mixed
from .near import LARGEST_LIGHT, Threshold, near_pairs, signature
from .simhash import shingle_hashes

#: Counts of shingles by the first bits of their hash; 2 MB, whatever the input.
BUCKETS = 1 << 18
_SLAB = 1 << 20
#: Wanted classes are broadcast up to this number, 24 bytes each; beyond it they are joined.
_BROADCAST_KEYS = 400_000


def shingle_sets(texts: list, shingle: int):
    """The sorted distinct shingle hashes of each text (bytes or None)."""
    slab, held = [], 0

    def flush():
        hashes, count = shingle_hashes([t for t in slab if t], shingle) if any(slab) else (np.zeros(0, np.uint64), [])
        ends, k, at = np.cumsum([0, *count]), 0, []
        for t in slab:
            at.append((ends[k], ends[k + 1]) if t else (0, 0))
            k += bool(t)
        return [np.unique(hashes[b:e]) for b, e in at]

    for text in texts:
        slab.append(b" ".join(word_list(lower_ascii(text or b""))))
        held += len(slab[-1])
        if held > _SLAB:
            yield from flush()
            slab, held = [], 0
    if slab:
        yield from flush()


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def subset_keys(hashes: np.ndarray, wanted: list[tuple[int, int, int]]) -> list[bytes]:
    """(s, t, 128 bits) of each subset of the wanted sizes, from sums of rehashed shingles."""
    n, out = len(hashes), []
    with np.errstate(over="ignore"):
        each = np.stack([mixed(hashes, 1), mixed(hashes, 2)])
        total = each.sum(axis=1)
        for s, t, o in wanted:
            left_out = np.array(list(combinations(range(n), n - o)), np.int64).reshape(comb(n, o), n - o)
            sums = total[:, None] - each[:, left_out].sum(axis=2)
            out += [bytes((s, t)) + row.tobytes() for row in np.ascontiguousarray(sums.T)]
    return out


def _read(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, F.xxhash64("text").alias("said"))


def _class(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def shingled(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, said, n, class) of each row, and for each task one row with its counts by bucket."""

    @freeing
    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            size, name = [], []
            for h in shingle_sets(batch.column(1).to_pylist(), shingle):
                counts += np.bincount(_bucket(h), minlength=BUCKETS) if len(h) > 4096 else 0
                if len(h) <= 4096:
                    np.add.at(counts, _bucket(h), 1)
                size.append(len(h))
                name.append(_class(h))
            none = pa.array([None] * len(size), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(name, pa.binary()), none], names=["doc_id", "said", "n", "class", "counts"])
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([None], pa.int64()), "said": pa.array([None], pa.int64()), "n": pa.array([None], pa.int64()), "class": pa.array([None], pa.binary()), "counts": pa.array([counts.astype(np.uint32).tobytes()], pa.binary())})

    return _read(docs).mapInArrow(run, "doc_id long, said long, n long, class binary, counts binary")


def _bucket_counts(found: DataFrame) -> np.ndarray:
    """The sums of the tasks' counts: partial sums in the tasks that read them, then 64 slices of the buckets."""

    def slices(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x, np.uint32)
        parts = total.reshape(64, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "counts"])

    def added(key, rows):
        return pa.table({"slice": rows.column("slice")[:1], "counts": pa.array([sum(np.frombuffer(x, np.int64) for x in rows.column("counts").to_pylist()).tobytes()], pa.binary())})

    rows = found.filter("counts is not null").select("counts").mapInArrow(slices, "slice int, counts binary").groupBy("slice").applyInArrow(added, "slice int, counts binary").collect()
    out = np.zeros(BUCKETS, np.int64).reshape(64, -1)
    for r in rows:
        out[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return out.reshape(-1)


def indexed(docs: DataFrame, counts: np.ndarray, limit: int, bound: Threshold, shingle: int) -> DataFrame:
    """(class, n, sign, tokens, keys) of each class (once a task): its prefix in order, and a light class' subsets."""
    spark = docs.sparkSession
    often = spark.sparkContext.broadcast(counts)
    first_list = bound.least(limit + 1)

    @freeing
    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for h in shingle_sets(batch.column(1).to_pylist(), shingle):
                name, n = _class(h), len(h)
                if not n or name in seen:
                    continue
                seen.add(name)
                order = np.lexsort((h, often.value[_bucket(h)]))[: bound.prefix(n)]
                tokens = h[order].view(np.int64) if n >= first_list else []
                rows.append((name, n, signature(h), tokens, subset_keys(h, bound.subset_sizes(n, limit)) if n <= limit else []))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary())), strict=True)], names=["class", "n", "sign", "tokens", "keys"])

    return _read(docs).mapInArrow(run, "class binary, n long, sign binary, tokens array<long>, keys array<binary>")


def _not_alone(entries: DataFrame) -> DataFrame:
    """The entries whose token stands in another entry too."""

    @freeing
    def run(batches):
        last, told = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            token = batch.column(0).to_numpy()
            same = token[1:] == token[:-1]
            keep = np.concatenate([[told], same]) | np.concatenate([same, [False]])
            told, last = bool(keep[-1]), batch.slice(batch.num_rows - 1)
            yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1]))
        if told:
            yield last

    return entries.repartition("token").sortWithinPartitions("token").mapInArrow(run, "token long, class binary, n long, place int")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, bound: Threshold, shingle: int) -> DataFrame:
    """The pairs (a, b) that are links; their sets are made from their texts again."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted, told = stored_and_told(classes.join(ends, "node").select("node", "said", "class"), "wanted", rows=F.count(F.lit(1)))
    few = told["rows"] <= _BROADCAST_KEYS

    @freeing
    def packed(batches):
        pack, seen = zstandard.ZstdCompressor(level=1), set()
        for batch in batches:
            keep = [k for k, x in enumerate(batch.column(0).to_pylist()) if x not in seen and not seen.add(x)]
            batch = batch.take(pa.array(keep, pa.int64()))
            texts, names = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            same = [k for k, h in enumerate(shingle_sets(texts, shingle)) if _class(h) == names[k]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(same, pa.int64())), pa.array([pack.compress(texts[k]) for k in same], pa.binary())], names=["node", "text"])

    texts = _read(docs).join(F.broadcast(wanted) if few else wanted, "said").select("node", "class", "text").mapInArrow(packed, "node long, text binary")
    texts = stored(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")

    @freeing
    def compared(batches):
        unpack = zstandard.ZstdDecompressor()

        @lru_cache(maxsize=64)
        def one(text):
            return next(shingle_sets([unpack.decompress(text)], shingle))

        for batch in batches:
            ok = []
            for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, t = one(s), one(t)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= bound.percent * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    met = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return stored(met.select("a", "b", "text_a", "text_b").mapInArrow(compared, "a long, b long"), "links")


def _light_links(index: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): stars over the classes that have a subset in common."""
    keyed = index.filter("size(keys) > 0").select("class", F.explode("keys").alias("key")).distinct().join(classes.select("class", "node", "n"), "class").select("key", "node", "n")
    met = keyed.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("of"), F.min("n").alias("low"), F.max("n").alias("high"))
    own = (F.ascii(F.substring("key", 1, 1).cast("string")), F.ascii(F.substring("key", 2, 1).cast("string")))
    return keyed.join(met.filter((F.col("of") > 1) & ((own[0] == own[1]) | (F.col("low") < F.col("high")))), "key").select(F.col("node").alias("a"), "b").filter("a <> b").distinct()


def linked(docs: DataFrame, percent: int = 85, shingle: int = 4, limit: int | None = None, tile: int = 2048) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, links): rows (doc_id, class), classes (node, class, n, head) and confirmed links (a, b) that hold every component together."""
    bound = Threshold(percent)
    found = stored(shingled(docs, shingle), "shingled")
    members = found.filter("counts is null")
    classes = stored(members.groupBy("class").agg(F.min("n").alias("n"), F.min("said").alias("said"), F.min("doc_id").alias("head")).withColumn("node", F.monotonically_increasing_id()), "classes")
    counts = _bucket_counts(found)
    if limit is None:
        sizes = {r["n"]: r["count"] for r in classes.filter(F.col("n").between(1, LARGEST_LIGHT)).groupBy("n").count().collect()}
        every = max(1, int(counts.sum()))
        limit = bound.boundary(sizes, max(1.0, float((counts.astype(float) ** 2).sum()) / every - every / BUCKETS))
    index = stored(indexed(docs, counts, limit, bound, shingle), "index")
    entries = _not_alone(index.select("class", "n", F.posexplode("tokens").alias("place", "token")).select("token", "class", "n", "place"))
    signs = index.select("class", "sign").join(classes.select("class", "node"), "class").dropDuplicates(["class"])
    entries = stored(entries.join(signs, "class").select("token", "node", "n", "place", "sign").dropDuplicates(["token", "node"]), "lists")
    first = near_pairs(entries.withColumn("root", F.col("node")), bound, limit, tile, False)
    links = _confirmed(stored(first, "near"), classes, docs, bound, shingle).union(stored(_light_links(index, classes), "light"))
    roots = stored(components(links), "roots")
    placed = entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed_lists = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("token")
    rest, told = stored_and_told(near_pairs(placed.join(mixed_lists, "token", "left_semi"), bound, limit, tile, True), "rest", rows=F.count(F.lit(1)))
    if told["rows"]:
        links = links.union(_confirmed(rest, classes, docs, bound, shingle))
    return members, classes, links


def joined(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    members, classes, links = linked(docs, **how)
    roots = components(links)
    placed = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = placed.groupBy("root").agg(F.min("head").alias("component_id"))
    told = placed.join(heads, "root").select("class", "component_id")
    return members.join(told, "class").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
