"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, a check of the Hamming distance.

A fingerprint has 64 bits for each of its ``tables`` (the first table is the
majority of the shingles' XXH64, the others of rehashes of it) and is kept as
big-endian bytes. It is cut into blocks of 16 bits; documents meet where
``shared`` blocks agree. With B blocks, B - shared >= max_distance, no pair
within ``max_distance`` can miss each other; otherwise a pair at bit
difference p meets in each block with (1 - p) ** 16, and ``overlap`` adds the
blocks that start at the bytes between these.

Copies collapse into one class a fingerprint before anything is linked. A
block that very many classes share is never dealt to one task: within
distance 2 all of its links follow from one-bit variants (each group of a
variant has at most 33 members), beyond that it is cut into pairs of tiles.
Linked pairs of a task are reduced to a spanning forest before they are
returned, so no group gives more rows than it has members.

With ``similar`` a link needs that share of common shingles, and fingerprints
only say which documents may belong together: those of one component. Inside
each, parity signatures of the shingle sets leave the pairs that can reach the
share (an exact bound), a forest of the nearest is looked up in the texts, and
then every pair that is left and not yet in one group. So pairs are checked
before they are reduced, no pair links unchecked, and a group of n copies gives
about n rows.

Defined results
    null text, no words   fingerprint zero; such documents link to each other
    very long texts       hashed in slabs of 1 MB of words, whole
    null doc_id           each such row is a document of its own, linked by its
                          text only; component_id is null only if no row of the
                          group has an id
    repeated doc_id       rows of one doc_id are one document: their links unite;
                          keep_one() goes by the texts alone
    equal texts           one class, whatever their number
    empty table           an empty result
    extra columns         ignored; keep_one() returns them, also under these names
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, freeing, lower_ascii, stored, stored_and_told, word_list
from .components import components
from .hashing import mixed, xxh64_spans
from .near import Threshold, forest, near_pairs, signature

#: Settings for copies whose five-word shingles agree to 0.8 or more. The angle between such shingle counts is at most
#: acos(8 / 9), 15.1 % of 512 bits: 78 with a standard deviation of 8, so 104 bits lose one in 1,000. At exactly 0.8 a pair
#: meets in one of the 63 blocks with 0.967.
EIGHTY_PERCENT = {"shingle": 5, "tables": 8, "shared": 1, "max_distance": 104, "overlap": True, "similar": 0.8}

#: Blocks above a tile are broadcast up to this number, 20 bytes each; beyond it they are joined.
_BROADCAST_KEYS = 400_000

#: Bytes of words that are hashed at once.
_SLAB = 1 << 20

_bit = np.arange(8, dtype=np.uint64)
#: Spreads the bits of a byte over the eight bytes of a word.
_SPREAD = (((np.arange(256, dtype=np.uint64)[:, None] >> _bit) & np.uint64(1)) << (np.uint64(8) * _bit)).sum(axis=1).astype(np.uint64)


def shingle_hashes(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, shingles of each text) for texts that have words, joined by single spaces."""
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero((buffer == 32) | (buffer == 10))
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = np.flatnonzero(buffer[ends] == 10)
    first = np.concatenate(([0], last[:-1] + 1))
    count = np.maximum(1, last - first + 2 - shingle)
    total = np.concatenate(([0], np.cumsum(count)))
    begin = np.arange(total[-1]) + np.repeat(first - total[:-1], count)
    end = np.minimum(begin + shingle - 1, np.repeat(last, count))
    return xxh64_spans(buffer, starts[begin], ends[end]), count


def majority(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each run of ``count`` hashes the eight big-endian bytes of the bits set in over half of them."""
    pieces = -(-count // 255)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    piece_of = np.concatenate(([0], np.cumsum(pieces)))
    inner = np.arange(piece_of[-1]) - np.repeat(piece_of[:-1], pieces)
    starts = np.repeat(first, pieces) + 255 * inner
    octets = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    sums = np.empty((len(starts), 64), np.uint8)
    for i in range(8):
        sums[:, 8 * i : 8 * i + 8] = np.add.reduceat(_SPREAD[octets[:, i]], starts).view(np.uint8).reshape(-1, 8)
    totals = np.add.reduceat(sums.astype(np.int64), piece_of[:-1], axis=0)
    return np.packbits((2 * totals > count[:, None])[:, ::-1], axis=1)


def fingerprint_rows(texts: list, shingle: int = 3, tables: int = 1) -> list[bytes]:
    """The fingerprint of each text (bytes or None)."""
    out = [bytes(8 * tables)] * len(texts)
    slab, members, held = [], [], 0

    def flush():
        hashes, count = shingle_hashes(slab, shingle)
        whole = np.concatenate([majority(mixed(hashes, t), count) for t in range(tables)], axis=1)
        for i, row in zip(members, whole):
            out[i] = row.tobytes()

    for i, text in enumerate(texts):
        words = word_list(lower_ascii(text or b""))
        if not words:
            continue
        slab.append(b" ".join(words))
        members.append(i)
        held += len(slab[-1])
        if held > _SLAB:
            flush()
            slab, members, held = [], [], 0
    if slab:
        flush()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, tables: int = 1) -> DataFrame:
    """(doc_id, row, fp) of every row of ``docs`` (doc_id, text, row)."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(fingerprint_rows(texts, shingle, tables), pa.binary())], names=["doc_id", "row", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), "row").mapInArrow(freeing(run), "doc_id long, row binary, fp binary")


def _close_pairs(group: np.ndarray, side: np.ndarray, fp: np.ndarray, most: int):
    """(i, j, distance) of rows of one group (sorted by group) within ``most`` bits; side 0 rows of a tile pair meet side 1 rows only, side 2 rows meet all."""
    n = len(group)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((starts, [n])))
    start_of = np.repeat(starts, sizes)
    small = np.repeat(sizes <= 48, sizes)
    found = [(np.zeros(0, np.int64),) * 3]
    for step in range(1, min(48, int(sizes.max(initial=0)))):
        i = np.flatnonzero(small[:-step] & (start_of[:-step] == start_of[step:]))
        if not len(i):
            continue
        apart = np.bitwise_count(fp[i] ^ fp[i + step]).sum(axis=1, dtype=np.int64)
        ok = (apart <= most) & ((side[i] != side[i + step]) | (side[i] == 2))
        found.append((i[ok], i[ok] + step, apart[ok]))
    for s, size in zip(starts[sizes > 48], sizes[sizes > 48]):
        rows = np.arange(s, s + size)
        for lo in range(0, size, 256):
            part = rows[lo : lo + 256]
            rest = rows[lo:]
            apart = np.zeros((len(part), len(rest)), np.int64)
            for t in range(fp.shape[1]):
                apart += np.bitwise_count(fp[part, t][:, None] ^ fp[rest, t][None, :])
            x, y = np.nonzero(apart <= most)
            apart = apart[x, y]
            x, y = part[x], rest[y]
            ok = (x < y) & ((side[x] != side[y]) | (side[x] == 2))
            found.append((x[ok], y[ok], apart[ok]))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def links(classes: DataFrame, tables: int, shared: int, max_distance: int, tile: int = 4096, overlap: bool = False, block_bytes: int = 2) -> DataFrame:
    """(a, b): links that connect all classes (fp, node) within ``max_distance`` bits that share ``shared`` blocks.

    ``block_bytes``: rows that share a block by chance grow with the table over 256 ** block_bytes. Two bytes serve
    tens of millions of classes; beyond that three bytes with more tables keep chance and recall where they were.
    """
    blocks = 8 * tables // block_bytes
    block = lambda start: F.substring("fp", start + 1, block_bytes)
    keys = [F.concat(F.lit(bytes(chosen)), *[block(block_bytes * b) for b in chosen]) for chosen in combinations(range(blocks), shared)]
    if overlap:  # their names have two bytes, so no key of both kinds is the same
        keys += [F.concat(F.lit(start.to_bytes(2, "big")), block(start)) for start in range(8 * tables - block_bytes + 1) if start % block_bytes]
    keyed = classes.select("fp", "node", F.explode(F.array(*keys)).alias("key"))
    hot, told = stored_and_told(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > tile), "hot", rows=F.count(F.lit(1)))
    rows = keyed.join(F.broadcast(hot) if told["rows"] <= _BROADCAST_KEYS else hot, "key", "left")
    star = tables == 1 and max_distance <= 2 and block_bytes == 2

    def pairs(batches):
        held: list = []
        for batch in batches:
            table = pa.Table.from_batches([*held, batch])
            table = table.combine_chunks()
            ids = table.column("gid").to_numpy()
            cut = len(ids) - int((ids[::-1] != ids[-1]).argmax()) if (ids != ids[-1]).any() else 0
            held = table.slice(cut).to_batches()
            if cut:
                yield from solve(table.slice(0, cut))
        if held:
            yield from solve(pa.Table.from_batches(held))

    def solve(table):
        group = np.unique(table.column("gid").to_numpy(), return_inverse=True)[1] if table.num_rows else np.zeros(0, np.int64)
        fp = np.frombuffer(b"".join(table.column("fp").to_pylist()), np.uint64).reshape(table.num_rows, tables)
        node = table.column("node").to_numpy()
        x, y, _ = _close_pairs(group, table.column("side").to_numpy(), fp, max_distance)
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in forest(node[x], node[y])], names=["a", "b"])

    plain = rows.filter("n is null") if star else rows
    if star:
        dealt = plain.select("key", "fp", "node", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"))
    else:
        count = F.ceil(F.coalesce("n", F.lit(1)) / tile).cast("int")
        own = F.pmod(F.xxhash64("fp"), count).cast("int")
        dealt = (
            rows.select("key", "fp", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), count - 1)).alias("other"))
            .select("key", "fp", "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                    F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))
        )
    dealt = dealt.select(F.xxhash64("key", "i", "j").alias("gid"), "fp", "node", "side")
    found = dealt.repartition("gid").sortWithinPartitions("gid").mapInArrow(freeing(pairs), "a long, b long")
    if not star:
        return found

    def variants(batches):
        for batch in batches:
            key, fp, node = (c.to_pylist() for c in batch.columns)
            for k, f, n in zip(key, fp, node):
                word, free = int.from_bytes(f, "big"), [b for b in range(blocks) if b not in k[:shared]]
                flips = [0] + [1 << (63 - 16 * b - i) for b in free for i in range(16)]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(flips), pa.binary()), pa.array([(word ^ x).to_bytes(8, "big") for x in flips], pa.binary()), pa.array([n] * len(flips), pa.int64())], names=["key", "variant", "node"])

    near = rows.filter("n is not null").select("key", "fp", "node").mapInArrow(freeing(variants), "key binary, variant binary, node long")
    groups = near.groupBy("key", "variant").agg(F.collect_set("node").alias("nodes")).filter("size(nodes) > 1")
    return found.union(groups.select(F.explode("nodes").alias("a"), F.array_min("nodes").alias("b")))


def shingle_set(text: bytes | None, shingle: int) -> frozenset:
    """The distinct shingles of a text; a text with fewer words is one shingle, one without words has none."""
    words = word_list(lower_ascii(text or b""))
    return frozenset(b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))) if words else frozenset()


def similarity(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def _confirmed(found: DataFrame, texts: DataFrame, classes: DataFrame, shingle: int, similar: float, tile: int = 2048) -> DataFrame:
    """(node, root) of the groups that pairs with enough common shingles hold together, within the components of the links ``found``."""
    bound = Threshold(round(100 * similar))
    moved = components(found)
    may = stored(moved.union(moved.select(F.col("root").alias("node"), "root").distinct()), "may")
    wanted, told = stored_and_told(may.join(classes.select("node", F.col("head.row").alias("row")), "node").select("row", "node", "root"), "wanted", rows=F.count(F.lit(1)))
    few = told["rows"] <= _BROADCAST_KEYS
    said = stored(texts.select("row", F.col("text").cast("binary").alias("text")).join(F.broadcast(wanted) if few else wanted, "row").groupBy("node").agg(F.min("root").alias("root"), F.min("text").alias("text")), "said")

    def signed(batches):
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                words = word_list(lower_ascii(text or b""))
                h = np.unique(shingle_hashes([b" ".join(words)], shingle)[0]) if words else np.zeros(0, np.uint64)
                rows.append((len(h), 0, signature(h)))
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary())))], names=["token", "node", "n", "place", "sign"])

    def compare(batches):
        for batch in batches:
            ok = [similarity(shingle_set(s, shingle), shingle_set(t, shingle)) >= similar for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def checked(pairs):
        both = pairs.join(said.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(said.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return stored(both.select("a", "b", "text_a", "text_b").mapInArrow(freeing(compare), "a long, b long"), "held")

    lists = stored(said.select("node", "root", "text").mapInArrow(freeing(signed), "token long, node long, n long, place int, sign binary"), "signs")
    held = checked(stored(near_pairs(lists.withColumn("root", F.col("node")), bound, 0, tile, False), "near"))
    roots = stored(components(held), "roots")
    placed = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("token")
    rest, told = stored_and_told(near_pairs(placed.join(open_, "token", "left_semi"), bound, 0, tile, True), "rest", rows=F.count(F.lit(1)))
    return components(held.union(checked(rest))) if told["rows"] else roots


def _groups(docs: DataFrame, by_id: bool, shingle: int = 3, tables: int = 1, shared: int = 2, max_distance: int = 2, tile: int = 4096, overlap: bool = False, similar: float | None = None, block_bytes: int = 2) -> tuple[DataFrame, DataFrame]:
    """(rows of ``docs`` as (doc_id, row, fp), (fp, node, root, head) of each distinct fingerprint).

    ``root`` is one node of the group, ``head`` the least (no id, doc_id, row) of the fingerprint's rows. Nodes are
    numbers of fingerprints, so null ids and repeated ids unite nothing; with ``by_id`` fingerprints of one doc_id are linked too.
    """
    marked = stored(fingerprints(docs, shingle, tables), "simhash")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("head")
    classes = stored(marked.groupBy("fp").agg(head).withColumn("node", F.monotonically_increasing_id()), "classes")
    found = links(classes.select("fp", "node"), tables, shared, max_distance, tile, overlap, block_bytes)
    if by_id:
        ids = marked.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low <> high")
        again = marked.join(ids, "doc_id").select("fp", "low").filter("fp <> low").distinct()
        again = again.join(classes.select("fp", F.col("node").alias("a")), "fp").join(classes.select(F.col("fp").alias("low"), F.col("node").alias("b")), "low")
        found = found.union(again.select("a", "b"))
    roots = components(found) if similar is None else _confirmed(found, docs, classes, shingle, similar)
    return marked, classes.join(roots, "node", "left").select("fp", "node", F.least("node", "root").alias("root"), "head")


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text); component_id is the least doc_id of the group."""
    row = _row() if how.get("similar") else F.lit(None).cast("binary")
    marked, classes = _groups(docs.select("doc_id", "text", row.alias("row")), True, **how)
    heads = classes.groupBy("root").agg(F.min("head.doc_id").alias("component_id"))
    placed = classes.join(heads, "root").select("fp", "component_id")
    return marked.join(placed, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def _row():
    """The SHA-256 of doc_id and text."""
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(" "), F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary"), 256))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """One row of each group of ``docs``: that of the smallest doc_id, one without an id only if no row of the group has one.

    Ids need not be unique: a row is known by the SHA-256 of its doc_id and text; of rows equal in both the first in order of the other columns stays.
    """
    row, first = free_names(docs.columns, "row", "first")
    named = docs.withColumn(row, _row())
    _, classes = _groups(named.select("doc_id", "text", F.col(row).alias("row")), False, **how)
    heads = classes.groupBy("root").agg(F.min("head").alias("head")).select(F.col("head.row").alias(row))
    left = named.join(heads, row, "left_semi").groupBy(row).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(first))
    return left.select(f"{first}.*")
