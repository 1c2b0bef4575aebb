"""Benchmark decontamination: n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

The test set is worked through in chunks of at most ``chunk_words`` words, so
what the executors get of it is bounded however large it is; each chunk takes
one pass over the documents and no shuffle.

One pass over the documents serves 2 million words of test items, about 50,000
items of 40 words; a larger test set takes one more pass for each such part.

Seeds are rare n-grams: those that at most ``rare`` different items hold. How
many documents hold them does not count, as copies that were edited and
repeated make just their own n-grams frequent. An n-gram of more items grows by
the words behind it, and by those before it, until it is rare; at ``LONGEST``
words it is a seed whatever its frequency. So each seed names few items, and a
document costs what the items that it may hold cost, not the number of items.
Items of up to ``SHORT`` words keep all their n-grams. Equal items are one.
Where a document holds seeds of an item, the passage around each cluster of
them is aligned with the item.

A passage that holds too few of the item's words to reach the threshold, as a
whole or in every stretch that an alignment can span, is left out before it is
aligned; both bounds are exact. Score: local alignment of
words (1 for a match, ``miss`` for a mismatch, ``gap`` for a word left out),
divided by the words of the item, so 1 is a whole copy.

Words are runs of ASCII letters and digits and of all non-ASCII characters,
A-Z lower-cased; hashes stand for them (CRC-32).

Defined results
    null or empty text, item   no words, never a match
    copies without a seed      a copy that keeps no rare n-gram of the item, and of
                               the frequent ones none with the words around that
                               make it rare, is not found
    items under ``n`` words    their only seed is the whole item, so they match
                               where all of their words stand in order
    very long texts, items     compared whole; memory grows with one text and one
                               item, not with their product
    equal passages             of passages with one score the first is reported
    repeated rows              each row is compared; repeated items each match
    null ids                   kept as they are
    empty tables               an empty result
    extra columns              ignored; without_leaks() returns them
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)

PAIRS = "doc_id long, item_id long, score double, start_word long, end_word long, n_passages long"


def word_hashes(text: bytes | None) -> np.ndarray:
    words = _WORD.findall((text or b"").lower())
    return np.fromiter(map(crc32, words), np.uint64, len(words))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n words from each word on."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1]
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(31))) * _MIX + words[k : len(words) - n + 1 + k]
    return (out ^ (out >> np.uint64(32))) * _MIX


#: Items of up to so many words keep all their n-grams as seeds; frequent n-grams grow to so many words at most.
SHORT, LONGEST = 12, 8
#: Bits of the tables that tell most n-grams of a document apart from seeds before they are looked up.
_TABLE = 22


class Lookup:
    """Sorted keys with the items of each, and a table of bits in front."""

    def __init__(self, key: np.ndarray, item: np.ndarray, items: int):
        pairs = np.unique(np.stack([key, item.astype(np.uint64)]), axis=1) if len(key) else np.zeros((2, 0), np.uint64)
        self.keys, self.first = np.unique(pairs[0], return_index=True)
        self.first = np.append(self.first, pairs.shape[1])
        self.item = pairs[1].astype(np.int32)
        self.table = np.zeros(1 << _TABLE, bool)
        self.table[self._slot(self.keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - _TABLE)).astype(np.int64)

    def hits(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``keys`` are here, their numbers)."""
        maybe = np.flatnonzero(self.table[self._slot(keys)])
        if not len(maybe):
            return maybe, maybe
        at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        ok = self.keys[at] == keys[maybe]
        return maybe[ok], at[ok]

    def items(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``keys``, item) of each item of each key that is here."""
        which, number = self.hits(keys)
        first, count = self.first[number], self.first[number + 1] - self.first[number]
        at = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum()) if len(number) else number
        return np.repeat(which, count), self.item[at]


@dataclass
class Index:
    """The items of one chunk, equal ones once, and their seeds."""

    ids: list[list]  # of each item the item_ids that have its words
    words: list[np.ndarray]
    flat: np.ndarray  # the items' words one after the other
    start: np.ndarray
    sizes: list[int]  # words of the seeds
    seeds: Lookup

    @classmethod
    def of(cls, rows: list[tuple], n: int, rare: int = 8) -> "Index":
        same: dict[bytes, int] = {}
        ids, words = [], []
        for item, text in rows:
            w = word_hashes(text)
            k = same.setdefault(w.tobytes(), len(words))
            if k == len(words):
                words.append(w)
                ids.append([])
            ids[k].append(item)
        long = np.array([len(w) > SHORT for w in words], bool)
        found, open_ = [], None  # open_: whether a seed may still grow, by item and place of the n-gram; [behind, before]
        for size in range(n, LONGEST + 1):
            each = [grams(w, min(size, max(1, len(w)))) for w in words]
            key = np.concatenate([np.zeros(0, np.uint64), *each])
            item = np.repeat(np.arange(len(words)), [len(g) for g in each])
            place = np.concatenate([np.zeros(0, np.int64), *map(np.arange, map(len, each))])
            once = np.unique(np.stack([key, item.astype(np.uint64)]), axis=1)[0] if len(key) else key
            known, held = np.unique(once, return_counts=True)
            seldom = (held[np.searchsorted(known, key)] <= rare) | ~long[item] | (size == LONGEST)
            if open_ is None:
                chosen, open_ = seldom, [set(zip(item[~seldom].tolist(), place[~seldom].tolist(), strict=True))] * 2
            else:  # the same start, or the same end
                ids_, at = item.tolist(), place.tolist()
                starts = np.array([(i, p) in open_[0] for i, p in zip(ids_, at, strict=True)], bool)
                ends = np.array([(i, p + size - n) in open_[1] for i, p in zip(ids_, at, strict=True)], bool)
                chosen = seldom & (starts | ends)
                open_ = [{(i, p) for i, p, ok in zip(ids_, at, ~seldom & starts, strict=True) if ok}, {(i, p + size - n) for i, p, ok in zip(ids_, at, ~seldom & ends, strict=True) if ok}]
            found.append((key[chosen], item[chosen]))
            if not open_[0] and not open_[1]:
                break
        sizes = {min(n, len(w)) for w in words if len(w)} | set(range(n + 1, n + len(found)))
        start = np.cumsum([0, *map(len, words)])
        return cls(ids, words, np.concatenate([np.zeros(0, np.uint64), *words]), start, sorted(sizes), Lookup(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), len(words)))

    def candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the document, item) of the seeds, sorted by item and place."""
        places, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for n in self.sizes:
            place, item = self.seeds.items(grams(words, n))
            places.append(place)
            items.append(item)
        place, item = np.concatenate(places), np.concatenate(items).astype(np.int64)
        if not len(place):
            return place, item
        place, item = np.divmod(np.unique(place * len(self.words) + item), len(self.words))
        order = np.lexsort((place, item))
        return place[order], item[order]

    def present(self, items: np.ndarray, words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each k how many words of item ``items[k]`` stand in ``words[begin[k] : end[k]]``."""
        size = self.start[items + 1] - self.start[items]
        before = np.concatenate(([0], np.cumsum(size)[:-1]))
        wanted = self.flat[np.repeat(self.start[items] - before, size) + np.arange(size.sum())]
        known, number = np.unique(words, return_inverse=True)
        width = len(words) + 1
        places = np.sort(number * width + np.arange(len(words)))
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        low = at * width + np.repeat(begin, size)
        nearest = places[np.minimum(np.searchsorted(places, low), len(places) - 1)]
        held = (known[at] == wanted) & (nearest >= low) & (nearest < at * width + np.repeat(end, size))
        return np.add.reduceat(held, before, dtype=np.int64)


def align(item: np.ndarray, passage: np.ndarray, miss: float, gap: float) -> tuple[float, int]:
    """(best local score, place after its last word in the passage) by Smith-Waterman with linear gaps."""
    ramp = gap * np.arange(len(passage) + 1)
    above = np.zeros(len(passage) + 1)
    best, end = 0.0, 0
    for word in item:
        row = np.zeros(len(passage) + 1)
        np.maximum(above[:-1] + np.where(passage == word, 1.0, miss), above[1:] + gap, out=row[1:])
        np.maximum(row, 0.0, out=row)
        row = np.maximum.accumulate(row - ramp) + ramp
        top = int(row.argmax())
        if row[top] > best + 1e-12:
            best, end = float(row[top]), top
        above = row
    return best, end


def leaks_of(words: np.ndarray, index: Index, threshold: float, miss: float, gap: float) -> list[tuple]:
    """(item number, score, start word, end word, passages) for each item that the document holds."""
    place, item = index.candidates(words)
    if not len(place):
        return []
    size = index.start[item + 1] - index.start[item]
    slack = size + size // 2 + 4
    first = np.flatnonzero(np.concatenate(([True], (item[1:] != item[:-1]) | (np.diff(place) > slack[1:]))))
    last = np.concatenate((first[1:], [len(place)])) - 1
    begin, end = np.maximum(0, place[first] - slack[first]), np.minimum(len(words), place[last] + slack[first])
    enough = index.present(item[first], words, begin, end) >= threshold * size[first] - 1e-9
    best: dict[int, list] = {}
    for number, begin, end in zip(item[first[enough]].tolist(), begin[enough].tolist(), end[enough].tolist(), strict=True):
        target, passage = index.words[number], words[begin:end]
        need = threshold * len(target)
        span = len(target) + int((len(target) - need) / -gap + 1e-9) if gap < 0 else len(words)
        if len(passage) > span:
            held = np.concatenate(([0], np.cumsum(np.isin(passage, target))))
            if (held[span:] - held[:-span]).max() < need - 1e-9:
                continue
        score, stop = align(target, passage, miss, gap)
        if score < need - 1e-9:
            continue
        found = best.setdefault(number, [score, begin, stop, passage, 0])
        found[4] += 1
        if score > found[0]:
            found[:4] = score, begin, stop, passage
    out = []
    for number, (score, begin, stop, passage, passages) in best.items():
        target = index.words[number]
        _, back = align(target[::-1], passage[:stop][::-1], miss, gap)
        out.append((number, min(1.0, score / len(target)), begin + stop - back, begin + stop, passages))
    return out


def _chunks(benchmark: DataFrame, chunk_words: int):
    """Lists of (item_id, text bytes) with about ``chunk_words`` words at most, one at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).filter("text is not null")
    size = F.octet_length("text")
    total = items.agg(F.sum(size)).first()[0] or 0
    parts = max(1, -(-total // (6 * chunk_words)))
    for part in range(parts):
        chosen = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield sorted(((r[0], bytes(r[1])) for r in chosen.toLocalIterator()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def seed_indexes(benchmark: DataFrame, n: int = 3, chunk_words: int = 2_000_000):
    """An Index of the seeds for each chunk of the test set."""
    for rows in _chunks(benchmark, chunk_words):
        yield Index.of(rows, n)


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.5, miss: float = -0.5, gap: float = -0.5, chunk_words: int = 2_000_000) -> DataFrame:
    """PAIRS: each document row (doc_id, text) and test item (item_id, text) whose alignment reaches ``threshold``."""
    out = None
    for index in seed_indexes(benchmark, n, chunk_words):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for number, *rest in leaks_of(word_hashes(text), shared.value, threshold, miss, gap):
                        rows += [(doc_id, item_id, *rest) for item_id in shared.value.ids[number]]
                columns = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.float64()] + [pa.int64()] * 3)], names=[c.split()[0] for c in PAIRS.split(", ")])

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(freeing(run), PAIRS)
        out = found if out is None else out.union(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, miss: float = -0.5, gap: float = -0.5, **how) -> DataFrame:
    """The rows of ``docs`` that hold no test item, all columns kept; nothing is shuffled."""
    out, at = docs, docs.columns.index("text")
    for index in seed_indexes(benchmark, **how):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                clean = [not leaks_of(word_hashes((t or "").encode("utf-8")), shared.value, threshold, miss, gap) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(freeing(run), docs.schema)
    return out
