"""Suffix-array deduplication of byte strings that documents share.

Every byte that is covered by a ``window``-byte string which also starts in a
document with a smaller id is removed; matches never cross documents.

Two strings that are equal have the same least hash among their 24-byte
substrings (their anchor), so strings meet by anchor, never by document:

1. texts are packed into chunks (rows of some MB, written once);
2. each chunk sends its distinct anchors, sorted and packed, to buckets by
   anchor; a bucket answers which of them occur in two documents;
3. for those only, a chunk sends the runs of windows that share an anchor
   (pieces), one for each distinct piece, with the least id in the chunk;
4. each bucket sorts the suffixes of its distinct pieces in two stages, takes
   adjacent common prefixes, and tells the chunks which windows start in a
   document with a smaller id;
5. each chunk joins the windows to spans and cuts them out.

A chunk never meets more than ``fan`` buckets in steps 2 to 4. Where there are
more, it sends to ``fan`` ranges of buckets; a cell takes one range from as
many chunks as fill a bucket, merges what is equal and sends that on to the
buckets of its range, and hands their answers back to its chunks. So chunks
send at most ``fan`` rows each, and cells buckets * buckets / ``fan`` in all,
100 thousand at 30 GB, where chunks by buckets were 56 million.

Exact copies are settled by digest before step 3: all but the first lose all
windows. What a chunk sends is free of repeats, so an anchor or a passage that
a third of the documents share costs a bucket one entry a chunk. A bucket
that is too large all the same is dealt out by windows: equal windows go to
the same share, each share is sorted by itself.

Digests (SHA-256) and, inside one chunk or bucket, 64-bit hashes with lengths
stand for equal texts and pieces; windows are compared byte by byte.

Defined results
    null or empty text   no bytes, nothing removed
    null doc_id          counts as the largest id
    repeated doc_id      rows of one id do not remove from each other
    repeated rows        each row gets the same result
    very long texts      a chunk of its own, matched whole
    empty table          an empty result
    extra columns        ignored; cleaned() returns them
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, freeing, fresh_path, release, stored
from .hashing import words_at, xxh64_spans
from .suffixes import big_words, common_prefixes, suffix_array

ANCHOR = 24
#: Windows that are hashed at once.
_SLAB = 1 << 19

CHUNK = "chunk long, ids array<long>, sizes array<long>, digests array<binary>, texts binary"
REMOVED = "id long, digest binary, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed blob, each with its type and length."""
    parts = [struct.pack("<I", len(arrays))]
    for a in arrays:
        parts += [a.dtype.str.encode().ljust(4), struct.pack("<Q", len(a)), a.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unpacked(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    count, at, out = struct.unpack_from("<I", data)[0], 4, []
    for _ in range(count):
        kind, n = np.dtype(data[at : at + 4].strip().decode()), struct.unpack_from("<Q", data, at + 4)[0]
        out.append(np.frombuffer(data, kind, n, at + 12))
        at += 12 + n * kind.itemsize
    return out


# -- chunks ---------------------------------------------------------------------------------------


def spark_hash(values: np.ndarray) -> np.ndarray:
    """Murmur3 of 64-bit integers with seed 42, the hash that deals rows to the buckets of a table."""
    with np.errstate(over="ignore"):
        h = np.full(len(values), 42, np.uint32)
        bits = values.astype(np.int64).view(np.uint64)
        for part in (bits & np.uint64(0xFFFFFFFF), bits >> np.uint64(32)):
            k = part.astype(np.uint32) * np.uint32(0xCC9E2D51)
            h ^= ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)
            h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(8)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
        return (h ^ (h >> np.uint32(16))).view(np.int32)


def chunk_name(task: int, number: int, files: int) -> int:
    """An id for a chunk that is unique to (task, number) and falls into the task's own bucket, so a task writes one file."""
    base = (task << 40) | (number << 22)
    for lo in range(0, 1 << 22, 1 << 14):
        tried = base + np.arange(lo, lo + (1 << 14))
        fits = np.flatnonzero(spark_hash(tried) % files == task % files)
        if len(fits):
            return int(tried[fits[0]])
    return base


def packed_chunks(docs: DataFrame, chunk_bytes: int, files: int, chunk_docs: int = 20000) -> DataFrame:
    """CHUNK rows of about ``chunk_bytes`` of text and at most ``chunk_docs`` documents."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))

    def pack(batches):
        task, number = TaskContext.get().partitionId(), 0
        ids, sizes, digests, texts, held = [], [], [], [], 0
        packer = zstandard.ZstdCompressor(level=3)

        def chunk():
            return pa.RecordBatch.from_arrays(
                [pa.array([chunk_name(task, number, files)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([digests], pa.list_(pa.binary())), pa.array([packer.compress(b"".join(texts))], pa.binary())],
                names=["chunk", "ids", "sizes", "digests", "texts"],
            )

        for batch in batches:
            for i, d, t in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (held + len(t) > chunk_bytes or len(ids) >= chunk_docs):
                    yield chunk()
                    number += 1
                    ids, sizes, digests, texts, held = [], [], [], [], 0
                ids.append(i)
                sizes.append(len(t))
                digests.append(d)
                texts.append(t)
                held += len(t)
        if ids:
            yield chunk()

    return rows.mapInArrow(freeing(pack), CHUNK)


def bucketed(chunks: DataFrame, files: int) -> DataFrame:
    """Writes the chunks to the shared folder as a table bucketed by chunk: what is joined to them by chunk moves, they do not."""
    spark, path = chunks.sparkSession, fresh_path(chunks.sparkSession, "chunks")
    name = path.rpartition("/")[2].replace("-", "_")
    chunks.write.bucketBy(files, "chunk").option("path", path).option("compression", "uncompressed").saveAsTable(name, format="parquet")
    return spark.table(name)


class Chunk:
    """One chunk in memory: the bytes, where documents start and end, which of them are the first of their text here."""

    def __init__(self, ids, sizes, digests, texts: bytes):
        self.ids, sizes = np.array(ids, np.int64), np.array(sizes, np.int64)
        self.digests = digests
        self.bytes = np.frombuffer(zstandard.ZstdDecompressor().decompress(texts), np.uint8) if sizes.sum() else np.zeros(0, np.uint8)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        first: dict[bytes, int] = {}
        for i, d in enumerate(digests):
            if d not in first or self.ids[i] < self.ids[first[d]]:
                first[d] = i
        self.own = np.zeros(len(self.ids), bool)
        self.own[list(first.values())] = True

    def runs(self, window: int, key_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first window, windows, document, key) of each run of windows with one anchor, over documents that are the first of their text."""
        which = np.flatnonzero(self.own & (self.ends - self.starts >= window))
        n = len(self.bytes)
        if not len(which):
            none = np.zeros(0, np.int64)
            return none, none, none, np.zeros(0, np.uint64)
        edge = np.zeros(n + 1, np.int8)
        np.add.at(edge, self.starts[which], 1)
        np.add.at(edge, self.ends[which] - window + 1, -1)
        valid = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        begins = np.zeros(n, bool)
        begins[self.starts[which]] = True
        span = window - ANCHOR + 1
        at, keys = [], []
        last_start = int(self.ends[which].max()) - window + 1
        previous = np.uint64(0)
        for lo in range(0, last_start, _SLAB):
            hi = min(last_start, lo + _SLAB)
            word = words_at(self.bytes[lo : min(n, hi + window + 8)])
            count = hi - lo + span - 1  # anchors that start in [lo, hi + span - 1)
            with np.errstate(over="ignore"):
                h = _mix(word[:count] * np.uint64(0x9E3779B97F4A7C15))
                h = _mix(h + word[8 : count + 8] * np.uint64(0xC2B2AE3D27D4EB4F))
                h = _mix(h + word[16 : count + 16] * np.uint64(0x165667B19E3779F9))
            width, least = 1, h
            while width * 2 <= span:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            low = np.minimum(least[: hi - lo], least[span - width : span - width + hi - lo])
            new = np.empty(hi - lo, bool)
            new[1:] = low[1:] != low[:-1]
            new[0] = lo == 0 or low[0] != previous
            previous = low[-1]
            new = np.flatnonzero((new | begins[lo:hi]) & valid[lo:hi])
            at.append(new + lo)
            with np.errstate(over="ignore"):
                keys.append(_mix(low[new] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - key_bits))
        at, keys = np.concatenate(at), np.concatenate(keys)
        doc = np.searchsorted(self.starts[which], at, side="right") - 1
        doc = which[doc]
        limit = self.ends[doc] - window + 1
        stop = np.minimum(limit, np.concatenate((at[1:], [n])))
        return at, stop - at, doc, keys


def _chunk(batch, i: int) -> Chunk:
    return Chunk(*(batch.column(c)[i].as_py() for c in ("ids", "sizes", "digests", "texts")))


# -- which anchors occur in two documents ----------------------------------------------------------


def _distinct_keys(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, whether each occurs with two ids)."""
    order = np.argsort(keys, kind="stable")
    keys, ids = keys[order], ids[order]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    if not len(starts):
        return keys, np.zeros(0, bool)
    return keys[starts], np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)


def _shares(keys: np.ndarray, width: int, count: int, first: int = 0) -> np.ndarray:
    """Where each of ``count`` buckets of ``width`` keys, from the ``first`` one on, begins among sorted keys."""
    edges = [min((first + k) * width, (1 << 64) - 1) for k in range(count + 1)]
    return np.searchsorted(keys, np.array(edges, np.uint64))


def _key_blob(keys: np.ndarray, twice: np.ndarray) -> bytes:
    """Sorted keys as the bytes of their differences, which pack well, and their flags."""
    steps = np.diff(keys, prepend=np.uint64(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T[:6]).reshape(-1)
    return _packed(planes, np.packbits(twice), np.array([len(keys)]))


def _keys_of(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes, twice, (n,) = _unpacked(blob)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :6] = planes.reshape(6, n).T
    return np.cumsum(steps.view(np.uint64).reshape(-1)), np.unpackbits(twice, count=n).astype(bool)


def _key_rows(window: int, width: int, count: int, key_bits: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = _chunk(batch, i)
                _, _, doc, keys = chunk.runs(window, key_bits)
                keys, twice = _distinct_keys(keys, chunk.ids[doc])
                edges = _shares(keys, width, count)
                used = np.flatnonzero(np.diff(edges))
                blobs = [_key_blob(keys[edges[b] : edges[b + 1]], twice[edges[b] : edges[b + 1]]) for b in used]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([batch.column("chunk")[i].as_py()] * len(used), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "chunk", "blob"])

    return run


def _merged_keys(width: int, inner: int):
    """The distinct keys of a cell (column ``range``, rows of chunks) for each of the ``inner`` buckets of its range; a key of two chunks occurs in two documents."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        which, cell = int(frame["range"].iloc[0]), int(frame["cell"].iloc[0])
        rows = [_keys_of(blob) for blob in frame["blob"]]
        keys, first, count = np.unique(np.concatenate([k for k, _ in rows]), return_index=True, return_counts=True)
        flags = np.concatenate([t for _, t in rows])
        every = np.concatenate([k for k, _ in rows])
        twice = count > 1
        twice[np.searchsorted(keys, every[flags])] = True
        edges = _shares(keys, width, inner, which * inner)
        used = np.flatnonzero(np.diff(edges))
        return pd.DataFrame({"bucket": which * inner + used, "chunk": np.full(len(used), cell), "blob": [_key_blob(keys[edges[b] : edges[b + 1]], twice[edges[b] : edges[b + 1]]) for b in used]})

    return run


def _spread_masks(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """The masks of a cell's keys, handed back to its chunks."""
    rows = [_keys_of(blob)[0] for blob in frame["blob"]]
    keys = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.uint64)
    answers = answers.sort_values("bucket")
    bits = [np.unpackbits(np.frombuffer(mask, np.uint8))[:n] for mask, n in zip(answers["mask"], answers["n"])]
    shared = np.concatenate([np.zeros(0, np.uint8), *bits]).astype(bool)
    masks = [np.packbits(shared[np.searchsorted(keys, own)]).tobytes() for own in rows]
    return pd.DataFrame({"chunk": frame["chunk"], "bucket": frame["range"], "mask": masks})


def _shared_keys(frame: pd.DataFrame) -> pd.DataFrame:
    """For each row of keys a bit mask of those that occur in two documents."""
    rows = [_keys_of(blob) for blob in frame["blob"]]
    parts, flags = [r[0] for r in rows], [r[1] for r in rows]
    sizes = np.array([len(p) for p in parts])
    keys, twice = np.concatenate(parts), np.concatenate(flags)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    twice_ordered = twice[order]
    twice_ordered[1:] |= same
    twice_ordered[:-1] |= same
    twice[order] = twice_ordered
    ends = np.cumsum(sizes)
    masks = [np.packbits(twice[e - s : e]).tobytes() for s, e in zip(sizes, ends)]
    del keys, twice, ordered, order, parts
    release()
    return pd.DataFrame({"chunk": frame["chunk"], "bucket": frame["bucket"], "n": sizes, "mask": masks})


# -- pieces ---------------------------------------------------------------------------------------


def _gathered(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return text[shift + np.arange(len(shift))]


def _piece_share(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(keys + np.uint64(0x51)) % np.uint64(buckets)).astype(np.int64)


def _piece_rows(window: int, buckets: int, inner: int, key_width: int, key_count: int, key_bits: int):
    """Rows (kind, bucket, chunk, size, blob): kind 0 the pieces for a range of ``inner`` buckets and the bytes they unpack to, kind 1 where each piece stands in the chunk."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, name = _chunk(batch, i), batch.column("chunk")[i].as_py()
                at, count, doc, keys = chunk.runs(window, key_bits)
                distinct = np.unique(keys)
                edges, shared = _shares(distinct, key_width, key_count), np.zeros(len(distinct), bool)
                for row in batch.column("masks")[i].as_py():
                    lo, hi = edges[row["bucket"]], edges[row["bucket"] + 1]
                    shared[lo:hi] = np.unpackbits(np.frombuffer(row["mask"], np.uint8), count=hi - lo).astype(bool)
                settled = np.zeros(len(chunk.ids), bool)
                settled[batch.column("skip")[i].as_py() or []] = True
                use = np.flatnonzero(shared[np.searchsorted(distinct, keys)] & ~settled[doc])
                if not len(use):
                    continue
                at, count, doc, keys = at[use], count[use], doc[use], keys[use]
                size = count + window - 1
                code = xxh64_spans(chunk.bytes, at, at + size, 7) ^ size.astype(np.uint64)
                _, first, piece = np.unique(code, return_index=True, return_inverse=True)
                least = np.full(len(first), NULL_ID, np.int64)
                np.minimum.at(least, piece, chunk.ids[doc])
                share = _piece_share(keys[first], buckets) // inner
                order = np.argsort(share, kind="stable")
                starts, sizes = at[first][order], size[first][order]
                text = _gathered(chunk.bytes, starts, sizes)
                byte_ends = np.concatenate(([0], np.cumsum(sizes)))
                cuts = np.searchsorted(share[order], np.arange(-(-buckets // inner) + 1))
                kinds, names, unpacked, blobs = [1], [-1], [0], [_packed(piece.astype(np.int32), doc.astype(np.int32), (at - chunk.starts[doc]).astype(np.int64), count.astype(np.int32))]
                for b in np.flatnonzero(np.diff(cuts)):
                    own = order[cuts[b] : cuts[b + 1]]
                    kinds.append(0)
                    names.append(int(b))
                    unpacked.append(int(byte_ends[cuts[b + 1]] - byte_ends[cuts[b]]) + 28 * len(own))
                    blobs.append(_packed(keys[first][own], least[own], size[first][own].astype(np.int32), own.astype(np.int32), np.zeros(len(own), np.int32), text[byte_ends[cuts[b]] : byte_ends[cuts[b + 1]]]))
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(names, pa.int32()), pa.array([name] * len(kinds), pa.int64()), pa.array(unpacked, pa.int64()), pa.array(blobs, pa.binary())], names=["kind", "bucket", "chunk", "size", "blob"])

    return run


def _joined(blobs) -> tuple:
    """(rows, and of all of their pieces: keys, least, size, start, end, text, the row, the piece of that row, equal pieces as one number)."""
    rows = [_unpacked(blob) for blob in blobs]
    keys, least, size, piece, _, text = (np.concatenate([r[k] for r in rows]) for k in range(6))
    end = np.cumsum(size, dtype=np.int64)
    code = xxh64_spans(text, end - size, end, 7) ^ size.astype(np.uint64)
    _, first, same = np.unique(code, return_index=True, return_inverse=True)
    lowest = np.full(len(first), NULL_ID, np.int64)
    np.minimum.at(lowest, same, least)
    return rows, keys, least, size, end, text, piece, first, same, lowest


def _merged_pieces(buckets: int, inner: int):
    """The distinct pieces of a cell (rows of chunks) with their least ids, for each bucket of its range; the piece's number is its rank in the cell."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        cell = int(frame["cell"].iloc[0])
        _, keys, _, size, end, text, _, first, _, lowest = _joined(frame["blob"])
        share = _piece_share(keys[first], buckets)
        order = np.argsort(share, kind="stable")
        share = share[order]
        heads = np.flatnonzero(np.concatenate((np.ones(min(1, len(share)), bool), share[1:] != share[:-1])))
        names, sizes, blobs = [], [], []
        for lo, hi in zip(heads, [*heads[1:], len(share)]):
            own = order[lo:hi]
            at = first[own]
            part = _gathered(text, end[at] - size[at], size[at].astype(np.int64))
            names.append(int(share[lo]))
            sizes.append(len(part) + 28 * len(own))
            blobs.append(_packed(keys[at], lowest[own], size[at], own.astype(np.int32), np.zeros(len(own), np.int32), part))
        release()
        return pd.DataFrame({"bucket": names, "chunk": np.full(len(names), cell), "size": sizes, "blob": blobs})

    return run


def _spread_answers(window: int):
    """The answers for a cell's pieces, handed back to the pieces of its chunks; a piece that another chunk of the cell has with a smaller id goes as a whole."""

    def run(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame({"chunk": [], "answer": []})
        rows, _, least, size, _, _, piece, first, same, lowest = _joined(frame["blob"])
        found = [_unpacked(blob) for blob in answers["answer"]]
        which, lo, hi = (np.concatenate([np.zeros(0, np.int32), *[f[k] for f in found]]).astype(np.int64) for k in range(3))
        order = np.argsort(which, kind="stable")
        which, lo, hi = which[order], lo[order], hi[order]
        whole = least > lowest[same]
        begin, end = np.searchsorted(which, same), np.searchsorted(which, same, side="right")
        out_chunk, out_blob, at = [], [], 0
        for chunk, row in zip(frame["chunk"], rows):
            own = np.arange(at, at + len(row[0]))
            at += len(row[0])
            gone, some = own[whole[own]], own[~whole[own] & (end[own] > begin[own])]
            many = end[some] - begin[some]
            place = np.repeat(begin[some] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            parts = (np.concatenate((piece[gone], np.repeat(piece[some], many))), np.concatenate((np.zeros(len(gone), np.int64), lo[place])), np.concatenate((size[gone] - window + 1, hi[place])))
            if len(parts[0]):
                out_chunk.append(chunk)
                out_blob.append(_packed(*(p.astype(np.int32) for p in parts)))
        release()
        return pd.DataFrame({"chunk": out_chunk, "answer": out_blob})

    return run


def _dealt_out(window: int):
    """Pieces of buckets that are too large, as windows: equal windows go to the same share."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys, least, size, piece, _, text = _unpacked(batch.column("blob")[i].as_py())
                parts, name, bucket = batch.column("parts")[i].as_py(), batch.column("chunk")[i].as_py(), batch.column("bucket")[i].as_py()
                begin = np.cumsum(size, dtype=np.int64) - size
                count = size - window + 1
                of = np.repeat(np.arange(len(size)), count)
                inner = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                start = begin[of] + inner
                code = xxh64_spans(text, start, start + window, 11)
                share = (code % np.uint64(parts)).astype(np.int64)
                order = np.argsort(share, kind="stable")
                cuts = np.searchsorted(share[order], np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(cuts)):
                    own = order[cuts[p] : cuts[p + 1]]
                    blob = _packed(code[own], least[of[own]], np.full(len(own), window, np.int32), piece[of[own]], inner[own].astype(np.int32), _gathered(text, start[own], np.full(len(own), window)))
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([int(p)], pa.int32()), pa.array([name], pa.int64()), pa.array([blob], pa.binary())], names=["bucket", "part", "chunk", "blob"])

    return run


def repeated_windows(keys, least, size, text, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first window, end) of the runs of windows that also stand in a piece with a smaller ``least``.

    Equal pieces need no sorting; suffixes are sorted for the distinct pieces of keys that have several.
    """
    end = np.cumsum(size, dtype=np.int64)
    begin = end - size
    code = xxh64_spans(text, begin, end, 7) ^ size.astype(np.uint64)
    _, first, same = np.unique(code, return_index=True, return_inverse=True)
    lowest = np.full(len(first), NULL_ID, np.int64)
    np.minimum.at(lowest, same, least)
    whole = np.flatnonzero(least > lowest[same])
    found = [(whole, np.zeros(len(whole), np.int64), (size[whole] - window + 1).astype(np.int64))]
    _, key, per_key = np.unique(keys[first], return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(per_key[key] > 1)
    if len(mixed):
        sizes = size[first[mixed]].astype(np.int64)
        joined = np.zeros(int((sizes + 1).sum()), np.uint8)  # a zero byte after each piece
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        place = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        joined[place] = _gathered(text, begin[first[mixed]], sizes)
        of = np.repeat(np.arange(len(mixed)), sizes + 1)
        words = big_words(joined)
        order = suffix_array(joined, words)
        order = order[order + window <= (starts + sizes)[of[order]]]
        ids = lowest[mixed][of[order]]
        heads = np.flatnonzero(np.concatenate(([True], common_prefixes(order, words, window) < window)))
        least_of = np.repeat(np.minimum.reduceat(ids, heads), np.diff(np.concatenate((heads, [len(order)]))))
        hit = np.sort(order[ids > least_of])
        if len(hit):
            new = np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (of[hit[1:]] != of[hit[:-1]])))
            lo, hi = hit[new], hit[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(hit) - 1]))] + 1
            holder = mixed[of[lo]]
            lo, hi = lo - starts[of[lo]], hi - starts[of[hi - 1]]
            # every piece that is equal to the holder and has its least id; the others are wholly marked already
            order = np.argsort(same, kind="stable")
            left, right = np.searchsorted(same[order], holder), np.searchsorted(same[order], holder, side="right")
            many = right - left
            at = order[np.repeat(left - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            lo, hi = np.repeat(lo, many), np.repeat(hi, many)
            keep = least[at] == lowest[same[at]]
            found.append((at[keep], lo[keep], hi[keep]))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def _solved(window: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = [_unpacked(blob) for blob in frame["blob"]]
        keys, least, size, piece, inner, text = (np.concatenate([r[k] for r in rows]) for k in range(6))
        row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        at, lo, hi = repeated_windows(keys, least, size, text, window)
        order = np.argsort(row[at], kind="stable")
        at, lo, hi = at[order], lo[order] + inner[at[order]], hi[order] + inner[at[order]]
        cuts = np.searchsorted(row[at], np.arange(len(rows) + 1))
        used = np.flatnonzero(np.diff(cuts))
        blobs = [_packed(piece[at[cuts[r] : cuts[r + 1]]], lo[cuts[r] : cuts[r + 1]].astype(np.int32), hi[cuts[r] : cuts[r + 1]].astype(np.int32)) for r in used]
        del keys, least, size, text, order
        release()
        return pd.DataFrame({"chunk": frame["chunk"].to_numpy()[used], "answer": blobs})

    return run


# -- cutting --------------------------------------------------------------------------------------


def merged(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs (doc, begin, end) of the spans of each document."""
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    wide = int(end.max()) + 1 if len(end) else 1
    reach = np.maximum.accumulate(end + doc.astype(np.int64) * wide) if len(end) else end
    new = np.ones(len(doc), bool)
    new[1:] = begin[1:] + doc[1:].astype(np.int64) * wide > reach[:-1]
    new[1:] |= doc[1:] != doc[:-1]
    heads = np.flatnonzero(new)
    last = np.concatenate((heads[1:], [len(doc)])) - 1
    return doc[heads], begin[heads], (reach[last] - doc[last].astype(np.int64) * wide) if len(heads) else end


def _cut_rows(window: int, whole_chars: bool):
    names = [c.split()[0] for c in ("id", "digest", "n_bytes", "spans", "kept")]
    valid = (lambda kept: kept.decode("utf-8", "ignore").encode("utf-8")) if whole_chars else (lambda kept: kept)
    types = [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary()]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = _chunk(batch, i)
                piece, doc, at, count = _unpacked(batch.column("blob")[i].as_py())
                least = np.full(int(piece.max()) + 1, NULL_ID, np.int64)
                np.minimum.at(least, piece, chunk.ids[doc])
                whole = np.flatnonzero(chunk.ids[doc] > least[piece])
                spans = [(doc[whole], at[whole], at[whole] + count[whole] + window - 1)]
                order = np.argsort(piece, kind="stable")
                for answer in batch.column("answers")[i].as_py() or []:
                    which, lo, hi = _unpacked(answer)
                    left, right = np.searchsorted(piece[order], which), np.searchsorted(piece[order], which, side="right")
                    many = right - left
                    inst = order[np.repeat(left - (np.cumsum(many) - many), many) + np.arange(many.sum())]
                    lo, hi = np.repeat(lo, many).astype(np.int64), np.repeat(hi, many).astype(np.int64)
                    spans.append((doc[inst], at[inst] + lo, at[inst] + hi + window - 1))
                doc, begin, end = merged(*(np.concatenate([s[k] for s in spans]) for k in range(3)))
                rows = []
                for d in np.unique(doc):
                    own = np.flatnonzero(doc == d) if len(doc) < 64 else np.arange(np.searchsorted(doc, d), np.searchsorted(doc, d, side="right"))
                    text = chunk.bytes[chunk.starts[d] : chunk.ends[d]]
                    stays = np.ones(len(text), bool)
                    for k in own:
                        stays[begin[k] : end[k]] = False
                    rows.append((int(chunk.ids[d]), chunk.digests[d], len(text), [{"begin": int(begin[k]), "end": int(end[k])} for k in own], valid(text[stays].tobytes())))
                for lo in range(0, len(rows), 2000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 2000]), types)], names=names)

    return run


def _celled(sent: DataFrame, groups: int, most_bytes: int | None = None) -> DataFrame:
    """``sent`` (bucket, chunk, ..) with ``range`` for bucket and ``cell``: a range is dealt to ``groups`` cells by chunk, to more where one would be too large."""
    group = F.pmod(F.xxhash64("chunk"), F.lit(groups))
    rows = sent.withColumnRenamed("bucket", "range").withColumn("group", group)
    if most_bytes is not None:
        parts = F.ceil(F.sum("size") / most_bytes).cast("int")
        large = rows.groupBy(F.col("range").alias("r"), F.col("group").alias("g")).agg(parts.alias("parts")).filter("parts > 1")
        rows = rows.join(large, (F.col("range") == F.col("r")) & (F.col("group") == F.col("g")), "left")
        rows = rows.withColumn("group", F.col("group") + F.lit(groups) * F.pmod(F.xxhash64("chunk", F.lit(3)), F.coalesce("parts", F.lit(1)))).drop("r", "g", "parts")
    # numbers of cells are below 2 ** 63: ranges are at most fan, groups at most buckets
    return rows.withColumn("cell", F.col("range").cast("long") * F.lit(1 << 40) + F.col("group")).drop("group")


def _answered(sent: DataFrame, window: int, most_bytes: int) -> DataFrame:
    """(chunk, answer) for the senders of pieces (bucket, chunk, size, blob); buckets that unpack to too much are dealt out by windows."""
    parts = F.ceil(F.col("bytes") * window / most_bytes).cast("int")  # every byte starts a window
    large = stored(sent.groupBy(F.col("bucket").alias("b")).agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > most_bytes).select("b", parts.alias("parts")), "large")
    groups = sent.select("bucket", F.lit(0).alias("part"), "chunk", "blob")
    if not large.isEmpty():
        same = F.col("bucket") == F.col("b")
        dealt = sent.join(large, same).drop("b").mapInArrow(freeing(_dealt_out(window)), "bucket int, part int, chunk long, blob binary")
        groups = groups.join(large, same, "left_anti").union(dealt)
    return groups.groupBy("bucket", "part").applyInPandas(_solved(window), "chunk long, answer binary")


def removals(docs: DataFrame, window: int = 50, chunk_bytes: int = 4 << 20, bucket_keys: int = 2_000_000, bucket_bytes: int = 4 << 20, most_bytes: int = 32 << 20, fan: int = 512, whole_chars: bool = False) -> DataFrame:
    """REMOVED: one row for each distinct (id, text digest) of ``docs`` (doc_id, text) that loses bytes.

    With ``whole_chars`` what a cut leaves of a character is not kept either.

    ``window`` is 32 to 56. ``bucket_keys`` anchors and the pieces of
    ``bucket_bytes`` of text meet in a bucket on average; one whose pieces
    unpack to more than ``most_bytes`` is dealt out by windows. ``fan``: buckets
    or ranges of them that a chunk sends to at most.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parallel = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = min(100_000, max(parallel, -(-total // (4 * chunk_bytes))))
    chunks = bucketed(packed_chunks(docs, chunk_bytes, files), files)
    index = chunks.select("chunk", F.posexplode(F.arrays_zip("ids", "sizes", "digests")).alias("place", "d")).select("chunk", "place", F.col("d.ids").alias("id"), F.col("d.sizes").alias("n_bytes"), F.col("d.digests").alias("digest"))
    firsts = index.groupBy("digest").agg(F.min(F.struct("id", "chunk", "place")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    firsts = stored(firsts, "firsts")  # a table of its own, so that a text with very many copies can be split in the join
    met = stored(index.join(firsts, "digest").filter((F.col("chunk") != F.col("first.chunk")) | (F.col("place") != F.col("first.place"))), "copies")
    skip = met.groupBy(F.col("chunk").alias("of")).agg(F.collect_list("place").alias("skip"))
    spans = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("end")))
    copies = met.filter((F.col("id") > F.col("first.id")) & (F.col("n_bytes") >= window)).groupBy("id", "digest").agg(F.first("n_bytes").alias("n_bytes")).select("id", "digest", "n_bytes", spans.alias("spans"), F.lit(b"").alias("kept"))

    key_buckets, buckets = max(1, -(-total // (14 * bucket_keys))), max(1, -(-total // bucket_bytes))
    key_bits = min(48, max(24, int(total).bit_length() + 6))  # about 1 anchor in 1000 meets a stranger, which costs a piece and no error
    width = -(-(1 << key_bits) // key_buckets)
    key_inner, inner = -(-key_buckets // fan), -(-buckets // fan)  # buckets of a range; 1: a chunk sends to the buckets themselves
    key_ranges = -(-key_buckets // key_inner)
    keys = chunks.mapInArrow(freeing(_key_rows(window, width * key_inner, key_ranges, key_bits)), "bucket int, chunk long, blob binary")
    solved = "chunk long, bucket int, n long, mask binary"
    if key_inner == 1:
        masks = keys.groupBy("bucket").applyInPandas(_shared_keys, solved)
    else:
        cells = stored(_celled(keys, key_inner), "key_cells", "uncompressed")
        merged = cells.groupBy("cell").applyInPandas(_merged_keys(width, key_inner), "bucket int, chunk long, blob binary")
        answers = merged.groupBy("bucket").applyInPandas(_shared_keys, solved)
        masks = cells.groupBy("cell").cogroup(answers.groupBy("chunk")).applyInPandas(_spread_masks, "chunk long, bucket int, mask binary")
    masks = masks.groupBy(F.col("chunk").alias("to")).agg(F.collect_list(F.struct("bucket", "mask")).alias("masks"))
    ready = chunks.join(masks.hint("shuffle_hash"), F.col("chunk") == F.col("to")).join(skip.hint("shuffle_hash"), F.col("chunk") == F.col("of"), "left")
    pieces = stored(ready.select("chunk", "ids", "sizes", "digests", "texts", "masks", "skip").mapInArrow(freeing(_piece_rows(window, buckets, inner, width * key_inner, key_ranges, key_bits)), "kind int, bucket int, chunk long, size long, blob binary"), "pieces", "uncompressed")

    sent = pieces.filter("kind = 0").drop("kind")
    if inner == 1:
        answers = _answered(sent, window, most_bytes)
    else:
        cells = stored(_celled(sent, inner, most_bytes), "piece_cells", "uncompressed")
        merged = stored(cells.groupBy("cell").applyInPandas(_merged_pieces(buckets, inner), "bucket int, chunk long, size long, blob binary"), "merged", "uncompressed")
        answers = _answered(merged, window, most_bytes)
        answers = cells.groupBy("cell").cogroup(answers.groupBy("chunk")).applyInPandas(_spread_answers(window), "chunk long, answer binary")
    answers = answers.groupBy(F.col("chunk").alias("to")).agg(F.collect_list("answer").alias("answers"))
    places = pieces.filter("kind = 1").select(F.col("chunk").alias("of"), "blob")
    ready = chunks.join(places.hint("shuffle_hash"), F.col("chunk") == F.col("of")).join(answers.hint("shuffle_hash"), F.col("chunk") == F.col("to"), "left")
    cut = ready.select("ids", "sizes", "digests", "texts", "blob", "answers").mapInArrow(freeing(_cut_rows(window, whole_chars)), REMOVED)
    return cut.union(copies)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.withColumn("__folio_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn("__folio_digest", F.unhex(F.sha2(text, 256)))


def digested(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``."""
    gone = removals(docs, **how).select("id", "digest", "n_bytes", F.size("spans").cast("long").alias("n_spans"), F.octet_length("kept").cast("long").alias("left"), F.sha2("kept", 256).alias("sha"))
    rows = _keyed(docs).select("doc_id", "__folio_id", "__folio_digest", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    out = rows.join(gone, (F.col("__folio_id") == F.col("id")) & (F.col("__folio_digest") == F.col("digest")), "left")
    none = F.lit(0).cast("long")
    return out.select(
        "doc_id", F.col("size").alias("n_bytes"), F.coalesce(F.col("size") - F.col("left"), none).alias("n_removed"),
        F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("sha", F.lower(F.hex("__folio_digest"))).alias("kept_sha256"),
    )


def cleaned(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with the repeated bytes cut out of the text, all rows and columns kept; n_chars follows where it exists.

    A character that a cut leaves incomplete goes as well.
    """

    gone = removals(docs, whole_chars=True, **how).select(F.col("id").alias("__folio_of"), F.col("digest").alias("__folio_with"), F.col("kept").cast("string").alias("__folio_kept"))
    out = _keyed(docs).join(gone, (F.col("__folio_id") == F.col("__folio_of")) & (F.col("__folio_digest") == F.col("__folio_with")), "left")
    out = out.withColumn("text", F.coalesce("__folio_kept", "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__folio_kept").isNull(), F.col("n_chars")).otherwise(F.char_length("__folio_kept")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[out[c] for c in docs.columns])
