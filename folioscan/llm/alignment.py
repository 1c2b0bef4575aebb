"""Cross-tokenizer alignment: two tokenizers' tokens of one text, cut into groups where both end.

A slab of an Arrow batch is laid out as one byte string with the documents'
offsets in it. ``bincount`` marks the bytes where A tokens end and where B
tokens end, once for the slab; a cut is where both do. Prefix sums of the three
marks, read at the documents' offsets, give every document's counts, and each
stretch between neighbouring ends belongs to one A and one B token: a link.

Corpus-wide counts: a slab sends each of its distinct (A id, B id) pairs once,
counts are summed by pair, the highest count of each B id is found (a B id has
as many partners as A has entries at most), and the slab's pairs look their
counts up. A slab's documents and its counts then meet, by slab. So what is
shuffled is distinct pairs, not links, and no table of pairs is held anywhere.

Texts are encoded by segments: a text falls apart at each single space between
a character that is no space and one that is no white space. Neither tokenizer
joins anything across such a place (A's pattern starts a piece with that space,
no piece of B holds a space behind another character, which is checked when it
is loaded), so equal segments are encoded once and kept for the next texts.

Defined results
    null or empty text, invalid UTF-8   no tokens, zeros, empty groups_sha256
    text that A or B does not give back (its bytes differ)   the same
    very long texts      a slab of their own; segments are encoded one by one
    null, repeated doc_id   each row counts for itself
    empty table          no rows
    columns with other names   ignored
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import freeing, stored

#: Vocabularies; both paths are parameters.
A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text laid out at once; a longer text is a slab of its own.
SLAB = 4 << 20
#: Segments and characters of them that an encoder keeps before it starts anew.
KEPT_SEGMENTS, KEPT_CHARS = 200_000, 8 << 20
_BETWEEN = re.compile(r"(?<=[^ ▁]) (?=\S)")


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others for U+0100 onwards."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Both tokenizers, and the ids of the segments that were seen."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        letter = byte_letters()
        self.a_bytes = [bytes(letter[c] for c in word) if all(c in letter for c in word) else word.encode() for word in map(self.a.id_to_token, range(self.a.get_vocab_size()))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.by_segments = not any("▁" in p[1:] and p.strip("▁") for p in pieces)
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.a_ids = self.b_ids = np.empty(0, np.int32)
        self.a_from, self.b_from = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.given_back = np.empty(0, bool)

    def segments(self, text: str) -> list[str]:
        return _BETWEEN.split(text) if self.by_segments else [text]

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The numbers of each text's segments; new segments are encoded."""
        if len(self.known) > KEPT_SEGMENTS or self.chars > KEPT_CHARS:
            self._forget()
        known = self.known
        was = len(known)
        out = [np.fromiter((known.setdefault(s, len(known)) for s in text), np.int64, len(text)) for text in texts]
        fresh = list(known)[was:] if was else list(known)
        for i in range(0, len(fresh), 4096):
            self._learn(fresh[i : i + 4096])
        return out

    def _learn(self, fresh: list[str]) -> None:
        a = [e.ids for e in self.a.encode_batch([" " + s for s in fresh], add_special_tokens=False)]
        b = self.b.encode(fresh, num_threads=1)
        self.chars += sum(map(len, fresh))
        for name, ids in (("a", a), ("b", b)):
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            starts, flat = getattr(self, f"{name}_from"), getattr(self, f"{name}_ids")
            setattr(self, f"{name}_from", np.concatenate([starts, starts[-1] + np.cumsum(sizes)]))
            setattr(self, f"{name}_ids", np.concatenate([flat, np.fromiter((x for i in ids for x in i), np.int32, int(sizes.sum()))]))
        same = [b"".join([self.a_bytes[x] for x in i]) == b"".join([self.b_bytes[x] for x in j]) == b" " + s.encode() for s, i, j in zip(fresh, a, b, strict=True)]
        self.given_back = np.concatenate([self.given_back, np.array(same, bool)])

    def tokens(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(ids[_ranges(starts[numbers], starts[numbers + 1])] for ids, starts in ((self.a_ids, self.a_from), (self.b_ids, self.b_from)))

    def whole(self, numbers: np.ndarray, text: str) -> bool:
        """Whether both give the text back; only where a segment alone is not given back the whole is put together."""
        if self.given_back[numbers].all():
            return True
        a, b = self.tokens(numbers)
        want = (" " + text).encode()
        return b"".join([self.a_bytes[x] for x in a]) == want == b"".join([self.b_bytes[x] for x in b])


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """starts[0]..ends[0]-1, starts[1]..ends[1]-1, ..."""
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


@lru_cache(maxsize=1)
def encoder(a_file: str, b_file: str) -> Encoder:
    return Encoder(a_file, b_file)


def laid_out(enc: Encoder, texts: list[str]) -> dict:
    """Counts, groups and links of texts that are laid out as one byte string."""
    cut_up = [enc.segments(t) if t else [] for t in texts]
    numbers = enc.numbers(cut_up)
    numbers = [n if len(n) and enc.whole(n, t) else n[:0] for n, t in zip(numbers, texts, strict=True)]
    offsets = np.cumsum([0, *(1 + len(t.encode()) if len(n) else 0 for n, t in zip(numbers, texts, strict=True))])
    every = np.concatenate([*numbers, np.empty(0, np.int64)])
    a, b = enc.tokens(every)
    a_end, b_end = np.cumsum(enc.a_size[a]), np.cumsum(enc.b_size[b])
    size = int(offsets[-1]) + 1
    in_a, in_b = (np.bincount(e, minlength=size).astype(bool) for e in (a_end, b_end))
    cut = in_a & in_b
    to_a, to_b, to_cut, to_any = (np.cumsum(m, dtype=np.int64) for m in (in_a, in_b, cut, in_a | in_b))
    of = lambda sums: np.diff(sums[offsets])
    at = np.flatnonzero(in_a | in_b)
    links = (a[to_a[at] - in_a[at]].astype(np.int64) << 32) | b[to_b[at] - in_b[at]]
    return {"n_a": of(to_a), "n_b": of(to_b), "n_groups": of(to_cut), "n_links": of(to_any), "links": links, "sha": _digests(a, b, a_end, b_end, cut, to_a, to_b, to_cut, offsets)}


def _digests(a, b, a_end, b_end, cut, to_a, to_b, to_cut, offsets) -> list[str]:
    """SHA-256 of every document's groups: ids and the sign behind each, put in order by group, A before B."""
    cuts = np.flatnonzero(cut)
    a_group, b_group = to_cut[a_end] - cut[a_end], to_cut[b_end] - cut[b_end]
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + np.concatenate([[0], to_b[cuts]])[a_group]] = np.arange(len(a))
    order[np.arange(len(b)) + to_a[cuts][b_group]] = len(a) + np.arange(len(b))
    last = np.isin(b_end, offsets)
    sign = np.concatenate([np.where(cut[a_end], 1, 0), np.where(last, 3, np.where(cut[b_end], 2, 0))])[order]
    ids = pa.array(np.concatenate([a, b]).astype(np.int32)[order]).cast(pa.string())
    text = pc.binary_join_element_wise(ids, pa.array([",", "|", ";", ""]).take(pa.array(sign)), "")
    where = np.frombuffer(text.buffers()[1], np.int32)[: len(order) + 1] if len(order) else np.zeros(1, np.int32)
    body = memoryview(text.buffers()[2]) if len(order) else b""
    bounds = where[to_a[offsets] + to_b[offsets]]
    return ["" if b == e else hashlib.sha256(body[b:e]).hexdigest() for b, e in zip(bounds[:-1], bounds[1:], strict=True)]


def _slabs(batches):
    """Rows (doc_id, text) in lists of at most SLAB bytes of text."""
    held, size = [], 0
    for batch in batches:
        for doc, raw in zip(batch.column(0), batch.column(1), strict=True):
            raw = raw.as_py() or b""
            if held and size + len(raw) > SLAB:
                yield held
                held, size = [], 0
            try:
                held.append((doc.as_py(), raw.decode()))
            except UnicodeDecodeError:
                held.append((doc.as_py(), ""))
            size += len(raw) + 64
    if held:
        yield held


_ROW = "slab long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pairs array<long>, counts array<long>"
_FIELDS = pa.schema([("slab", pa.int64()), ("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


def alignments(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """Rows of two kinds for each slab: its documents, ``links`` as 32-bit places in the slab's pairs, and one row with its distinct ``pairs`` (A id << 32 | B id) and their counts."""

    @freeing
    def run(batches):
        enc = encoder(a_file, b_file)
        slab = TaskContext.get().partitionId() << 32
        for rows in _slabs(batches):
            found = laid_out(enc, [t for _, t in rows])
            pairs, place, counts = np.unique(found["links"], return_inverse=True, return_counts=True)
            ends = np.cumsum([0, *found["n_links"]])
            place = place.astype(np.int32)
            n = len(rows)
            told = [pa.array([*[x.tolist() for x in (found[k],)][0], None], pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")]
            links = [place[b:e].tobytes() for b, e in zip(ends[:-1], ends[1:], strict=True)]
            empty = pa.array([None] * n, pa.list_(pa.int64()))
            lists = [pa.concat_arrays([empty, pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(x.astype(np.int64)))]) for x in (pairs, counts)]
            yield pa.RecordBatch.from_arrays([pa.array([slab] * (n + 1), pa.int64()), pa.array([*(d for d, _ in rows), None], pa.int64()), *told, pa.array([*found["sha"], None], pa.string()), pa.array([*links, None], pa.binary()), *lists], schema=_FIELDS)
            slab += 1

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, _ROW)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, a, b, count, best) over the whole corpus: best where no other pair of the B id has a higher count."""
    each = found.filter("pairs is not null").select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("count"))
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    return each.select("pair", F.shiftright("pair", 32).alias("a"), b.alias("b"), "count").withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def aligned(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """A row for each document: token, group and link counts, the links whose pair is the best of its B id, the sum of their counts, the digest of its groups."""
    found = stored(alignments(docs, a_file, b_file), "aligned")
    counts = pair_counts(found).select("pair", "count", "best")
    sent = found.filter("pairs is not null").select(F.col("slab").alias("of_slab"), F.posexplode("pairs").alias("place", "pair"))
    looked_up = sent.join(counts, "pair").select("of_slab", "place", "count", "best")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def summed(rows: pa.Table, of_slab: pa.Table) -> pa.Table:
        n = of_slab.num_rows
        count, best = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        place = of_slab.column("place").to_numpy()
        count[place], best[place] = of_slab.column("count").to_numpy(), of_slab.column("best").to_numpy().astype(np.int64)
        links = [np.frombuffer(x.as_py(), np.int32) for x in rows.column("links")]
        told = {"n_best": [int(best[x].sum()) for x in links], "count_sum": [int(count[x].sum()) for x in links]}
        return pa.table({k: told[k] if k in told else rows.column(k) for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")})

    texts = found.filter("links is not null").drop("pairs", "counts")
    return texts.groupBy("slab").cogroup(looked_up.groupBy("of_slab")).applyInArrow(summed, schema)
