"""HTML main-text extraction with a recurrent block labeller.

A page becomes a sequence of leaf blocks. Each block is a vector: the mean of
its hashed tag-path tokens beside the mean of its hashed words. A bidirectional
LSTM in numpy reads the sequence and labels every block as main text or not, so
each decision sees the whole page. The labeller is trained on the driver on
``PAGES`` made-up pages (a documented bound) and has a fixed size; the trained
arrays are kept in the shared folder under a key of their settings, so that a
later session reads them.

The blocks with label main, in page order, joined by one newline, are the text.

Defined results
    null or empty html   no blocks, text empty
    very long pages      all blocks, read in time proportional to the page
    malformed html       read leniently, nothing fails
    a tie (0.5)          main text
    repeated rows        each row is extracted
    null ids, urls       kept
    empty table          an empty result
    extra columns        ignored
"""

from __future__ import annotations

import inspect
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_blocks, html_pages
from .common import freeing, shared_dir

#: Made-up pages that the labeller is trained on, and passes over them.
PAGES, EPOCHS = 2400, 7
PATH_SLOTS, WORD_SLOTS, WIDTH, HIDDEN = 1 << 14, 1 << 13, 16, 20

TEXTS = "page_id long, url string, text string, n_blocks int, n_main int"


@lru_cache(maxsize=1 << 16)
def _slot(token: str, slots: int) -> int:
    return crc32(token.encode("utf-8", "replace")) % slots


@lru_cache(maxsize=1 << 12)
def _path_slots(path: tuple) -> tuple:
    """Every element and name on a tag path, the last two once more with their place; neighbours on a page share their paths."""
    out = []
    for depth, tokens in enumerate(path):
        out += tokens
        if depth >= len(path) - 2:
            out += [f"{len(path) - depth}{t}" for t in tokens]
    return tuple(_slot(t, PATH_SLOTS) for t in out)


def block_ids(block: html_blocks.Block) -> tuple[list[int], list[int]]:
    """Slots of the tag path with the size and the share of links in steps, and of the words."""
    size = len(block.text)
    marks = (f"size{min(9, size.bit_length())}", f"link{4 * min(size, block.linked) // max(1, size)}", f"end{block.text[-1] in '.!?'}")
    return [*_path_slots(block.path), *[_slot(t, PATH_SLOTS) for t in marks]], [_slot(w, WORD_SLOTS) for w in block.text.lower().split()]


def _means(table: np.ndarray, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = np.fromiter((i for part in ids for i in part), np.int64)
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(ids), table.shape[1]), np.float32)
    step = 1 << 15
    for lo in range(0, len(ids), step):  # bounded slices of the gathered rows
        hi = min(len(ids), lo + step)
        first, last = starts[lo], starts[hi - 1] + sizes[hi - 1]
        out[lo:hi] = np.add.reduceat(table[flat[first:last]], starts[lo:hi] - first, axis=0)
    return out / sizes[:, None], flat, sizes


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embeddings, one LSTM for each direction and a logistic output; ``p`` holds the arrays by name."""

    def __init__(self, seed: int = 1):
        r, d, h = np.random.default_rng(seed), 2 * WIDTH, HIDDEN
        self.p = {"path": r.normal(0, 0.1, (PATH_SLOTS, WIDTH)), "word": r.normal(0, 0.02, (WORD_SLOTS, WIDTH)), "out": r.normal(0, 0.2, 2 * h), "bias": np.zeros(1)}
        for side in "fb":
            self.p |= {f"x{side}": r.normal(0, 1 / np.sqrt(d), (d, 4 * h)), f"h{side}": r.normal(0, 1 / np.sqrt(h), (h, 4 * h)), f"c{side}": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    @staticmethod
    def _places(lengths: np.ndarray, back: bool) -> np.ndarray:
        """For each page and step the number of its block in the flat list, -1 after the end."""
        steps, starts = np.arange(lengths.max()), np.cumsum(lengths) - lengths
        inside = steps[None, :] < lengths[:, None]
        at = lengths[:, None] - 1 - steps[None, :] if back else np.broadcast_to(steps[None, :], inside.shape)
        return np.where(inside, starts[:, None] + at, -1)

    def _run(self, x: np.ndarray, lengths: np.ndarray, side: str, keep: bool):
        h_size = HIDDEN
        places = self._places(lengths, side == "b")
        drive = x @ self.p[f"x{side}"] + self.p[f"c{side}"]
        h, c = np.zeros((len(lengths), h_size), np.float32), np.zeros((len(lengths), h_size), np.float32)
        out, trail = np.zeros((len(x), h_size), np.float32), []
        for t in range(places.shape[1]):
            live = np.flatnonzero(places[:, t] >= 0)
            at = places[live, t]
            gates = drive[at] + h[live] @ self.p[f"h{side}"]
            s = _sigmoid(gates[:, : 3 * h_size])
            i, f, o = s[:, :h_size], s[:, h_size : 2 * h_size], s[:, 2 * h_size :]
            g = np.tanh(gates[:, 3 * h_size :])
            before_c, before_h = c[live], h[live]
            now = f * before_c + i * g
            top = np.tanh(now)
            c[live], h[live] = now, o * top
            out[at] = h[live]
            if keep:
                trail.append((live, at, i, f, o, g, before_c, before_h, top))
        return out, trail

    def inputs(self, ids: list[tuple]):
        path, path_flat, path_sizes = _means(self.p["path"], [i[0] for i in ids])
        word, word_flat, word_sizes = _means(self.p["word"], [i[1] for i in ids])
        return np.concatenate((path, word), axis=1), (path_flat, path_sizes, word_flat, word_sizes)

    def chances(self, ids: list[tuple], lengths: np.ndarray) -> np.ndarray:
        """For each block, pages of ``lengths`` blocks one after the other, the chance that it is main text."""
        x, _ = self.inputs(ids)
        states = [self._run(x, lengths, side, False)[0] for side in "fb"]
        return _sigmoid(np.concatenate(states, axis=1) @ self.p["out"] + self.p["bias"][0])

    def gradients(self, ids: list[tuple], lengths: np.ndarray, truth: np.ndarray) -> tuple[float, dict]:
        x, (path_flat, path_sizes, word_flat, word_sizes) = self.inputs(ids)
        runs = [self._run(x, lengths, side, True) for side in "fb"]
        states = np.concatenate([r[0] for r in runs], axis=1)
        chance = _sigmoid(states @ self.p["out"] + self.p["bias"][0])
        error = ((chance - truth) / len(truth)).astype(np.float32)
        grads = {"out": states.T @ error, "bias": np.array([error.sum()], np.float32)}
        d_states, d_x, n = np.outer(error, self.p["out"]).astype(np.float32), np.zeros_like(x), HIDDEN
        for number, side in enumerate("fb"):
            d_out = d_states[:, number * n : (number + 1) * n]
            d_h, d_c = np.zeros((len(lengths), n), np.float32), np.zeros((len(lengths), n), np.float32)
            d_gates_all, g_h = np.zeros((len(x), 4 * n), np.float32), np.zeros_like(self.p[f"h{side}"])
            for live, at, i, f, o, g, before_c, before_h, top in reversed(runs[number][1]):
                dh = d_h[live] + d_out[at]
                dc = d_c[live] + dh * o * (1 - top * top)
                d_gates = np.concatenate((dc * g * i * (1 - i), dc * before_c * f * (1 - f), dh * top * o * (1 - o), dc * i * (1 - g * g)), axis=1)
                d_gates_all[at] = d_gates
                g_h += before_h.T @ d_gates
                d_c[live] = dc * f
                d_h[live] = d_gates @ self.p[f"h{side}"].T
            grads |= {f"x{side}": x.T @ d_gates_all, f"h{side}": g_h, f"c{side}": d_gates_all.sum(axis=0)}
            d_x += d_gates_all @ self.p[f"x{side}"].T
        for name, part, flat, sizes in (("path", d_x[:, :WIDTH], path_flat, path_sizes), ("word", d_x[:, WIDTH:], word_flat, word_sizes)):
            table = np.zeros_like(self.p[name])
            np.add.at(table, flat, np.repeat(part / sizes[:, None], sizes, axis=0))
            grads[name] = table
        loss = -np.mean(np.log(np.maximum(1e-9, np.where(truth > 0.5, chance, 1 - chance))))
        return float(loss), grads

    def train(self, pages: list[tuple], epochs: int = EPOCHS, batch: int = 24, rate: float = 0.01, unknown: float = 0.3, strange: float = 0.2, seed: int = 2) -> "Labeller":
        """Adam on pages (ids of the blocks, truth)."""
        r, step = np.random.default_rng(seed), 0
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        for _ in range(epochs):
            order = r.permutation(len(pages))
            for lo in range(0, len(order), batch):
                chosen = [pages[i] for i in order[lo : lo + batch]]
                # some blocks show unknown words or another name on their path, so that no single one decides
                shown = [(path + r.integers(0, PATH_SLOTS, 2).tolist() if r.random() < strange else path, r.integers(0, WORD_SLOTS, 2).tolist() if r.random() < unknown else words) for ids, _ in chosen for path, words in ids]
                _, grads = self.gradients(shown, np.array([len(ids) for ids, _ in chosen]), np.concatenate([t for _, t in chosen]))
                step += 1
                size = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in grads.items():
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.001 * (g * g - square[k])
                    self.p[k] -= (size * mean[k] / (np.sqrt(square[k]) + 1e-7)).astype(np.float32)
        return self


def training_pages(count: int, seed: int = 8) -> list[tuple]:
    out = []
    for page in html_pages.pages(count, seed):
        found = html_blocks.blocks(page)
        if found:
            out.append(([block_ids(b) for b in found], np.array([b.marked for b in found], np.float32)))
    return out


@lru_cache(maxsize=2)
def trained(count: int = PAGES) -> Labeller:
    return Labeller().train(training_pages(count))


def kept(spark: SparkSession, count: int = PAGES) -> Labeller:
    """The labeller of the shared folder; trained and put there if it is not. The key follows the code that it comes from."""
    code = "".join(inspect.getsource(part) for part in (html_blocks, html_pages, Labeller, _path_slots, block_ids, training_pages))
    path = f"{shared_dir(spark)}/labeller-{count}-{PATH_SLOTS}-{WORD_SLOTS}-{WIDTH}-{HIDDEN}-{crc32(code.encode('utf-8')):08x}"
    model = Labeller.__new__(Labeller)
    try:
        rows = spark.read.schema("name string, shape array<int>, data binary").parquet(path).collect()
    except AnalysisException:
        rows = []
    if len(rows) == len(Labeller().p):
        model.p = {r.name: np.frombuffer(r.data, np.float32).reshape(r.shape) for r in rows}
        return model
    model = trained(count)
    frame = spark.createDataFrame([(k, list(v.shape), v.astype(np.float32).tobytes()) for k, v in model.p.items()], "name string, shape array<int>, data binary")
    frame.coalesce(1).write.mode("overwrite").parquet(path)  # a writer beside this one writes the same
    return model


def main_texts(pages: list[str | None], labeller: Labeller) -> list[tuple[str, int, int]]:
    """(text, blocks, main blocks) of each page; pages are labelled in groups of like length."""
    found = [html_blocks.blocks(html or "") for html in pages]
    out: list = [("", 0, 0)] * len(pages)
    order = sorted((i for i in range(len(pages)) if found[i]), key=lambda i: len(found[i]))
    lo = 0
    while lo < len(order):
        hi, total = lo, 0
        while hi < len(order) and hi - lo < 128 and (hi == lo or total + len(found[order[hi]]) <= 20000):
            total += len(found[order[hi]])
            hi += 1
        group = order[lo:hi]
        chances = labeller.chances([block_ids(b) for i in group for b in found[i]], np.array([len(found[i]) for i in group]))
        at = 0
        for i in group:
            own = chances[at : at + len(found[i])] >= 0.5
            at += len(found[i])
            out[i] = ("\n".join(b.text for b, ok in zip(found[i], own) if ok), len(found[i]), int(own.sum()))
        lo = hi
    return out


def extract(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """TEXTS for every row of ``pages`` (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast((labeller or kept(pages.sparkSession)).p)

    def run(batches):
        model = Labeller.__new__(Labeller)
        model.p = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = main_texts(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), *[pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32()))]], names=["page_id", "url", "text", "n_blocks", "n_main"])

    return pages.select("page_id", "url", "html").mapInArrow(freeing(run), TEXTS)


def page_texts(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
