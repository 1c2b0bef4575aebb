"""License scan: phrases that stand word by word, and an exact set-similarity join with license templates.

The join finds every pair of a text block and a template whose containment
|block & template| / |template| of distinct words reaches the threshold:

* words are ordered by the number of documents that hold them, rarest first
  (one counting pass over all documents; only words of templates are counted);
* prefix filter: a block that reaches the threshold holds one of the first
  |t| - ceil(threshold * |t|) + 1 words of the template, so only these are looked up;
* length filter: a block has at least ceil(threshold * |t|) distinct words;
* positional filter: when the k-th word of the template is its first one in
  the block, at most |t| - k + 1 can follow.

The templates are a fixed list of bounded size, so the lookup table goes to
every task and no text is shuffled.

Blocks of a document, for each template, are windows over all of its words,
whatever its lines: ``step`` words are the least power of two from 8 on that
is 1.25 times the words of the template or more; windows are two steps long
and start every step, so a passage of up to ``step`` words is whole in one of
them and no block is much longer than the template. Every block that reaches
the threshold is returned.

A set of words says nothing about their order, so each block has its ``order``:
the share of the template's neighbouring word pairs that are neighbours in the
block too. Blocks are ``firm`` with an order of ``pairs`` or more; templates of
fewer than ``short`` distinct words need all of their words and pairs for that.
``best`` marks firm blocks that no rival (a template of another label that
shares at least half of the words of both, such as another version of the
license) matches better in the same block or one that overlaps it, and only
these give labels; the score comes from firm blocks.

Words: A-Z lower-cased, runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.

Defined results
    null or empty text   no words, no labels, score 0
    very long texts      all windows of the whole text
    equal rivals         both are best: a tie gives both labels
    null doc_id          kept
    repeated rows        each row is scanned
    empty table          an empty result
    extra columns        ignored
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Phrases that give a label wherever their words stand consecutively.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Notices of public licenses, label and text.
TEMPLATES = (
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3", "under the terms of the GNU Affero General Public License version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("mit", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("isc", "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("bsd", "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-2", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
)

# Identifiers and links of public licenses, label and text.
IDENTIFIERS = (
    ("apache-2", "SPDX-License-Identifier: Apache-2.0"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("gpl-2", "SPDX-License-Identifier: GPL-2.0"),
    ("gpl-3", "SPDX-License-Identifier: GPL-3.0"),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1"),
    ("lgpl", "SPDX-License-Identifier: LGPL-3.0"),
    ("agpl-3", "SPDX-License-Identifier: AGPL-3.0"),
    ("bsd", "SPDX-License-Identifier: BSD-2-Clause"),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("mpl-2", "SPDX-License-Identifier: MPL-2.0"),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("unlicense", "SPDX-License-Identifier: Unlicense"),
    ("cc0", "SPDX-License-Identifier: CC0-1.0"),
    ("cc-by", "SPDX-License-Identifier: CC-BY-4.0"),
    ("cc-by-sa", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    ("cc-by-nc", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("cc-by", "creativecommons.org/licenses/by/4.0"),
    ("cc-by-sa", "creativecommons.org/licenses/by-sa/4.0"),
    ("cc-by-nc", "creativecommons.org/licenses/by-nc/4.0"),
    ("cc0", "creativecommons.org/publicdomain/zero/1.0"),
)

SCAN = "doc_id long, n_words long, places array<struct<label: string, word: long>>, blocks array<struct<label: string, first_word: long, words: long, containment: double, order: double, firm: boolean, best: boolean>>"

#: Templates with fewer distinct words are firm with all words and pairs only; the share of neighbouring pairs that the others need.
SHORT, PAIRS = 10, 0.5


def words_of(text: bytes | None) -> list[bytes]:
    return _WORD.findall((text or b"").lower())


def step_of(words: int) -> int:
    """Half the length of the windows for a template of so many words."""
    return max(8, 1 << math.ceil(math.log2(1.25 * max(1, words))))


def window_starts(places, step: int, n: int) -> list[int]:
    """The starts of the windows of a text of ``n`` words that hold one of the places."""
    last = max(0, -(-n // step) - 2)
    return [k * step for k in sorted({k for p in places for k in (p // step - 1, p // step) if 0 <= k <= last})]


def _neighbours(words) -> set:
    return set(zip(words, words[1:]))


@dataclass
class Templates:
    """Templates as word tuples in the global order, with the lookup of their prefixes."""

    labels: list[str]
    words: list[tuple]
    least: list[int]  # words that a block needs
    firm: list[int]  # words that a firm block needs
    steps: list[int]
    near: list[set]  # neighbouring words
    least_near: list[int]
    prefix: dict = field(default_factory=dict)  # word -> [(template, place of the word)]
    rivals: list = field(default_factory=list)  # of each template: those of other labels that share at least half of the words of both

    @classmethod
    def of(cls, templates, threshold: float, frequency: dict, short: int = SHORT, pairs: float = PAIRS) -> "Templates":
        said = [words_of(t.encode("utf-8")) for _, t in templates]
        sets = [tuple(sorted(set(w), key=lambda w: (frequency.get(w, 0), w))) for w in said]
        least = [math.ceil(threshold * len(s) - 1e-9) for s in sets]
        firm = [len(s) if len(s) < short else n for s, n in zip(sets, least)]
        near = [_neighbours(w) for w in said]
        out = cls([label for label, _ in templates], sets, least, firm, [step_of(len(w)) for w in said], near, [len(n) if len(s) < short else math.ceil(pairs * len(n) - 1e-9) for s, n in zip(sets, near)])
        for number, (words, need) in enumerate(zip(sets, least)):
            for place, word in enumerate(words[: len(words) - need + 1]):
                out.prefix.setdefault(word, []).append((number, place))
        alike = lambda a, b: 2 * len(set(a) & set(b)) >= len(set(a) | set(b))
        out.rivals = [[m for m, other in enumerate(sets) if out.labels[m] != out.labels[n] and alike(words, other)] for n, words in enumerate(sets)]
        return out

    def held(self, number: int, own: set, near: set) -> tuple[int, int, bool]:
        """Words and neighbouring pairs of a template that a block holds, and whether they make it firm."""
        n, pairs = sum(w in own for w in self.words[number]), len(self.near[number] & near)
        return n, pairs, n >= self.firm[number] and pairs >= self.least_near[number]

    def matches(self, words: list[bytes], start: int, step: int) -> list[tuple[int, float, float, bool, bool]]:
        """(template, containment, order, firm, best) of each template with this step that the block from ``start`` on holds."""
        block = words[start : start + 2 * step]
        own = set(block)
        first: dict[int, int] = {}
        for word in own & self.prefix.keys():
            for number, place in self.prefix[word]:
                if self.steps[number] == step and place < first.get(number, 1 << 30):
                    first[number] = place
        found, around = [], None
        for number, place in sorted(first.items()):
            target, need = self.words[number], self.least[number]
            if len(own) < need or len(target) - place < need or sum(w in own for w in target[place:]) < need:
                continue
            shared, pairs, firm = self.held(number, own, _neighbours(block))
            if shared < need:
                continue
            rank, best = (shared / len(target), shared), firm
            if firm and self.rivals[number]:
                if around is None:  # a block that holds the end of a notice overlaps one that holds all of it
                    last = max(0, -(-len(words) // step) - 2) * step
                    parts = [words[s : s + 2 * step] for s in (start - step, start, start + step) if 0 <= s <= last]
                    around = [(set(part), _neighbours(part)) for part in parts]
                others = [(r, self.held(r, *part)) for r in self.rivals[number] for part in around]
                best = not any(sure and (n / len(self.words[r]), n) > rank for r, (n, _, sure) in others)
            found.append((number, rank[0], pairs / len(self.near[number]) if self.near[number] else 1.0, firm, best))
        return found

    def found(self, words: list[bytes]) -> list[tuple[int, int, int, float, float, bool, bool]]:
        """(template, first word, words, containment, order, firm, best) of each block of a text that holds a template."""
        if self.prefix.keys().isdisjoint(words):
            return []
        places: dict[int, list[int]] = {}
        for at, word in enumerate(words):
            for number, _ in self.prefix.get(word, ()):
                places.setdefault(self.steps[number], []).append(at)
        out = []
        for step, at in sorted(places.items()):
            for start in window_starts(at, step, len(words)):
                out += [(n, start, min(2 * step, len(words) - start), *found) for n, *found in self.matches(words, start, step)]
        return out


def phrase_places(words: list[bytes], phrases: dict) -> list[tuple[str, int]]:
    """(label, first word) of each place where the words of a phrase stand consecutively."""
    own, out = set(words), []
    for phrase, label in phrases.items():
        target = phrase.encode("utf-8").split()
        if not own.issuperset(target):
            continue
        at = -1
        while True:
            try:
                at = words.index(target[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(target)] == target:
                out.append((label, at))
    return out


def document_frequency(docs: DataFrame, templates) -> dict[bytes, int]:
    """For each word of the templates the number of documents that hold it; added up in each task first."""
    vocabulary = {w for _, t in templates for w in words_of(t.encode("utf-8"))}

    def count(batches):
        own: dict[bytes, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for word in vocabulary.intersection(words_of(text)):
                    own[word] = own.get(word, 0) + 1
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(freeing(count), "word binary, n long")
    return {bytes(r[0]): r[1] for r in rows.groupBy("word").agg(F.sum("n")).collect()}  # at most the words of the templates


def scan(docs: DataFrame, phrases: dict = PHRASES, templates=TEMPLATES + IDENTIFIERS, threshold: float = 0.8) -> DataFrame:
    """SCAN for every row of ``docs`` (doc_id, text): phrase places and blocks that hold a template."""
    index = Templates.of(templates, threshold, document_frequency(docs, templates))
    place_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    block_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("containment", pa.float64()), ("order", pa.float64()), ("firm", pa.bool_()), ("best", pa.bool_())]))

    def run(batches):
        for batch in batches:
            counts, places, blocks = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                counts.append(len(words))
                places.append([{"label": label, "word": at} for label, at in phrase_places(words, phrases)])
                blocks.append([{"label": index.labels[n], "first_word": at, "words": size, "containment": c, "order": o, "firm": f, "best": b} for n, at, size, c, o, f, b in index.found(words)])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(places, place_type), pa.array(blocks, block_type)], names=["doc_id", "n_words", "places", "blocks"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(freeing(run), SCAN)


def labelled(docs: DataFrame, **how) -> DataFrame:
    """The digest of a scan: counts and first and last place of the phrases, labels, the best containment as score."""
    base = F.array_sort(F.array_distinct("places.label"))
    every = F.array_sort(F.array_distinct(F.concat("places.label", F.expr("filter(blocks, b -> b.best).label"))))
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.expr("filter(blocks, b -> b.firm).containment")), F.lit(0.0)))
    return scan(docs, **how).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        F.concat_ws(",", base).alias("base_labels"), F.concat_ws(",", every).alias("labels"), score.alias("score"),
    )
