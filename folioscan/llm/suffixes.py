"""Two-stage suffix sorting and adjacent common prefixes, in numpy.

Stage one sorts only the suffixes that are smaller than their successor
(type S), by their first ``DEPTH`` bytes. Stage two scans the buckets of first
bytes in rising order: the suffixes that are larger than their successor
(type L) follow from what stands before them, so their order is induced and
never compared. The result is sorted by the first ``DEPTH`` bytes at least.
"""

from __future__ import annotations

import numpy as np

from .hashing import words_at

DEPTH = 56


def big_words(text: np.ndarray) -> np.ndarray:
    """The big-endian 64-bit word that starts at each byte; DEPTH zero bytes follow the end."""
    return words_at(np.concatenate((text, np.zeros(DEPTH, np.uint8)))).byteswap()


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """For each suffix whether it is smaller than the next one; a run of one byte takes the type of its end."""
    n = len(text)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    change = np.where(text[:-1] != text[1:], np.arange(n - 1), n)
    at = np.minimum.accumulate(change[::-1])[::-1]
    inner = at < n
    out[:-1][inner] = text[at[inner]] < text[at[inner] + 1]
    return out


def sort_directly(places: np.ndarray, words: np.ndarray) -> np.ndarray:
    """``places`` in order of the DEPTH bytes that start there; only those still tied are looked at again."""
    key = words[places]
    order = np.argsort(key, kind="stable")
    out, key = places[order], key[order]
    tied = np.concatenate(([False], key[1:] == key[:-1]))
    for step in range(8, DEPTH, 8):
        member = tied.copy()
        member[:-1] |= tied[1:]
        at = np.flatnonzero(member)
        if not len(at):
            break
        group = np.cumsum(~tied[at])
        key = words[out[at] + step]
        order = np.lexsort((key, group))
        out[at] = out[at][order]
        key = key[order]
        tied[at] = np.concatenate(([False], (key[1:] == key[:-1]) & (group[1:] == group[:-1])))
    return out


def suffix_array(text: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """The starts of all suffixes of ``text`` (uint8), sorted by their first DEPTH bytes at least."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    words = big_words(text) if words is None else words
    direct = sort_directly(np.flatnonzero(smaller_than_next(text)), words)
    edges = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[int(text[n - 1])].append(np.array([n - 1]))  # what stands before the empty suffix
    out = []
    for byte in range(256):
        last = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        waiting[byte] = []
        large = [last]
        while len(last):  # runs of this byte follow inside the bucket
            before = last[last > 0] - 1
            last = before[text[before] == byte]
            large.append(last)
        bucket = np.concatenate([*large, direct[edges[byte] : edges[byte + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        first = text[before]
        before, first = before[first > byte], first[first > byte]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        starts = np.flatnonzero(np.concatenate((first[:1] == first[:1], first[1:] != first[:-1])))
        for lo, hi in zip(starts, [*starts[1:], len(first)]):
            waiting[int(first[lo])].append(before[lo:hi])
    return np.concatenate(out)


def common_prefixes(places: np.ndarray, words: np.ndarray, limit: int) -> np.ndarray:
    """For each place but the first the length of the common prefix with the place before it, ``limit`` (8 to DEPTH) at most."""
    out = np.full(max(0, len(places) - 1), limit, np.int64)
    same = np.arange(len(out))
    for step in [*range(0, limit - 7, 8), *([limit - 8] if limit % 8 else [])]:
        apart = words[places[same] + step] ^ words[places[same + 1] + step]
        off = apart != 0
        bits = apart[off]
        at = np.full(len(bits), 7)
        for byte in range(7, -1, -1):
            at[(bits >> np.uint64(56 - 8 * byte)) != 0] = byte
        out[same[off]] = step + at
        same = same[~off]
    return out
