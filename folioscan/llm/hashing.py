"""XXH64 of many byte spans at once, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Longer spans go through the library one by one.
_LONG = 512


def _rotl(x, r: int):
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * _P2, 31) * _P1


def words_at(buffer: np.ndarray) -> np.ndarray:
    """The little-endian 64-bit word that starts at each byte; eight zero bytes follow the end."""
    padded = np.zeros(len(buffer) + 8, np.uint8)
    padded[: len(buffer)] = buffer
    return np.ndarray((len(buffer) + 1,), "<u8", padded.data, strides=(1,)).copy()


def xxh64_spans(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of buffer[starts[i]:ends[i]] for each i, as uint64."""
    word = words_at(buffer)
    at, size = starts.astype(np.int64), (ends - starts).astype(np.int64)
    s = np.uint64(seed)
    out = np.full(len(at), s + _P5, np.uint64)
    with np.errstate(over="ignore"):
        wide = np.flatnonzero((size >= 32) & (size <= _LONG))
        if len(wide):
            lanes = [np.full(len(wide), v, np.uint64) for v in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            left, where, live = size[wide].copy(), at[wide].copy(), np.arange(len(wide))
            while len(live):
                for k in range(4):
                    lanes[k][live] = _round(lanes[k][live], word[where[live] + 8 * k])
                where[live] += 32
                left[live] -= 32
                live = live[left[live] >= 32]
            h = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
            for lane in lanes:
                h = (h ^ _round(np.uint64(0), lane)) * _P1 + _P4
            out[wide] = h
        out += size.astype(np.uint64)
        where = at + (size & ~np.int64(31)) * (size >= 32)
        left = size - (size & ~np.int64(31)) * (size >= 32)
        for _ in range(3):
            i = np.flatnonzero(left >= 8)
            if not len(i):
                break
            out[i] = _rotl(out[i] ^ _round(np.uint64(0), word[where[i]]), 27) * _P1 + _P4
            where[i] += 8
            left[i] -= 8
        i = np.flatnonzero(left >= 4)
        if len(i):
            out[i] = _rotl(out[i] ^ ((word[where[i]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
            where[i] += 4
            left[i] -= 4
        for _ in range(3):
            i = np.flatnonzero(left >= 1)
            if not len(i):
                break
            out[i] = _rotl(out[i] ^ ((word[where[i]] & np.uint64(0xFF)) * _P5), 11) * _P1
            where[i] += 1
            left[i] -= 1
        out ^= out >> np.uint64(33)
        out *= _P2
        out ^= out >> np.uint64(29)
        out *= _P3
        out ^= out >> np.uint64(32)
    for i in np.flatnonzero(size > _LONG):
        out[i] = xxhash.xxh64_intdigest(buffer[at[i] : at[i] + size[i]].tobytes(), seed)
    return out


def mixed(h: np.ndarray, n: int) -> np.ndarray:
    """The n-th independent rehash of 64-bit hashes; the 0th is the hash itself."""
    if n == 0:
        return h
    with np.errstate(over="ignore"):
        x = h + np.uint64((n * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
