"""Compound files, the container of older office documents and mails: streams by path, from sectors and their chains."""

from __future__ import annotations

import struct

MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
_END = 0xFFFFFFFA  # this and larger numbers are no sectors


class CompoundError(ValueError):
    pass


class Compound:
    """``streams`` maps lower-case paths (names joined by /) to bytes. Chains that loop or leave the file are an error."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or len(data) < 512:
            raise CompoundError("not a compound file")
        self.data = data
        self.sector = 1 << struct.unpack_from("<H", data, 30)[0]
        self.mini = 1 << struct.unpack_from("<H", data, 32)[0]
        if not 64 <= self.sector <= 1 << 16 or not 16 <= self.mini <= self.sector:
            raise CompoundError("odd sector size")
        tables, first_dir, self.cutoff, first_mini, first_more = (struct.unpack_from("<I", data, at)[0] for at in (44, 48, 56, 60, 68))
        places = list(struct.unpack_from("<109I", data, 76))
        more = first_more
        while more < _END and len(places) < tables:
            entry = self._numbers(self._at(more))
            places += entry[:-1]
            more = entry[-1]
        self.next = [n for p in places[:tables] if p < _END for n in self._numbers(self._at(p))]
        self.next_mini = self._numbers(self._chain(first_mini)) if first_mini < _END else []
        entries = self._chain(first_dir)
        self.entries = [entries[i : i + 128] for i in range(0, len(entries) - 127, 128)]
        if not self.entries:
            raise CompoundError("no directory")
        self.small = b""
        _, _, start, size = self._entry(0)
        self.small = self._chain(start, size) if size else b""
        self.streams: dict[str, bytes] = {}
        self._walk()

    def _at(self, sector: int) -> bytes:
        start = (sector + 1) * self.sector
        if start >= len(self.data):
            raise CompoundError("a sector lies outside the file")
        return self.data[start : start + self.sector].ljust(self.sector, b"\0")

    @staticmethod
    def _numbers(raw: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))

    def _chain(self, start: int, size: int | None = None) -> bytes:
        out, seen = [], set()
        while start < _END:
            if start in seen or start >= len(self.next):
                raise CompoundError("a chain of sectors is broken")
            seen.add(start)
            out.append(self._at(start))
            start = self.next[start]
        whole = b"".join(out)
        return whole if size is None else whole[:size]

    def _short(self, start: int, size: int) -> bytes:
        out, seen = [], set()
        while start < _END and len(out) * self.mini < size:
            if start in seen or start >= len(self.next_mini):
                raise CompoundError("a chain of sectors is broken")
            seen.add(start)
            out.append(self.small[start * self.mini : (start + 1) * self.mini])
            start = self.next_mini[start]
        return b"".join(out)[:size]

    def _entry(self, number: int) -> tuple[str, int, int, int]:
        """(name, kind, first sector, size): kind 1 is a folder, 2 a stream, 5 the root."""
        raw = self.entries[number]
        length = min(64, struct.unpack_from("<H", raw, 64)[0])
        return raw[: max(0, length - 2)].decode("utf-16-le", "replace"), raw[66], struct.unpack_from("<I", raw, 116)[0], struct.unpack_from("<I", raw, 120)[0]

    def _walk(self) -> None:
        todo, seen = [(struct.unpack_from("<I", self.entries[0], 76)[0], "")], set()
        while todo:
            number, folder = todo.pop()
            if number >= len(self.entries) or number in seen:
                continue
            seen.add(number)
            left, right, child = struct.unpack_from("<3I", self.entries[number], 68)
            name, kind, start, size = self._entry(number)
            path = folder + name.lower()
            todo += [(left, folder), (right, folder)]
            if kind == 2:
                self.streams[path] = self._chain(start, size) if size >= self.cutoff else self._short(start, size)
            elif kind == 1:
                todo.append((child, path + "/"))

    def get(self, path: str) -> bytes | None:
        return self.streams.get(path.lower())
