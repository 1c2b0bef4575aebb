"""Older office formats inside compound files: DOC texts by their piece table, XLS cells by their records, MSG mails by their properties."""

from __future__ import annotations

import re
import struct
from zlib import crc32

from .compound import MAGIC, Compound, CompoundError
from .parsers import _DATES, Block, ParseError, _line_blocks, column_letters, decode_html, html_text_blocks, number_text, rtf_blocks


def _opened(data: bytes, code: str) -> Compound:
    try:
        return Compound(data)
    except (CompoundError, struct.error) as problem:
        raise ParseError(code, str(problem)) from None


# -- DOC -----------------------------------------------------------------------------------------------

_FIELD = re.compile("\x13[^\x13\x14\x15]*(?:\x14([^\x13\x14\x15]*))?\x15")
_DOC_MARKS = str.maketrans({"\x07": "\n", "\x0b": "\n", "\x0c": "\n", "\r": "\n", "\x1e": "-", **dict.fromkeys("\x01\x02\x03\x04\x05\x08\x1f\x13\x14\x15")})


def _pieces(table: bytes, word: bytes) -> str:
    """The text of a document in character order: pieces of one or two bytes a character."""
    at = 0
    while at < len(table) and table[at] == 1:  # properties that stand before the pieces
        at += 3 + struct.unpack_from("<H", table, at + 1)[0]
    if at >= len(table) or table[at] != 2:
        raise ParseError("DOC_FORMAT_ERROR", "no piece table")
    size = struct.unpack_from("<I", table, at + 1)[0]
    plex = table[at + 5 : at + 5 + size]
    n = (len(plex) - 4) // 12
    ends = struct.unpack_from(f"<{n + 1}I", plex)
    out = []
    for i in range(n):
        place = struct.unpack_from("<I", plex, 4 * (n + 1) + 8 * i + 2)[0]
        count = ends[i + 1] - ends[i]
        if place & 0x40000000:
            start = (place & 0x3FFFFFFF) // 2
            out.append(word[start : start + count].decode("cp1252", "replace"))
        else:
            out.append(word[place : place + 2 * count].decode("utf-16-le", "replace"))
    return "".join(out)


def _shown(text: str) -> str:
    """Without the instructions of fields, marks as line breaks."""
    while True:
        plain = _FIELD.sub(lambda m: m[1] or "", text)
        if plain == text:
            return plain.translate(_DOC_MARKS)
        text = plain


def doc_blocks(data: bytes) -> list[Block]:
    """Lines of the body, headers, footers, notes, comments and text boxes."""
    if data[:8] != MAGIC:
        raise ParseError("DOC_FORMAT_ERROR")
    compound = _opened(data, "DOC_FORMAT_ERROR")
    word = compound.get("WordDocument") or b""
    if len(word) < 0x1AA or word[:2] != b"\xec\xa5":
        raise ParseError("DOC_FORMAT_ERROR")
    flags = struct.unpack_from("<H", word, 10)[0]
    if flags & 0x8100:
        raise ParseError("DOC_ENCRYPTED")
    table = compound.get("1Table" if flags & 0x200 else "0Table") or b""
    start, size = struct.unpack_from("<2I", word, 0x1A2)
    text = _pieces(table[start : start + size], word)
    # lengths of the parts, one after the other in the text
    lengths = dict(zip(("body", "footnotes", "headers", "macros", "comments", "endnotes", "text boxes", "header text boxes"), struct.unpack_from("<8I", word, 0x4C)))
    parts, at = {}, 0
    for name, length in lengths.items():
        parts[name] = text[at : at + length]
        at += length
    start, size = struct.unpack_from("<2I", word, 154 + 8 * 11)
    stories = struct.unpack_from(f"<{size // 4}I", table, start) if size else ()
    header, footer = [], []
    for i in range(6, len(stories) - 1):  # six separators, then for each section: two headers, two footers, the first page's header and footer
        (header if (i - 6) % 6 in (0, 1, 4) else footer).append(parts["headers"][stories[i] : stories[i + 1]])
    said = [("body", parts["body"]), ("header", "\n".join(header)), ("footer", "\n".join(footer)), ("footnotes", parts["footnotes"]), ("endnotes", parts["endnotes"]), ("comments", parts["comments"]), ("text boxes", parts["text boxes"] + "\n" + parts["header text boxes"])]
    out: list[Block] = []
    for name, whole in said:
        for number, line in enumerate(_shown(whole).split("\n"), 1):
            if line.strip():
                out.append((len(out), None, line, "section", f"{name}, paragraph {number}"))
    return out


# -- XLS -----------------------------------------------------------------------------------------------

# Numbers of record types and of built-in formats that show percent, fixed decimals or thousands.
BOF, EOF, SHEET, STRINGS, MORE, FORMAT, STYLE, YEAR_1904, LOCKED = 0x809, 0x0A, 0x85, 0xFC, 0x3C, 0x41E, 0xE0, 0x22, 0x2F
SHARED_TEXT, TEXT, RICH_TEXT, NUMBER, SHORT, SHORTS, FORMULA, RESULT, LOGICAL = 0xFD, 0x204, 0xD6, 0x203, 0x27E, 0xBD, 0x06, 0x207, 0x205
BUILT_IN = {2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%"}
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}


def _records(book: bytes) -> list[tuple[int, int, list[bytes]]]:
    """(place, type, parts) of each record; what continues a record is a further part of it."""
    out, at = [], 0
    while at + 4 <= len(book):
        kind, size = struct.unpack_from("<2H", book, at)
        body = book[at + 4 : at + 4 + size]
        if kind == MORE and out:
            out[-1][2].append(body)
        else:
            out.append((at, kind, [body]))
        at += 4 + size
    return out


class _Text:
    """Reads strings over the parts of a record; a part that continues characters says anew how wide they are."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.part, self.at = parts, 0, 0

    def take(self, size: int) -> bytes:
        out = b""
        while size:
            if self.at == len(self.parts[self.part]):
                if self.part + 1 == len(self.parts):
                    raise ParseError("XLS_PARSE_ERROR", "a string ends early")
                self.part, self.at = self.part + 1, 0
            piece = self.parts[self.part][self.at : self.at + size]
            out, size, self.at = out + piece, size - len(piece), self.at + len(piece)
        return out

    def string(self, count_bytes: int = 2) -> str:
        count = int.from_bytes(self.take(count_bytes), "little")
        flags = self.take(1)[0]
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = [], flags & 1
        while count:
            if self.at == len(self.parts[self.part]) and self.part + 1 < len(self.parts):
                self.part, self.at = self.part + 1, 0
                wide = self.take(1)[0] & 1
            width = 2 if wide else 1
            now = min(count, (len(self.parts[self.part]) - self.at) // width)
            if not now:
                raise ParseError("XLS_PARSE_ERROR", "a string ends early")
            out.append(self.take(now * width).decode("utf-16-le" if wide else "latin-1", "replace"))
            count -= now
        self.take(4 * runs + extra)
        return "".join(out)


def _short_number(raw: int) -> float:
    value = struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0] if not raw & 2 else float((raw >> 2) - ((raw >> 31) << 30))
    return value / 100 if raw & 1 else value


def xls_blocks(data: bytes) -> list[Block]:
    """Each cell with text, by sheet, row and column; numbers as their format shows them."""
    if data[:8] == MAGIC:
        compound = _opened(data, "XLS_FORMAT_ERROR")
        book = compound.get("Workbook") or compound.get("Book")
    else:
        book = data if data[:2] in (b"\x09\x08", b"\x09\x04", b"\x09\x02", b"\x09\x00") else None
    if not book:
        raise ParseError("XLS_FORMAT_ERROR")
    records = _records(book)
    formats, styles, strings, sheets, since_1904 = dict(BUILT_IN), [], [], [], False
    for _, kind, parts in records:
        body = parts[0]
        if kind == LOCKED:
            raise ParseError("XLS_ENCRYPTED")
        if kind == FORMAT:
            formats[struct.unpack_from("<H", body)[0]] = _Text([body[2:]]).string()
        elif kind == STYLE:
            styles.append(struct.unpack_from("<H", body, 2)[0])
        elif kind == YEAR_1904:
            since_1904 = body[:1] == b"\1"
        elif kind == SHEET:
            sheets.append((struct.unpack_from("<I", body)[0], _Text([body[6:]]).string(1)))
        elif kind == STRINGS:
            reader = _Text([body[8:], *parts[1:]])
            strings = [reader.string() for _ in range(struct.unpack_from("<I", body, 4)[0])]

    def number(value: float, style: int) -> str:
        code = styles[style] if style < len(styles) else 0
        raw = str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
        return number_text(raw, formats.get(code) or ("yyyy-mm-dd" if code in _DATES else None), since_1904)

    out: list[Block] = []
    for place, name in sheets:
        cells: dict[tuple[int, int], str] = {}
        depth, pending = 0, None
        for at, kind, parts in records:
            if at < place:
                continue
            body = parts[0]
            depth += (kind == BOF) - (kind == EOF)
            if depth == 0:
                break
            if depth > 1 or kind not in (SHARED_TEXT, TEXT, RICH_TEXT, NUMBER, SHORT, SHORTS, FORMULA, RESULT, LOGICAL):
                continue
            if kind == RESULT:
                if pending:
                    cells[pending] = _Text(parts).string()
                continue
            row, column, style = struct.unpack_from("<3H", body)
            if kind == SHARED_TEXT:
                index = struct.unpack_from("<I", body, 6)[0]
                cells[row, column] = strings[index] if index < len(strings) else ""
            elif kind in (TEXT, RICH_TEXT):
                cells[row, column] = _Text([body[6:], *parts[1:]]).string()
            elif kind == NUMBER:
                cells[row, column] = number(struct.unpack_from("<d", body, 6)[0], style)
            elif kind == SHORT:
                cells[row, column] = number(_short_number(struct.unpack_from("<I", body, 6)[0]), style)
            elif kind == SHORTS:
                for i in range((len(body) - 6) // 6):
                    style, raw = struct.unpack_from("<HI", body, 4 + 6 * i)
                    cells[row, column + i] = number(_short_number(raw), style)
            elif kind == LOGICAL:
                cells[row, column] = ERRORS.get(body[6], "#ERR") if body[7] else ("TRUE" if body[6] else "FALSE")
            elif body[12:14] != b"\xff\xff":
                cells[row, column] = number(struct.unpack_from("<d", body, 6)[0], style)
            elif body[6] == 0:
                pending = (row, column)  # the text stands in the next record
            else:
                cells[row, column] = {1: "TRUE" if body[8] else "FALSE", 2: ERRORS.get(body[8], "#ERR")}.get(body[6], "")
        for (row, column), text in sorted(cells.items()):
            if text.strip():
                out.append((len(out), name, text, "sheet_cell", f"{name}!{column_letters(column)}{row + 1}"))
    return out


# -- MSG -----------------------------------------------------------------------------------------------

# The text that compressed RTF starts from, and how recipients are called by their number.
RTF_START = b"{\\rtf1\\ansi\\mac\\deff0\\deftab720{\\fonttbl;}{\\f0\\fnil \\froman \\fswiss \\fmodern \\fscript \\fdecor MS Sans SerifSymbolArialTimes New RomanCourier{\\colortbl\\red0\\green0\\blue0\r\n\\par \\pard\\plain\\f0\\fs20\\b\\i\\u\\tab\\tx"
RECIPIENTS = {1: "to", 2: "cc", 3: "bcc"}
MOST_RTF = 64 << 20


def expanded_rtf(data: bytes) -> bytes:
    """Compressed RTF of a mail: literals and references into a ring of 4,096 bytes."""
    if len(data) < 16:
        raise ParseError("MSG_RTF_INVALID")
    size, kind, checksum = struct.unpack_from("<I", data, 4)[0], data[8:12], struct.unpack_from("<I", data, 12)[0]
    if size > MOST_RTF:
        raise ParseError("MSG_RTF_LIMIT")
    if kind == b"MELA":
        return data[16 : 16 + size]
    if kind != b"LZFu" or crc32(data[16:], 0xFFFFFFFF) ^ 0xFFFFFFFF != checksum:
        raise ParseError("MSG_RTF_INVALID")
    ring = bytearray(RTF_START.ljust(4096, b"\0"))
    write, out, at = len(RTF_START), bytearray(), 16
    while at < len(data):
        control, at = data[at], at + 1
        for bit in range(8):
            if at >= len(data):
                break
            if control >> bit & 1:
                if at + 2 > len(data):
                    return bytes(out)
                pair, at = data[at] << 8 | data[at + 1], at + 2
                read, length = pair >> 4, (pair & 15) + 2
                if read == write:
                    return bytes(out)
                for k in range(length):  # a reference may reach what it writes itself
                    byte = ring[(read + k) % 4096]
                    out.append(byte)
                    ring[write] = byte
                    write = (write + 1) % 4096
            else:
                out.append(data[at])
                ring[write] = data[at]
                write, at = (write + 1) % 4096, at + 1
    return bytes(out)


class _Properties:
    """The properties of one folder of a mail: fixed ones from its table, strings and bytes from their own streams."""

    def __init__(self, compound: Compound, folder: str, header: int, ansi: str = "cp1252"):
        self.compound, self.folder, self.ansi = compound, folder, ansi
        table = compound.get(f"{folder}__properties_version1.0")
        if table is None or len(table) < header or (len(table) - header) % 16:
            raise ParseError("MSG_FORMAT_ERROR")
        self.numbers = {tag >> 16: value for tag, _, value, _ in struct.iter_unpack("<4I", table[header:]) if tag & 0xFFFF == 3}

    def raw(self, tag: int, kind: int) -> bytes | None:
        return self.compound.get(f"{self.folder}__substg1.0_{tag:04x}{kind:04x}")

    def text(self, tag: int) -> str:
        wide, narrow = self.raw(tag, 0x1F), self.raw(tag, 0x1E)
        said = wide.decode("utf-16-le", "replace") if wide is not None else (narrow or b"").decode(self.ansi, "replace")
        return said.strip("\0 \t\r\n")


def _codec(page: int | None, fallback: str) -> str:
    name = {65001: "utf-8", 1200: "utf-16-le", 20127: "ascii"}.get(page or 0, f"cp{page}")
    try:
        b"".decode(name)
    except LookupError:
        return fallback
    return name


def msg_blocks(data: bytes) -> list[Block]:
    """Subject (as heading too), sender, recipients and the body: HTML, else plain text, else RTF. Attachments are not read."""
    if data[:8] != MAGIC:
        raise ParseError("MSG_FORMAT_ERROR")
    compound = _opened(data, "MSG_FORMAT_ERROR")
    mail = _Properties(compound, "", 32)
    mail.ansi = _codec(mail.numbers.get(0x3FFD), "cp1252")
    kind = mail.text(0x1A).lower()
    if not kind:
        raise ParseError("MSG_FORMAT_ERROR")
    if ".smime" in kind:
        raise ParseError("MSG_SMIME_UNSUPPORTED")
    if kind.split(".")[:2] != ["ipm", "note"]:
        raise ParseError("MSG_ITEM_UNSUPPORTED")
    out: list[Block] = []

    def add(text: str, place: str, heading: str | None = None) -> None:
        if text.strip():
            out.append((len(out), heading, text.strip(), "section", place))

    unique = lambda *said: "\n".join(dict.fromkeys(s for s in said if s))
    subject = mail.text(0x37)
    add(subject, "subject", subject or None)
    add(unique(mail.text(0x0C1A), mail.text(0x0C1F), mail.text(0x5D01)), "sender")
    folders = sorted({path.split("/")[0] + "/" for path in compound.streams if path.startswith("__recip_version1.0_#")})
    for number, folder in enumerate(folders, 1):
        person = _Properties(compound, folder, 8, mail.ansi)
        add(unique(person.text(0x3001), person.text(0x3003), person.text(0x39FE)), f"{RECIPIENTS.get(person.numbers.get(0x0C15), 'recipient')} {number}")
    if not folders:
        for tag, name in ((0x0E04, "to"), (0x0E03, "cc"), (0x0E02, "bcc")):
            add(mail.text(tag), name)
    for form, lines in _bodies(mail):
        if lines:
            for number, line in enumerate(lines, 1):
                add(line, f"body ({form}), paragraph {number}")
            break
    return out


def _bodies(mail: _Properties):
    """The forms of a mail's body by preference; the next one is only made if the one before is empty."""
    raw = mail.raw(0x1013, 0x102)
    page = mail.numbers.get(0x3FDE)
    html = mail.text(0x1013) or (raw.decode(_codec(page, "cp1252"), "replace") if raw and page else decode_html(raw) if raw else "")
    yield "HTML", [b[2] for b in html_text_blocks(html)] if html else []
    yield "text", [b[2] for b in _line_blocks(mail.text(0x1000))]
    packed = mail.raw(0x1009, 0x102)
    yield "RTF", [b[2] for b in rtf_blocks(expanded_rtf(packed))] if packed else []
