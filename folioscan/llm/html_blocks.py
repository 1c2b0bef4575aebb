"""Leaf blocks of a web page: a lenient tokenizer that never fails and never drops text between tags.

Time and memory are in proportion to the page, whatever its markup: a tag that
is not closed turns quoted attributes off for the rest of the page, open
elements are counted by name, implied end tags look back ``LOOK_BACK`` open
elements at most, and the path of a block shows its outermost and innermost
elements.

Only scripts, styles and the text of form fields are no text of the page;
what stands in ``noscript``, ``template``, ``noembed`` and ``xmp`` is left to
the labeller (the last two hold no markup).
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape

# Element names of the HTML standard.
BLOCK = frozenset("address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noembed noscript object ol optgroup option p pre search section select summary table tbody td template tfoot th thead title tr ul xmp".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Their content is not markup; it is no text of the page either.
DROPPED = frozenset("script style textarea".split())
#: Their content is text, not markup.
LITERAL = frozenset("noembed xmp".split())
#: A start tag closes open elements of these names, up to the nearest scope.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
SCOPE = frozenset("ul ol dl table article section main aside nav div form body td th".split())
#: A paragraph ends where one of these starts.
ENDS_P = BLOCK - frozenset("button option optgroup col colgroup title select noscript template".split())

#: Open elements that an implied end tag looks back, and that a path shows from the root and from the block.
LOOK_BACK, OUTER, INNER = 64, 8, 24

_OPENING = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][^\s/>]*+)")
#: What is left of a tag; a > inside a quoted value does not end it.
_QUOTED = re.compile(r"""(?:[^>"'=]|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+>""")
#: Where the content of an element without markup ends; ASCII letters only, as lower() of other letters can change the length.
_RAW_END = {name: re.compile(f"</{name}", re.I | re.A) for name in DROPPED | LITERAL}
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_MARK = re.compile(r'data-main="([01])"')
_PART = re.compile(r"[A-Za-z]+")


@dataclass
class Block:
    path: tuple  # names of the open block elements, outermost first, with words of their class, id and role
    text: str
    linked: int  # characters inside links
    marked: bool  # whether the training pages mark the nearest marked element around it as main text


def _tokens(name: str, attributes: str) -> tuple:
    out = [name]
    if attributes:
        for key, value in _ATTR.findall(attributes):
            key = key.lower()
            if key in ("hidden", "aria-hidden"):
                out.append("hidden")
            else:
                out += [f"{'.' if key == 'class' else '#'}{part.lower()}" for part in _PART.findall(value)]
    return tuple(out)


class _Reader:
    def __init__(self):
        self.stack: list[tuple] = []  # (name, tokens, marked)
        self.opened: Counter = Counter()
        self.out: list[Block] = []
        self.parts: list[str] = []
        self.linked, self.link = 0, False

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                shown = self.stack if len(self.stack) <= OUTER + INNER else self.stack[:OUTER] + self.stack[-INNER:]
                self.out.append(Block(tuple(entry[1] for entry in shown), text, self.linked, bool(self.stack) and self.stack[-1][2]))
            self.parts.clear()
        self.linked = 0

    def add(self, piece: str, literal: bool = False) -> None:
        if piece:
            piece = unescape(piece) if "&" in piece and not literal else piece
            self.parts.append(piece)
            if self.link:
                self.linked += len(piece.strip())

    def cut(self, size: int) -> None:
        """Closes open elements down to ``size`` of them."""
        while len(self.stack) > size:
            self.opened[self.stack.pop()[0]] -= 1

    def close(self, name: str) -> None:
        if self.opened[name]:
            at = len(self.stack) - 1
            while self.stack[at][0] != name:
                at -= 1
            self.cut(at)

    def imply(self, name: str) -> None:
        """The end tags that a start tag implies."""
        least = max(0, len(self.stack) - LOOK_BACK)
        if name in ENDS_P and self.opened["p"]:
            for i in range(len(self.stack) - 1, least - 1, -1):
                if self.stack[i][0] == "p":
                    self.cut(i)
                    break
                if self.stack[i][0] in SCOPE:
                    break
        closed = CLOSES.get(name, ())
        if any(self.opened[c] for c in closed):
            for i in range(len(self.stack) - 1, max(0, len(self.stack) - LOOK_BACK) - 1, -1):
                if self.stack[i][0] in closed:
                    self.cut(i)
                    break
                if self.stack[i][0] in SCOPE and not (name in ("td", "th", "tr") and self.stack[i][0] in ("td", "th")):
                    break

    def open(self, name: str, attributes: str) -> None:
        mark = _MARK.search(attributes) if "data-main" in attributes else None
        marked = mark[1] == "1" if mark else bool(self.stack) and self.stack[-1][2]
        self.stack.append((name, _tokens(name, attributes), marked))
        self.opened[name] += 1


def blocks(html: str) -> list[Block]:
    """The leaf blocks of ``html`` in page order: text decoded, white space as one space, trimmed, never empty."""
    page, at, quoted = _Reader(), 0, True
    while True:
        found = _OPENING.search(html, at)
        if not found:
            break
        start, name = found.span(), found.group(2)
        if not name:
            kind = found.group()
            end = html.find({"<!--": "-->", "<![CDATA[": "]]>"}.get(kind, ">"), start[1])
            if end < 0 and kind in ("<!", "<?"):
                break
            page.add(html[at : start[0]])
            at = len(html) if end < 0 else end + (1 if kind in ("<!", "<?") else 3)
            continue
        rest = _QUOTED.match(html, start[1]) if quoted else None
        if rest is None:
            quoted = False
            end = html.find(">", start[1]) + 1
            if not end:
                break
        else:
            end = rest.end()
        page.add(html[at : start[0]])
        at, attributes = end, html[start[1] : end - 1]
        name, closing = name.lower(), bool(found.group(1))
        if not closing and name in _RAW_END:
            stop = _RAW_END[name].search(html, at)
            # an element that is never closed runs to the end of the page
            inner = html[at:] if stop is None else html[at : stop.start()]
            at = len(html) if stop is None else (html.find(">", stop.end()) + 1 or len(html))
            if name in LITERAL:
                page.flush()
                page.open(name, attributes)
                page.add(inner, literal=True)
                page.flush()
                page.close(name)
            continue
        if name == "br":
            page.parts.append(" ")
        elif name == "a":
            page.link = not closing
        elif name in BLOCK:
            page.flush()
            if closing:
                page.close(name)
                continue
            page.imply(name)
            if name not in VOID:
                page.open(name, attributes)
    page.add(html[at:])
    page.flush()
    return page.out
