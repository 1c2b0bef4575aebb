"""Made-up web pages on which the block labeller is trained.

Every part of a page carries ``data-main="1"`` (main text) or ``"0"``; the
nearest one around a block is its truth. Pages differ in how much their markup
says: *semantic* pages have article, nav and the like, *named* ones divs whose
class or id tells the part, *coded* ones divs with meaningless names, *bare*
ones no names at all, so that only words, links, sizes and the order of the
blocks are left. The main text may stand in one element, in nested wrappers,
in a table cell or in the body itself, with inserts between its paragraphs.
"""

from __future__ import annotations

import random

# Words of class and id names by the part of a page that they name.
NAMES = {
    "main": "content article post entry story body text main page-content article-body post-content entry-content story-body blog-post markdown rich-text maintext",
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs links tabs pager pagination submenu main-menu",
    "head": "header masthead topbar banner site-header logo branding search-bar toolbar",
    "foot": "footer site-footer copyright bottom colophon legal credits foot-links",
    "side": "sidebar side aside widget rail related recommended popular trending most-read see-also more-stories tags",
    "ad": "ad ads advert advertisement sponsored sponsor promo banner-ad adsbox google-ad commercial partner promoted",
    "notice": "notice cookie cookies consent alert gdpr banner-notice message warning-bar popup modal overlay disclaimer announcement paywall",
    "form": "form newsletter subscribe signup login search contact-form poll survey register",
    "comments": "comments comment reply replies discussion responses user-comments disqus thread feedback comment-list reviews",
    "share": "share social sharing share-buttons follow social-links toolbar-share",
}
# Words that such parts are made of.
WORDS = {
    "nav": "home about contact news sports business products services blog archive next previous category categories topics sitemap help faq all more page",
    "head": "welcome search login register account menu language english deutsch skip to content sign in my site",
    "foot": "copyright all rights reserved terms of use privacy policy imprint contact careers powered by company inc © 2024 cookies",
    "side": "related articles popular posts most read recent you may also like trending now tags archive see also read more editor picks",
    "ad": "advertisement sponsored buy now save 50% off shop today free shipping click here best deals limited offer learn more",
    "notice": "we use cookies to improve your experience accept reject settings please enable javascript this site notice by continuing you agree update your browser dismiss",
    "form": "email address your name subscribe to our newsletter submit password send search enter required sign up choose vote message",
    "comments": "comments reply leave a comment says posted by user ago likes report great post thanks i think this agree disagree",
    "share": "share tweet facebook twitter print email this link copy whatsapp follow us pin save",
}
# Frequent words of four languages for the main text.
COMMON = "the of and to in a is that for it with as was on be by this are from at der die und das in zu den von ist mit le la les de et des en que pour dans un une el los que en y a se por con para"



STYLES = {"semantic": 34, "named": 30, "coded": 14, "bare": 22}
#: The element that a part has on semantic pages.
ELEMENTS = {"nav": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form", "comments": "section", "ad": "div", "notice": "div", "share": "div"}


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        letters = "etaoinshrdlucmfwypvbgkéäñöüß"
        made = ["".join(self.r.choice(letters) for _ in range(self.r.randrange(2, 12))) for _ in range(1500)]
        # words of the other parts are words of articles as well
        self.vocabulary = COMMON.split() * 3 + made + [w for part in WORDS.values() for w in part.split()]
        self.style, self.heading = "named", ""

    @property
    def plain(self) -> bool:
        """Whether the markup says nothing about the parts."""
        return self.style in ("coded", "bare")

    # -- words ----------------------------------------------------------------------------------------

    def prose(self, low: int, high: int) -> str:
        r = self.r
        out = [r.choice(self.vocabulary) + r.choice(["", "", "", "", "", "", ",", "."]) for _ in range(r.randrange(low, high))]
        out[0] = out[0].capitalize()
        if r.random() < 0.12:  # texts of poor quality are main text as well
            odd = r.choice([" | ", "!! ", "# ", "& ", "* ", "% ", "$ ", " - ", ", "])
            return odd.join(w.upper() if odd == "!! " else w for w in out)
        return " ".join(out) + r.choice([".", ".", ".", "", "!", "?"])

    def said(self, part: str, low: int = 1, high: int = 9) -> str:
        """Words that are typical of a part, on pages whose markup helps partly replaced."""
        words, r = WORDS[part].split(), self.r
        start = r.randrange(len(words))
        picked = [words[(start + i) % len(words)] for i in range(r.randrange(low, high))]
        if not self.plain and r.random() < 0.35:
            picked = [r.choice(self.vocabulary) if r.random() < 0.6 else w for w in picked]
        return " ".join(picked).capitalize()

    def told(self, part: str, low: int, high: int) -> str:
        """Text of a part: typical words, or any prose where the markup tells what it is."""
        return self.said(part, low, high) if self.plain or self.r.random() < 0.5 else self.prose(low, high + 4)

    # -- elements -------------------------------------------------------------------------------------

    def element(self, part: str, inner: str, *tags: str) -> str:
        r, main = self.r, part == "main"
        named = self.style == "named" or self.style == "semantic" and r.random() < 0.5
        if self.style == "semantic":
            tag = r.choice(["article", "article", "main"]) if main else ELEMENTS[part]
            named |= tag in ("div", "section")
        else:
            tag = r.choice(tags or ("div",))
        key, name = r.choice(["class", "class", "id"]), ""
        if named:
            name = r.choice(NAMES[part].split())
        elif self.style == "coded":
            name = "".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(5))
        if name and key == "class":
            name += r.choice(["", "", " clearfix", " col-md-8", " box", " wrapper"])
        return f'<{tag}{f" {key}={chr(34)}{name}{chr(34)}" if name else ""} data-main="{int(main)}">{inner}</{tag}>'

    def links(self, part: str, high: int = 9) -> str:
        r = self.r
        text = lambda: self.said(part, 1, 4) if r.random() < 0.4 else " ".join(r.choice(self.vocabulary) + r.choice(["", "", ".", ","]) for _ in range(r.randrange(1, 7)))
        items = [f'<a href="/{i}">{text()}</a>' for i in range(r.randrange(2, high))]
        return r.choice(["<ul><li>" + "</li><li>".join(items) + "</li></ul>", " | ".join(items), "<div>" + "</div><div>".join(items) + "</div>", "<ol><li>" + "<li>".join(items) + "</ol>", "<table><tr><td>" + "</td><td>".join(items) + "</td></tr></table>"])

    def form(self) -> str:
        return f"<label>{self.said('form', 1, 4)}</label><input name=q><button>{self.said('form', 1, 3)}</button>"

    # -- main text ------------------------------------------------------------------------------------

    def paragraph(self) -> str:
        r = self.r
        text = self.prose(1, r.choice([2, 4, 12, 60, 160])) if not self.plain else self.prose(4, r.choice([9, 20, 60, 160]))
        if not self.plain and r.random() < 0.05:  # an article may say what else stands in footers
            text = self.said(r.choice(["foot", "notice", "nav", "side"]), 2, 9) + "."
        words = text.split(" ")
        for _ in range(r.choice([0, 0, 0, 0, 1, 2, 3])):
            at = r.randrange(len(words))
            words[at] = r.choice(['<a href="/x">%s</a>', '<a href="/x">%s</a>', "<em>%s</em>", "<b>%s</b>", "<code>%s</code>", "<span>%s</span>"]) % words[at]
        text = " ".join(words)
        if r.random() < 0.06:
            text = text.replace(" ", r.choice(["<br>", "<br><br>", " &amp; ", " &nbsp;", " &mdash; ", "\n"]), 2)
        return r.choice([f"<p>{text}</p>"] * 5 + [f"<p><b>{text}<br>", f"<p>{text}", f"<div>{text}</div>", f"<section><p>{text}</p></section>", f"{text}<p></p>", f"<noscript><p>{text}</p></noscript>" if r.random() < 0.2 else f"<p>{text}</p>"])

    def piece(self) -> str:
        r, roll = self.r, self.r.random()
        if roll < 0.70:
            return self.paragraph()
        if roll < 0.78:
            level = r.choice("223345")
            return f"<h{level}>{self.prose(1, 7)}</h{level}>" + self.paragraph()
        if roll < 0.85:
            tag = r.choice(["ul", "ul", "ol"])
            return f"<{tag}><li>" + r.choice(["</li><li>", "<li>"]).join(self.prose(2, 14) for _ in range(r.randrange(2, 6))) + f"</{tag}>"
        if roll < 0.93:
            return r.choice(["<blockquote><p>%s</p></blockquote>", "<blockquote>%s</blockquote>", "<pre>%s</pre>", "<figure><img src=a><figcaption>%s</figcaption></figure>", "<table><tr><th>%s</th></tr></table>", "<dl><dt>%s</dt></dl>", "<xmp>%s</xmp>", "<details><summary>%s</summary></details>", "<address>%s</address>"]) % self.prose(3, 30)
        cells = [f"<td>{self.prose(1, 4)}</td>" * 2 for _ in range(r.randrange(2, 5))]
        return "<table><tr>" + "</tr><tr>".join(cells) + "</tr></table>"

    def insert(self) -> str:
        """What stands in the middle of an article but is not part of it."""
        part = self.r.choice(["ad", "ad", "share", "form", "side", "notice", "comments"])
        return self.part(part, 5)

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.8:
            tag = r.choice(["h1", "h1", "h1", "h2"])
            out.append(f"<{tag}>{self.heading}</{tag}>" + f"<p>{self.heading}</p>" * (r.random() < 0.15))
        for _ in range(r.choice([1, 2, 3, 5, 10, 16])):
            out.append(self.piece())
            if r.random() < 0.07:
                out.append(self.insert())
        return "".join(out)

    # -- other parts ----------------------------------------------------------------------------------

    def part(self, part: str, high: int = 9) -> str:
        r = self.r
        if part == "nav":
            return self.element(part, self.links(part, r.choice([5, 9, 9, 40])), "div", "div", "ul")
        if part == "head":
            return self.element(part, r.choice([self.links("nav", high), f"<p>{self.said(part)}</p>", f"<h2>{self.said(part, 1, 4)}</h2>", f"{self.told(part, 1, 4)}"]))
        if part == "foot":
            year = f"{r.randrange(1999, 2026)}"
            return self.element(part, r.choice([self.said(part, 3, 9), f"&copy; {year} {self.prose(2, 9)}", f"&copy; {self.prose(1, 4)} &middot; {self.told(part, 2, 12)}", self.links(part), f"<p>Copyright {year} {self.prose(1, 5)} {self.said(part, 3, 6)}</p>", f"<p>{self.said(part, 3, 9)} | {year}</p>", f"<p>&copy; {year} {self.prose(1, 4)} All rights reserved.</p>"]))
        if part == "side":
            return self.element(part, f"<h3>{self.said(part, 1, 4)}</h3>" * (self.plain or r.random() < 0.7) + (self.links(part, high) if self.plain or r.random() < 0.5 else f"<p>{self.prose(4, 25)}</p>"), "div", "div", "section")
        if part == "ad":
            return self.element(part, r.choice(["%s", "<p>%s</p>", "<a href=/ad>%s</a>"]) % self.told(part, 2, 12), "div", "div", "section")
        if part == "notice":
            text = f"<p>{self.told(part, 5, 24)}</p>"
            if r.random() < 0.2:
                return f'<noscript data-main="0">{self.said(part, 5, 14)}</noscript>'
            return self.element(part, text + r.choice(["", "<button>ok</button>"]), "div", "div", "section")
        if part == "form":
            return self.element(part, f"<p>{self.said(part, 3, 9)}</p>" * (r.random() < 0.5) + self.form(), "form", "form", "div")
        if part == "comments":
            lead = f"<h3>{r.choice(['Comments', 'Comments (%d)' % r.randrange(90), '%d comments' % r.randrange(90), 'Leave a comment', 'Discussion', 'Responses', self.said('comments', 2, 5)])}</h3>"
            said = "".join(r.choice(["<div>%s</div>", "<li>%s</li>", "<p>%s</p>"]) % f"<p>{self.said('comments', 2, 5)}</p><p>{self.prose(3, 40)}</p>" for _ in range(r.randrange(1, 6)))
            return self.element(part, lead * (self.plain or r.random() < 0.85) + said, "div", "div", "section")
        return self.element(part, self.links(part, high), "div", "ul")

    def page(self) -> str:
        r = self.r
        self.style = r.choices(list(STYLES), list(STYLES.values()))[0]
        self.heading = self.prose(2, 9)
        before = [p for p in ("notice", "head", "nav", "ad", "form", "side") if r.random() < (0.7 if p == "nav" else 0.3)]
        after = [p for p in ("share", "ad", "comments", "side", "form", "nav", "notice", "foot") if r.random() < (0.7 if p == "foot" else 0.3)]
        r.shuffle(before)
        if r.random() < 0.3:
            r.shuffle(after)
        text, skeleton = self.article(), r.choice(["flow", "flow", "flow", "wrapped", "table", "body"])
        if self.plain and r.random() < 0.08:
            before, after = [], []
        first, last = "".join(self.part(p) for p in before), "".join(self.part(p) for p in after)
        if skeleton == "body":
            # unwrapped: the body itself is the main text and only the other parts are marked
            return self.document(first + text + last, 1)
        if skeleton == "wrapped":
            for _ in range(r.randrange(1, 4)):
                text = f"<div>{text}</div>"
        main = self.element("main", text, "div", "div", "section")
        if skeleton == "table":
            cells = [first, main, last]
            body = "<table><tr><td>" + "</td><td>".join(cells) + "</td></tr></table>" if r.random() < 0.5 else f"{first}<table><tr><td>{main}</td></tr></table>{last}"
        else:
            body = first + main + last
        if r.random() < 0.3:
            body = f'<div class="{r.choice(["wrapper", "container", "page", "site", "row"])}">{body}</div>'
        return self.document(body, 0)

    def document(self, body: str, mark: int) -> str:
        title = f'<title data-main="0">{self.heading}</title>' if self.r.random() < 0.9 else ""
        return f'<!DOCTYPE html><html><head>{title}<style>p{{}}</style></head><body data-main="{mark}">{body}</body></html>'


def pages(count: int, seed: int = 8) -> list[str]:
    writer = Writer(seed)
    return [writer.page() for _ in range(count)]
