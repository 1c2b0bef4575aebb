import re
import time
from html import unescape

import numpy as np
import pytest

from folioscan.llm import extract, html_blocks, html_pages, queries

from .layouts import LAYOUTS

PAGES = "page_id long, url string, html string, text string, n_main int"


def made(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES)


def slow_article(html):
    inner = re.search(r"(?s)<article>(.*?)</article>", html)
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", " ", inner[1]))
    return "\n".join(t for t in (re.sub(r"\s+", " ", unescape(p)).strip() for p in parts) if t)


def test_every_page_of_the_table(spark, sf):
    rows = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op8_extract(spark, sf).collect()
    assert len(got) == len(rows)
    assert sum(r.text == slow_article(rows[r.page_id]) for r in got) >= 0.99 * len(rows)
    assert all(r.n_chars == len(r.text) for r in got)


def test_letters_that_lower_case_lengthens():
    for raw in sorted(html_blocks.DROPPED):
        page = f"<title>{'İ' * 5}</title><p>İİ</p><{raw}>x < İ y</{raw.upper()} >Hello world<{raw}>z</{raw}><p>İstanbul</p>"
        assert [b.text for b in html_blocks.blocks(page)] == ["İ" * 5, "İİ", "Hello world", "İstanbul"], raw
    assert [b.text for b in html_blocks.blocks("<title>İİİİİ</title><script>x</script>Hello world")] == ["İİİİİ", "Hello world"]
    assert html_blocks.blocks("<script>x</ſcript>y</script") == []


def test_held_out_training_pages():
    model, pages = extract.trained(), extract.training_pages(200, seed=77)
    chances = model.chances([i for ids, _ in pages for i in ids], np.array([len(ids) for ids, _ in pages]))
    assert ((chances >= 0.5) == np.concatenate([t for _, t in pages])).mean() >= 0.98


def test_hand_written_layouts():
    """Layouts by other code than the trainer's; 0.95 of the blocks at least, and most pages without a fault."""
    right, whole, total = 0, 0, 0
    for name, (text, _, _) in zip(LAYOUTS, extract.main_texts([page for page, _ in LAYOUTS.values()], extract.trained())):
        page, want = LAYOUTS[name]
        blocks = [b.text for b in html_blocks.blocks(page)]
        got = text.split("\n") if text else []
        faults = sum((b in got) != (b in want) for b in blocks)
        right, total, whole = right + len(blocks) - faults, total + len(blocks), whole + (got == want)
    assert len(LAYOUTS) >= 20 and right >= 0.95 * total and whole >= 0.85 * len(LAYOUTS)


def test_kept_arrays_are_read_again(spark, monkeypatch):
    extract.kept(spark)
    monkeypatch.setattr(extract, "trained", None)
    again = extract.kept(spark)
    monkeypatch.undo()
    assert all((again.p[k] == v).all() for k, v in extract.trained().p.items())


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000, '<a b=">"' * 130_000, "<div>x" * 50_000, "<center>" * 50_000 + "<option></option>" * 50_000, "<li><ul>" + "<center>" * 50_000 + "<li></li>" * 50_000, "<" * 1_000_000, "<!" * 500_000, "<div>" * 50_000 + "</p>" * 50_000, "<p" + " x='" * 200_000],
    ids=["unclosed", "quoted", "nested", "options", "items", "signs", "declarations", "ends", "quotes"],
)
def test_time_is_linear(page):
    start = time.perf_counter()
    found = html_blocks.blocks(page)
    assert time.perf_counter() - start < 5
    assert all(len(b.path) <= html_blocks.OUTER + html_blocks.INNER for b in found)


def test_marks_of_the_made_up_pages():
    for page in html_pages.pages(200, 3):
        assert page.count("data-main") >= 1
        for block in html_blocks.blocks(page):
            assert not any(t in ("nav", "footer", "aside", "form", "title") for tokens in block.path for t in tokens[:1]) or not block.marked


def test_gradients_by_differences():
    pages = extract.training_pages(3, seed=5)
    ids, lengths, truth = [i for p, _ in pages for i in p], np.array([len(p) for p, _ in pages]), np.concatenate([t for _, t in pages])
    model = extract.Labeller()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    _, grads = model.gradients(ids, lengths, truth)
    r = np.random.default_rng(0)
    for name in model.p:
        flat, grad = model.p[name].reshape(-1), grads[name].reshape(-1)
        for at in r.choice(np.flatnonzero(grad) if grad.any() else [0], 3):
            held = flat[at]
            flat[at] = held + 1e-3
            up = model.gradients(ids, lengths, truth)[0]
            flat[at] = held - 1e-3
            down = model.gradients(ids, lengths, truth)[0]
            flat[at] = held
            assert (up - down) / 2e-3 == pytest.approx(grad[at], rel=0.05, abs=2e-5)


def test_context_of_the_whole_page_counts():
    model, pages = extract.trained(), extract.training_pages(40, seed=31)
    ids = next(p for p, _ in pages if len(p) > 8)
    alone = model.chances(ids, np.ones(len(ids), np.int64))
    together = model.chances(ids, np.array([len(ids)]))
    assert np.abs(alone - together).max() > 0.01
    both = model.chances(ids + ids[:5], np.array([len(ids), 5]))
    assert np.allclose(both[: len(ids)], together, atol=1e-5)


@pytest.mark.parametrize(
    "html, texts",
    [
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a<p>b<br>c</p>d", ["a", "b c", "d"]),
        ("<script>var x='</p>';</script><p>x&nbsp;\n y</p><style>p{}", ["x y"]),
        ("<!-- no <p>comment</p> --><ul><li>one<li>two</ul>", ["one", "two"]),
        ("<div title=\"a>b\" class='x y'>t</div>", ["t"]),
        ("<p><b>bold<br><p>next</p>", ["bold", "next"]),
        ("a < b and c > d <p", ["a < b and c > d <p"]),
        ("<td>1<td>2<tr><td>3", ["1", "2", "3"]),
        ("<p a=\"never closed>text</p><p>more</p>", ["text", "more"]),
        ("<textarea>t</textarea><SCRIPT>s</ScRiPt >after", ["after"]),
        ("<!--never closed <p>x", []),
        ("<xmp><b>x</b> &amp;</xmp>y", ["<b>x</b> &amp;", "y"]),
        ("<noscript><p>in &amp; out</p></noscript>z<template>t</template>", ["in & out", "z", "t"]),
        ("<p x='a>b' y=c>d</p>", ["d"]),
    ],
)
def test_blocks(html, texts):
    assert [b.text for b in html_blocks.blocks(html)] == texts


def test_paths():
    found = html_blocks.blocks('<div class="Ad box-2" id=top><ul><li><a href=x>link</a> t</ul></div><p>x')
    assert found[0].path == (("div", ".ad", ".box", "#top"), ("ul",), ("li",)) and found[0].linked == 4
    assert found[1].path == (("p",),)


def test_odd_rows(spark):
    page = "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A title here</h1><p>Some text of the article, long enough.</p></article><footer>&copy; all rights reserved</footer></body></html>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", page), (4, "u", page), (4, "u", page), (5, "u", "<article>" + "<p>word word word word.</p>" * 30000 + "</article>"), (6, "u", "<" * 5000 + "<a " * 5000 + '"')]
    got = extract.page_texts(made(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    assert (by_id[1].text, by_id[1].n_chars, by_id[2].text) == ("", 0, "")
    assert by_id[4].text == by_id[None].text == "A title here\nSome text of the article, long enough."
    assert by_id[5].text.count("\n") > 29000
    assert extract.page_texts(made(spark, [])).count() == 0
