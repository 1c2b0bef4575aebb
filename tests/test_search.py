import random

import pytest
from pyspark.sql import functions as F

from folioscan.functions.text import earliest, grams, normalize, normalized, parse_types, query_terms, snippet
from folioscan.operators import passages, postings, search
from folioscan.operators.search import Search

DOCS = "id long, root string, path string, filename string, extension string, size_bytes long, modified_at_ms double, status string"
BLOCKS = "document_id long, ordinal int, heading string, content string, location_value string"


def collection(spark, docs, blocks):
    d = spark.createDataFrame(docs, DOCS).withColumn("filename_norm", normalized("filename"))
    b = spark.createDataFrame(blocks, BLOCKS).withColumn("heading_norm", normalized("heading")).withColumn("content_norm", normalized("content"))
    return d.cache(), b.cache()


def made(seed, count=60):
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "ﬁne", "Ｆｕｌｌ", "測試", "的", "é", "é", "İx", "ß", "ΣΑΣ", "a", "b", "a b", "x  y"]
    docs, blocks = [], []
    for i in range(count):
        root, ext = f"/r{i % 2}", rng.choice([".txt", ".md", ".xlsx"])
        name = f"{rng.choice(words)}-{i}{ext}" if rng.random() < 0.8 else f"{rng.choice(words)}"
        docs.append((i, root, f"{root}/{'sub/' if i % 3 == 0 else ''}{i}/{name}", name, ext, 10, 1000.0 + (i % 7) * 10, "unsupported" if i % 11 == 5 else "indexed"))
        if i % 11 != 5:
            for o in sorted(rng.sample(range(30), rng.randrange(0, 7))):
                blocks.append((i, o, rng.choice([None, "", rng.choice(words), "測試 alpha"]), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) + rng.choice(["", "\n" + rng.choice(words)]), f"line {o}"))
    return docs, blocks, words


def slow(docs, blocks, s: Search):
    """The ranking, document by document."""
    query, terms = query_terms(s.text, s.mode)
    out = []
    for i, root, path, name, ext, _, at, status in docs:
        inside = s.subtree is None or path == s.subtree or path.startswith(s.subtree + "/")
        if (s.types and ext not in s.types) or (s.statuses and status not in s.statuses) or (s.root and root != s.root) or not inside:
            continue
        n = normalize(name)
        rank = 0 if s.field == "content" else 4 if n == query else 3 if all(t in n for t in terms) else 0
        by, ordinal = "filename", None
        if not rank and s.field != "filename":
            own = sorted((b for b in blocks if b[0] == i), key=lambda b: b[1])
            rows = [(o, normalize(h or ""), normalize(c)) for _, o, h, c, _ in own]
            left = {t for t in terms if s.field == "content" or t not in n} - {t for _, h, c in rows for t in terms if t in h or t in c}
            if s.mode == "all-terms" and left:
                continue
            heads = [o for o, h, _ in rows if h and all(t in h for t in terms)]
            texts = [o for o, _, c in rows if all(t in c for t in terms)]
            cover = []
            for o, h, c in rows:
                use = h and any(t in h for t in terms)
                k = sum(t in (h if use else c) for t in terms)
                cover += [(-k, -bool(use), o)] if k else []
            if heads:
                rank, by, ordinal = 2, "heading", heads[0]
            elif texts:
                rank, by, ordinal = 1, "content", texts[0]
            elif s.mode == "all-terms" and cover:
                best = min(cover)
                rank, by, ordinal = 1, "heading" if best[1] else "content", best[2]
        if rank:
            out.append((i, rank, by, ordinal, at, path))
    key = {"relevance": lambda r: (-r[1], -r[4], r[5].encode("utf-16-be")), "filename": lambda r: (r[5].encode("utf-16-be"), -r[4]), "modified": lambda r: (-r[4], r[5].encode("utf-16-be"))}
    return [r[:4] for r in sorted(out, key=key[s.sort])]


@pytest.mark.parametrize("seed", [7, 8])
def test_ranking_against_the_slow_ranker(spark, seed):
    docs, blocks, words = made(seed)
    d, b = collection(spark, docs, blocks)
    rng = random.Random(seed)
    variants = [{}, {"mode": "all-terms"}, {"field": "filename"}, {"field": "content", "mode": "all-terms"}, {"sort": "filename"}, {"sort": "modified", "statuses": ("indexed",)}, {"types": (".md",), "root": "/r0"}, {"subtree": "/r0/sub"}]
    found = 0
    for n in range(16):
        text = rng.choice(words) if n % 2 else f"{rng.choice(words)} {rng.choice(words)}"
        text = text.upper() if rng.random() < 0.2 else text
        s = Search(text, **variants[n % len(variants)])
        got = [(r.id, r.rank, r.by, r.ordinal) for r in search.top(search.matches(d, b, s), s.sort, 1000).orderBy("position").collect()]
        assert got == slow(docs, blocks, s), s
        found += len(got)
    assert found > 100
    ranks = {r[1] for text in words for r in slow(docs, blocks, Search(text))} | {r[1] for r in slow(docs, blocks, Search(docs[3][3]))}
    assert ranks == {1, 2, 3, 4}


def test_refining_keeps_the_order_before(spark):
    docs, blocks, _ = made(3)
    d, b = collection(spark, docs, blocks)
    session = search.Session(d, b, Search("a", sort="modified", types=(".txt", ".md")), version=1, current=lambda: 1)
    first = [r.id for r in session.results().collect()]
    then = [r.id for r in session.append("b").collect()]
    assert then == [i for i in first if i in {r[0] for r in slow(docs, blocks, Search("b"))}] and then
    assert session.conditions == ["a", "b"]
    assert [r.id for r in session.page(1, 3).collect()] == then[:3] and [r.id for r in session.first(2).collect()] == then[:2]
    assert [r.id for r in session.back().collect()] == first
    session.append("b")
    assert [r.id for r in session.reset().collect()] == first
    stale = search.Session(d, b, Search("a"), version=1, current=lambda: 2)
    with pytest.raises(RuntimeError, match="SEARCH_INDEX_CHANGED"):
        stale.results()


def test_pages_and_totals(spark):
    docs = [(i, "/r", f"/r/{i:04}.txt", f"{i:04}.txt", ".txt", 1, 0.0, "indexed") for i in range(501)]
    d, b = collection(spark, docs, [(i, 0, None, "hit", "line 1") for i in range(501)])
    found = search.matches(d, b, Search("hit"))
    assert [r.id for r in search.page(found, 26, 20).collect()] == [500]
    with pytest.raises(ValueError):
        search.page(found, 27, 20)
    assert search.page(search.matches(d, b, Search("nothing")), 1, 20).count() == 0
    for n, want in ((499, (499, "eq")), (500, (500, "gte")), (501, (500, "gte"))):
        part = found.filter(F.col("id") < n)
        assert tuple(search.total(part, False).first()) == want
        assert tuple(search.total(part, True).first()) == (n, "eq")
    assert tuple(search.total(found, False, 620).first()) == (501, "eq")
    assert [r.id for r in search.phased(d, b, Search("000"), 5).orderBy("position").collect()] == [0, 1, 2, 3, 4]


def test_grams_equal_the_scan(spark):
    docs, blocks, words = made(5)
    d, b = collection(spark, docs, blocks)
    for term in ("alpha", "測試", "的", "a b", "ne"):
        grams = postings.gram_postings(b, min(3, len(term)))
        want = {(x[0], min(y[1] for y in blocks if y[0] == x[0] and term in normalize(y[3]))) for x in blocks if term in normalize(x[3])}
        assert {tuple(r) for r in postings.verified(b, grams, term).collect()} == want


def test_all_terms_passages_take_the_nearest(spark):
    docs = [(1, "/r", "/r/a.txt", "a.txt", ".txt", 1, 0.0, "indexed")]
    lines = {0: "one", 10: "one", 12: "two", 13: "three", 30: "two", 40: "four five"}
    d, b = collection(spark, docs, [(1, o, None, c, f"line {o}") for o, c in lines.items()])
    terms = ["one", "two", "three", "four", "five"]
    rows = passages.all_terms_passages(d.withColumn("ordinal", F.lit(None).cast("int")), b, terms).orderBy("passage").collect()
    assert [(r.ordinal, r.terms, r.source) for r in rows] == [(10, "one", "one"), (12, "two,three", "two\nthree"), (40, "four", "four five")]


def test_context_passages_cover_greedily(spark):
    docs = [(1, "/r", "/r/a.txt", "a.txt", ".txt", 1, 0.0, "indexed")]
    d, b = collection(spark, docs, [(1, 0, None, "one", "l0"), (1, 1, None, "one two", "l1"), (1, 2, "three", "x", "l2"), (1, 3, None, "two one", "l3")])
    rows = passages.context_passages(d, b, ["one", "two", "three"], 3).orderBy("place").collect()
    assert [(r.ordinal, r.rank) for r in rows] == [(1, 1), (2, 2), (3, 1)]


def test_phrase_passages_show_the_representative_first(spark):
    docs = [(1, "/r", "/r/a.txt", "a.txt", ".txt", 1, 0.0, "indexed")]
    d, b = collection(spark, docs, [(1, 0, None, "hit a", "l0"), (1, 4, "hit", "body", "l4"), (1, 6, None, "hit c", "l6")])
    found = search.top(search.matches(d, b, Search("hit")))
    rows = passages.phrase_passages(found, b, "hit").orderBy("place").collect()
    assert [(r.ordinal, r.source) for r in rows] == [(4, "hit"), (0, "hit a")]
    cut = passages.with_snippets(passages.phrase_passages(found, b, "hit"), ["hit"]).orderBy("place").collect()
    assert [(r.snippet, r.snippet_truncated) for r in cut] == [("hit", False), ("hit a", False)]


@pytest.mark.parametrize("source, term", [("x" * 300 + "ﬁne" + "y" * 300, "fine"), ("a" * 20 + "Ｆｕｌｌ", "full"), ("före é after", "é"), ("İstanbul", normalize("İs")), ("ΑΣ word", normalize("ΑΣ")), ("が ガ", "が"), ("tab\t\tand\u3000\u3000wide hit", "hit")])
def test_snippets_hold_the_hit(source, term):
    text, cut = snippet(source, term)
    assert term in normalize(text) and len(text) <= 160 and not cut


def test_snippet_limits():
    assert snippet("m" * 159, "m" * 159) == ("m" * 159, False)
    assert snippet("m" * 159 + " tail", "m" * 159) == ("m" * 159 + "…", False)
    assert snippet("m" * 160 + " tail", "m" * 160) == ("m" * 160, False)
    assert snippet("m" * 200, "m" * 200) == ("m" * 158 + "…", True)
    text, _ = snippet("b" * 100 + "hit" + "a" * 300, "hit")
    assert text == "…" + "b" * 45 + "hit" + "a" * 110 + "…"
    assert snippet("one  \n two hit\t\tthree", "hit") == ("one two hit three", False)
    with pytest.raises(ValueError):
        snippet("nothing", "hit")


def test_terms_types_and_blank_queries():
    assert query_terms("  Ａ b\n", "phrase") == ("a b", ["a b"])
    assert query_terms("B\u3000a  b", "all-terms") == ("b a  b", ["b", "a"])
    assert parse_types(" .MD, txt,md") == [".md", ".txt"]
    for bad in ("", "a,,b", "a/b", "..md", "a.b"):
        with pytest.raises(ValueError):
            parse_types(bad)
    with pytest.raises(ValueError):
        query_terms("\u3000", "phrase")
    assert earliest("B then A", ["a", "b"]) == "b"


def test_grams_are_of_code_points(spark):
    texts = ["", "a", "ab", "abcab", "a\U0001f600b\U0001f600\U0001f600c", "\n\r\n x", "測試測試的"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 2, 3):
        got = [set(r[0]) for r in df.select(grams("t", n)).collect()]
        assert got == [{t[i : i + n] for i in range(len(t) - n + 1)} for t in texts]


def test_blocks_are_made_once(spark):
    """Lines, heading and normal form come once a document, whatever is filtered; line ends of all kinds, as Python's normal form of each line."""
    import re

    from folioscan.sources.corpus import searchable

    texts = ["ﬁrst\r\n \r\rCafé é x\n\nΣΑΣ\nEnd", "a\n \nB", " \n", None]
    rows = [(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate((t, lang) for t in texts for lang in ("fr", "en"))]
    docs, blocks = searchable(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    want = set()
    for i, text, lang, *_ in rows:
        lines = [(n, x) for n, x in enumerate(re.split("\r\n|\n|\r", text or "")) if x.strip("   ")]
        heading = lines[0][1] if lang == "fr" and lines else None
        want |= {(i, n, heading, x, f"line {n + 1}", heading and normalize(heading), normalize(x)) for n, x in lines}
    columns = ["document_id", "ordinal", "heading", "content", "location_value", "heading_norm", "content_norm"]
    assert {tuple(r) for r in blocks.select(columns).collect()} == want
    plan = search.evidence(blocks, ["first", "end"])._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Generate ", 1)
    assert plan.count("ArrowEvalPython") == 1 and "split(" not in above.rpartition("Aggregate")[2] and "Contains(heading" not in below
