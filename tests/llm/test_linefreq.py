import random
import re

from folioscan.llm import linefreq, queries

DOCS = "doc_id long, text string, source string, lines string, digest int"
SPACE = "\x20\t\n\x0b\x0c\r"


def made(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS)


def slow_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if x.strip(SPACE)]
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(8)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def slow(rows, least=10, share=0.05, left_words=8, left_share=0.3):
    normal = lambda line: " ".join(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[1-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), line))))
    held = lambda text: {normal(x) for x in (text or "").split("\n")} - {""}
    hosts = {}
    for at, (d, text, source) in enumerate(rows):
        own = hosts.setdefault(source, {}).setdefault(("row", at) if d is None else d, set())
        own |= held(text)
    bad = {}
    for source, docs in hosts.items():
        n = {}
        for lines in docs.values():
            for line in lines:
                n[line] = n.get(line, 0) + 1
        bad[source] = {line for line, k in n.items() if k > least and k > share * len(docs)}
    out = []
    for d, text, source in rows:
        base = slow_base(text)
        gone = sum(len(normal(x).split(" ")) for x in (text or "").split("\n") if normal(x) in bad[source])
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        left = base[0] - gone
        out.append((d, *base, failed, not failed and left >= left_words and left >= base[0] * left_share, gone))
    return sorted(out, key=str)


def test_all_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    assert sorted(map(tuple, queries.op3_linefreq(spark, sf).collect()), key=str) == slow(rows)


def test_boilerplate_depletes_documents(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(6))
    menu = "Home | About us | Page 7 of 12 | all rights are reserved here and there"
    rows = []
    for i in range(60):
        text = " ".join(word() for _ in range(30))
        rows.append((i, f"{menu.replace('7', str(20 + i))}\n{text}" if i % 2 else text, "h1"))
    rows += [(100 + i, menu + "\n" + menu + "\n" + " ".join([menu.upper()]) + "\nfew words", "h1") for i in range(3)]
    rows += [(200 + i, "the same copied document " + "with a long line of its own text here " * 2, "h2") for i in range(50)]
    rows += [(300, None, None), (301, "", "h1"), (302, " \n\t\n", "h1"), (None, "x y " * 4000, "h1"), (304, "é ü\xa0ß　ö" * 9, None), (200, rows[-1][1], "h2")]
    got = sorted(map(tuple, linefreq.verdicts(made(spark, rows)).collect()), key=str)
    assert got == slow(rows)
    verdict = {r[0]: (r[6], r[7]) for r in got}
    assert not any(verdict[100 + i][1] for i in range(3)) and all(verdict[i][1] for i in range(60))
    # copies are documents: what 50 of the 50 documents of a host hold is boilerplate there
    assert not any(verdict[200 + i][1] for i in range(50))
    cleaned = {r.doc_id: r.text for r in linefreq.without_boilerplate(made(spark, rows)).collect() if r.doc_id is not None and r.doc_id < 60}
    assert all("Home" not in t and len(t.split()) == 30 for t in cleaned.values())


def test_limits_repeated_ids_and_null_ids(spark):
    line, own = "one two three four five six seven eight nine ten eleven twelve", "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(i, f"{line}\n{own} {i}", "at the limit") for i in range(10)] + [(7, f"{line}\nagain {own}", "at the limit")] * 5
    rows += [(None, f"{line}\n{own} x{i}", "above") for i in range(11)] + [(50 + i, f"{own} {own} {own}", "above") for i in range(9)]
    got = sorted(map(tuple, linefreq.verdicts(made(spark, rows)).collect()), key=str)
    assert got == slow(rows)
    gone = {r[0]: r[-1] for r in got}
    assert gone[7] == gone[0] == 0 and gone[None] == 12
    assert linefreq.without_boilerplate(made(spark, rows)).count() == len(rows)


def test_empty_table(spark):
    assert linefreq.verdicts(made(spark, [])).count() == 0


def test_repeated_windows_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        text = " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60)))
        assert linefreq.measured(text.encode())[:5] == slow_base(text)
