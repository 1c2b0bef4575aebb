import random
import re

from folioscan.llm import licenses, queries

DOCS = "doc_id long, text string, labels string, words int"


def made(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS)


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow(rows, threshold=0.8):
    templates = [(label, words(t)) for label, t in licenses.TEMPLATES + licenses.IDENTIFIERS]
    pairs = lambda w: {(w[i], w[i + 1]) for i in range(len(w) - 1)}

    def held(template, block):
        t, b = set(template), set(block)
        n, near = len(t & b), pairs(template)
        need, need_near = (1.0, 1.0) if len(t) < 10 else (threshold, 0.5)
        return n if n / len(t) >= need - 1e-9 and len(near & pairs(block)) >= need_near * len(near) else 0

    out = []
    for doc, text in rows:
        w = words(text)
        places = [(label, i) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        best, found = 0.0, set()
        for label, template in templates:
            step = 8
            while step < 1.25 * len(template):
                step *= 2
            for at in range(0, max(1, len(w) - step), step):
                block = w[at : at + 2 * step]
                n = held(template, block)
                if not n:
                    continue
                rank = (n / len(set(template)), n)
                best = max(best, rank[0])
                rivals = [u for other, u in templates if other != label and 2 * len(set(template) & set(u)) >= len(set(template) | set(u))]
                around = [w[b : b + 2 * step] for b in range(0, max(1, len(w) - step), step) if abs(b - at) <= step]
                if not any((held(u, b) / len(set(u)), held(u, b)) > rank for u in rivals for b in around):
                    found.add(label)
        base = {label for label, _ in places}
        at = [i for _, i in places]
        out.append((doc, len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if places else best))
    return sorted(out, key=str)


def test_all_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op7_licenses(spark, sf).collect()), key=str) == slow(rows)


def test_blocks_against_brute_force(spark):
    rng = random.Random(4)
    pool = [w for _, t in licenses.TEMPLATES for w in t.split()]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            _, t = rng.choice(licenses.TEMPLATES)
            w = t.split()
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(pool)
            if rng.random() < 0.5:
                rng.shuffle(w)
            cut = rng.randrange(len(w))
            parts += [" ".join(w[:cut]) + rng.choice(["\n", " ", "\n\n"]) + " ".join(w[cut:]), " ".join(rng.choice(pool) for _ in range(rng.randrange(40)))]
        rows.append((i, rng.choice(["\n", "\n \n"]).join(parts)))
    rows += [(500 + i, f"{t} {u}\n{t}") for i, ((_, t), (_, u)) in enumerate((rng.choice(licenses.IDENTIFIERS), rng.choice(licenses.TEMPLATES + licenses.IDENTIFIERS)) for _ in range(60))]
    rows += [(1000, "filler line here\n" * 400 + licenses.TEMPLATES[9][1].replace(" ", "\n") + "\nfiller line here" * 400)]
    rows += [(None, None), (1001, ""), (1002, "CC-BY-NC cc by nc; CC.BY.NC"), (1002, "CC-BY-NC cc by nc; CC.BY.NC"), (1003, "é`under`the[MIT]license_under the mit license9"), (1004, "mit " * 60000)]
    for threshold in (0.8, 0.9, 1.0):
        got = licenses.labelled(made(spark, rows), threshold=threshold).collect()
        assert sorted(map(tuple, got), key=str) == slow(rows, threshold)


def test_empty_table(spark):
    assert licenses.labelled(made(spark, [])).count() == 0


def test_versions_are_told_apart(spark):
    rows = [(1, "This work is licensed under the GNU General Public License, version 3."), (2, "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"), (3, "This work is licensed under the GNU General Public License.")]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.labelled(made(spark, rows)).collect()}
    assert got[1] == ("gpl-3", 1.0) and got[2] == ("cc-by-sa", 1.0) and got[3][0] == "gpl-2,gpl-3" and 0.8 <= got[3][1] < 1


def test_words_of_a_license_in_prose_are_no_license(spark):
    rng = random.Random(8)
    pool = [w.lower().strip(".,") for _, t in licenses.TEMPLATES for w in t.split()]
    rows = [
        (1, "the new album was released today and the license fees fall under a separate contract"),
        (2, "the film was released into the free market; unencumbered by rights and this software of the public is now domain of all"),
        (3, "Version 2 of the public bus is licensed, and under general law this work is the gnu of all"),
        (4, " ".join(rng.choice(pool) for _ in range(20000))),
        (5, ("a public license, under the law, is granted and the software of any person is free of charge for the work " * 300)),
    ]
    prose = "the of and to in a is that for it with as was on be by this are from at or an not under general public work free license version software any use".split()
    rows += [(100 + i, " ".join(rng.choice(prose) for _ in range(rng.randrange(5, 60)))) for i in range(10000)]
    assert {(r.doc_id, r.labels, r.score) for r in licenses.labelled(made(spark, rows)).filter("labels <> '' or score > 0").collect()} == set()


def test_notices_in_long_lines_and_over_lines(spark):
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet under the of and".split()) for _ in range(n))
    rows = []
    for i, (_, t) in enumerate(licenses.TEMPLATES):
        rows += [(i, f"{prose(rng.randrange(3000))} {t}. {prose(rng.randrange(3000))}"), (100 + i, prose(50) + "\n" + t.replace(" ", "\n") + "\n" + prose(7))]
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.labelled(made(spark, rows)).collect()}
    assert all(licenses.TEMPLATES[d % 100][0] in labels for d, labels in got.items())


def test_all_blocks_with_their_order(spark):
    rng = random.Random(3)
    long, short = licenses.TEMPLATES[9][1], licenses.TEMPLATES[0][1]
    mixed = long.split()
    rng.shuffle(mixed)
    rows = [(1, long), (2, " ".join(mixed)), (3, "released under the GPL License"), (4, "nothing of that kind")]
    got = {r.doc_id: [b for b in r.blocks if b.containment < 1 or b.label == "bsd"] for r in licenses.scan(made(spark, rows), templates=[licenses.TEMPLATES[9], ("mit", short)]).collect()}
    assert [(b.containment, b.order, b.firm, b.best) for b in got[1]] == [(1.0, 1.0, True, True)]
    assert len(got[2]) == 1 and got[2][0].containment == 1.0 and got[2][0].order < 0.5 and not got[2][0].firm and not got[2][0].best
    assert [(b.label, b.containment, b.firm) for b in got[3]] == [("mit", 0.8, False)] and got[3][0].order == 0.5
    assert got[4] == [] and {(r.doc_id, r.labels) for r in licenses.labelled(made(spark, rows)).collect()} == {(1, "bsd"), (2, ""), (3, ""), (4, "")}


def test_spdx_lines_links_and_bodies(spark):
    rows = [
        (1, "// SPDX-License-Identifier: Apache-2.0\nint main() {}"), (2, "see https://creativecommons.org/licenses/by-sa/4.0/ for it"), (3, "# SPDX-License-Identifier: GPL-3.0-or-later"),
        (4, "shared under http://creativecommons.org/licenses/by/4.0/."), (5, "an identifier of the license, spdx or not, mit or bsd"), (6, "apache 2.0 web server, identifier and license by spdx"),
        (7, 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
        (8, "4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ]
    got = {r.doc_id: r.labels for r in licenses.labelled(made(spark, rows)).collect()}
    assert got == {1: "apache-2", 2: "cc-by-sa", 3: "gpl-3", 4: "cc-by", 5: "", 6: "", 7: "mit", 8: "bsd"}
