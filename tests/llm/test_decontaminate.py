import random

import numpy as np

from folioscan.llm import decontaminate, queries

DOCS = "doc_id long, text string, item_id long, score double"
ITEMS = "item_id long, text string, doc_id long"


def slow_align(item, passage, miss=-0.5, gap=-0.5):
    best = 0.0
    rows = [[0.0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            rows[i][j] = max(0.0, rows[i - 1][j - 1] + (1.0 if a == b else miss), rows[i - 1][j] + gap, rows[i][j - 1] + gap)
            best = max(best, rows[i][j])
    return best


def made(spark, docs, items):
    return spark.createDataFrame([(*d, 7, 0.1) for d in docs], DOCS), spark.createDataFrame([(*i, 3) for i in items], ITEMS)


def corpus(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6))) for _ in range(700)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, text(rng.randrange(15, 60))) for i in range(30)]
    docs, truth = [], {}
    for d in range(240):
        body = text(rng.randrange(30, 400))
        if d % 3 == 0:
            number, copy = items[d % 30][0], list(items[d % 30][1])
            for at in rng.sample(range(len(copy)), len(copy) // 7 * (d % 2)):
                copy[at] = rng.choice(words)
            if d % 4 == 0:
                del copy[len(copy) // 2]
            at = rng.randrange(len(body))
            body[at:at] = copy
            truth[d] = number
        docs.append((d, " ".join(body)))
    return docs, [(i, " ".join(w)) for i, w in items], truth


def test_planted_exact_and_edited_copies(spark):
    docs, items, truth = corpus()
    got = decontaminate.leaks(*made(spark, docs, items)).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= set(truth.items())
    words = {i: decontaminate.word_hashes(t.encode()) for i, t in items}
    for d, t in docs[:60]:
        own = decontaminate.word_hashes(t.encode())
        close = {i for i, w in words.items() if slow_align(w.tolist(), own.tolist()) >= 0.5 * len(w) - 1e-9}
        assert {r.item_id for r in got if r.doc_id == d} == close
    for r in got:
        passage = docs[r.doc_id][1].split()[r.start_word : r.end_word]
        assert slow_align(dict(items)[r.item_id].split(), passage) / len(words[r.item_id]) >= r.score - 1e-9


def test_all_pairs_of_documents_and_items(spark):
    """Every document of the 0.01 scale, and edited copies of passages of it, against every item by plain alignment."""
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    rng = random.Random(21)
    for i, (number, text) in enumerate(items * 4):
        copy, around = text.split(), docs[rng.randrange(len(docs))][1].split()[:200]
        for at in rng.sample(range(len(copy)), len(copy) * rng.randrange(0, 6) // 10):
            copy[at : at + 1] = [rng.choice(["edited", "words here", ""])]
        docs.append((10_000 + i, " ".join(around[:90] + copy + around[90:])))
    words = {i: decontaminate.word_hashes(t.encode()) for i, t in items}
    want, seedless = set(), set()
    for d, text in docs:
        own = decontaminate.word_hashes((text or "").encode())
        seeds = set(decontaminate.grams(own, 3).tolist())
        for i, w in words.items():
            if np.isin(w, own).sum() >= 0.5 * len(w) and decontaminate.align(w, own, -0.5, -0.5)[0] >= 0.5 * len(w) - 1e-9:
                (want if seeds & set(decontaminate.grams(w, 3).tolist()) else seedless).add((d, i))
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert len(want) > 80 and not seedless


def test_items_of_one_and_two_words(spark):
    docs = [(1, "there is a Zyxgloria here"), (2, "alpha beta gamma"), (3, "beta alpha, gamma"), (4, "ALPHA-beta"), (5, None), (6, "three word item"), (7, "three item word")]
    items = [(10, "zyxgloria"), (11, "alpha beta"), (12, "three word item"), (13, ""), (14, None), (15, "absent")]
    got = {(r.doc_id, r.item_id, r.score) for r in decontaminate.leaks(*made(spark, docs, items)).collect()}
    assert got == {(1, 10, 1.0), (2, 11, 1.0), (4, 11, 1.0), (6, 12, 1.0)}


def test_chunks_give_the_same_pairs(spark):
    docs, items, _ = corpus(9)
    pair = made(spark, docs, items)
    want = sorted(map(tuple, decontaminate.leaks(*pair).collect()))
    assert sorted(map(tuple, decontaminate.leaks(*pair, chunk_words=100).collect())) == want
    kept = decontaminate.without_leaks(*pair, chunk_words=100)
    assert kept.columns == ["doc_id", "text", "item_id", "score"]
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {r[0] for r in want}


def test_an_item_that_leaked_everywhere_is_found(spark):
    item = " ".join(f"word{i}" for i in range(20))
    docs = [(i, f"intro {i} {item} outro {i * 7}") for i in range(300)]
    got = decontaminate.leaks(*made(spark, docs, [(1, item)])).collect()
    assert len(got) == 300 and {r.score for r in got} == {1.0}


def test_a_repeated_edited_passage_is_found(spark):
    words = [f"word{i}" for i in range(40)]
    edited = {step: " ".join(f"other{i}" if i % step == step - 1 else w for i, w in enumerate(words)) for step in (4, 5, 6)}
    for step, passage in edited.items():
        docs = [(i, f"intro {i} {passage} outro {i * 7}") for i in range(1000)] + [(1000 + i, f"plain text {i} word1 word2") for i in range(50)]
        pair = made(spark, docs, [(1, " ".join(words))])
        score = slow_align(words, passage.split()) / 40
        got = decontaminate.leaks(*pair).collect()
        assert {r.doc_id for r in got} == set(range(1000)) and {r.score for r in got} == {score}, step
        assert {r.doc_id for r in decontaminate.without_leaks(*pair).collect()} == set(range(1000, 1050))


def test_seeds_far_apart_in_a_long_text(spark):
    rng = random.Random(8)
    item = [f"word{i}" for i in range(40)]
    text = [w for _ in range(300) for at in [rng.randrange(38)] for w in [*item[at : at + 3], *(f"x{rng.randrange(900)}" for _ in range(30))]]
    docs = [(1, " ".join(text)), (2, " ".join(text + item + text))]
    got = decontaminate.leaks(*made(spark, docs, [(5, " ".join(item))])).collect()
    assert [(r.doc_id, r.item_id, r.score, r.start_word, r.end_word) for r in got] == [(2, 5, 1.0, len(text), len(text) + 40)]


def test_odd_rows(spark):
    item = "one two three four five six seven eight"
    docs = [(1, None), (2, ""), (3, item.upper().replace(" ", ", ")), (3, item.upper().replace(" ", ", ")), (None, item), (4, "x " * 50000 + item + " y" * 50000 + " " + item), (5, "one two")]
    items = [(1, item), (1, item), (2, "one two"), (3, None), (4, ""), (None, item)]
    got = decontaminate.leaks(*made(spark, docs, items)).collect()
    assert len(got) == 4 * 3 + 5 and {r.score for r in got} == {1.0}
    assert {r.n_passages for r in got if r.doc_id == 4} == {2}
    assert decontaminate.leaks(*made(spark, [], items)).count() == 0
    assert decontaminate.leaks(*made(spark, docs, [])).count() == 0


def test_alignment_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 14))] for _ in range(2))
        assert abs(decontaminate.align(np.array(a, np.uint64), np.array(b, np.uint64), -0.5, -0.5)[0] - slow_align(a, b)) < 1e-9


def test_query_finds_every_whole_copy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    whole = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    assert {(r.doc_id, r.item_id) for r in queries.op6_decontaminate(spark, sf).collect()} >= whole


def zipf(rng, n, rank=50_000):
    """Words by Zipf's law."""
    share = 1 / np.arange(1, rank + 1)
    return [f"w{x}" for x in rng.choice(rank, n, p=share / share.sum())]


def test_cost_does_not_grow_with_the_items():
    """Ten times the items: seeds name few of them."""
    rng = np.random.default_rng(1)
    docs = [decontaminate.word_hashes(" ".join(zipf(rng, 1000)).encode()) for _ in range(10)]
    said = zipf(rng, 800_000)
    met, most = [], 0
    for n in (2_000, 20_000):
        index = decontaminate.Index.of([(i, " ".join(said[40 * i : 40 * i + 40]).encode()) for i in range(n)], 3)
        found = [index.candidates(d)[1] for d in docs]
        met.append(sum(len(np.unique(f)) for f in found) / len(docs))
        most = max(most, max(np.diff(index.seeds.first)))
    every = decontaminate.Index.of([(i, " ".join(said[40 * i : 40 * i + 40]).encode()) for i in range(20_000)], 3, rare=10**9)
    assert most <= 8 and met[1] < 0.3 * sum(len(np.unique(every.candidates(d)[1])) for d in docs) / len(docs), (met, most)


def test_frequent_seeds_lose_no_pair():
    """Items that share much: every edited copy against all items, as with all n-grams as seeds."""
    rng = np.random.default_rng(7)
    stock = [zipf(rng, 6, 300) for _ in range(40)]
    items = [(i, " ".join(w for k in range(5) for w in [*stock[int(rng.integers(40))], *zipf(rng, 4, 3000)]).encode()) for i in range(300)]
    every, seeds = decontaminate.Index.of(items, 3, rare=10**9), decontaminate.Index.of(items, 3, rare=4)
    n = 0
    for i in range(150):
        words = items[int(rng.integers(300))][1].decode().split()
        for _ in range(len(words) // int(rng.integers(4, 9))):
            at = int(rng.integers(len(words)))
            words[at : at + int(rng.integers(2))] = [["edited"], ["two", "words"], []][int(rng.integers(3))]
        doc = decontaminate.word_hashes(" ".join(zipf(rng, 30) + words + zipf(rng, 30)).encode())
        want, got = (sorted(decontaminate.leaks_of(doc, x, 0.5, -0.5, -0.5)) for x in (every, seeds))
        assert [x[:2] for x in got] == [x[:2] for x in want]
        n += len(want)
    assert n > 100


def test_equal_items_each_match(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my"
    got = decontaminate.leaks(*made(spark, [(1, f"x {text} y")], [(5, text), (6, text.upper()), (7, "nothing of it at all in here")])).collect()
    assert sorted((r.item_id, r.score) for r in got) == [(5, 1.0), (6, 1.0)]
