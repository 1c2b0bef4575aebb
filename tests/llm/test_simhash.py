import random

import numpy as np
import xxhash

from folioscan.llm import components, near, queries, simhash
from folioscan.llm.hashing import xxh64_spans

DOCS = "doc_id long, text string, fp string, key int"


def made(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS)


def slow_fp(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(rows, most=2):
    fps = [slow_fp(t) for _, t in rows]
    distinct = sorted(set(fps))
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    arr = np.array(distinct, np.uint64)
    for i, f in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= most):
            root[find(f)] = find(distinct[i + 1 + int(j)])
    least = {}
    for (d, _), f in zip(rows, fps):
        r = find(f)
        least[r] = min(least.get(r, d), d)
    return sorted((d, f"{f:016x}", least[find(f)]) for (d, _), f in zip(rows, fps))


def test_vector_hash_equals_the_library():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(5000))
    spans = [(a, a + n) for n in [*range(80), 127, 128, 500, 513, 2000] for a in (0, 7, 1234)]
    got = xxh64_spans(np.frombuffer(data, np.uint8), np.array([s for s, _ in spans]), np.array([e for _, e in spans]))
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(data[s:e], 42) for s, e in spans]


def test_against_brute_force_on_all_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.op2_simhash(spark, sf).collect())
    assert got == slow_components(rows)


def test_hand_made_rows(spark):
    long = " ".join(f"w{i % 97}x{i}" for i in range(4000))
    rows = [(9, "A b  C"), (4, "a B\tc"), (7, None), (3, ""), (8, " \n"), (2, "x"), (5, long), (1, long + " end"), (6, "É b"), (10, "é b")]
    got = sorted(tuple(r) for r in simhash.near_duplicates(made(spark, rows)).collect())
    assert got == slow_components(rows)


def test_empty_null_and_repeated_ids(spark):
    assert simhash.near_duplicates(made(spark, [])).count() == 0
    rows = [(None, "one two three"), (5, "one two three"), (None, "lonely words here"), (6, "left text"), (6, "right text"), (4, "right text"), (6, "left text")]
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(made(spark, rows)).collect()}
    assert got >= {(None, 5), (5, 5), (6, 4), (4, 4)}
    assert len(simhash.near_duplicates(made(spark, rows)).collect()) == len(rows)
    assert sorted(str(r.doc_id) for r in simhash.keep_one(made(spark, [(1, "a b c d"), (1, "a b c d"), (2, "A b c d")])).collect()) == ["1"]


def test_null_ids_are_documents_of_their_own(spark):
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40))
    alone, copied, nameless = [text() for _ in range(20)], text(), text()
    rows = [(None, t) for t in alone] + [(5, copied), (None, copied), (None, nameless), (None, nameless.upper()), (None, nameless), (9, text())]
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(made(spark, rows)).collect()}
    assert len(got) == 20 + 2 + 1 + 1
    assert {k: c for k, c in got.items() if c is not None} == {(5, f"{slow_fp(copied):016x}"): 5, (None, f"{slow_fp(copied):016x}"): 5, (9, f"{slow_fp(rows[-1][1]):016x}"): 9}
    for how in ({}, simhash.EIGHTY_PERCENT):
        kept = [(r.doc_id, r.text) for r in simhash.keep_one(made(spark, rows), **how).collect()]
        assert len(kept) == 23 and {t for d, t in kept if d is None} - {nameless, nameless.upper()} == set(alone)
        assert {(d, t) for d, t in kept if d is not None} == {(5, copied), rows[-1]}


def test_rows_of_one_id_with_other_texts_stay(spark):
    rows = [(6, "left text of the one row"), (6, "right words in another row"), (6, "Left text  of the one row"), (4, "right words in another row"), (6, "left text of the one row")]
    kept = sorted((r.doc_id, r.text.lower().split()[0]) for r in simhash.keep_one(made(spark, rows), **simhash.EIGHTY_PERCENT).collect())
    assert kept == [(4, "right"), (6, "left")]


def test_hot_block_by_star_and_by_tiles(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(3))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)})
    classes = spark.createDataFrame([(bytearray(f.to_bytes(8, "big")), i) for i, f in enumerate(fps)], "fp binary, node long")
    want = {}
    arr = np.array(fps, np.uint64)
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2]
    edges = spark.createDataFrame(pairs, "a long, b long")
    want = {tuple(r) for r in components.components(edges).collect()}
    for tile in (8, 4096):
        got = {tuple(r) for r in components.components(simhash.links(classes, 1, 2, 2, tile)).collect()}
        assert got == want
    three = {tuple(r) for r in components.components(spark.createDataFrame([(i, j) for i in range(len(fps)) for j in range(i) if int(np.bitwise_count(arr[i] ^ arr[j])) <= 3], "a long, b long")).collect()}
    got = {tuple(r) for r in components.components(simhash.links(classes, 1, 1, 3, 16)).collect()}
    assert got == three


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {tuple(r) for r in components.components(edges).collect()}
    assert got == {(i, 0) for i in range(1, 201)} | {(501, 500)}


def jaccard(a, b):
    return simhash.similarity(simhash.shingle_set(a.encode(), 5), simhash.shingle_set(b.encode(), 5))


def test_eighty_percent_against_brute_force(spark):
    """Edited copies on both sides of the threshold: no link under it, none of the others lost; recall by similarity is that of the blocks."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(2000)]
    rows, truth = [], {}
    for i in range(150):
        text = [rng.choice(words) for _ in range(300)]
        other = list(text)
        for at in rng.sample(range(0, 300, 5), rng.randrange(1, 14)):
            other[at] = rng.choice(words)
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(other))]
        truth[2 * i + 1] = jaccard(rows[-2][1], rows[-1][1])
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(made(spark, rows), **simhash.EIGHTY_PERCENT).collect()}
    assert all(got[d] // 2 == d // 2 for d in got)
    assert {b for b, j in truth.items() if j < 0.8 and got[b] != b} == set()
    close = [b for b, j in truth.items() if 0.8 <= j < 0.85]
    assert len(close) >= 15 and sum(got[b] == b - 1 for b in close) >= 0.9 * len(close)
    assert all(got[b] == b - 1 for b, j in truth.items() if j >= 0.85)


def test_open_links_of_a_group_are_those_of_the_closest_pairs(spark):
    """One text with many edits, tiles of two rows: the groups are those of an exact comparison of all pairs."""
    rng = random.Random(15)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(900)]
    base = [rng.choice(words) for _ in range(200)]
    texts = [base]
    for n in range(40):
        other = list(rng.choice(texts))
        for at in rng.sample(range(200), rng.choice([1, 2, 4, 9])):
            other[at] = rng.choice(words)
        texts.append(other)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100 + i, " ".join(t)) for i, t in enumerate(texts[:5])]
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, s) in enumerate(rows):
        for b, t in rows[:i]:
            if jaccard(s, t) >= 0.8:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    for other in ({"tile": 2}, {"tile": 4096}, {"block_bytes": 3, "tables": 32, "max_distance": 4 * 100}):
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(made(spark, rows), **(simhash.EIGHTY_PERCENT | other)).collect()}
        assert got == {d: find(d) for d in root}


def test_nearest_forest_joins_what_all_pairs_join():
    r = np.random.default_rng(2)
    for _ in range(50):
        a, b = r.integers(0, 30, 60), r.integers(0, 30, 60)
        apart = r.integers(1, 9, 60)
        a, b, apart = a[a != b], b[a != b], apart[a != b]
        x, y, d = near.nearest_forest(a, b, apart, 3)
        for most in range(1, 9):
            keep, all_ = (d <= most) if most >= 3 else (d < 0), apart <= most
            if most >= 3:
                one = dict(zip(*near.forest(x[keep], y[keep]))) if keep.any() else {}
                assert one == (dict(zip(*near.forest(a[all_], b[all_]))) if all_.any() else {})
        assert len(x) < 30


def test_components_of_a_hub(spark):
    edges = [(0, i) for i in range(1, 400)] + [(399, 1000 + i) for i in range(400)] + [(5000, 5001)]
    got = {tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long"), most=8).collect()}
    assert got == {(i, 0) for i in range(1, 400)} | {(1000 + i, 0) for i in range(400)} | {(5001, 5000)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_that_differ_in_other_columns_only(spark):
    rows = [(1, "a b c d", "z", 3), (1, "a b c d", "b", 9), (1, "a b c d", "b", 2)]
    for n in (1, 3):
        docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, key int").repartition(n)
        assert [tuple(r) for r in simhash.keep_one(docs, **simhash.EIGHTY_PERCENT).collect()] == [(1, "a b c d", "b", 2)]


def test_random_groups_equal_brute_force(spark):
    """300 groups of six texts around 0.8: no group is joined that no pair joins, and next to none is split."""
    rng = random.Random(8)
    rows, want = [], {}
    for g in range(300):
        size = rng.choice([40, 80, 150, 300])
        texts = [[f"g{g}w{rng.randrange(400)}" for _ in range(size)]]
        for _ in range(5):
            other = list(rng.choice(texts))
            for at in rng.sample(range(size), rng.randrange(1, max(2, size // 25))):
                other[at] = f"new{rng.randrange(10**6)}"
            texts.append(other)
        mine = [(6 * g + i, " ".join(t)) for i, t in enumerate(texts)]
        rows += mine
        root = {d: d for d, _ in mine}
        for _ in range(6):
            for i, (a, s) in enumerate(mine):
                for b, t in mine[:i]:
                    if jaccard(s, t) >= 0.8:
                        root[a] = root[b] = min(root[a], root[b])
        want |= root
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(made(spark, rows), **simhash.EIGHTY_PERCENT).collect()}
    assert all(want[d] == want[c] for d, c in got.items())
    assert len({d // 6 for d in want if got[d] != want[d]}) <= 3
    assert 100 < len(set(want.values())) - 300  # some groups fall apart


def test_columns_with_the_helpers_names(spark):
    rows = [(i, "some words of one text that is a copy", f"keep{i}", i, "x") for i in range(3)] + [(9, "another text with other words in it altogether", "keep9", 9, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __folio_row string, folio_row int, FOLIO_first string")
    got = simhash.keep_one(df, **simhash.EIGHTY_PERCENT)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[3]]
