"""Token alignment against plain loops over whole encodings."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from folioscan.llm import alignment
from folioscan.llm.common import table


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(alignment.A_FILE)
    a.encode_special_tokens = True
    letter = alignment.byte_letters()
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.B_FILE)
    return a, lambda i: bytes(letter[c] for c in a.id_to_token(i)), b, lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()


def plain(rows, both):
    """Whole texts encoded at once, every pair of overlapping tokens listed."""
    a, a_bytes, b, b_bytes = both
    told, pairs = [], Counter()
    for doc, text in rows:
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if b"".join(map(a_bytes, ia)) != want or b"".join(map(b_bytes, ib)) != want:
            ia = ib = []
        spans = []
        for ids, of in ((ia, a_bytes), (ib, b_bytes)):
            at, mine = 0, []
            for i in ids:
                mine.append((at, at + len(of(i)), i))
                at += len(of(i))
            spans.append(mine)
        links, k = [], 0
        for s, e, i in spans[0]:
            while k and spans[1][k][0] > s:
                k -= 1
            while spans[1][k][1] <= s:
                k += 1
            m = k
            while m < len(spans[1]) and spans[1][m][0] < e:
                links.append((i, spans[1][m][2]))
                m += 1
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, last = [], 0
        for cut in ends:
            groups.append("|".join(",".join(str(i) for s, e, i in side if last <= s and e <= cut) for side in spans) if len(text) < 3000 else "")
            last = cut
        pairs.update(links)
        told.append((doc, len(ia), len(ib), len(ends), links, (hashlib.sha256(";".join(groups).encode()).hexdigest() if ia else "") if len(text or "") < 3000 else None))
    most = Counter()
    for (_, j), n in pairs.items():
        most[j] = max(most[j], n)
    return {d: (na, nb, ng, len(li), sum(pairs[x] == most[x[1]] for x in li), sum(pairs[x] for x in li), sha) for d, na, nb, ng, li, sha in told}


def checked(found, rows, both):
    want = plain(rows, both)
    got = {r["doc_id"]: tuple(r)[1:] for r in found.collect()}
    assert got.keys() == want.keys()
    for d, w in want.items():
        assert got[d][:-1] == w[:-1], d
        assert w[-1] is None or got[d][-1] == w[-1], d


def test_whole_table(spark, sf, both):
    docs = table(spark, sf, "documents")
    checked(alignment.aligned(docs), [(r["doc_id"], r["text"]) for r in docs.collect()], both)


def test_odd_texts(spark, both):
    odd = ["", None, " ", "  ", "a", " a", "a ", "a  b", "a \n b\n\n  c", "\t\tx\r\n", "x▁y ▁z", "<s> </s> <0x41> <|endoftext|>", "café naïve   　 z", "你好 世界", "é ﬁ \U0001f600\U0001f680 ok", "it's we'll 've'd", "1234567 8 9", "a\x00b \x1c c\x1d d", "word " * 400, "ab" * 2000, "   x\u0085y z", "a ▁ b", "‍ ‍"]
    rng = random.Random(3)
    alphabet = ["a", "b", " ", " ", "\n", "\t", " ", "'s", "1", "!", "é", "中", "▁", "the", "\U0001f600", "　", "\x1c"]
    odd += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(600)]
    rows = list(enumerate(odd))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    checked(alignment.aligned(df), rows, both)


def test_segments_are_those_of_the_whole(both):
    """Slabs of every size and a forgetful encoder give the same tokens."""
    a, _, b, _ = both
    enc = alignment.Encoder(alignment.A_FILE, alignment.B_FILE)
    texts = ["the quick  brown\n fox's 12 tails", "naïve 你好 the the the", "x"]
    for keep in (200_000, 0):
        alignment.KEPT_SEGMENTS, was = keep, alignment.KEPT_SEGMENTS
        for t in texts * 2:
            got = enc.tokens(enc.numbers([enc.segments(t)])[0])
            assert got[0].tolist() == a.encode(" " + t).ids and got[1].tolist() == b.encode(t)
        alignment.KEPT_SEGMENTS = was


def test_nulls_repeats_and_empty_table(spark):
    rows = [(None, "same text"), (None, "same text"), (1, "same text"), (1, "other"), (2, None)]
    found = alignment.aligned(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS slab", "1 AS pairs")).collect()
    assert sorted((str(r["doc_id"]), r["n_a"] > 0, r["groups_sha256"] == "") for r in found) == [("1", True, False), ("1", True, False), ("2", False, True), ("None", True, False), ("None", True, False)]
    assert {r["count_sum"] / r["n_links"] for r in found if r["doc_id"] is None} == {3.0}
    assert alignment.aligned(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pair_counts(spark):
    found = alignment.alignments(spark.createDataFrame([(1, "a b a"), (2, "a")], "doc_id long, text string"))
    rows = {(r["a"], r["b"]): (r["count"], r["best"]) for r in alignment.pair_counts(found).collect()}
    assert sorted(n for n, _ in rows.values()) == [1, 3] and all(best for _, best in rows.values())
