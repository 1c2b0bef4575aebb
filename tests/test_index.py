"""The stored index: packed postings, and searches that read the blocks of candidates only."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan import catalog
from folioscan.operators import postings, search
from folioscan.operators.search import Search
from folioscan.plans.snapshot import SnapshotStore
from folioscan.sources.corpus import searchable, table

SEARCHES = [catalog.PHRASE, catalog.ALL_TERMS, catalog.BY_NAME, Search("thtion"), Search("the"), Search("e"), Search("no such text anywhere"), Search("zq"), Search("doc-7", field="content"), Search("ten nothere", "all-terms"), Search("ten", types=(".md",), sort="modified")]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    docs, blocks = searchable(table(spark, "/root/testdata/sf0.01", "documents"))
    s = SnapshotStore(spark, str(tmp_path_factory.mktemp("index")), target=20)
    s.commit(documents=docs, blocks=blocks, postings=postings.packed(postings.gram_postings(blocks, 1, 2, 3, headings=True)))
    return s


def index(s):
    return postings.Index(lambda grams: s.lookup("postings", grams), s.documents(s.version()))


@pytest.mark.parametrize("what", SEARCHES, ids=lambda s: f"{s.text}-{s.mode}-{s.field}")
def test_pruned_equals_the_scan(stored, what):
    docs = stored.read("documents")
    whole = search.matches(docs, stored.read("blocks"), what)
    found = search.matches(docs, lambda ids: stored.narrowed("blocks", ids), what, index(stored))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))


def test_files_that_are_read(stored):
    every = set(stored.read("blocks").inputFiles())
    once = stored.read("postings").groupBy("gram").agg(F.sum("n").alias("n")).filter("n <= 2 and gram > 4398046511104").orderBy("gram").first()
    rare = index(stored).candidates(postings.gram(once.gram))
    few = stored.narrowed("blocks", rare)
    n = rare.count()
    assert 0 < len(few.inputFiles()) <= min(n, len(every) - 1)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "document_id" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert stored.narrowed("blocks", index(stored).candidates("no such text anywhere")).inputFiles() == []
    assert index(stored).candidates("e") is None  # nearly everywhere: a scan is shorter


def test_more_candidates_than_are_listed(stored, monkeypatch):
    from folioscan.plans import snapshot

    ids = stored.read("documents").filter("id < 40").select("id")
    want = sorted(map(tuple, stored.read("blocks").filter("document_id < 40").collect()))
    for listed in (1000, 5):
        monkeypatch.setattr(snapshot, "LISTED", listed)
        assert sorted(map(tuple, stored.narrowed("blocks", ids).collect())) == want


def test_packed_rows(spark, monkeypatch):
    monkeypatch.setattr(postings, "PACK", 7)
    rng = np.random.default_rng(2)
    rows = {(int(g), int(d)) for g, d in zip(rng.integers(0, 6, 400) ** 2, rng.integers(-50, 400, 400) * 3, strict=True)} | {(7, 5), (7, 5 + (1 << 33)), (7, (1 << 62))}
    df = spark.createDataFrame(sorted(rows) + sorted(rows)[:50], postings.POSTINGS).repartition(5)  # some twice
    packed = postings.packed(df)
    told = packed.collect()
    assert all(r.n <= 16 * 4096 and (r.n == 1) == (r.first == r.last) for r in told)
    assert sorted(map(tuple, postings.unpacked(packed).collect())) == sorted(rows)
    assert postings.packed(df.limit(0)).count() == 0
    assert packed.groupBy().agg(F.sum("n")).first()[0] == len(rows)


def test_postings_of_some_terms(spark):
    """As all postings, less the grams that the terms do not ask for."""
    _, blocks = searchable(table(spark, "/root/testdata/sf0.001", "documents"))
    terms = ("the than", "re")
    some = postings.gram_postings(blocks, 1, 2, 3, headings=True, terms=terms)
    wanted = [postings.number(g) for t in terms for g in postings.query_grams(t)]
    whole = postings.gram_postings(blocks, 1, 2, 3, headings=True)
    rows = sorted(map(tuple, some.collect()))
    assert rows and rows == sorted(map(tuple, whole.filter(whole.gram.isin(wanted)).collect()))
