import random

import pytest

import corpus_pipeline
from folioscan.llm import decontaminate, mixing, simhash, substrings, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark, and what was planted in them."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    docs, labels, kind = {}, [], {}
    for i in range(400):
        text = prose(rng.randrange(60, 300))
        if i % 10 == 3:
            for _ in range(rng.randrange(3, 9)):
                text.insert(rng.randrange(len(text)), rng.choice(["zqwort", "zqlump", "zqgrub"]))
            kind[i] = "toxic"
        docs[i] = text
        labels.append((i, 1, int(i % 10 == 3)))
    clean = [i for i in docs if i not in kind]
    items = [(k, " ".join(prose(40))) for k in range(6)]
    for k, i in enumerate(clean[10:16]):
        docs[i][30:30] = items[k][1].split()
        kind[i] = "leak"
    for n, i in enumerate(clean[40:60]):
        copy = list(docs[i])
        if n % 2:
            copy[5] = "changed"
        docs[1000 + n] = copy
        kind[1000 + n] = "copy"
    passage = prose(60)
    for i in clean[80:90]:
        docs[i] += passage
        kind[i] = "passage"
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, " ".join(t), "en", f"s{i % 3}", len(" ".join(t))) for i, t in docs.items()]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, kind, " ".join(passage)


def test_stages_on_planted_cases(spark, planted, tmp_path):
    folder, rows, kind, passage = planted
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != "mixing":
            assert docs.columns == before.columns
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in seen.items()}
    every = {r[0] for r in rows}
    of = lambda what: {i for i, k in kind.items() if k == what}
    assert every - ids["toxicity"] == of("toxic")
    assert ids["toxicity"] - ids["simhash"] == of("copy")
    assert ids["substrings"] == ids["simhash"]
    whole = [r.text.count(passage) for r in seen["substrings"].collect()]
    assert sum(whole) == 1 and all(r.n_chars == len(r.text) for r in seen["substrings"].collect())
    assert ids["substrings"] - ids["decontaminate"] == of("leak")
    assert ids["mixing"] == ids["decontaminate"]
    untouched = {r.doc_id: r.text for r in seen["decontaminate"].collect()}
    assert all(untouched[r[0]] == r[1] for r in rows if r[0] not in kind)
    taken = seen["mixing"].groupBy("source_size", "target").sum("taken").collect()
    assert all(abs(r["sum(taken)"] - r.target) <= 400 for r in taken)


def test_run_is_the_chain_of_the_stages(spark, planted):
    folder = planted[0]
    got = sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, items = spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    out = toxicity.without_toxic(docs, labels)
    out = simhash.keep_one(out, **simhash.EIGHTY_PERCENT)
    out = decontaminate.without_leaks(substrings.cleaned(out), items)
    assert got == sorted(map(tuple, mixing.mix(out).select("doc_id", "size", "source_size", "target", "taken").collect()))


def test_odd_tables(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words here", "en", "a", 15), (None, "some words here", "en", "a", 15), (3, "x " * 30000, "en", None, 60000)]
    for name, made, schema in (("documents", rows, DOCS + ", size long, id string"), ("labels", [], "doc_id long, quality int, toxic int"), ("benchmark", [], "item_id long, text string")):
        spark.createDataFrame([(*r, 7, "clash") for r in made] if name == "documents" else made, schema).write.parquet(f"{folder}/{name}.parquet")
    got = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == {1, None, 3}
    empty = str(tmp_path / "empty")
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
