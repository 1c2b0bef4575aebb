"""Writers that meet: commits check what they were prepared on."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from folioscan.api import Collection
from folioscan.plans.snapshot import Conflict, SnapshotStore

DOCS, BLOCKS = "id long, path string, size_bytes long", "document_id long, ordinal int, content string"


def tree(top, folder, names):
    (top / folder).mkdir(parents=True, exist_ok=True)
    for n in names:
        (top / folder / f"{n}.txt").write_text(f"hello {folder} {n}")
    return str(top / folder)


def test_two_writers_keep_all_documents(spark, tmp_path):
    """Writer A has read and parsed folder a; B commits folder b meanwhile; then A commits."""
    a, b = tree(tmp_path, "a", "xyz"), tree(tmp_path, "b", "uvw")
    c, other = (Collection(spark, str(tmp_path / "store")) for _ in range(2))
    patch, between = c.store.patch, []

    def late(*args, **how):
        between.append(other.index(b)["version"])
        return patch(*args, **how)

    c.store.patch = late
    assert c.index(a)["version"] == between[0] + 1 and len(between) == 1  # no second try: nothing that A touches has changed
    docs = c.store.read("documents").collect()
    assert len({d.id for d in docs}) == len(docs) == 6 and c.search("hello").count() == 6
    assert c.roots() == [a, b]


def test_the_same_folder_twice(spark, tmp_path):
    """Both add the same paths: the slower one meets a conflict, reads again and finds nothing to do."""
    a = tree(tmp_path, "a", "xyz")
    c, other = (Collection(spark, str(tmp_path / "store")) for _ in range(2))
    patch, met = c.store.patch, []

    def late(*args, **how):
        if not met:
            other.index(a)
        try:
            return patch(*args, **how)
        except Conflict as found:
            met.append(found)
            raise

    c.store.patch = late
    told = c.index(a)
    assert len(met) == 1 and told["reasons"] == {"unchanged": 3}
    assert c.store.read("documents").count() == 3 and c.search("hello").count() == 3


def test_writers_in_threads(spark, tmp_path):
    folders = [tree(tmp_path, f"f{i}", "ab") for i in range(4)]
    store = str(tmp_path / "store")
    Collection(spark, store)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda f: Collection(spark, store).index(f), folders))
    c = Collection(spark, store)
    docs = c.store.read("documents").collect()
    assert len({d.id for d in docs}) == len(docs) == 8 and c.roots() == folders and c.search("hello").count() == 8


@pytest.fixture
def store(spark, tmp_path):
    s = SnapshotStore(spark, str(tmp_path / "s"))
    s.commit(documents=spark.createDataFrame([(i, f"/d/{i}", 1) for i in range(100)], DOCS), blocks=spark.createDataFrame([(i, 0, "old") for i in range(100)], BLOCKS))
    return s


def change(spark, ids, word):
    return {"documents": spark.createDataFrame([(i, f"/d/{i}", 2) for i in ids], DOCS), "blocks": spark.createDataFrame([(i, 0, word) for i in ids], BLOCKS)}


def ids(spark, found):
    return spark.createDataFrame([(i,) for i in found], "id long")


def test_what_a_conflict_is(spark, store):
    read = store.version()
    store.patch(ids(spark, [1]), read=read, **change(spark, [1], "first"))
    assert store.patch(ids(spark, [2]), read=read, **change(spark, [2], "other")) == 3  # another document, in whichever bucket
    with pytest.raises(Conflict, match="/d/1 "):
        store.patch(ids(spark, [1]), read=read, **change(spark, [1], "second"))
    with pytest.raises(Conflict):
        store.patch(ids(spark, [2]), read=read)  # it would remove what it has not seen
    with pytest.raises(Conflict, match="/d/new"):  # the same path under two ids
        store.patch(ids(spark, [900]), read=3, documents=spark.createDataFrame([(900, "/d/new", 1)], DOCS))
        store.patch(ids(spark, [901]), read=3, documents=spark.createDataFrame([(901, "/d/new", 1)], DOCS))
    with pytest.raises(Conflict):
        store.commit(read=read, blocks=store.read("blocks"))
    found = {r.document_id: r.content for r in store.read("blocks").collect()}
    assert (found[1], found[2], found[3], len(found)) == ("first", "other", "old", 100)
    store.touch(spark.createDataFrame([(5, "/moved/5", 1)], DOCS), read=3)  # beside /d/new
    with pytest.raises(Conflict):
        store.patch(ids(spark, [5]), read=3, **change(spark, [5], "late"))
    store.compact(grace=0)
    with pytest.raises(Conflict, match="not kept"):
        store.patch(ids(spark, [7]), read=read, **change(spark, [7], "late"))


def test_a_repeated_micro_batch_commits_once(spark, store, tmp_path):
    """A stream whose batch is run again after it had committed, as after a crash before the stream's own log."""
    (tmp_path / "in").mkdir()
    docs = lambda i: spark.createDataFrame([(1000 + i, f"/s/{i}", i)], DOCS)

    def write(rows, number, s=store):
        found = [r.id for r in rows.collect()]
        new = spark.createDataFrame([(1000 + i, f"/s/{i}", number) for i in found], DOCS)
        s.upsert(new, spark.createDataFrame([(1000 + i, 0, f"batch {number}") for i in found], BLOCKS), batch=("intake", number))

    versions = []
    for i in range(3):
        spark.range(i, i + 1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        stream.awaitTermination()
        versions.append(store.version())
        write(spark.createDataFrame([(i,)], "id long"), i)  # again
        assert store.version() == versions[-1]
    assert versions == [2, 3, 4]
    docs_now = {r.path: r.size_bytes for r in store.read("documents").filter("path like '/s/%'").collect()}
    assert docs_now == {"/s/0": 0, "/s/1": 1, "/s/2": 2}
    write(spark.createDataFrame([(0,)], "id long"), 1)  # an older batch than the ledger's
    assert store.version() == versions[-1]


def test_reserved_ids_never_overlap(spark, store):
    with ThreadPoolExecutor(4) as pool:
        firsts = list(pool.map(lambda n: (SnapshotStore(spark, store.path).reserved(n), n), [3, 1, 7, 2, 5, 4]))
    taken = sorted(x for f, n in firsts for x in range(f, f + n))
    assert len(set(taken)) == len(taken) == 22 and taken[0] == 100


def test_folders_of_writers_that_failed(spark, store, tmp_path):
    import os

    os.makedirs(tmp_path / "s" / "v-lost" / "documents")
    assert store.compact() == 0  # it may still be written
    assert store.compact(grace=0) == 1 and not os.path.exists(tmp_path / "s" / "v-lost")
    assert store.read("documents").count() == 100


def test_a_merge_is_one_commit_and_scratch_goes(spark, tmp_path):
    import os

    from folioscan.plans.scratch import shared

    tree(tmp_path / "t", "a", "xy")
    c = Collection(spark, str(tmp_path / "store"))
    c.index(str(tmp_path / "t" / "a"))
    tree(tmp_path / "t", "b", "z")
    here = lambda: set(os.listdir(shared(spark).removeprefix("file:")))
    before, version = here(), c.store.version()
    assert c.index(str(tmp_path / "t"))["plan"] == "merge" and c.store.version() == version + 1
    assert here() == before
    assert {r.root for r in c.store.read("documents").collect()} == {str(tmp_path / "t")} and c.search("hello").count() == 3


def test_a_file_that_changes_while_it_is_read(spark, tmp_path, monkeypatch):
    from folioscan.sources import scan

    a = tree(tmp_path, "a", "xyz")
    c = Collection(spark, str(tmp_path / "store"))
    real = scan.seen_again
    monkeypatch.setattr(scan, "seen_again", lambda files: (tmp_path / "a" / "x.txt").write_text("hello longer than before") and real(files))
    told = c.index(a)
    assert told["changed_meanwhile"] == 1 and c.search("hello").count() == 2
    monkeypatch.undo()
    assert c.index(a)["committed"] == {"added": 1} and c.search("longer").count() == 1
