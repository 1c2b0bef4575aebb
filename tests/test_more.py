import hashlib
import hmac
import json
import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from folioscan.api import Collection
from folioscan.functions.paths import builtin_rule, ignore_rules
from folioscan.functions.text import normalize, normalized, snippet
from folioscan.operators import chunks, context, library, passages, postings, search, sessionlog
from folioscan.operators.search import Search
from folioscan.plans.snapshot import Conflict, SnapshotStore
from folioscan.sources import logs, parsers, scan
from folioscan.streaming import live
from test_search import collection, made

# -- postings --------------------------------------------------------------------------------------------


def test_grams_are_numbers_that_lose_nothing():
    texts = ["abc", "", "a", "Ａ測\0試\U0001f600z", "ab"]
    want = {t[i : i + n] for t in texts for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    assert {postings.gram(int(g)) for g in postings.numbers_of(texts, (1, 2, 3))} == want
    assert postings.gram(postings.number("\0\0x")) == "\0\0x"


def test_pruned_searches_equal_the_scan(spark):
    docs, blocks, words = made(3)
    d, b = collection(spark, docs, blocks)
    grams = postings.gram_postings(b, 1, 2, 3, headings=True).cache()
    rng = random.Random(5)
    texts = [rng.choice(words) + rng.choice(["", " " + rng.choice(words), rng.choice(words)]) for _ in range(12)] + ["的", "alpha beta gamma", "nothing at all", "a long phrase that is nowhere in any block of these"]
    for text in texts:
        for what in (Search(text), Search(text, "all-terms"), Search(text, "all-terms", "content"), Search(text, types=(".md",))):
            rows = lambda p, what=what: sorted(map(tuple, search.matches(d, b, what, p).collect()))
            assert rows(grams) == rows(None), what


def test_phases_and_limited_pages(spark):
    docs, blocks, _ = made(6)
    d, b = collection(spark, docs, blocks)
    for text in ("alpha", "a", "beta-7.txt"):
        want = [tuple(r) for r in search.top(search.matches(d, b, Search(text)), limit=15).orderBy("position").collect()]
        assert [tuple(r) for r in search.phased(d, b, Search(text), 15).orderBy("position").collect()] == want
        assert sum(p.count() for p in search.phases(d, b, Search(text))) == search.matches(d, b, Search(text)).count()
    found = search.matches(d, b, Search("a"))
    assert [r.position for r in search.limited_page(found, 2, 7).orderBy("position").collect()] == list(range(8, 15))
    many = spark.range(700).select("id", F.format_string("/%05d", "id").alias("path"), F.lit(1).alias("rank"), F.lit(0.0).alias("modified_at_ms"))
    assert search.limited_page(many, 10, 50).count() == 50 and search.limited_page(many, 11, 50).count() == 0
    for bad in ((1, 51), (0, 5), (1, 0)):
        with pytest.raises(ValueError):
            search.limited_page(found, *bad)


def test_the_newest_search_wins(spark):
    runner = search.Latest(spark)
    slow = spark.range(200).repartition(8).select(F.udf(lambda i: time.sleep(0.4) or i, "long")("id"))
    first = runner.submit(slow)
    time.sleep(1.5)
    second = runner.submit(spark.range(3))
    assert len(second.result(60)) == 3
    with pytest.raises(Exception, match="(?i)cancel|interrupt"):
        first.result(60)


def test_preview_ids_and_display_width(spark):
    for key in (b"k", b"long" * 40):
        got = spark.createDataFrame([("/a/ü",)], "path string").select(search.preview_id("path", key)).first()[0]
        assert got == hmac.new(key, "/a/ü".encode(), hashlib.sha256).hexdigest()
    rows = spark.createDataFrame([("abc",), ("測試a",), ("e\u0301x",), ("",)], "t string").select(context.display_width("t")).collect()
    assert [r[0] for r in rows] == [3, 5, 2, 0]


def test_passages_in_normal_form(spark):
    docs = [(1, "/r", "/r/1.txt", "1.txt", ".txt", 1, 0.0, "indexed")]
    d, b = collection(spark, docs, [(1, 0, None, "Ａｂｃ here", "l0"), (1, 3, None, "only ﬁne words", "l3"), (1, 9, None, "abc ﬁne", "l9")])
    found = search.top(search.matches(d, b, Search("abc fine", "all-terms")))
    rows = passages.all_terms_passages(found, b, ["abc", "fine"]).collect()
    assert [(r.ordinal, r.source, r.terms) for r in rows] == [(9, "abc ﬁne", "abc,fine")]
    hits = {r.ordinal: list(r.terms) for r in passages.hit_blocks(b, ["abc", "fine"]).collect()}
    assert hits == {0: ["abc"], 3: ["fine"], 9: ["abc", "fine"]}
    assert passages.phrase_passages(found, b, "abc", "filename").count() == 0


def test_normal_form_of_a_column(spark):
    texts = ["plain ASCII", "Ａｂｃ", "ΑΣ", "İ", None, "", "ﬁ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(normalized("t")).collect()
    assert [r[0] for r in rows] == [None if t is None else normalize(t) for t in texts]


def test_snippets_of_random_texts_hold_their_term():
    rng = random.Random(1)
    pool = list("abAB ßΣςσİıﬁﬀÅåe\u0301\u0327\u1100\u1161\u11a8が\u3099ｶﾞ①Ⅳ漢\u0958\u0f73\u0344")
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))
        normal = normalize(text)
        at = rng.randrange(len(normal)) if normal else 0
        term = normal[at : at + 3].strip()
        if term:
            assert term in normalize(snippet(text, term)[0])


# -- snapshots, scans, collections -----------------------------------------------------------------------

DOCS, BLOCKS = "id long, path string, size_bytes long", "document_id long, ordinal int, content string"


def stored(spark, path, n=200):
    store = SnapshotStore(spark, str(path))
    store.commit(documents=spark.range(n).select("id", F.format_string("/d/%05d", "id").alias("path"), F.lit(1).cast("long").alias("size_bytes")), blocks=spark.range(n).select(F.col("id").alias("document_id"), F.lit(0).alias("ordinal"), F.lit("old").alias("content")))
    return store


def test_a_change_writes_its_buckets_only(spark, tmp_path):
    store = stored(spark, tmp_path / "s")
    before = store._entry()["tables"]
    assert len(before["documents"]["parts"]) > 20
    new = spark.createDataFrame([(7, "/d/00007", 9), (500, "/d/new", 2)], DOCS)
    assert store.patch(spark.createDataFrame([(7,), (11,)], "id long"), documents=new, blocks=spark.createDataFrame([(7, 0, "new"), (500, 0, "new"), (500, 1, "more")], BLOCKS)) == 2
    after = store._entry()["tables"]
    for name in ("documents", "blocks"):
        changed = {b for b in after[name]["parts"] if after[name]["parts"][b] != before[name]["parts"].get(b)}
        assert 1 <= len(changed) <= 3
    docs = {r.id: r.size_bytes for r in store.read("documents").collect()}
    assert len(docs) == 200 and docs[7] == 9 and docs[500] == 2 and 11 not in docs
    assert sorted((r.document_id, r.content) for r in store.read("blocks").filter("content <> 'old'").collect()) == [(7, "new"), (500, "more"), (500, "new")]
    assert store.read("documents", 1).count() == 200 and store.read("blocks", 1).filter("content = 'new'").count() == 0
    assert store.touch(spark.createDataFrame([(9, "/moved", 5)], DOCS)) == 3
    assert store.read("documents").filter("id = 9").first().path == "/moved" and store.read("blocks").filter("document_id = 9").count() == 1
    assert store.remove(spark.createDataFrame([("/moved",)], "path string")) == 4 and store.read("blocks").filter("document_id = 9").count() == 0
    gone = store.compact()
    assert gone > 0 and store.read("documents").count() == 199
    with pytest.raises(LookupError):
        store.read("documents", 1)


def test_a_collection_that_grows_gets_more_buckets(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), target=10)
    rows = lambda lo, hi: (spark.range(lo, hi).select("id", F.format_string("/d/%05d", "id").alias("path"), F.lit(1).cast("long").alias("size_bytes")), spark.range(lo, hi).select(F.col("id").alias("document_id"), F.lit(0).alias("ordinal"), F.lit("t").alias("content")))
    none = spark.createDataFrame([], "id long")
    store.commit(documents=rows(0, 0)[0], blocks=rows(0, 0)[1])
    seen = []
    for lo, hi in ((0, 100), (100, 300), (300, 900), (900, 910)):
        docs, blocks = rows(lo, hi)
        store.patch(none, documents=docs, blocks=blocks)
        seen.append(store._entry()["buckets"])
        assert store.read("documents").count() == hi == store.read("blocks").select("document_id").distinct().count()
    assert seen == [32, 32, 128, 128]
    before = store._entry()["tables"]["blocks"]["parts"]
    store.patch(spark.createDataFrame([(5,)], "id long"))
    after = store._entry()["tables"]["blocks"]["parts"]
    assert sum(after.get(b) != p for b, p in before.items()) == 1 and store.read("documents").count() == 909


def test_postings_are_looked_up_by_gram_and_only_added_to(spark, tmp_path):
    top = tmp_path / "files"
    top.mkdir()
    for i in range(30):
        (top / f"f{i}.txt").write_text(f"common words and the number x{i}y")
    c = Collection(spark, str(tmp_path / "store"))
    c.index(str(top))
    parts = c.store._entry()["tables"]["postings"]["parts"]
    rows = c.store.lookup("postings", [postings.number("x7y"), postings.number("com")])
    assert sorted(r.n for r in rows.collect()) == [1, 30] and postings.unpacked(rows).count() == 31
    assert len(rows.inputFiles()) < len(c.store.read("postings").inputFiles())
    (top / "f7.txt").write_text("common words and the number z7y")
    c.index(str(top))
    after = c.store._entry()["tables"]["postings"]["parts"]
    assert all(after[b][: len(p)] == p for b, p in parts.items())
    for text, names in (("x7y", set()), ("z7y", {"f7.txt"}), ("x8y", {"f8.txt"}), ("number", {f"f{i}.txt" for i in range(30)})):
        assert {r.filename for r in c.search(text, 50).collect()} == names
    c.compact()
    assert c.store.lookup("postings", [postings.number("x7y")]).count() == 0 and c.search("z7y").count() == 1


def test_two_writers_never_make_one_version(spark, tmp_path):
    store = stored(spark, tmp_path / "s", 20)
    results, start = [], threading.Barrier(2)

    def write(i):
        other = SnapshotStore(spark, str(tmp_path / "s"))
        start.wait()
        try:
            results.append(other.patch(spark.createDataFrame([(i,)], "id long")))
        except Conflict:
            results.append("conflict")

    threads = [threading.Thread(target=write, args=(i,)) for i in (1, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    versions = [r["data_version"] for r in store._manifest()]
    assert versions == sorted(set(versions)) and store.version() == 1 + sum(r != "conflict" for r in results)
    assert store.read("documents").count() == 20 - sum(r != "conflict" for r in results)
    with pytest.raises(Conflict):
        store._create(f"{store.path}/manifest/{1:012d}.json", "x\n")
    tried = []
    assert live.with_back_off(lambda: tried.append(1) or (_ for _ in ()).throw(Conflict()) if len(tried) < 3 else "done", Conflict, sleep=tried.append) == "done"


def test_scan_reports_what_it_cannot_read(spark, tmp_path, monkeypatch):
    for name in ("a/x.txt", "a/deep/er/y.txt", "b/z.md", ".git/config", "~$tmp.docx", "keep.log"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("t")
    (tmp_path / "link.txt").symlink_to(tmp_path / "a/x.txt")
    (tmp_path / "loop").symlink_to(tmp_path)
    top = str(tmp_path)
    files, failed = scan.scanned(spark, top, top, ignore_rules("*.log"))
    rows = {r.relative: r.rule for r in files.collect()}
    assert failed == [] and {k for k, v in rows.items() if v is None} == {"a/x.txt", "a/deep/er/y.txt", "b/z.md"}
    assert {k: v for k, v in rows.items() if v} == {".git": "builtin:.git", "~$tmp.docx": "builtin:office-temp", "keep.log": "user-rule:*.log", "link.txt": "link", "loop": "link"}
    assert scan.entries_of(f"{top}/absent") == [(f"{top}/absent", True, False, 0, 0.0, True)]
    for bad, code in (("relative", "ROOT_NOT_ABSOLUTE"), (f"{top}/absent", "ROOT_NOT_FOUND"), (f"{top}/keep.log", "ROOT_NOT_A_FOLDER"), ("/proc/self", "ROOT_IS_SYSTEM")):
        with pytest.raises(scan.RootError) as problem:
            scan.validated(bad)
        assert problem.value.code == code
    assert scan.validated(f"{top}/a/") == f"{top}/a"


def test_a_collection_survives_what_it_cannot_see(spark, tmp_path, monkeypatch):
    top = tmp_path / "files"
    for name in ("a/one.txt", "a/two.txt", "b/three.txt"):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text("hello " + name)
    (top / "pic.bin").write_bytes(b"\0")
    c = Collection(spark, str(tmp_path / "store"))
    first = c.index(str(top))
    assert first["committed"] == {"added": 4} and first["read"] == 3
    real = scan.scanned

    def broken(spark, start, root, *more):
        files, _ = real(spark, start, root, *more)
        return files.filter(~F.col("path").startswith(f"{top}/a/")), [f"{top}/a"]

    monkeypatch.setattr(scan, "scanned", broken)
    (top / "b/three.txt").unlink()
    second = c.index(str(top))
    assert (second["removed"], second["protected"], second["unreadable"]) == (1, 2, [f"{top}/a"])
    assert {r.filename for r in c.search("hello").collect()} == {"one.txt", "two.txt"}
    monkeypatch.undo()
    os.rename(top, tmp_path / "away")
    with pytest.raises(scan.RootError, match="ROOT_NOT_FOUND"):
        c.index(str(top))
    top.mkdir()
    with pytest.raises(scan.RootError, match="ROOT_IS_EMPTY"):
        c.index(str(top))
    assert c.search("hello").count() == 2 and c.page("hello", 1, 1).count() == 1
    status = c.status()
    assert c.status() is status
    assert c.index(str(top), allow_empty=True)["removed"] == 3 and c.status() is not status
    assert c.compact() > 0 and c.search("hello").count() == 0
    c.trash(str(top))
    assert c.trashed() == [str(top)] and c.roots() == []
    with pytest.raises(LookupError):
        c.restore("/elsewhere")
    os.rmdir(top)
    os.rename(tmp_path / "away", top)
    assert c.restore(str(top))["committed"] == {"added": 3} and c.roots() == [str(top)]
    with pytest.raises(context.ContextError) as problem:
        row = c.search("hello").first()
        context.bundle(c.store.read("documents"), c.store.read("blocks"), [("hello", row.reference)], version=1, current=lambda: 2)
    assert problem.value.code == "CONTEXT_STALE"


def test_volume_rules(spark):
    rows = [("$Recycle.Bin/x", False), ("System Volume Information", True), ("sub/$Recycle.Bin/x", False), ("Windows/a.txt", False), ("Users/ann/AppData/x", False), ("Users/ann/doc.txt", False), ("Program Files (x86)/a", False), ("windows", False)]
    df = spark.createDataFrame(rows, "p string, d boolean")
    plain = [r[0] for r in df.select(builtin_rule("p", F.col("d"))).collect()]
    whole = [r[0] for r in df.select(builtin_rule("p", F.col("d"), True)).collect()]
    assert plain == ["builtin:$recycle-bin", "builtin:system-volume-information", None, None, None, None, None, None]
    assert whole == [*plain[:3], "volume-default:windows", "volume-default:users-profile-appdata", None, "volume-default:program-files-x86", None]


def test_chunks_and_library():
    assert chunks.chunk_numbers([10, 20, 40, 5, 100, 1, 99], 50) == [0, 0, 1, 1, 2, 3, 4]
    assert chunks.chunk_numbers([], 5) == [] and chunks.chunk_numbers([70, 70], 50) == [0, 1]
    assert chunks.chunk_numbers([0, 24, 25, 0, 1], 50) == [None, 0, 0, None, 1]  # 24 + 1 + 25 fit, one more and its separator do not


def test_lists_that_are_full(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "path string, at int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "path string, at int")
    assert sorted(map(tuple, library.added(old, new, "path", 3).collect())) == [("a", 1), ("b", 9), ("c", 3)]
    assert [r.path for r in library.removed(old, new, "path").collect()] == ["a"]
    with pytest.raises(library.Full):
        library.added(old, new, "path", 2)
    files = spark.createDataFrame([("/x/My File.txt", "my file.txt"), ("/x/file.txt", "file.txt"), ("/x/other", "other")], "path string, filename_norm string")
    assert sorted((r.path, r["rank"]) for r in library.imported(files, ["file"], "file.txt").collect()) == [("/x/My File.txt", 3), ("/x/file.txt", 4)]
    with pytest.raises(library.Full):
        library.imported(files, ["x"], "x", 2)
    for i in range(7):
        (tmp_path / f"t{i}.json").write_text("x" * (10 if i != 3 else 99))
        os.utime(tmp_path / f"t{i}.json", (i, i))
    assert [os.path.basename(p) for p in logs.rotated(str(tmp_path), 4, 50)] == ["t0.json", "t1.json", "t3.json"]
    logs.write_profile(str(tmp_path / "profile"), {"counts": {"indexed": 3}, "roots": ["/secret"], "issues": [1]}, ["/secret"])
    assert "secret" not in (tmp_path / "profile").read_text()
    with pytest.raises(FileExistsError):
        logs.write_profile(str(tmp_path / "profile"), {}, [])


# -- live updates ----------------------------------------------------------------------------------------


def test_gaps_turns_and_handles(spark):
    roots = spark.createDataFrame([("/a", 5), ("/b", 50), ("/c", None)], "root string, watched_until long")
    for policy, action in (("ask", "waiting"), ("auto", "reconcile"), ("off", "recorded")):
        assert [tuple(r) for r in live.downtime_gaps(roots, 20, policy).collect()] == [("/a", "downtime-gap", "not-watched", 20, action)]
    with pytest.raises(ValueError):
        live.downtime_gaps(roots, 20, "maybe")
    assert [live.next_turn(*x) for x in ((9000, 0, True, True), (4000, 0, True, True), (4000, 0, True, False), (4000, 0, False, True), (0, None, True, True), (0, 0, False, False))] == ["reconcile", "local", "reconcile", "local", "reconcile", "idle"]
    due = spark.createDataFrame([("/a", 0), ("/b", 90), ("/c", None)], "root string, reconciled_at long")
    assert sorted(r.root for r in live.periodic_due(due, 100, 50).collect()) == ["/a", "/c"]
    folders = spark.createDataFrame([("/a", f"/a/{i}") for i in range(5)] + [("/b", "/b/1")], "root string, folder string")
    assert {r.root: (r["mode"], r.n) for r in live.watch_plan(folders, 4).collect()} == {"/a": ("coarse", 1), "/b": ("split", 2)}


def test_folders_are_taken_in_rounds(spark):
    folders = spark.createDataFrame([("/r", "/r/a", None), ("/r", "/r/b", None), ("/r", "/r/c", None)], "root string, folder string, after string")
    listing = spark.createDataFrame([("/r", "/r/a", f"/r/a/{i}") for i in range(7)] + [("/r", "/r/b", "/r/b/1")], "root string, folder string, path string")
    seen, rounds = [], 0
    while True:
        paths, state = live.expanded(folders, listing, 3)
        seen += [r.path for r in paths.collect()]
        rows = state.collect()
        rounds += 1
        if all(r.complete for r in rows):
            break
        folders = spark.createDataFrame([tuple(r)[:3] for r in rows if not r.complete], folders.schema)
    assert sorted(seen) == sorted(r.path for r in listing.collect()) and len(seen) == len(set(seen)) and rounds == 3


def test_groups_checkpoints_and_second_look(spark):
    items = spark.createDataFrame([("/r", f"p{i}", c, i) for i, c in enumerate([5, 5, 90, 5, 5, 5, 200, 1])], "root string, path string, chars long, seq int")
    got = {r.path: r.group for r in live.prepared_groups(items, 3, 100).collect()}
    assert [got[f"p{i}"] for i in range(8)] == [0, 0, 0, 1, 1, 1, 2, 3]
    changes = spark.createDataFrame([(f"/p{i}", "added" if i % 2 else "same") for i in range(9)], "path string, change string")
    one = [r.path for r in live.reconcile_round(changes, None, 3).collect()]
    two = [r.path for r in live.reconcile_round(changes, one[-1], 3).collect()]
    assert one + two == ["/p1", "/p3", "/p5", "/p7"]
    files = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0), ("c", 1, 1.0)], "path string, size_bytes long, modified_at_ms double")
    now = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 1.0)], files.schema)
    assert {r.path: r.commit for r in live.verified_again(files, now).collect()} == {"a": True, "b": False, "c": False}
    states = [spark.createDataFrame([(r,) for r in rows], "root string") for rows in (["/a", "/old"], ["/b"], ["/gone", "/a"])]
    registered = spark.createDataFrame([("/a",), ("/b",)], "root string")
    assert sorted(r.root for r in live.orphans(registered, *states).collect()) == ["/gone", "/old"]
    assert [r.root for r in live.purged(states[0], registered).collect()] == ["/a"]


# -- tool logs -------------------------------------------------------------------------------------------


def line(kind, payload, **more):
    return json.dumps({"type": kind, "payload": payload, **more})


def test_evidence_of_tool_calls():
    user = lambda text: line("response_item", {"type": "message", "role": "user", "content": [{"type": "input_text", "text": text}]})
    call = lambda name, args, **more: line("response_item", {"type": "function_call", "name": name, "arguments": args, **more})
    done = lambda item: line("event_msg", {"type": "item_completed", "item": item})
    cases = [
        (user("please read /a/b.txt now"), [("/a/b.txt", "user-provided", "medium")]),
        (user("/a/b.txt\nC:\\x\\y.md\n"), [("/a/b.txt", "prompt", "high"), ("C:\\x\\y.md", "prompt", "high")]),
        (line("response_item", {"type": "message", "role": "assistant", "content": [{"type": "input_text", "text": "/a/b.txt"}]}), []),
        (call("shell_command", json.dumps({"command": ["cat", "/a/b c.txt"], "workdir": "/w"})), [("/a/b c.txt", "other-tool", "high"), ("/w", "other-tool", "high")]),
        (call("other", json.dumps({"command": "/a/b.txt"})), []),
        (call("mcp__document_search__find", {"under": {"deep": ["/a/q.txt"]}}), [("/a/q.txt", "search-tool", "high")]),
        (line("response_item", {"type": "custom_tool_call", "name": "apply_patch", "input": "*** Begin Patch\n*** Update File: /a/one.py\n*** Add File: rel.py\n*** Delete File: /a/two.py\n"}), [("/a/one.py", "other-tool", "high"), ("/a/two.py", "other-tool", "high")]),
        (done({"type": "file_change", "changes": {"/a/c.txt": {}}, "content": [{"path": "/a/d.txt", "note": "/a/no.txt"}]}), [("/a/d.txt", "other-tool", "high"), ("/a/c.txt", "other-tool", "high")]),
        (done({"type": "CommandExecution", "command": "ls /a/list.txt"}), [("/a/list.txt", "other-tool", "high")]),
        (done({"type": "mcp_tool_call", "server": "document_search", "arguments": '{"p": "/a/m.txt"}'}), [("/a/m.txt", "search-tool", "high")]),
        (done({"type": "mcp_tool_call", "server": "else", "arguments": '{"p": "/a/m.txt"}'}), []),
        (json.dumps({"type": "note", "message": "in /a/low.txt here"}), [("/a/low.txt", "user-provided", "low")]),
        (line("turn_context", {"cwd": "/a"}), []), ("{broken", []), ("[1]", []), ("", []),
    ]
    moved = "*** Begin Patch\n*** Update File: /a/one.py\n*** Move to: /a/three.py\n*** Copy to: /a/four.py\n"
    cases.append((line("response_item", {"type": "custom_tool_call", "name": "apply_patch", "input": moved}), [(p, "other-tool", "high") for p in ("/a/one.py", "/a/three.py", "/a/four.py")]))
    for value, want in cases:
        assert [e[:3] for e in sessionlog.evidence_of(value)] == want, value


def test_json_strings_and_existence():
    deep = "/x/y.txt"
    for _ in range(12):
        deep = [deep]
    assert list(sessionlog.strings_of(deep)) == [] and list(sessionlog.strings_of({"a": ["b", {"c": "[\"d\"]"}]})) == ["b", "d"]
    assert list(sessionlog.fields_of([{"path": "p", "x": {"file": ["q"]}, "text": "r"}])) == ["p", "q"]

    def look(path):
        if "slow" in path:
            time.sleep(3)
        if "denied" in path:
            raise PermissionError
        return {"/f": "file", "/d": "folder"}.get(path)

    start = time.monotonic()
    got = sessionlog.existence(["/f", "/d", "/no", "\\\\host\\s\\f", "/denied", *[f"/slow{i}" for i in range(20)]], look, 0.2)
    assert time.monotonic() - start < 6
    assert got["/f"] == ("file", None) and got["/d"] == ("folder", None) and got["/no"] == ("missing", None)
    assert got["\\\\host\\s\\f"] == ("unknown", "network") and got["/denied"] == ("unknown", "PermissionError") and got["/slow19"] == ("unknown", "timeout")


def test_buckets_of_references(spark):
    rows = [(1, "/a", "low", "exists"), (1, "/b", "high", "unknown"), (1, "/c", "low", "unknown"), (1, "/d", "high", "missing"), (2, "/e", "low", "file")]
    refs = spark.createDataFrame(rows, "session int, path string, confidence string, state string")
    assert sorted(map(tuple, sessionlog.reference_buckets(refs).collect())) == [(1, 1, 1, 2), (2, 0, 1, 0)]


@pytest.mark.parametrize(
    "raw, style, shown",
    [
        ("0.256", "0.0%", "25.6%"), ("0.5", "0%", "50%"), ("1234567.891", "#,##0.00", "1,234,567.89"), ("1234567", "#,##0", "1,234,567"), ("3.14159", "0.000;-0.000", "3.142"), ("45292.5", "yyyy-mm-dd hh:mm", "2024-01-01 12:00:00"),
        ("45292", 'd"."mmm', "2024-01-01"), ("7", '"day "0', "7"), ("7", "[Red]0.0", "7.0"), ("1e300", "yyyy", "1e300"), ("inf", "0.0", "inf"), ("12", None, "12"), ("12", "General", "12"), ("text", "0.0", "text"), ("-5", "-#,##0", "-5"),
    ],
)
def test_number_formats(raw, style, shown):
    assert parsers.number_text(raw, style, False) == shown
