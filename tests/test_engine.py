import datetime
import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from folioscan import catalog
from folioscan.functions import paths
from folioscan.operators import inventory, library, sessionlog
from folioscan.plans.snapshot import SnapshotStore
from folioscan.sources import parsers
from folioscan.streaming import live


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) & set(catalog.ORACLE_SQL)))
def test_queries_equal_their_twins(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "events", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    rows = [tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall()]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(plain(v) for v in r)) for r in got.select(*columns).collect())
    assert rows


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_other_queries_run(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


# -- paths ---------------------------------------------------------------------------------------------


def test_path_algebra(spark):
    assert paths.covers("/a", "/a/b") and paths.covers("/a", "/a") and not paths.covers("/a", "/ab") and paths.covers("/", "/x")
    df = spark.createDataFrame([("/a",), ("/a/b",), ("/ab",), ("/",)], "path string")
    assert [r[0] for r in df.select(paths.below("path", "/a")).collect()] == [True, True, False, False]
    assert [r[0] for r in df.select(paths.ancestors("path")).collect()][1] == ["/a", "/a/b"]
    plan = paths.plan_root
    assert plan("/a", ["/a"]).kind == "existing" and plan("/a/b/c", ["/a", "/a/b"]) == paths.RootPlan("subtree", "/a/b", (), "/a/b/c")
    assert plan("/a", ["/a/c", "/a/b", "/x"]) == paths.RootPlan("merge", "/a", ("/a/b", "/a/c")) and plan("/q", ["/a"]).kind == "independent"


@pytest.mark.parametrize(
    "rules, path, folder, hit",
    [
        ("*.log", "a/b.LOG", False, "*.log"), ("build/", "build", False, None), ("build/", "build", True, "build/"), ("build/", "x/build/y.txt", False, "build/"), ("/top", "sub/top", False, None),
        ("/top", "top/deep/x", False, "/top"), ("a/*.txt", "a/b/c.txt", False, None), ("a/**/c.txt", "a/c.txt", False, "a/**/c.txt"), ("a/**/c.txt", "a/b/d/c.txt", False, "a/**/c.txt"), ("?.md", "ab.md", False, None),
        ("# no\n\nfoo", "foo", False, "foo"), ("a\\b", "a/b", False, "a\\b"), ("x+(1).txt", "x+(1).txt", False, "x+(1).txt"), ("**", "any/thing", False, "**"),
    ],
)
def test_ignore_rules(spark, rules, path, folder, hit):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(paths.ignored_by("p", F.lit(folder), paths.ignore_rules(rules))).first()[0] == hit


def test_rules_that_include_again_are_an_error():
    with pytest.raises(ValueError):
        paths.ignore_rules("!keep")


def test_precedence_of_exclusions(spark):
    rows = [("a/.git/x", False, False), ("a/.git", False, False), ("~$w.docx", False, False), ("n/x.log", True, False), ("n/x.log", False, False), ("n/x.log", False, True)]
    df = spark.createDataFrame(rows, "p string, link boolean, own boolean")
    got = df.select(paths.excluded_by("p", F.lit(False), F.col("link"), F.col("own"), paths.ignore_rules("*.log"))).collect()
    assert [r[0] for r in got] == ["builtin:.git", None, "builtin:office-temp", "link", "user-rule:*.log", "index-artifact"]


# -- inventory -------------------------------------------------------------------------------------------


def test_reasons_to_read_again(spark):
    disk = spark.createDataFrame([("n", ".txt", 1, 1.0), ("s", ".txt", 2, 1.0), ("t", ".txt", 1, 2.5), ("e", ".md", 1, 1.0), ("u", ".sql", 1, 1.0), ("r", ".pdf", 1, 1.0), ("b", ".bin", 1, 1.0), ("k", ".txt", 1, 1.0), ("l", ".txt", 1, 1.0)], "path string, extension string, size_bytes long, modified_at_ms double")
    index = spark.createDataFrame([("s", "indexed", 1, 1, 1.0), ("t", "indexed", 1, 1, 1.0), ("e", "error", 1, 1, 1.0), ("u", "indexed", None, 1, 1.0), ("r", "unsupported", None, 1, 1.0), ("k", "indexed", 1, 1, 1.0), ("l", "too_large", None, 1, 1.0)], "path string, status string, parse_version int, size_bytes long, modified_at_ms double")
    got = {r.path: (r.reason, r.action) for r in inventory.classified(disk, index).collect()}
    assert got == {"n": ("added", "parse"), "s": ("source-changed", "parse"), "t": ("source-changed", "parse"), "e": ("error-retry", "parse"), "u": ("text-upgrade", "parse"), "r": ("unsupported-retry", "parse"), "b": ("added", "metadata"), "k": ("unchanged", "skip"), "l": ("unchanged", "skip")}
    assert {r.reason for r in inventory.classified(disk, index, True).collect()} == {"rebuild"}


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    docs = lambda rows: spark.createDataFrame(rows, "id long, path string, size_bytes long")
    blocks = lambda rows: spark.createDataFrame(rows, "document_id long, ordinal int, content string")
    assert store.version() == 0
    assert store.upsert(docs([(1, "/a", 1), (2, "/b", 1)]), blocks([(1, 0, "x"), (2, 0, "y")])) == 1
    assert store.upsert(docs([(9, "/a", 5), (3, "/c", 1)]), blocks([(9, 0, "new"), (3, 0, "z")])) == 2
    assert sorted(map(tuple, store.read("documents").collect())) == [(1, "/a", 5), (2, "/b", 1), (3, "/c", 1)]
    assert sorted(map(tuple, store.read("blocks").collect())) == [(1, 0, "new"), (2, 0, "y"), (3, 0, "z")]
    assert sorted(map(tuple, store.read("documents", 1).collect())) == [(1, "/a", 1), (2, "/b", 1)]
    with pytest.raises(ValueError):
        store.upsert(docs([(4, "/d", 1)]), blocks([(4, 0, "x"), (4, 0, "y")]))
    store.remove(docs([(0, "/b", 0)]))
    assert sorted(r.document_id for r in store.read("blocks").collect()) == [1, 3]
    with pytest.raises(LookupError):
        store.read("documents", 77)


# -- parsers ---------------------------------------------------------------------------------------------


def contents(blocks):
    return [(b[0], b[1], b[2]) for b in blocks]


def test_text_and_encodings():
    assert contents(parsers.text_blocks(b"a\r\n\n \t\nb\rc")) == [(0, None, "a"), (3, None, "b"), (4, None, "c")]
    assert parsers.decoded("測試".encode("big5")) == "測試" and parsers.decoded(b"\xef\xbb\xbfx") == "x" and parsers.decoded("é".encode("utf-16")) == "é"
    assert parsers.decoded('<?xml version="1.0" encoding="CP950"?><a>測</a>'.encode("big5"), True).endswith("測</a>")
    for data, xml, code in ((b"\xff\x00\x81\xff\xff", False, "TEXT_DECODE_ERROR"), (b'<?xml version="1.0" encoding="nope"?>', True, "XML_ENCODING_UNSUPPORTED"), (b'<?xml version="1.0" encoding="utf-8"?>\xff', True, "XML_DECODE_ERROR")):
        with pytest.raises(parsers.ParseError) as found:
            parsers.decoded(data, xml)
        assert found.value.code == code


def test_markdown(spark):
    text = "intro\n\n# One \ntext\n## \n####### seven\n### Two\n\n"
    want = [(0, None, "intro", 1), (1, "One", "# One \ntext\n## \n####### seven", 3), (2, "Two", "### Two", 7)]
    assert [(b[0], b[1], b[2], int(b[4].split()[1])) for b in parsers.markdown_blocks(text.encode())] == want
    df = spark.createDataFrame([(5, text), (6, "\n"), (7, "plain")], "k long, text string")
    got = sorted(map(tuple, parsers.markdown_sections(df, "k").collect()), key=str)
    assert got == [(5, *w) for w in want] + [(7, 0, None, "plain", 1)]


def test_csv():
    assert parsers.csv_rows('a,"b ""x"", y"\r\n,\n"multi\nline",z') == [["a", 'b "x", y'], ["", ""], ["multi\nline", "z"]]
    assert contents(parsers.csv_blocks(b"\xef\xbb\xbfa,b\n , \n,,c")) == [(0, None, "a | b"), (2, None, " |  | c")]
    assert parsers.csv_blocks(b",,c")[0][4] == "row 1 (C-C)" and [parsers.column_letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    for bad in ('a"b', '"a"b', '"open', '"a" "b"'):
        with pytest.raises(parsers.ParseError):
            parsers.csv_rows(bad)
    assert parsers.csv_rows("") == [] and parsers.csv_rows("a,") == [["a", ""]]


def test_html_and_mht():
    html = "<title>T &amp; t</title><style>p</style><h1>Head</h1><p>one <b>two</b> <a href='http://x/'>link</a><a href='javascript:x'>j</a><table><tr><td>1<td>2</table><script>no</script>end"
    assert contents(parsers.html_blocks(html.encode())) == [(0, "T & t", "T & t"), (1, "Head", "Head"), (2, "Head", "one two http://x/ linkj"), (3, "Head", "1 2"), (4, "Head", "end")]
    assert parsers.decode_html('<meta charset="big5"><p>測'.encode("big5")).endswith("測")
    mail = b"MIME-Version: 1.0\r\nContent-Type: multipart/related; boundary=b\r\n\r\n--b\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>hello</p>\r\n--b--\r\n"
    assert contents(parsers.mht_blocks(mail)) == [(0, None, "hello")]
    with pytest.raises(parsers.ParseError):
        parsers.mht_blocks(b"no header")


def test_number_texts():
    assert parsers.number_text("1234.5", "#,##0.00", False) == "1,234.50" and parsers.number_text("x", "0.0", False) == "x" and parsers.number_text("0", "yyyy", True) == "1904-01-01"


def test_rtf():
    data = rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}caf\'e9 \u233?\par {\*\generator x;}second\{x\}{\field{\*\fldinst HYPERLINK " + b'"http://a/"' + rb"}{\fldrslt shown}}}"
    assert [b[2] for b in parsers.rtf_blocks(data)] == ["café é", "second{x}shown", "http://a/"]
    for bad in (b"plain", rb"{\rtf1 {", rb"{\rtf1 }}"):
        with pytest.raises(parsers.ParseError):
            parsers.rtf_text(bad)


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"a.txt": b"one\n\ntwo", "sub/b.md": b"# h\nx", "c.bin": b"\0", "d.rtf": b"broken", "e.txt": b" \n", "f.csv": b'"open', "G.TXT": b"up"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.filename: r for r in parsers.read_files(spark, str(tmp_path)).collect()}
    assert {n: (r.status, r.error_code, len(r.blocks)) for n, r in got.items()} == {
        "a.txt": ("indexed", None, 2), "b.md": ("indexed", None, 1), "c.bin": ("unsupported", None, 0), "d.rtf": ("error", "RTF_INVALID", 0), "e.txt": ("no_text", None, 0), "f.csv": ("error", "CSV_FORMAT_ERROR", 0), "G.TXT": ("indexed", None, 1),
    }
    assert got["b.md"].blocks[0].heading == "h" and got["a.txt"].path == str(tmp_path / "a.txt")


# -- sessions, library, live ---------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, found",
    [
        ("see /a/b.txt and more (/c/d.md) then", ["/a/b.txt", "/c/d.md"]), ("/a/b.txt, and", ["/a/b.txt, and"]), ("C:\\x\\y.txt:12", ["C:\\x\\y.txt"]), ("http://h/p /a//b/../c/", ["/a/c"]), ("file:///a/b%20c.txt", ["/a/b c.txt"]), ("\\\\host\\share\\f.txt", ["\\\\host\\share\\f.txt"]),
        ("data /9j/abcdef and // no", []), ("「/文件/報告.txt」。", ["/文件/報告.txt"]), ("a/b relative", []), ("/one.txt /one.txt", ["/one.txt"]), ("x=/k", ["/k"]), ("/" + "z" * 500, []),
    ],
)
def test_paths_in_text(text, found):
    assert sessionlog.paths_in(text) == found


def test_session_lines(spark):
    lines = [json.dumps({"type": "session_meta", "timestamp": "t0"}), "", "{bad", json.dumps([1]), json.dumps({"type": "response_item", "payload": {"type": "message", "role": "user", "text": "x", "timestamp": "t2"}}), json.dumps({"no": "type"})]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(lines)], "session long, line long, value string")
    row = sessionlog.session_summary(sessionlog.events_of_lines(df)).first()
    assert (row.events, row.invalid_lines, row.started_at, row.last_event_at) == (3, 2, "t0", "t2")
    assert row.event_types == "response_item/message=1,session_meta=1,unknown=1"


def test_main_source_of_a_reference(spark):
    rows = [(1, "/a", "other-tool", "high", "x"), (1, "/a", "user-provided", "medium", "y"), (1, "/a", "prompt", "high", "x"), (1, "/b", "user-provided", "low", "z")]
    refs = sessionlog.references(spark.createDataFrame(rows, "session long, path string, source string, confidence string, event_type string"))
    got = {r.path: r for r in refs.collect()}
    assert (got["/a"].source, got["/a"].confidence, got["/a"].occurrences, got["/a"].sources) == ("prompt", "high", 3, "prompt,user-provided,other-tool")
    docs = spark.createDataFrame([(5, "/A"), (6, "/b")], "id long, path string")
    assert {r.path: r.document_id for r in sessionlog.indexed_references(refs, docs).collect()} == {"/a": 5, "/b": 6}


def test_library(spark):
    assert library.name_key(" Ａbc ") == "abc"
    for bad in ("", " ", "x" * 81, "a\nb"):
        with pytest.raises(ValueError):
            library.name_key(bad)
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, t int")
    new = spark.createDataFrame([("a", 5), ("c", 3)], "k string, t int")
    assert [tuple(r) for r in library.upserted(old, new, "k", "t", 2).collect()] == [("a", 5), ("c", 3)]


def test_debounce_and_throttle():
    assert live.debounce([0, 1000, 2400, 9000]) == [(0, 2400, 3, 3900), (9000, 9000, 1, 10500)]
    assert live.debounce(list(range(0, 20000, 1000)))[0] == (0, 14000, 15, 15000)
    assert live.throttle([0, 1000, 5000, 10000, 15000, 20000, 24000, 26000, 60000]) == [True, False, True, True, True, False, False, False, True]


def test_stream_equals_the_batch(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(milliseconds=700 * i * (1 + i % 5)), i % 3) for i in range(60)] + [(99, start + datetime.timedelta(days=1), 7)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long")
    df.repartition(1).write.parquet(str(tmp_path / "events.parquet"))
    want = {tuple(r) for r in live.debounced(df, "user_id").collect() if r.key != "7"}
    got = {tuple(r) for r in live.replayed(spark, str(tmp_path / "events.parquet"), "user_id", live.QUIET, live.FORCED).collect()}
    assert got <= want | {tuple(r) for r in live.debounced(df, "user_id").collect()} and len(got) >= len(want) - 3


def test_queue_rules(spark):
    rows = [(0, "a", "path", "expand", 1, 1), (0, "a", "path", "event", 2, 2), (0, "a", "path", "expand", 3, 3), (0, "b", "path", "delete", 1, 4), (0, "b", "path", "expand", 2, 5), (1, "c", "path", "event", 1, 6)]
    queue = live.work_queue(spark.createDataFrame(rows, "root int, rel_path string, kind string, reason string, at int, seq int"))
    got = {(r.root, r.rel_path): (r.generation, r.reason, r.created_at) for r in queue.collect()}
    assert got == {(0, "a"): (3, "event", 1), (0, "b"): (2, "expand", 1), (1, "c"): (1, "event", 1)}
    acks = spark.createDataFrame([(0, "a", 2), (0, "b", 2)], "root int, rel_path string, up_to long")
    assert {r.rel_path for r in live.acknowledged(queue, acks).collect()} == {"a", "c"}
    over = {(r.root, r.kind) for r in live.overflowed(queue, 1).collect()}
    assert over == {(0, "dirty-scope"), (1, "path")}
    pending = spark.createDataFrame([("/a",), ("/a/b",), ("/ab",), ("/c/d",)], "path string")
    assert {r.path for r in live.absorbed(pending).collect()} == {"/a", "/ab", "/c/d"}
