import json

import pytest

from folioscan.operators import context, search, sessionlog
from folioscan.operators.search import Search
from folioscan.sources import logs
from folioscan.sources.corpus import searchable, table


@pytest.fixture(scope="module")
def corpus(spark, sf):
    docs, blocks = searchable(table(spark, sf, "documents"))
    return docs.cache(), blocks.cache()


def test_bundle_of_selected_results(spark, corpus):
    docs, blocks = corpus
    rows = search.with_reference(search.top(search.matches(docs, blocks, Search("the than")), limit=2)).orderBy("position").collect()
    named = search.with_reference(search.top(search.matches(docs, blocks, Search("doc-7.txt")), limit=1)).first()
    basket = context.Selection()
    basket.toggle("the than", [r.reference for r in rows])
    basket.toggle("doc-7.txt", [named.reference])
    data = context.bundle(docs, blocks, basket.pairs(), created_at="2024-01-01T00:00:00.000Z")
    assert [d["path"] for d in data["documents"]] == [*[r.path for r in rows], named.path]
    assert all("the than" in p["snippet"].lower() for d in data["documents"][:2] for p in d["passages"])
    assert data["documents"][2]["filenameOnly"] and data["documents"][2]["passages"][0]["snippet"] == "doc-7.txt"
    assert json.loads(context.rendered(data, "json")) == data
    text = context.rendered(data)
    assert text.startswith("# Context") and "2024-01-01" in text and f"## 3. {named.path}" in text
    assert "createdAt" not in context.bundle(docs, blocks, basket.pairs()[:1], times=False)
    basket.toggle("the than", [rows[0].reference])
    assert len(basket.pairs()) == 2


def test_selections_that_do_not_hold(spark, corpus):
    docs, blocks = corpus
    good = "7-0123456789abcdef"
    for picked, code in (([], "CONTEXT_SELECTION_INVALID"), ([("a", good)] * 2, "CONTEXT_SELECTION_INVALID"), ([(" ", good)], "CONTEXT_SELECTION_INVALID"), ([("a", "x")], "CONTEXT_SELECTION_INVALID"), ([("the", good)], "CONTEXT_REFERENCE_MISSING")):
        with pytest.raises(context.ContextError) as found:
            context.bundle(docs, blocks, picked)
        assert found.value.code == code
    with pytest.raises(context.ContextError):
        context.bundle(docs, blocks, [("a", good)], limit=11)
    with pytest.raises(context.ContextError):
        context.rendered({"queries": ["x" * 300000], "matchMode": "phrase", "note": "", "documents": []})


def test_prefixes_end_at_whole_characters(spark):
    texts = ["plain text", "ééé", "測試測試", "a\U0001f600b\U0001f600", "", "ab"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for most in range(0, 13):
        got = [r[0] for r in df.select(context.byte_prefix("t", most)).collect()]
        assert got == [t.encode()[:most].decode("utf-8", "ignore") for t in texts], most
    assert spark.createDataFrame([("a\x1b[0m‮b\n",)], "t string").select(context.shown("t")).first()[0] == "a [0m b "


def test_logs(spark, tmp_path):
    (tmp_path / "s" / "2024").mkdir(parents=True)
    (tmp_path / "s" / "2024" / "rollout-1.jsonl").write_text('{"type": "session_meta", "timestamp": "t0"}\r\n{"no json\n\n')
    (tmp_path / "s" / "rollout-2.jsonl").write_text('{"type": "message", "text": "see /a/b.txt"}')
    (tmp_path / "s" / "other.jsonl").write_text("{}")
    lines = logs.session_lines(spark, str(tmp_path / "s"))
    events = sessionlog.events_of_lines(lines)
    got = {r.session.rsplit("/", 1)[-1]: (r.events, r.invalid_lines) for r in sessionlog.session_summary(events).collect()}
    assert got == {"rollout-1.jsonl": (1, 1), "rollout-2.jsonl": (1, 0)}
    assert [r[0] for r in events.filter("event_type = 'message'").select(sessionlog.text_paths("text")).collect()] == [["/a/b.txt"]]
    rows = [("search", "success", "t1", f"2024-01-0{i}", float(i), {"scan": 1.0}, {"results": 2.0}) for i in range(1, 5)] + [("answer", "error", "t1", "2024-01-09", 1.0, {}, {})]
    logs.append_traces(spark.createDataFrame(rows, logs.TRACE), str(tmp_path / "t"))
    (tmp_path / "t" / "damaged.json").write_text("{broken\n[1]\n")
    traces, errors = logs.read_traces(spark, str(tmp_path / "t"), limit=3)
    assert [r.completedAt for r in traces.collect()] == ["2024-01-09", "2024-01-04", "2024-01-03"] and errors.first()[0] == 2
    assert logs.read_traces(spark, str(tmp_path / "t"), kind="answer", status="error")[0].count() == 1
    files = spark.createDataFrame([(f"f{i}", 10 if i else 3 << 20, i) for i in range(8)], "path string, length long, modified_at int")
    assert sorted(r.path for r in logs.kept_files(files).collect()) == ["f3", "f4", "f5", "f6", "f7"]
