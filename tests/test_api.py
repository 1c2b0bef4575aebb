import os

import pytest

from folioscan.api import Collection
from folioscan.operators.context import ContextError


def test_life_of_a_collection(spark, tmp_path):
    top = tmp_path / "files"
    for name, data in {"a/one.txt": "hello world\nsecond line", "a/two.md": "# Hello heading\nbody", "a/skip.log": "hello", "a/node_modules/x.txt": "hello", "b/three.csv": "hello,there", "b/pic.bin": "x", "b/bad.rtf": "no"}.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(data)
    (top / "a" / "ignore.rules").write_text("*.log\n")
    c = Collection(spark, str(tmp_path / "store"))
    first = c.index(str(top / "a"))
    assert (first["plan"], first["reasons"], first["removed"]) == ("independent", {"added": 2}, 0)
    assert first["skipped"] == {"user-rule:*.log": 1, "builtin:node-modules": 1, "index-artifact": 1}
    rows = c.search("hello").collect()
    assert [(r.filename, r["rank"], r.by) for r in rows] == [("two.md", 2, "heading"), ("one.txt", 1, "content")]
    ids = {r.path: r.id for r in rows}
    again = c.index(str(top / "a"))
    assert (again["reasons"], again["read"]) == ({"unchanged": 2}, 0)
    session = c.session("hello")
    (top / "a" / "one.txt").write_text("hello changed, longer text than before")
    os.remove(top / "a" / "two.md")
    third = c.index(str(top / "a"))
    assert (third["reasons"], third["removed"]) == ({"source-changed": 1}, 1)
    rows = c.search("hello").collect()
    assert [(r.id, r.filename) for r in rows] == [(ids[str(top / "a" / "one.txt")], "one.txt")]
    with pytest.raises(RuntimeError, match="SEARCH_INDEX_CHANGED"):
        session.page(1, 5)
    merged = c.index(str(top))
    assert merged["plan"] == "merge" and c.roots() == [str(top)]
    assert {r.filename for r in c.search("hello", types="csv,txt").collect()} == {"one.txt", "three.csv"}
    assert [r.filename for r in c.search("hello", under=str(top / "b")).collect()] == ["three.csv"]
    assert c.index(str(top / "b"))["plan"] == "subtree"
    status = c.status()
    assert status["counts"]["unsupported"] >= 1 and status["counts"]["error"] == 1 and status["issues"][0]["path"].endswith("bad.rtf")
    explained = {n: c.explain(str(top / n)) for n in ("a/one.txt", "b/pic.bin", "b/bad.rtf", "a/node_modules/x.txt", "a/none.txt")}
    assert explained == {"a/one.txt": "indexed", "b/pic.bin": "filename-only", "b/bad.rtf": "parse-failed", "a/node_modules/x.txt": "excluded", "a/none.txt": "unindexed"}
    assert c.explain("/elsewhere/x") == "outside-root"
    row = c.search("changed").first()
    assert "hello changed" in c.context([("changed", row.reference)])
    with pytest.raises(ContextError):
        c.context([("changed", "5-0000000000000000")])
    c.trash(str(top))
    assert c.roots() == [] and c.search("hello").count() == 0
    assert c.index(str(top))["plan"] == "independent" and c.search("hello").count() >= 2
    c.purge()
    assert c.roots() == [str(top)]
