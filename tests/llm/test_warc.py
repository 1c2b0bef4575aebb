import hashlib

import pytest
import zstandard

from folioscan.llm import queries, warc

PAGES = "page_id long, url string, html string, error string, payload int"


def made(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES)


def expected(rows):
    first = {}
    for i, _, h in rows:
        d = hashlib.sha1((h or "").encode()).digest()
        if i is not None and (d not in first or i < first[d]):
            first[d] = i
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        d = hashlib.sha1(body).digest()
        revisit = d in first and i != first[d]
        out.append((i, len(body), warc.digest32(d), "revisit" if revisit else "response", first[d] if revisit else None))
    return sorted(out, key=str)


def test_round_trip_of_all_kinds_of_rows(spark):
    rows = [(5, "u5", "<p>ä</p>"), (3, "u3\r\nX-Evil: 1", "<p>ä</p>"), (9, None, None), (4, "u4", ""), (7, "u7", "x" * 300000), (7, "u7", "x" * 300000), (None, "n", "<p>ä</p>"), (11, "ü", "WARC/1.1\r\n\r\n")]
    got = warc.page_records(made(spark, rows)).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == expected(rows)
    assert {r.error for r in got} == {None}


def test_empty_table(spark):
    assert warc.page_records(made(spark, [])).count() == 0


def test_payloads_and_small_payloads_stay_responses(spark):
    rows = [(i, f"u{i}", "same" if i % 2 else "a longer payload") for i in range(40)]
    got = warc.archive_round_trip(made(spark, rows), least_bytes=6).collect()
    assert sum(r.record_type == "response" for r in got) == 21
    assert {bytes(r.payload) for r in got if r.record_type == "response"} == {b"same", b"a longer payload"}
    assert sorted(r.target_uri for r in got) == sorted(r[1] for r in rows)


def test_hot_pages_and_null_ids_are_dealt_out(spark, tmp_path):
    rows = [(None, "u", "same text " * 20)] * 900 + [(7, "u", "other text " * 20)] * 700 + [(i, "u", f"page {i} " * 30) for i in range(100, 300)]
    warc.write_archives(made(spark, rows).repartition(3), str(tmp_path / "w"), archive_bytes=40_000, pair_rows=50)
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(rows) and not any(r.error for r in got)
    per = {}
    for r in got:
        per[r.archive] = per.get(r.archive, 0) + 1
    assert len(per) >= 8 and max(per.values()) < 0.3 * len(rows)
    ids = sorted((r.record_id, r.record_type) for r in got if r.record_id in ("<urn:page:null>", "<urn:page:7>"))
    assert ids == [("<urn:page:7>", "response")] * 700 + [("<urn:page:null>", "response")] * 900


def test_query_on_all_pages(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = queries.op1_warc(spark, sf).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == expected(rows)


def record(body=b"hello"):
    return warc.record_bytes(1, "http://a/", body, hashlib.sha1(body).digest(), None, False)


@pytest.mark.parametrize("packed", [False, True])
def test_dictionary_in_the_leading_frame(packed):
    samples = [b"<html><body><p>text number %d and more</p></body></html>" % i * 5 for i in range(300)]
    dictionary = warc.train_dictionary(samples, 4096)
    assert dictionary
    held = zstandard.compress(dictionary) if packed else dictionary
    data = warc.dictionary_frame(held) + warc.SEPARATOR.encode() + warc._compressor(dictionary).compress(record()) + warc.SEPARATOR.encode() + warc._compressor(dictionary).compress(record(b""))
    got = [r for _, r in warc.read_archive(data)]
    assert [r["payload"] for r in got] == [b"hello", b""] and not any(r["error"] for r in got)
    without = [r for _, r in warc.read_archive(data[8 + len(held) :])]
    assert all(r["error"] for r in without)


@pytest.mark.parametrize(
    "raw, what",
    [
        (record().replace(b"WARC/1.1", b"WARX/1.1"), "version"),
        (record().replace(b"WARC-Date", b"WARC-Dat"), "warc-date"),
        (record() + b"x", "content-length"),
        (record().replace(b"hello", b"hellO"), "digest"),
        (record().replace(b"WARC-Type: response", b"no colon here"), "malformed"),
    ],
)
def test_damaged_records_are_named(raw, what):
    good = zstandard.ZstdCompressor().compress(record())
    got = [r for _, r in warc.read_archive(zstandard.ZstdCompressor().compress(raw) + good)]
    assert what in got[0]["error"] and got[1]["error"] is None


def test_truncated_archive():
    good = zstandard.ZstdCompressor().compress(record())
    got = [r for _, r in warc.read_archive(good + good[:-3])]
    assert got[0]["error"] is None and "truncated" in got[1]["error"]
    assert [r["error"] for _, r in warc.read_archive(b"\x50\x2a")] != [None]


def test_two_records_in_one_frame_are_an_error():
    got = [r for _, r in warc.read_archive(zstandard.ZstdCompressor().compress(record() + record()))]
    assert len(got) == 1 and "content-length" in got[0]["error"]
