import random

import pytest

from grove.llm import warc
from grove.llm.scratch import Scratch

DATE = "2020-01-01T00:00:00Z"


def some(n=30):
    return [warc.record(i, f"http://x/{i}", f"<p>{i}</p>".encode() * (i + 1), None if i % 3 else (0 if i else None), DATE) for i in range(n)]


def ids(rows):
    return [int(r["id"].removeprefix("urn:page:")) for r in rows if r["kind"] == "record" and r["id"].removeprefix("urn:page:").isdecimal()]


def test_whole_archives():
    for data in (b"".join(some()), b"".join(map(warc.member, some()))):
        rows = list(warc.salvage(data))
        assert ids(rows) == list(range(30)) and not [r for r in rows if r["kind"] == "gap"]
        assert sum(r["length"] for r in rows) == len(data)
    assert list(warc.salvage(b"")) == []


def test_salvage_finds_all_that_is_whole():
    rng = random.Random(4)
    for packed in (True, False):
        for _ in range(60):
            parts = [warc.member(x) if packed else x for x in some(12)]
            hurt = set(rng.sample(range(12), rng.randint(1, 4)))
            for i in hurt:
                part, how = bytearray(parts[i]), rng.randrange(3)
                if how == 0:
                    for _ in range(3):
                        part[rng.randrange(10, len(part) - 4)] ^= 0x5A
                elif how == 1:
                    part = part[: rng.randrange(1, len(part))]
                else:
                    part = bytearray(rng.randbytes(40))
                parts[i] = bytes(part)
            data = b"".join(parts)
            rows = list(warc.salvage(data))
            assert set(range(12)) - hurt <= set(ids(rows))
            assert sum(r["length"] for r in rows) == len(data)  # records and gaps cover all bytes
            assert [r["offset"] for r in rows] == sorted(r["offset"] for r in rows)


def test_mark_inside_a_payload_is_no_record():
    inner = b"text WARC/1.1\r\nWARC-Type: response\r\n\r\n and \x1f\x8b\x08 more"
    data = warc.record(1, "u", inner, None, DATE) + warc.record(2, "u", b"x", None, DATE)
    assert ids(warc.salvage(data)) == [1, 2]


def test_round_trip_through_spark(spark):
    html = [(5, "a", "<b>x</b>"), (3, "b", "<b>x</b>"), (9, None, None), (8, "c", ""), (7, "d", "é" * 5000), (7, "d", "é" * 5000), (None, "e", "<b>x</b>"), (1, "line\r\nbreak", "solo")]
    df = spark.createDataFrame([(*r, "clash") for r in html], "page_id long, url string, html string, sha string").repartition(2)
    folder = Scratch(spark, "test").path("warc")
    files = warc.write_warc(df, folder, most=300)
    assert files.count() > 1 and sum(r.records for r in files.collect()) == len(html)
    rows = warc.read_warc(spark, folder).collect()
    assert all(r.kind == "record" for r in rows) and len(rows) == len(html)
    first = {"<b>x</b>": 3, "": 8, "é" * 5000: 7, "solo": 1}
    for page, _, text in html:
        r = next(r for r in rows if r.id == f"urn:page:{page}")
        payload = (text or "").encode()
        assert r.payload_bytes == len(payload) and r.payload_digest == warc.digest32(payload)
        same = first[text or ""]
        assert (r.type, r.refers_to) == (("response", None) if page == same else ("revisit", f"urn:page:{same}"))
        assert r.payload == (payload if page == same else None)


def test_threshold_and_emptiness(spark):
    df = spark.createDataFrame([(1, "a", "xx"), (2, "a", "xx"), (3, "a", "longer text"), (4, "a", "longer text")], "page_id long, url string, html string")
    folder = Scratch(spark, "test").path("warc")
    warc.write_warc(df, folder, least=5).count()
    assert {r.id[-1]: r.type for r in warc.read_warc(spark, folder).collect()} == {"1": "response", "2": "response", "3": "response", "4": "revisit"}
    assert warc.write_warc(df.limit(0), Scratch(spark, "test").path("warc")).count() == 0


def test_long_urls(spark, tmp_path):
    url = "data:text/html," + "x" * 100_000
    data = warc.record(1, url, b"one", None, DATE) + warc.record(2, url, b"one", 1, DATE) + warc.record(3, "u", b"three", None, DATE)
    rows = list(warc.salvage(data))
    assert ids(rows) == [1, 2, 3] and [r["uri"] for r in rows] == [url, url, "u"]
    assert ids(warc.salvage(data[: data.index(b"\r\nWARC-Target")] + data[data.index(b"WARC/1.1", 9) :])) == [2, 3]
    pages = spark.createDataFrame([(1, url, "a"), (2, url * 30, "a"), (3, "u", "b")], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    assert {(r.page_id, r.record_type, r.refers_to) for r in warc.op5_warc(spark, str(tmp_path)).collect()} == {(1, "response", None), (2, "revisit", 1), (3, "response", None)}


def test_headers_without_end_take_linear_time():
    assert ids(warc.salvage((b"WARC/1.1\r\n" + b"x" * 50) * 50_000 + some(1)[0])) == [0]


def test_a_lost_record_fails_the_query(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "u", "a"), (2, "v", "b")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    read = warc.read_warc
    monkeypatch.setattr(warc, "read_warc", lambda *a, **b: read(*a, **b).filter("id <> 'urn:page:2'"))
    with pytest.raises(RuntimeError, match="2 records written, 1 read"):
        warc.op5_warc(spark, str(tmp_path))


def test_gaps_are_logged_and_files_of_lost_attempts_are_not_read(spark, tmp_path):
    rows = [(i, "u", f"<p>{i % 4}</p>") for i in range(20)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in warc.op5_warc(spark, str(tmp_path)).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {i: ("response", None) if i < 4 else ("revisit", i % 4) for i in range(20)}
    whole, hurt = warc.member(some(3)[0]), bytearray(warc.member(some(3)[1]))
    hurt[40] ^= 1
    (tmp_path / "a.warc.gz").write_bytes(whole + bytes(hurt) + whole)
    gaps = warc.logged_gaps(warc.read_warc(spark, str(tmp_path / "a.warc.gz")), Scratch(spark, "test")).collect()
    assert [(g.offset, g.length) for g in gaps] == [(len(whole), len(hurt))] and gaps[0].reason
