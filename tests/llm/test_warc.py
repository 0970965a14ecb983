import gzip
import io

import pytest

from tessera.llm import warc as w


def test_versions_and_lengths():
    for version in (1, 2):
        data = w.arc_header(version, "a.arc", "20010203040506") + w.arc_record(version, "http://x/", "20010203040506", "text/plain", b"one\n\ntwo\n") + w.arc_record(version, "http://y/", "2001", "text/html", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody")
        kinds = [w.synthesise(*r) for r in w.walk_arc(data)]
        assert [k[1] for k in kinds] == ["warcinfo", "resource", "response"]
        assert kinds[1][3] == "2001-02-03T04:05:06Z" and kinds[2][3] == "1970-01-01T00:00:00Z"
        assert kinds[1][9] == b"one\n\ntwo\n" and kinds[2][8:] == (b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n", b"body") and kinds[2][7] == 4
        assert [w.synthesise(*r) for r in w.walk_arc(data)] == kinds and len({k[0] for k in kinds}) == 3


def test_broken_archives():
    good = w.arc_header(1, "a", "20010203") + w.arc_record(1, "http://x/ y", "20010203", "text/plain", b"12345")
    for bad in (good[:-3], good + b"no header line", good + b"http://z 1 2 t 99\nshort"):
        got = [w.synthesise(*r) for r in w.walk_arc(bad)]
        assert got[-1][1] == "metadata" and got[0][1] == "warcinfo"
    assert list(w.walk_arc(b"")) == [] and list(w.walk_arc(b"\n\n")) == []
    assert w.iso_date("20240229") == "2024-02-29T00:00:00Z" and w.iso_date("x") == "1970-01-01T00:00:00Z"


def test_reading_members_and_plain():
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    packed = gzip.compress(record) + gzip.compress(record)
    stream = io.BufferedReader(w._Stream(w._inflated(packed)))
    assert [b for _, b in w.walk_warc(stream)] == [b"abc", b"abc"]
    assert [h["warc-type"] for h, _ in w.walk_warc(io.BytesIO(record))] == ["resource"]
    assert [b for _, b in w.walk_warc(io.BytesIO(b"junk"))] == [b"junk"]
    big = b"x" * (w.LIMIT + 5)
    assert b"".join(w._inflated(gzip.compress(big))) == big


@pytest.mark.parametrize("version", [1, 2])
def test_round_trip(spark, tmp_path, version):
    html = "<p>" + "same text " * 20 + "</p>"
    rows = [(5, "http://a/x y", html), (2, None, html), (9, "http://b/", html), (1, "http://c/", "short"), (3, "http://c/", "short"), (7, "u", None), (None, "n", html), (9, "http://b/", html), (8, "é://ü", "WARC/1.1\r\n\r\nWARC/1.1\r\n" * 9)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, content string, key string")
    arcs = w.to_arc(pages, version=version)
    narrow = w.stored(w.convert(arcs, payloads=False).withColumn("key", w.page_key()), "t")
    records = w.with_revisits(w.convert(arcs), narrow, narrow["key"])
    path = str(tmp_path / "out")
    w.write_warc(records, path)
    got = [r for r in w.read_warc(spark, path).withColumn("page", w.page_key()).collect() if r.type in ("response", "revisit")]
    assert len(got) == len(rows)
    kinds = sorted((str(r.page), r.type) for r in got)
    assert kinds == sorted([("5", "revisit"), ("2", "response"), ("9", "revisit"), ("9", "revisit"), ("1", "response"), ("3", "response"), ("7", "response"), ("None", "revisit"), ("8", "response")])
    by = {r.page: r for r in got}
    assert all(r.refers_to == by[2].record_id for r in got if r.type == "revisit")
    for k, _, text in rows:
        if by[k].type == "response":
            assert bytes(by[k].payload).decode() == (text or "") and by[k].payload_digest == by[k].declared_digest and by[k].payload_bytes == len((text or "").encode())
    assert by[2].uri == "unknown:" and by[5].uri == "http://a/x%20y" and by[8].uri == "é://ü"
    if version == 1:
        one = gzip.open(next((tmp_path / "out").glob("part-*"))).read()
        assert one.startswith(b"WARC/1.1\r\nWARC-Type: ") and one.endswith(b"\r\n\r\n")


def test_files_have_a_size(spark, tmp_path):
    """Files end after so many records, whatever the partitions; all records are read back."""
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * 30) for i in range(95)], "page_id long, url string, html string").coalesce(1)
    arcs = w.to_arc(pages)
    narrow = w.stored(w.convert(arcs, payloads=False).drop("payload"), "t")
    assert w.per_file(narrow, 10_000) < 10 and w.per_file(narrow.limit(0)) > 1 and w.per_file(narrow, 1) == 1
    path = str(tmp_path / "out")
    w.write_warc(w.convert(arcs), path, 10)
    assert len(list((tmp_path / "out").glob("part-*"))) == 10
    got = [r for r in w.read_warc(spark, path).withColumn("page", w.page_key()).collect() if r.type == "response"]
    assert sorted((r.page, bytes(r.payload).decode()) for r in got) == [(i, f"page {i} " * 30) for i in range(95)]
