import gzip
import hashlib
import io

import pytest

from corpusloom.llm import warc

BIG = "<p>" + "segment me éü " * 9000 + "</p>"
ROWS = [
    (1, "http://a/x", "<html>" + "dup " * 50), (2, "http://b/y", "<html>" + "dup " * 50), (3, None, None), (4, "u", ""), (5, "u", "tiny"), (6, "u", "tiny"), (7, "http://é/ \r\nx", BIG), (8, "v", BIG),
    (9, "w", "0\r\n\r\nWARC/1.1\r\n" * 20), (2, "http://b/y", "<html>" + "dup " * 50), (None, "n", "nameless " * 30),
]


DATE = "2026-01-02T03:04:05Z"


def brute(rows):
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if p is not None and len(b) >= 100:
            first[b] = min(p, first.get(b, p))
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        rev = b in first and p != first[b]
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if rev else "response", first[b] if rev else None, None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment", [64, 5000, 1 << 20])
def test_round_trip(spark, tmp_path, segment):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3)
    archives = warc.write_archives(pages, str(tmp_path / "w"), segment_bytes=segment, archive_bytes=2000)
    archives = spark.createDataFrame(archives.collect(), archives.schema)
    assert sum(r.records for r in archives.collect()) == len(ROWS)
    assert sorted(map(tuple, warc.read_archives(archives).collect()), key=repr) == brute(ROWS)


def test_real_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=repr) == brute(rows)
    assert warc.round_trip(pages.limit(0)).count() == 0


def archive(tmp_path, records):
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(gzip.compress(r) for r in records))
    return str(path)


def test_damage_is_told(spark, tmp_path):
    records = list(warc.page_records(1, "0-0", "u", "body " * 100, hashlib.sha256(b"body " * 100).hexdigest(), False, 100, DATE))
    whole = [r for r in records]
    missing = whole[:1] + whole[2:]
    short = whole[:-1] + [whole[-1].replace(b"WARC-Segment-Total-Length: ", b"WARC-Segment-Total-Length: 9")]
    for given, error in ((whole, None), (list(reversed(whole)), None), (missing, "segments are missing or doubled"), (whole + whole[1:2], "segments are missing or doubled"), (short, "total length differs")):
        df = spark.createDataFrame([(archive(tmp_path, given),)], "path string")
        row = warc.read_archives(df).first()
        assert row.error == error and (row.payload_bytes == 500) == (error is None)


def test_headers_and_revisits(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(2)
    root = str(tmp_path / "w")
    archives = warc.write_archives(pages, root, segment_bytes=5000).collect()
    records = [r for a in archives for r in warc.read_records(gzip.open(a.path))]
    ids = [h["warc-record-id"] for h, _ in records]
    assert len(set(ids)) == len(ids)
    for h, block in records:
        assert h["warc-date"].endswith("Z") and int(h["content-length"]) == len(block) and (h["warc-type"] == "continuation" or h["content-type"] == "application/http;msgtype=response")
    digests = {h["warc-payload-digest"] for h, _ in records if h["warc-type"] == "response"}
    revisits = [h for h, _ in records if h["warc-type"] == "revisit"]
    assert revisits and all(h["warc-payload-digest"] in digests and "warc-profile" in h for h in revisits)


def test_a_revisit_without_its_response_is_told(spark, tmp_path):
    given = list(warc.page_records(7, "0-0", "u", "lost " * 90, hashlib.sha256(b"lost " * 90).hexdigest(), True, 100, DATE))
    row = warc.read_archives(spark.createDataFrame([(archive(tmp_path, given),)], "path string")).first()
    assert (row.page_id, row.record_type, row.refers_to, row.error) == (7, "revisit", None, "no response holds the payload")


def test_a_page_of_many_megabytes(spark, tmp_path):
    html = "<p>" + "é0123456789 " * 1_500_000
    pages = spark.createDataFrame([(1, "http://a/", html), (2, "http://b/", html)], "page_id long, url string, html string")
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=repr) == brute([(1, None, html), (2, None, html)])


def test_chunks():
    assert warc.dechunk(warc.chunked(b"abc" * 5000, 7)) == b"abc" * 5000 and warc.dechunk(b"0\r\n\r\n") == b""
    assert warc.dechunk(b"3;name=x\r\nabc\r\n0\r\n\r\n") == b"abc"
    for bad in (b"5\r\nabc", b"3\r\nabcd\r\n0\r\n\r\n", b""):
        with pytest.raises(ValueError):
            warc.dechunk(bad)
    assert [b for _, b in warc.read_records(io.BytesIO(warc.record("response", "urn:page:1:x", b"x\r\n\r\ny", {})))] == [b"x\r\n\r\ny"]
