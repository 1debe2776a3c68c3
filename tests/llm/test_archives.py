import hashlib
import io

import pytest
from pyspark.sql import functions as F

from stayframe.llm import warc
from stayframe.session import scratch_path

KIND = "page_id bigint, url string, html string"
BODY = "<html>\r\n\r\nWARC/1.1\r\n" + "é" * 60
PAGES = [
    (5, "http://a/5", BODY), (3, "http://a/3 x\r\ny", BODY), (9, None, BODY), (1, "http://a/1", None), (2, "http://a/2", ""),
    (4, "http://a/4", "short"), (6, "http://a/6", "short"), (None, "http://a/n", BODY), (7, "http://a/7", "z" * 200_000), (8, "http://a/8", "y" * 100),
    (8, "http://a/8", "y" * 100),
]


def read(spark, rows):
    place = scratch_path(spark, "warc")
    pages = spark.createDataFrame(rows, KIND).withColumns({n: F.lit(1) for n in ("key", "body", "name", "id", "copies", "bytes", "shared")})
    warc.write_warc(pages, place)
    return warc.captures(warc.read_records(spark, place)).collect()


def test_captures_of_odd_pages(spark):
    found = read(spark, PAGES)
    assert len(found) == len(PAGES)
    seen = []
    for r in found:
        page = r["metadata"]["fields"]["page-id"]
        body = next((h or "") for i, _, h in PAGES if str("" if i is None else i) == page).encode()
        seen.append(page)
        assert r["request"]["record_type"] == "request" and r["capture"]["record_id"] == r["capture_id"]
        assert r["capture"]["payload_digest"] == hashlib.sha256(body).hexdigest()
        assert int(r["metadata"]["fields"]["payload-bytes"]) == len(body)
        if page in ("5", "9", ""):
            assert r["capture"]["record_type"] == "revisit" and r["metadata"]["fields"]["refers-to-page"] == "3"
        else:
            assert r["capture"]["record_type"] == "response" and bytes(r["capture"]["payload"]) == body
    assert sorted(seen) == sorted("" if i is None else str(i) for i, _, _ in PAGES)
    assert len({r["capture_id"] for r in found}) == len(PAGES)


def test_no_pages(spark):
    assert read(spark, []) == []


def test_parts_may_be_missing(spark):
    place = scratch_path(spark, "warc")
    head = "WARC/1.1\r\nWARC-Type: {}\r\nWARC-Record-ID: <{}>\r\n{}Content-Length: 2\r\n\r\nok"
    to = "WARC-Concurrent-To: <{}>\r\n"
    made = [head.format("response", "a", ""), head.format("request", "b", to.format("gone")), head.format("request", "d", to.format("a")), head.format("request", "c", to.format("a"))]
    spark.createDataFrame([(x,) for x in made], "value string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(place)
    found = {r["capture_id"]: r for r in warc.captures(warc.read_records(spark, place)).collect()}
    assert found["a"]["request"]["record_id"] == "c" and found["a"]["metadata"] is None
    assert found["gone"]["capture"] is None and found["gone"]["request"]["record_id"] == "b"


def test_broken_archives_are_told():
    with pytest.raises(ValueError):
        list(warc.parse_records(io.BytesIO(b"HTTP/1.1 200 OK\r\n\r\n")))
    with pytest.raises(ValueError):
        list(warc.parse_records(io.BytesIO(b"WARC/1.1\r\nWARC-Type: response\r\n")))
    assert list(warc.parse_records(io.BytesIO(b"\r\n\r\n"))) == []
