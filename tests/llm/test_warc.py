import gzip
import hashlib
import random

import pytest

from layertext.llm import shared, warc


def test_framing():
    r = random.Random(1)
    for n in (0, 1, 8191, 8192, 8193, 30000):
        payload = r.randbytes(n)
        assert warc.dechunked(warc.chunked(payload)) == payload
        assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nT: v\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


def pages():
    big = "ä\r\n\r\n" * 40_000
    return [(1, "http://a/1", "x" * 1000), (2, "http://a/2", "x" * 1000), (3, None, "x" * 1000), (4, "u v\nw", "x" * 999), (5, "", "x" * 999), (6, "ü", big), (7, "h", None), (8, "h", ""), (None, "n", "x" * 1000), (6, "ü", big), (9, "z", big + "!")]


def test_round_trip(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").selectExpr("*", "1 as payload", "2 as digest", "3 as key")
    out = sorted(map(tuple, warc.round_trip(df).collect()), key=repr)
    want = []
    for i, _, html in pages():
        b = (html or "").encode()
        refers = max(j for j, _, h in pages() if j is not None and h == html)
        again = len(b) >= 1000 and refers != i
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", refers if again else None))
    assert out == sorted(want, key=repr)
    assert warc.round_trip(df.limit(0)).collect() == []


def test_payloads_and_damage(spark, tmp_path):
    df = spark.createDataFrame([(6, "u", "ä" * 50_000), (7, "u", "b")], "page_id long, url string, html string")
    path = shared.new_path(spark, "warc")
    warc.write_archives(df, path)
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(spark, path).collect()}
    assert got == {6: "ä" * 50_000, 7: "b"}
    block = warc._HTTP.encode() + b"Transfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"q" * 90)
    records = warc.segments("urn:layertext:page:1:1", [], "response", block, 64)
    assert len(records) > 2
    for name, kept in (("whole", records[::-1]), ("missing", records[:1] + records[2:]), ("unended", records[:-1])):
        (tmp_path / f"{name}.gz").write_bytes(gzip.compress(b"".join(x + warc.END for x in kept)))
        (row,) = warc.read_archives(spark, str(tmp_path / f"{name}.gz")).collect()
        assert row.intact == (name == "whole") and (bytes(row.payload) == b"q" * 90 if row.intact else row.payload is None)
