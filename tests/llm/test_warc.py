import gzip
import hashlib
import io
import json

import pytest

from millrace.llm import warc
from millrace.llm.queries import op12_warc

from ..conftest import SF

PAGES = "page_id bigint, url string, html string"
BIG, OTHER = "<p>é</p>" * 200, "other " * 300


def expected(rows):
    """What the contract says of (id, html) rows, by hand."""
    top = {}
    for i, html in rows:
        if html and len(html.encode()) >= 1000 and i is not None:
            top[html] = max(top.get(html, i), i)
    out = []
    for i, html in rows:
        raw = (html or "").encode()
        kept = top.get(html, i)
        again = kept != i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", kept if again else None))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_odd_pages(spark):
    long = "x" * 3_000_000 + "\r\n\r\nWARC/1.1\r\n"
    texts = [(1, BIG), (7, BIG), (3, BIG), (3, BIG), (7, BIG), (None, BIG), (4, "small"), (5, "small"), (6, None), (8, ""), (9, "\r\n\r\nWARC/1.1\r\n\r\n"), (10, long), (11, long), (12, "a" * 999), (13, "a" * 999), (14, "a" * 1000), (15, "a" * 1000), (None, OTHER), (None, OTHER)]
    pages = spark.createDataFrame([(i, None if i == 4 else f"http://h/{i}\r\nX: y", t) for i, t in texts], PAGES).repartition(3)
    assert found(warc.round_trip(pages)) == expected(texts)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_are_read_by_offset(spark, tmp_path):
    rows = [(k, f"http://h/{k}", f"page {k} " * (k % 40)) for k in range(90)]
    folder = str(tmp_path / "out")
    done = warc.archive(spark.createDataFrame(rows, PAGES).repartition(3), folder).collect()
    assert sum(r.records for r in done) == 90
    for r in done:
        raw = (tmp_path / "out" / r.archive).read_bytes()
        entries = [json.loads(x) for x in (tmp_path / "out" / f"{r.archive}.idx").read_text().splitlines()]
        assert len(raw) == r.bytes == sum(e["length"] for e in entries)
        for e in entries:
            record = gzip.decompress(raw[e["offset"] : e["offset"] + e["length"]])
            head, _, rest = record.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n") and f"Page-ID: {e['id']}\r\n".encode() in head and rest.endswith(b"\r\n\r\n")
        assert gzip.decompress(raw).count(b"WARC-Record-ID") == r.records
    one = warc.read_records(warc.read_index(spark, folder).where("id = '38'"), folder).collect()
    assert [(r.id, r.url, bytes(r.payload).decode()) for r in one] == [("38", "http://h/38", rows[38][2])]
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_streams_given_as_content(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <u:1>\r\nContent-Type: text/plain\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    frame = lambda content: spark.createDataFrame([("x/a.warc.gz", bytearray(content))], "path string, content binary")
    whole, parts = gzip.compress(record * 3), gzip.compress(record) * 3
    for k, content in enumerate((whole, parts)):
        folder = str(tmp_path / str(k))
        assert [tuple(r) for r in warc.normalise(frame(content), folder).select("archive", "records").collect()] == [("a.warc.gz", 3)]
        assert {(r.type, bytes(r.payload)) for r in warc.read_records(warc.read_index(spark, folder), folder).collect()} == {("resource", b"abc")}
    for bad in (whole[:-20], gzip.compress(record[:-6]), gzip.compress(record[:40]), gzip.compress(record.replace(b": 3", b": 2"))):
        with pytest.raises(Exception, match="archive|long"):
            warc.normalise(frame(bad), str(tmp_path / "bad"))
    # a second run over the same archive leaves the same bytes
    before = (tmp_path / "0" / "a.warc.gz").read_bytes()
    warc.normalise(frame(whole), str(tmp_path / "0"))
    assert (tmp_path / "0" / "a.warc.gz").read_bytes() == before


def test_pieces_are_small():
    record = b"WARC/1.0\r\nContent-Length: 5000000\r\n\r\n" + b"z" * 5_000_000 + b"\r\n\r\n"
    assert [len(block) for *_, block in warc.parsed(io.BytesIO(gzip.compress(record * 2)))] == [5_000_000] * 2


def test_query_is_brute_force(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert found(op12_warc(spark, SF)) == expected(rows)
