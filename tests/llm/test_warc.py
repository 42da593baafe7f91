"""Archives: exact round trips, in ranges of any size, with misleading bytes."""

import gzip
import hashlib
import os
import zlib

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from creditloom.llm import warc

SCHEMA = "page_id long, url string, html string"


def described(rows):
    """page_id, payload_bytes, payload_digest, record_type and refers_to as the contract has them."""
    first = {}
    for page_id, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 100 and page_id is not None:
            first[raw] = min(first.get(raw, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        refers = first.get(raw) if page_id is not None else None
        refers = refers if refers is not None and refers < page_id else None
        kind = "response" if refers is None else "revisit"
        out.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), kind, refers))
    return sorted(map(str, out))


PAGES = [
    (5, "http://a/", "<p>" + "copy " * 40),
    (3, "http://b/\r\nX-Bad: 1%0A", "<p>" + "copy " * 40),
    (9, None, "<p>" + "copy " * 40),
    (1, "http://c/", "short"),
    (2, "http://d/", "short"),
    (4, "http://e/", None),
    (6, "http://f/", ""),
    (7, "http://é/日本", "ß\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 50),
    (8, "http://g/", "long " * 400_000),
    (8, "http://g/", "long " * 400_000),
    (None, "http://h/", "<p>" + "copy " * 40),
]


@pytest.mark.parametrize("range_bytes", [64, 1000, 4 << 20])
def test_round_trip(spark, range_bytes):
    df = spark.createDataFrame(PAGES, SCHEMA).withColumns({c: F.lit("own") for c in ("digest", "path", "payload", "size")})
    got = warc.archived_pages(df.repartition(3), range_bytes=range_bytes).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == described(PAGES)


def test_table(spark, small_dir):
    pages = spark.read.parquet(f"{small_dir}/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    got = warc.archived_pages(pages, range_bytes=50_000).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == described(rows)


def test_records_keep_headers_and_payload(spark, tmp_path):
    folder = f"file://{tmp_path}/archives"
    df = spark.createDataFrame(PAGES[:8], SCHEMA)
    listed = warc.write_archives(df, folder)
    assert listed.agg(F.sum("records")).first()[0] == 8
    rows = {r["record_id"]: r for r in warc.read_archives(listed, folder).collect()}
    assert {r["url"] for r in rows.values()} == {u for _, u, _ in PAGES[:8]}
    assert bytes(rows["urn:page:7"]["payload"]).decode() == PAGES[7][2]
    assert rows["urn:page:5"]["record_type"] == "revisit" and bytes(rows["urn:page:5"]["payload"]) == b""
    path = listed.first()["path"]
    raw = open(path, "rb").read()
    assert gzip.decompress(raw).count(b"WARC/1.1\r\nWARC-Type") >= 1  # any gzip reader reads it whole


def test_misleading_bytes(tmp_path):
    """Ranges of every size agree although records contain whole members, stored unpacked."""
    inner = warc.member(77, None, b"inner " * 30, "0", None, "d")
    http = b"HTTP/1.1 200 OK\r\n\r\n"

    def stored(payload):
        head = f"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: {len(http + payload)}\r\n\r\n"
        packer = zlib.compressobj(0, zlib.DEFLATED, 31)
        return packer.compress(head.encode() + http + payload + b"\r\n\r\n") + packer.flush()

    real = [b"\x1f\x8b\x08" * 50, os.urandom(3000), b"\x1f\x8b\x08\0 no member"]
    members = [stored(p) for p in real] + [warc.member(1, "u", b"plain", "0", None, "d")]
    garbage = b"\x1f\x8b\x08 not gzip \x1f\x8b\x08"
    data = garbage + members[0] + members[1] + garbage + members[2] + members[3] + inner[:-9]
    file = tmp_path / "x.warc.gz"
    file.write_bytes(data)
    store = fs.LocalFileSystem()
    for step in (1 << 20, 4096, 100, 7):
        archive, found = warc._Archive(store, str(file)), []
        for start in range(0, len(data), step):
            found += [r["payload"] for r in warc.records_in(archive, "x", start, start + step)]
        archive.close()
        assert found == [*real, b"plain"]  # the truncated last member is none


@pytest.mark.parametrize("range_bytes", [5000, 300_000, 4 << 20])
def test_long_headers(spark, range_bytes):
    """Headers of megabytes, as of a data: address, come back like any other."""
    hexadecimal = os.urandom(1_500_000).hex()
    rows = [(1, "data:text/plain;base16," + hexadecimal, "first " * 30), (2, "data:," + "a" * 5_000_000, "first " * 30), (3, "u", "x")]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = warc.archived_pages(df, range_bytes=range_bytes).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == described(rows)


def test_lost_records_are_an_error(spark, monkeypatch):
    read = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda *a: read(*a).filter("record_id != 'urn:page:1'"))
    with pytest.raises(RuntimeError, match="11 records were written and 10 read back"):
        warc.archived_pages(spark.createDataFrame(PAGES, SCHEMA))


def test_empty_table(spark):
    assert warc.archived_pages(spark.createDataFrame([], SCHEMA)).count() == 0
