"""WARC archives: written by Spark tasks, read back in byte ranges.

An archive is a series of gzip members, one for each record, so a reader can start
at any member. A reading task scans its range of bytes for the gzip magic, and
takes a place for a member only if what follows inflates to a WARC header and to
the member's end with the right checksum. A record belongs to the range in which
its member starts, even if it ends in the next one; what a range finds before its
first member belongs to an earlier range.

Tasks write archives under names of their own; the list of archives is a table
that Spark commits, so files of lost or repeated tasks are never read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.batches import small_batches
from creditloom.session import materialise, scratch_path

#: Payloads of fewer bytes are never replaced by a revisit.
SMALLEST_REVISIT = 100
RANGE_BYTES = 4 << 20
_READ = 1 << 18
_MAGIC = b"\x1f\x8b\x08"
_PAGE = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _clean(value: str) -> str:
    """A header value on one line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unclean(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = f"{_PAGE}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        fields.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        fields += [f"WARC-Refers-To: <{_PAGE}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _write(folder: str, date: str):
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        path, stream, records = f"{root}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if stream is None:
                    store.create_dir(root, recursive=True)
                    stream = store.open_output_stream(path, compression=None)
                stream.write(member(*(x.as_py() for x in row), date))
                records += 1
        if stream is not None:
            stream.close()
            size = store.get_file_info(path).size
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [records]})

    return written


def write_archives(pages: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html) under ``folder``.

    Of pages with equal payloads of at least 100 bytes the smallest page_id is a
    response and the others are revisits of it; all else are responses, rows
    with a null page_id too. A null html is an empty payload. Rows that repeat the
    smallest page_id are responses as well. Returns the committed list of
    archives: path, bytes, records. An empty table writes none. ``folder`` must
    be one that all executors reach; other columns are not read.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
    )
    named = rows.filter((F.octet_length("payload") >= SMALLEST_REVISIT) & F.col("page_id").isNotNull())
    firsts = named.groupBy("digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    joined = rows.join(firsts.filter("_rows > 1").drop("_rows"), "digest", "left")
    revisit = F.when(F.col("page_id") > F.col("_first"), F.col("_first"))
    listed = joined.select("page_id", "url", "payload", "digest", revisit.alias("refers_to")).mapInArrow(
        _write(folder, date), "path string, bytes long, records long"
    )
    return materialise(listed, "warc-list")


class _Archive:
    """A file read in pieces."""

    def __init__(self, store: fs.FileSystem, path: str) -> None:
        self._file = store.open_input_file(path)
        self.size = self._file.size()

    def read(self, at: int, count: int) -> bytes:
        self._file.seek(at)
        return self._file.read(count)

    def close(self) -> None:
        self._file.close()


def _magics(archive: _Archive, start: int, end: int) -> Iterator[int]:
    """Places of the gzip magic that start in the range; ``send`` moves on."""
    at = start
    while at < end:
        block = archive.read(at, _READ + len(_MAGIC) - 1)
        found, base = block.find(_MAGIC), at
        at += _READ
        while found >= 0 and base + found < min(end, base + _READ):
            moved = yield base + found
            if moved is not None:
                at = moved
                break
            found = block.find(_MAGIC, found + 1)


def _inflate(archive: _Archive, at: int) -> tuple[bytes, int] | None:
    """The content of the member at ``at`` and the place behind it, if it is a whole WARC record."""
    unpacker, content, read, ended = zlib.decompressobj(31), bytearray(), at, -1
    while not unpacker.eof:
        block = archive.read(read, _READ)
        if not block:
            return None
        read += len(block)
        seen = max(0, len(content) - 3)
        try:
            content += unpacker.decompress(block)
        except zlib.error:
            return None
        if not b"WARC/1.".startswith(content[:7]):
            return None
        # Headers may be of any length: the member's end bounds them.
        if ended < 0:
            ended = content.find(b"\r\n\r\n", seen)
    return (bytes(content), read - len(unpacker.unused_data)) if ended >= 0 else None


def parse(content: bytes) -> dict | None:
    """Fields of an inflated record; None if its length is not what it says."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    if not fields.get("content-length", "").isdigit() or len(rest) < int(fields["content-length"]):
        return None
    block = rest[: int(fields["content-length"])]
    is_http = fields.get("content-type", "").startswith("application/http")
    payload = block.partition(b"\r\n\r\n")[2] if is_http else block
    target = fields.get("warc-target-uri")
    return {
        "record_type": fields.get("warc-type"),
        "record_id": fields.get("warc-record-id", "").strip("<>"),
        "date": fields.get("warc-date"),
        "url": None if target is None else _unclean(target),
        "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        "stated_digest": fields.get("warc-payload-digest"),
        "payload": payload,
    }


_RECORD = (
    "path string, at long, bytes long, record_type string, record_id string, date string, url string, refers_to string, "
    "stated_digest string, payload binary"
)
_RECORD_TYPES = pa.schema(
    [("path", pa.string()), ("at", pa.int64()), ("bytes", pa.int64())]
    + [(c, pa.string()) for c in ("record_type", "record_id", "date", "url", "refers_to", "stated_digest")]
    + [("payload", pa.binary())]
)


def records_in(archive: _Archive, path: str, start: int, end: int) -> Iterator[dict]:
    """The records whose members start in ``[start, end)``."""
    places = _magics(archive, start, min(end, archive.size))
    at = next(places, None)
    while at is not None:
        found = _inflate(archive, at)
        record = parse(found[0]) if found else None
        if record is None:
            at = next(places, None)
            continue
        yield {"path": path, "at": at, "bytes": found[1] - at, **record}
        try:
            at = places.send(found[1])
        except StopIteration:
            return


def _read(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
                archive, rows, size = _Archive(store, path), [], 0
                for record in records_in(archive, path, start, end):
                    rows.append(record)
                    size += len(record["payload"])
                    if size > RANGE_BYTES or len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, _RECORD_TYPES)
                        rows, size = [], 0
                archive.close()
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _RECORD_TYPES)

    return read


def read_archives(archives: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of ``archives`` (path, bytes), read in ranges of ``range_bytes``.

    Returns path, at and bytes of the member, record_type, record_id, date, url,
    refers_to, stated_digest and payload (without HTTP headers). Bytes that are no
    WARC member are passed over.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))
    ranges = archives.filter("bytes > 0").select("path", F.explode(starts).alias("start"))
    ranges = ranges.withColumn("end", F.col("start") + range_bytes)
    return ranges.repartition("path", "start").mapInArrow(_read(folder), _RECORD)


def archived_pages(pages: DataFrame, folder: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write ``pages`` as WARC archives, read them back and describe every record.

    Returns page_id, payload_bytes and payload_digest (SHA-256) of the full
    payload, record_type and refers_to (page_id of the response that a revisit
    names, else null). What a revisit leaves out comes from the response with
    its digest. Reading another number of records than were written is an error.
    URLs and payloads may be of any length. Rules for nulls, repeated rows and empty tables are those of
    ``write_archives``; a null page_id comes back as null.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or scratch_path(spark, "warc")
    if "://" not in folder and folder.startswith("file:"):
        folder = folder.replace("file:", "file://", 1)
    archives = write_archives(pages, folder)
    records = read_archives(archives, folder, range_bytes)
    page = F.regexp_extract("record_id", rf"^{_PAGE}(-?\d+)$", 1)
    seen = materialise(
        records.select(
            F.when(page != "", page.cast("long")).alias("page_id"),
            "record_type",
            F.regexp_replace("refers_to", f"^{_PAGE}", "").cast("long").alias("refers_to"),
            F.regexp_replace("stated_digest", "^sha256:", "").alias("stated"),
            F.when(F.col("record_type") == "response", F.sha2("payload", 256)).alias("digest"),
            F.octet_length("payload").cast("long").alias("size"),
        ),
        "warc-records",
    )
    written, read = archives.agg(F.sum("records")).first()[0] or 0, seen.count()
    if read != written:
        raise RuntimeError(f"{written} records were written and {read} read back")
    full = seen.filter("record_type = 'response'")
    known = full.groupBy("digest").agg(F.max("size").alias("size"))
    revisits = seen.filter("record_type = 'revisit'").drop("digest", "size")
    resolved = revisits.join(known, revisits["stated"] == known["digest"], "left")
    columns = [
        "page_id",
        F.col("size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    ]
    return full.select(*columns).union(resolved.select(*columns))
