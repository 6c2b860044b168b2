"""Legacy archive converter: ARC files to WARC files, and readers for both.

ARC: a file opens with a version block whose first line is ``filedesc://NAME IP DATE text/plain [...] LENGTH``
and whose second starts with the version number. Version 1 records have header lines of five fields (URL IP
date type length), version 2 of ten (URL IP date type status checksum location offset file length). The
declared length counts the bytes behind the header line; a newline ends the record. Nothing inside a
block is searched for separators.

WARC: of records with equal payloads of MIN_REVISIT bytes or more that with the largest id is the
response and the others are revisits of it. Record ids are made from (id, URL, date, payload digest), so
a task that runs again writes the same ids.

Files are read with Spark's binaryFile source and written with its text writer (gzip), so any store that
Spark reaches will do. A file is taken whole by one task: the writer puts at most RECORDS_PER_FILE records
into a file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.session import scratch_path

MIN_REVISIT = 1000
RECORDS_PER_FILE = 2000
CHUNK_BYTES = 4 << 20  # bytes of an archive made in memory, and of a batch sent back from a task
DATE = "20200101000000"  # of pages that come without a date
_SPACE = re.compile(rb"[\x00-\x20\x7f-\xff]")
RECORD = "page_id long, url string, date string, mime string, status string, payload binary, payload_bytes long, payload_digest string, record_id string"
CONVERTED = "page_id long, url string, record_type string, record_id string, refers_to long, payload_bytes long, payload_digest string"


def _inflate(data: bytes) -> bytes:
    """Plain bytes, one gzip stream, or gzip members one after another."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        stream = zlib.decompressobj(31)
        out.append(stream.decompress(data))
        out.append(stream.flush())
        data = stream.unused_data
    return b"".join(out)


# ---------------------------------------------------------------- ARC


def _arc_url(url: str | None) -> bytes:
    """A URL as a header field: bytes that would end the field are percent-coded, a missing one is ``-``."""
    return _SPACE.sub(lambda m: b"%%%02X" % m[0][0], (url or "").encode()) or b"-"


def arc_header(version: int, url: str | None, mime: str, length: int, offset: int = 0, digest: str = "-") -> bytes:
    if version == 1:
        return b"%s 0.0.0.0 %s %s %d\n" % (_arc_url(url), DATE.encode(), mime.encode(), length)
    fields = (_arc_url(url), DATE.encode(), mime.encode(), digest.encode(), offset, length)
    return b"%s 0.0.0.0 %s %s 200 %s - %d pages.arc %d\n" % fields


def arc_version_block(version: int) -> bytes:
    fields = "URL IP-address Archive-date Content-type Archive-length"
    if version == 2:
        fields = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    body = f"{version} 0 seriesloom\n{fields}\n".encode()
    if version == 1:
        head = b"filedesc://pages.arc 0.0.0.0 %s text/plain %d\n" % (DATE.encode(), len(body))
    else:
        head = b"filedesc://pages.arc 0.0.0.0 %s text/plain 200 - - 0 pages.arc %d\n" % (DATE.encode(), len(body))
    return head + body + b"\n"


def http_block(page_id: int | None, payload: bytes) -> bytes:
    own = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n%s" % (own, len(payload), payload)


def parse_http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status, headers (lower-case names) and payload; a block that is no HTTP message is all payload."""
    if not block.startswith(b"HTTP/"):
        return "", {}, block
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        head, _, payload = block.partition(b"\n\n")
    lines = head.decode("latin-1").splitlines()
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return (lines[0].split(" ") + [""])[1], headers, payload


def parse_arc(data: bytes) -> Iterator[tuple[str, str, str, str, bytes]]:
    """(url, date, type, status, block) of every record behind the version block.

    The version block's second line names the version, and with it the number of fields. A record whose
    header line has another number of fields, or whose declared length runs past the end, is an error.
    """
    data = _inflate(data)
    at, version, fields = 0, 0, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # separators between records, however many
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header line at byte {at} has no end")
        parts = data[at:end].rstrip(b"\r").split(b" ")
        if not version:
            if not parts[0].startswith(b"filedesc://"):
                raise ValueError("an ARC file starts with a filedesc line")
            line = data[end + 1 : data.find(b"\n", end + 1)]
            version = int(line.split(b" ")[0])
            if version not in (1, 2):
                raise ValueError(f"ARC version {version}")
            fields = 5 if version == 1 else 10
        if len(parts) != fields:
            raise ValueError(f"ARC header at byte {at}: {len(parts)} fields, version {version} has {fields}")
        length = int(parts[-1])
        block = data[end + 1 : end + 1 + length]
        if len(block) != length:
            raise ValueError(f"ARC record at byte {at} declares {length} bytes, {len(block)} are left")
        at = end + 1 + length
        if parts[0].startswith(b"filedesc://"):
            continue
        status = parts[4].decode("latin-1") if version == 2 else ""
        yield parts[0].decode("latin-1"), parts[2].decode("latin-1"), parts[3].decode("latin-1"), status, block


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as ARC archives, one binary ``content`` per row of about CHUNK_BYTES.

    Archives alternate between versions 1 and 2. A null html is an empty payload.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version, parts, size = 1, [], 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["content"])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html = (batch.column(k)[i].as_py() for k in range(3))
                payload = (html or "").encode()
                block = http_block(page_id, payload)
                if not parts:
                    parts.append(arc_version_block(version))
                    size = len(parts[0])
                digest = hashlib.sha1(payload).hexdigest() if version == 2 else "-"
                parts += [arc_header(version, url, "text/html", len(block), size, digest), block, b"\n"]
                size += len(parts[-3]) + len(block) + 1
                if size >= CHUNK_BYTES:
                    yield done()
                    parts, size, version = [], 0, 3 - version
        if parts:
            yield done()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(pack, "content binary")


def read_arc(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records (RECORD columns) of ARC archives given as rows with a binary ``content``.

    ``spark.read.format("binaryFile").load(path)`` gives such rows. ``payloads=False`` leaves the payload
    null. page_id is taken from the X-Page-Id header and null where there is none.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("page_id", pa.int64()), *[(c, pa.string()) for c in ("url", "date", "mime", "status")],
             ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_id", pa.string())]
        )
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for url, date, mime, status, block in parse_arc(content.as_py() or b""):
                    code, headers, payload = parse_http(block)
                    own = headers.get("x-page-id", "")
                    page_id = int(own) if own.lstrip("-").isdigit() else None
                    digest = hashlib.sha1(payload).hexdigest()
                    rows.append(
                        {"page_id": page_id, "url": url, "date": date, "mime": mime, "status": status or code,
                         "payload": payload if payloads else None, "payload_bytes": len(payload),
                         "payload_digest": digest, "record_id": record_id(page_id, url, date, digest)}
                    )
                    size += len(payload) if payloads else 200
                    if size >= CHUNK_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("content").mapInArrow(parse, RECORD)


# ---------------------------------------------------------------- WARC


def record_id(*parts: object) -> str:
    return str(uuid.UUID(bytes=hashlib.sha1("\x00".join(map(str, parts)).encode()).digest()[:16], version=5))


def with_types(records: DataFrame) -> DataFrame:
    """``records`` with refers_to and refers_id of revisits (null: a response).

    The largest id of each digest is found by a map-side combined aggregation of digests alone; only it
    is joined back. Records without an id are responses and never referred to. Of repeated records with
    the largest id all are responses.
    """
    large = records.where((F.col("payload_bytes") >= MIN_REVISIT) & F.col("page_id").isNotNull())
    first = large.groupBy("payload_digest").agg(
        F.max(F.struct("page_id", "record_id")).alias("first"), F.min("page_id").alias("least")
    )
    # only digests that occur more than once matter
    first = first.where("least < first.page_id").select("payload_digest", "first")
    own = F.col("payload_bytes") >= MIN_REVISIT
    other = own & (F.col("page_id") < F.col("first.page_id"))
    return records.join(first, "payload_digest", "left").select(
        *records.columns,
        F.when(other, F.col("first.page_id")).alias("refers_to"),
        F.when(other, F.col("first.record_id")).alias("refers_id"),
    )


def _warc_record(row: dict) -> bytes:
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    revisit = row["refers_id"] is not None
    headers = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{row['record_id']}>",
        "WARC-Date: {0}-{1}-{2}T{3}:{4}:{5}Z".format(*re.match(r"(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)", row["date"]).groups()),
        f"WARC-Target-URI: {row['url']}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        headers += [
            "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{row['refers_id']}>",
            f"X-Refers-To-Page: {row['refers_to']}",
        ]
    block = http_block(row["page_id"], row["payload"])
    if revisit:  # the headers only; their Content-Length still tells the payload's length
        block = block[: len(block) - len(row["payload"])]
    headers += [
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"Content-Length: {len(block)}",
    ]
    # the writer adds the last line end
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n"


def write_warc(records: DataFrame, path: str) -> None:
    """Write records (see ``with_types``) as gzip WARC files below ``path``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for i in range(batch.num_rows):
                record = _warc_record({n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)})
                held.append(record)
                size += len(record)
                if size >= CHUNK_BYTES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])
                    held, size = [], 0

    columns = ["page_id", "url", "date", "payload", "payload_digest", "record_id", "refers_to", "refers_id"]
    lines = records.select(*columns).mapInArrow(build, "value binary").select(F.col("value").cast("string"))
    (
        lines.write.option("lineSep", "\r\n")
        .option("compression", "gzip")
        .option("zlib.compress.level", "BEST_SPEED")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every record, by declared lengths."""
    data = _inflate(data)
    at = 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(headers["content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) != length:
            raise ValueError(f"WARC record at byte {at} declares {length} bytes, {len(block)} are left")
        at = end + 4 + length
        yield headers, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records (CONVERTED columns) of the WARC files below ``path``.

    Block digests are checked, and the payload digest of responses; a mismatch is an error.
    """

    def digest(value: str) -> str:
        return base64.b32decode(value.partition(":")[2]).hex()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()),
             ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
        )
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in parse_warc(content.as_py()):
                    _, http, payload = parse_http(block)
                    if digest(headers["warc-block-digest"]) != hashlib.sha1(block).hexdigest():
                        raise ValueError(f"block digest of {headers['warc-record-id']} is wrong")
                    kind, sha1 = headers["warc-type"], digest(headers["warc-payload-digest"])
                    if kind == "response" and sha1 != hashlib.sha1(payload).hexdigest():
                        raise ValueError(f"payload digest of {headers['warc-record-id']} is wrong")
                    rows.append(
                        {"page_id": int(http["x-page-id"]) if "x-page-id" in http else None, "url": headers["warc-target-uri"],
                         "record_type": kind, "record_id": headers["warc-record-id"].strip("<>").removeprefix("urn:uuid:"),
                         "refers_to": int(headers["x-refers-to-page"]) if "x-refers-to-page" in headers else None,
                         "payload_bytes": int(http["content-length"]), "payload_digest": sha1}
                    )
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").load(path)
    return files.select("content").mapInArrow(parse, CONVERTED)


def convert(archives: DataFrame, path: str) -> None:
    """ARC archives (rows with binary ``content``) to WARC files below ``path``.

    Null, empty and very long payloads are records like others; repeated pages give repeated records; a
    page without an id has no X-Page-Id and is always a response; other columns are ignored. Without any
    page there is one empty folder.
    """
    types = with_types(read_arc(archives, payloads=False)).select("page_id", "record_id", "refers_to", "refers_id")
    types = types.where("refers_to is not null").distinct()
    # the decisions for revisits are joined to the payloads; responses need none
    write_warc(read_arc(archives).join(types, ["page_id", "record_id"], "left"), path)


def convert_pages(pages: DataFrame) -> DataFrame:
    """Pages through ARC archives into WARC files, and the records read back from those files."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    convert(pages_to_arc(pages), path)
    return read_warc(spark, path)
