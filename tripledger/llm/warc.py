"""WARC archives as a Spark data source, and pages with revisit records.

Writing: every task writes one archive into the target folder through pyarrow's file systems, so
the folder may be in any store they reach; it must be shared by all executors. The driver
commits by writing MANIFEST, the list of archives of the attempts that succeeded. Readers of a
folder with a MANIFEST see exactly those, so a lost executor or a repeated task leaves nothing
double.

Reading: files are dealt to partitions by size. Of each record the WARC headers are parsed first,
then the HTTP headers of its block. Predicates on the record type and on header columns are
pushed down and decide at that point: the payload of a record that fails them is not inflated,
and is skipped in the file where its length is known (plain archives, and compressed ones with
the skip-length field `sl`, which the writer sets). Without option payload = true no payload is
decoded at all.
"""

import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)

from tripledger.sources.workdir import materialize

MANIFEST = "MANIFEST"
VERSION = b"WARC/1.1"
#: Column and the WARC header it shows.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}
SCHEMA = pa.schema(
    [*((c, pa.string()) for c in HEADERS), ("payload_length", pa.int64()), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64())]
)
SPARK_SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload_length long, payload binary, file string, offset long"
BATCH_BYTES = 8_000_000
BATCH_ROWS = 4096


# --- records ------------------------------------------------------------------------------


def _line(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n]+", " ", value)


def encode_record(row: dict) -> bytes:
    """One record, uncompressed. The block is an HTTP response; that of a revisit has headers
    only, which name the length of the payload that it leaves out."""
    payload = row["payload"] or b""
    length = row["payload_length"] if row["payload_length"] is not None else len(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http if row["record_type"] == "revisit" else http + payload
    lines = [f"{HEADERS[c]}: {_line(row[c])}" for c in HEADERS if row.get(c) is not None]
    if row["record_type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field `sl` tells its compressed and uncompressed length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    total = 12 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Head:
    """The headers of a record, and where its payload is."""

    headers: dict[str, str]
    http: dict[str, str] | None
    offset: int
    payload_length: int | None

    def column(self, name: str):
        if name == "payload_length":
            return self.payload_length
        return self.offset if name == "offset" else self.headers.get(HEADERS[name].lower())


class Stream:
    """The uncompressed bytes of one record, plain or one gzip member, inflated on demand."""

    def __init__(self, file, offset: int):
        self.file, self.offset, self.buffer, self.inflated = file, offset, b"", 0
        file.seek(offset)
        first = file.read(2)
        self.zip, self.member = first == b"\x1f\x8b", None
        if self.zip:
            rest = file.read(10)
            if len(rest) == 10 and rest[1] & 4:
                extra = file.read(struct.unpack("<H", rest[8:10])[0])
                at = 0
                while at + 4 <= len(extra):
                    size = struct.unpack("<H", extra[at + 2 : at + 4])[0]
                    if extra[at : at + 2] == b"sl" and size == 8:
                        self.member = struct.unpack("<I", extra[at + 4 : at + 8])[0] or None
                    at += 4 + size
            self.unzip = zlib.decompressobj(31)
        file.seek(offset)
        self.end = not first

    def more(self, size: int = 16384) -> bool:
        """Get some more bytes; False at the end of the record's member or of the file."""
        if self.end:
            return False
        if not self.zip:
            data = self.file.read(size)
        else:
            data = b""
            while not data and not self.unzip.eof:
                raw = self.unzip.unconsumed_tail or self.file.read(size)
                if not raw:
                    raise ValueError("a compressed record is cut off")
                data = self.unzip.decompress(raw, 4 * size)
        self.end = not data
        self.inflated += len(data)
        self.buffer += data
        return bool(data)

    def until(self, mark: bytes) -> bytes:
        """Bytes before the mark; the mark is passed over."""
        seen = 0
        while (at := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark) + 1)
            if not self.more():
                raise ValueError("headers are cut off")
        out, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
        return out

    def take(self, size: int) -> bytes:
        parts, left = [], size
        while left > 0:
            if not self.buffer and not self.more(max(16384, min(left, 1 << 20))):
                raise ValueError("a block is cut off")
            parts.append(self.buffer[:left])
            self.buffer = self.buffer[len(parts[-1]) :]
            left -= len(parts[-1])
        return b"".join(parts)

    def next_offset(self, left: int) -> int:
        """Where the next record starts, `left` bytes of the block not being taken yet."""
        if not self.zip:
            return self.offset + self.inflated - len(self.buffer) + left + 4
        if self.member:
            return self.offset + self.member
        self.buffer = b""
        while self.more():  # an unknown length has to be inflated to find its end
            self.buffer = b""
        return self.file.tell() - len(self.unzip.unused_data)


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    pairs = (line.split(":", 1) for line in lines if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def read_records(file, wanted: Callable[[Head], bool], decode: bool) -> Iterator[tuple[Head, bytes | None]]:
    """(head, payload) of the wanted records of an open archive; payload is None unless decoded,
    and for records without one of their own."""
    offset = 0
    while True:
        stream = Stream(file, offset)
        if not stream.more():
            return
        if not stream.buffer.lstrip(b"\r\n") and not stream.zip and not stream.more():
            return
        raw = stream.until(b"\r\n\r\n")
        if not raw.lstrip(b"\r\n").startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {offset}")
        headers = _headers(raw.lstrip(b"\r\n"))
        left = int(headers["content-length"])
        http, length = None, left
        if headers.get("content-type", "").startswith("application/http"):
            raw = stream.until(b"\r\n\r\n")
            http, left = _headers(raw), left - len(raw) - 4
            length = int(http.get("content-length", left))
        head = Head(headers, http, offset, length)
        payload = None
        keep = wanted(head)
        if keep and decode and headers.get("warc-type") != "revisit":
            payload = stream.take(left)
            left = 0
        if keep:
            yield head, payload
        offset = stream.next_offset(left)


# --- the data source ----------------------------------------------------------------------


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def list_archives(path: str) -> list[tuple[str, int]]:
    """(path, size) of the committed archives of a folder, or of all in it without a MANIFEST."""
    store, root = open_store(path)
    info = store.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [(root, info.size)]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    manifest = store.get_file_info(f"{root}/{MANIFEST}")
    if manifest.type == pafs.FileType.File:
        with store.open_input_stream(manifest.path) as f:
            return [(f"{root}/{name}", size) for name, size in json.loads(f.read())]
    found = store.get_file_info(pafs.FileSelector(root, recursive=True))
    return sorted((i.path, i.size) for i in found if i.type == pafs.FileType.File and re.search(r"\.warc(\.gz)?$", i.path))


@dataclass
class Archives(InputPartition):
    files: list[str]


TESTS: dict[type, Callable] = {
    EqualTo: lambda have, f: have is not None and have == f.value,
    EqualNullSafe: lambda have, f: have == f.value,
    In: lambda have, f: have is not None and have in f.value,
    IsNotNull: lambda have, f: have is not None,
    GreaterThan: lambda have, f: have is not None and have > f.value,
    GreaterThanOrEqual: lambda have, f: have is not None and have >= f.value,
    LessThan: lambda have, f: have is not None and have < f.value,
    LessThanOrEqual: lambda have, f: have is not None and have <= f.value,
    StringStartsWith: lambda have, f: have is not None and have.startswith(f.value),
}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.decode = options.get("payload", "false").lower() == "true"
        self.size = int(options.get("partitionbytes", 64_000_000))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        """Filters on header columns are kept here; the others go back to Spark."""
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and (f.attribute[0] in HEADERS or f.attribute[0] == "payload_length"):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        """Files in order, as many to a partition as fit its size, at least one."""
        out, held = [Archives([])], 0
        for path, size in list_archives(self.path):
            if out[-1].files and held + size > self.size:
                out.append(Archives([]))
                held = 0
            out[-1].files.append(path)
            held += size
        return out

    def wanted(self, head: Head) -> bool:
        return all(TESTS[type(f)](head.column(f.attribute[0]), f) for f in self.filters)

    def read(self, partition):
        store, _ = open_store(self.path)
        rows, held = [], 0
        for path in partition.files:
            with store.open_input_file(path) as raw:
                for head, payload in read_records(io.BufferedReader(raw, 1 << 16), self.wanted, self.decode):
                    rows.append({**{c: head.column(c) for c in HEADERS}, "payload_length": head.payload_length, "payload": payload, "file": path, "offset": head.offset})
                    held += len(payload or b"")
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    size: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.compress = options.get("compression", "gzip") == "gzip"

    def write(self, iterator):
        """One archive; a task without rows writes none."""
        store, root = open_store(self.path)
        name = f"part-{uuid.uuid4().hex}.warc" + (".gz" if self.compress else "")
        out, size = None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                record = encode_record(row)
                record = gzip_member(record) if self.compress else record
                out.write(record)
                size += len(record)
        if out is None:
            return Written(None, 0)
        out.close()
        return Written(name, size)

    def commit(self, messages):
        store, root = open_store(self.path)
        store.create_dir(root, recursive=True)
        names = sorted((m.name, m.size) for m in messages if m is not None and m.name)
        with store.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages):
        store, root = open_store(self.path)
        for m in messages:
            if m is not None and m.name:
                store.delete_file(f"{root}/{m.name}")


class WarcSource(DataSource):
    """format("warc"): see the module. Options: path, payload (false), partitionBytes,
    compression (gzip or none, when writing)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SPARK_SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make format("warc") known, with predicates pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# --- pages --------------------------------------------------------------------------------

RECORD = "urn:tripledger:page:"


def page_records(pages: DataFrame, least: int = 1000, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Rows for format("warc") from pages (page_id, url, html).

    Of pages with equal payloads of at least `least` bytes the one with the largest page_id is a
    response, the others revisit it; a null page_id is smaller than any, and where all are null
    all are responses. Rows that repeat the largest page_id are responses too. Equal means equal
    length and SHA-1. A null html is an empty payload.
    """
    body = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select("page_id", "url", body.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    # groups of copies only, stored, so that Spark knows their size before it joins the payloads
    groups = rows.where(F.col("bytes") >= least).groupBy("sha1", "bytes")
    groups = materialize(groups.agg(F.count("*").alias("n"), F.max("page_id").alias("first")).where("n > 1"), "copies")
    rows = rows.join(groups.select("sha1", "bytes", "first"), ["sha1", "bytes"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    named = lambda c: F.concat(F.lit(f"<{RECORD}"), c.cast("string"), F.lit(">"))
    return rows.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.coalesce(named(F.col("page_id")), F.lit(f"<{RECORD}>")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(F.lit("sha1:"), "sha1").alias("payload_digest"),
        F.when(again, named(F.col("first"))).alias("refers_to"),
        F.col("bytes").alias("payload_length"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, path: str, compression: str = "gzip", **options) -> None:
    register(pages.sparkSession)
    page_records(pages, **options).write.format("warc").option("compression", compression).mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def _page(record: str):
    number = F.regexp_extract(record, f"^<{RECORD}([^>]*)>$", 1)
    return F.when(number != "", number).cast("long")


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of pages.

    Length and digest of a response are taken from the payload that was read; those of a revisit,
    which has none, from its headers.
    """
    rows = read(spark, path, payload=True)
    own = F.col("payload").isNotNull()
    return rows.select(
        _page("record_id").alias("page_id"),
        F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(own, F.sha1("payload")).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        _page("refers_to").alias("refers_to"),
    )
