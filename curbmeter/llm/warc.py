"""WARC archives as a Spark data source, read header first.

``spark.read.format("warc")`` plans one partition per file; the writer starts a
new file when one reaches ``file_bytes``. Predicates on the record type and
other header columns are pushed down and judged on the parsed header; a record
that fails, or whose payload is not asked for (option ``payload`` = false), is
skipped without decoding its payload. A record is a gzip member of its own
whose header states the member's length (field ``sl``), so a skip is a seek.
Archives of others, without that field or not compressed, are read as well.

Writers put files under unique names, and the commit lists those of the
attempts that succeeded; readers follow the list. A task that is repeated after
an executor was lost leaves at most a file that nobody reads.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from curbmeter.llm.shared import shared_path, store
from curbmeter.session import broadcast_if_small

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, "
    "payload_digest string, payload_length bigint, payload binary"
)
_HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "X-Payload-Length",
}
FILE_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
MANIFEST = "_files.json"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Copies of shorter payloads are stored again: a reference would not be smaller.
SMALLEST_REVISIT = 1000


def file_system(path: str):
    """The file system of a path or URI and the path in it; executors and the driver use the same."""
    from pyarrow import fs

    if re.match(r"file:/(?!/)", path):
        path = "file://" + path[len("file:") :]
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def header_value(text: str) -> str:
    """A header's value on one line: control characters as percent escapes."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record_bytes(row: dict) -> bytes:
    """One record, not compressed. A response or resource carries its payload behind an HTTP header."""
    kind = row["record_type"]
    payload = row["payload"]
    block = HTTP + payload if payload is not None and kind in ("response", "revisit") else payload or b""
    if kind == "revisit":
        block = HTTP
    lines = ["WARC/1.1"]
    for column, header in _HEADERS.items():
        if row[column] is not None:
            lines.append(f"{header}: {header_value(str(row[column]))}")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    if block.startswith(b"HTTP/"):
        lines.append("Content-Type: application/http;msgtype=response")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    """``data`` as a gzip member that states its own length and that of the data."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    size = 10 + 2 + 12 + len(body) + 8
    known = (size, len(data)) if size < 1 << 32 and len(data) < 1 << 32 else (0, 0)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, *known)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(ds.WriterCommitMessage):
    files: list


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, path: str, file_bytes: int):
        self.path, self.file_bytes = path.rstrip("/"), file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            names = batch.schema.names
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(names)}
                if out is None or size >= self.file_bytes:
                    if out is not None:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                    info = {n: None for n in names} | {
                        "record_id": f"<urn:uuid:{uuid.uuid4()}>",
                        "record_type": "warcinfo",
                        "date": row["date"],
                        "payload": b"format: WARC File Format 1.1\r\n",
                    }
                    size += out.write(gzip_member(record_bytes(info)))
                size += out.write(gzip_member(record_bytes(row)))
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages) -> None:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps([f for m in messages if m is not None for f in m.files]).encode())

    def abort(self, messages) -> None:
        system, root = file_system(self.path)
        for message in messages:
            for name in message.files if message is not None else []:
                system.delete_file(f"{root}/{name}")


@dataclass
class WarcFile(ds.InputPartition):
    path: str


def parse_header(block: bytes) -> dict:
    """Header names (lower case) and values; a continued line belongs to the one before."""
    lines = re.sub(rb"\r?\n[ \t]+", b" ", block).decode("utf-8", "replace").splitlines()
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}


class _Plain:
    """Records of an archive that is not compressed; payloads are skipped by seeking."""

    def __init__(self, file):
        self.file, self.at, self.size = file, 0, file.size()

    def header(self) -> dict | None:
        while self.at < self.size:
            data, want = b"", 4096
            while b"\r\n\r\n" not in data and len(data) < self.size - self.at:
                data = self.file.read_at(min(want, self.size - self.at), self.at)
                want *= 2
            if data.lstrip(b"\r\n") == b"":
                return None
            lead = len(data) - len(data.lstrip(b"\r\n"))
            head, _, _ = data[lead:].partition(b"\r\n\r\n")
            self.at += lead + len(head) + 4
            values = parse_header(head)
            self.length = int(values.get("content-length", 0))
            return values
        return None

    def block(self) -> bytes:
        return self.file.read_at(self.length, self.at)

    def next(self) -> None:
        self.at += self.length


class _Gzip:
    """Records that are gzip members; a member of known length is skipped by seeking."""

    def __init__(self, file):
        self.file, self.at, self.size = file, 0, file.size()

    def header(self) -> dict | None:
        if self.at >= self.size:
            return None
        self.inflate, self.data, self.pos, self.more = zlib.decompressobj(31), b"", self.at, b""
        first = self.file.read_at(24, self.at)
        self.length = None
        if len(first) == 24 and first[3] & 4 and first[12:16] == b"sl\x08\x00":
            self.length = struct.unpack("<I", first[16:20])[0] or None
        while b"\r\n\r\n" not in self.data:
            if not self._inflate(4096):
                break
        head, _, _ = self.data.partition(b"\r\n\r\n")
        self.start = len(head) + 4
        self.values = parse_header(head)
        return self.values

    def _inflate(self, n: int) -> bool:
        """Read on; about ``n`` bytes more of data. False at the member's end."""
        if self.inflate.eof:
            return False
        if not self.more:
            left = self.size - self.pos
            if self.length is not None:
                left = min(left, self.at + self.length - self.pos)
            self.more = self.file.read_at(min(max(n, 4096), left), self.pos)
            self.pos += len(self.more)
            if not self.more:
                return False
        self.data += self.inflate.decompress(self.more, n)
        self.more = self.inflate.unconsumed_tail
        return True

    def block(self) -> bytes:
        end = self.start + int(self.values.get("content-length", 0))
        while len(self.data) < end:
            if not self._inflate(max(end - len(self.data), 4096)):
                break
        return self.data[self.start : end]

    def next(self) -> None:
        if self.length is None:
            # The end is known only by inflating up to it; what comes out is dropped.
            while not self.inflate.eof and self._inflate(1 << 16):
                self.data = b""
            self.length = self.pos - len(self.inflate.unused_data) - self.at
        self.at += self.length


def payload_of(values: dict, block: bytes) -> bytes:
    """The HTTP body if the block is an HTTP message, else the block."""
    if values.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


class WarcReader(ds.DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.tests = path.rstrip("/"), payload, []

    def pushFilters(self, filters):
        """Keep filters on header columns for the scan; give Spark the rest."""
        for test in filters:
            inner = test.child if isinstance(test, ds.Not) else test
            column = getattr(inner, "attribute", ("payload",))
            known = (ds.EqualTo, ds.EqualNullSafe, ds.In, ds.IsNull, ds.IsNotNull, ds.StringStartsWith, ds.StringEndsWith, ds.StringContains)
            if len(column) == 1 and column[0] in _HEADERS and column[0] != "payload_length" and isinstance(inner, known):
                self.tests.append((column[0], inner, isinstance(test, ds.Not)))
            else:
                yield test

    def partitions(self):
        from pyarrow import fs

        system, root = file_system(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.File:
            return [WarcFile(root)]
        if system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            with system.open_input_stream(f"{root}/{MANIFEST}") as file:
                return [WarcFile(f"{root}/{name}") for name in json.loads(file.read())]
        files = system.get_file_info(fs.FileSelector(root, recursive=True))
        names = sorted(f.path for f in files if f.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", f.path))
        return [WarcFile(name) for name in names]

    def wanted(self, row: dict) -> bool:
        """Whether the header passes all pushed filters; a null passes only the tests for it."""
        for column, test, negated in self.tests:
            value = row[column]
            if isinstance(test, ds.IsNull):
                result = value is None
            elif isinstance(test, ds.IsNotNull):
                result = value is not None
            elif isinstance(test, ds.EqualNullSafe):
                result = value == test.value
            elif value is None:
                return False
            elif isinstance(test, ds.EqualTo):
                result = value == test.value
            elif isinstance(test, ds.In):
                result = value in test.value
            elif isinstance(test, ds.StringStartsWith):
                result = value.startswith(test.value)
            elif isinstance(test, ds.StringEndsWith):
                result = value.endswith(test.value)
            else:
                result = test.value in value
            if result == negated:
                return False
        return True

    def read(self, partition: WarcFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file at all
            return
        system, _ = file_system(self.path)
        schema = pa.schema([(c, pa.string()) for c in list(_HEADERS)[:-1]] + [("payload_length", pa.int64()), ("payload", pa.binary())])
        rows, size = [], 0
        with system.open_input_file(partition.path) as file:
            records = _Gzip(file) if file.read_at(2, 0) == b"\x1f\x8b" else _Plain(file)
            while (values := records.header()) is not None:
                row = {c: values.get(h.lower()) for c, h in _HEADERS.items()}
                if self.wanted(row):
                    length = row["payload_length"]
                    row["payload_length"] = int(length) if length and length.isdigit() else None
                    row["payload"] = None
                    if self.payload and row["record_type"] != "revisit":
                        row["payload"] = payload_of(values, records.block())
                        size += len(row["payload"])
                    rows.append(row)
                records.next()
                if size >= BATCH_BYTES or len(rows) >= 10_000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcSource(ds.DataSource):
    """Options: ``path``; reading ``payload`` (true); writing ``file_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("file_bytes", FILE_BYTES)))


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records under ``path``; with ``payload`` false no payload is decoded."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Records of pages: of equal payloads of at least 1000 bytes the largest id is stored, the others refer to it.

    Payloads count as equal when their SHA-1 is. A null page is empty, a null
    URL gives no target header. A null id is smaller than any; rows that repeat
    the stored id and payload are stored as well.
    """
    digest = F.sha1("payload")
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.col(url_col).alias("target_uri"),
        F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"),
    ).select("*", digest.alias("digest"), F.octet_length("payload").cast("long").alias("payload_length"))
    large = F.col("payload_length") >= SMALLEST_REVISIT
    kept = rows.where(large).groupBy("digest").agg(F.max("id").alias("kept"), F.count(F.lit(1)).alias("n"))
    kept = broadcast_if_small(store(kept.where("n > 1").select("digest", "kept"), "kept"))
    rows = rows.join(kept, "digest", "left")
    again = F.col("kept").isNotNull() & ~F.col("id").eqNullSafe(F.col("kept")) & large

    def urn(column):
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(">"))

    return rows.select(
        urn("id").alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit(date).alias("date"),
        F.when(again, urn("kept")).alias("refers_to"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        "payload_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, path: str, **columns) -> None:
    """Write ``pages`` as archives under ``path``."""
    register(pages.sparkSession)
    page_records(pages, **columns).write.format("warc").mode("append").save(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder and read them back.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``: for
    responses from the payload that was read, for revisits from their header.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "archives")
    write_pages(pages, path)

    def page(column):
        return F.regexp_extract(column, "^<urn:page:(.*)>$", 1).try_cast("long")

    kept = read_warc(spark, path).where(F.col("record_type") == "response")
    again = read_warc(spark, path, payload=False).where(F.col("record_type") == "revisit")
    return kept.select(
        page(F.col("record_id")).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    ).unionByName(
        again.select(
            page(F.col("record_id")).alias("page_id"),
            F.col("payload_length").alias("payload_bytes"),
            F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
            "record_type",
            page(F.col("refers_to")).alias("refers_to"),
        )
    )
