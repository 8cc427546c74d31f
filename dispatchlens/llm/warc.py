"""WARC archives as a Spark data source written in Python.

Writing: each task writes gzip-compressed WARC files (one gzip member a record, whose compressed size is in
the member's extra field) under hidden names; the commit gives only the files of successful
attempts their final names, so lost executors and speculative attempts leave nothing.

Reading: partitions are runs of whole files of about the same size. Filters on record type
and header columns are pushed into the reader: it parses a record's headers first and
goes on at the next member, without inflating the rest, where a record is not wanted or its payload not
asked for. Members without that field (of other writers) are inflated to their ends.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from dispatchlens.llm import common

SCHEMA = "page_id long, record_type string, url string, payload_digest string, payload_bytes long, refers_to long, payload binary"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
HEADERS = set(COLUMNS) - {"payload"}
FORMAT = "warc"
#: Bytes of an archive read at once, and of a header inflated at once.
READ_BYTES, HEAD_STEP = 1 << 16, 1 << 10
#: Bytes of a member before its deflated data, and the extra field with a member's size.
HEAD_BYTES, SIZE_FIELD = 24, int.from_bytes(b"ms", "little")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def page_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(uri: str | None) -> int | None:
    number = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(text: str | None) -> str:
    """A header value: line ends and other control characters become spaces."""
    return "".join(" " if c < " " or c in "\x7f\x85  " else c for c in text or "").strip()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit has the HTTP headers of the full payload and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {page_uri(page_id)}", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {one_line(url)}"] * (url is not None)
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {page_uri(refers_to)}"] * revisit
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(plain: bytes) -> bytes:
    """A gzip member with its own size in the extra field ``SIZE_FIELD``."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(plain) + deflate.flush()
    size = HEAD_BYTES + len(body) + 8
    head = struct.pack("<4BIBBHHHQ", 31, 139, 8, 4, 0, 0, 255, 12, SIZE_FIELD, 8, size)
    return head + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def member_size(head: bytes) -> int | None:
    """The size of the member that begins with ``head``, if a member of :func:`member` does."""
    if len(head) < HEAD_BYTES or head[:4] != bytes([31, 139, 8, 4]):
        return None
    more, field, n, size = struct.unpack_from("<HHHQ", head, 10)
    return size if (more, field, n) == (12, SIZE_FIELD, 8) else None


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, file_bytes: int):
        self.path, self.file_bytes = path, file_bytes

    def write(self, rows: Iterator) -> Written:
        disk, root = fs.FileSystem.from_uri(self.path)
        disk.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        for row in rows:
            if out is None:
                files.append(f"{uuid.uuid4().hex}.warc.gz")
                out, size = disk.open_output_stream(f"{root}/.{files[-1]}", compression=None), 0
            packed = member(record(row["page_id"], row["url"], bytes(row["payload"] or b""), row["refers_to"], row["record_type"] == "revisit", date))
            out.write(packed)
            size += len(packed)
            if size >= self.file_bytes:
                out.close()
                out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        disk, root = fs.FileSystem.from_uri(self.path)
        for name in (f for m in messages if m for f in m.files):
            disk.move(f"{root}/.{name}", f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        disk, root = fs.FileSystem.from_uri(self.path)
        for name in (f for m in messages if m for f in m.files):
            disk.delete_file(f"{root}/.{name}")


@dataclass
class Files(InputPartition):
    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], split_bytes: int):
        self.path, self.columns, self.split_bytes, self.wanted = path, columns, split_bytes, {}

    def pushFilters(self, filters):
        """Take equality and membership on header columns; the rest stays with Spark."""
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            elif not (column in HEADERS and isinstance(f, IsNotNull) and column in self.wanted):
                yield f

    def partitions(self) -> list[Files]:
        disk, root = fs.FileSystem.from_uri(self.path)
        found = sorted((f for f in disk.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.endswith(".warc.gz") and f.base_name[0] != "."), key=lambda f: f.base_name)
        return [Files([f.path for f in found[a:b]]) for a, b in common.slices([f.size for f in found], self.split_bytes)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        disk, _ = fs.FileSystem.from_uri(self.path)
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        names = self.columns
        rows, size = [], 0
        for name in partition.names:
            with disk.open_input_file(name) as raw:
                for row in records(Members(raw), self.wanted, "payload" in names):
                    rows.append(row)
                    size += 200 + len(row["payload"] or b"")
                    if size >= 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names)


class Members:
    """The bytes of a file of gzip members, in order and in bounded memory."""

    def __init__(self, raw):
        self.raw, self.packed, self.plain = raw, b"", bytearray()
        self.read_to = self.inflated = 0  # bytes of the file that have been read, and bytes inflated
        self.begin()

    def begin(self) -> None:
        """At the start of a member."""
        self.gz, self.end = zlib.decompressobj(31), None

    def fill(self) -> bool:
        got = self.raw.read(READ_BYTES)
        self.packed += got
        self.read_to += len(got)
        return bool(got)

    def more(self, step: int = READ_BYTES) -> bool:
        if self.end is None:
            while len(self.packed) < HEAD_BYTES and self.fill():
                pass
            size = member_size(self.packed)
            self.end = -1 if size is None else self.read_to - len(self.packed) + size
        if not self.packed and not self.fill():
            return False
        got = self.gz.decompress(self.packed, step)
        self.plain += got
        self.inflated += len(got)
        self.packed = self.gz.unconsumed_tail or self.gz.unused_data
        if self.gz.eof:
            self.begin()
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to ``mark``, which is left out; None at the end of the file."""
        seen = 0
        while (at := self.plain.find(mark, seen)) < 0:
            seen = max(0, len(self.plain) - len(mark))
            if not self.more(HEAD_STEP):
                return None
        out = bytes(self.plain[:at])
        del self.plain[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.plain) < n and self.more():
            pass
        out = bytes(self.plain[:n])
        del self.plain[:n]
        return out

    def skip(self, n: int) -> None:
        """Go past the last ``n`` bytes of a record, with which its member ends."""
        if n > len(self.plain) and (self.end or -1) > 0:
            if self.end > self.read_to:
                self.raw.seek(self.end)
                self.packed, self.read_to = b"", self.end
            else:
                self.packed = self.packed[len(self.packed) - (self.read_to - self.end) :]
            self.plain.clear()
            self.begin()
            return
        while n > len(self.plain):
            n -= len(self.plain)
            self.plain.clear()
            if not self.more():
                return
        del self.plain[:n]


def fields(block: bytes) -> dict[str, str]:
    lines = block.decode().split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def records(data: Members, wanted: dict[str, set], with_payload: bool) -> Iterator[dict]:
    """Rows of the records whose header columns are all among those wanted."""
    while (head := data.until(b"\r\n\r\n")) is not None:
        warc = fields(head)
        left = int(warc["content-length"])
        row = {
            "page_id": page_of(warc.get("warc-record-id")), "record_type": warc.get("warc-type"), "url": warc.get("warc-target-uri"),
            "payload_digest": warc.get("warc-payload-digest", "").removeprefix("sha1:"), "refers_to": page_of(warc.get("warc-refers-to")), "payload": None,
        }
        if all(row[c] in values for c, values in wanted.items() if c != "payload_bytes"):
            http = data.until(b"\r\n\r\n")
            left -= len(http) + 4
            row["payload_bytes"] = int(fields(http)["content-length"])
            if "payload_bytes" not in wanted or row["payload_bytes"] in wanted["payload_bytes"]:
                if with_payload and row["record_type"] == "response":
                    row["payload"] = data.take(left)
                    left = 0
                yield row
        data.skip(left + 4)


class WarcSource(DataSource):
    """``spark.read.format("warc").option("columns", "page_id,record_type").load(path)``; options:
    ``columns`` (of the schema, default all; without ``payload`` no payload is kept), ``splitBytes``
    (archive bytes a partition) and, for writing, ``fileBytes`` (size at which a new file is begun)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _columns(self) -> list[str]:
        asked = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        if unknown := set(asked) - set(COLUMNS):
            raise ValueError(f"no such columns: {sorted(unknown)}")
        return asked or COLUMNS

    def schema(self) -> str:
        return ", ".join(c for c in SCHEMA.split(", ") if c.split()[0] in self._columns())

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema.names, int(self.options.get("splitbytes", 64 << 20)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("filebytes", 256 << 20)))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters pushed into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, record_type, refers_to``: of rows with equal payloads of at least
    ``min_bytes`` bytes, those with the largest page_id are responses and the others revisit it.

    Payloads are compared by SHA-256 and length. Html and url are the only other columns
    read; null html is an empty payload; a null page_id is smaller than any other; rows that
    repeat the largest page_id are all responses. Only digests are shuffled by payload (with
    partial aggregation); payloads go through the join only with the digests that repeat.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("same", F.when(F.length("payload") >= min_bytes, F.sha2("payload", 256)))
    kept = rows.filter("same is not null").groupBy("same").agg(F.max("page_id").alias("kept_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    kept = common.written(kept, "payloads")  # so that the join has plain exchanges on both sides and a common payload's rows can be split
    revisits = ~F.col("page_id").eqNullSafe(F.col("kept_id")) & F.col("kept_id").isNotNull()
    return rows.join(kept, "same", "left").select("page_id", "url", "payload", F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("kept_id")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write one record per row of ``pages(page_id, url, html)`` below ``path``, a folder all executors reach."""
    register(pages.sparkSession)
    with_revisits(pages, min_bytes).withColumns({"payload_digest": F.lit(""), "payload_bytes": F.length("payload").cast("long")}).select(*COLUMNS).write.format(FORMAT).mode("append").save(path)


def read_archives(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of all archives below ``path``; an empty or missing folder gives none."""
    register(spark)
    return spark.read.format(FORMAT).option("columns", ",".join(columns or COLUMNS)).load(path)
