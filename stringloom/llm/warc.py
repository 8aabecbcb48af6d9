"""WARC archives as a Spark data source, and the write-and-read-back of web pages with revisit records.

``format("warc")`` reads ``.warc`` and ``.warc.gz`` files. Files are planned into partitions by size; equality,
membership and prefix predicates on the record type and on header columns are pushed into the reader, which
parses a record's header block first and passes over the payload of a record that isn't wanted. The writer
makes one gzip member for each record, with the member's length in an extra field, so that a reader can step
over a member after inflating its header block only. Archives of other writers may pack many records into a member, or
a record into many. Files go through Arrow's file systems (local or by URI).
"""

from __future__ import annotations

import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from stringloom.llm.common import pick
from stringloom.session import cut, drop_folder, shared_dir

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_length bigint, content_length bigint, payload binary"
ARROW = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()),
    ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("content_length", pa.int64()), ("payload", pa.binary()),
])
# The WARC header behind each column. The payload length is an extension header.
HEADERS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length", "content_length": "Content-Length",
}
PUSHED = ("record_id", "record_type", "target_uri", "date", "refers_to", "payload_digest")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DEFAULT_DATE = "1970-01-01T00:00:00Z"
HEAD_BYTES = 4096
BATCH_BYTES = 4 << 20
PARTITION_BYTES = 64 << 20
LEAST_REVISIT_BYTES = 100
SALTS = 32


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system behind a path or URI, and the path inside it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the archives under a path, in order of their names."""
    files, root = open_path(path)
    info = files.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(root, info.size)]
    found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", f.path) and not posixpath.basename(f.path).startswith(("_", ".")))


def parse_header(block: bytes) -> dict[str, str]:
    """Fields of a header block by lower-case name; continued lines are joined."""
    lines = block.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record here: {lines[0][:60]!r}")
    out: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


class RecordStream:
    """Records of one file. ``next_header`` parses a header; then ``block`` or ``skip`` moves past the block.

    A packed file is read as the bytes of its gzip members, one after the other, wherever records begin in them: a member
    may hold one record, many, or part of one. Only a member that says its own length (see ``gzip_member``) holds
    exactly one record, and is stepped over unread when the record isn't wanted.
    """

    def __init__(self, source, packed: bool):
        self.source, self.packed, self.buffer = source, packed, b""
        self.inflater, self.fed = None, b""  # the open member, and bytes read from the file but not inflated yet
        self.member_end: int | None = None
        self.bytes_inflated = 0

    def _open_member(self) -> bool:
        """Start the next member, if there is one."""
        head = self.fed + self.source.read(HEAD_BYTES - len(self.fed)) if len(self.fed) < 24 else self.fed
        head = head.lstrip(b"\0") if head[:1] == b"\0" else head  # padding between members
        self.fed = head
        if not head:
            return False
        if head[:2] != b"\x1f\x8b":
            raise ValueError("no gzip member here")
        own = head[:4] == b"\x1f\x8b\x08\x04" and head[12:14] == b"SL"
        self.member_end = self.source.tell() - len(head) + int.from_bytes(head[16:24], "little") if own else None
        self.inflater = zlib.decompressobj(31)
        return True

    def _more(self) -> bytes:
        """Some more bytes of the records; none at the end of the file."""
        if not self.packed:
            return self.source.read(HEAD_BYTES)
        while True:
            if self.inflater is None and not self._open_member():
                return b""
            fed = self.fed or self.source.read(HEAD_BYTES)
            if not fed:
                raise ValueError("the file ends inside a gzip member")
            out = self.inflater.decompress(fed, 2 * HEAD_BYTES)
            self.fed = self.inflater.unconsumed_tail
            if self.inflater.eof:
                self.fed, self.inflater = self.inflater.unused_data, None
            if out:
                self.bytes_inflated += len(out)
                return out

    def next_header(self) -> dict[str, str] | None:
        while True:
            text = self.buffer.lstrip(b"\r\n")
            end = text.find(b"\r\n\r\n")
            if end >= 0:
                self.buffer = text[end + 4 :]
                return parse_header(text[:end])
            if not text:
                self.member_end = None  # set anew if a member opens here, at a record's start
            more = self._more()
            if not more:
                if text.strip():
                    raise ValueError("the file ends inside a header")
                return None
            self.buffer = text + more

    def block(self, length: int) -> bytes:
        parts, left = [self.buffer[:length]], length - len(self.buffer)
        self.buffer = self.buffer[length:]
        while left > 0:
            more = self.source.read(left) if not self.packed else self._more()
            if not more:
                raise ValueError("the file ends inside a record")
            parts.append(more[:left])
            self.buffer = more[left:]
            left -= len(more)
        return b"".join(parts)

    def skip(self, length: int) -> None:
        if self.packed and self.member_end is not None:
            self.source.seek(self.member_end)
            self.buffer, self.fed, self.inflater, self.member_end = b"", b"", None, None
            return
        left = length - len(self.buffer)
        self.buffer = self.buffer[length:]
        if left > 0 and not self.packed:
            self.source.seek(self.source.tell() + left)
            return
        while left > 0:
            more = self._more()
            if not more:
                raise ValueError("the file ends inside a record")
            self.buffer = more[left:]
            left -= len(more)


def http_body(block: bytes) -> bytes:
    """What follows the HTTP header of a response block."""
    if not block.startswith(b"HTTP/"):
        return block
    at = block.find(b"\r\n\r\n")
    return block[at + 4 :] if at >= 0 else b""


@dataclass
class FilePartition(InputPartition):
    files: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        self.payload = options.get("payload", "true").lower() == "true"
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in PUSHED and isinstance(f, (EqualTo, In, StringStartsWith)):
                kind = "in" if isinstance(f, In) else "is" if isinstance(f, EqualTo) else "starts"
                self.tests.append((column, kind, f.value))
            else:
                yield f

    def partitions(self) -> list[FilePartition]:
        out: list[FilePartition] = []
        size = 0
        for name, n in list_files(self.path):
            if not out or size + n > self.most:
                out.append(FilePartition([]))
                size = 0
            out[-1].files.append(name)
            size += n
        return out or [FilePartition([])]  # one empty partition where there is no archive

    def wanted(self, row: dict) -> bool:
        for column, kind, value in self.tests:
            own = row[column]
            if own is None or not (own == value if kind == "is" else own in value if kind == "in" else own.startswith(value)):
                return False
        return True

    def records(self, name: str, source, counter: dict | None = None) -> Iterator[dict]:
        stream = RecordStream(source, name.endswith(".gz"))
        while (header := stream.next_header()) is not None:
            row = {column: header.get(field.lower()) for column, field in HEADERS.items()}
            length = int(row["content_length"] or 0)
            row["content_length"] = length
            row["payload_length"] = int(row["payload_length"]) if row["payload_length"] else None
            row["payload"] = None
            keep = self.wanted(row)
            if keep and self.payload and row["record_type"] != "revisit":
                block = stream.block(length)
                row["payload"] = http_body(block) if row["record_type"] == "response" else block
            else:
                stream.skip(length)
            if counter is not None:
                counter["inflated"] = stream.bytes_inflated
            if keep:
                yield row

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        files, _ = open_path(self.path)
        held, size = [], 0
        for name in partition.files:
            with files.open_input_file(name) as source:
                for row in self.records(name, source):
                    held.append(row)
                    size += 500 + len(row["payload"] or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=ARROW)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=ARROW)


def gzip_member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field ``SL`` holds its whole length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"SL" + (8).to_bytes(2, "little") + total.to_bytes(8, "little")
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + len(extra).to_bytes(2, "little") + extra + body + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


def record_bytes(row: dict) -> bytes:
    """One record: a response holds an HTTP header and the payload, a revisit the HTTP header alone."""
    kind, payload = row["record_type"], row["payload"] or b""
    if kind == "response":
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    elif kind == "revisit":
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    else:
        block = payload
    lines = ["WARC/1.1"]
    for column, field in HEADERS.items():
        value = len(block) if column == "content_length" else row.get(column)
        if column == "date" and not value:
            value = DEFAULT_DATE
        if value is not None:
            lines.append(f"{field}: " + re.sub(r"[\r\n]+", " ", str(value)))
    if kind in ("response", "revisit"):
        lines.append("Content-Type: application/http; msgtype=response")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes hidden files of its own; the commit gives them their names, an abort removes them."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.gzip = options.get("compression", "gzip") == "gzip"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = open_path(self.path)
        files.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip
        hidden, final, n = posixpath.join(root, "_" + name), posixpath.join(root, name), 0
        with files.open_output_stream(hidden, compression=None) as sink:
            for batch in iterator:
                for row in batch.to_pylist():
                    data = record_bytes(row)
                    sink.write(gzip_member(data) if self.gzip else data)
                    n += 1
        if not n:
            files.delete_file(hidden)
            return Written([])
        return Written([(hidden, final)])

    def commit(self, messages: list[Written | None]) -> None:
        files, root = open_path(self.path)
        files.create_dir(root, recursive=True)
        old = [name for name, _ in list_files(self.path)] if self.overwrite else []
        for message in messages:
            for hidden, final in message.files if message else []:
                files.move(hidden, final)
        for name in old:  # only once the new files have their names
            files.delete_file(name)

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = open_path(self.path)
        for message in messages:
            for hidden, _ in message.files if message else []:
                files.delete_file(hidden)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records under a path; with ``payload=False`` no payload is decoded and the column is null."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def write_warc(df: DataFrame, path: str, mode: str = "append", compression: str = "gzip") -> None:
    """Write rows of the source's columns (missing ones null) as archives under ``path``."""
    register(df.sparkSession)
    kinds = dict(x.split() for x in SCHEMA.split(", "))
    whole = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
    whole.write.format("warc").option("compression", compression).mode(mode).save(path)


def page_records(pages: DataFrame) -> DataFrame:
    """A record for each page: of equal payloads of at least 100 bytes the smallest page_id is the response.

    A null html is an empty payload. Rows that repeat both page_id and payload are of one kind. A page without
    an id is a response and no page refers to it. Extra columns are not read.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    hashed = pick(pages, "page_id", "url", "html").select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("bigint"))
    narrow = hashed.filter((F.col("bytes") >= LEAST_REVISIT_BYTES) & F.col("page_id").isNotNull()).select("page_id", "digest")
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last")
    salted = firsts.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    revisits = narrow.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"]).filter(F.col("page_id") > F.col("first"))
    revisits = revisits.select("page_id", "digest", "first").distinct()
    joined = hashed.join(revisits, ["page_id", "digest"], "left")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    return joined.select(
        urn(F.col("page_id")).alias("record_id"), F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("url").alias("target_uri"),
        F.when(F.col("first").isNotNull(), urn(F.col("first"))).alias("refers_to"), F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), F.col("bytes").alias("payload_length"),
        F.when(F.col("first").isNull(), F.col("payload")).alias("payload"),
    )


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages' archives to ``path`` and read them back: (page_id, payload_bytes, payload_digest, record_type,
    refers_to), length and digest of a response from what was read. Only the wanted record types are parsed beyond
    their headers. Without a path the archives stand in a folder of the shared one until they have been read, then go."""
    spark = pages.sparkSession
    folder = path or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(page_records(pages), folder)
    back = read_warc(spark, folder).filter(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    whole = F.col("record_type") == "response"
    found = back.select(
        F.expr("try_cast(regexp_extract(record_id, '^<urn:page:(-?[0-9]+)>$', 1) AS bigint)").alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
        "record_type", F.when(F.col("refers_to").isNotNull(), number(F.col("refers_to")).cast("bigint")).alias("refers_to"),
    )
    if path:
        return found
    found = cut(found)  # a few columns for each page
    drop_folder(folder)
    return found
