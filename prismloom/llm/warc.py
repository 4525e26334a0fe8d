"""WARC archives as a Spark data source, ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans one partition a file, or several by byte ranges where files are not compressed and large. Predicates on
the record type and on headers are pushed down: a record's headers are parsed first, and the payload of
a record that they rule out is skipped without reading it; in compressed files too, where every record is a gzip
member whose header tells its length (others are decompressed to the next record). Writing deduplicates nothing by
itself; ``with_revisits`` marks the records that repeat a payload. Spark keeps one set of pushed predicates a load, so
readers with different predicates need loads of their own.

Paths are those of any file system that pyarrow knows, local or in a store.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from prismloom.llm.storage import new_path, table, written

#: Columns that a reader gives and a writer takes; a writer needs only id, url, record_type, refers_to and payload.
SCHEMA = "id string, url string, record_type string, date string, payload_bytes bigint, payload_digest string, refers_to string, payload binary"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
ARROW = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in NAMES])
#: The headers that hold columns which may be filtered on before a payload is read.
HEADERS = {"record_type": "warc-type", "id": "x-source-id", "url": "warc-target-uri", "refers_to": "x-refers-to-source-id", "date": "warc-date"}
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 1000
#: Bytes of payload in an Arrow batch; bytes of a plain file that a partition reads.
BATCH_BYTES, SPLIT_BYTES = 4 << 20, 256 << 20
#: Bytes of repeated digests that a join may broadcast, and what one takes at most.
BROADCAST_BYTES, DIGEST_BYTES = 64 << 20, 128
#: Compressed and plain length of a member, in a field of its gzip header.
_LENGTHS = struct.Struct("<10sHccHII")
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    if re.match(r"^[a-z][a-z0-9+.-]*:", uri):
        return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return pa.fs.LocalFileSystem(), uri


def _field(value: str) -> str:
    """A value that fits into a header line."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", value)


def _unfield(value: str) -> str:
    return re.sub(r"%([01][0-9A-F]|7F|25)", lambda m: chr(int(m[1], 16)), value)


def record(row: dict, date: str) -> bytes:
    """The bytes of a record. A revisit has the HTTP headers of the full payload, but not the payload."""
    payload = row["payload"] or b""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kind = row["record_type"] or "response"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Target-URI", row.get("url")), ("X-Source-Id", row.get("id")), ("WARC-Payload-Digest", digest)]
    if kind == "revisit":
        fields += [("WARC-Profile", _REVISIT_PROFILE), ("WARC-Refers-To-Target-URI", row.get("refers_to_url")), ("X-Refers-To-Source-Id", row.get("refers_to"))]
    else:
        block += payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_field(v)}\r\n" for k, v in fields if v is not None) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member with its compressed and plain length in the header, unless they are too large for that."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    body += struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    size = _LENGTHS.size + len(body)
    if max(size, len(data)) >= 1 << 32:
        return b"\x1f\x8b\x08" + bytes(6) + b"\xff" + body
    return _LENGTHS.pack(b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff", 12, b"s", b"l", 8, size, len(data)) + body


def member_size(head: bytes) -> int | None:
    """The compressed length that a member's header tells, or None."""
    if len(head) < _LENGTHS.size:
        return None
    start, _, a, b, n, size, _ = _LENGTHS.unpack(head[: _LENGTHS.size])
    return size if start[:4] == b"\x1f\x8b\x08\x04" and a + b == b"sl" and n == 8 else None


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files under hidden names; only those of tasks that the job keeps get their names."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.gzip, self.overwrite = options["path"].rstrip("/"), options.get("compression", "none") == "gzip", overwrite
        self.date = options.get("date", "2024-01-01T00:00:00Z")
        self.file_bytes = int(options.get("filebytes", 1 << 30))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = file_system(self.path)
        fs.create_dir(path, recursive=True)
        files, out, room = [], None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    data = record(row, self.date)
                    if self.gzip:  # a member each, so readers can start at any record
                        data = member(data)
                    if out is None or room < len(data):
                        if out is not None:
                            out.close()
                        files.append(f".{uuid.uuid4().hex}.warc" + ".gz" * self.gzip)
                        out, room = fs.open_output_stream(f"{path}/{files[-1]}", compression=None), self.file_bytes
                    out.write(data)
                    room -= len(data)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = file_system(self.path)
        fs.create_dir(path, recursive=True)
        if self.overwrite:
            for info in fs.get_file_info(pa.fs.FileSelector(path)):
                if re.search(r"/[^./_][^/]*\.warc(\.gz)?$", info.path):
                    fs.delete_file(info.path)
        for name in (f for m in messages if m for f in m.files):
            fs.move(f"{path}/{name}", f"{path}/{name[1:]}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = file_system(self.path)
        for name in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{path}/{name}")


@dataclass
class Part(InputPartition):
    """The records of a file that begin in a byte range."""

    file: str
    lo: int
    hi: int | None

    def __post_init__(self):
        super().__init__((self.file, self.lo, self.hi))


class _Inflated(io.RawIOBase):
    """A stream of gzip members as the bytes that they hold, in bounded memory."""

    def __init__(self, raw):
        self.raw, self.unpack, self.rest = raw, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            if not self.rest:
                self.rest = self.raw.read(1 << 16)
                if not self.rest:
                    return 0
            data = self.unpack.decompress(self.rest, len(buffer))
            self.rest = self.unpack.unconsumed_tail
            if self.unpack.eof:
                self.rest = self.unpack.unused_data
                self.unpack = zlib.decompressobj(31)
            if data:
                buffer[: len(data)] = data
                return len(data)


def _skip(stream, n: int) -> None:
    if stream.seekable():
        stream.seek(n, 1)
        return
    while n > 0 and (got := stream.read(min(n, 1 << 20))):
        n -= len(got)


def _header_block(stream) -> dict[str, str] | None:
    """The next header lines up to an empty one, names in lower case; None at the end of the file."""
    out: dict[str, str] = {}
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not re.match(rb"(WARC|HTTP)/\d", line):
        raise ValueError(f"not a record: {line[:40]!r}")
    last = ""
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and last:
            out[last] += " " + text.strip()
        else:
            last, _, value = text.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def _hex(digest: str | None) -> str | None:
    if digest is None:
        return None
    value = digest.rpartition(":")[2]
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"].rstrip("/"), options.get("payload", "true") == "true"
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.wanted: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo) and f.value is not None:
                self.wanted.append((HEADERS[column], (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.wanted.append((HEADERS[column], tuple(f.value)))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.wanted.append((HEADERS[column], ()))
            else:
                yield f

    def partitions(self) -> list[Part]:
        fs, path = file_system(self.path)
        here = fs.get_file_info(path)
        infos = [here] if here.is_file else sorted((i for i in fs.get_file_info(pa.fs.FileSelector(path, allow_not_found=True)) if i.is_file and re.search(r"/[^./_][^/]*\.warc(\.gz)?$", i.path)), key=lambda i: i.path)
        parts = []
        for info in infos:
            if info.path.endswith(".gz") or info.size <= self.split_bytes:
                parts.append(Part(info.path, 0, None))
            else:
                parts += [Part(info.path, lo, min(lo + self.split_bytes, info.size)) for lo in range(0, info.size, self.split_bytes)]
        return parts or [Part("", 0, None)]

    def _keep(self, headers: dict[str, str]) -> bool:
        return all(name in headers and (not values or _unfield(headers[name]) in values) for name, values in self.wanted)

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        rows, room = [], BATCH_BYTES
        for row in self._rows(part) if part.file else ():
            rows.append(row)
            room -= 1000 + len(row["payload"] or b"")
            if room < 0:
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                rows, room = [], BATCH_BYTES
        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    def _start(self, raw, lo: int) -> None:
        """Goes to the first record that begins at ``lo`` or later.

        A payload may hold what looks like a record, so a place counts only if headers with a type, an
        id and a length follow it, and another record or the end of the file follows those.
        """
        raw.seek(max(0, lo - 4))
        window, base = b"", max(0, lo - 4)
        while True:
            more = raw.read(1 << 20)
            window += more
            for m in re.finditer(rb"\r\n\r\n(?=WARC/1\.[01]\r\n)", window):
                at = base + m.end()
                raw.seek(at)
                headers = _header_block(raw)
                if headers and {"warc-type", "warc-record-id", "content-length"} <= headers.keys() and headers["content-length"].isdigit():
                    raw.seek(int(headers["content-length"]), 1)
                    if re.match(rb"\r\n\r\n(WARC/1\.[01]\r\n|$)", raw.read(14)):
                        raw.seek(at)
                        return
            if not more:
                raw.seek(0, 2)
                return
            base += max(0, len(window) - 16)
            window = window[-16:]
            raw.seek(base + len(window))

    def _rows(self, part: Part) -> Iterator[dict]:
        fs, _ = file_system(self.path)
        with io.BufferedReader(fs.open_input_file(part.file), 1 << 20) as raw:
            if not part.file.endswith(".gz"):
                if part.lo:
                    self._start(raw, part.lo)
                yield from self._records(raw, part.hi)
                return
            at = 0
            while head := raw.read(_LENGTHS.size):
                raw.seek(at)
                size = member_size(head)
                if size is None:  # no way to the next record but through this one
                    yield from self._records(io.BufferedReader(_Inflated(raw), 1 << 16), None)
                    return
                row = self._record(io.BufferedReader(_Inflated(raw), 1 << 13), lambda stream, n: None)
                if row:
                    yield row
                at += size
                raw.seek(at)

    def _records(self, stream, hi: int | None) -> Iterator[dict]:
        """The wanted records that follow in a stream and begin before ``hi``."""
        while hi is None or stream.tell() < hi:
            row = self._record(stream, _skip)
            if row is None:
                return
            if row:
                yield row

    def _record(self, stream, skip) -> dict | None:
        """The next record; an empty dict if it isn't wanted, None at the end. ``skip`` passes over bytes not needed."""
        headers = _header_block(stream)
        if headers is None:
            return None
        left = int(headers["content-length"])
        if not self._keep(headers):
            skip(stream, left + 4)
            return {}
        get = lambda name: _unfield(headers[name]) if name in headers else None
        row = {"id": get("x-source-id"), "url": get("warc-target-uri"), "record_type": get("warc-type"), "date": get("warc-date"), "payload_digest": _hex(headers.get("warc-payload-digest")), "refers_to": get("x-refers-to-source-id"), "payload": None, "payload_bytes": left}
        whole = self.payload and row["record_type"] != "revisit"
        if headers.get("content-type", "").startswith("application/http") and left:
            block = stream.read(left) if whole else stream.read(min(left, 1 << 16))
            skip(stream, left - len(block) + 4)
            head, _, body = block.partition(b"\r\n\r\n")
            length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
            row["payload_bytes"] = int(length[1]) if length else left - len(head) - 4
            row["payload"] = body if whole else None
        else:
            row["payload"] = stream.read(left) if whole else None
            skip(stream, 4 if whole else left + 4)
        if whole and row["payload_digest"] not in (None, hashlib.sha1(row["payload"]).hexdigest()):
            raise ValueError(f"the payload of {row['id']} differs from its digest")
        return row


class WarcSource(DataSource):
    """Options: path; read: payload (false leaves payloads null and unread), splitbytes; write: compression (none or gzip), date, filebytes."""

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
    spark.dataSource.register(WarcSource)


def with_revisits(pages: DataFrame, *, id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Pages as records to write: of equal payloads the one with the largest id is the response.

    Null html is an empty payload. Payloads under ``least`` bytes and records with a null id are always responses; rows that repeat
    the largest id of their payload are responses too. Other columns are left out.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id).alias("key"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha1("payload")), "size": F.octet_length("payload")})
    large = rows.where((F.col("size") >= least) & F.col("key").isNotNull())
    kept = written(large.groupBy("digest", "size").agg(F.max("key").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n"), "kept")
    # Payloads stay where they are if the digests that repeat are few enough to go to them. If not, rows of one payload
    # meet one row, so a payload with very many copies is split over tasks by adaptive execution.
    both = rows.join(F.broadcast(kept) if kept.count() * DIGEST_BYTES <= BROADCAST_BYTES else kept, ["digest", "size"], "left")
    revisit = F.col("key") < F.col("kept")
    return both.select(F.col("key").cast("string").alias("id"), "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("kept").cast("string")).alias("refers_to"), "payload")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    path = new_path(spark, "warc")
    with_revisits(table(spark, sf_dir, "pages")).write.format("warc").option("compression", "gzip").option("filebytes", str(SPLIT_BYTES)).mode("append").save(path)
    # Predicates on the type reach the reader: payloads of responses are passed over where revisits are wanted. Each has
    # a load of its own, as Spark keeps one set of pushed predicates a load.
    of_type = lambda kind, digest: spark.read.format("warc").load(path).where(F.col("record_type") == kind).select(F.col("id").cast("bigint").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))
    return of_type("response", F.sha1("payload")).unionByName(of_type("revisit", F.col("payload_digest")))


QUERIES = {"op8_warc": op8_warc}
ORACLE_SQL = {
    "op8_warc": """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < kept THEN kept END AS refers_to FROM k"""
}
