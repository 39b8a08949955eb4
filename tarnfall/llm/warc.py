"""WARC archives as a Python data source, and payload deduplication.

Reading: ``spark.read.format("warc").load(path)``. Planning lists the files and packs
small ones into partitions. Predicates on the record type and the named headers
are pushed down; a record's headers are parsed first, and the payload of a record
that no predicate wants, or of any record with the option ``payload=false``, isn't
decoded: plain files are skipped ahead, and a gzip member that tells its length
in the ``sl`` extra field is passed over without inflating it. A file is never split, as
only reading it tells where its records begin; the writer's files have a partition's size.

Writing: ``df.write.format("warc").mode("append").save(path)``, one gzip member for each
record. Tasks write under temporary names which the driver renames on commit, so
lost or repeated tasks leave no records behind.

Defined results: a null payload is empty; a null url has no WARC-Target-URI; line
breaks in header values are percent-encoded; truncated files raise; a missing or
empty folder has no records. ``with_revisits``: payloads are equal if their SHA-1, length and
a 64-bit hash are; of rows that tie for the largest id all are responses; rows that repeat
an id are records of their own; a very long payload is one record, and in memory once as
it is written or read; extra columns stay outside, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from tarnfall.llm.common import MAX_BROADCAST_IDS, new_path, prepare, spread_join, written

#: Columns that come straight from headers.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "payload_length": "X-Payload-Length",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", content_length bigint, headers map<string,string>, payload binary"
#: A writer starts another file beyond this; a reader packs smaller files up to this.
FILE_BYTES = PARTITION_BYTES = 32 << 20
READ_BYTES = 1 << 20
#: Bytes that are inflated at once where a member's length isn't told.
PIECE = 1 << 16
BATCH_BYTES = 8 << 20
MAX_HEADER = 1 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(headers: dict[str, str | None], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {clean(v)}" for k, v in headers.items() if v is not None], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member with its compressed and plain lengths in an ``sl`` extra field."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    if size >= 1 << 32 or len(data) >= 1 << 32:  # lengths that don't fit aren't told
        extra = b"xx" + bytes([8, 0]) + bytes(8)
    return (
        b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body
        + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    )


def http_block(payload: bytes, kind: str = "text/html; charset=utf-8") -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


class Source:
    """Plain bytes of a file behind a position; more of them are read as they are needed."""

    def __init__(self, stream):
        self.stream, self.plain, self.at = stream, b"", 0

    def _add(self, data: bytes) -> None:
        self.plain, self.at = self.plain[self.at :] + data if self.at < len(self.plain) else data, 0

    def _more(self) -> bool:
        data = self.stream.read(READ_BYTES)
        self._add(data)
        return bool(data)

    def header(self) -> bytes | None:
        while True:
            while self.plain[self.at : self.at + 1] in (b"\r", b"\n"):
                self.at += 1
            if (end := self.plain.find(b"\r\n\r\n", self.at)) >= 0:
                out, self.at = self.plain[self.at : end], end + 4
                return out
            if len(self.plain) - self.at > MAX_HEADER:
                raise ValueError("a record's header doesn't end")
            if not self._more():
                if self.at < len(self.plain):
                    raise ValueError("the file ends inside a record's header")
                return None

    def block(self, size: int) -> bytes:
        parts, got = [], 0
        while got < size:
            if self.at == len(self.plain) and not self._more():
                raise ValueError("the file ends inside a record")
            parts.append(self.plain[self.at : self.at + size - got])
            self.at += len(parts[-1])
            got += len(parts[-1])
        return parts[0] if len(parts) == 1 else b"".join(parts)

    def skip(self, size: int) -> None:
        while size:
            if self.at == len(self.plain) and not self._more():
                raise ValueError("the file ends inside a record")
            here = min(size, len(self.plain) - self.at)
            self.at += here
            size -= here


class Gzip(Source):
    """Records in gzip members, one each (or several, in files of other writers)."""

    def __init__(self, stream):
        super().__init__(stream)
        self.raw, self.pos = b"", 0
        self.inflate, self.left = None, None

    def _have(self, n: int) -> bool:
        """Whether n compressed bytes are there."""
        while len(self.raw) - self.pos < n:
            data = self.stream.read(READ_BYTES)
            if not data:
                return False
            self.raw, self.pos = self.raw[self.pos :] + data, 0
        return True

    def _open(self) -> bool:
        if not self._have(1):
            return False
        self.left = None
        if self._have(24) and self.raw[self.pos + 3] & 4 and self.raw[self.pos + 12 : self.pos + 16] == b"sl\x08\0":
            self.left = struct.unpack_from("<I", self.raw, self.pos + 16)[0]
        self.inflate = zlib.decompressobj(31)
        return True

    def _more(self) -> bool:
        """More plain bytes, from the next member if this one is over."""
        if self.inflate is None and not self._open():
            return False
        if not self._have(1):
            raise ValueError("the file ends inside a gzip member")
        # Only this member's bytes, so that none come back.
        take = min(len(self.raw) - self.pos, PIECE if self.left is None else max(self.left, 1))
        self._add(self.inflate.decompress(memoryview(self.raw)[self.pos : self.pos + take], READ_BYTES))
        rest = self.inflate.unconsumed_tail if not self.inflate.eof else self.inflate.unused_data
        self.pos += take - len(rest)
        if self.left is not None:
            self.left -= take - len(rest)
        if self.inflate.eof:
            self.inflate = None
        return True

    def skip(self, size: int) -> None:
        if self.inflate is None or self.left is None:
            super().skip(size)
            return
        while self.left > len(self.raw) - self.pos:
            self.left -= len(self.raw) - self.pos
            self.raw, self.pos = b"", 0
            if not self._have(1):
                raise ValueError("the file ends inside a gzip member")
        self.pos += self.left
        self.plain, self.at, self.inflate = b"", 0, None


def parse_header(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def payload_of(headers: dict[str, str], block: bytes) -> bytes | None:
    """The entity body of an HTTP block; other blocks are payloads themselves."""
    if headers.get("warc-type") == "revisit":
        return None
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def value_of(headers: dict[str, str], column: str) -> str | None:
    return headers.get(HEADERS[column].lower())


def holds(test: Filter, headers: dict[str, str]) -> bool:
    value = value_of(headers, test.attribute[0])
    if isinstance(test, EqualTo):
        return value is not None and value == test.value
    if isinstance(test, In):
        return value is not None and value in test.value
    if isinstance(test, StringStartsWith):
        return value is not None and value.startswith(test.value)
    return value is not None


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, top = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(top)
        if info.type == pafs.FileType.File:
            files = [info]
        else:
            files = fs.get_file_info(pafs.FileSelector(top, recursive=True, allow_not_found=True))
        files = [f for f in files if f.type == pafs.FileType.File and re.search(r"\.warc(\.gz)?$", f.base_name) and f.base_name[0] not in "._"]
        out: list[list[str]] = []
        size = PARTITION_BYTES
        for f in sorted(files, key=lambda f: f.path):
            if size + f.size > PARTITION_BYTES:
                out.append([])
                size = 0
            out[-1].append(f.path)
            size += f.size
        return [Files(tuple(p)) for p in out] or [Files(())]

    def records(self, path: str, fs: pafs.FileSystem) -> Iterator[tuple[dict[str, str], bytes | None]]:
        with fs.open_input_stream(path, compression=None) as stream:
            source = (Gzip if path.endswith(".gz") else Source)(stream)
            while (head := source.header()) is not None:
                headers = parse_header(head)
                size = int(headers.get("content-length", 0))
                if not all(holds(t, headers) for t in self.tests):
                    source.skip(size)
                elif self.payload:
                    yield headers, payload_of(headers, source.block(size))
                else:
                    yield headers, None
                    source.skip(size)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        rows, size = [], 0
        for path in partition.paths:
            for headers, payload in self.records(path, fs):
                rows.append((headers, payload))
                size += len(payload or b"") + 1000
                if size > BATCH_BYTES:
                    yield self.batch(rows)
                    rows, size = [], 0
        if rows or not partition.paths:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple[dict[str, str], bytes | None]]) -> pa.RecordBatch:
        columns = {c: pa.array([value_of(h, c) for h, _ in rows], pa.string()) for c in HEADERS}
        columns["content_length"] = pa.array([int(h.get("content-length", 0)) for h, _ in rows], pa.int64())
        columns["headers"] = pa.array([list(h.items()) for h, _ in rows], pa.map_(pa.string(), pa.string()))
        columns["payload"] = pa.array([p for _, p in rows], pa.binary())
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


@dataclass
class Done(WriterCommitMessage):
    files: tuple[str, ...]


class WarcWriter(DataSourceArrowWriter):
    """Rows: record_id, record_type, target_uri, date, payload_digest, refers_to, payload_length
    as in HEADERS, and payload. A revisit has HTTP headers but no payload."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        fs, top = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(top, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                payload = row["payload"] or b""
                revisit = row["record_type"] == "revisit"
                headers = {HEADERS[c]: row[c] for c in HEADERS}
                headers["Content-Type"] = "application/http;msgtype=response"
                if revisit:
                    headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                data = member(record(headers, http_block(b"" if revisit else payload)))
                if out is None or size + len(data) > FILE_BYTES:
                    if out is not None:
                        out.close()
                    files.append(f"{top}/_{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(files[-1], compression=None), 0
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Done(tuple(files))

    def commit(self, messages: list[Done | None]) -> None:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for path in (p for m in messages if m for p in m.files):
            folder, _, name = path.rpartition("/")
            fs.move(path, f"{folder}/part{name}")

    def abort(self, messages: list[Done | None]) -> None:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for path in (p for m in messages if m for p in m.files):
            fs.delete_file(path)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def with_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, date: str, most: int = MAX_BROADCAST_IDS // 4) -> DataFrame:
    """Writer rows of pages. Of equal payloads the largest id is the response and the others
    refer to it; rows that share that id are all responses. The payloads that occur twice
    are counted: if they are few they are broadcast and no payload is moved, else their
    ids are found first, salted by payload, and payloads are shuffled by id."""
    row = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("target_uri"),
        F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha", F.sha1("payload"))
    same = F.concat_ws("-", "sha", F.hex(F.xxhash64("payload")), F.octet_length("payload"))
    row = row.withColumn("same", same)
    again = row.groupBy("same").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = written(again, "revisits")
    if again.count() <= most:
        again = again.select(F.col("same").alias("again"), "keep")
        row = row.join(F.broadcast(again), F.col("same") == F.col("again"), "left")
    else:
        marks = spread_join(row.select("same", "id"), again, ["same"], "n", F.xxhash64("id"))
        marks = written(marks.select(F.col("same").alias("again"), F.col("id").alias("of"), "keep").distinct(), "revisits")
        row = row.join(marks, (F.col("same") == F.col("again")) & F.col("id").eqNullSafe(F.col("of")), "left")
    revisit = F.col("again").isNotNull() & ~F.col("id").eqNullSafe(F.col("keep"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    return row.select(
        urn(F.col("id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit(date).alias("date"),
        F.concat(F.lit("sha1:"), base32("sha")).alias("payload_digest"),
        F.when(revisit, urn(F.col("keep"))).alias("refers_to"),
        F.octet_length("payload").cast("string").alias("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def base32(sha_hex):
    """Base32 of 40 hex digits, five digits for four letters."""
    out = []
    for k in range(8):
        part = F.lpad(F.conv(F.substring(sha_hex, 5 * k + 1, 5), 16, 32), 4, "0")
        out.append(F.translate(part, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))
    return F.concat(*out)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    path = new_path(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    with_revisits(pages, "page_id", "url", "html", "2024-01-01T00:00:00Z").write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").load(path).where(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(.*)>', 1) AS bigint)")
    sha = F.when(F.col("payload").isNotNull(), base32(F.sha1("payload")))  # of what was read
    told = F.regexp_replace("payload_digest", "^sha1:", "")
    return back.select(
        page("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload"), F.col("payload_length")).cast("bigint").alias("payload_bytes"),
        F.coalesce(sha, told).alias("payload_digest"),
        "record_type",
        F.when(F.col("record_type") == "revisit", page("refers_to")).alias("refers_to"),
    )


def _base32_sql(sha_hex: str) -> tuple[str, str, str]:
    """DuckDB expressions: the digits n, five at a time v, and their Base32 letters."""
    bits = f"list_transform(range(0, 40), lambda i: ('0x' || substr({sha_hex}, i + 1, 1))::INT)"
    value = "list_transform(range(0, 8), lambda g: list_reduce(n[5 * g + 1 : 5 * g + 5], lambda a, b: a * 16 + b))"
    letters = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v[k // 4 + 1] >> (15 - 5 * (k % 4))) % 32 + 1, 1)"
    return bits, value, f"array_to_string(list_transform(range(0, 32), lambda k: {letters}), '')"


_N, _V, _B32 = _base32_sql("sha")
OP3_SQL = f"""
WITH a AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
b AS (SELECT page_id, strlen(p) AS payload_bytes, sha1(p) AS sha,
             max(page_id) OVER (PARTITION BY p) AS keep FROM a),
c AS (SELECT *, {_N} AS n FROM b), d AS (SELECT *, {_V} AS v FROM c)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to FROM d
"""
