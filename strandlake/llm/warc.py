"""WARC archives as a Spark data source, written and read in parallel.

``spark.read.format("warc")`` plans parts of files as partitions: each holds the records that begin in its range of bytes.
Predicates on the record type and on header fields are pushed down: a record's headers are parsed first, and where they
don't match, its payload is skipped. Compressed records carry their length in the gzip header (the ``sl`` field of the
standard's annex), so skipping is a seek; without that field the record is run through and dropped piece by piece.
Files are opened by their address (``file:``, ``hdfs:``, ``s3:`` …), so they may be in any store that pyarrow knows.
"""
import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from strandlake.operators.lookup import lookup

SCHEMA = ("record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, "
          "content_type string, http_length long, payload binary")
#: Columns by the header field that they come from.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
           "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_type": "content-type"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 16
GZIP = b"\x1f\x8b\x08"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(name: str, value: str | None) -> str:
    """A header line; what would break the line is percent-encoded. A null value has none."""
    return "" if value is None else f"{name}: " + "".join(quote(c) if c < " " or c == "\x7f" else c for c in value) + "\r\n"


def record(row) -> bytes:
    """The record of one row: headers, HTTP headers, and the payload unless it is a revisit."""
    payload = bytes(row["payload"] or b"")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    block = http if revisit else http + payload
    head = ("WARC/1.1\r\n" + _field("WARC-Type", row["record_type"]) + _field("WARC-Record-ID", row["record_id"]) + _field("WARC-Target-URI", row["target_uri"])
            + _field("WARC-Date", row["date"]) + _field("WARC-Payload-Digest", "sha1:" + digest(payload)) + _field("WARC-Refers-To", row["refers_to"])
            + _field("WARC-Profile", PROFILE if revisit else None) + f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n")
    return head.encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """One gzip member whose header tells its own length and that of its content."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    if size >= 1 << 32 or len(data) >= 1 << 32:  # too long for the field
        return GZIP + b"\0\0\0\0\0\0\xff" + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    return GZIP + b"\4\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data)) + body + struct.pack("<II", zlib.crc32(data), len(data))


def _open_store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # as written, as committed


class WarcWriter(DataSourceWriter):
    """Every task writes files of its own under a name of its own; the driver moves those of committed tasks into place."""

    def __init__(self, options):
        self.path, self.most, self.compress = options["path"].rstrip("/"), int(options.get("maxbytes", 1 << 30)), options.get("compression", "gzip") == "gzip"
        self.run = uuid.uuid4().hex

    def write(self, rows) -> Written:
        from pyspark import TaskContext
        store, path = _open_store(self.path)
        task, attempt, files, out, size = TaskContext.get().partitionId(), uuid.uuid4().hex, [], None, 0
        store.create_dir(f"{path}/_temporary/{self.run}", recursive=True)
        for row in rows:
            if out is None or size >= self.most:
                if out:
                    out.close()
                name = f"part-{task:05d}-{len(files):04d}-{self.run}.warc" + ".gz" * self.compress
                files.append((f"{path}/_temporary/{self.run}/{attempt}-{name}", f"{path}/{name}"))
                out, size = store.open_output_stream(files[-1][0], compression=None), 0
            data = record(row)
            data = gzip_member(data) if self.compress else data
            out.write(data)
            size += len(data)
        if out:
            out.close()
        return Written(files)

    def commit(self, messages) -> None:
        store, path = _open_store(self.path)
        store.create_dir(path, recursive=True)
        for message in messages:
            for source, target in message.files if message else []:
                store.move(source, target)
        self._clean(store, path)

    def abort(self, messages) -> None:
        self._clean(*_open_store(self.path))

    def _clean(self, store: fs.FileSystem, path: str) -> None:
        if store.get_file_info(f"{path}/_temporary/{self.run}").type != fs.FileType.NotFound:
            store.delete_dir(f"{path}/_temporary/{self.run}")


@dataclass
class Range(InputPartition):
    """The records of a file that begin in a range of its bytes."""
    path: str
    start: int
    end: int


def _wanted(predicates: list[tuple[str, str, tuple]], headers: dict[str, str]) -> bool:
    for kind, name, values in predicates:
        value = headers.get(HEADERS[name])
        held = {"null": value is None, "known": value is not None, "in": value in values, "starts": value is not None and value.startswith(values[:1] or ("",))}[kind]
        if not held:
            return False
    return True


def _headers(lines: bytes) -> dict[str, str]:
    """Fields by their names in lower case; a line that begins with white space carries on the one before."""
    out, name = {}, None
    for line in lines.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


class _Stream:
    """Bytes from a place in a file on, of one record after the other, decompressed where they are compressed."""

    def __init__(self, file, compressed: bool):
        self.file, self.compressed, self.at = file, compressed, 0
        self.inflate, self.start, self.jump, self.ready = None, 0, None, b""

    def seek(self, at: int) -> None:
        self.file.seek(at)
        self.at = self.start = at
        self.jump, self.ready = None, b""
        self.inflate = None
        if self.compressed:
            head = self.file.read(24)
            if head[:4] == GZIP + b"\4" and head[12:14] == b"sl":
                self.jump = struct.unpack("<I", head[16:20])[0]
            self.file.seek(at)
            self.inflate = zlib.decompressobj(31)

    def more(self) -> bytes:
        """The next piece; empty at the end of the compressed record or of the file."""
        if not self.compressed:
            data = self.file.read(CHUNK)
            self.at += len(data)
            return data
        while not self.inflate.eof:
            data = self.inflate.unconsumed_tail or self.file.read(CHUNK)
            if not data:
                raise EOFError("the archive ends within a record")
            self.at += len(data) - (len(self.inflate.unconsumed_tail) if data is self.inflate.unconsumed_tail else 0)
            out = self.inflate.decompress(data, 4 * CHUNK)
            if out:
                return out
        return b""

    def next_member(self) -> int:
        """Where the next compressed record begins."""
        if self.jump:
            return self.start + self.jump
        while self.more():
            pass
        return self.at - len(self.inflate.unused_data)


def _resync(file, start: int, end: int) -> int:
    """The first place from ``start`` on where a compressed record begins, or ``end``."""
    at = start
    while at < end:
        file.seek(at)
        data = file.read(1 << 20)
        k = data.find(GZIP)
        while k >= 0 and at + k < end:
            file.seek(at + k)
            try:
                if zlib.decompressobj(31).decompress(file.read(4096), 7) == b"WARC/1.":
                    return at + k
            except zlib.error:
                pass
            k = data.find(GZIP, k + 1)
        if len(data) < 1 << 20:
            return end
        at += len(data) - len(GZIP)
    return end


def read_range(file, size: int, part: Range, predicates: list, with_payload: bool) -> Iterator[tuple]:
    """Rows of the records that begin in the range and hold the predicates."""
    compressed = part.path.endswith(".gz")
    stream = _Stream(file, compressed)
    at = _resync(file, part.start, part.end) if part.start else 0
    while at < min(part.end, size):
        stream.seek(at)
        data = b""
        while b"\r\n\r\n" not in data:
            piece = stream.more()
            if not piece:
                if data.strip():
                    raise EOFError(f"{part.path}: the record at {at} has no end of its headers")
                return
            data += piece
        head, _, data = data.partition(b"\r\n\r\n")
        headers = _headers(head)
        length = int(headers.get("content-length", 0))
        following = at + len(head) + 4 + length + 4
        if _wanted(predicates, headers):
            http = headers.get("content-type", "").startswith("application/http")
            have, need = [data[:length]], length - len(data)
            while need > 0 and (with_payload or http and b"\r\n\r\n" not in b"".join(have[:2])):
                piece = stream.more()
                if not piece:
                    raise EOFError(f"{part.path}: the record at {at} is cut off")
                have.append(piece[:need])
                need -= len(piece)
            block = b"".join(have)
            fields, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
            http_length = _headers(fields).get("content-length") if http else None
            revisit = headers.get("warc-type") == "revisit"
            named = (headers.get("warc-payload-digest") or "").removeprefix("sha1:") or None
            if with_payload and not revisit and named and digest(payload) != named:
                raise ValueError(f"{part.path}: the payload at {at} doesn't have its digest")
            row = {c: headers.get(h) for c, h in HEADERS.items()}
            yield (*(named if c == "payload_digest" else row[c] for c in HEADERS), int(http_length) if http_length else None,
                   payload if with_payload and not revisit else None)
        at = stream.next_member() if compressed else following


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"].rstrip("/"), int(options.get("splitbytes", 64 << 20))
        self.with_payload = options.get("payload", "true") == "true"
        self.predicates: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        """Keep predicates on header fields; the others go back to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            # a digest is written with its algorithm, which the column leaves out
            kind = None if name not in HEADERS or name == "payload_digest" else \
                ("in", (f.value,)) if isinstance(f, EqualTo) else ("in", tuple(f.value)) if isinstance(f, In) else ("null", ()) if isinstance(f, IsNull) else \
                ("known", ()) if isinstance(f, IsNotNull) else ("starts", (f.value,)) if isinstance(f, StringStartsWith) else None
            if kind:
                self.predicates.append((kind[0], name, kind[1]))
            else:
                yield f

    def partitions(self):
        store, path = _open_store(self.path)
        info = store.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path)) if info.type == fs.FileType.Directory else []
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        names = sorted((f.path, f.size) for f in files if f.type == fs.FileType.File and f.path.endswith((".warc", ".warc.gz")))
        # a payload may hold what looks like the start of a plain record: files that aren't compressed are read as one
        steps = [(p, size, self.split if p.endswith(".gz") else max(size, 1)) for p, size in names]
        return [Range(p, at, min(at + step, size)) for p, size, step in steps for at in range(0, size, step)] or [Range("", 0, 0)]

    def read(self, part: Range):
        if part.end == part.start:
            return
        store, _ = _open_store(self.path)
        columns, held, kinds = [[] for _ in range(9)], 0, [pa.string()] * 7 + [pa.int64(), pa.binary()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        with store.open_input_file(part.path) as file:
            for row in read_range(file, file.size(), part, self.predicates, self.with_payload):
                for column, x in zip(columns, row):
                    column.append(x)
                held += len(row[-1] or b"")
                if held >= 8 << 20 or len(columns[0]) >= 5_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
                    columns, held = [[] for _ in range(9)], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


class WarcSource(DataSource):
    """Options: ``path``, ``payload`` (false: headers only), ``splitBytes``; for writing ``compression`` (gzip, none) and ``maxBytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter({k.lower(): v for k, v in self.options.items()})


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(**options).load(path)


def write_warc(records: DataFrame, path: str, **options) -> None:
    """Write ``records (record_type, record_id, target_uri, date, refers_to, payload)``, a record each; revisits without their payload."""
    records.sparkSession.dataSource.register(WarcSource)
    records.select("record_type", "record_id", "target_uri", "date", "refers_to", "payload").write.format("warc").mode("append").options(**options).save(path)


def page_records(pages: DataFrame, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Records of ``pages (page_id, url, html, …)``, the html in UTF-8 as payload (null: empty).

    Of pages with equal payloads of ``least`` bytes or more, the one with the largest page_id is the response and the others
    revisit it. Rows that repeat this page_id are all responses; null page_ids come before all others. Payloads aren't grouped:
    only digests are, and a payload on very many pages is joined in parts.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    groups = rows.filter(F.col("bytes") >= least).groupBy("sha", "bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    named = lambda c: F.format_string("<urn:page:%s>", F.coalesce(F.col(c).cast("string"), F.lit("null")))
    joined = lookup(rows, groups, ["sha", "bytes"], "page_id", how="left", measure=True)
    revisit = F.col("copies").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(F.when(revisit, "revisit").otherwise("response").alias("record_type"), named("page_id").alias("record_id"), F.col("url").alias("target_uri"),
                         F.lit(date).alias("date"), F.when(revisit, named("first")).alias("refers_to"), "payload")


def page_rows(archive: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of the records of pages in an archive."""
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    page = lambda c: F.when(number(c) != "", number(c)).cast("long")
    size = F.coalesce(F.octet_length("payload").cast("long"), F.col("http_length"))
    return archive.select(page("record_id").alias("page_id"), size.alias("payload_bytes"), "payload_digest", "record_type", page("refers_to").alias("refers_to"))
