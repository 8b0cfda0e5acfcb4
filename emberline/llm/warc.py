"""WARC archives as a PySpark data source, to write and to read.

Records are gzip members of their own. Each member's header carries its compressed size in the extra field ``sl``, so that a reader
that does not want a record steps over it without inflating it. The writer's tasks make files of their own names; the commit writes a
manifest of the files that successful tasks made, with the offsets at which a file may be split, so retries and lost executors
leave nothing that is read. The reader plans one partition for each such piece, takes over predicates on record type, record id,
target URI, digest and page id, parses a record's headers first, and inflates a payload only if the record passes and the option
``payload`` is not ``false``. With ``verify`` payloads are inflated, measured and held against their digests, but not handed on. Members of
other writers, which do not tell their size, are inflated in pieces; what is not wanted of them is not kept.

Paths are local, ``file:`` or of any scheme that pyarrow knows (hdfs, s3, gs). Defined cases: null html is an empty payload, null url
gives no target URI, an empty table gives an empty archive, null page ids give records without a page id; payloads are kept whole, however
long; of equal payloads the least page id is the response, a null one only if there is no other; repeated rows, of one page id and payload,
are all of one type; columns other than the three that are named are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from emberline.operators.skew import join_on_hot_key, small_or_shuffled
from emberline.session import forget, fresh_path, gone_at_exit, table, written

#: Bytes of a file after which the next record may begin a new piece.
PIECE_BYTES = 8 << 20
#: Bytes of records that pass between Python and the JVM at a time; a longer record passes alone.
BATCH_BYTES = 4 << 20
#: Payloads smaller than this are stored again instead of referred to.
REVISIT_MIN_BYTES = 0
_FIELDS = "page_id long, record_type string, record_id string, target_uri string, refers_to long, payload_digest string, payload_bytes long, content_type string, payload binary"
_ARROW = pa.schema([(name, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[kind]) for name, kind in (f.split() for f in _FIELDS.split(", "))])
_PREDICATES = {"page_id", "record_type", "record_id", "target_uri", "payload_digest"}
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    parts = urllib.parse.urlparse(path)
    if parts.scheme in ("", "file"):
        return pafs.LocalFileSystem(), parts.path
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member with its compressed and raw sizes in the extra field ``sl``."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    extra = b"sl" + struct.pack("<HII", 8, 10 + 2 + 12 + len(body) + 8, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response or revisit record of one page, before compression."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Done(WriterCommitMessage):
    def __init__(self, name: str, size: int, splits: list[int], records: int):
        self.name, self.size, self.splits, self.records = name, size, splits, records


class WarcWriter(DataSourceArrowWriter):
    """Takes page_id, url, payload, refers_to, revisit."""

    def __init__(self, path: str, piece: int):
        self.path, self.piece = path, piece

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _store(self.path)
        name, at, splits, n, out = f"part-{uuid.uuid4().hex}.warc.gz", 0, [0], 0, None
        try:
            for b in iterator:
                for r in b.to_pylist():
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    if at - splits[-1] >= self.piece:
                        splits.append(at)
                    data = member(record(r["page_id"], r["url"], r["payload"], r["refers_to"], r["revisit"]))
                    out.write(data)
                    at, n = at + len(data), n + 1
        finally:
            if out is not None:
                out.close()
        return _Done(name, at, splits, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _store(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([m.__dict__ for m in messages if m is not None and m.records]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _store(self.path)
        for m in messages:
            if m is not None and m.records:
                fs.delete_file(f"{root}/{m.name}")


class Piece(InputPartition):
    def __init__(self, file: str, start: int, end: int | None):
        self.file, self.start, self.end = file, start, end


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        out[k.lower()] = v.strip()
    return out


def _page(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: str):
        self.path, self.payload = path, payload
        self.wanted: list[tuple[str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in _PREDICATES and isinstance(f, EqualTo):
                self.wanted.append((name, (f.value,)))
            elif name in _PREDICATES and isinstance(f, In):
                self.wanted.append((name, tuple(f.value)))
            elif isinstance(f, IsNotNull) and name in ("record_type", "record_id", "payload_digest"):
                pass
            else:
                yield f

    def partitions(self) -> list[Piece]:
        fs, root = _store(self.path)
        pieces = []
        found = [f for f in fs.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.File]
        manifests = [f for f in found if f.base_name.startswith("manifest-")]
        for m in manifests:
            with fs.open_input_stream(m.path) as s:
                for d in json.loads(s.read()):
                    pieces += [Piece(d["name"], a, b) for a, b in zip(d["splits"], [*d["splits"][1:], d["size"]], strict=True)]
        if not manifests:  # archives of other writers: whole files
            pieces = [Piece(f.base_name, 0, None) for f in found if f.base_name.endswith((".warc.gz", ".warc"))]
        return pieces

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in self.rows(partition):
            held.append(row)
            size += 512 + len(row[-1] or b"")
            if size >= BATCH_BYTES:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    def rows(self, partition: Piece | None) -> Iterator[tuple]:
        if partition is None:
            return
        fs, root = _store(self.path)
        with fs.open_input_file(f"{root}/{partition.file}") as f:
            end = f.size() if partition.end is None else partition.end
            f.seek(partition.start)
            for head, rest in (_plain_records(f, end) if partition.file.endswith(".warc") else _packed_records(f, end)):
                row = self.row(_headers(head), rest)
                if row is not None:
                    yield row

    def row(self, h: dict[str, str], rest) -> tuple | None:
        kind = h.get("warc-type")
        known = {"page_id": _page(h.get("warc-record-id")), "record_type": kind, "record_id": h.get("warc-record-id"), "target_uri": h.get("warc-target-uri"), "payload_digest": (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None}
        if any(known[name] not in values for name, values in self.wanted):
            return None
        size, payload, digest = None, None, known["payload_digest"]
        if self.payload != "false" or kind == "revisit":
            block = rest(int(h.get("content-length", 0)))
            http, _, payload = block.partition(b"\r\n\r\n") if h.get("content-type", "").startswith("application/http") else (b"", b"", block)
            if kind == "revisit":
                size, payload = int(_headers(http).get("content-length", 0)), None
            else:
                size, own = len(payload), base32_sha1(payload)
                if digest is not None and digest != own:
                    raise ValueError(f"payload of {known['record_id']} does not match its digest")
                digest = own
                if self.payload == "verify":
                    payload = None
        return (known["page_id"], kind, known["record_id"], known["target_uri"], _page(h.get("warc-refers-to")), digest, size, h.get("content-type"), payload)


class Damaged(ValueError):
    """A record or member that does not hold what its headers say."""


def _packed_records(f, end: int):
    """(header block, function that inflates so many bytes after it) of each gzip member."""
    while (at := f.tell()) < end:
        fixed = f.read(12)
        if len(fixed) < 12:
            raise Damaged(f"the member at byte {at} is cut")
        size = None
        if fixed[3] & 4:
            extra = f.read(struct.unpack("<H", fixed[10:12])[0])
            while len(extra) >= 4:
                n = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"sl":
                    size = struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + n :]
        if size is None:
            yield from _foreign_members(f, at, end)
            return
        start = f.tell()
        packed = f.read(min(4096, at + size - 8 - start))
        unpack = zlib.decompressobj(-15)
        raw = unpack.decompress(packed, 8192)
        while b"\r\n\r\n" not in raw:
            packed = unpack.unconsumed_tail or f.read(min(4096, max(0, at + size - 8 - f.tell())))
            if not packed or unpack.eof:
                raise Damaged(f"the record at byte {at} ends within its header block")
            raw += unpack.decompress(packed, 8192)
        head, _, tail = raw.partition(b"\r\n\r\n")

        def rest(n: int, unpack=unpack, tail=tail, at=at, size=size) -> bytes:
            if len(tail) < n:
                tail += unpack.decompress(unpack.unconsumed_tail + f.read(max(0, at + size - 8 - f.tell())))
            if len(tail) < n:
                raise Damaged(f"the record at byte {at} ends within its block")
            return tail[:n]

        yield head, rest
        f.seek(at + size)


class _Inflated:
    """The contents of gzip members, from ``at`` on, read in pieces."""

    def __init__(self, f, at: int, end: int):
        f.seek(at)
        self.f, self.end, self.unpack, self.held = f, end, zlib.decompressobj(31), b""

    def more(self) -> bool:
        while True:
            data = self.unpack.unconsumed_tail or (self.unpack.unused_data if self.unpack.eof else b"") or (self.f.read(1 << 16) if self.f.tell() < self.end else b"")
            if not data:
                return False
            if self.unpack.eof:
                self.unpack = zlib.decompressobj(31)
            got = self.unpack.decompress(data, 1 << 16)
            if got:
                self.held += got
                return True

    def is_cut(self) -> bool:
        return not self.unpack.eof

    def until(self, mark: bytes) -> bytes | None:
        """What stands before ``mark``, which is passed over; None at the end."""
        while (i := self.held.find(mark)) < 0:
            if not self.more():
                return None
        out, self.held = self.held[:i], self.held[i + len(mark) :]
        return out

    def take(self, n: int, keep: bool = True) -> bytes:
        parts = []
        while n > 0 and (self.held or self.more()):
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            if keep:
                parts.append(part)
        return b"".join(parts)

    def skip_lines(self) -> None:
        while True:
            self.held = self.held.lstrip(b"\r\n")
            if self.held or not self.more():
                return


class _Plain(_Inflated):
    """The contents of a file that is not compressed."""

    def __init__(self, f, end: int):
        self.f, self.end, self.held = f, end, b""

    def is_cut(self) -> bool:
        return False

    def more(self) -> bool:
        got = self.f.read(1 << 16) if self.f.tell() < self.end else b""
        self.held += got
        return bool(got)


def _records_of(source: _Inflated):
    """(header block, function that gives so many bytes after it) of each record; a body is kept only if it is asked for."""
    while True:
        source.skip_lines()
        head = source.until(b"\r\n\r\n")
        if head is None:
            if source.held.strip() or source.is_cut():
                raise Damaged("the last record ends within its header block")
            return
        left = [int(_headers(head).get("content-length", 0))]

        def rest(n: int, left=left) -> bytes:
            sought = min(n, left[0])
            out = source.take(sought)
            if len(out) < sought:
                raise Damaged("the last record ends within its block")
            left[0] -= len(out)
            return out

        yield head, rest
        source.take(left[0], keep=False)


def _foreign_members(f, at: int, end: int):
    """Members whose headers do not give their size."""
    yield from _records_of(_Inflated(f, at, end))


def _plain_records(f, end: int):
    yield from _records_of(_Plain(f, end))


class WarcSource(DataSource):
    """Options: ``path``; ``payload`` (false: bodies are not inflated, payload and, for responses, payload_bytes are null; verify: payload is
    null, but measured and held against its digest)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _FIELDS

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower())

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], int(self.options.get("piece", PIECE_BYTES)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_pages(pages: DataFrame, path: str, min_bytes: int = REVISIT_MIN_BYTES, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """A record per page. Of equal payloads of at least ``min_bytes`` bytes, the page of least id is the response, the others revisit it."""
    spark = pages.sparkSession
    register(spark)
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    ids = pages.select(F.col(key).alias("k"), F.sha1(payload).alias("d"), F.octet_length(payload).alias("b")).where(F.col("b") >= min_bytes)
    first = written(ids.groupBy("d").agg(F.min("k").alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
    later = join_on_hot_key(ids, first, "d", "n", ["first"], F.xxhash64("k")).where("first is not null and not (k <=> first)").select("k", "d", "first").distinct()
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).withColumn("d", F.sha1("payload"))
    later = written(later.withColumnRenamed("d", "d2"), "later")
    rows = rows.join(small_or_shuffled(later), F.col("page_id").eqNullSafe(F.col("k")) & (F.col("d") == F.col("d2")), "left")
    rows = rows.select("page_id", "url", "payload", F.col("first").alias("refers_to"), F.col("first").isNotNull().alias("revisit"))
    limit, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set(limit, BATCH_BYTES)
    try:
        rows.write.format("warc").mode("append").option("path", path).save()
    finally:
        spark.conf.set(limit, before)
        forget(first, later)


def read_warc(spark: SparkSession, path: str, payload: bool | str = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_pages(table(spark, sf_dir, "pages"), path)
    gone_at_exit(spark, path)
    return read_warc(spark, path, "verify").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("target_uri").alias("url"))
