"""WARC archives as a Python data source (``format("warc")``), for reading and writing.

Reading: ``partitions`` lists the files and makes one partition of each (``write`` rolls to a new file every
``max_file_bytes``, so files stay small enough for a task). Equality, ``IN`` and prefix predicates on the header columns
are pushed down. Of each record the headers are parsed first; a record that the predicates refuse, or whose payload isn't
asked for (option ``payload`` "false"), is stepped over: by its Content-Length in plain files, and in compressed ones by
the member's length where the writer left it (an ``sl`` extra field, as this writer does), without inflating it.

Writing: each record is a gzip member of its own. Task attempts write files of unlike names, and the commit lists those
of the successful attempts in ``_COMMITTED``; readers take what such lists name, so a lost or repeated attempt leaves
nothing behind that is read.

Columns: ``key`` (long, header ``X-Record-Key``), ``record_type``, ``record_id``, ``target_uri``, ``date``,
``payload_digest`` (lower-case hex), ``payload_bytes`` (of the full payload; for a revisit what its HTTP header says),
``refers_to`` (record id), ``refers_to_key``, ``headers`` (map) and ``payload`` (binary; null for a revisit or unless asked for).

Defined results: a null payload is written as an empty one; a null URI has no header and comes back null; control
characters in a URI are percent-encoded; an empty table makes a folder that reads as no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from tesserae.operators.skew import lookup_join
from tesserae.session import qualified, scratch_path, stored

SCHEMA = "key long, record_type string, record_id string, target_uri string, date string, payload_digest string, payload_bytes long, refers_to string, refers_to_key long, headers map<string,string>, payload binary"
# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
_HEAD_COLUMNS = {"key", "record_type", "record_id", "target_uri", "date", "payload_digest", "refers_to", "refers_to_key"}
_CHUNK = 1 << 20


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _digest_hex(value: str | None) -> str | None:
    """``sha1:`` with base 32 or hex, as archives have either."""
    if not value:
        return None
    text = value.rpartition(":")[2]
    try:
        return base64.b32decode(text.upper()).hex() if len(text) == 32 else text.lower()
    except ValueError:
        return text.lower()


def _fields(block: bytes) -> tuple[str, dict[str, str]]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    found: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            found[last] = value.strip()
    return lines[0], found


class _Bytes:
    """Reads a file by chunks; knows how to peek and to step over."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held, self.from_ = file, size, 0, b"", 0

    def peek(self, n: int) -> bytes:
        low = self.at - self.from_
        if low < 0 or low + n > len(self.held):
            self.file.seek(self.at)
            self.held, self.from_, low = self.file.read(max(n, _CHUNK)), self.at, 0
        return self.held[low : low + n]

    def skip(self, n: int) -> None:
        self.at += n


def _member(source: _Bytes) -> tuple[Iterator[bytes], int | None]:
    """The inflated stream of the gzip member at hand, piece by piece, and the member's length if an ``sl`` field has it."""
    head = source.peek(32)
    length = None
    if len(head) > 24 and head[3] & 4 and head[12:14] == b"sl":
        length = struct.unpack("<I", head[16:20])[0]
    start = source.at

    def pieces() -> Iterator[bytes]:
        inflater, at = zlib.decompressobj(31), start
        step = 4096
        while not inflater.eof:
            source.at = at
            raw = source.peek(step)
            if not raw:
                raise EOFError("the archive ends inside a record")
            out = inflater.decompress(raw)
            at += len(raw) - len(inflater.unused_data)
            step = _CHUNK
            if out:
                yield out
        source.at = at

    return pieces(), length


def records(file, size: int, wanted=lambda head: True, payload: bool = True) -> Iterator[tuple[dict[str, str], dict[str, str], bytes | None, dict[str, int]]]:
    """Headers, HTTP headers and payload of the records that ``wanted`` lets through, and what was skipped or inflated so far."""
    source, seen = _Bytes(file, size), {"skipped": 0, "inflated": 0}
    while source.at < size:
        packed = source.peek(2) == b"\x1f\x8b"
        if packed:
            stream, length = _member(source)
            start, held = source.at, b""
            for piece in stream:
                held += piece
                if b"\r\n\r\n" in held:
                    break
        else:
            held, start, n = b"", source.at, 4096
            while b"\r\n\r\n" not in held:
                held = source.peek(n)
                if len(held) < n and b"\r\n\r\n" not in held:
                    break
                n *= 4
            if not held.strip():
                return
            lead = len(held) - len(held.lstrip(b"\r\n"))
            source.skip(lead)
            held, start = held[lead:], start + lead
        block, cut, body = held.partition(b"\r\n\r\n")
        if not cut:
            raise EOFError("a record without the end of its headers")
        _, head = _fields(block)
        count = int(head.get("content-length", 0))
        keep = wanted(head)
        http = head.get("content-type", "").startswith("application/http")
        need = count if keep and payload else 0
        web: dict[str, str] = {}
        if packed:
            if keep:
                enough = lambda: len(body) >= need and (not http or b"\r\n\r\n" in body[:count] or len(body) >= count)
                while not enough():
                    piece = next(stream, b"")
                    if not piece:
                        break
                    body += piece
            if length:
                source.at = start + length
                seen["skipped"] += not keep or not payload
            else:
                for _ in stream:
                    pass
                seen["inflated"] += 1
        else:
            source.at = start + len(block) + 4
            if keep:
                n = need or min(count, 4096)
                body = source.peek(n)
                while http and b"\r\n\r\n" not in body and len(body) < count:
                    n = min(count, 4 * n)
                    body = source.peek(n)
            source.skip(count + 4)
            seen["skipped"] += not keep or not payload
        if not keep:
            continue
        body = body[:count]
        if http:
            top, _, rest = body.partition(b"\r\n\r\n")
            _, web = _fields(top)
            body = rest
        yield head, web, body if payload and head.get("warc-type") != "revisit" else None, seen


def _row(head: dict[str, str], web: dict[str, str], payload: bytes | None) -> tuple:
    def number(x: str | None) -> int | None:
        return int(x) if x and x.lstrip("-").isdigit() else None

    size = number(web.get("content-length")) if web else number(head.get("content-length"))
    return (number(head.get("x-record-key")), head.get("warc-type"), head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date"), _digest_hex(head.get("warc-payload-digest")), size, head.get("warc-refers-to"), number(head.get("x-refers-to-key")), head, payload)


def _column(head: dict[str, str], name: str):
    return _row(head, {}, None)[["key", "record_type", "record_id", "target_uri", "date", "payload_digest", "", "refers_to", "refers_to_key"].index(name)]


def _passes(head: dict[str, str], filters: list[tuple[str, str, object]]) -> bool:
    for kind, name, value in filters:
        own = _column(head, name)
        if own is None or kind == "eq" and own != value or kind == "in" and own not in value or kind == "prefix" and not own.startswith(value):
            return False
    return True


@dataclass
class FilePartition(InputPartition):
    path: str
    size: int

    def __init__(self, path: str, size: int):
        super().__init__(path)
        self.path, self.size = path, size


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.uri = options["path"]
        self.payload = options.get("payload", "true").lower() == "true" and "payload" in schema.names
        self.names = schema.names
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name not in _HEAD_COLUMNS:
                yield f
            elif isinstance(f, EqualTo):
                self.filters.append(("eq", name, f.value))
            elif isinstance(f, In):
                self.filters.append(("in", name, set(f.value)))
            elif isinstance(f, StringStartsWith):
                self.filters.append(("prefix", name, f.value))
            elif isinstance(f, IsNotNull):
                self.filters.append(("set", name, None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, path = _store(self.uri)
        info = store.get_file_info(path)
        if info.is_file:
            return [FilePartition(path, info.size)]
        files = {f.base_name: f for f in store.get_file_info(pafs.FileSelector(path, recursive=False)) if f.is_file}
        lists = [n for n in files if n.startswith("_COMMITTED")]
        if lists:
            names = set()
            for n in lists:
                with store.open_input_stream(files[n].path) as f:
                    names |= set(f.read().decode().split())
        else:
            names = {n for n in files if n.endswith((".warc", ".warc.gz"))}
        return [FilePartition(files[n].path, files[n].size) for n in sorted(names)]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        store, _ = _store(self.uri)
        at = [SCHEMA_NAMES.index(n) for n in self.names]
        if partition is None or not partition.size:
            return
        with store.open_input_file(partition.path) as f:
            for head, web, payload, _ in records(f, partition.size, lambda h: _passes(h, self.filters), self.payload):
                row = _row(head, web, payload)
                yield tuple(row[i] for i in at)


SCHEMA_NAMES = [p.split()[0] for p in SCHEMA.split(", ")]


@dataclass
class Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)


class WarcWriter(DataSourceWriter):
    """Rows have ``key``, ``record_type`` (response or revisit), ``target_uri``, ``payload`` and ``refers_to_key``; ``date`` is optional."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.uri = options["path"]
        self.limit = int(options.get("max_file_bytes", 128 << 20))
        self.level = int(options.get("level", 3))
        store, path = _store(self.uri)
        if overwrite and store.get_file_info(path).type != pafs.FileType.NotFound:
            store.delete_dir_contents(path)
        store.create_dir(path, recursive=True)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, path = _store(self.uri)
        out, size, names = None, 0, []
        try:
            for row in rows:
                if out is None or size >= self.limit:
                    if out is not None:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = store.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                data = compress(record(row.asDict()), self.level)
                out.write(data)
                size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path = _store(self.uri)
        with store.open_output_stream(f"{path}/_COMMITTED-{uuid.uuid4().hex}") as f:
            f.write("\n".join(n for m in messages if m for n in m.files).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path = _store(self.uri)
        for m in messages:
            for n in m.files if m else []:
                store.delete_file(f"{path}/{n}")


def record_id(key: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{key}')}>"


def record(row: dict) -> bytes:
    """One record with its HTTP block, uncompressed."""
    payload = row.get("payload")
    payload = b"" if payload is None else payload.encode("utf-8") if isinstance(payload, str) else bytes(payload)
    revisit = row.get("record_type") == "revisit"
    top = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = top if revisit else top + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(row.get('key'))}", f"WARC-Date: {row.get('date') or DATE}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}", f"Content-Length: {len(block)}"]
    if row.get("target_uri") is not None:
        head.insert(2, "WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in row["target_uri"]))
    if row.get("key") is not None:
        head.append(f"X-Record-Key: {row['key']}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(row['refers_to_key'])}", f"X-Refers-To-Key: {row['refers_to_key']}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def compress(data: bytes, level: int = 3) -> bytes:
    """A gzip member whose ``sl`` field holds its own and the inflated length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    extra = b"sl" + struct.pack("<H", 8)
    length = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + extra + struct.pack("<II", length, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def plan_revisits(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", least_bytes: int = 1000) -> DataFrame:
    """Rows for ``write``: of equal payloads of at least ``least_bytes`` the one with the largest key is the response, the
    others revisit it. Rows that share that key are all responses; rows without a key revisit. Equal means an equal SHA-1."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(uri).cast("string").alias("target_uri"), body.alias("payload"))
    digest = F.when(F.octet_length("payload") >= least_bytes, F.sha1("payload"))
    known = rows.select(digest.alias("_digest"), "key").filter("_digest is not null").groupBy("_digest").agg(F.max("key").alias("_first"), F.count("*").alias("_n"))
    copied = stored(known.filter("_n > 1 and _first is not null"), "digests")
    joined = lookup_join(rows.withColumn("_digest", digest), copied, "_digest", "_n", spread=F.coalesce("key", F.lit(-1)), rows=copied.count())
    revisit = F.col("_first").isNotNull() & ~F.col("key").eqNullSafe(F.col("_first"))
    return joined.select("key", F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", "payload", F.when(revisit, F.col("_first")).alias("refers_to_key"))


def write(rows: DataFrame, path: str, **options: object) -> None:
    register(rows.sparkSession)
    rows.write.format("warc").options(**options).mode("append").save(qualified(rows.sparkSession, path))


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(qualified(spark, path))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages' archive to the shared folder and reads it whole. ``payload_digest`` and ``payload_bytes`` of a response are those
    of the payload that came back; a revisit has none, and keeps what its header says."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(plan_revisits(pages), path)
    back = read(spark, path)
    return back.withColumns({"payload_digest": F.coalesce(F.sha1("payload"), F.col("payload_digest")), "payload_bytes": F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes"))})
