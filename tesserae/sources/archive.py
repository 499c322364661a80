"""Python data sources that read parts of large files: members of ZIP archives, and hashes of files.

``format("zip_members")``: of an archive the central directory is read (by ranges, at its end), and then the bytes of wanted members only.
Small archives share a partition; the members of a large one are spread over several, so an archive of any size is read by
many tasks, each of which holds one member at a time. Columns: ``path``, ``modified``, ``member`` (null where the archive can't be
read, or has no wanted member), ``position`` in the directory, ``size``, ``sha256`` and ``content``. Options, as suffixes apart by commas:
``members`` (those that are listed; all, if empty), ``content`` (of these the content is read), ``digest`` (of these the hash is
made, block by block). Equality, ``IN``, prefix and suffix predicates on ``member`` are pushed down.

``format("file_digests")``: ``path``, ``modified``, ``length`` and ``sha256`` of files, read block by block: no file is too large.

Both read what the Arrow file systems do (local, HDFS, S3, GCS). ``glob`` is a pattern of names; folders are read with all below them.
"""

from __future__ import annotations

import hashlib
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from fnmatch import fnmatch

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from tesserae.session import qualified

#: Bytes of files that a partition reads, and of an archive from which its members are spread.
PARTITION_BYTES = 64 << 20
_BLOCK = 1 << 20
#: What reading something that is no archive comes to; a file shorter than its end ought to be can't be sought in.
BROKEN = (zipfile.BadZipFile, pa.ArrowInvalid)
MEMBERS = "path string, modified timestamp, member string, position int, size long, sha256 string, content binary"
DIGESTS = "path string, modified timestamp, length long, sha256 string"


def store_of(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):  # such paths are taken as they are, with spaces too
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if ":" in uri else (pafs.LocalFileSystem(), uri)


def reachable(uri: str) -> bool:
    """Whether the Arrow file systems know the scheme of the path."""
    return uri.partition(":")[0] in ("file", "hdfs", "s3", "s3a", "gs") or ":" not in uri


@dataclass
class Found:
    path: str  # with its file system, as given
    modified: datetime
    size: int
    members: list[tuple[int, str]] | None = None  # of a large archive those to read; None: all


def _milliseconds(time: datetime) -> datetime:
    """As exact as other readers of files are."""
    return time.astimezone(timezone.utc).replace(microsecond=time.microsecond // 1000 * 1000)


def listed(uri: str, glob: str) -> list[Found]:
    """Files at the path or below it, whose names fit the pattern."""
    store, path = store_of(uri)
    info = store.get_file_info(path)
    infos = [info] if info.is_file else store.get_file_info(pafs.FileSelector(path, recursive=True))
    return [Found(uri[: len(uri) - len(path)] + i.path if ":" in uri else i.path, _milliseconds(i.mtime), i.size) for i in sorted(infos, key=lambda i: i.path) if i.is_file and fnmatch(i.base_name, glob)]


def grouped(files: list[Found], limit: int) -> list[list[Found]]:
    groups: list[list[Found]] = []
    size = 0
    for f in files:
        if not groups or size + f.size > limit:
            groups.append([])
            size = 0
        groups[-1].append(f)
        size += f.size
    return groups


class FilesPartition(InputPartition):
    def __init__(self, files: list[Found]):
        self.files = files


def digest_of(stream) -> str:
    total = hashlib.sha256()
    while block := stream.read(_BLOCK):
        total.update(block)
    return total.hexdigest()


class DigestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return DIGESTS

    def reader(self, schema: StructType) -> DataSourceReader:
        return DigestReader(self.options)


class DigestReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.glob, self.limit = options["path"], options.get("glob", "*"), int(options.get("partition_bytes", PARTITION_BYTES))

    def partitions(self) -> list[FilesPartition]:
        return [FilesPartition(g) for g in grouped(listed(self.path, self.glob), self.limit)]

    def read(self, partition: FilesPartition) -> Iterator[tuple]:
        for f in partition.files:
            store, path = store_of(f.path)
            with store.open_input_stream(path) as stream:
                yield f.path, f.modified, f.size, digest_of(stream)


class MemberSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: StructType) -> DataSourceReader:
        return MemberReader(self.options)


def _suffixes(value: str) -> tuple[str, ...]:
    return tuple(s for s in (x.strip() for x in value.split(",")) if s)


class MemberReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.glob, self.limit = options["path"], options.get("glob", "*.zip"), int(options.get("partition_bytes", PARTITION_BYTES))
        self.wanted, self.content, self.digest = (_suffixes(options.get(n, "")) for n in ("members", "content", "digest"))
        self.filters: list[tuple[str, tuple[str, ...]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute == ("member",):
                kind = "in" if isinstance(f, (EqualTo, In)) else "start" if isinstance(f, StringStartsWith) else "end"
                self.filters.append((kind, tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def takes(self, name: str) -> bool:
        if self.wanted and not name.endswith(self.wanted):
            return False
        return all(name in v if kind == "in" else name.startswith(v) if kind == "start" else name.endswith(v) for kind, v in self.filters)

    def partitions(self) -> list[FilesPartition]:
        """Small archives by their bytes; of a large one, whose directory is read here, the wanted members by theirs."""
        out, small = [], []
        for f in listed(self.path, self.glob):
            if f.size <= self.limit:
                small.append(f)
                continue
            store, path = store_of(f.path)
            try:
                with store.open_input_file(path) as stream, zipfile.ZipFile(stream) as z:
                    members = [Found(f.path, f.modified, m.compress_size, [(i, m.filename)]) for i, m in enumerate(z.infolist()) if self.takes(m.filename)]
            except BROKEN:
                members = []
            for group in grouped(members, self.limit) or [[]]:
                out.append(FilesPartition([Found(f.path, f.modified, f.size, [m for g in group for m in g.members])]))
        return [*out, *(FilesPartition(g) for g in grouped(small, self.limit))]

    def read(self, partition: FilesPartition) -> Iterator[tuple]:
        for f in partition.files:
            store, path = store_of(f.path)
            try:
                with store.open_input_file(path) as stream, zipfile.ZipFile(stream) as z:
                    infos = z.infolist()
                    chosen = f.members if f.members is not None else [(i, m.filename) for i, m in enumerate(infos) if self.takes(m.filename)]
                    if not chosen and not self.filters:
                        yield f.path, f.modified, None, None, None, None, None
                    for i, name in chosen:
                        digest = content = None
                        if name.endswith(self.digest) if self.digest else False:
                            with z.open(infos[i]) as member:
                                digest = digest_of(member)
                        if name.endswith(self.content) if self.content else False:
                            content = z.read(infos[i])
                        yield f.path, f.modified, name, i, infos[i].file_size, digest, content
            except BROKEN:
                if not self.filters:
                    yield f.path, f.modified, None, None, None, None, None


def members(spark: SparkSession, path: str, wanted: str = "", content: str = "", digest: str = "", glob: str = "*.zip", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    spark.dataSource.register(MemberSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("zip_members").option("members", wanted).option("content", content).option("digest", digest)
    return reader.option("glob", glob).option("partition_bytes", partition_bytes).load(qualified(spark, path))


def digests(spark: SparkSession, path: str, glob: str = "*", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    spark.dataSource.register(DigestSource)
    return spark.read.format("file_digests").option("glob", glob).option("partition_bytes", partition_bytes).load(qualified(spark, path))
