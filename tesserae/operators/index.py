"""The chunk index: flat rows keyed by chunk id, in buckets by a hash of the key.

``_log`` holds a manifest for each version: the base folder of every bucket, and the upserts since, with their rows per bucket. An upsert
writes its own rows only; a reader takes the base rows whose keys no later upsert has, and of the upserts the last row of each
key. Where upserts come to more than ``COMPACT`` of the base, the buckets that they touch (and no others) are written anew; where
there are many small ones, they are made one. A version is published by creating its manifest, which fails if it is there: of two writers the
second takes up the first's version and tries again, so neither is lost. A failed write leaves nothing that is read.
Upserts never delete: rows with other keys stay.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Any
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tesserae.operators.skew import anti_join

#: Declared lengths of the stored texts, in bytes.
LIMITS = {"id": 64, "text": 8192, "file_name": 512, "file_type": 32, "chapter": 512, "section": 512, "content_hash": 64}


def index_rows(unified: DataFrame) -> DataFrame:
    """Unified chunks with ``vector`` as index rows: flat fields, and the whole metadata as JSON."""
    m = lambda path: F.col(f"metadata.{path}")
    pages, span = m("source.page_numbers"), m("source.line_range")
    return unified.select(
        F.col("chunk_id").alias("id"), "vector", "text", *(m(f"document.{n}").alias(n) for n in ("file_name", "file_type")),
        *(m(f"structure.{n}").alias(n) for n in ("chapter", "section", "heading")), F.array_join(m("structure.heading_path"), " > ").alias("heading_path"),
        "chunk_index", "content_hash", "token_count", F.get(pages, F.lit(0)).alias("page_number"), F.array_join(pages.cast("array<string>"), ",").alias("page_numbers"),
        F.get(span, F.lit(0)).alias("line_start"), F.try_element_at(span, F.lit(-1)).alias("line_end"), F.array_join(m("content.types"), ",").alias("block_type"),
        *(m(f"processing.{n}").alias(n) for n in ("parser", "language", "create_time")), m("source.source_path").alias("source_path"), F.to_json("metadata").alias("metadata_json"),
    )


def oversize(rows: DataFrame) -> Column:
    """Names of the fields that exceed their declared length."""
    return F.array_compact(F.array(*(F.when(F.octet_length(name) > n, F.lit(name)) for name, n in LIMITS.items() if name in rows.columns)))


def checked(rows: DataFrame, dimension: int | None) -> DataFrame:
    """``rows`` that fail when they are read, if a vector hasn't got ``dimension`` components or a text exceeds its declared length."""
    long = oversize(rows)
    problem = F.when(F.size(long) > 0, F.concat(F.lit("too long for the index: "), F.array_join(long, ", "), F.lit(" of "), F.col("id")))
    if dimension is not None:
        problem = F.when(F.coalesce(F.size("vector"), F.lit(-1)) != dimension, F.concat(F.lit(f"a vector of other than {dimension} components: "), F.col("id"))).otherwise(problem)
    return rows.withColumn("id", F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(F.col("id")))


def latest(rows: DataFrame, key: str | list[str], order: Column) -> DataFrame:
    """One row per key (one column or several): the last by ``order``."""
    w = Window.partitionBy(key).orderBy(order.desc())
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def upserted(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``new`` in place of the rows of ``existing`` with the same key. ``new`` must hold each key once (see ``latest``)."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


#: Buckets of a new index, and the share of the base from which upserts are merged into it; upserts that are kept apart at most.
BUCKETS, COMPACT, PARTS = 64, 0.25, 16


@dataclass
class Manifest:
    """``base``: folder and rows of each bucket. ``upserts``: in order, the folder of each with its rows by bucket."""

    key: str
    buckets: int
    schema: dict[str, Any]
    dimension: int | None = None
    base: dict[str, tuple[str, int]] = field(default_factory=dict)
    upserts: list[tuple[str, dict[str, int]]] = field(default_factory=list)


def _joined(a: StructType, b: StructType) -> StructType:
    """The fields of both; one that both have must have one type."""
    for f in b.fields:
        if f.name in a.names and a[f.name].dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"the index has {f.name} as {a[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
    return StructType([*a.fields, *(f for f in b.fields if f.name not in a.names)])


class Index:
    """A table at ``path``, on any file system that Spark knows, with one row per key. Any number of writers may upsert."""

    HOMED = True  # a key names its bucket

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(self.path).getFileSystem(self._conf)

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def version(self) -> int | None:
        """The number of the last version."""
        if not self._fs.exists(self._at("_log")):
            return None
        names = (s.getPath().getName() for s in self._fs.listStatus(self._at("_log")))
        return max((int(n.partition(".")[0]) for n in names if n.endswith(".json") and not n.startswith(".")), default=None)

    def manifest(self, version: int | None = None) -> Manifest | None:
        number = self.version() if version is None else version
        if number is None:
            return None
        stream = self._fs.open(self._at(f"_log/{number:020d}.json"))
        try:
            return Manifest(**json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _published(self, number: int, manifest: Manifest) -> bool:
        """Whether the manifest became version ``number``: not if there is one already."""
        draft, final = self._at(f"_log/.{uuid.uuid4().hex}"), self._at(f"_log/{number:020d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        out.close()
        local = urlparse(str(self._fs.makeQualified(final).toUri()))
        try:
            if local.scheme == "file":  # its rename replaces files; a link doesn't
                os.link(urlparse(str(self._fs.makeQualified(draft).toUri())).path, local.path)
            else:
                context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
                none = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
                context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(final), none)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception.getClass().getName()):
                raise
            return False
        finally:
            self._fs.delete(draft, False)

    def _commit(self, change: Callable[[Manifest | None], Manifest | None]) -> int | None:
        """Publishes what ``change`` makes of the last version, again if another writer came first. The version; None if there is no change."""
        while True:
            last = self.version()
            made = change(None if last is None else self.manifest(last))
            if made is None:
                return None
            if self._published((last or 0) + 1, made):
                return (last or 0) + 1

    def exists(self) -> bool:
        return self.version() is not None

    def _rows(self, folders: list[str], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def _read(self, m: Manifest, buckets: set[str] | None = None) -> DataFrame:
        """The rows of a version (of some buckets)."""
        schema = StructType.fromJson(m.schema)
        wanted = lambda b: buckets is None or b in buckets
        touched = {b for _, rows in m.upserts for b in rows if wanted(b)}
        still = [f for b, (f, _) in m.base.items() if wanted(b) and b not in touched]
        parts = [self._rows(still, schema)] if still else []
        if touched:
            parts += self._merged(m, touched)
        out = parts[0] if parts else self.spark.createDataFrame([], schema)
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _merged(self, m: Manifest, touched: set[str]) -> list[DataFrame]:
        """The last row of each key in the upserts, and the base rows of other keys, in some buckets. Base rows stay where they are read: only those
        that a filter of the upserts' keys lets pass are exchanged."""
        schema = StructType.fromJson(m.schema)
        newest, under = self._upserted(m, touched), [f for b, (f, _) in m.base.items() if b in touched]
        return [newest, anti_join(self._rows(under, schema), [F.col(m.key)], newest.select(m.key))] if under else [newest]

    def _upserted(self, m: Manifest, touched: set[str]) -> DataFrame:
        """The last row of each key in the upserts."""
        schema = StructType.fromJson(m.schema)
        each = [self._rows([f"{folder}/_b={b}" for b in rows if b in touched], schema).withColumn("_at", F.lit(i)) for i, (folder, rows) in enumerate(m.upserts) if touched & set(rows)]
        rows = each[0]
        for more in each[1:]:
            rows = rows.unionByName(more)
        return (latest(rows, m.key, F.col("_at")) if len(each) > 1 else rows).drop("_at")

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if m is None:
            raise LookupError(f"there is no index at {self.path}")
        return self._read(m)

    def bucket_of(self, key: str, buckets: int | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets or self.buckets)).cast("int")

    def dimension(self) -> int | None:
        """Components of the stored vectors; null without an index, or without vectors."""
        m = self.manifest()
        return m.dimension if m else None

    def _dealt(self, rows: DataFrame, key: str, buckets: int) -> DataFrame:
        """The rows by bucket (``_b``) and slice of it (``_s``): the one exchange of a write. What follows by bucket, slice and key needs no other."""
        slices = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // buckets)
        part = F.pmod(F.xxhash64(F.lit("slice"), F.col(key).cast("string")), F.lit(slices)).cast("int")
        return rows.withColumns({"_b": self.bucket_of(key, buckets), "_s": part}).repartition("_b", "_s")

    def _write(self, dealt: DataFrame) -> tuple[str, dict[str, int]]:
        """Writes dealt rows by bucket; the folder, and the rows of each bucket. ``dealt`` is evaluated once."""
        folder = f"data/{uuid.uuid4().hex}"
        dealt.drop("_s").write.partitionBy("_b").parquet(f"{self.path}/{folder}")
        found = self.spark.read.schema("_b int").option("basePath", f"{self.path}/{folder}").parquet(f"{self.path}/{folder}")
        return folder, {str(r["_b"]): r["count"] for r in found.groupBy("_b").count().collect()}  # a row for each bucket

    def upsert(self, rows: DataFrame, key: str = "id", create: bool = True, order: Column | None = None) -> int:
        """Writes the rows; the number written. No rows: nothing is written. Of rows with one key the last by ``order`` counts, or
        without one that with the largest hash of its columns: the same whatever order rows come in. Rows with vectors must
        agree in their components, with the index too, and fit the declared lengths; a key must not be null; else nothing is
        written. The input is evaluated once, however dear it is, and the rows of the index aren't read."""
        m = self.manifest()
        if m is not None and m.key != key:
            raise ValueError(f"the key of this index is {m.key}")
        vectors = "vector" in rows.columns and key == "id"
        buckets = m.buckets if m else self.buckets
        ranking = order if order is not None else F.xxhash64(*rows.columns)
        ranked = latest(self._dealt(rows, key, buckets), ["_b", "_s", key], ranking) if self.HOMED else self._dealt(latest(rows, key, ranking), key, buckets)
        named = F.when(F.col(key).isNull(), F.raise_error(F.lit("a key of the index is null"))).otherwise(F.col(key))
        batch = (checked(ranked, m.dimension if m else None) if vectors else ranked).withColumn(key, named.cast(rows.schema[key].dataType))
        folder, counts = self._write(batch.select(*rows.columns, "_b", "_s"))
        try:
            size = sum(counts.values())
            if not size:
                self._fs.delete(self._at(folder), True)
                return 0
            if m is None and not create:
                raise LookupError(f"there is no index at {self.path}, and it may not be created")
            known = self._dimension_of(folder, rows.schema) if vectors else None

            def change(last: Manifest | None) -> Manifest:
                last = last or Manifest(key, buckets, rows.schema.jsonValue())
                if last.buckets != buckets or known is not None and last.dimension not in (None, known):
                    raise ValueError(f"the index at {self.path} was made with another number of buckets or vectors of other than {known} components")
                schema = _joined(StructType.fromJson(last.schema), StructType.fromJson(rows.schema.jsonValue()))
                made = Manifest(key, buckets, schema.jsonValue(), known if last.dimension is None else last.dimension, dict(last.base), list(last.upserts))
                if made.base or made.upserts:
                    made.upserts.append((folder, counts))
                else:
                    made.base = {b: (f"{folder}/_b={b}", n) for b, n in counts.items()}
                return made

            self._commit(change)
        except BaseException:
            self._fs.delete(self._at(folder), True)
            raise
        self._tidy()
        return size

    def _dimension_of(self, folder: str, schema: StructType) -> int | None:
        n = F.coalesce(F.size("vector"), F.lit(-1))
        least, most = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}").agg(F.min(n), F.max(n)).first()
        if least != most:
            raise ValueError(f"the vectors of one index must have the same number of components, not {least} and {most}")
        return None if most < 0 else most

    def _tidy(self) -> None:
        m = self.manifest()
        late, base = sum(sum(rows.values()) for _, rows in m.upserts), sum(n for _, n in m.base.values())
        if late > COMPACT * base:
            self.compact()
        elif len(m.upserts) > PARTS:
            self.compact(base=False)

    def compact(self, base: bool = True) -> bool:
        """Merges the upserts so far into the buckets that they touch, or (not ``base``) into one upsert. Upserts that come meanwhile stay as
        they are. Whether it was published: not if another writer has merged them."""
        m = self.manifest()
        if m is None or not m.upserts:
            return False
        merged = [f for f, _ in m.upserts]
        touched = {b for _, rows in m.upserts for b in rows}
        if base:  # files hold a bucket each, so rows are written from where they are read
            merged_rows = reduce(DataFrame.unionByName, self._merged(m, touched)).withColumn("_b", self.bucket_of(m.key, m.buckets))
        else:
            merged_rows = self._dealt(self._upserted(m, touched), m.key, m.buckets)
        folder, counts = self._write(merged_rows)

        def change(last: Manifest | None) -> Manifest | None:
            if last is None or [f for f, _ in last.upserts][: len(merged)] != merged:
                return None
            rest = [tuple(u) for u in last.upserts[len(merged) :]]
            if base:
                rewritten = {b: (f"{folder}/_b={b}", n) for b, n in counts.items()}
                return Manifest(last.key, last.buckets, last.schema, last.dimension, {**last.base, **rewritten}, rest)
            return Manifest(last.key, last.buckets, last.schema, last.dimension, last.base, [(folder, counts), *rest])

        if self._commit(change) is None:
            self._fs.delete(self._at(folder), True)
            return False
        return True

    def vacuum(self, keep_seconds: float = 7 * 86_400) -> int:
        """Deletes folders that the last version doesn't name, and manifests before it, if they are older than ``keep_seconds``: longer than any
        reader or writer takes. How many folders went."""
        last = self.version()
        if last is None:
            return 0
        m, before, gone = self.manifest(last), (time.time() - keep_seconds) * 1000, 0
        used = {f.split("/")[1] for f, _ in [*m.base.values(), *m.upserts]}
        for status in self._fs.listStatus(self._at("data")):
            if status.getPath().getName() not in used and status.getModificationTime() < before:
                gone += bool(self._fs.delete(status.getPath(), True))
        for status in self._fs.listStatus(self._at("_log")):
            name = status.getPath().getName()
            if name.endswith(".json") and int(name.partition(".")[0]) < last and status.getModificationTime() < before:
                self._fs.delete(status.getPath(), False)
        return gone
