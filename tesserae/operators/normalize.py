"""One nested schema for the chunks of all parsers, by one projection.

The first value that is not null wins; empty strings and empty lists count as values. A string where a list is wanted is
a list of that string, uncut; an empty one is an empty list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

UNIFIED = (
    "chunk_id string, chunk_index int, text string, token_count int, content_hash string, metadata struct<"
    "document:struct<file_id:string,file_name:string,file_type:string>,"
    "structure:struct<heading_path:array<string>,chapter:string,section:string,heading:string>,"
    "source:struct<source_path:string,page_numbers:array<int>,line_range:array<int>>,"
    "content:struct<types:array<string>>,"
    "processing:struct<parser:string,language:string,create_time:string>>"
)
_PLACES = {"document": "document", "structure": "structure", "source": "source", "content": "content", "processing": "processing"}


class _Fields:
    """Finds fields that a table may or may not have: nested in the metadata, in the metadata, at the top."""

    def __init__(self, chunks: DataFrame):
        self.top = {f.name: f.dataType for f in chunks.schema.fields}
        meta = self.top.get("metadata")
        self.meta = {f.name: f.dataType for f in meta.fields} if isinstance(meta, StructType) else {}

    def find(self, group: str | None, name: str, top: bool = True) -> list[tuple[Column, object]]:
        found = []
        inner = self.meta.get(group) if group else None
        if isinstance(inner, StructType) and name in inner.names:
            found.append((F.col(f"metadata.{group}.{name}"), inner[name].dataType))
        if name in self.meta and not isinstance(self.meta[name], StructType):
            found.append((F.col(f"metadata.{name}"), self.meta[name]))
        if top and name in self.top:
            found.append((F.col(name), self.top[name]))
        return found

    def text(self, group: str | None, name: str, top: bool = True, default: Column | None = None) -> Column:
        values = [c.cast("string") for c, _ in self.find(group, name, top)]
        return F.coalesce(*values, *([default] if default is not None else []), F.lit(""))

    def items(self, places: list[tuple[Column, object]], item: str) -> Column:
        """The first value as a list without nulls and empty strings; null where there is no value."""
        lists = []
        for c, kind in places:
            if isinstance(kind, ArrayType):
                lists.append(F.filter(c.cast(f"array<{item}>"), lambda x: x.isNotNull() & (x.cast("string") != "")))
            else:
                lists.append(F.when(c.isNotNull(), F.when(c.cast("string") == "", F.array().cast(f"array<{item}>")).otherwise(F.array(c.cast(item)))))
        return F.coalesce(*lists) if lists else F.lit(None).cast(f"array<{item}>")


def normalize(chunks: DataFrame, file_type: str | None = None) -> DataFrame:
    """Chunks of any parser (fields at the top, in ``metadata``, or nested already) in the unified schema: as many rows, in no
    other order, with texts untouched. ``file_type`` fills in where the chunks name none."""
    f = _Fields(chunks)
    none = lambda item: F.array().cast(f"array<{item}>")
    ends = F.array_compact(F.array(*(F.coalesce(*(c.cast("int") for c, _ in f.find("source", n)), F.lit(None).cast("int")) for n in ("line_start", "line_end"))))
    types = [*f.find("content", "types"), *f.find(None, "block_types"), *f.find(None, "block_type")]
    number = lambda name, default: F.coalesce(*(c.cast("int") for c, _ in f.find(None, name)[-1:]), default)
    top = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")) if name in f.top else F.lit("")
    document = F.struct(*(f.text("document", n).alias(n) for n in ("file_id", "file_name")), f.text("document", "file_type", default=F.lit(file_type) if file_type else None).alias("file_type"))
    structure = F.struct(F.coalesce(f.items(f.find("structure", "heading_path"), "string"), none("string")).alias("heading_path"), *(f.text("structure", n, top=False).alias(n) for n in ("chapter", "section", "heading")))
    source = F.struct(
        f.text("source", "source_path").alias("source_path"),
        F.coalesce(f.items(f.find("source", "page_numbers"), "int"), f.items(f.find("source", "page_number"), "int"), none("int")).alias("page_numbers"),
        F.coalesce(f.items(f.find("source", "line_range"), "int"), ends).alias("line_range"),
    )
    content = F.struct(F.coalesce(f.items(types, "string"), none("string")).alias("types"))
    processing = F.struct(*(f.text("processing", n, top=False).alias(n) for n in ("parser", "language", "create_time")))
    return chunks.select(
        top("chunk_id").alias("chunk_id"), number("chunk_index", F.lit(None).cast("int")).alias("chunk_index"), top("text").alias("text"),
        number("token_count", F.lit(0)).alias("token_count"), top("content_hash").alias("content_hash"),
        F.struct(document.alias("document"), structure.alias("structure"), source.alias("source"), content.alias("content"), processing.alias("processing")).alias("metadata"),
    )
