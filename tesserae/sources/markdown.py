"""Markdown texts as ordered elements.

``line_blocks`` is native: fences, ATX headings, table lines and text by windows over the lines. ``elements`` makes elements of
the blocks that ``commonmark.read`` finds outside any container, in one pass over the lines of each text: of a list the first text of
each item is shown, of a quote the texts of all that it holds.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.tables import is_caption
from tesserae.functions.text import LINE_BREAK, is_list_item, strip, uuid5_url
from tesserae.session import text_batches
from tesserae.sources import commonmark
from tesserae.sources.commonmark import Block

_IMAGE = re.compile(r"\s*!\[[^\]]*\]\([^)]+\)\s*")


def line_blocks(texts: DataFrame) -> DataFrame:
    """Blocks (file_id, block_idx, block_type, content, heading_level, block_id) of texts (file_id, text): the fallback for a
    parser's Markdown. Every table line is a block; an unclosed fence is text."""
    lines = texts.select("file_id", F.posexplode(F.split("text", LINE_BREAK)).alias("n", "line"))
    w = Window.partitionBy("file_id").orderBy("n")
    fence = F.col("line").startswith("```")
    marked = lines.withColumn("_fences", F.sum(F.when(fence, 1).otherwise(0)).over(w))
    in_code = (F.col("_fences") % 2 == 1) | fence
    closed = F.col("_fences") < F.max("_fences").over(Window.partitionBy("file_id")) + F.when(F.max("_fences").over(Window.partitionBy("file_id")) % 2 == 0, 1).otherwise(0)
    kind = F.when(in_code, F.when(closed, "code").otherwise("text")).when(F.col("line").startswith("#"), "heading").when(strip(F.col("line")).startswith("|"), "table").otherwise("text")
    typed = marked.withColumn("_kind", kind).withColumn("_pair", F.when(in_code, F.ceil(F.col("_fences") / 2)).otherwise(F.lit(-1)))
    before = lambda c: F.lag(c).over(w)
    new = (fence & (F.col("_fences") % 2 == 1)) | F.col("_kind").isin("heading", "table") | before("_kind").isNull() | (F.col("_kind") != before("_kind")) | ((F.col("_kind") == "code") & (F.col("_pair") != before("_pair")))
    runs = typed.withColumn("_new", F.when(new, 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w))
    grouped = runs.groupBy("file_id", "_run").agg(F.min("_kind").alias("_kind"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("raw"))
    level = F.when(F.col("_kind") == "heading", F.least(F.length(F.regexp_extract("raw", "^(#+)", 1)), F.lit(6)))
    content = F.when(F.col("_kind") == "heading", strip(F.regexp_replace("raw", "^#+", ""))).when(F.col("_kind") == "code", F.col("raw")).otherwise(strip(F.col("raw")))
    blocks = grouped.withColumns({"content": content, "heading_level": level}).filter((F.col("_kind") != "text") | (F.col("content") != ""))
    block_type = F.when(F.col("_kind") == "text", F.when(is_list_item(F.col("content")), "list").otherwise("paragraph")).otherwise(F.col("_kind"))
    index = (F.row_number().over(Window.partitionBy("file_id").orderBy("_run")) - 1).alias("block_idx")
    named = blocks.select("file_id", index, block_type.alias("block_type"), "content", "heading_level")
    return named.withColumn("block_id", uuid5_url(F.concat_ws(":", F.lit("md-block"), "block_idx", F.substring("content", 1, 80))))


def parse(text: str) -> Iterator[dict]:
    """Elements of a text: element_type, content, level, heading_path, heading_levels, language, ordered, table_rows, line_start, line_end."""
    path: list[tuple[int, str]] = []

    def element(block: Block, kind: str, content: str, **more) -> dict:
        return {"element_type": kind, "content": content, "level": None, "language": None, "ordered": False, "table_rows": None, "heading_path": [t for _, t in path], "heading_levels": [v for v, _ in path], "line_start": block.start + 1, "line_end": block.end} | more

    for block in commonmark.read(text):
        if block.kind == "heading":
            path = [p for p in path if p[0] < block.level] + [(block.level, block.text)]
            yield element(block, "heading", block.text, level=block.level)
        elif block.kind == "code":
            language = block.info.split()[0] if block.info else ""
            code = "\n".join(block.lines).rstrip("\n")
            yield element(block, "code", f"```{language}\n{code}\n```", language=language or None)
        elif block.kind == "table":
            rows = [r for r in block.lines if any(r)]
            if rows:
                shown = [f"| {' | '.join(r)} |" for r in rows]
                yield element(block, "table", "\n".join([shown[0], f"| {' | '.join(['---'] * len(rows[0]))} |", *shown[1:]]), table_rows=rows)
        elif block.kind == "list":
            if content := commonmark.rendered_list(block):
                yield element(block, "list", content, ordered=block.number is not None)
        elif block.kind == "quote":
            if content := commonmark.quoted(block):
                yield element(block, "blockquote", content)
        elif block.kind == "html":
            if content := html.unescape(block.text):
                yield element(block, "html", content)
        elif block.kind == "paragraph" and block.text:
            yield element(block, "image" if _IMAGE.fullmatch(block.text) else "paragraph", block.text)


FIELDS = (
    "file_id string, element_idx int, element_type string, content string, level int, heading_path array<string>, heading_levels array<int>, language string, ordered boolean, table_rows array<array<string>>, line_start int, line_end int"
)
_TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<array<string>>": pa.list_(pa.list_(pa.string()))}


def elements(texts: DataFrame) -> DataFrame:
    """Elements of Markdown texts (file_id, text), with table captions attached. A worker holds a few megabytes of texts and the elements of about
    ``GATHERED`` characters of them, or of one longer text."""
    text_batches(texts.sparkSession)
    return attach_captions(texts.select("file_id", "text").mapInArrow(_element_batches, FIELDS))


#: Characters of texts whose elements a worker gathers before it sends them.
GATHERED = 1 << 20


def _element_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [f.split(" ", 1) for f in FIELDS.split(", ")]

    def sent(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _TYPES[t]) for n, t in fields], names=[n for n, _ in fields])

    for batch in batches:
        rows, size = [], 0
        for file_id, text in zip(batch.column(0), batch.column(1)):  # one text at a time becomes a Python string
            text = text.as_py() or ""
            rows += [e | {"file_id": file_id.as_py(), "element_idx": i} for i, e in enumerate(parse(text))]
            size += len(text)
            if size >= GATHERED:
                yield sent(rows)
                rows, size = [], 0
        if rows:
            yield sent(rows)


def attach_captions(rows: DataFrame) -> DataFrame:
    """Tables take the caption of a paragraph just before them, else just after, under the same headings. A caption from after
    the table leaves the text; one from before stays in it too."""
    w = Window.partitionBy("file_id").orderBy("element_idx")
    fits = lambda at: (at("element_type") == "paragraph") & at("heading_path").eqNullSafe(F.col("heading_path")) & is_caption(at("content"), collapsed=True)
    before, after = (lambda c: F.lag(c).over(w)), (lambda c: F.lead(c).over(w))
    table = F.col("element_type") == "table"
    caption = F.when(table, F.when(fits(before), strip(before("content"))).when(fits(after), strip(after("content"))))
    from_after = table & fits(after) & ~F.coalesce(fits(before), F.lit(False))
    marked = rows.withColumns({"_caption": caption, "_from_after": F.coalesce(from_after, F.lit(False))})
    content = F.when(F.col("_caption").isNotNull(), F.concat(F.lit("Table caption: "), "_caption", F.lit("\n\n"), "content")).otherwise(F.col("content"))
    taken = F.coalesce(F.lag("_from_after").over(w), F.lit(False))
    return marked.withColumns({"content": content, "_taken": taken}).filter(~F.col("_taken")).drop("_caption", "_from_after", "_taken")
