"""A layout parser's items (JSON) as ordered blocks: flat rows first, then native rules for content, type, page and level."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.tables import described_table, html_flat, rows_as_records
from tesserae.functions.text import is_list_item, strip, uuid5_url
from tesserae.operators.headings import NUMBERED
from tesserae.sources.files import items_of

ITEM = (
    "file_id string, item_idx int, type string, text string, content string, html string, latex string, caption string, img_caption array<string>, table string, table_rows array<array<string>>, "
    "captions array<string>, notes array<string>, text_level int, page_number string, page string, page_idx string, bbox array<double>, image_path string"
)
_KINDS = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()), "array<array<string>>": pa.list_(pa.list_(pa.string()))}
# Names under which a table's captions and notes come.
CAPTIONS, NOTES, BODIES = ("table_caption", "caption", "table_title", "title"), ("table_footnote", "footnote", "note"), ("table_body", "table", "html", "content")


def _text(value) -> str | None:
    return None if value in (None, "", [], {}) else value if isinstance(value, str) else str(value)


def _strings(value) -> list[str]:
    return [value] if isinstance(value, str) else [s for v in value for s in _strings(v)] if isinstance(value, list) else []


def _row(file_id: str, n: int, item: dict) -> dict:
    body = next((item[k] for k in BODIES if item.get(k)), None)
    box = item.get("bbox") or item.get("poly")
    caption = item.get("img_caption")
    level = item.get("text_level")
    return {
        "file_id": file_id, "item_idx": n, "type": _text(item.get("type") or item.get("category") or item.get("block_type")) or "text",
        **{k: _text(item.get(k)) for k in ("text", "content", "html", "latex", "caption", "page_number", "page", "page_idx")},
        "page_idx": None if item.get("page_idx") is None else str(item["page_idx"]),
        "img_caption": [str(c) for c in caption] if isinstance(caption, list) else [str(caption)] if caption else None,
        "table": None if isinstance(body, list) else _text(body) if item.get("table_body") or item.get("table") or str(item.get("type") or item.get("category") or "").lower() == "table" else None,
        "table_rows": [[str(c) for c in r] for r in body if isinstance(r, list)] if isinstance(body, list) else None,
        "captions": [s for k in CAPTIONS for s in _strings(item.get(k))], "notes": [s for k in NOTES for s in _strings(item.get(k))],
        "text_level": int(level) if level else None, "bbox": [float(x) for x in box] if isinstance(box, list) and all(isinstance(x, (int, float)) for x in box) else None,
        "image_path": _text(item.get("img_path") or item.get("image_path")),
    }


def items(artifacts: DataFrame) -> DataFrame:
    """Flat items of artifacts (file_id, json)."""
    fields = [f.split(" ", 1) for f in ITEM.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file_id, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
                try:
                    rows += [_row(file_id, n, item) for n, item in enumerate(items_of(text or "[]"))]
                except json.JSONDecodeError:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _KINDS[t]) for n, t in fields], names=[n for n, _ in fields])

    return artifacts.select("file_id", "json").mapInArrow(run, ITEM)


def page_of(page_number: Column, page: Column, page_idx: Column) -> Column:
    """The first of the three that is set and not zero, plus one wherever ``page_idx`` is there at all; null if it is no number."""
    usable = lambda c: F.when(~F.coalesce(c, F.lit("")).isin("", "0"), c)
    value = F.coalesce(usable(page_number), usable(page), page_idx)
    return value.try_cast("int") + F.when(page_idx.isNotNull(), 1).otherwise(0)


def block_type(kind: Column, text_level: Column, content: Column) -> Column:
    k = F.lower(kind)
    return (
        F.when(k == "title", "title").when(text_level.isNotNull() | k.isin("heading", "header"), "heading").when((k == "table") | content.startswith("|"), "table").when(k.isin("image", "figure"), "image")
        .when(k.isin("caption", "figure_caption", "table_caption"), "caption").when(k.isin("equation", "formula"), "formula").when(k.isin("code", "code_block"), "code").when(is_list_item(content), "list").otherwise("paragraph")
    )


def block_id(index: Column, content: Column) -> Column:
    return uuid5_url(F.concat_ws(":", F.lit("pdf-block"), index, F.substring(content, 1, 80)))


def blocks(rows: DataFrame) -> DataFrame:
    """Blocks (file_id, block_idx, block_type, content, page_number, heading_level, block_id, ...) of items; those without content go."""
    is_table = (F.lower("type") == "table") | F.col("table").isNotNull() | F.col("table_rows").isNotNull()
    table = described_table(F.col("captions"), F.coalesce("table", F.when(F.col("table_rows").isNotNull(), rows_as_records(F.col("table_rows"))), F.lit("")), F.col("notes"))
    pictures = F.array_join(F.filter(F.transform("img_caption", strip), lambda x: x != ""), " ")
    content = F.when(is_table, table).otherwise(F.coalesce(strip(F.col("text")), strip(F.col("content")), html_flat(F.col("html")), strip(F.col("caption")), pictures, strip(F.col("latex")), F.lit("")))
    kept = rows.withColumn("content", content).filter("content <> ''")
    number = F.regexp_extract("content", NUMBERED, 1)
    typed = kept.withColumn("block_type", block_type(F.col("type"), F.col("text_level"), F.col("content")))
    level = F.when(F.col("block_type") == "heading", F.when(number != "", F.least(F.size(F.split(number, r"\.")) + 1, F.lit(6))).otherwise(F.coalesce("text_level", F.lit(1))))
    index = (F.row_number().over(Window.partitionBy("file_id").orderBy("item_idx")) - 1).alias("block_idx")
    done = typed.select("file_id", index, "block_type", "content", page_of(F.col("page_number"), F.col("page"), F.col("page_idx")).alias("page_number"), level.alias("heading_level"), F.col("type").alias("raw_type"), "bbox", "image_path")
    return done.withColumn("block_id", block_id(F.col("block_idx"), F.col("content")))
