"""Cleaning of ordered blocks. Windows are partitioned by document and ordered by position, so one exchange serves all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import clean_characters, clean_markdown, is_page_number, merge_broken_lines, strip


# How often a short line makes noise, and how long it may be.
LEAST = 3
LONGEST = 120


def repeated_noise(blocks: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """``file_id`` and ``noise``: short paragraphs and captions that occur at least ``least`` times in a document."""
    short = blocks.filter(F.col("block_type").isin("paragraph", "caption")).select("file_id", strip(F.col("content")).alias("noise"))
    return short.filter(F.length("noise").between(1, longest)).groupBy("file_id", "noise").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("file_id", "noise")


def drop_adjacent_duplicates(blocks: DataFrame, content: str = "content", document: str = "file_id", order: str = "block_idx") -> DataFrame:
    """Rows whose content equals that of the row before are dropped."""
    before = F.lag(content).over(Window.partitionBy(document).orderBy(order))
    return blocks.withColumn("_before", before).filter(~F.col(content).eqNullSafe(F.col("_before"))).drop("_before")


def clean_blocks(blocks: DataFrame) -> DataFrame:
    """PDF blocks (file_id, block_idx, block_type, content, ...): characters and broken lines mended; empty blocks, page
    numbers, noise (counted on the raw text) and adjacent repeats dropped, in this order.

    One exchange by document; each text is cleaned once. For the noise a row whose raw text isn't its cleaned one has a second
    entry, and a window over the document's entries of one text counts the raw ones."""
    row = F.struct(*(F.col(c) for c in blocks.columns if c not in ("file_id", "content"))).alias("row")
    noisy = F.col("block_type").isin("paragraph", "caption")
    plain = clean_characters(F.col("content"))
    merged = F.when(F.col("block_type").isin("paragraph", "list", "caption"), merge_broken_lines(plain)).otherwise(plain)
    short = F.when(noisy & F.length(strip(F.col("content"))).between(1, LONGEST), strip(F.col("content")))
    rows = blocks.repartition("file_id").select("file_id", row, merged.alias("content"), short.alias("raw"), noisy.alias("noisy"))
    entry = lambda kept, text, raw: F.struct(F.lit(kept).alias("kept"), text.alias("text"), raw.cast("int").alias("raw"))
    same = F.col("raw").isNull() | (F.col("raw") == F.col("content"))
    own = entry(True, F.col("content"), F.col("raw").isNotNull() & same)
    entries = rows.select("file_id", "row", "noisy", F.explode(F.when(same, F.array(own)).otherwise(F.array(own, entry(False, F.col("raw"), F.lit(True))))).alias("e"))
    counted = entries.select("file_id", "row", F.col("row.block_idx").alias("block_idx"), "noisy", "e.*")
    counted = counted.withColumn("n", F.sum("raw").over(Window.partitionBy("file_id", "text")))
    content = F.col("text")
    quiet = counted.filter("kept").filter((content != "") & ~is_page_number(content) & ~(F.col("noisy") & (F.col("n") >= LEAST)))
    before = F.lag("text").over(Window.partitionBy("file_id").orderBy("block_idx"))
    left = quiet.withColumn("before", before).filter(~content.eqNullSafe(F.col("before")))
    return left.select(*(content.alias(c) if c == "content" else F.col(c) if c == "file_id" else F.col("row")[c].alias(c) for c in blocks.columns))


def _islands(rows: DataFrame, starts, document: str, order: str) -> DataFrame:
    """Numbers runs of rows: a new run begins where ``starts`` is true."""
    w = Window.partitionBy(document).orderBy(order)
    return rows.withColumn("_run", F.sum(F.when(starts(w), 1).otherwise(0)).over(w))


def _with_text(elements: DataFrame, content: Column) -> DataFrame:
    """The rows with this content, without empty ones. No filter moves below a generator, so the content is made once."""
    return elements.withColumn("content", F.explode(F.filter(F.array(content), lambda c: c != "")))


def clean_word(elements: DataFrame) -> DataFrame:
    """Word elements (file_id, element_idx, element_type, level, content): consecutive paragraphs and list items become one
    paragraph; headings and tables stay."""
    rows = _with_text(elements, clean_characters(F.col("content")))
    text = lambda c: c.isin("paragraph", "list")

    def starts(w):
        return ~(text(F.col("element_type")) & F.coalesce(text(F.lag("element_type").over(w)), F.lit(False)))

    runs = _islands(rows, starts, "file_id", "element_idx")
    first = lambda c: F.min_by(c, "element_idx").alias(c)
    others = [c for c in elements.columns if c not in ("file_id", "element_idx", "element_type", "content")]
    grouped = runs.groupBy("file_id", "_run").agg(
        F.min("element_idx").alias("element_idx"), first("element_type"), *map(first, others),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("element_idx", "content"))), lambda x: x["content"]), "\n").alias("content"),
    )
    kind = F.when(F.col("element_type") == "list", "paragraph").otherwise(F.col("element_type"))
    return grouped.withColumn("element_type", kind).select(*elements.columns)


def clean_markdown_elements(elements: DataFrame) -> DataFrame:
    """Markdown elements (file_id, element_idx, element_type, content, heading_path, line_start, line_end, ...): adjacent
    paragraphs under the same heading path become one, apart by a blank line."""
    rows = _with_text(elements, clean_markdown(F.col("content"), F.col("element_type")))

    def starts(w):
        alike = (F.lag("element_type").over(w) == "paragraph") & F.lag("heading_path").over(w).eqNullSafe(F.col("heading_path"))
        return ~((F.col("element_type") == "paragraph") & F.coalesce(alike, F.lit(False)))

    runs = _islands(rows, starts, "file_id", "element_idx")
    others = [c for c in elements.columns if c not in ("file_id", "element_idx", "content", "line_end")]
    grouped = runs.groupBy("file_id", "_run").agg(
        F.min("element_idx").alias("element_idx"), *(F.min_by(c, "element_idx").alias(c) for c in others), F.max_by("line_end", "element_idx").alias("line_end"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("element_idx", "content"))), lambda x: x["content"]), "\n\n").alias("content"),
    )
    return grouped.select(*elements.columns)
