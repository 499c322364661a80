"""Review of chunks: overlay of human edits, pages, heading tree, quality issues and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.tables import described_table, rows_as_lines, table_text
from tesserae.functions.text import strip
from tesserae.sources.items import BODIES, CAPTIONS, NOTES

STATUSES = ("PENDING", "APPROVED", "REJECTED", "MODIFIED")
REQUIRED = ("chapter", "section", "page_number")
LARGE, SHORT, PAGE_GAP = 1000, 50, 5
ERROR_COST, WARNING_COST = 15, 5


def valid_status(status: str) -> str:
    if status not in STATUSES:
        raise ValueError(f"unsupported review status: {status}")
    return status


def merge_maps(low: Column, high: Column) -> Column:
    """Both maps; entries of ``high`` win."""
    low, high = (F.coalesce(m, F.create_map().cast("map<string,string>")) for m in (low, high))
    return F.map_concat(F.map_filter(low, lambda k, v: ~F.map_contains_key(high, k)), high)


def overlay(chunks: DataFrame, state: DataFrame) -> DataFrame:
    """Chunks (chunk_id, text, metadata map, ...) left-joined with the review state (chunk_id, review_status, review_comment,
    text, metadata, updated_time). An edited text that isn't empty wins; token counts and hashes stay as they were."""
    s = state.select("chunk_id", *(F.col(c).alias(f"_{c}") for c in ("review_status", "review_comment", "text", "metadata", "updated_time")))
    return (
        chunks.join(s, "chunk_id", "left")
        .withColumns({
            "text": F.coalesce(F.nullif("_text", F.lit("")), F.col("text"), F.lit("")),
            "metadata": merge_maps(F.col("metadata"), F.col("_metadata")),
            "review_status": F.coalesce("_review_status", F.lit("PENDING")),
            "review_comment": F.coalesce("_review_comment", F.lit("")),
            "updated_time": F.col("_updated_time"),
        })
        .drop("_review_status", "_review_comment", "_text", "_metadata", "_updated_time")
    )


def page_count(chunks: DataFrame, document: str = "file_id") -> DataFrame:
    """The largest page of each document's chunks (page_numbers, page_number); 0 without any."""
    page = F.greatest(F.array_max("page_numbers"), F.col("page_number"))
    return chunks.groupBy(document).agg(F.coalesce(F.max(page), F.lit(0)).alias("page_count"), F.count("*").alias("chunk_count"))


def pages_of_blocks(blocks: DataFrame, document: str = "file_id", order: str = "block_idx") -> DataFrame:
    """Blocks by page (none: page 0), in order."""
    return blocks.withColumn("page", F.coalesce("page_number", F.lit(0))).groupBy(document, "page").agg(F.sort_array(F.collect_list(F.struct(order, "block_type", "content"))).alias("blocks"))


def pages_of_chunks(chunks: DataFrame, document: str = "file_id") -> DataFrame:
    """Chunks by each of their pages; without any they are on page_number, or page 0."""
    pages = F.when(F.size("page_numbers") > 0, F.col("page_numbers")).otherwise(F.array(F.coalesce("page_number", F.lit(0))))
    return chunks.withColumn("page", F.explode(pages)).groupBy(document, "page").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_id", "text"))).alias("chunks"))


def pages_of_either(of_blocks: DataFrame, of_chunks: DataFrame, document: str = "file_id") -> DataFrame:
    """``document``, ``page``, and ``blocks`` or ``chunks``: a document with pages of blocks shows those, any other its chunks'."""
    has = of_blocks.select(document).distinct()
    return of_blocks.unionByName(of_chunks.join(has, document, "left_anti"), allowMissingColumns=True)


def heading_tree(chunks: DataFrame, document: str = "file_id") -> DataFrame:
    """Nodes of the heading tree as rows (``path``, ``parent``, ``label``, ``node_type``, ``page_number``, ``chunk_id``): a node for every prefix of
    a chunk's heading (cut at ">"), with the page of the first chunk below it, and a leaf for each chunk. ``node_id`` is
    shared by headings of one label, ``path`` is not."""
    parts = F.filter(F.transform(F.split(F.coalesce("heading", F.lit("")), ">"), strip), lambda x: x != "")
    rows = chunks.withColumn("_parts", parts)
    prefixes = rows.filter(F.size("_parts") > 0).select(document, "chunk_index", "page_number", F.explode(F.transform(F.sequence(F.lit(1), F.size("_parts")), lambda n: F.slice("_parts", F.lit(1), n))).alias("path"))
    headings = prefixes.groupBy(document, "path").agg(F.min_by("page_number", "chunk_index").alias("page_number"))
    headings = headings.select(document, "path", F.slice("path", F.lit(1), F.size("path") - 1).alias("parent"), F.element_at("path", -1).alias("label"), F.lit("heading").alias("node_type"), "page_number", F.lit(None).cast("string").alias("chunk_id"))
    leaf = F.concat(F.lit("Chunk "), F.col("chunk_index").cast("string"))
    leaves = rows.select(document, F.concat("_parts", F.array(leaf)).alias("path"), F.col("_parts").alias("parent"), leaf.alias("label"), F.lit("chunk").alias("node_type"), "page_number", "chunk_id")
    node = F.sha1(F.concat_ws(":", "node_type", "label", F.coalesce("chunk_id", F.lit("None"))))
    return headings.unionByName(leaves).withColumn("node_id", node)


def quality_issues(chunks: DataFrame, document: str = "file_id") -> DataFrame:
    """Issues of chunks (chunk_id, chunk_index, text, token_count, chapter, section, page_number, page_numbers, heading,
    content_hash as the metadata has it, null if it has none)."""
    known = F.coalesce(F.col("content_hash"), F.lit("")) != ""
    again = F.row_number().over(Window.partitionBy(document, "content_hash").orderBy("chunk_index"))
    rows = chunks.withColumn("_again", F.when(known, again))
    issue = lambda when, severity, code, message: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(message).alias("message")))
    pages = F.filter("page_numbers", lambda p: p.isNotNull() & (p != 0))
    bare = strip(F.replace("text", F.replace(F.col("heading"), F.lit(" > "), F.lit("\n")), F.lit("")))
    missing = [issue(F.coalesce(F.col(k).cast("string"), F.lit("")) == "", "ERROR", "METADATA_MISSING", f"Missing metadata field: {k}.") for k in REQUIRED]
    found = F.array(
        issue(F.col("token_count") > LARGE, "WARNING", "CHUNK_TOO_LARGE", f"Chunk token_count > {LARGE}."),
        issue(F.col("token_count") < SHORT, "WARNING", "CHUNK_TOO_SHORT", f"Chunk token_count < {SHORT}."),
        *missing,
        issue((F.size("page_numbers") >= 2) & (F.array_max(pages) - F.array_min(pages) > PAGE_GAP), "WARNING", "PAGE_JUMP", "Chunk spans distant pages."),
        issue((F.coalesce("heading", F.lit("")) != "") & (bare == ""), "WARNING", "ORPHAN_HEADING", "Heading has no body content."),
        issue(F.col("_again") > 1, "WARNING", "DUPLICATE_CONTENT", "Duplicate chunk content hash."),
    )
    exploded = rows.select(document, "chunk_id", "chunk_index", "page_number", F.explode(F.array_compact(found)).alias("i"))
    return exploded.select(document, F.sha1(F.concat_ws(":", "chunk_id", "i.code")).alias("issue_id"), "i.severity", "i.code", "i.message", "chunk_id", "chunk_index", "page_number")


def quality_report(chunks: DataFrame, document: str = "file_id") -> DataFrame:
    """Counts of chunks, errors and warnings, and the score: 100 less 15 for each error and 5 for each warning, at least 0."""
    counts = quality_issues(chunks, document).groupBy(document).agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARNING").alias("warnings"))
    rows = chunks.groupBy(document).agg(F.count("*").alias("chunk_count")).join(counts, document, "left").fillna(0, ["errors", "warnings"])
    return rows.withColumn("score", F.greatest(F.lit(0), 100 - ERROR_COST * F.col("errors") - WARNING_COST * F.col("warnings")))


# Keys of a parser's item whose texts are its content, in this order.
CONTENT = ("text", "content", "table_body", "image_caption", "image_footnote", "chart_caption", "chart_footnote", "table_caption", "table_footnote")


def parser_items(artifacts: DataFrame) -> DataFrame:
    """The items of content lists (document_id, json) as ``review_blocks`` takes them: texts under the nine keys in order, and of
    tables ``table``, their described text. JSON that can't be read, or is no list, has no items."""
    found = artifacts.select("document_id", F.posexplode(F.try_variant_get(F.try_parse_json("json"), "$", "array<variant>")).alias("item_idx", "v"))
    at = lambda key, kind: F.try_variant_get("v", f"$.{key}", kind)
    is_a = lambda value, kind: F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))
    string = lambda value: F.try_variant_get(value, "$", "string")
    # A part of a list counts if it is a text that isn't empty, or another value that isn't zero, false or empty.
    counts = lambda p: F.coalesce(F.when(is_a(p, "STRING"), string(p) != "").otherwise(~string(p).isin("0", "0.0", "false", "[]", "{}")), F.lit(False))
    parts = lambda key: F.transform(F.filter(at(key, "array<variant>"), counts), string)
    texts = lambda key: F.coalesce(F.when(is_a(at(key, "variant"), "STRING"), F.array(at(key, "string"))).when(is_a(at(key, "variant"), "ARRAY"), parts(key)), F.array().cast("array<string>"))
    body = lambda key: F.when(is_a(at(key, "variant"), "STRING"), table_text(F.nullif(at(key, "string"), F.lit("")))).when(is_a(at(key, "variant"), "ARRAY") & (F.size(at(key, "array<variant>")) > 0), rows_as_lines(at(key, "array<array<string>>")))
    gathered = lambda keys: F.flatten(F.array(*map(texts, keys)))
    table = described_table(gathered(CAPTIONS), F.coalesce(*map(body, BODIES), F.lit("")), gathered(NOTES))
    return found.select(
        "document_id", "item_idx", at("type", "string").alias("type"), at("text_level", "int").alias("text_level"), at("level", "int").alias("level"), at("page_idx", "int").alias("page_idx"), at("bbox", "array<double>").alias("bbox"),
        gathered(CONTENT).alias("texts"), F.when(at("type", "string") == "table", table).alias("table"),
    )


def review_blocks(items: DataFrame) -> DataFrame:
    """Parser items (document_id, item_idx, type, text_level, page_idx, bbox, texts: the texts of the item in order; and perhaps level and
    ``table``, which is a table's content) as review blocks; page numbers and items without text are left out."""
    kind = F.coalesce(F.nullif("type", F.lit("")), F.lit("paragraph"))
    block_type = (
        F.when(kind.isin("title", "heading") | (F.coalesce("text_level", F.lit(0)) != 0), "heading").when(kind.isin("image", "chart"), "image").when(kind == "equation", "formula")
        .when(kind.isin("table", "ref_text", "page_footnote", "aside_text"), kind).otherwise("paragraph")
    )
    content = F.array_join(F.filter(F.transform("texts", strip), lambda x: x != ""), "\n")
    if "table" in items.columns:
        content = F.when(kind == "table", F.coalesce("table", F.lit(""))).otherwise(content)
    level = F.nullif("text_level", F.lit(0))
    if "level" in items.columns:
        level = F.coalesce(level, F.nullif("level", F.lit(0)))
    rows = items.withColumns({"block_type": block_type, "content": content, "page_number": F.col("page_idx") + 1, "level": level})
    return rows.filter((kind != "page_number") & (F.col("content") != "")).select(F.concat_ws(":block:", "document_id", F.col("item_idx").cast("string")).alias("id"), "document_id", "block_type", "level", "content", "page_number", "bbox")
