"""Files as rows: Markdown, DOCX, parser archives, chunk previews. Listing and hashing are native; only what has no native
reader (ZIP members, Word XML) is read by workers, a file at a time."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions.tables import word_table_sentences
from tesserae.functions.text import collapse, detect_language, is_list_item, strip, uuid5_url
from tesserae.operators.headings import word_level
from tesserae.session import qualified
from tesserae.sources import archive

SUFFIXES = {"markdown": (".md", ".markdown"), "word": (".docx",), "pdf": (".pdf",), "text": (".txt",)}
# Namespace of word processor XML.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def kind_of(path: Column) -> Column:
    """The parser for a path by its suffix; null for none."""
    name = F.lower(path)
    case = F.lit(None).cast("string")
    for kind, suffixes in SUFFIXES.items():
        for suffix in suffixes:
            case = F.when(name.endswith(suffix), F.lit(kind)).otherwise(case)
    return case


def files(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """path, file_name, stem, kind, modified, length, sha256 and content of the files under ``path``, of one kind if named."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    named = rows.select("path", F.url_decode(name).alias("file_name"), F.regexp_replace(F.url_decode(name), r"\.[^.]*$", "").alias("stem"), kind_of(F.col("path")).alias("kind"), F.col("modificationTime").alias("modified"), "length", F.sha2("content", 256).alias("sha256"), "content")
    return named.filter(F.col("kind") == kind) if kind else named


def file_digests(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """As ``files`` of one kind, without the content: files of any size are hashed block by block, where the store is one that the
    Arrow file systems know."""
    if not archive.reachable(qualified(spark, path)):
        return files(spark, path, kind).drop("content")
    rows = archive.digests(spark, path)
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select("path", name.alias("file_name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), kind_of(F.col("path")).alias("kind"), "modified", "length", "sha256").filter(F.col("kind") == kind)


def file_id(name: Column, digest: Column) -> Column:
    return uuid5_url(F.concat_ws(":", name, digest))


def markdown_texts(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files decoded (no byte order mark, newlines only), with id, title and language."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.decode("content", "utf-8"), "^\\ufeff", ""), "\r\n", "\n"), "\r", "\n")
    rows = files(spark, path, "markdown").withColumn("text", text)
    title = F.coalesce(F.nullif(F.regexp_extract("text", r"(?m)^ {0,3}# +(.*?)\s*#*\s*$", 1), F.lit("")), F.col("stem"))
    return rows.select(file_id(F.col("file_name"), F.sha2(F.col("text").cast("binary"), 256)).alias("file_id"), "file_name", F.lit("markdown").alias("file_type"), F.col("path").alias("source_path"), "text", title.alias("title"), detect_language(F.col("text")).alias("language"))


def _docx(content: bytes) -> Iterator[tuple]:
    """Body children in order: (text, style, outline level, numbered, rows)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                label = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = label.get(f"{_W}val") if label is not None else s.get(f"{_W}styleId")

    def text(node) -> str:
        out = []
        for x in node.iter():
            out.append(x.text or "" if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" if x.tag in (f"{_W}br", f"{_W}cr") else "")
        return "".join(out)

    for child in body if body is not None else ():
        if child.tag == f"{_W}p":
            pr = child.find(f"{_W}pPr")
            get = lambda tag: pr.find(f"{_W}{tag}") if pr is not None else None  # noqa: B023, E731
            style, outline = get("pStyle"), get("outlineLvl")
            style_id = style.get(f"{_W}val") if style is not None else ""
            yield text(child), names.get(style_id, style_id), int(outline.get(f"{_W}val")) if outline is not None else None, get("numPr") is not None, None
        elif child.tag == f"{_W}tbl":
            rows = [["\n".join(text(p) for p in cell.iter(f"{_W}p")) for cell in row.findall(f"{_W}tc")] for row in child.findall(f"{_W}tr")]
            yield "", "", None, False, rows


def word_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of DOCX files: headings, lists, paragraphs and tables (as sentences, and as rows)."""
    fields = "source_path string, file_name string, sha256 string, element_idx int, text string, style string, outline int, numbered boolean, table_rows array<array<string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, name, digest, content in zip(*(batch.column(i).to_pylist() for i in range(4))):
                rows = list(_docx(content))
                n = len(rows)
                t, s, o, b, r = (list(x) for x in zip(*rows)) if rows else ([], [], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array([source] * n, pa.string()), pa.array([name] * n, pa.string()), pa.array([digest] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(t, pa.string()), pa.array(s, pa.string()), pa.array(o, pa.int32()), pa.array(b, pa.bool_()), pa.array(r, pa.list_(pa.list_(pa.string())))], names=[f.split()[0] for f in fields.split(", ")])

    raw = files(spark, path, "word").select("path", "file_name", "sha256", "content").mapInArrow(run, fields)
    table = F.filter(F.transform("table_rows", lambda row: F.transform(row, collapse)), lambda row: F.exists(row, lambda c: c != ""))
    rows = raw.withColumns({"table_rows": table, "text": strip(F.col("text"))})
    level = word_level(F.col("text"), F.col("style"), F.col("outline"))
    listed = F.col("numbered") | F.lower("style").rlike("list|bullet|number") | F.col("style").contains("列表") | is_list_item(F.col("text")) | F.col("text").rlike(r"^[a-zA-Z][.)]\s+")
    kind = F.when(F.col("table_rows").isNotNull(), "table").when(level.isNotNull(), "heading").when(listed, "list").otherwise("paragraph")
    content = F.when(F.col("table_rows").isNotNull(), word_table_sentences(F.col("table_rows"))).otherwise(F.col("text"))
    done = rows.withColumns({"element_type": kind, "content": content, "level": F.when(F.col("table_rows").isNull(), level)})
    return done.filter("content <> ''").select(file_id(F.col("file_name"), F.col("sha256")).alias("file_id"), "file_name", "source_path", "element_idx", "element_type", "level", "content", "table_rows")


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """Of each parser archive (ZIP) under ``path``: the first content list (or other JSON) in archive order, the first Markdown
    text, the member that a review reads, and the hash of the original file inside. Only these members are read, of archives of
    any size; where the store is one that only Spark reads, whole archives of up to 2 GB are loaded."""
    if not archive.reachable(qualified(spark, path)):
        rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
        return loaded_archives(rows.select("path", "modificationTime", "content"))
    found = archive.members(spark, path, wanted=".json,.md,_origin.pdf", content=".json,.md", digest="_origin.pdf")
    member, lists = F.col("member"), ("_content_list.json", "_content_list_v2.json")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    first = lambda value, *ends: F.min_by(F.when(member.endswith(ends[0]), value), F.when(member.endswith(ends[0]), F.col("position")))
    return found.groupBy("path", "modified").agg(
        first(text, ".json").alias("json"), first(text, ".md").alias("markdown"), F.coalesce(first(text, lists[0]), first(text, lists[1])).alias("content_list"), first(F.col("sha256"), "_origin.pdf").alias("origin_sha256"),
    )


def loaded_archives(rows: DataFrame) -> DataFrame:
    """The same of archives (path, modificationTime, content), of a table or a stream."""
    fields = "path string, modified timestamp, json string, markdown string, content_list string, origin_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            found = []
            for source, modified, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = z.namelist()
                        first = lambda *ends: next((n for n in names if n.endswith(ends)), None)  # noqa: B023, E731
                        lists = first("_content_list.json") or first("_content_list_v2.json")
                        read = lambda n: z.read(n).decode("utf-8", "replace") if n else None  # noqa: B023, E731
                        origin = first("_origin.pdf")
                        found.append((source, modified, read(first(".json")), read(first(".md")), read(lists), hashlib.sha256(z.read(origin)).hexdigest() if origin else None))
                except zipfile.BadZipFile:
                    found.append((source, modified, None, None, None, None))
            cols = list(zip(*found)) if found else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.timestamp("us", tz="UTC")), *(pa.array(c, pa.string()) for c in cols[2:])], names=[f.split()[0] for f in fields.split(", ")])

    return rows.mapInArrow(run, fields)


def latest_artifact(archives: DataFrame, sha256: str | None) -> DataFrame:
    """The newest archive of the file with that hash, else the newest that has a content list."""
    match = F.coalesce(F.col("origin_sha256") == F.lit(sha256), F.lit(False))
    return archives.filter(match | F.col("content_list").isNotNull()).orderBy(match.desc(), F.desc("modified"), "path").limit(1)


def batch_result(results: Column, data_id: str) -> Column:
    """Of a parser service's results, the first that is for ``data_id`` or for no one."""
    return F.get(F.filter(results, lambda r: r["data_id"].isNull() | (r["data_id"] == data_id)), F.lit(0))


# States of a parser service's task.
DONE = ("done", "success", "completed", "finish", "finished")
FAILED = ("failed", "error", "fail")


def is_done(state: Column, *urls: Column) -> Column:
    """A finished task: by its state, or by having any artifact."""
    said = F.lower(F.coalesce(state, F.lit(""))).isin(*DONE)
    return said | F.coalesce(*(F.nullif(u, F.lit("")) for u in urls)).isNotNull() if urls else said


def is_failed(state: Column) -> Column:
    return F.lower(F.coalesce(state, F.lit(""))).isin(*FAILED)


def previews(spark: SparkSession, path: str) -> DataFrame:
    """Chunk previews (``*_chunks_preview.json``, an array of chunks or an object with ``chunks``): a row per chunk with its file,
    position and raw JSON. Unreadable files have no rows."""
    raw = spark.read.option("wholetext", "true").option("pathGlobFilter", "*_chunks_preview.json").option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("path"))
    tree = F.try_parse_json("value")
    chunks = F.coalesce(F.try_variant_get(tree, "$", "array<variant>"), F.try_variant_get(tree, "$.chunks", "array<variant>"))
    rows = raw.select("path", F.posexplode(chunks).alias("pos", "chunk"))
    get = lambda p, kind="string": F.try_variant_get("chunk", p, kind)
    return rows.select("path", "pos", get("$.chunk_id").alias("chunk_id"), get("$.chunk_index", "int").alias("chunk_index"), get("$.text").alias("text"), get("$.token_count", "int").alias("token_count"), get("$.content_hash").alias("content_hash"), F.to_json("chunk").alias("raw"))


def documents_of(chunks: DataFrame) -> DataFrame:
    """A row per preview: id, name and type by its first chunk's metadata, and how many chunks it has."""
    first = F.min_by("raw", "pos")
    named = lambda k: F.coalesce(F.get_json_object("raw", f"$.metadata.{k}"), F.get_json_object("raw", f"$.metadata.document.{k}"))
    rows = chunks.groupBy("path").agg(first.alias("raw"), F.count("*").alias("chunk_count"))
    base = F.url_decode(F.element_at(F.split("path", "/"), -1))
    filled = lambda k, default: F.coalesce(F.nullif(named(k), F.lit("")), default)
    return rows.select("path", filled("file_id", F.regexp_replace(base, r"\.json$", "")).alias("document_id"), filled("file_name", base).alias("file_name"), filled("file_type", F.lit("unknown")).alias("file_type"), "chunk_count")


def find_document(documents: DataFrame, wanted: str) -> DataFrame:
    """The first preview by path whose id or name is ``wanted``."""
    return documents.filter((F.col("document_id") == wanted) | (F.col("file_name") == wanted)).orderBy("path").limit(1)


def newest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def items_of(text: str) -> list[dict]:
    """A parser's JSON as flat items: lists under any of its usual names, items with ``blocks`` replaced by these."""
    tree = json.loads(text)
    if isinstance(tree, dict):
        tree = next((tree[k] for k in ("content_list", "blocks", "layout_dets", "pages") if tree.get(k)), [])
    found, todo = [], [tree] if isinstance(tree, dict) else list(reversed(tree)) if isinstance(tree, list) else []
    while todo:
        item = todo.pop()
        if isinstance(item, dict) and isinstance(item.get("blocks"), list):
            todo += reversed(item["blocks"])
        elif isinstance(item, dict):
            found.append(item)
    return found
