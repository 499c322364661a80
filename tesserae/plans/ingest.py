"""Whole paths: files to chunks, chunks to the index, questions to answers, reviews of documents.

Each is a chain of DataFrame transformations; nothing runs before its result is asked for or written.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import content_hash, is_blank
from tesserae.operators import retrieve, review
from tesserae.operators.chunk import Budget, markdown_chunks, pdf_chunks, word_chunks
from tesserae.operators.clean import clean_blocks, clean_markdown_elements, clean_word
from tesserae.operators.embed import HashEmbedder, embed, embed_query
from tesserae.operators.index import Index, index_rows
from tesserae.operators.normalize import normalize
from tesserae.operators.skew import lookup_join
from tesserae.operators.vectors import VectorIndex
from tesserae.session import stored
from tesserae.sources import items, markdown
from tesserae.sources.files import archive_members, file_digests, file_id, latest_artifact, markdown_texts, word_elements

KNOWLEDGE_BASE = "default"


class SearchUnavailable(RuntimeError):
    pass


class ModelUnavailable(RuntimeError):
    pass


@dataclass(frozen=True)
class Settings:
    """Limits of retrieval; values that make no sense are raised to the least that does."""

    default_k: int = retrieve.DEFAULT_K
    max_k: int = retrieve.MAX_K
    min_score: float = retrieve.MIN_SCORE

    def __post_init__(self) -> None:
        object.__setattr__(self, "default_k", max(1, self.default_k))
        object.__setattr__(self, "max_k", max(self.default_k, self.max_k))
        object.__setattr__(self, "min_score", max(0.0, self.min_score))


    @classmethod
    def from_environment(cls, given: Mapping[str, str]) -> Settings:
        """Settings by name (``RETRIEVAL_DEFAULT_TOP_K``, ...); what is missing or no number keeps its default."""
        made = {}
        for name, key, kind in (("default_k", "RETRIEVAL_DEFAULT_TOP_K", int), ("max_k", "RETRIEVAL_MAX_TOP_K", int), ("min_score", "RETRIEVAL_MIN_SCORE", float)):
            try:
                made[name] = kind(given[key].strip())
            except (KeyError, ValueError):
                continue
        return cls(**made)


def _with_metadata(chunks: DataFrame, documents: DataFrame, *fields: str) -> DataFrame:
    """Parser chunks with their metadata struct, and the fields of their document."""
    own = [c for c in chunks.columns if c not in ("chunk_id", "text", "content_hash", "token_count", "chunk_index", *documents.columns)]
    joined = chunks.join(documents, "file_id")
    meta = F.struct("file_id", *own, *fields, "content_hash", "token_count")
    return joined.select("chunk_id", "chunk_index", "text", "token_count", "content_hash", meta.alias("metadata"))


def markdown_source(spark: SparkSession, path: str, budget: Budget = Budget()) -> DataFrame:
    texts = markdown_texts(spark, path)
    chunks = markdown_chunks(clean_markdown_elements(markdown.elements(texts)), budget)
    documents = texts.select("file_id", "file_name", "file_type", "source_path", "language", "title", F.lit("tesserae-markdown").alias("parser"))
    titled = chunks.join(documents.select("file_id", "title"), "file_id").withColumn("chapter", F.coalesce("chapter", "title")).drop("title")
    return normalize(_with_metadata(titled, documents.drop("title"), "file_name", "file_type", "source_path", "language", "parser"), "markdown")


def word_source(spark: SparkSession, path: str, budget: Budget = Budget()) -> DataFrame:
    elements = word_elements(spark, path)
    chunks = word_chunks(clean_word(elements), budget).withColumnRenamed("heading", "heading_path").drop("page_number", "page_numbers", "block_types", "file_name")
    documents = elements.groupBy("file_id").agg(F.min("file_name").alias("file_name"), F.min("source_path").alias("source_path"), F.lit("docx").alias("file_type"))
    joined = _with_metadata(chunks, documents, "file_name", "file_type", "source_path")
    return normalize(joined.withColumn("metadata", F.col("metadata").dropFields("file_id")), "docx")


def newest_archives(pdfs: DataFrame, archives: DataFrame) -> DataFrame:
    """Each of ``pdfs`` (sha256) with the newest archive made of it, else with the newest that has a content list; reading a
    file for which there is neither fails."""
    order, read = F.struct("modified", "path"), F.struct("json", "markdown")
    keyed = archives.withColumn("key", F.explode(F.array_compact(F.array("origin_sha256", F.when(F.col("content_list").isNotNull(), "")))))
    newest = keyed.groupBy("key").agg(F.max_by(read, order).alias("found"), F.when(F.col("key") == "", 2).otherwise(1).alias("weight"))
    asked = pdfs.withColumn("key", F.explode(F.array("sha256", F.lit(""))))
    met = lookup_join(asked, newest, "key", "weight", spread=F.col("file_id"), top=1)
    best = met.groupBy(*pdfs.columns).agg(F.max_by("found", F.when(F.col("found").isNotNull(), F.col("key"))).alias("found"))
    parsed = best.select(*pdfs.columns, F.col("found.json").alias("json"), F.col("found.markdown").alias("markdown"))
    nothing = F.col("json").isNull() & F.col("markdown").isNull()
    return parsed.withColumn("file_id", F.when(nothing, F.raise_error(F.concat(F.lit("no parser archive for "), "file_name"))).otherwise(F.col("file_id")))


def pdf_source(spark: SparkSession, path: str, archives: str, budget: Budget = Budget()) -> DataFrame:
    """PDF files with the archives that a layout parser left for them: JSON items, or else its Markdown."""
    pdfs = file_digests(spark, path, "pdf").select(file_id(F.col("file_name"), F.col("sha256")).alias("file_id"), "file_name", F.lit("pdf").alias("file_type"), F.col("path").alias("source_path"), "sha256")
    parsed = newest_archives(pdfs, archive_members(spark, archives))
    return pdf_units(pdfs, parsed, budget)


def pdf_units(pdfs: DataFrame, parsed: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """Unified chunks of PDF files (file_id, file_name, file_type, source_path) from what a layout parser made of them (file_id, json, markdown)."""
    from_items = items.blocks(items.items(parsed.select("file_id", "json")))
    columns = ["file_id", "block_idx", "block_type", "content", "page_number", "heading_level"]
    rest = parsed.select("file_id", F.col("markdown").alias("text")).filter("text is not null").join(from_items.select("file_id").distinct(), "file_id", "left_anti")
    from_text = markdown.line_blocks(rest).withColumn("page_number", F.lit(None).cast("int"))
    chunks = pdf_chunks(clean_blocks(from_items.select(*columns).unionByName(from_text.select(*columns))), budget)
    documents = pdfs.select("file_id", "file_name", "file_type", "source_path", F.lit("mineru").alias("parser"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("create_time"))
    return normalize(_with_metadata(chunks.withColumn("block_type", F.array_join("block_types", ",")).drop("block_types"), documents, "file_name", "file_type", "source_path", "parser", "create_time"), "pdf")


#: By suffix: the plan that reads such files. ``register_handler`` adds to it.
HANDLERS: dict[str, Callable[..., DataFrame]] = {".md": markdown_source, ".markdown": markdown_source, ".docx": word_source, ".pdf": pdf_source}


def register_handler(suffix: str, handler: Callable[..., DataFrame]) -> None:
    suffix = suffix.lower()
    HANDLERS[suffix if suffix.startswith(".") else f".{suffix}"] = handler


def handler_for(name: str) -> Callable[..., DataFrame]:
    suffix = "." + name.rpartition(".")[2].lower() if "." in name else ""
    if suffix not in HANDLERS:
        raise ValueError(f"no handler for {name}; known are {', '.join(sorted(HANDLERS))}")
    return HANDLERS[suffix]


def with_vectors(chunks: DataFrame, index: Index, make_provider: Callable[[], Any], reuse: bool = True) -> DataFrame:
    """Unified chunks with ``vector``, stored. The provider is asked for each distinct text once, and (``reuse``) for none whose hash is in the
    index with a vector already: an index has the vectors of one model. Chunks whose ``content_hash`` isn't that of their text are
    asked for by their text."""
    rows = stored(chunks.filter(~is_blank(F.col("text"))).withColumn("_hash", content_hash(F.col("text"))), "chunks")
    asked = rows.groupBy("_hash").agg(F.min("text").alias("text"), F.count("*").alias("weight"))
    known = None
    if reuse and index.exists() and {"content_hash", "vector"} <= set((old := index.read()).columns):
        mine = old.select(F.col("content_hash").alias("_hash"), "vector").filter("vector is not null").join(asked.select("_hash"), "_hash", "left_semi")
        known = stored(mine.groupBy("_hash").agg(F.min("vector").alias("vector")), "known")
        asked = asked.join(known.select("_hash"), "_hash", "left_anti")
    made = stored(embed(asked.select("_hash", "text"), make_provider).select("_hash", "vector"), "vectors")
    vectors = made if known is None else made.unionByName(known)
    weighed = vectors.join(rows.groupBy("_hash").agg(F.count("*").alias("weight")), "_hash")
    return lookup_join(rows, weighed, "_hash", "weight", spread=F.col("chunk_id")).drop("_hash")


def ingest(chunks: DataFrame, index: Index, make_provider: Callable[[], Any] = HashEmbedder, reuse: bool = True) -> dict[str, Any]:
    """Embeds unified chunks and upserts them; a summary. Without a chunk it fails, as nothing could be found later."""
    written = index.upsert(index_rows(with_vectors(chunks, index, make_provider, reuse)))
    if not written:
        raise ValueError("no chunks were made")
    return {"upsert_count": written}


def summaries(chunks: DataFrame) -> DataFrame:
    """A row per document: how many chunks, and their ids in order."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_id"))), lambda c: c["chunk_id"])
    return chunks.groupBy(F.col("metadata.document.file_id").alias("file_id"), F.col("metadata.document.file_name").alias("file_name")).agg(F.count("*").alias("chunk_count"), ids.alias("chunk_ids"))


def searchable(index: Index) -> DataFrame | VectorIndex:
    """What ``search`` takes: a vector index as it is, of any other its rows."""
    return index if isinstance(index, VectorIndex) and index.exists() else index.read()


def search(index: DataFrame | VectorIndex, query: str, provider: Any, top_k: Any = None, settings: Settings = Settings()) -> DataFrame:
    """``score``, ``text`` and ``metadata`` of the best rows for a question: exact over rows, by cells in a vector index."""
    vector = embed_query(provider, retrieve.valid_query(query))
    k = retrieve.top_k_of(top_k, settings.default_k, settings.max_k)
    hits = index.best(vector, k, settings.min_score) if isinstance(index, VectorIndex) else retrieve.search(index, vector, k, settings.min_score)
    return retrieve.result_metadata(hits).select("id", "score", "text", "metadata")


def _collected(index: DataFrame | VectorIndex, question: str, provider: Any, top_k: Any, settings: Settings) -> list[Any]:
    """The hits, best first. Where the index can't be read with its JSON metadata, its flat fields have to do."""
    tries = [index] + ([index.drop("metadata_json")] if isinstance(index, DataFrame) and "metadata_json" in index.columns else [])
    for rows in tries:
        hits = search(rows, question, provider, top_k, settings).orderBy(F.desc("score"), "id")
        try:
            return hits.collect()  # at most max_k rows
        except PySparkException as error:
            problem = error
    raise SearchUnavailable("the index can't be searched") from problem


def answer(index: DataFrame | VectorIndex, query: str, provider: Any, model: Callable[[str], str], top_k: Any = 5, knowledge_base: str | None = None, settings: Settings = Settings()) -> dict[str, Any]:
    """An answer from the best rows, with the distinct sources. Without any row the model isn't asked."""
    question = retrieve.valid_query(query)
    if (knowledge_base or KNOWLEDGE_BASE).strip() != KNOWLEDGE_BASE:
        raise ValueError(f"only the knowledge base {KNOWLEDGE_BASE!r} is there")
    hits = _collected(index, question, provider, top_k, settings)
    if not hits:
        return {"success": True, "answer": retrieve.NO_ANSWER, "sources": []}
    rows = [(i, h["text"], *(h["metadata"][n] for n in ("file_name", "file_type", "chapter", "section", "chunk_index")), (h["metadata"]["page_numbers"] or [None])[0]) for i, h in enumerate(hits, 1)]
    spark = index.spark if isinstance(index, VectorIndex) else index.sparkSession
    ranked = spark.createDataFrame(rows, "rank int, text string, file_name string, file_type string, chapter string, section string, chunk_index int, page string")
    context = retrieve.context_parts(ranked).first()["context"]
    sources = retrieve.distinct_sources(ranked).orderBy("rank").drop("rank", "text").collect()
    try:
        said = text_of(model(retrieve.prompt(context, question)))
    except Exception as error:
        raise ModelUnavailable("the model failed") from error
    return {"success": True, "answer": said, "sources": [s.asDict() for s in sources]}


def text_of(content: Any) -> str:
    """A model's answer as text: a string, or the texts of its parts."""
    if isinstance(content, str):
        return content
    if isinstance(content, Sequence):
        return "".join(p if isinstance(p, str) else str(p.get("text", "")) for p in content if isinstance(p, (str, dict)))
    return str(content)


def review_document(chunks: DataFrame, state: DataFrame, document: str = "file_id", blocks: DataFrame | None = None) -> dict[str, DataFrame]:
    """The parts of a review of flat chunks: ``chunks`` with the state laid over, ``pages``, ``tree``, ``issues`` and ``report``. Pages
    show the parser's ``blocks`` where a document has any, else its chunks."""
    seen = review.overlay(chunks, state) if "metadata" in chunks.columns else chunks
    pages = review.pages_of_chunks(seen, document)
    if blocks is not None:
        pages = review.pages_of_either(review.pages_of_blocks(blocks, document), pages, document)
    return {"chunks": seen, "pages": pages, "tree": review.heading_tree(seen, document), "issues": review.quality_issues(seen, document), "report": review.quality_report(seen, document)}


def assembled_review(parts: Mapping[str, DataFrame], document: str = "file_id") -> DataFrame:
    """One row per document of ``review_document``'s parts: its chunks, pages, tree and issues as arrays in order, and its report."""
    rows = None
    for name, frame in parts.items():
        fields = [c for c in frame.columns if c != document]
        gathered = F.sort_array(F.collect_list(F.struct(*_in_order(frame, fields)))) if name != "report" else F.first(F.struct(*fields))
        part = frame.groupBy(document).agg(gathered.alias(name))
        rows = part if rows is None else rows.join(part, document, "full")
    return rows


def _in_order(frame: DataFrame, fields: list[str]) -> list[str]:
    """Fields with a position first, maps left out: they can't be sorted."""
    plain = [f for f in fields if not frame.schema[f].dataType.simpleString().startswith(("map", "variant"))]
    return sorted(plain, key=lambda f: f not in ("chunk_index", "page", "block_idx"))


def update_review(index: Index, chunk_id: str, status: str, comment: str = "", text: str | None = None) -> int:
    """Writes one review; the last for a chunk counts."""
    row = index.spark.createDataFrame([(chunk_id, review.valid_status(status), comment, text)], "chunk_id string, review_status string, review_comment string, text string")
    return index.upsert(row.withColumn("updated_time", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")), key="chunk_id")


def read_state(index: Index) -> DataFrame:
    """The reviews written so far; none where nothing can be read."""
    try:
        return index.read()
    except (LookupError, PySparkException):
        return index.spark.createDataFrame([], "chunk_id string, review_status string, review_comment string, text string, updated_time string")


def artifact_for(spark: SparkSession, archives: str, sha256: str | None) -> DataFrame:
    return latest_artifact(archive_members(spark, archives), sha256)
