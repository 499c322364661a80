"""Files that arrive: each micro-batch of Markdown, or of PDFs with a parser's archives, becomes chunks and is upserted. Batches that run
again change nothing, because chunk ids are made of their content."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesserae.functions.text import detect_language
from tesserae.operators.chunk import Budget, markdown_chunks
from tesserae.operators.clean import clean_markdown_elements
from tesserae.operators.embed import HashEmbedder
from tesserae.operators.index import Index, index_rows, latest
from tesserae.operators.normalize import normalize
from tesserae.plans.ingest import pdf_units, with_vectors
from tesserae.session import stored
from tesserae.sources import markdown
from tesserae.sources.files import file_id, loaded_archives
from tesserae.streaming.jobs import arriving_files, with_artifacts


def watch_markdown(spark: SparkSession, path: str, index: Index, checkpoint: str, make_provider: Callable[[], Any] = HashEmbedder, budget: Budget = Budget()) -> StreamingQuery:
    """Starts a query that takes the files there are, then ends; run it again, or with another trigger, for more."""
    arriving = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.md").load(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_name").alias("file_name"))

    def store(batch: DataFrame, _: int) -> None:
        texts = batch.withColumn("text", F.regexp_replace(F.regexp_replace("text", "^\\ufeff", ""), "\r\n?", "\n"))
        texts = texts.withColumn("file_id", file_id(F.col("file_name"), F.sha2(F.col("text").cast("binary"), 256)))
        chunks = markdown_chunks(clean_markdown_elements(markdown.elements(texts)), budget)
        named = chunks.join(texts.select("file_id", "file_name", "source_path", detect_language(F.col("text")).alias("language")), "file_id")
        index.upsert(index_rows(with_vectors(normalize(named, "markdown"), index, make_provider)))

    return arriving.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch_pdfs(
    spark: SparkSession, path: str, archives: str, index: Index, checkpoint: str, missing: str | None = None, wait: str = "1 hour", make_provider: Callable[[], Any] = HashEmbedder, budget: Budget = Budget()
) -> StreamingQuery:
    """As ``watch_markdown`` for PDFs: each is taken once an archive made of it is there, whichever of them comes first. Those for which none
    comes within ``wait`` are appended to the Parquet table ``missing``, if it is named."""
    found = arriving_files(spark, path).select(file_id(F.col("file_name"), F.col("sha256")).alias("file_id"), "file_name", F.lit("pdf").alias("file_type"), F.col("path").alias("source_path"), "sha256", F.col("modified").alias("arrived"))
    made = loaded_archives(arriving_files(spark, archives, "*.zip").select("path", F.col("modified").alias("modificationTime"), "content"))

    def store(batch: DataFrame, _: int) -> None:
        rows = stored(batch, "arrived")
        nothing = F.col("json").isNull() & F.col("markdown").isNull()
        if missing is not None:
            rows.filter(nothing).select("file_id", "file_name", "source_path", "sha256", "arrived").write.mode("append").parquet(missing)
        parsed = latest(rows.filter(~nothing), "file_id", F.col("_made"))  # of several archives the newest
        index.upsert(index_rows(with_vectors(pdf_units(parsed, parsed, budget), index, make_provider)))

    return with_artifacts(found, made, wait).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
