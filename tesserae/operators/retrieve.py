"""Cosine top-k search, result metadata, and the context and sources of an answer."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import batched, chain
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from tesserae.functions.text import strip
from tesserae.session import scratch_path

DEFAULT_K, MAX_K, MIN_SCORE = 5, 20, 0.0
QUERY_BLOCK = 20_000
# Wording of answers and prompts.
NO_ANSWER = "知识库中没有找到相关内容。"
PROMPT = """你是一个专业知识库助手。
请严格根据下面提供的参考资料回答用户问题。

回答规则：
1. 优先使用参考资料中的内容回答。
2. 不要编造参考资料中不存在的事实。
3. 如果参考资料不足以回答问题，请明确说明。
4. 回答应清晰、准确，并尽量结合资料中的技术术语。

参考资料：
{context}

用户问题：
{question}
"""


def top_k_of(value: Any, default: int = DEFAULT_K, most: int = MAX_K) -> int:
    """A usable k: the default where the value is missing, no number or not positive; never more than ``most``."""
    try:
        k = default if value is None else int(value)
    except (TypeError, ValueError):
        k = default
    return min(default if k <= 0 else k, most)


def top_k_column(value: Column, default: int = DEFAULT_K, most: int = MAX_K) -> Column:
    k = F.coalesce(F.try_to_number(value.cast("string"), F.lit("S999999999")).cast("int"), F.lit(default))
    return F.least(F.when(k <= 0, default).otherwise(k), F.lit(most))


def valid_query(query: Any) -> str:
    if not isinstance(query, str) or not query.strip():
        raise ValueError("query cannot be empty")
    return query.strip()


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.try_divide(dot, norm(a) * norm(b))


def search(index: DataFrame, query: list[float], k: int = DEFAULT_K, min_score: float = MIN_SCORE, vector: str = "vector", key: str = "id") -> DataFrame:
    """The ``k`` rows most alike to the query, with ``score``; equal scores by key. Rows below ``min_score`` or without text are
    dropped after the limit, so fewer than ``k`` may be left. Vectors that are null, of another length than the query, without length
    or not finite score 0. The query is a literal: one scan, a bounded heap per task."""
    size = sum(float(x) * float(x) for x in query) ** 0.5
    if not query or size == 0:
        raise ValueError("the query vector has no length")
    given = F.array(*(F.lit(float(x) / size) for x in query))
    dot = F.aggregate(F.zip_with(vector, given, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    scored = index.withColumn("score", F.nanvl(F.coalesce(F.try_divide(dot, norm), F.lit(0.0)), F.lit(0.0)))
    best = scored.orderBy(F.desc("score"), key).limit(k)
    best = best.filter(F.col("score") >= min_score)
    return best.filter(strip(F.col("text")) != "") if "text" in index.columns else best


def search_many(index: DataFrame, queries: DataFrame, k: int = DEFAULT_K, min_score: float = MIN_SCORE, vector: str = "vector", key: str = "id", most_queries: int | None = None, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id``, ``rank``, ``id`` and ``score`` for any number of queries (query_id, query_vector), ``query_block`` of them at a
    time: their matrix is broadcast, each task multiplies it with its rows block by block and keeps the best ``k`` per query,
    and only these are exchanged. The driver reads the queries partition by partition and holds two blocks at most; the results of
    more blocks than one are stored. A caller can refuse more than ``most_queries``. Null vectors of the index, and queries with a null or
    empty vector, take no part; vectors of another length than the query, without length or not finite score 0."""
    asked = queries.select("query_id", "query_vector").filter(F.size("query_vector") > 0)
    if most_queries is not None and asked.limit(most_queries + 1).count() > most_queries:
        raise ValueError(f"more than {most_queries} queries at once; split them into sets")
    blocks = batched(asked.toLocalIterator(), query_block)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return index.select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), F.lit(0).alias("rank"), F.col(key).alias("id"), F.lit(0.0).alias("score")).limit(0)
    kind = queries.schema["query_id"].dataType
    if second is None:
        return _search_block(index, first, kind, k, min_score, vector, key)[0]
    path, schema = scratch_path(index.sparkSession, "hits"), None
    for block in chain((first, second), blocks):
        found, shared = _search_block(index, block, kind, k, min_score, vector, key)
        found.write.mode("append").parquet(path)
        shared.destroy()
        schema = found.schema
    return index.sparkSession.read.schema(schema).parquet(path)


def _search_block(index: DataFrame, asked: Sequence[Row], kind: DataType, k: int, min_score: float, vector: str, key: str) -> tuple[DataFrame, Broadcast]:
    """Hits of some queries, whose ids have the type ``kind``, and the broadcast that they are made with."""
    lists = pa.array([r["query_vector"] for r in asked], pa.list_(pa.float64()))
    shared = index.sparkSession.sparkContext.broadcast((pa.array([r["query_id"] for r in asked], to_arrow_type(kind)), *_units(lists, int(lists.value_lengths().to_numpy(zero_copy_only=False).max()))))
    types = [f"query_id {kind.simpleString()}", f"id {index.schema[key].dataType.simpleString()}", "score double"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q, sizes = shared.value
        ids, best = None, None  # candidates so far: ids, and for each query places in them with scores
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x, own = _units(part.column(1), q.shape[1])
                like = lambda i: np.where(sizes[i : i + 256, None] == own, q[i : i + 256] @ x.T, 0.0)  # noqa: B023, E731
                fresh = [_best(np.round(like(i), 12), part.column(0), k) for i in range(0, len(q), 256)]
                places, scores = (np.concatenate([f[n] for f in fresh]) for n in (0, 1)) if fresh else (np.zeros((0, 0), int), np.zeros((0, 0)))
                if ids is None:
                    ids, best = part.column(0), (places, scores)
                    continue
                merged = pa.concat_arrays([ids, part.column(0)])
                places = np.concatenate((best[0], places + len(ids)), axis=1)
                scores = np.concatenate((best[1], scores), axis=1)
                rank = _ranks(merged)[places]
                order = np.lexsort((rank, -scores), axis=1)[:, :k]
                places, scores = np.take_along_axis(places, order, 1), np.take_along_axis(scores, order, 1)
                used, inverse = np.unique(places, return_inverse=True)
                ids, best = merged.take(pa.array(used)), (inverse.reshape(places.shape), scores)
        if ids is not None and len(q):
            width = best[0].shape[1]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(np.repeat(np.arange(len(q)), width))), ids.take(pa.array(best[0].ravel())), pa.array(best[1].ravel())], names=["query_id", "id", "score"])

    found = index.select(F.col(key).alias("id"), vector).filter(F.col(vector).isNotNull()).mapInArrow(run, ", ".join(types))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    hits = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).filter(F.col("score") >= min_score).select("query_id", "rank", "id", "score")
    return hits, shared


BLOCK = 4096


def _rows_of_length_one(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _units(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors divided by their lengths, in rows of ``width`` numbers, and how many components they have. Rows that are longer, or hold what
    is no finite number, are zeros."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), width))
    fit = np.repeat(sizes <= width, sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat = lists.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(lists)), sizes)[fit], at[fit]] = flat[fit]
    out[~np.isfinite(out).all(axis=1)] = 0
    return _rows_of_length_one(out), sizes


def _ranks(ids: pa.Array) -> np.ndarray:
    """Places of ids in ascending order."""
    order = pc.sort_indices(ids).to_numpy(zero_copy_only=False)
    rank = np.empty(len(ids), dtype=np.int64)
    rank[order] = np.arange(len(ids))
    return rank


def _best(scores: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the best ``k`` columns of each row, equal scores by id. Only columns that score no less than the row's k-th are
    ordered, and nothing of the size of ``scores`` is held by what is returned."""
    rows, width = len(scores), min(k, scores.shape[1])
    if not rows or not width:
        return np.zeros((rows, 0), int), np.zeros((rows, 0))
    least = np.partition(scores, -width, axis=1)[:, -width, None]
    row, place = np.nonzero(scores >= least)
    order = np.lexsort((_ranks(ids)[place], -scores[row, place], row))
    first = np.searchsorted(row, np.arange(rows))  # the rows ascend, before and after
    places = place[order][first[:, None] + np.arange(width)]
    return places, np.take_along_axis(scores, places, 1)


def _first(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v.cast("string"), F.lit("")) for v in values))


def result_metadata(hits: DataFrame) -> DataFrame:
    """Hits with ``metadata``: fields of the row, and where these are empty those of ``metadata_json`` (if it is JSON)."""
    has = set(hits.columns)
    col = lambda name: F.col(name).cast("string") if name in has else F.lit(None).cast("string")
    meta = F.try_parse_json(col("metadata_json"))
    at = lambda path, kind="string": F.try_variant_get(meta, f"$.{path}", kind)
    text = lambda name, path: F.coalesce(strip(_first(col(name), at(path))), F.lit(""))
    split = lambda c: F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")
    filled = lambda c: F.when(F.size(c) > 0, c)
    pages = F.coalesce(filled(at("source.page_numbers", "array<string>")), filled(split(_first(col("page_numbers")))), F.array_compact(F.array(_first(col("page_number")))))
    both = F.when(_first(col("line_start")).isNotNull() & _first(col("line_end")).isNotNull(), F.array(col("line_start"), col("line_end")))
    span = F.coalesce(filled(at("source.line_range", "array<string>")), both)
    return hits.withColumn(
        "metadata",
        F.struct(
            text("file_name", "document.file_name").alias("file_name"), text("file_type", "document.file_type").alias("file_type"),
            text("chapter", "structure.chapter").alias("chapter"), text("section", "structure.section").alias("section"),
            _first(col("chunk_index")).cast("int").alias("chunk_index"), F.when(F.size(pages) > 0, pages).alias("page_numbers"), span.alias("line_range"),
        ),
    )


def hit_rows(raw: DataFrame) -> DataFrame:
    """Hits as a vector store tells them (``hit``: JSON), as rows for ``result_metadata``: ``id``, ``score`` and the fields of its entity. The entity is
    the member ``entity``, or else the hit itself without its id and scores. The score is the first of ``score`` and ``distance`` that is there and
    not empty, 0 if it is no number. What isn't JSON is a hit without fields."""
    hit = F.try_parse_json("hit")
    at = lambda v, path: F.try_variant_get(v, f"$.{path}", "string")
    inner = F.try_variant_get(hit, "$.entity", "variant")
    filled = F.coalesce(F.schema_of_variant(inner).startswith("OBJECT<") & (F.schema_of_variant(inner) != "OBJECT<>"), F.lit(False))
    entity = F.when(filled, inner).otherwise(hit)
    score = F.coalesce(_first(at(hit, "score"), at(hit, "distance")).try_cast("double"), F.lit(0.0))
    names = ("text", "file_name", "file_type", "chapter", "section", "chunk_index", "page_numbers", "page_number", "line_start", "line_end", "metadata_json")
    rows = raw.select(*raw.columns, hit.alias("_hit"), entity.alias("_entity"), score.alias("score"))
    return rows.select(*(c for c in raw.columns if c != "hit"), at(F.col("_hit"), "id").alias("id"), "score", *(at(F.col("_entity"), n).alias(n) for n in names))


def retrieved_documents(hits: DataFrame) -> DataFrame:
    """Results with ``text``, ``score`` and ``metadata`` as a retriever hands them on: ``page_content``, and ``metadata`` with the score and the first of the
    page numbers as ``page``. Those with blank texts are left out."""
    m = lambda name: F.col(f"metadata.{name}")
    text = lambda name: F.coalesce(m(name).cast("string"), F.lit("")).alias(name)
    pages = F.when(F.size(m("page_numbers")) > 0, m("page_numbers"))
    made = F.struct(*map(text, ("file_name", "file_type", "chapter", "section")), m("chunk_index").alias("chunk_index"), F.coalesce("score", F.lit(0.0)).alias("score"), F.get(pages, F.lit(0)).alias("page"), pages.alias("page_numbers"), m("line_range").alias("line_range"))
    content = strip(F.col("text"))
    return hits.filter(F.coalesce(content, F.lit("")) != "").select(*(c for c in hits.columns if c not in ("text", "score", "metadata")), content.alias("page_content"), made.alias("metadata"))


def context_parts(ranked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Ranked documents (rank, text, file_name, chapter, section, page) as numbered references, one text per group of ``by``."""
    page = F.when(_first(F.col("page")).isNotNull(), F.concat(F.lit("第"), F.col("page").cast("string"), F.lit("页")))
    source = F.concat_ws(" | ", _first(F.col("file_name")), _first(F.col("chapter")), _first(F.col("section")), page)
    label = F.concat(F.lit("[参考资料 "), F.col("rank").cast("string"), F.lit("]"), F.when(source != "", F.concat(F.lit(" 来源："), source)).otherwise(""))
    part = F.struct("rank", F.concat(label, F.lit("\n"), F.col("text")).alias("part"))
    return ranked.groupBy(*(by or [])).agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["part"]), "\n\n").alias("context"))


def distinct_sources(ranked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The first of the ranked documents with each source (file, chapter, section, page and chunk; not the type)."""
    w = Window.partitionBy(*(by or []), "file_name", "chapter", "section", "page", "chunk_index").orderBy("rank")
    return ranked.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def prompt(context: str, question: str) -> str:
    return PROMPT.format(context=context, question=question)
