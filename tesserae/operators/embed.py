"""Embedding through a provider: an object with ``embed(texts) -> vectors`` made on the worker, called by batches."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, FloatType, StructField, StructType

from tesserae.session import text_batches

BATCH = 16


class EmbeddingUnavailable(RuntimeError):
    pass


def vectors_of(response: Any, count: int) -> list[list[float]]:
    """Vectors of a provider's answer: ``{"data": [{"index", "embedding"}]}`` by index, ``{"embeddings": [...]}`` or a bare list."""
    if isinstance(response, (str, bytes)):
        response = json.loads(response)
    if isinstance(response, dict) and "data" in response:
        found = [item["embedding"] for item in sorted(response["data"], key=lambda item: item.get("index", 0))]
    elif isinstance(response, dict) and "embeddings" in response:
        found = response["embeddings"]
    else:
        found = response
    if not isinstance(found, Sequence) or len(found) != count:
        raise EmbeddingUnavailable("the provider returned another number of vectors than texts")
    return [valid_vector(v) for v in found]


def valid_vector(vector: Sequence[float]) -> list[float]:
    if not vector or any(isinstance(x, (str, bytes)) or x is None for x in vector):
        raise EmbeddingUnavailable("a vector must be a list of numbers and not empty")
    return [float(x) for x in vector]


class HashEmbedder:
    """A deterministic stand-in for a model: components from the hash of the text, of length one."""

    def __init__(self, dimensions: int = 8):
        self.dimensions = dimensions

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            raw = [int.from_bytes(hashlib.sha256(f"{i}:{text}".encode()).digest()[:4], "big") / 2**31 - 1 for i in range(self.dimensions)]
            norm = math.sqrt(sum(x * x for x in raw)) or 1.0
            out.append([x / norm for x in raw])
        return out


class CallableEmbedder:
    """Wraps what embeds: an object with ``embed_documents`` or ``encode``, or a function of texts."""

    def __init__(self, target: Any):
        self.call = getattr(target, "embed_documents", None) or getattr(target, "encode", None) or target
        if not callable(self.call):
            raise TypeError("an embedding provider must be callable")

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return vectors_of([list(v) for v in self.call(list(texts))], len(texts))


class HttpEmbedder:
    """A service that answers POST ``{"model", "input"}``. ``post`` sends (address, body, timeout), and the headers where a ``key`` is given;
    nothing is fetched on import."""

    def __init__(self, url: str, model: str, post: Callable[..., Any], timeout: float = 60.0, key: str | None = None):
        self.url, self.model, self.post, self.timeout, self.key = url, model, post, timeout, key

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        headers = [{"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}] if self.key else []
        return vectors_of(self.post(self.url, {"model": self.model, "input": list(texts)}, self.timeout, *headers), len(texts))


class UnitEmbedder(CallableEmbedder):
    """A local model, its vectors divided by their lengths."""

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return [[x / size for x in v] if (size := math.sqrt(sum(x * x for x in v))) else v for v in super().embed(texts)]


def endpoint(url: str = "", base: str = "") -> str:
    """Where embeddings are asked for: ``url`` as it is, or else under ``base``."""
    if not url and not base:
        raise EmbeddingUnavailable("neither an address nor a base address of the embedding service is given")
    return url or f"{base.rstrip('/')}/embeddings"


# Names of the kinds of providers.
SERVICES = ("openai", "openai_compatible", "api")
LOCAL = ("sentence_transformers", "sentence-transformer", "local")


def provider(kind: str, *, model: Any, post: Callable[..., Any] | None = None, url: str = "", base: str = "", timeout: float = 60.0, key: str | None = None, normalise: bool = True) -> Any:
    """A provider by the name of its kind: a service (``model`` names the model, ``post`` sends), or a ``model`` at hand."""
    name = kind.strip().lower()
    if name in SERVICES:
        if post is None:
            raise ValueError("a service needs a function that sends")
        return HttpEmbedder(endpoint(url, base), model, post, timeout, key)
    if name in LOCAL:
        return UnitEmbedder(model) if normalise else CallableEmbedder(model)
    raise ValueError(f"no embedding provider of the kind {kind}")


def embed_query(provider: Any, query: str) -> list[float]:
    if not query.strip():
        raise ValueError("texts to embed must not be blank")
    try:
        return valid_vector(provider.embed([query.strip()])[0])
    except EmbeddingUnavailable:
        raise
    except Exception as error:
        raise EmbeddingUnavailable("the embedding provider failed") from error


def _not_blank(text: str) -> str:
    if not (found := text.strip()):
        raise ValueError("texts to embed must not be blank")
    return found


def embed(chunks: DataFrame, make: Callable[[], Any], text: str = "text", batch: int = BATCH, component: DataType = FloatType(), ask: Callable[[str], str] = _not_blank) -> DataFrame:
    """``chunks`` with ``vector``, whose components are kept as ``component``. ``make`` builds the provider once per task; ``ask`` makes of a text what
    the provider is asked: without it texts are stripped, and a blank one fails."""
    text_batches(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for rows in batches:
            texts = [ask(t or "") for t in rows.column(rows.schema.get_field_index(text)).to_pylist()]
            found: list[list[float]] = []
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                vectors = provider.embed(part)
                if len(vectors) != len(part):
                    raise EmbeddingUnavailable("the provider returned another number of vectors than texts")
                found += map(valid_vector, vectors)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.list_(to_arrow_type(component)))], names=[*rows.schema.names, "vector"])

    rows = chunks.drop("vector")
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("vector", ArrayType(component))]))


def unit(vector: Column) -> Column:
    """The vector divided by its length; zeros stay."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(0.0))
