"""An inverted-file index for vector search: cells, quantised residuals, exact re-rank.

Centroids are fitted on a bounded sample, and every row is filed under the cell of its nearest centroid. What is left of a vector (of length one)
after its centroid is cut into slices of ``SLICE`` components, each named by the nearest of 256 code words: a byte a slice. A search
takes the cells nearest to the query, reads only ids and codes there, and keeps ``RERANK`` candidates for each hit asked for; then it
reads the vectors of the cells that hold candidates, and scores these exactly. How many cells are looked at is calibrated: as many as
hold ``target`` of the nearest neighbours of sample rows.

Rows are kept in an ``Index`` whose buckets are the cells: cells are folders, so others aren't opened. Upserts file new rows under the
cells there are; a row that moves to another cell leaves the old one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from tesserae.functions.text import strip
from tesserae.operators.index import Index, Manifest
from tesserae.operators.retrieve import BLOCK, DEFAULT_K, QUERY_BLOCK, _best, cosine, search_many
from tesserae.operators.skew import FEW
from tesserae.session import scratch_path, stored

#: Rows that the index is fitted on at most, rows of them whose neighbours calibrate it, and cells at most.
SAMPLE, ASKED, MOST_CELLS = 20_000, 200, 1024
SLICE, WORDS = 2, 256
RERANK, TARGET = 6, 0.97


@dataclass
class Cells:
    centroids: np.ndarray  # a row for each cell
    words: np.ndarray  # slices x code words x components
    probes: int = 1

    @property
    def width(self) -> int:
        return self.centroids.shape[1]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Cells of each row, nearest first."""
        return np.argsort((self.centroids**2).sum(axis=1) - 2 * x @ self.centroids.T, axis=1, kind="stable")

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code of each row; rows of length one, or zeros."""
        cell = ((self.centroids**2).sum(axis=1) - 2 * x @ self.centroids.T).argmin(axis=1)
        rest = _sliced(x - self.centroids[cell])
        code = [((w**2).sum(axis=1) - 2 * rest[:, i] @ w.T).argmin(axis=1) for i, w in enumerate(self.words)]
        return cell, np.stack(code, axis=1).astype(np.uint8)

    def decode(self, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        rest = np.concatenate([w[code[:, i]] for i, w in enumerate(self.words)], axis=1)[:, : self.width]
        return self.centroids[cell] + rest


def _sliced(x: np.ndarray) -> np.ndarray:
    """Rows x slices x components; zeros fill the last slice."""
    slices = -(-x.shape[1] // SLICE)
    padded = np.zeros((len(x), slices * SLICE))
    padded[:, : x.shape[1]] = x
    return padded.reshape(len(x), slices, SLICE)


def _units(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors divided by their lengths; zeros for those that are null, of other than ``width`` components, or hold no finite number somewhere."""
    sizes = np.asarray(lists.value_lengths().fill_null(-1))
    out = np.zeros((len(lists), width))
    usual = np.flatnonzero(sizes == width)
    if len(usual):
        out[usual] = np.asarray(lists.take(pa.array(usual)).flatten().cast(pa.float64()).fill_null(np.nan)).reshape(-1, width)
    out[~np.isfinite(out).all(axis=1)] = 0
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: finite components, not all of them 0."""
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)


def _unit_array(vector: Column) -> Column:
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / size)


def _code_words(rests: DataFrame) -> np.ndarray:
    """Code words of each slice, from the rests of the sample: k-means by slice, each in a task of its own, over the bounded sample."""

    def fit(key: tuple[int, ...], rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["part"].to_numpy())
        words = np.quantile(x, (np.arange(WORDS) + 0.5) / WORDS, axis=0) if x.shape[1] == 1 else x[np.linspace(0, len(x) - 1, WORDS).astype(int)]
        for _ in range(12):
            near = np.concatenate([((words**2).sum(axis=1) - 2 * x[i : i + 4096] @ words.T).argmin(axis=1) for i in range(0, len(x), 4096)])
            count = np.bincount(near, minlength=WORDS)
            sums = np.stack([np.bincount(near, weights=c, minlength=WORDS) for c in x.T], axis=1)
            words = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], words)
        return pd.DataFrame({"slice": [int(key[0])], "words": [words.ravel().tolist()]})

    found = rests.groupBy("slice").applyInPandas(fit, "slice int, words array<double>").collect()  # slices x 256 x SLICE numbers
    return np.array([r["words"] for r in sorted(found, key=lambda r: r["slice"])]).reshape(len(found), WORDS, SLICE)


def fit(rows: DataFrame, cells: int | None = None, key: str = "id", vector: str = "vector", sample: int = SAMPLE, target: float = TARGET) -> Cells:
    """Cells and code words for ``rows``, from at most about ``sample`` of them (chosen by a hash of the key). Cells: 16 rows of the sample
    each, if no number is given, and ``MOST_CELLS`` at most."""
    spark = rows.sparkSession
    fine = rows.select(F.col(key).cast("string").alias("id"), F.col(vector).alias("v")).filter(usable(F.col("v")))
    total, width = fine.agg(F.count("*"), F.max(F.size("v"))).first()
    if not total:
        raise ValueError("no row has a vector that the index could be fitted on")
    share = min(1.0, sample / total)
    chosen = fine.filter((F.size("v") == width) & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= int(share * (1 << 30))))
    chosen = stored(chosen.select("id", _unit_array(F.col("v")).alias("vector"), array_to_vector(_unit_array(F.col("v"))).alias("features")), "sample")
    n = chosen.count()
    k = max(1, min(cells or n // 16, n, MOST_CELLS))
    if k > 1:
        centroids = np.array(KMeans(k=k, seed=7, initMode="random", maxIter=12).fit(chosen).clusterCenters())
    else:
        centroids = np.zeros((1, width))
    made = Cells(centroids, np.zeros((-(-width // SLICE), 1, SLICE)))
    shared = spark.sparkContext.broadcast(made)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _units(batch.column(1), width)
            cell = shared.value.encode(x)[0]
            parts = _sliced(x - shared.value.centroids[cell])
            listed = [pa.array([p.tolist() for p in parts[:, i]], pa.list_(pa.float64())) for i in range(parts.shape[1])]
            for i, part in enumerate(listed):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(part), pa.int32()), part], names=["slice", "part"])

    made.words = _code_words(chosen.select("id", "vector").mapInArrow(rest, "slice int, part array<double>"))
    made.probes = _calibrated(chosen.select("id", "vector"), made, target)
    return made


def _calibrated(sample: DataFrame, made: Cells, target: float) -> int:
    """Cells to look at so that ``target`` of the five nearest neighbours of some sample rows are in them."""
    asked = sample.orderBy(F.xxhash64("id")).limit(ASKED).select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    hits = search_many(sample, asked, k=6, min_score=-2.0).filter("query_id <> id")
    met = hits.join(asked, "query_id").join(sample, "id").select("query_vector", "vector").collect()  # ASKED x 6 rows
    if not met:
        return len(made.centroids)
    order = made.nearest(np.array([r["query_vector"] for r in met]))
    cell = made.encode(np.array([r["vector"] for r in met]))[0]
    rank = np.sort((order == cell[:, None]).argmax(axis=1))
    return int(rank[min(len(rank) - 1, int(np.ceil(target * len(rank))) - 1)]) + 1


def encoded(rows: DataFrame, made: Cells, vector: str = "vector") -> DataFrame:
    """``rows`` with ``cell`` and ``code``; rows without a direction have code null and are in cell 0."""
    shared = rows.sparkSession.sparkContext.broadcast(made)
    at = rows.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _units(batch.column(at), shared.value.width)
            none = ~x.any(axis=1)
            cell, code = shared.value.encode(x)
            codes = [None if n else c.tobytes() for n, c in zip(none.tolist(), code)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(none, 0, cell), pa.int32()), pa.array(codes, pa.binary())], names=[*batch.schema.names, "cell", "code"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("cell", IntegerType()), StructField("code", BinaryType())]))


def rerank(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = DEFAULT_K, key: str = "id") -> DataFrame:
    """``query_id``, ``rank``, ``id`` and exact ``score`` of the best ``k`` of each query's ``candidates`` (query_id, id): cosine, 0 where a
    vector has no length, rounded to 12 digits; equal scores by id."""
    met = candidates.join(vectors.select(F.col(key).alias("id"), F.col("vector").alias("_v")), "id").join(queries.select("query_id", F.col("query_vector").alias("_q")), "query_id")
    scored = met.select("query_id", "id", F.round(F.coalesce(cosine(F.col("_q"), F.col("_v")), F.lit(0.0)), 12).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


#: Rows and queries of one product of ``rerank_groups``, about: a block of either is dealt by a hash of its ids.
GROUP_ROWS, GROUP_QUERIES = 8192, 4096


def rerank_groups(queries: DataFrame, vectors: DataFrame, group: str, k: int = DEFAULT_K, key: str = "id", digits: int = 12) -> DataFrame:
    """As ``rerank``, where the candidates of a query (query_id, query_vector, ``group``) are all rows of its group: pairs aren't listed. A group's
    rows and queries are dealt into blocks, every two of them meet in one product, and only the best ``k`` of a query in a block leave it.
    Scores are compared at ``digits`` digits. Null groups meet nothing; a score that is no number comes first, as in ``rerank``."""
    many = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    rows = vectors.select(F.col(group).alias("g"), F.col(key).alias("id"), F.col("vector").cast("array<double>").alias("v"))
    asked = queries.select(F.col(group).alias("g"), "query_id", F.col("query_vector").cast("array<double>").alias("q"))
    sizes = rows.groupBy("g").agg(F.count("*").alias("n")).join(asked.groupBy("g").agg(F.count("*").alias("m")), "g").select("g", many("n", GROUP_ROWS).alias("rb"), many("m", GROUP_QUERIES).alias("qb"))
    own = lambda name, blocks: F.pmod(F.xxhash64(name), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    left = asked.join(sizes, "g").select("g", own("query_id", "qb").alias("qb"), every("rb").alias("rb"), "query_id", "q")
    right = rows.join(sizes, "g").select("g", every("qb").alias("qb"), own("id", "rb").alias("rb"), "id", "v")

    def best(asked: pa.Table, there: pa.Table) -> pa.Table:
        names, ids = asked["query_id"].combine_chunks(), there["id"].combine_chunks()
        q, x = asked["q"].combine_chunks(), there["v"].combine_chunks()
        width = max((int(c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).max()) for c in (q, x) if len(c)), default=0)
        (q, q_sizes), (x, x_sizes) = _padded(q, width), _padded(x, width)
        held = []
        for a in range(0, len(q), 256):
            for b in range(0, len(x), BLOCK):
                with np.errstate(invalid="ignore"):
                    scores = np.round(np.where(q_sizes[a : a + 256, None] == x_sizes[b : b + BLOCK], q[a : a + 256] @ x[b : b + BLOCK].T, 0.0), 12)
                ranked = np.nan_to_num(np.round(scores, digits), nan=np.inf) if digits < 12 else np.nan_to_num(scores, nan=np.inf)
                places, _ = _best(ranked, ids.slice(b, BLOCK), k)
                held.append((np.repeat(np.arange(a, a + len(places)), places.shape[1]), places.ravel() + b, np.take_along_axis(scores, places, 1).ravel()))
        row, place, score = (np.concatenate([h[i] for h in held]) for i in range(3)) if held else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"query_id": names.take(pa.array(row)), "id": ids.take(pa.array(place)), "score": pa.array(score)})

    kinds = (f"query_id {queries.schema['query_id'].dataType.simpleString()}", f"id {vectors.schema[key].dataType.simpleString()}", "score double")
    met = left.groupBy("g", "qb", "rb").cogroup(right.groupBy("g", "qb", "rb")).applyInArrow(best, ", ".join(kinds))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", digits)), "id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _padded(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors over their lengths in rows of ``width`` numbers, and how many components each has. Vectors that are null, hold null or have no
    length are zeros; what is not finite stays."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    row, start = np.repeat(np.arange(len(lists)), sizes), np.cumsum(sizes) - sizes
    out = np.zeros((len(lists), width))
    out[row, np.arange(sizes.sum()) - np.repeat(start, sizes)] = flat.to_numpy(zero_copy_only=False)
    if flat.null_count:
        out[row[flat.is_null().to_numpy(zero_copy_only=False)]] = 0
    with np.errstate(invalid="ignore"):
        size = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, size, out=np.zeros_like(out), where=size != 0), sizes


class VectorIndex(Index):
    """Rows with ``id``, ``vector`` and any others at ``path``, filed by cells."""

    HOMED = False  # a row's cell does, and it may move

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, buckets=MOST_CELLS)
        self._cells: Cells | None = None

    @property
    def cells(self) -> Cells:
        if self._cells is None:
            row = self.spark.read.parquet(f"{self.path}/model").first()
            centroids, words = (np.array(row[n]).reshape(row[f"{n}_shape"]) for n in ("centroids", "words"))
            self._cells = Cells(centroids, words, row["probes"])
        return self._cells

    def create(self, rows: DataFrame, cells: int | None = None, **options) -> int:
        """Fits the cells and files all rows; the number written."""
        if self.exists():
            raise ValueError(f"there is an index at {self.path}")
        self._cells = made = fit(rows, cells, **options)
        flat = [(made.centroids.ravel().tolist(), list(made.centroids.shape), made.words.ravel().tolist(), list(made.words.shape), made.probes)]
        kind = "centroids array<double>, centroids_shape array<int>, words array<double>, words_shape array<int>, probes int"
        self.spark.createDataFrame(flat, kind).coalesce(1).write.parquet(f"{self.path}/model")
        return self.upsert(rows)

    def bucket_of(self, key: str, buckets: int | None = None) -> Column:
        return F.col("cell")

    def upsert(self, rows: DataFrame, key: str = "id", create: bool = True, order: Column | None = None) -> int:
        """As of any index. The first rows are what the cells are fitted on."""
        plain = rows.drop("cell", "code")
        if self._cells is None and not self.exists():
            if not create:
                raise LookupError(f"there is no index at {self.path}, and it may not be created")
            first = stored(plain, "rows")
            return self.create(first) if first.limit(1).count() else 0
        ranking = order if order is not None else F.xxhash64(*plain.columns)
        return super().upsert(encoded(plain, self.cells), key, create, ranking)

    def _read(self, m: Manifest, buckets: set[str] | None = None) -> DataFrame:
        """As of any index, but a key of an upsert may have been in any cell before."""
        schema = StructType.fromJson(m.schema)
        folders = [f for b, (f, _) in m.base.items() if buckets is None or b in buckets]
        out = self._rows(folders, schema) if folders else self.spark.createDataFrame([], schema)
        if m.upserts:
            newest = self._upserted(m, {b for _, rows in m.upserts for b in rows})
            keys, size = newest.select(m.key), sum(sum(rows.values()) for _, rows in m.upserts)
            out = out.join(F.broadcast(keys) if size <= FEW else keys, m.key, "left_anti").select(*schema.names)
            out = out.unionByName(newest if buckets is None else newest.filter(F.col("cell").isin([int(b) for b in buckets])))
        return out

    def compact(self, base: bool = True) -> bool:
        """Merges the upserts into all cells: a row may have left any. Whether it was published."""
        m = self.manifest()
        if m is None or not m.upserts or not base:
            return super().compact(base)
        merged = [f for f, _ in m.upserts]
        folder, counts = self._write(self._dealt(self._read(m), m.key, m.buckets))

        def change(last: Manifest | None) -> Manifest | None:
            if last is None or [f for f, _ in last.upserts][: len(merged)] != merged:
                return None
            files = {b: (f"{folder}/_b={b}", n) for b, n in counts.items()}
            return Manifest(last.key, last.buckets, last.schema, last.dimension, files, [tuple(u) for u in last.upserts[len(merged) :]])

        if self._commit(change) is None:
            self._fs.delete(self._at(folder), True)
            return False
        return True

    def candidates(self, queries: DataFrame, k: int = DEFAULT_K, probes: int | None = None, per_hit: int = RERANK) -> DataFrame:
        """``query_id``, ``id``, ``cell`` of the ``per_hit * k`` rows that their codes make the best for each of at most ``QUERY_BLOCK`` queries
        (query_id, query_vector), from the ``probes`` nearest cells of each. Only ids and codes are read, of these cells."""
        m, made = self.manifest(), self.cells
        if m is None:
            raise LookupError(f"there is no index at {self.path}")
        rows = queries.select("query_id", "query_vector").limit(QUERY_BLOCK + 1).collect()
        if len(rows) > QUERY_BLOCK:
            raise ValueError(f"more than {QUERY_BLOCK} queries at once; split them into sets")
        q = _units(pa.array([r["query_vector"] for r in rows], pa.list_(pa.float64())), made.width)
        near = made.nearest(q)[:, : probes or made.probes]
        wanted = np.zeros((len(made.centroids), len(rows)), dtype=bool)
        wanted[near, np.arange(len(rows))[:, None]] = True
        shared = self.spark.sparkContext.broadcast((made, q, wanted, pa.array([r["query_id"] for r in rows], to_arrow_type(queries.schema["query_id"].dataType))))
        top = per_hit * k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made, q, wanted, names = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    ids, cell = part.column(0), part.column(1).to_numpy()
                    code = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype=np.uint8).reshape(len(cell), -1)
                    for c in np.unique(cell):
                        mine, own = np.flatnonzero(cell == c), np.flatnonzero(wanted[c])
                        if not len(own):
                            continue
                        score = q[own] @ made.decode(cell[mine], code[mine]).T
                        best = np.argsort(-score, axis=1, kind="stable")[:, :top]
                        yield pa.RecordBatch.from_arrays(
                            [names.take(pa.array(np.repeat(own, best.shape[1]))), ids.take(pa.array(mine[best.ravel()])), pa.array(np.full(best.size, c, dtype=np.int32)), pa.array(np.take_along_axis(score, best, 1).ravel())],
                            names=["query_id", "id", "cell", "near"],
                        )

        read = self._read(m, {str(c) for c in np.unique(near)} if len(rows) else set()).select("id", "cell", "code").filter("code is not null")
        kind = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {read.schema['id'].dataType.simpleString()}, cell int, near double"
        found = read.mapInArrow(run, kind)
        order = Window.partitionBy("query_id").orderBy(F.desc("near"), "id")
        return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= top).select("query_id", "id", "cell")

    def search(self, queries: DataFrame, k: int = DEFAULT_K, min_score: float = 0.0, probes: int | None = None, per_hit: int = RERANK) -> DataFrame:
        """``query_id``, ``rank``, ``id``, ``score`` of the best rows of each query: exact scores of the candidates. Vectors are read of the cells
        that hold a candidate. Queries without a direction find nothing."""
        return self._reranked(queries, k, probes, per_hit)[0].filter(F.col("score") >= min_score)

    def _reranked(self, queries: DataFrame, k: int, probes: int | None = None, per_hit: int = RERANK) -> tuple[DataFrame, set[str]]:
        """The best rows of each query, and the cells that they are in."""
        asked = queries.filter(usable(F.col("query_vector")))
        found = stored(self.candidates(asked, k, probes, per_hit), "candidates")
        cells = {str(r["cell"]) for r in found.select("cell").distinct().collect()}  # no more than there are cells
        vectors = self._read(self.manifest(), cells).select("id", "vector")
        return rerank(found.select("query_id", "id"), vectors, asked, k), cells

    def best(self, query: list[float], k: int = DEFAULT_K, min_score: float = 0.0) -> DataFrame:
        """As ``retrieve.search`` of one query: the whole rows with ``score``, read of the cells that hold candidates."""
        asked = self.spark.createDataFrame([(0, [float(x) for x in query])], "query_id int, query_vector array<double>")
        hits, cells = self._reranked(asked, k)
        named = stored(hits.filter(F.col("score") >= min_score).select("id", "score"), "hits")
        rows = self._read(self.manifest(), cells).drop("cell", "code").join(F.broadcast(named), "id")  # k rows
        return rows.filter(strip(F.col("text")) != "") if "text" in rows.columns else rows


def scratch_index(spark: SparkSession) -> VectorIndex:
    """An index in a folder of its own among the shared ones."""
    return VectorIndex(spark, scratch_path(spark, "vectors"))
