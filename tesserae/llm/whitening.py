"""PCA whitening of embeddings by a tiled covariance.

Vectors become integers x = floor(scale * c); an offset of all entries would change no result and isn't added. The fit list has each distinct vector once. Its rows are cut into row blocks and
its dimensions into column blocks; a pair of column blocks is a tile. Column blocks are exchanged by row block and tile, so that
the two of a tile meet; they are centred, multiplied, and summed per tile by each task, and the tasks' sums per tile. Only the assembled
matrix, which grows with the dimensions and not with the rows, goes to the driver, where it is decomposed; the axes go back in a broadcast of
the same bound. Sums of integers are exact.

Defined results: a vector that is null or holds a null or non-finite entry takes no part. Of vectors of several lengths those of the
commonest (of two, the longer) do, without entries none. Entries beyond 2**62 / scale count as that. Components without variance have
no ``whitened`` (null), their ``explained`` is 0, and ``identity_error`` is over the others (null without any). ``deviation`` is null where
it exceeds a long. Rows that repeat a vector or a key are all returned; other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tesserae.llm.wordhash import tidy
from tesserae.session import stored, text_batches

SCALE, MOST = 64, 16
#: Rows of a row block and dimensions of a column block: 1 MB of longs.
ROWS, TILE = 4096, 32
_FAR = 1 << 62


@dataclass
class Whitening:
    """``total``: sums of x over the ``n`` vectors of the fit list. ``axes``: a unit eigenvector a column, by falling eigenvalue."""

    n: int
    total: list[int]
    eigenvalues: np.ndarray
    axes: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * c) of each entry; null for a vector that takes no part."""
    number = F.transform(vector, lambda c: c.cast("double"))
    usable = F.forall(number, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(usable & (F.size(number) > 0), F.transform(number, lambda c: F.floor(F.greatest(F.lit(float(-_FAR)), F.least(F.lit(float(_FAR)), c * float(scale))))))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    return np.asarray(lists.flatten(), dtype=lists.type.value_type.to_pandas_dtype()).reshape(len(lists), width)


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - total / n, rounded once where n * x fits in a long."""
    most = max(int(np.abs(x).max(initial=0)), max((abs(t) // n for t in total), default=0))
    if (most + 1) * n < 1 << 61:
        return (x * n - np.array(total, dtype=np.int64)) / float(n)
    return x.astype(np.float64) - np.array([t / n for t in total])


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Rows, and exact sums of each dimension: a task sends one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, [0] * width
        for batch in batches:
            x = matrix(batch.column(0), width)
            count += len(x)
            # Halves of 31 bits: their sums fit in a long for any batch.
            total = [t + (h << 31) + low for t, h, low in zip(total, (x >> 31).sum(axis=0).tolist(), (x & 0x7FFFFFFF).sum(axis=0).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(width)], pa.int32()), pa.array([str(t) for t in (count, *total)])], names=["d", "s"])

    summed = fit.select("x").mapInArrow(tidy(run), "d int, s string").groupBy("d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {r["d"]: int(r["s"]) for r in summed.collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(width)]


def covariance(rows: DataFrame, width: int, n: int, total: list[int] | None = None, tile: int = TILE, block: int = ROWS) -> np.ndarray:
    """Covariance of the vectors in the column ``x`` of ``rows`` (read from files: the same rows in the same order each time), divisor
    ``n``; ``total`` has the sums of longs, None: of doubles with mean 0."""
    edges = range(0, width, tile)
    tiles = [(a, b) for a in range(len(edges)) for b in range(a, len(edges))]
    kind = pa.int64() if total is not None else pa.float64()
    number = np.int64 if total is not None else np.float64

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Column blocks of each row block, one row for each tile that it is in."""
        for batch in batches:
            for i in range(0, batch.num_rows, block):
                x = matrix(batch.column(0).slice(i, block), width)
                for c, e in enumerate(edges):
                    own = np.ascontiguousarray(x[:, e : e + tile]).astype(number).tobytes()
                    mine = [t for t in tiles if c in t]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(1)[i].as_py()] * len(mine)), pa.array([a for a, _ in mine], pa.int32()), pa.array([b for _, b in mine], pa.int32()), pa.array([c] * len(mine), pa.int32()), pa.array([own] * len(mine), pa.binary())], names=["r", "a", "b", "c", "m"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Products of the tiles, summed over the row blocks of a task. Rows come by tile, row block and column block."""
        at, acc, left = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if at is not None:
                i, j = np.indices(acc.shape)
                yield pa.RecordBatch.from_arrays([pa.array((i + edges[at[0]]).ravel(), pa.int32()), pa.array((j + edges[at[1]]).ravel(), pa.int32()), pa.array(acc.ravel())], names=["i", "j", "v"])

        for batch in batches:
            for r, a, b, c, m in zip(*(batch.column(i) for i in range(5))):
                a, b, c = a.as_py(), b.as_py(), c.as_py()
                size = min(tile, width - edges[c])
                x = np.frombuffer(m.as_buffer(), dtype=number).reshape(-1, size)
                x = centred(x, n, total[edges[c] : edges[c] + size]) if total is not None else x
                if at != (a, b):
                    yield from done()
                    at, acc = (a, b), np.zeros((min(tile, width - edges[a]), min(tile, width - edges[b])))
                if a == b:
                    acc += x.T @ x
                elif c == a:
                    left = (r.as_py(), x)
                else:
                    assert left is not None and left[0] == r.as_py(), "the two column blocks of a tile must meet"
                    acc += left[1].T @ x
        yield from done()

    named = rows.select("x", F.monotonically_increasing_id().alias("r"))
    pieces = named.mapInArrow(tidy(cut), "r long, a int, b int, c int, m binary").repartition("r", "a", "b").sortWithinPartitions("a", "b", "r", "c")
    sums = pieces.mapInArrow(tidy(multiply), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((width, width))
    for r in sums.collect():  # width squared numbers at most
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out / n


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> tuple[DataFrame, int]:
    """The rows that take part, as ``key`` and integers ``x``, and how many entries they have."""
    rows = stored(vectors.select(F.col(f"`{key}`").alias("key"), quantised(F.col(f"`{vector}`"), scale).alias("x")).filter("x is not null"), "vectors")
    common = rows.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    width = common["w"] if common else 0
    return rows.filter(F.size("x") == width), width


def fit(rows: DataFrame, width: int, most: int = MOST, tile: int = TILE) -> Whitening:
    """The whitening of ``usable`` rows. Equal vectors are folded in each task before they are exchanged."""
    text_batches(rows.sparkSession)
    once = stored(rows.select("x").groupBy("x").agg(F.lit(1).alias("one")).select("x"), "fit")
    n, total = _sums(once, width) if width else (0, [])
    if not n:
        return Whitening(0, [], np.zeros(0), np.zeros((width, 0)), np.zeros(0))
    v = covariance(once, width, n, total, tile)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    noise = max(values[0], 0.0) * width * np.finfo(np.float64).eps
    values = np.where(values > noise, values, 0.0)
    trace = float(np.trace(v))
    made = Whitening(n, total, values[:most].copy(), axes[:, :most].copy(), values[:most] / trace if trace > 0 else np.zeros(min(most, width)))
    live = int((made.eigenvalues > 0).sum())
    if live:
        white = stored(_projected(once.select(F.lit(None).cast("long").alias("key"), "x"), made, width).select(F.slice("whitened", 1, live).alias("x")), "white")
        made.identity_error = float(np.abs(covariance(white, live, n, None, tile) - np.eye(live)).max())
    return made


def _projected(rows: DataFrame, model: Whitening, width: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scale = np.divide(1.0, np.sqrt(m.eigenvalues), out=np.zeros(len(m.eigenvalues)), where=m.eigenvalues > 0)
        total = np.array(m.total, dtype=object)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                x = matrix(part.column(1), width)
                white = (centred(x, m.n, m.total) @ m.axes) * scale
                span = int(np.abs(x).max(initial=0)) * m.n + max(map(abs, m.total), default=0)
                if span * span * width < 1 << 63:
                    gap = x * m.n - np.array(m.total, dtype=np.int64)
                    deviation = pa.array((gap * gap).sum(axis=1))
                else:
                    exact = [int(sum(g * g for g in row)) for row in (x.astype(object) * m.n - total)]
                    deviation = pa.array([d if d < 1 << 63 else None for d in exact], pa.int64())
                dead = np.broadcast_to(m.eigenvalues <= 0, white.shape).ravel()
                each = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * white.shape[1]), pa.array(white.ravel(), mask=dead))
                yield pa.RecordBatch.from_arrays([part.column(0), deviation, each], names=["key", "deviation", "whitened"])

    out = StructType([rows.schema["key"], StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))])
    return rows.select("key", "x").mapInArrow(tidy(run), out)


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = MOST, tile: int = TILE) -> tuple[DataFrame, Whitening]:
    """For each row that takes part ``key``, ``deviation`` (the sum over dimensions of (n * x - S)**2, S the sums over the fit list) and
    ``whitened`` (up to ``most`` components), and the whitening itself."""
    rows, width = usable(vectors, key, vector)
    model = fit(rows, width, most, tile)
    return _projected(rows, model, width), model
