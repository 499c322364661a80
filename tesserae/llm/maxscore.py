"""Exact top-k search by inner product with MaxScore.

Dimensions are terms and a vector's values its term weights. Vectors that are equal are one candidate that carries its
smallest ids, so copies cost nothing; equal query vectors are one query too. Candidates are dealt into shards, queries into
blocks, and each pair of a shard and a block is searched by itself, then the shards' lists are merged. Shards and blocks
are as large as a worker's memory allows: a candidate is copied once for each block, and a query has a list from each shard.

In a shard, a query's terms are ordered by the spread of their contributions (the upper less the lower bound of weight
times value over the shard). The terms of least spread whose spreads sum to less than what the current k-th score
demands are non-essential: without essential terms no candidate gets there. The essential terms are traversed for all
candidates; the others are probed, the widest first, only for candidates whose partial score plus the remaining upper
bounds still competes. Bounds are exact integers, and a candidate that could tie is kept, so the result is exact.

Defined results: vectors that are null or hold a null or non-finite component, and rows without an id, take no part; a
shorter vector counts as padded with zeros; rows that repeat both id and vector count once, as candidates and as queries; rows
that share an id and have unlike vectors are candidates and queries of their own, and none of them is a hit of another; ties
go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.skew import lookup_join
from tesserae.session import stored

SHARD_ROWS = 32_768
LEAST_ROWS = 4096
BLOCK_QUERIES = 8192
SEED_ROWS = 256
_RESULT = pa.schema([("qid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component as a double; null unless all are finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(finite, F.transform(x, lambda v: F.floor(v * factor).cast("long")))


def _dense(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to ``width``."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
    flat = np.asarray(lists.flatten(), dtype=np.int64)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Shard:
    """Candidates of one shard, by term, with each term's bounds."""

    def __init__(self, values: np.ndarray):
        # Products of doubles are exact far beyond these integers, and much faster.
        limit = float(np.abs(values).max(initial=0))
        self.kind = np.float64 if limit * limit * max(1, values.shape[1]) < 2**52 else object
        self.x = values.astype(self.kind)
        self.terms = np.ascontiguousarray(self.x.T)
        self.low = self.x.min(axis=0) if len(values) else np.zeros(values.shape[1])
        self.high = self.x.max(axis=0) if len(values) else np.zeros(values.shape[1])
        self.probed = 0

    def top(self, query: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all candidates that may be among the first ``k``, where a candidate counts for ``weight`` ids."""
        q = query.astype(self.kind)
        a, b = q * self.low, q * self.high
        lower, upper = np.minimum(a, b), np.maximum(a, b)
        spread = upper - lower
        order = np.argsort(spread, kind="stable")[::-1]
        order = order[spread[order] > 0] if self.kind is not object else order
        fixed = (lower.sum() - lower[order].sum()) if len(order) < len(q) else 0  # terms alike in all candidates
        seed = min(SEED_ROWS, len(self.x))
        first = self.x[:seed] @ q
        threshold = self._kth(first, weight[:seed], k)
        places, scores = [np.arange(seed)], [first]
        if seed < len(self.x):
            rest = np.arange(seed, len(self.x))
            # Non-essential: the largest set of narrowest terms whose upper bounds can't reach the threshold alone.
            slack = threshold - fixed - lower[order].sum()
            narrow = np.cumsum(spread[order][::-1])
            essential = len(order) - int(np.searchsorted(narrow, slack, side="left")) if np.isfinite(float(slack)) else len(order)
            essential = max(0, min(len(order), essential))
            remaining = np.concatenate([np.cumsum(upper[order][::-1])[::-1], [0]])
            head = order[:essential]
            partial = fixed + (self.terms[head, seed:].T @ q[head] if essential else np.zeros(len(rest)))
            at = essential
            alive = partial + remaining[at] >= threshold
            rest, partial = rest[alive], partial[alive]
            while at < len(order) and len(rest):
                step = order[at : at + 4]
                self.probed += len(rest) * len(step)
                partial = partial + self.terms[step][:, rest].T @ q[step]
                at += len(step)
                alive = partial + remaining[at] >= threshold
                rest, partial = rest[alive], partial[alive]
            places.append(rest)
            scores.append(partial)
        place, score = np.concatenate(places), np.concatenate(scores)
        keep = score >= self._kth(score, weight[place], k)
        return place[keep], score[keep].astype(np.int64)

    @staticmethod
    def _kth(score: np.ndarray, weight: np.ndarray, k: int) -> float:
        order = np.argsort(-score, kind="stable")
        reached = np.flatnonzero(np.cumsum(weight[order]) >= k)
        return score[order[reached[0]]] if len(reached) else -np.inf


def _search(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    if not len(queries) or not len(candidates):
        return _RESULT.empty_table()
    width = max(int(pc.max(t["vec"].combine_chunks().value_lengths()).as_py() or 0) for t in (queries, candidates))
    candidates = candidates.sort_by("vid")
    shard = Shard(_dense(candidates["vec"], width))
    lists = candidates["ids"].combine_chunks()
    weight, flat = np.asarray(lists.value_lengths(), dtype=np.int64), np.asarray(lists.flatten())
    start = np.concatenate(([0], np.cumsum(weight)))
    asked = _dense(queries["vec"], width)
    out: list[tuple[int, int, int]] = []
    for qid, own, q in zip(queries["qid"].to_pylist(), queries["own"].to_pylist(), asked):
        others = weight
        if own is not None:  # candidates' ids without the query's own
            others = weight - np.bincount(np.searchsorted(start, np.flatnonzero(flat == own), side="right") - 1, minlength=len(weight))
        place, score = shard.top(q, others, k)
        found = sorted((-int(s), i) for p, s in zip(place.tolist(), score.tolist()) for i in flat[start[p] : start[p + 1]].tolist() if i != own)[:k]
        out += [(qid, i, -s) for s, i in found]
    qids, vecs, scores = zip(*out) if out else ((), (), ())
    return pa.table([pa.array(qids, pa.int64()), pa.array(vecs, pa.int64()), pa.array(scores, pa.int64())], schema=_RESULT)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int | None = None, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each row of ``queries`` (``query_id``, ``vec``) its ``k`` best rows of
    ``vectors`` (``vec_id``, ``vec``; arrays of longs), leaving out those with the query's own id."""
    spark = vectors.sparkSession
    want = k + 1  # one may be the query's own
    alike = Window.partitionBy("vec").orderBy("vec_id")
    usable = vectors.filter("vec is not null and vec_id is not null").select("vec_id", "vec").distinct()
    few = usable.withColumn("r", F.row_number().over(alike)).filter(F.col("r") <= want)
    classes = stored(few.groupBy("vec").agg(F.min("vec_id").alias("vid"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes")
    # A query whose id several candidates share is asked by itself: its search must pass over all of them.
    repeated = stored(usable.groupBy("vec_id").agg(F.count("*").alias("m")).filter("m > 1").withColumn("again", F.lit(True)), "repeated")
    rows = queries.filter("vec is not null and query_id is not null").select("query_id", "vec").distinct()
    asked = lookup_join(rows, repeated.withColumnRenamed("vec_id", "query_id"), "query_id", "m", spread=F.xxhash64("vec")).select("query_id", "vec", F.when(F.col("again"), F.col("query_id")).alias("own"))
    grouped = asked.groupBy("vec", "own").agg(F.count("*").alias("n"))
    kinds = stored(grouped.withColumn("qid", F.monotonically_increasing_id()), "queries")  # the numbers are those written
    n_classes, n_kinds = classes.count(), kinds.count()
    if shard_rows is None:
        shard_rows = min(SHARD_ROWS, max(LEAST_ROWS, n_classes // (2 * spark.sparkContext.defaultParallelism)))
    shards, blocks = max(1, -(-n_classes // shard_rows)), max(1, -(-n_kinds // block_queries))
    spread = classes.select("vec", "vid", "ids", F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    dealt = kinds.select("vec", "qid", "own", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        return _search(q, c, want)

    found = dealt.groupBy("shard", "block").cogroup(spread.groupBy("shard", "block")).applyInArrow(run, "qid long, vec_id long, score long")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    merged = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= want).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("hits"))
    what = F.struct("vec", F.col("own").isNull().alias("free"), F.coalesce("own", F.lit(0).cast("long")).alias("own"))
    answers = kinds.join(merged, "qid").select(what.alias("what"), "n", "hits")
    answered = lookup_join(asked.select("query_id", what.alias("what")), answers, "what", "n", spread=F.col("query_id"), rows=n_kinds)
    others = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    hits = answered.filter("hits is not null").select("query_id", F.posexplode(others).alias("at", "hit"))
    return hits.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
