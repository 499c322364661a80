"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled text. Every text is cut into blocks and
each block is compressed with either dictionary: what resembles good text gets smaller with the good dictionary. The
size difference, divided by the text's bytes, is the evidence; a logistic calibration turns it into a probability.
Blocks keep the dictionaries in reach over the whole of a long text, and let a junk passage show in a long text
(the least difference of a block is a second reading of the same evidence). Text that any dictionary shrinks to almost
nothing has almost no difference to show, whatever it is worth: the compressed share of the bytes, which is what the
difference is a part of, enters the calibration too. The README has the accuracy with and without it.

Defined results: a null or empty text has no evidence and gets the score of evidence zero; labels that are null or
neither 0 nor 1 are not learned from; several labels of one document all count; repeated documents are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tesserae.llm.wordhash import tidy
from tesserae.session import bundled, text_batches, unbundled

BLOCK = 1024
LEVEL = 3
SHORTEST = 256


@dataclass(frozen=True)
class CompressionModel:
    """Dictionaries, and the calibration: weights of the standardised readings."""

    good: bytes
    bad: bytes
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    block: int = BLOCK
    level: int = LEVEL


def _blocks(text: bytes, size: int) -> list[bytes]:
    """Blocks of ``size`` bytes; a short rest stays with the block before it."""
    n = max(1, (len(text) - SHORTEST) // size + 1) if len(text) > size else 1
    cuts = [i * size for i in range(n)] + [len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


class _Reader:
    """Turns texts into readings; holds the compressors of one process."""

    def __init__(self, good: bytes, bad: bytes, block: int, level: int):
        self.block, self.tools = block, []
        for data in (good, bad):
            dictionary = zstandard.ZstdCompressionDict(data)
            dictionary.precompute_compress(level=level)
            self.tools.append(zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[float, float, float, float]:
        data = (text or "").encode("utf-8", "replace")
        if not data:
            return 0.0, 0.0, 0.0, 0.0
        total = [0, 0]
        least = None
        share = None
        for part in _blocks(data, self.block):
            sizes = [len(tool.compress(part)) for tool in self.tools]
            total[0] += sizes[0]
            total[1] += sizes[1]
            gap = (sizes[1] - sizes[0]) / len(part)
            if len(part) >= SHORTEST or least is None:
                least = gap if least is None else min(least, gap)
                rate = min(sizes) / len(part)
                share = rate if share is None else min(share, rate)
        return (total[1] - total[0]) / len(data), least, min(total) / len(data), share


def _expand(readings: np.ndarray) -> np.ndarray:
    """The calibration sees the readings, and how far the compressed share lies below ordinary text."""
    d, least, rate, share = readings.T
    return np.stack([d, least, rate, share, np.log(np.maximum(share, 0.01))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last weight is the constant."""
    a = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge * w.sum() / max(1, len(w)))
    penalty[-1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (w * (p - y)) + penalty * beta
        curve = (a * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def train(
    documents: DataFrame, labels: DataFrame, sample: int = 1500, dictionary_bytes: int = 112_640, block: int = BLOCK, level: int = LEVEL, longest: int = 100_000, key: str = "doc_id", text: str = "text", label: str = "quality"
) -> CompressionModel:
    """Fits the model on a bounded sample: at most ``sample`` documents of each label build the dictionaries, and as many
    again set the calibration. The sample is the lowest hashes of the key, so it is the same for any partitioning. Texts of over
    ``longest`` characters are not learned from, and of documents that repeat a key no more than the sample's size in all.
    The labels' shares are counted over all labels given, and weigh the calibration back to them."""
    known = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).filter("y in (0, 1) and k is not null")
    share = {int(r["y"]): int(r["n"]) for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).dropDuplicates(["k"]).orderBy(F.xxhash64(F.lit("quality"), "k"), "k").limit(2 * sample)
        picked = part if picked is None else picked.unionByName(part)
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(picked), "k").filter(F.length("t").between(1, longest)).select("y", "t", F.xxhash64(F.lit("quality"), "k").alias("h")).orderBy("h", "t").limit(4 * sample).collect()
    rows.sort(key=lambda r: (r["h"], r["t"]))
    texts = {y: [r["t"].encode("utf-8", "replace") for r in rows if r["y"] == y] for y in (0, 1)}
    if not texts[0] or not texts[1]:
        # One label only: nothing to compare. The score is that label's share everywhere.
        p = (1 + share.get(1, 0)) / (2 + sum(share.values()))
        empty = zstandard.ZstdCompressionDict(b" " * 64, dict_type=zstandard.DICT_TYPE_RAWCONTENT).as_bytes()
        return CompressionModel(empty, empty, (0.0,) * 5, (1.0,) * 5, (0.0,) * 5 + (float(np.log(p / (1 - p))),), block, level)
    built: dict[int, bytes] = {}
    rest: dict[int, list[bytes]] = {}
    for y in (0, 1):
        half = max(1, len(texts[y]) // 2)
        rest[y] = texts[y][half:] or texts[y]
        parts = [b for t in texts[y][:half] for b in _blocks(t, block)]
        try:
            built[y] = zstandard.train_dictionary(dictionary_bytes, parts).as_bytes()
        except zstandard.ZstdError:  # too little text for a trained one
            built[y] = (b" " * 8 + b" ".join(parts))[-dictionary_bytes:]
    read = _Reader(built[1], built[0], block, level)
    x = _expand(np.array([read(t.decode("utf-8", "replace")) for y in (0, 1) for t in rest[y]]))
    target = np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])])
    weight = np.repeat([share[0] / len(rest[0]), share[1] / len(rest[1])], [len(rest[0]), len(rest[1])])
    weight *= len(weight) / weight.sum()
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    beta = _logistic((x - centre) / scale, target, weight)
    return CompressionModel(built[1], built[0], tuple(map(float, centre)), tuple(map(float, scale)), tuple(map(float, beta)), block, level)


def score(documents: DataFrame, model: CompressionModel, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """``key`` and ``score``: the calibrated probability of the good label, for every row. With ``carry`` all columns of
    ``documents`` come along, under any names (one named ``score`` is replaced). No exchange: one pass over the texts."""
    text_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in documents.columns if c.lower() != "score"] if carry else [key]
    rows = documents.select(bundled(documents, kept).alias("own"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        read = _Reader(m.good, m.bad, m.block, m.level)
        for batch in batches:
            own, texts = batch.columns
            x = _expand(np.array([read(t.as_py()) for t in texts]).reshape(-1, 4))
            z = ((x - np.array(m.centre)) / np.array(m.scale)) @ np.array(m.weights[:-1]) + m.weights[-1]
            yield pa.RecordBatch.from_arrays([own, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["own", "score"])

    scored = rows.mapInArrow(tidy(run), StructType([rows.schema["own"], StructField("score", DoubleType())]))
    return scored.select(*unbundled("own", kept), "score")
