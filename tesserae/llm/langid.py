"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes a single space, and runs of one to three characters are hashed to
a fixed number of features. Weights are learned by follow-the-regularised-leader (per-coordinate steps, L1 and L2
penalties: coordinates with too little evidence stay exactly zero), and a temperature, set on rows kept out of the
weights' training, calibrates the probabilities.

Defined results: a null text, or one without a letter, is ``und`` with score 0; rows with a null language are not
learned from; with one language only, every text with a letter gets it; ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tesserae.llm.wordhash import tidy
from tesserae.operators.skew import lookup_join, semi_join
from tesserae.session import bundled, stored, text_batches, unbundled

UNDETERMINED = "und"
FEATURES = 1 << 14
SLICE_CHARS = 400_000
SLICE_ROWS = 64
_TABLE: dict[str, np.ndarray] = {}


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def _fold() -> np.ndarray:
    """By code point: its lower-case letter, or the space. Characters whose lower case is longer keep its first."""
    if "fold" not in _TABLE:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                table[c] = ord(s.lower()[0])
        _TABLE["fold"] = table
    return _TABLE["fold"]


def tf_matrix(texts: list[str], features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Sublinear counts of the hashed n-grams (rows: texts), and whether each text has a letter."""
    parts = [np.frombuffer(t.encode("utf-32-le", "replace"), dtype=np.uint32) for t in texts]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    joined = np.full(int(sizes.sum()) + len(texts), 32, dtype=np.uint32)
    at = 0
    for p in parts:
        joined[at : at + len(p)] = p
        at += len(p) + 1
    code = _fold()[joined]
    keep = code != 32
    keep[1:] |= code[:-1] != 32  # one space after each word
    code, owner = code[keep].astype(np.uint64), owner[keep]
    letters = np.bincount(owner[code != 32], minlength=len(texts)) > 0
    total = np.zeros(len(texts) * features, dtype=np.float32)
    value = np.zeros(len(code), dtype=np.uint64)
    for n in (1, 2, 3):
        m = len(code) - n + 1
        if m <= 0:
            break
        value = (value[:m] + code[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
        cell = ((value * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.int64) % features
        same = owner[:m] == owner[n - 1 :]
        total += np.bincount((owner[:m] * features + cell)[same], minlength=len(total)).astype(np.float32)
    return np.log1p(total).reshape(len(texts), features), letters


def _weigh(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = tf * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Ftrl:
    """FTRL-proximal for a softmax over dense mini-batches of sparse rows."""

    def __init__(self, features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-4):
        self.z = np.zeros((features, classes))
        self.n = np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self) -> np.ndarray:
        shrunk = np.sign(self.z) * np.maximum(np.abs(self.z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(self.n)) / self.alpha + self.l2)

    def step(self, x: np.ndarray, target: np.ndarray) -> None:
        w = self.weights()
        g = x.T @ (_softmax(x @ w) - target) / len(x)
        sigma = (np.sqrt(self.n + g * g) - np.sqrt(self.n)) / self.alpha
        self.z += g - sigma * w
        self.n += g * g


def fit(texts: list[str], languages: list[str], features: int = FEATURES, epochs: int = 6, batch: int = 16, kept_out: float = 0.2, seed: int = 7) -> LanguageModel:
    """Trains on the given rows. A share ``kept_out`` of them sets the temperature only."""
    names = tuple(sorted(set(languages)))
    code = np.array([names.index(x) for x in languages], dtype=np.int64)
    if len(names) < 2:
        return LanguageModel(names, np.ones(features), np.zeros((features, len(names))), np.zeros(len(names)), 1.0)
    order = np.random.default_rng(seed).permutation(len(texts))
    rows: list[tuple[np.ndarray, np.ndarray]] = []  # cells and counts of each text: the matrix is never whole
    for i in range(0, len(texts), SLICE_ROWS):
        tf, _ = tf_matrix(texts[i : i + SLICE_ROWS], features)
        for row in tf:
            cells = np.flatnonzero(row).astype(np.int32)
            rows.append((cells, row[cells]))
    cut = max(1, int(len(order) * (1 - kept_out)))
    train, held = order[:cut], order[cut:]
    df = np.zeros(features)
    for i in train:
        df[rows[i][0]] += 1
    idf = (np.log((1 + len(train)) / (1 + df)) + 1).astype(np.float32)

    def dense(places: np.ndarray) -> np.ndarray:
        x = np.zeros((len(places), features + 1))
        for n, i in enumerate(places):
            cells, tf = rows[i]
            value = tf * idf[cells]
            x[n, cells] = value / max(float(np.sqrt((value * value).sum())), 1e-9)
        x[:, -1] = 1.0
        return x

    target = np.eye(len(names))[code]
    learner = Ftrl(features + 1, len(names))
    rng = np.random.default_rng(seed + 1)
    for _ in range(epochs):
        for places in np.array_split(rng.permutation(train), max(1, len(train) // batch)):
            learner.step(dense(places), target[places])
    w = learner.weights()
    temperature = 1.0
    if len(held):
        logits = np.concatenate([dense(held[i : i + SLICE_ROWS]) @ w for i in range(0, len(held), SLICE_ROWS)])
        grid = np.geomspace(0.02, 5, 80)
        loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(held)), code[held]], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return LanguageModel(names, idf, w[:-1].astype(np.float32), w[-1], temperature)


def train(documents: DataFrame, per_language: int = 600, most: int = 6000, least: int = 20, longest: int = 100_000, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fits on a bounded sample: about ``per_language`` documents of every language, fewer if they were more than ``most`` in all, but
    never fewer than ``least`` of a language that has so many; chosen by the hash of the key against a threshold from the
    languages' full counts. Texts of over ``longest`` characters are not learned from, so the sample is bounded in bytes too."""
    rows = documents.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l"))
    known = rows.filter((F.col("l").isNotNull()) & F.col("t").isNotNull() & (F.length("t") <= longest))
    count = known.groupBy("l").agg(F.count("*").alias("n"))
    found = max(1, count.count())
    per_language = max(1, least, min(per_language, most // found))
    share = F.pmod(F.xxhash64(F.lit("langid"), "k"), F.lit(1_000_003)) / 1_000_003.0
    light = lookup_join(known.select("k", "l"), count.withColumn("w", F.col("n")), "l", "w", spread=F.xxhash64("k"), rows=found)
    order = Window.partitionBy("l").orderBy(share, "k")
    ranked = light.filter(share < F.least(F.lit(1.0), F.lit(1.5 * per_language) / F.col("n"))).withColumn("r", F.row_number().over(order))
    picked = stored(ranked.filter(F.col("r") <= per_language).select("k").distinct(), "picked")  # the texts stay where they are
    got = semi_join(known, [F.col("k")], picked).select("l", "t", share.alias("h")).orderBy("h", "l", "t").limit(2 * per_language * found).collect()
    seen: dict[str, int] = {}
    kept = []
    for r in got:
        seen[r["l"]] = seen.get(r["l"], 0) + 1
        if seen[r["l"]] <= per_language:
            kept.append((r["t"], r["l"]))
    return fit([t for t, _ in kept], [l for _, l in kept])


def predict(documents: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` (the calibrated probability of that language), for every row; no exchange. With
    ``carry`` all columns of ``documents`` come along, under any names (those named ``lang_pred`` or ``score`` are replaced)."""
    text_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in documents.columns if c.lower() not in ("lang_pred", "score")] if carry else [key]
    rows = documents.select(bundled(documents, kept).alias("own"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            best, sure, i = np.full(len(texts), len(m.languages)), np.zeros(len(texts)), 0
            while i < len(texts):
                j, chars = i, 0
                while j < len(texts) and j - i < SLICE_ROWS and (j == i or chars + len(texts[j]) <= SLICE_CHARS):
                    chars += len(texts[j])
                    j += 1
                tf, letters = tf_matrix(texts[i:j], len(m.idf))
                if len(m.languages):
                    p = _softmax((_weigh(tf, m.idf) @ m.weights + m.bias) / m.temperature)
                    best[i:j] = np.where(letters, p.argmax(axis=1), len(m.languages))
                    sure[i:j] = np.where(letters, p.max(axis=1), 0.0)
                i = j
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(sure)], names=["own", "lang_pred", "score"])

    found = rows.mapInArrow(tidy(run), StructType([rows.schema["own"], StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
    return found.select(*unbundled("own", kept), "lang_pred", "score")
