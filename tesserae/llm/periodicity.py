"""Periodic runs of words: maximal stretches that repeat their first ``q`` words three times and more.

A run is a stretch of consecutive words with smallest period q, of at least ``max(least, repeats * q)`` words, that no neighbouring word
extends keeping the period. They are found on a harmonic grid: for each period p, the words at jp and (j+1)p are compared by their
longest common extensions (LCE) forward and backward. A run of period p covers one of these pairs at least, and the two
extensions give its whole stretch. LCEs are asked of a suffix array with its array of common prefixes under range-minimum tables, and
of the same for the reversed words. A stretch found at a multiple of its period is told by having the same ends.

Texts are handled a slice at a time, as one sequence whose words are like those of their own text only, so no extension leaves a text.
A text in which no ``least - least // repeats`` consecutive words come twice holds no run and isn't sorted. (A run of period q has
at least that many words that match those q further on.) Everything is narrow: no row is exchanged.

Defined results: null texts and texts without words have no runs, and the collapsed text of no words is empty; rows that repeat a key
are judged by their own texts; other columns are carried under any name, but one named as the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tesserae.llm.wordhash import Words, buffers, parts, tidy, window_hash
from tesserae.session import text_batches

LEAST, REPEATS = 24, 3
#: Pairs of the grid that are compared at once.
PAIRS = 1 << 20
RUN = StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("period", LongType())])
FOUND = StructType([StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("text", StringType())])


class Extensions:
    """Longest common extensions to the right in ``symbol``: suffix array by doubling, common prefixes of neighbours in it, and tables
    of their minima over ranges of 1, 2, 4, ... neighbours."""

    def __init__(self, symbol: np.ndarray):
        n = len(symbol)
        rank = symbol.astype(np.int64)
        levels, span = [rank.astype(np.int32)], 1
        while True:
            after = np.zeros(n, dtype=np.int64)
            after[: max(0, n - span)] = rank[span:] + 1
            key = rank * (n + 2) + after
            suffixes = np.argsort(key)
            ordered = key[suffixes]
            rank = np.zeros(n, dtype=np.int64)
            rank[suffixes[1:]] = np.cumsum(ordered[1:] != ordered[:-1])
            if n == 0 or rank[suffixes[-1]] == n - 1:
                break
            span *= 2
            levels.append(rank.astype(np.int32))
        self.rank = rank.astype(np.int32)
        # Common prefixes of neighbours: the ranks by 2**k symbols, longest first, tell 2**k symbols at a time.
        a, b = suffixes[:-1].copy(), suffixes[1:].copy()
        prefix = np.zeros(max(0, n - 1), dtype=np.int32)
        for k in reversed(range(len(levels))):
            inside = np.maximum(a, b) + (1 << k) <= n
            same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
            step = same.astype(np.int64) << k
            a, b = a + step, b + step
            prefix += step.astype(np.int32)
        del levels
        self.least = [prefix]
        width = 1
        while 2 * width <= len(prefix):
            last = self.least[-1]
            self.least.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i on are those from j on; i and j differ."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b).astype(np.int64), np.maximum(a, b).astype(np.int64)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.zeros(len(low), dtype=np.int64)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.least[k][low[own]], self.least[k][high[own] - (1 << int(k))])
        return out


def grid(size: np.ndarray, least: int, repeats: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, period and place jp of the pairs (jp, (j+1)p) in texts of ``size`` words, about ``PAIRS`` at a time. A run of period p has at
    least m = max(least, repeats * p) - p places whose word comes again p further on: of each m consecutive places, one is taken."""
    for t, n in enumerate(size.tolist()):
        period = np.arange(1, n // repeats + 1)
        period = period[np.maximum(least, repeats * period) <= n]
        if not len(period):
            continue
        step = (np.maximum(least, repeats * period) - period) // period * period
        count = (n - period - 1) // step + 1
        ends = np.cumsum(count)
        at = 0
        while at < len(period):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            c = count[at:stop]
            j = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            yield np.full(len(j), t), np.repeat(period[at:stop], c), j * np.repeat(step[at:stop], c)
            at = stop


def _gathered(size: np.ndarray, least: int, repeats: int) -> Iterator[tuple[np.ndarray, ...]]:
    held, n = [], 0
    for piece in grid(size, least, repeats):
        held.append(piece)
        n += len(piece[0])
        if n >= PAIRS:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def suspects(value: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Texts in which some ``width`` consecutive words come twice."""
    gram = window_hash(value, width)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.flatnonzero(owner[: len(gram)] == owner[width - 1 :]) if len(gram) else np.zeros(0, dtype=np.int64)
    gram, owner = gram[start], owner[start]
    # Equal hashes of one text are neighbours once a hash of both is sorted.
    both = gram ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(both)
    again = both[order[1:]] == both[order[:-1]]
    return np.unique(owner[order[1:][again]])


def find_runs(value: np.ndarray, first: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> np.ndarray:
    """Runs as rows (text, start, length, period), in that order, of texts whose words are ``value[first[i]:first[i + 1]]``."""
    none = np.zeros((0, 4), dtype=np.int64)
    texts = suspects(value, first, least - least // repeats)
    if not len(texts):
        return none
    size = first[texts + 1] - first[texts]
    begin = np.cumsum(size) - size
    word = value[np.repeat(first[texts] - begin, size) + np.arange(size.sum())]
    # Symbols of a text are like none of another text, and grow with the text: its suffixes are together in the array.
    owner = np.repeat(np.arange(len(texts)), size)
    order = np.lexsort((word, owner))
    new = np.concatenate(([False], (word[order[1:]] != word[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])))
    symbol = np.zeros(len(word), dtype=np.int64)
    symbol[order] = np.cumsum(new)
    n = len(symbol)
    forward, backward = Extensions(symbol), Extensions(symbol[::-1])
    found = []
    for text, period, place in _gathered(size, least, repeats):
        i = begin[text] + place
        j = i + period
        same = symbol[i] == symbol[j]
        text, period, i, j = text[same], period[same], i[same], j[same]
        right = forward.common(i, j)
        left = backward.common(n - 1 - i, n - 1 - j) - 1
        length = left + period + right
        long = length >= np.maximum(least, repeats * period)
        found.append(np.stack((text, i - left - begin[text], length, period), axis=1)[long])
    rows = np.unique(np.concatenate([none, *found]), axis=0)
    # A stretch that is found at several periods has the smallest.
    smallest = np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1))) if len(rows) else np.zeros(0, dtype=bool)
    rows = rows[smallest]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    rows[:, 0] = texts[rows[:, 0]]
    return rows


def dropped(runs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The words, of all texts, that a run holds after its first period."""
    change = np.zeros(int(first[-1]) + 1, dtype=np.int64)
    start = first[runs[:, 0]] + runs[:, 1]
    np.add.at(change, start + runs[:, 3], 1)
    np.add.at(change, start + runs[:, 2], -1)
    return np.cumsum(change)[:-1] > 0


def _collapsed(words: Words, text: int, gone: np.ndarray) -> bytes:
    a, b = words.first[text], words.first[text + 1]
    raw = words.data[words.offsets[text] : words.offsets[text + 1]].tobytes()
    if not gone[a:b].any():
        return b" ".join(raw.split())
    return b" ".join(w for w, g in zip(raw.split(), gone[a:b].tolist()) if not g)


def periodic_runs(documents: DataFrame, text: str = "text", least: int = LEAST, repeats: int = REPEATS, keep: list[str] | None = None, found: str = "_periodic") -> DataFrame:
    """The columns ``keep`` of ``documents`` (all, if None) with ``found``: n_words, the runs by start and period, and the words
    that stay once each run is cut to its first period, joined by one space."""
    if repeats < 2 or least < 2:
        raise ValueError("a run repeats its period and has two words at least")
    text_batches(documents.sparkSession)
    kept = [c for c in (documents.columns if keep is None else keep) if c != found]
    own = F.struct(*(F.col(f"`{c}`") for c in kept)) if kept else F.lit(1)
    rows = documents.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("b"), own.alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 0, 1 << 20):
            words = Words(*buffers(part.column(0)))
            runs = find_runs(words.hashes(), words.first, least, repeats)
            gone = dropped(runs, words.first)
            offsets = np.searchsorted(runs[:, 0], np.arange(part.num_rows + 1)).astype(np.int32)
            listed = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in (1, 2, 3)], names=["start", "length", "period"])
            texts = pa.array([_collapsed(words, i, gone).decode("utf-8") for i in range(part.num_rows)], pa.string())
            made = pa.StructArray.from_arrays([pa.array(np.diff(words.first), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), listed), texts], names=["n_words", "runs", "text"])
            yield pa.RecordBatch.from_arrays([made, part.column(1)], names=["f", "own"])

    out = rows.mapInArrow(tidy(run), StructType([StructField("f", FOUND), rows.schema["own"]]))
    return out.select(*([F.col("own")[c].alias(c) for c in kept]), F.col("f").alias(found))
