"""Benchmark decontamination by suffix arrays of the training texts.

A window is ``window`` consecutive words of a benchmark item; an item of fewer words, but not none, is one window. Words are runs of
bytes other than ASCII punctuation and white space, with A-Z in lower case. The documents are shards (a slice of rows with their whole
texts); each shard sorts its suffixes to a suffix array, every test suffix is binary-searched there to the depth of its window, and
the interval found lists its verbatim occurrences. Occurrences that follow each other are one longer match. A shard
leaves out suffixes whose first words begin no test suffix: no match starts there.

Nothing is exchanged: the benchmark goes to the documents, in blocks of ``BLOCK_WINDOWS`` windows (some 20 MB), one pass for each
block, however large the benchmark is; a document's hits are joined from pass to pass in its own row.

Defined results: null texts and texts without words have no hits; items without words occur nowhere; an item whose id is null marks
words but is in no list; items that share an id count once; an empty benchmark hits nothing; rows that repeat an id are
judged by their own texts; other columns are carried under any name, but one named as the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tesserae.llm.wordhash import Words, buffers, mix, parts, tidy
from tesserae.session import free_name, stored, text_batches

WINDOW = 10
#: Windows, and bytes of item ids, of a block of the benchmark.
BLOCK_WINDOWS = 250_000
BLOCK_IDS = 4 << 20
#: First words by which suffixes are told to begin no test suffix, and bits of the map that tells.
SEED = 3
SEED_BITS = 22

_APART = np.ones(256, dtype=bool)
_APART[48:58] = _APART[97:123] = _APART[128:] = False
FOUND = StructType([
    StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("items", ArrayType(StringType())),
    StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("length", LongType())]))),
])


def words_of(column: pa.Array) -> Words:
    return Words(*buffers(column), lower=True, space=_APART)


@dataclass
class Suffixes:
    """Test suffixes cut at their windows, each once: symbols (0 after the end of a short one), lengths, and the items that have each."""

    known: np.ndarray  # hashes of the benchmark's words, ascending: word i is symbol i + 1
    pattern: np.ndarray  # int32, one row per suffix
    length: np.ndarray
    first: np.ndarray  # items of suffix i: item[first[i]:first[i + 1]]
    item: np.ndarray  # places in ``names``
    names: list[str]
    seed: int
    seeds: np.ndarray


def _seed(symbols: list[np.ndarray]) -> np.ndarray:
    value = symbols[0].astype(np.uint64)
    for s in symbols[1:]:
        value = value * np.uint64(0x9E3779B97F4A7C15) + s.astype(np.uint64)
    return (mix(value) >> np.uint64(64 - SEED_BITS)).astype(np.int64)


def compile_suffixes(items: list[tuple[str | None, np.ndarray]], window: int) -> Suffixes:
    """``items``: id and word hashes, none of them empty."""
    known, symbol = np.unique(np.concatenate([w for _, w in items]), return_inverse=True)
    size = np.array([len(w) for _, w in items])
    begin = np.cumsum(size) - size
    each = np.maximum(size - window + 1, 1)
    which = np.repeat(np.arange(len(items)), each)
    start = np.repeat(begin - (np.cumsum(each) - each), each) + np.arange(each.sum())
    length = np.minimum(size, window)[which]
    padded = np.concatenate((symbol + 1, np.zeros(window, dtype=np.int64))).astype(np.int32)
    at = np.arange(window)
    rows = np.where(at < length[:, None], padded[start[:, None] + at], 0)
    pattern, kind = np.unique(rows, axis=0, return_inverse=True)
    names = sorted({k for k, _ in items if k is not None})
    code = {k: i for i, k in enumerate(names)}
    own = np.array([code.get(k, -1) for k, _ in items])[which]
    pairs = np.unique(np.stack((kind.ravel(), own), axis=1)[own >= 0], axis=0)
    first = np.searchsorted(pairs[:, 0], np.arange(len(pattern) + 1))
    lengths = (pattern > 0).sum(axis=1)
    seed = int(min(SEED, lengths.min()))
    seeds = np.zeros(1 << SEED_BITS, dtype=bool)
    seeds[_seed([pattern[:, i] for i in range(seed)])] = True
    return Suffixes(known, pattern, lengths, first, pairs[:, 1], names, seed, seeds)


def blocks_of(items: Iterable[tuple[str | None, str | None]], window: int = WINDOW, most: int = BLOCK_WINDOWS) -> Iterator[Suffixes]:
    """The test suffixes of ``items`` (id and text), a block at a time. An item that is longer than a block is cut into pieces that
    overlap by a window less a word, so that each of its windows is in one."""
    held, count, size = [], 0, 0
    for name, text in items:
        word = words_of(pa.array([text], pa.string())).hashes()
        step = max(most, 1)
        for i in range(0, max(1, len(word) - window + 1), step):
            piece = word[i : i + step + window - 1]
            if len(piece):
                held.append((name, piece))
                count, size = count + max(1, len(piece) - window + 1), size + len(name or "")
            if count >= most or size >= BLOCK_IDS:
                yield compile_suffixes(held, window)
                held, count, size = [], 0, 0
    if held:
        yield compile_suffixes(held, window)


def _packed(symbols: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Keys that compare as the symbols do, first symbols first."""
    per = max(1, 62 // bits)
    keys = []
    for i in range(0, len(symbols), per):
        key = np.zeros(len(symbols[0]), dtype=np.int64)
        for s in symbols[i : i + per]:
            key = key << bits | s
        keys.append(key)
    return keys


class SuffixArray:
    """The suffixes of ``text`` (symbols; 0 is like no other) that start at ``places``, sorted by their first ``depth`` symbols."""

    def __init__(self, text: np.ndarray, places: np.ndarray, depth: int, symbols: int):
        self.bits = max(1, int(symbols).bit_length())
        self.depth = depth
        padded = np.concatenate((text, np.zeros(depth, dtype=text.dtype)))
        keys = _packed([padded[places + i] for i in range(depth)], self.bits)
        order = np.lexsort((places, *reversed(keys)))
        self.places, self.keys = places[order], [k[order] for k in keys]

    def _bound(self, keys: list[np.ndarray], right: bool) -> np.ndarray:
        """How many suffixes sort before each pattern (or, ``right``, up to it), by binary search of all patterns at once."""
        low, high = np.zeros(len(keys[0]), dtype=np.int64), np.full(len(keys[0]), len(self.places), dtype=np.int64)
        for _ in range(int(len(self.places)).bit_length()):
            middle = np.minimum((low + high) >> 1, max(0, len(self.places) - 1))
            less, same = np.zeros(len(low), dtype=bool), np.ones(len(low), dtype=bool)
            for own, given in zip(self.keys, keys):
                x = own[middle]
                less |= same & (x < given)
                same &= x == given
            go = (less | same if right else less) & (low < high)
            high = np.where(go | (low >= high), high, middle)
            low = np.where(go, middle + 1, low)
        return low

    def find(self, pattern: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that start with each pattern: rows of ``depth`` symbols, of which ``length`` count."""
        after = np.arange(self.depth) >= length[:, None]
        columns = lambda m: _packed([m[:, i].astype(np.int64) for i in range(self.depth)], self.bits)
        return self._bound(columns(np.where(after, 0, pattern)), False), self._bound(columns(np.where(after, (1 << self.bits) - 1, pattern)), True)


def occurrences(words: Words, test: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of the test suffixes in the texts of a shard: the suffix, and the word at which it starts."""
    none = np.zeros(0, dtype=np.int64)
    if not len(words):
        return none, none
    value = words.hashes()
    at = np.searchsorted(test.known, value)
    at[at == len(test.known)] = 0
    symbol = np.where(test.known[at] == value, at + 1, 0)
    # A symbol that is in no suffix stands between two texts, so that no match crosses from one into the other.
    owner = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    spot = np.arange(len(value)) + owner
    depth = test.pattern.shape[1]
    text = np.zeros(len(value) + len(words.first) + depth, dtype=np.int64)
    text[spot] = symbol
    open_ = np.flatnonzero(text)
    near = [text[open_ + i] for i in range(test.seed)]
    keep = test.seeds[_seed(near)]
    for s in near[1:]:
        keep &= s > 0
    places = open_[keep]
    if not len(places):
        return none, none
    array = SuffixArray(text, places, depth, len(test.known) + 1)
    low, high = array.find(test.pattern, test.length)
    count = high - low
    which = np.repeat(np.arange(len(count)), count)
    found = array.places[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())]
    return which, np.searchsorted(spot, found)


def _hits(words: Words, test: Suffixes, before: pa.StructArray | None) -> pa.StructArray:
    """What is found in each text, with what was found ``before``."""
    n = len(words.first) - 1
    which, at = occurrences(words, test)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + test.length[which], -1)
    owner = np.searchsorted(words.first, at, side="right") - 1
    pairs = np.unique(owner * len(test.pattern) + which)
    row, kind = pairs // len(test.pattern), pairs % len(test.pattern)
    each = test.first[kind + 1] - test.first[kind]
    own = np.repeat(row, each)
    item = test.item[np.repeat(test.first[kind] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
    listed = np.unique(own * max(1, len(test.names)) + item)
    names: list[list[str]] = [[] for _ in range(n)]
    for i, k in zip((listed // max(1, len(test.names))).tolist(), (listed % max(1, len(test.names))).tolist()):
        names[i].append(test.names[k])
    if before is not None:
        spans = before.field("spans")
        sizes = np.asarray(spans.value_lengths().fill_null(0), dtype=np.int64)
        start, length = (np.asarray(x, dtype=np.int64) for x in spans.flatten().flatten())
        start = start + np.repeat(words.first[:-1], sizes)
        np.add.at(change, start, 1)
        np.add.at(change, start + length, -1)
        names = [sorted({*a, *b}) for a, b in zip(names, before.field("items").to_pylist())]
    hit = np.cumsum(change)[:-1] > 0
    total = np.concatenate(([0], np.cumsum(hit)))
    edge = np.zeros(len(hit) + 1, dtype=bool)
    edge[words.first] = True  # spans end with their text
    old = np.concatenate(([False], hit[:-1])) & ~edge[:-1] if len(hit) else hit
    begin = np.flatnonzero(hit & ~old)
    following = np.concatenate((hit[1:], [False])) & ~edge[1:] if len(hit) else hit
    end = np.flatnonzero(hit & ~following) + 1
    mine = np.searchsorted(words.first, begin, side="right") - 1
    offsets = np.searchsorted(mine, np.arange(n + 1)).astype(np.int32)
    each_span = pa.StructArray.from_arrays([pa.array(begin - words.first[mine], pa.int64()), pa.array(end - begin, pa.int64())], names=["start", "length"])
    return pa.StructArray.from_arrays(
        [pa.array(np.diff(words.first), pa.int64()), pa.array(total[words.first[1:]] - total[words.first[:-1]], pa.int64()), pa.array(names, pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(offsets), each_span)],
        names=["n_words", "n_hit", "items", "spans"],
    )


def find_matches(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None, found: str = "_found", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The columns ``keep`` of ``documents`` (all, if None) with ``found``: n_words, n_hit, the items that occur (as strings, in
    order) and the spans of hit words, each of one or more matches that touch or overlap."""
    spark = documents.sparkSession
    text_batches(spark)
    kept = [c for c in (documents.columns if keep is None else keep) if c != found]
    asked = benchmark.select(F.col(f"`{item}`").cast("string").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t"))
    body, before = F.col(f"`{text}`").cast("string").alias("b"), F.lit(None).cast(FOUND).alias("f")
    own = lambda c: F.col(f"`{c}`")
    rows = documents.select(body, before, F.struct(*(own(c) for c in kept)).alias("own")) if kept else documents.select(body, before, F.lit(1).alias("own"))
    blocks = blocks_of(((r["i"], r["t"]) for r in asked.toLocalIterator()), window, block_windows)
    now, after = next(blocks, None), next(blocks, None)
    if now is None:
        now = compile_suffixes([(None, np.zeros(1, dtype=np.uint64))], window)  # a word that no text has
    while now is not None:
        rows = _pass(rows, now, last=after is None)
        if after is not None:
            rows = stored(rows, "matched")
        now, after = after, next(blocks, None) if after is not None else None
    return rows.select(*([F.col("own")[c].alias(c) for c in kept]), F.col("f").alias(found))


def _pass(rows: DataFrame, test: Suffixes, last: bool) -> DataFrame:
    """What one block's suffixes hit, beside what was hit before; the ``last`` pass leaves the texts."""
    shared = rows.sparkSession.sparkContext.broadcast(test)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 0, 1 << 20):
            before = part.column(1)
            made = _hits(words_of(part.column(0)), shared.value, None if before.null_count == len(before) else before)
            yield pa.RecordBatch.from_arrays([made, part.column(2)] if last else [part.column(0), made, part.column(2)], names=["f", "own"] if last else ["b", "f", "own"])

    fields = [f for f in rows.schema.fields if not last or f.name != "b"]
    return rows.mapInArrow(tidy(run), StructType(fields))


def decontaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with their own columns."""
    name = free_name(documents, "_found")
    return find_matches(documents, benchmark, found=name, **options).filter(F.col(name)["n_hit"] == 0).drop(name)
