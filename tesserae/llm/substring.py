"""Removal of passages that an earlier document has, by FM-indexes of shards.

A window is ``window`` consecutive words. To bring equal windows together without comparing documents with each other,
each window is filed under its anchor, one of the runs of ``ANCHOR`` words in it: a rare one before a frequent one (as counted
in a sample), then the one with the lowest hash. Equal windows have equal anchors, and consecutive windows mostly share
theirs, so a document becomes a few runs of windows (``_runs``), and frequent phrases are anchors of frequent passages only.

Equal rows are folded first: documents with equal texts into the one with the smallest key (the others are repeated from end
to end), and runs with the same words into the earliest. An anchor that occurs in two documents sends its runs' words to a
shard of whole anchors. The shard's runs are indexed, and streamed against the index by backward search: their matching
statistics give for every window the interval of its occurrences, hence their smallest document. The answer holds for every
run that was folded into the one that was asked. Runs that share their anchor by chance aren't asked: a window that two of
them have in common reaches half of the other words to the left or to the right of the anchor, and two short hashes of
these words tell. Anchors of more runs than a shard holds are cut into parts, with a shard
for every two parts.

Defined results: null texts have no words; a text of fewer words than a window keeps all; rows that repeat a key never
take words from each other; rows without a key keep all their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tesserae.llm.fmindex import FmIndex
from tesserae.llm.jaccard import whole_groups
from tesserae.llm.wordhash import Words, _powers, buffers, mix, parts, slices, tidy, window_hash
from tesserae.operators.skew import anti_join, lookup_join, semi_join, some_join
from tesserae.session import bundled, discard, free_name, stored, text_batches

WINDOW = 13
ANCHOR = 3
WHOLE = -1  # stands for a span over the whole text
SHARD_RUNS = 20_000
HELD_RUNS = 200_000
#: Runs of one anchor in a part.
PART_RUNS = 50_000
#: Anchors are dealt into so many lots, and the runs of one lot exchanged at a time.
LOTS = 2
#: Phrases held as frequent, and the share of documents that they are counted in.
COMMON = 65_536
SAMPLED = 16


def _mark(text: Column) -> Column:
    """A few bits of the text, to tell rows apart that share a key."""
    return F.shiftrightunsigned(F.xxhash64(text), 40)


def span(start, length):
    """Where a span starts and how many words it has, in one number."""
    return start * 64 + length


def find_runs(words: Words, window: int, anchor: int, common: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows with one anchor: its hash, a hash of the run's words, the text, the first word, the windows, and
    hashes of the words beside the anchor to the left and to the right, as many as one side of a common window must
    reach (0 where the run doesn't). ``common``: hashes of frequent phrases, ascending."""
    value = words.hashes()
    grams = window_hash(value, anchor) >> np.uint64(1)
    if len(common) and len(grams):
        at = np.searchsorted(common, grams)
        at[at == len(common)] = 0
        grams |= (common[at] == grams).astype(np.uint64) << np.uint64(63)
    per = window - anchor + 1
    none = np.zeros(0, dtype=np.int64)
    empty = (none.astype(np.uint64), none.astype(np.uint64), none, none, none, none.astype(np.int32), none.astype(np.int32))
    if len(grams) < per:
        return empty
    start = np.arange(len(grams) - per + 1)
    best = start + np.lib.stride_tricks.sliding_window_view(grams, per).argmin(axis=1)
    owner = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    inside = owner[start] == owner[start + window - 1]
    start, best = start[inside], best[inside]
    if not len(start):
        return empty
    new = np.ones(len(start), dtype=bool)
    new[1:] = (best[1:] != best[:-1]) | (start[1:] != start[:-1] + 1) | (owner[start[1:]] != owner[start[:-1]])
    head = np.flatnonzero(new)
    windows = np.diff(np.append(head, len(start)))
    first = start[head]
    end = first + windows + window - 1
    p, q = _powers(len(value) + 1)
    total = np.zeros(len(value) + 1, dtype=np.uint64)
    np.cumsum(value * p[: len(value)], out=total[1:])
    content = mix((total[end] - total[first]) * q[first] + (end - first).astype(np.uint64))
    text = owner[first]
    side, at = -(-(window - anchor) // 2), best[head]
    near = (window_hash(value, side) if side else np.zeros(len(value) + 1, dtype=np.uint64)) | np.uint64(1)
    beside = lambda place, inside: np.where(inside, near[np.clip(place, 0, len(near) - 1)] & np.uint64(0xFFFF), np.uint64(0)).astype(np.int32)
    left, right = beside(at - side, at - side >= first), beside(at + anchor, at + anchor + side <= end)
    return grams[at], content, text, first - words.first[text], windows, left, right


def _common(rows: DataFrame, anchor: int) -> DataFrame:
    """Hashes of phrases that a worker saw often among the texts ``sample``, with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def often() -> pa.RecordBatch:
            value, count = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            keep = count > 2
            return pa.RecordBatch.from_arrays([pa.array(value[keep].view(np.int64)), pa.array(count[keep], pa.int64())], names=["h", "n"])

        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for i, j in slices(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                held.append(window_hash(words.hashes(), anchor) >> np.uint64(1))
                size += len(held[-1])
                if size > 4_000_000:
                    yield often()
                    held, size = [], 0
        yield often()

    return rows.select("sample").mapInArrow(tidy(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(COMMON)


def _runs(rows: DataFrame, window: int, anchor: int, common: np.ndarray, lot: int = 0, lots: int = 1) -> DataFrame:
    """Runs of all documents whose anchors are in the lot. Kind 0: a worker has seen the same words in an earlier document, into which this run is folded.
    Kind 1: the earliest that the worker has seen; ``m`` is how many it has folded into it. A passage that very many
    documents share so comes to few rows of kind 1."""
    most = HELD_RUNS
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def settle(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        a, content, key, at, left, right = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((key, content, a))
        a, content, key, at, left, right = (x[order] for x in (a, content, key, at, left, right))
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (content[1:] != content[:-1])
        heads = np.flatnonzero(new)
        copied = key > key[np.repeat(heads, np.diff(np.append(heads, len(a))))]
        m = np.zeros(len(a), dtype=np.int64)
        m[heads] = np.add.reduceat(copied, heads, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array((~copied).astype(np.int32)), pa.array(a.view(np.int64)), pa.array(content.view(np.int64)), pa.array(key), pa.array(at), pa.array(m.astype(np.int32)), pa.array(left | right << 16)], names=["kind", "a", "c", "key", "at", "m", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            key, mark = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = buffers(batch.column(2))
            for i, j in slices(offsets):
                a, content, text, first, windows, left, right = find_runs(Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), window, anchor, shared.value)
                if lots > 1:
                    own = mix(a) % np.uint64(lots) == lot
                    a, content, text, first, windows, left, right = (x[own] for x in (a, content, text, first, windows, left, right))
                if not len(a):
                    continue
                held.append([a, content, key[i:j][text], mark[i:j][text] << 39 | span(first, windows), left, right])
                size += len(a)
                if size > most:
                    yield settle(held)
                    held, size = [], 0
        if held:
            yield settle(held)

    return rows.select("key", "mark", "text").mapInArrow(tidy(run), "kind int, a long, c long, key long, at long, m int, b int")


def _alike(a: np.ndarray, beside: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Rows that share the anchor and the hash ``beside`` it (not 0) with a row of another document."""
    order = np.lexsort((beside, a))
    x, y, k = a[order], beside[order], key[order]
    cuts = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))) if len(x) else np.zeros(0, dtype=np.int64)
    out = np.zeros(len(a), dtype=bool)
    if len(cuts):
        two = (np.minimum.reduceat(k, cuts) < np.maximum.reduceat(k, cuts)) & (y[cuts] != 0)
        out[order] = np.repeat(two, np.diff(np.append(cuts, len(x))))
    return out


def _repeated(runs: DataFrame) -> DataFrame:
    """Kind 0: runs folded into the earliest with their words. Kind 1: the others, where some were folded into them, or another
    document's run may have a window with them. Streams over the runs in the order of anchor, words and key; of an anchor
    it holds the runs of kind 1 only."""
    names = ["kind", "a", "c", "key", "at", "m"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # anchor, words and key of the group at hand
        wait = [np.zeros(0, dtype=np.int64)] * 6 + [np.zeros(0, dtype=bool)]  # rows of the anchor at hand, and whether others were folded into them

        def batch_of(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, dtype=np.int32)), *(pa.array(x.astype(np.int64)) for x in columns)], names=names)

        def asked(rows: list[np.ndarray]) -> pa.RecordBatch:
            a, c, key, at, m, beside, folded = rows
            keep = folded | _alike(a, beside & 0xFFFF, key) | _alike(a, beside >> 16 & 0xFFFF, key)
            return batch_of(1, *(x[keep] for x in (a, c, key, at, m)))

        for batch in batches:
            if not batch.num_rows:
                continue
            kind, *columns = (batch.column(i).to_numpy() for i in range(7))
            known = int(np.searchsorted(kind, 1))
            yield batch_of(0, *(x[:known] for x in columns[:5]))
            if known == len(kind):
                continue
            columns = [x[known:] for x in columns]
            a, c, key, _, m, _ = columns
            new = np.ones(len(a), dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
            if last is not None:
                new[0] = (a[0], c[0]) != last[:2]
            place = np.maximum.accumulate(np.where(new, np.arange(len(a)), -1))
            earliest = np.where(place >= 0, key[np.maximum(place, 0)], last[2] if last is not None else 0)
            copied = key > earliest
            yield batch_of(0, *(x[copied] for x in columns[:5]))
            group = np.cumsum(new)  # 0: the group that goes on from the batch before
            folded = (np.bincount(group, weights=copied, minlength=int(group[-1]) + 1) > 0)[group] | (m > 0)
            if place[0] < 0:
                before = (wait[0] == last[0]) & (wait[1] == last[1])
                going_on = bool(copied[group == 0].any() or wait[6][before].any())
                wait[6] = wait[6] | before & going_on
                folded |= (group == 0) & going_on
            last = (a[-1], c[-1], earliest[-1])
            own = [np.concatenate((w, x[~copied])) for w, x in zip(wait, (*columns, folded))]
            done = int(np.searchsorted(own[0], a[-1])) if len(own[0]) else 0
            yield asked([x[:done] for x in own])
            wait = [x[done:] for x in own]
        yield asked(wait)

    spread = F.when(F.col("kind") == 1, F.col("a")).otherwise(F.xxhash64("key", "at"))
    return runs.repartition(spread).sortWithinPartitions("kind", "a", "c", "key", "at").mapInArrow(tidy(run), "kind int, a long, c long, key long, at long, m long")


def _words_of(rows: DataFrame, window: int) -> DataFrame:
    """The words of the runs listed in ``runs``: a, c, key, at, m, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(2)
            key = batch.column(0).to_numpy()
            data, offsets = buffers(batch.column(1))
            for i, j in slices(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                sizes = np.asarray(runs[i:j].value_lengths(), dtype=np.int64)
                a, c, at, m = (np.asarray(x) for x in runs[i:j].flatten().flatten())
                if not len(at):
                    continue
                where = np.repeat(np.arange(j - i), sizes)
                first = words.first[where] + ((at & ((1 << 39) - 1)) >> 6)
                stop = first + (at & 63) + window - 1
                begin, end = words.start[first], words.end[stop - 1]
                raw = words.data.tobytes()
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (a, c, key[i:j][where], at, m)), pa.array([raw[x:y] for x, y in zip(begin.tolist(), end.tolist())], pa.binary())], names=["a", "c", "key", "at", "m", "words"])

    return rows.select("key", "text", "runs").mapInArrow(tidy(run), "a long, c long, key long, at long, m long, words binary")


def shard_spans(words: list[bytes] | pa.Array, key: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of one shard's runs: the run, the window's place in it, and the smallest key of its occurrences."""
    data, offsets = buffers(words if isinstance(words, (pa.Array, pa.ChunkedArray)) else pa.array(words, pa.binary()))
    found = Words(data, offsets)
    known, symbol = np.unique(found.hashes(), return_inverse=True)
    symbol = symbol.astype(np.int64) + 1
    index = FmIndex(symbol, found.first, key, window, len(known) + 1)
    place, kind = index.matching(symbol, found.first)
    run = np.searchsorted(found.first, place, side="right") - 1
    return run, place - found.first[run], index.least[kind]


def _shards(words: DataFrame, window: int) -> DataFrame:
    """Kind 0: spans to remove (key, mark, span). Kind 1: for each run asked (anchor ``key``, words ``mark``), the smallest key
    (``span``) that has each of its windows, and ``m``."""
    least = SHARD_RUNS
    names = ["kind", "key", "mark", "span", "m"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, least):
            a, c, key, at, m = (table.column(i).to_numpy() for i in range(1, 6))
            which, offset, earliest = shard_spans(table.column(6).combine_chunks(), key, window)
            early = earliest < key[which]
            first, k = (at[which] & ((1 << 39) - 1)) >> 6, int(early.sum())
            # One span of a whole window's words for each window; neighbours overlap and are merged when applied.
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.zeros(k, np.int32), key[which][early], (at[which] >> 39)[early], span(first + offset, window)[early], np.zeros(k, np.int64))], names=names)
            bound = np.full(len(a), np.iinfo(np.int64).min)
            np.maximum.at(bound, which, earliest)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.ones(len(a), np.int32), a, c, bound, m)], names=names)

    # Anchors of very many runs are cut into parts, with a shard for every two of them.
    hot = stored(words.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > PART_RUNS).select("a", "n", F.ceil(F.col("n") / PART_RUNS).cast("int").alias("g")), "hot")
    split = lookup_join(words, hot, "a", "n", spread=F.xxhash64("key", "at"), rows=hot.count()).withColumn("g", F.coalesce("g", F.lit(1)))
    split = split.withColumn("p", F.pmod(F.xxhash64("key", "at"), F.col("g"))).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = split.select(F.xxhash64("a", F.least("p", "q"), F.greatest("p", "q")).alias("shard"), "a", "c", "key", "at", "m", "words")
    return dealt.repartition("shard").sortWithinPartitions("shard", "a", "key", "at").mapInArrow(tidy(run), "kind int, key long, mark long, span long, m long")


def repeated_spans(documents: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``key``, ``mark`` and ``spans``, the words to remove, for the documents that have any: numbers as of ``span``, or ``WHOLE``."""
    spark = documents.sparkSession
    text_batches(spark)
    if not 1 <= anchor <= window < 40:
        raise ValueError("a window must hold an anchor and fewer than 40 words")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = documents.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), body.alias("text"))
    named = stored(rows.select("key", _mark(F.col("text")).alias("mark"), F.md5(F.col("text").cast("binary")).alias("m"), F.octet_length("text").alias("size"), F.when(F.pmod(F.xxhash64(F.lit("anchors"), "key"), F.lit(SAMPLED)) == 0, F.col("text")).alias("sample")), "texts")
    copied = stored(named.groupBy("m", "size").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.struct("m", "size").alias("t"), "first", "n"), "copied")
    copies = stored(lookup_join(named.select("key", "mark", F.struct("m", "size").alias("t")), copied, "t", "n", spread=F.col("key"), rows=copied.count()).filter("first < key").select("key", "mark").distinct(), "copies")
    marked = rows.withColumn("mark", _mark(F.col("text")))
    names = [F.col("key"), F.col("mark")]
    common = np.sort(np.array([r["h"] for r in _common(named.filter("sample is not null"), anchor).select("h").collect()], dtype=np.int64)).view(np.uint64)
    lots = []
    for lot in range(LOTS):  # the runs of all anchors at once would be half as much again as the texts
        lots.append(stored(_repeated(_runs(anti_join(marked, names, copies), window, anchor, common, lot, LOTS)), "runs"))
        discard(spark)
    found = reduce(DataFrame.unionByName, lots)
    discard(spark, named, copied)
    runs = F.collect_list(F.struct("a", "c", "at", "m")).alias("runs")
    asked = stored(found.filter("kind = 1").groupBy("key", F.shiftright("at", 39).alias("mark")).agg(runs), "asked")
    texts = semi_join(marked, names, stored(asked.select("key", "mark"), "ids")).join(asked, ["key", "mark"])
    words = stored(_words_of(texts, window), "words")
    answers = stored(_shards(words, window), "answers")
    discard(spark, asked, words)
    bounds = answers.filter("kind = 1").select(F.struct(F.col("key").alias("a"), F.col("mark").alias("c")).alias("what"), F.col("span").alias("earliest"), "m").groupBy("what").agg(F.min("earliest").alias("earliest"), F.sum("m").alias("m"))
    others = found.filter("kind = 0").select("key", "at", F.struct("a", "c").alias("what"))
    direct = lookup_join(others, bounds, "what", "m", spread=F.xxhash64("key", "at")).filter("earliest < key")
    direct = direct.select("key", F.shiftright("at", 39).alias("mark"), (F.col("at").bitwiseAND((1 << 39) - 1) + (window - 1)).alias("span"))
    spans = direct.unionByName(answers.filter("kind = 0").select("key", "mark", "span")).unionByName(copies.select("key", "mark", F.lit(WHOLE).cast("long").alias("span")))
    out = stored(spans.groupBy("key", "mark").agg(F.collect_set("span").alias("spans")), "spans")
    discard(spark, *lots, answers, copies)
    return out


def apply_spans(text: bytes, spans: list[int] | None, window: int) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    words = text.split()
    n = len(words)
    if spans is None or not len(spans):
        return words, n
    if WHOLE in spans:
        return ([] if n >= window else words), n
    gone = bytearray(n)
    for s in spans:
        first, length = int(s) >> 6, int(s) & 63
        gone[first : first + length] = b"\1" * length
    return [w for w, g in zip(words, gone) if not g], n


def without_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The rows of ``documents`` with a column ``_kept``: n_words, n_removed and text (the words that stay, joined by one space).
    A column of ``documents`` that is named so is replaced."""
    documents = documents.drop("_kept")
    listed = free_name(documents, "spans")
    spans = repeated_spans(documents, key, text, window, anchor)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    others = [c for c in documents.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 1):
            own, texts, lists = part.columns
            counts, lost, kept = [], [], []
            for t, s in zip(texts, lists):
                words, n = apply_spans((t.as_py() or "").encode("utf-8"), s.as_py(), window)
                counts.append(n)
                lost.append(n - len(words))
                kept.append(b" ".join(words).decode("utf-8"))
            made = pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())], names=["n_words", "n_removed", "text"])
            yield pa.RecordBatch.from_arrays([own, texts, made], names=["own", "text", "kept"])

    names = [F.col(key).cast("long"), _mark(body)]
    listed_rows = some_join(documents, names, spans.select("key", "mark", F.col("spans").alias(listed)), ["key", "mark"])
    kept = StructType([StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("text", StringType())])
    rows = listed_rows.select(bundled(documents, others).alias("own"), F.col(f"`{text}`").alias("text"), F.col(f"`{listed}`").alias("spans"))
    done = rows.mapInArrow(tidy(run), StructType([rows.schema["own"], rows.schema["text"], StructField("kept", kept)]))
    return done.select(*(F.col("text").alias(c) if c == text else F.col("own")[c].alias(c) for c in documents.columns), F.col("kept").alias("_kept"))
