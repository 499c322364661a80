"""BPE encoding and decoding of a vocabulary with word ends, the same as the tokenizers library's for such files.

Texts are split at the special tokens; the rest is normalised (NFC, white space, lower case letter by letter) and cut
into words, and every word is a list of token ids of its own. The corpus' frequent words are compiled, with these
lists, into the transducer of ``lexicon``; workers map it into memory. Words that it doesn't hold are merged by rank.
Which words are in the lexicon never changes a result, only how often a merge is needed.

Defined results: null and empty texts, and texts of white space, have no tokens and decode to the empty text. A word
of any length is merged whole, in n log n steps.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.lexicon import Lexicon, build
from tesserae.llm.wordhash import Words, buffers, slices, tidy
from tesserae.session import qualified, scratch_path, text_batches

# White space and the word pattern as the vocabulary file states them.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
MEMO = 250_000
STRETCH = 4 << 20


def _byte_letters() -> list[str]:
    """The printable letter of each byte: itself where Latin-1 has a visible one, else the next from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        if b in visible:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Vocabulary:
    """Merges, tokens and special tokens of a file of the tokenizers library (BPE with a word end)."""

    def __init__(self, text: str):
        raw = json.loads(text)
        model = raw["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("unk_token") or not model.get("end_of_word_suffix"):
            raise ValueError("a BPE vocabulary over bytes with a word end is needed")
        self.end = model["end_of_word_suffix"]
        self.id_of: dict[str, int] = model["vocab"]
        if odd := [t["content"] for t in raw["added_tokens"] if any(t.get(name) for name in ("normalized", "lstrip", "rstrip", "single_word"))]:
            raise ValueError(f"special tokens are matched as they are; the file asks for more of {odd[:5]}")
        self.special = {t["content"]: t["id"] for t in raw["added_tokens"]}
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        # Ids of a pair -> rank and id of what it merges to, each packed into one number: the least number is the next merge.
        ids = self.id_of
        self.next = {ids[a] << 20 | ids[b]: r << 20 | ids[a + b] for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.token_of = {i: t for t, i in (*self.id_of.items(), *self.special.items())}
        letters = _byte_letters()
        self.inner = [ids[c] for c in letters]
        self.final = [ids[c + self.end] for c in letters]

    @cached_property
    def _special_pattern(self):
        return regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def merge(self, word: str) -> list[int]:
        """Token ids of one word, by the lowest rank first and the leftmost of equal ranks."""
        data = word.encode("utf-8")
        if not data:
            return []
        ids = [self.inner[b] for b in data]
        ids[-1] = self.final[data[-1]]
        return self._merge_long(ids) if len(ids) > 64 else self._merge_short(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get, none = self.next.get, 1 << 62
        wait = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while wait:
            best = min(wait)
            if best == none:
                break
            i = wait.index(best)
            ids[i] = best & 0xFFFFF
            del ids[i + 1], wait[i]
            if i < len(wait):
                wait[i] = get(ids[i] << 20 | ids[i + 1], none)
            if i:
                wait[i - 1] = get(ids[i - 1] << 20 | ids[i], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.next.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m >> 20, i, ids[i], ids[i + 1], m) for i in range(n - 1) if (m := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, merged = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = merged & 0xFFFFF, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((i, after[i]), (before[i], i)):
                if a >= 0 and b < n and (m := get(ids[a] << 20 | ids[b])) is not None:
                    heapq.heappush(heap, (m >> 20, a, ids[a], ids[b], m))
        return [i for i in ids if i >= 0]

    def pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        """Special tokens (True) and the stretches between them (False)."""
        if self._special_pattern is None or not any(t in text for t in self.special):
            yield False, text
            return
        for k, part in enumerate(self._special_pattern.split(text)):
            if part:
                yield bool(k % 2), part

    def words(self, text: str) -> list[str]:
        """Normalised words of a stretch without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")  # letter by letter there is no final sigma
        return _WORD.findall(text.lower())

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space: the file names no decoder, so word ends stay visible."""
        return " ".join(self.token_of[i] for i in ids)


class Encoder:
    """One process' encoder: the lexicon, the merges behind it, and a bounded memo of finished words in two generations: when
    the young one is full it becomes the old one, and words still in use move on from there."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.memo: dict[str, tuple[list[int], str, str]] = {}
        self.old: dict[str, tuple[list[int], str, str]] = {}
        self.hits = self.merges = 0

    def learn(self, words: list[str]) -> None:
        """Finishes unknown words: all at once in the lexicon, then one by one by merging."""
        fresh = [w for w in words if w not in self.old]
        numbers = self.lexicon.numbers([w.encode("utf-8") for w in fresh]).tolist() if self.lexicon and fresh else [-1] * len(fresh)
        for w, n in zip(fresh, numbers):
            if n < 0:
                self.merges += 1
                ids = self.vocabulary.merge(w)
            else:
                self.hits += 1
                ids = self.lexicon.ids_at(n)
            self.memo[w] = (ids, " ".join(map(str, ids)), self.vocabulary.decode(ids))
        for w in words:
            if w not in self.memo:
                self.memo[w] = self.old[w]

    def entries(self, texts: list[str]) -> Iterator[list[tuple[list[int], str, str]]]:
        """For each text the ids, the ids as text and the decoded text of each of its words and special tokens."""
        at = 0
        while at < len(texts):
            parts, unknown, size = [], {}, 0
            while at < len(texts) and size < 2_000_000:
                size += len(texts[at]) + 1
                found: list[str | int] = []
                for special, part in self.vocabulary.pieces(texts[at]):
                    if special:
                        found.append(self.vocabulary.special[part])
                    else:
                        found += self.vocabulary.words(part)
                parts.append(found)
                memo = self.memo
                unknown |= {w: None for w in found if w not in memo and type(w) is str}
                at += 1
            if len(self.memo) + len(unknown) > MEMO and self.memo:
                # What is known and needed now would go with the young generation: it is learned again from the old one.
                self.old, self.memo = self.memo, {}
                unknown = dict.fromkeys(w for found in parts for w in found if type(w) is str)
            self.learn(list(unknown))
            memo, special = self.memo, {i: ([i], str(i), t) for t, i in self.vocabulary.special.items()}
            for found in parts:
                yield [memo[w] if type(w) is str else special[w] for w in found]

    def encode(self, text: str) -> list[int]:
        return [i for found in self.entries([text]) for ids, _, _ in found for i in ids]


_ENCODERS: dict[str | None, Encoder] = {}


def _encoder(vocabulary: Vocabulary, lexicon: str | None) -> Encoder:
    """The process' encoder for a lexicon; a worker that is used again keeps its memo."""
    known = _ENCODERS.get(lexicon)
    if known is None or known.vocabulary.next != vocabulary.next:
        _ENCODERS.clear()
        known = _ENCODERS[lexicon] = Encoder(vocabulary, Lexicon.open(lexicon) if lexicon else None)
    return known


def frequent_words(documents: DataFrame, vocabulary: Vocabulary, limit: int = 200_000, text: str = "text") -> list[str]:
    """At most ``limit`` of the corpus' most frequent words, from counts over all texts. Words apart by white space are counted
    by their hashes, some megabytes at a time, and cut into the vocabulary's words at the end. What a stretch has less than
    three times, and the rarest when a worker's counter is full, is let go; a frequent word loses next to nothing by that."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def count(held: list[tuple[np.ndarray, np.ndarray]], counter: Counter) -> None:
        sizes = np.cumsum([0, *(len(d) for d, _ in held)])
        offsets = np.concatenate([[0], *(o[1:] + at for (_, o), at in zip(held, sizes))])
        words = Words(np.concatenate([d for d, _ in held]), offsets)
        _, first, n = np.unique(words.hashes(), return_index=True, return_counts=True)
        often = n > 2
        raw = words.data.tobytes()
        for k, m in zip(first[often].tolist(), n[often].tolist()):
            counter[raw[words.start[k] : words.end[k]]] += m
        if len(counter) > 400_000:
            low = sorted(counter.values())[200_000]
            for w in [w for w, m in counter.items() if m <= low]:
                del counter[w]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter = Counter()
        held, size = [], 0
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for i, j in slices(offsets, STRETCH):
                held.append((data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                size += len(held[-1][0])
                if size >= STRETCH:
                    count(held, counter)
                    held, size = [], 0
        if held:
            count(held, counter)
        own: Counter = Counter()
        for w, m in counter.items():
            for x in shared.value.words(w.decode("utf-8", "replace")):
                own[x] += m
        kept = [(w, m) for w, m in own.items() if len(w) <= 64]
        kept.sort(key=lambda x: -x[1])
        kept = kept[: 2 * limit]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([m for _, m in kept], pa.int64())], names=["w", "n"])

    counted = documents.select(F.col(text).cast("string").alias("t")).mapInArrow(tidy(run), "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return [r["w"] for r in counted.orderBy(F.desc("n"), "w").limit(limit).select("w").collect()]


def compile_lexicon(documents: DataFrame, vocabulary: Vocabulary, limit: int = 200_000, text: str = "text") -> str:
    """Writes the transducer of the frequent words to the shared folder; its address."""
    words = sorted(w.encode("utf-8") for w in frequent_words(documents, vocabulary, limit, text))
    data = build((w, vocabulary.merge(w.decode("utf-8"))) for w in words)
    uri = qualified(documents.sparkSession, scratch_path(documents.sparkSession, "lexicon") + ".bin")
    filesystem, path = pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)
    filesystem.create_dir(path.rpartition("/")[0], recursive=True)
    with filesystem.open_output_stream(path) as f:
        f.write(data)
    return uri


def load_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        return Vocabulary(f.read())


def encode(documents: DataFrame, vocabulary: Vocabulary, lexicon: str | None = None, key: str = "doc_id", text: str = "text", output: str = "ids") -> DataFrame:
    """One row per row: ``key``, and

    - output "ids": ``ids``, an array of token ids;
    - output "digest": ``n_tokens``, ``ids_sha256`` (decimal ids joined by one space) and ``decoded_sha256`` (decoded text).
    """
    text_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)
    kind = documents.schema[key].dataType.simpleString()
    fields = {"ids": "ids array<int>", "digest": "n_tokens long, ids_sha256 string, decoded_sha256 string"}[output]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, lexicon)
        for batch in batches:
            every = encoder.entries([t or "" for t in batch.column(1).to_pylist()])
            if output == "ids":
                made = [pa.array([[i for e in found for i in e[0]] for found in every], pa.list_(pa.int32()))]
            else:
                counts, coded, decoded = [], [], []
                for found in every:
                    counts.append(sum([len(e[0]) for e in found]))
                    coded.append(hashlib.sha256(" ".join([e[1] for e in found]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(" ".join([e[2] for e in found]).encode("utf-8")).hexdigest())
                made = [pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["key", *(f.split()[0] for f in fields.split(", "))])

    return documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), f"key {kind}, {fields}").withColumnRenamed("key", key)


def decode(encoded: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``text`` from arrays of ids; a null array gives the empty text, an unknown id fails."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shared.value.decode(x.as_py() or []) for x in batch.column(1)], pa.string())], names=["key", "text"])

    return encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
