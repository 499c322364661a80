"""A compressed full-text index over sequences of symbols: the Burrows-Wheeler transform in a wavelet matrix of packed bits with
rank directories, and for each class of suffixes alike in ``depth`` symbols a bit at its first place and its least owner.

The suffixes are sorted by their first symbols only, somewhat more than ``depth``: intervals of patterns of up to
``depth`` + 1 symbols are the same as under a full sort. No suffix array is kept. All queries of a call advance together, one symbol a step."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector in 64-bit words, with the count of ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, dtype=bool)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.zeros(len(ones), dtype=np.int32)
        np.cumsum(ones[:-1], out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th one, from 0."""
        word = np.searchsorted(self.before, k, side="right") - 1
        rest, bits = (k - self.before[word]).astype(np.int64), self.words[word]
        place = word.astype(np.int64) * 64
        for step in (32, 16, 8, 4, 2, 1):
            low = bits & np.uint64((1 << step) - 1)
            ones = np.bitwise_count(low).astype(np.int64)
            far = rest >= ones
            rest -= np.where(far, ones, 0)
            place += np.where(far, step, 0)
            bits = np.where(far, bits >> np.uint64(step), low)
        return place


class WaveletMatrix:
    def __init__(self, values: np.ndarray, symbols: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in reversed(range(max(1, int(symbols - 1).bit_length()))):
            bit = (values >> shift) & 1 == 1
            self.levels.append((shift, Bits(bit), int(len(values) - bit.sum())))
            values = np.concatenate((values[~bit], values[bit]))
        self.start = self._walk(np.arange(symbols), np.zeros(symbols, dtype=np.int64)).astype(np.int32)

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbol >> shift) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._walk(symbol, at) - self.start[symbol]


class FmIndex:
    """``text``: symbols from 1 to ``symbols`` - 1; ``first[i]:first[i + 1]`` is sequence i, ``owner[i]`` its owner. Sequences end in
    a terminator that no query holds, so nothing matches across two of them."""

    def __init__(self, text: np.ndarray, first: np.ndarray, owner: np.ndarray, depth: int, symbols: int):
        count = len(first) - 1
        n = len(text) + count
        ends = first[1:] + np.arange(count)
        joined = np.zeros(n, dtype=np.int64)
        body = np.ones(n, dtype=bool)
        body[ends] = False
        joined[body] = text
        # Ranks by the first ``span`` symbols: as many as a number holds, then twice as many each time.
        width = int(symbols).bit_length()
        span = min(62 // width, depth)
        key = np.zeros(n, dtype=np.int64)
        for i in range(span):
            key[: n - i] |= joined[i:] << (width * (span - 1 - i))
        half = at = None
        while True:
            suffixes = np.argsort(key)
            ordered = key[suffixes]
            rank = np.zeros(n, dtype=np.int64)
            rank[suffixes[1:]] = np.cumsum(ordered[1:] != ordered[:-1])
            if span <= depth:
                half, at = rank, span
            if span > depth:
                break
            after = np.full(n, -1, dtype=np.int64)
            after[: max(0, n - span)] = rank[span:]
            key, span = rank * (n + 1) + after + 1, 2 * span
        # ``half`` ranks by ``at`` symbols, which is at least half of ``depth`` and no more than it.
        a, b = half[suffixes], half[np.minimum(suffixes + depth - at, n - 1)]
        heads = np.ones(n, dtype=bool)
        heads[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        who = owner[np.searchsorted(ends, suffixes)]
        self.heads = Bits(heads)
        self.least = np.minimum.reduceat(who, np.flatnonzero(heads)) if n else who
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(joined, minlength=symbols)))).astype(np.int64)
        self.wavelet = WaveletMatrix(joined[suffixes - 1], symbols)
        self.size = n
        self.classes = len(self.least)
        self.depth = depth

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that start with the symbol and go on as before."""
        k = len(symbol)
        both = np.concatenate((symbol, symbol))
        at = self.smaller[both] + self.wavelet.rank(both, np.concatenate((low, high)))
        return at[:k], at[k:]

    def interval(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of a class."""
        last = k + 1 == self.classes
        return self.heads.select(k), np.where(last, self.size, self.heads.select(np.where(last, k, k + 1)))

    def matching(self, text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics cut at ``depth`` of queries that are sequences of the index, streamed from their ends to their starts:
        one step a symbol, as a sequence always matches itself. For the places where ``depth`` symbols start, the place in
        ``text`` and the class of the match, that is the interval of its occurrences."""
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        places, classes = [], []
        low, high = np.zeros(len(size), dtype=np.int64), np.full(len(size), self.size, dtype=np.int64)
        for step in range(int(size.max(initial=0))):
            live = order[: int(np.searchsorted(-size[order], -step, side="left"))]
            at = first[live + 1] - 1 - step
            a, b = self.extend(text[at], low[live], high[live])
            if step + 1 >= self.depth:
                # Back to ``depth`` symbols: the parent interval is the class of any of its suffixes.
                k = self.heads.rank(a + 1) - 1
                a, b = self.interval(k)
                places.append(at)
                classes.append(k)
            low[live], high[live] = a, b
        empty = np.zeros(0, dtype=np.int64)
        return (np.concatenate(places), np.concatenate(classes)) if places else (empty, empty)
