"""A minimal acyclic transducer: sorted words in, one integer out per word, common suffixes shared.

States are built from sorted words one by one; as soon as a suffix is complete it is replaced by an equal one that is
there already, so the automaton is minimal at every step. Each arc carries the number of words that sort before the
words through it, and the sum of these along a path is the word's number: outputs that differ don't keep suffixes
apart. The numbers index a table of token ids. All of it is flat little-endian arrays in one file, which readers map
into memory and share between processes.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow.fs as pafs

_MAGIC = b"MATL0001"


class _State:
    __slots__ = ("arcs", "final", "number", "words")

    def __init__(self) -> None:
        self.arcs: dict[int, _State] = {}
        self.final = False
        self.number = -1
        self.words = 0

    def key(self) -> tuple:
        return (self.final, *((b, s.number) for b, s in self.arcs.items()))


def build(entries: Iterable[tuple[bytes, Sequence[int]]]) -> bytes:
    """The file's bytes, for words (unlike each other, in ascending order) and their ids."""
    root, register, order = _State(), {}, []
    path: list[tuple[_State, int, _State]] = []
    last = b""
    offsets, ids = [0], []

    def settle(down_to: int) -> None:
        while len(path) > down_to:
            parent, byte, child = path.pop()
            known = register.get(key := child.key())
            if known is None:
                child.number = len(order)
                child.words = child.final + sum(s.words for s in child.arcs.values())
                order.append(child)
                register[key] = child
            else:
                parent.arcs[byte] = known

    for word, out in entries:
        if word <= last and offsets[-1] + len(offsets) > 1:
            raise ValueError("words must ascend")
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        settle(same)
        state = path[-1][2] if path else root
        for byte in word[same:]:
            child = _State()
            state.arcs[byte] = child
            path.append((state, byte, child))
            state = child
        state.final = True
        last = word
        ids.extend(out)
        offsets.append(len(ids))
    settle(0)
    root.number, root.words = len(order), root.final + sum(s.words for s in root.arcs.values())
    order.append(root)
    first, labels, targets, before = [0], [], [], []
    for state in order:
        passed = int(state.final)
        for byte in sorted(state.arcs):
            labels.append(byte)
            targets.append(state.arcs[byte].number)
            before.append(passed)
            passed += state.arcs[byte].words
        first.append(len(labels))
    arrays = [np.array(first, "<i4"), np.array([s.final for s in order], "u1"), np.array(labels, "u1"), np.array(targets, "<i4"), np.array(before, "<i4"), np.array(offsets, "<i4"), np.array(ids, "<i4")]
    out = io.BytesIO()
    out.write(_MAGIC + struct.pack("<7q", *(len(a) for a in arrays)))
    for a in arrays:
        out.write(b"\0" * (-out.tell() % 8))
        out.write(a.tobytes())
    return out.getvalue()


class Lexicon:
    """Reads such a file from any buffer."""

    def __init__(self, data):
        if bytes(data[:8]) != _MAGIC:
            raise ValueError("not a lexicon")
        sizes, at = struct.unpack("<7q", bytes(data[8:64])), 64
        arrays = []
        for n, kind in zip(sizes, ("<i4", "u1", "u1", "<i4", "<i4", "<i4", "<i4")):
            at += -at % 8
            arrays.append(np.frombuffer(data, dtype=kind, count=n, offset=at))
            at += n * np.dtype(kind).itemsize
        self.arrays = arrays
        self._first, self._final, self._labels, self._targets, self._before, self._offsets, self._ids = map(memoryview, arrays)
        self.states, self.arcs, self.words = len(self._final), len(self._labels), len(self._offsets) - 1

    @classmethod
    def open(cls, uri: str) -> Lexicon:
        """Mapped into memory; on a store without local files, read into it."""
        filesystem, path = pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)
        if isinstance(filesystem, pafs.LocalFileSystem):
            return cls(np.memmap(path, dtype=np.uint8, mode="r"))
        with filesystem.open_input_file(path) as f:
            return cls(np.frombuffer(f.read(), dtype=np.uint8))

    def number(self, word: bytes) -> int:
        """The word's place in ascending order, or -1."""
        first, labels = self._first, self._labels
        state, total = self.states - 1, 0
        for byte in word:
            low, high = first[state], first[state + 1]
            while low < high:
                mid = (low + high) >> 1
                if labels[mid] < byte:
                    low = mid + 1
                else:
                    high = mid
            if low == first[state + 1] or labels[low] != byte:
                return -1
            total += self._before[low]
            state = self._targets[low]
        return total if self._final[state] else -1

    def ids_at(self, number: int) -> list[int]:
        return self._ids[self._offsets[number] : self._offsets[number + 1]].tolist()

    def ids(self, word: bytes) -> list[int] | None:
        n = self.number(word)
        return None if n < 0 else self.ids_at(n)

    def numbers(self, words: Sequence[bytes]) -> np.ndarray:
        """The same for many words, all of them a byte further at each step."""
        first, final, labels, targets, before = self.arrays[:5]
        size = np.array([len(w) for w in words], dtype=np.int64)
        text = np.frombuffer(b"".join(words), dtype=np.uint8)
        start = np.cumsum(size) - size
        state, total = np.full(len(words), self.states - 1, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        live = np.arange(len(words))
        for step in range(int(size.max(initial=0))):
            live = live[size[live] > step]
            if not len(live):
                break
            byte = text[start[live] + step]
            low, high = first[state[live]].astype(np.int64), first[state[live] + 1].astype(np.int64)
            stop = high
            while (open_ := low < high).any():
                mid = (low + high) >> 1
                less = open_ & (labels[np.minimum(mid, self.arcs - 1)] < byte)
                low, high = np.where(less, mid + 1, low), np.where(open_ & ~less, mid, high)
            found = low < stop
            found &= labels[np.minimum(low, self.arcs - 1)] == byte
            state[live[~found]] = -1
            live, low = live[found], low[found]
            total[live] += before[low]
            state[live] = targets[low]
        known = (state >= 0) & (final[np.maximum(state, 0)] == 1)
        return np.where(known, total, -1)
