import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm.fmindex import Bits, FmIndex, WaveletMatrix
from tesserae.llm.wordhash import Words, buffers, slices


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\x0b é", max_size=12), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    data, offsets = buffers(pa.array(texts, pa.string()))
    words = Words(data, offsets)
    raw = data.tobytes()
    for i, t in enumerate(texts):
        span = range(words.first[i], words.first[i + 1])
        assert [raw[words.start[k] : words.end[k]].decode() for k in span] == re.findall(r"[^\x20\x09-\x0D]+", t)
    h = words.hashes()
    seen = {}
    for k in range(len(words)):
        assert seen.setdefault(raw[words.start[k] : words.end[k]], h[k]) == h[k]
    assert len(set(seen.values())) == len(seen)


def test_slices_cover_all_rows():
    offsets = np.array([0, 5, 5, 100, 101])
    assert list(slices(offsets, 10)) == [(0, 2), (2, 3), (3, 4)]


def test_wavelet_ranks():
    values = np.random.default_rng(1).integers(0, 37, 500)
    w = WaveletMatrix(values, 37)
    symbol, at = np.random.default_rng(2).integers(0, 37, 300), np.random.default_rng(3).integers(0, 501, 300)
    assert w.rank(symbol, at).tolist() == [int((values[:p] == s).sum()) for s, p in zip(symbol, at)]


def test_fm_index_finds_all_occurrences():
    rng = random.Random(4)
    rows = [[rng.randint(1, 3) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    text, first = np.array([x for r in rows for x in r]), np.cumsum([0, *map(len, rows)])
    index = FmIndex(text, first, np.arange(100, 160), 4, 4)
    place, kind = index.matching(text, first)
    found = dict(zip(place.tolist(), kind.tolist()))
    starts = [(r, i) for r in range(len(rows)) for i in range(len(rows[r]) - 3)]
    assert len(found) == len(starts)
    low, high = index.interval(np.array([found[first[r] + i] for r, i in starts]))
    for (r, i), n in zip(starts, (high - low).tolist()):
        hits = [a for a, b in starts if rows[a][b : b + 4] == rows[r][i : i + 4]]
        assert n == len(hits) and index.least[found[first[r] + i]] == 100 + min(hits)


def test_bits_rank_and_select():
    rng = np.random.default_rng(5)
    for share in (0.02, 0.5, 0.98):
        bits = rng.random(1000) < share
        places, packed = np.flatnonzero(bits), Bits(bits)
        assert packed.select(np.arange(len(places))).tolist() == places.tolist()
        assert packed.rank(np.arange(1001)).tolist() == np.concatenate(([0], np.cumsum(bits))).tolist()
