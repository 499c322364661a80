"""Periodic runs and benchmark decontamination against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.llm import decontaminate, periodicity, queries
from tesserae.llm.decontaminate import SuffixArray, compile_suffixes
from tesserae.llm.periodicity import Extensions, find_runs, grid


def brute_runs(words, least=24, repeats=3):
    found = {}
    for p in range(1, len(words) // repeats + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, repeats * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i) + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def brute_collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def wordy(rng):
    letters = rng.choice([1, 2, 3, 60])
    words = [rng.randrange(letters) for _ in range(rng.choice([0, 1, 10, 24, 30, 100, 180]))]
    if words and rng.random() < 0.6:
        unit = [rng.randrange(4) for _ in range(rng.randint(1, 12))]
        at = rng.randrange(len(words))
        words[at:at] = unit * rng.randint(2, 9) + unit[: rng.randrange(len(unit))]
    return words


@pytest.mark.parametrize("least, repeats, seed", [(24, 3, 1), (24, 3, 2), (6, 2, 3), (10, 4, 4), (31, 5, 5)])
def test_runs_are_those_of_brute_force(least, repeats, seed):
    rng = random.Random(seed)
    for _ in range(40):
        texts = [wordy(rng) for _ in range(rng.randint(1, 6))]
        first = np.cumsum([0, *map(len, texts)])
        runs = find_runs(np.array(sum(texts, []), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), first, least, repeats).tolist()
        for i, words in enumerate(texts):
            assert [tuple(r[1:]) for r in runs if r[0] == i] == brute_runs(words, least, repeats)


def test_extensions_are_common_prefixes():
    rng = random.Random(8)
    for n in (2, 3, 17, 64, 200):
        symbol = np.array([rng.randrange(3) for _ in range(n)])
        i, j = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
        i, j = i[i != j], j[i != j]
        expected = [next((k for k in range(n - max(a, b)) if symbol[a + k] != symbol[b + k]), n - max(a, b)) for a, b in zip(i.tolist(), j.tolist())]
        assert Extensions(symbol).common(i, j).tolist() == expected


def test_grid_is_as_wide_as_it_may_be():
    text, period, place = (np.concatenate(x) for x in zip(*grid(np.array([100, 5, 30]), 24, 3)))
    assert set(text.tolist()) == {0, 2} and period[text == 0].max() == 33 and (place % period == 0).all() and (place + period < np.array([100, 5, 30])[text]).all()
    for p in set(period[text == 0].tolist()):
        places = np.sort(place[(text == 0) & (period == p)])
        assert (np.diff(places) <= max(24, 3 * p) - p).all() and 100 - p - places[-1] <= max(24, 3 * p) - p


def test_periodic_runs_of_documents(spark, docs):
    rng = random.Random(3)
    rows = [(k, " ".join(f"w{w}" for w in wordy(rng))) for k in range(40)] + [(40, None), (41, ""), (42, " \n\t"), (5, "a b " * 20), (5, "a b " * 20), (None, "x " * 30), (44, "ü\x0bü " * 2000)]
    got = periodicity.periodic_runs(docs(rows).withColumn("own", F.lit(1)).withColumn("_periodic", F.lit("old"))).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() >= {"own", "key", "lang", "text"}
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        runs = brute_runs(words) if len(words) < 3000 else [(0, 4000, 1)]
        assert r["_periodic"]["n_words"] == len(words) and [tuple(x) for x in r["_periodic"]["runs"]] == runs
        assert r["_periodic"]["text"] == " ".join(brute_collapsed(words, runs))
    assert periodicity.periodic_runs(docs([])).count() == 0
    with pytest.raises(ValueError):
        periodicity.periodic_runs(docs([]), repeats=1)


def test_periodic_runs_of_a_very_long_text(docs):
    words = [f"w{i % 997}" for i in range(60_000)]
    [r] = periodicity.periodic_runs(docs([(1, " ".join(words))]), keep=["doc_id"]).collect()
    assert [tuple(x) for x in r["_periodic"]["runs"]] == [(0, 60_000, 997)] and r["_periodic"]["text"] == " ".join(words[:997])


def leak_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_leaks(documents, items, window=10):
    windows = {}
    for k, t in items:
        words = leak_words(t)
        for i in range(max(1, len(words) - window + 1)) if words else ():
            windows.setdefault(tuple(words[i : i + window]), set()).add(k)
    out = []
    for k, t in documents:
        words, hit, found = leak_words(t), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if own := windows.get(tuple(words[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= {str(x) for x in own if x is not None}
        out.append((k, t, len(words), len(hit), sorted(found)))
    return sorted(out, key=str)


def leaky(seed):
    rng = random.Random(seed)
    vocabulary = [f"V{i}" for i in range(40)] + ["Ünï", "42", "çé"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    items = [(i, text(rng.choice([10, 12, 30]))) for i in range(12)] + [(12, "rare short"), (13, "v1 v2 v3"), (3, text(15)), (None, "no id here at all"), (14, None), (15, " ,.; "), (16, "")]
    items.append((20, items[0][1] + items[1][1]))
    documents = []
    for k in range(80):
        body = text(rng.choice([0, 3, 40, 200]))
        if rng.random() < 0.5:
            words = re.split(r"(?<=\W)(?=\w)", rng.choice(items)[1] or "")
            at = rng.randrange(len(words))
            body += "".join(words[at : at + rng.choice([5, 9, 10, 11, 40])]) + text(5)
        documents.append((k % 70, body))
    return documents + [(90, None), (91, ""), (None, "RARE short"), (92, "x no id here at ALL y")], items


@pytest.mark.parametrize("window, block", [(10, 250_000), (10, 7), (4, 20)])
def test_matches_are_those_of_brute_force(spark, docs, window, block):
    documents, items = leaky(window)
    benchmark = spark.createDataFrame(items, "item_id int, text string")
    got = decontaminate.find_matches(docs(documents).withColumn("_found", F.lit(0)), benchmark, window=window, block_windows=block).collect()
    assert sorted(((r["doc_id"], r["text"], r["_found"]["n_words"], r["_found"]["n_hit"], r["_found"]["items"]) for r in got), key=str) == brute_leaks(documents, items, window)
    assert any(r["_found"]["n_hit"] for r in got)
    for r in got:
        spans = r["_found"]["spans"]
        assert sum(s["length"] for s in spans) == r["_found"]["n_hit"] and all(a["start"] + a["length"] < b["start"] for a, b in zip(spans, spans[1:]))


def test_affected_documents_are_removed(spark, docs):
    documents, items = leaky(1)
    benchmark = spark.createDataFrame(items, "item_id int, text string")
    kept = decontaminate.decontaminated(docs(documents).withColumn("_found", F.lit(7)), benchmark)
    assert kept.columns == [*docs([]).columns, "_found"]
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == sorted((str(k), str(t)) for k, t, _, hit, _ in brute_leaks(documents, items) if not hit)
    assert decontaminate.decontaminated(docs(documents), benchmark.limit(0)).count() == len(documents)
    assert decontaminate.find_matches(docs([]), benchmark).count() == 0


def test_suffix_array_intervals():
    rng = random.Random(4)
    text = np.array([rng.randrange(4) for _ in range(300)])
    array = SuffixArray(text, np.flatnonzero(text), 10, 3)
    pattern = np.zeros((60, 10), dtype=np.int32)
    length = np.array([rng.randint(1, 10) for _ in range(60)])
    for row, n in zip(pattern, length):
        at = rng.randrange(290)
        row[:n] = np.maximum(text[at : at + n], 1)
    low, high = array.find(pattern, length)
    padded = text.tolist() + [0] * 10
    for row, n, a, b in zip(pattern, length, low, high):
        assert sorted(array.places[a:b].tolist()) == [i for i in range(300) if padded[i : i + n] == row[:n].tolist()]


def test_items_are_compiled_once_each():
    made = compile_suffixes([("b", np.arange(1, 12, dtype=np.uint64)), ("a", np.arange(1, 12, dtype=np.uint64)), (None, np.arange(2, 4, dtype=np.uint64))], 10)
    assert len(made.pattern) == 3 and sorted(made.length.tolist()) == [2, 10, 10] and made.names == ["a", "b"] and np.diff(made.first).sum() == 4


def test_the_registered_queries_agree_with_brute_force(spark, tmp_path):
    """The tables' own edge cases: nulls, repeated ids, and documents that the periodic query changes."""
    import hashlib
    import zlib

    documents, items = leaky(6)
    documents = [(k, t) for k, t in documents] + [(k, " ".join(f"w{i}" for i in range(k % 90))) for k in range(100, 300)]
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = []
    for k, t in documents:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(words), zlib.crc32(str(k).encode())
        if k is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
        expected.append((k, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(brute_collapsed(words, runs)))))
    got = [tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str) and any(r[1] for r in got)
    leaks = [(k, n, hit, len(found), sha(",".join(found)), hit > 0) for k, _, n, hit, found in brute_leaks(documents, items)]
    assert sorted(map(str, (tuple(r) for r in queries.op13_decontamination(spark, str(tmp_path)).collect()))) == sorted(map(str, leaks))


def test_matches_of_wide_columns():
    words = decontaminate.words_of(pa.array(["A-b,C", None, ""], pa.large_string()))
    assert np.diff(words.first).tolist() == [3, 0, 0]
