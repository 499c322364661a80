"""Jaccard join, substring removal and components against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import jaccard, simhash, substring
from tesserae.llm.components import connected_components


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return {k: (len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows)}


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(25)]
    rows, made = [], []
    for k in range(n):
        kind = rng.random()
        if made and kind < 0.25:
            words = list(rng.choice(made))
        elif made and kind < 0.6:
            words = list(rng.choice(made))
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 13, 14, 40, 120]))]
            if rng.random() < 0.4:
                at = rng.randrange(len(words) + 1)
                words[at:at] = passage[rng.randrange(5) :]
        made.append(words)
        rows.append((k * 7 % n, " ".join(w.upper() if rng.random() < 0.02 else w for w in words)))
    return rows


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_jaccard_components(docs, n, percent):
    rows = corpus(n)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs(rows), words=n, percent=percent).collect()}
    assert got == brute_components(rows, n, percent)


def test_jaccard_edges(edge, docs):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(edge).collect())
    assert got == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 997, 8), (9, 997, 8), (10, 1, 10)]
    assert jaccard.jaccard_components(docs([])).count() == 0
    assert sorted(r["doc_id"] for r in jaccard.one_of_each(edge).collect()) == [1, 2, 3, 4, 6, 7, 8, 10]


def test_jaccard_null_keys(docs):
    got = jaccard.jaccard_components(docs([(None, "a b c d"), (3, "a b c d"), (4, "a b c d")])).collect()
    assert len(got) == 3 and {r["component_id"] for r in got if r["doc_id"] is not None} == {3}


def test_pairs_of_a_large_group_are_not_all_made(docs):
    rng = random.Random(1)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for k in range(150):
        words = list(base)
        words[rng.randrange(400)] = f"x{k}"
        rows.append((k, " ".join(words)))
    assert {r["component_id"] for r in jaccard.jaccard_components(docs(rows)).collect()} == {0}


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_jaccard_links_are_all_there(docs, n, percent):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(200)]
    group = []
    for k in range(12):  # all link with all
        words = list(base)
        words[rng.randrange(200)] = f"x{k}"
        group.append((1000 + k, " ".join(words)))
    rows = corpus(n, 80) + group + [(2000, group[0][1]), (2001, ""), (None, group[0][1])]
    sets = {k: shingles(t, n) for k, t in rows if k is not None}
    linked = {(x, y) for x in sets for y in sets if x != y and len(sets[x] & sets[y]) and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y])}
    least = {k: min([k, *(y for y in sets if sets[y] == s and s)]) for k, s in sets.items()}
    pairs, members = jaccard.jaccard_links(docs(rows), words=n, percent=percent)
    got = [(r["doc_id"], r["n_shingles"], r["class_id"], r["n_links"]) for r in members.collect()]
    assert len(got) == len(rows) and [r[3] for r in got if r[0] is None] == [0]
    assert {r for r in got if r[0] is not None} == {(k, len(s), least[k], sum(x == k for x, _ in linked)) for k, s in sets.items()}
    assert sorted((r["class_id"], r["other_id"]) for r in pairs.collect()) == sorted({(least[x], least[y]) for x, y in linked if least[x] < least[y]})


def brute_removed(rows, window):
    first = {}
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for (k, _), w in zip(rows, words):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(k, first.get(key, k))
    out = []
    for (k, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < k:
                gone |= set(range(i, i + window))
        out.append((k, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out)


def removed(df, **options):
    kept = substring.without_repeats(df, **options)
    return sorted(map(tuple, kept.select("doc_id", "_kept.n_words", "_kept.n_removed", F.sha2(F.col("_kept.text").cast("binary"), 256)).collect()), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_removal(docs, seed):
    rows = corpus(seed)
    assert removed(docs(rows)) == brute_removed(rows, 13)


@pytest.mark.parametrize("lots", [1, 2, 5])
def test_substring_lots(docs, monkeypatch, lots):
    monkeypatch.setattr(substring, "LOTS", lots)
    rows = corpus(3)
    assert removed(docs(rows)) == brute_removed(rows, 13)


def test_substring_lots_part_the_runs(docs):
    rows = docs(corpus(1)).selectExpr("doc_id AS key", "0L AS mark", "text").filter("text is not null")
    none = np.zeros(0, dtype=np.uint64)
    made = lambda *lot: {(r["a"], r["key"], r["at"]) for r in substring._runs(rows, 13, 3, none, *lot).collect()}
    parts = [made(i, 2) for i in range(2)]
    assert parts[0] | parts[1] == made() and all(parts) and not {a for a, *_ in parts[0]} & {a for a, *_ in parts[1]}


def test_substring_short_windows(docs):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))) for k in range(60)]
    assert removed(docs(rows), window=5, anchor=2) == brute_removed(rows, 5)


def test_substring_edges(edge, docs):
    from conftest import EDGE

    assert removed(edge) == brute_removed(EDGE, 13)
    assert removed(docs([])) == []
    long = " ".join(map(str, range(40)))
    assert [r[2] for r in removed(docs([(None, long), (5, long), (5, long + " more")])) if r[0] == 5] == [0, 0]


def test_whole_runs_beyond_one_shard(docs, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_RUNS", 3)
    monkeypatch.setattr(substring, "HELD_RUNS", 10)
    rows = corpus(5, 40)
    assert removed(docs(rows)) == brute_removed(rows, 13)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_edited_text_and_edges(edge, docs):
    from conftest import EDGE

    got = simhash.compare_edited(edge).orderBy("doc_id").collect()
    assert len(got) == len(EDGE)
    order = sorted(EDGE, key=lambda r: (r[0], r[1] or ""))
    expected = []
    for i, (k, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        expected.append((k, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == sorted(expected)
    marks = {r["doc_id"]: (r["hi"], r["lo"]) for r in got}
    assert marks[1] == marks[2] == marks[3] == (0, 0) and marks[4] == marks[5] and marks[8] == marks[9] != marks[10]
    assert simhash.compare_edited(docs([])).count() == 0
    alone = simhash.compare_edited(docs([(7, "only one here")])).collect()
    assert alone[0]["near_next"] == 1.0


def test_simhash_buckets_agree_with_one(spark, docs):
    rows = [(k * k, f"text number {k} " * (k % 5 + 1)) for k in range(200)]
    one = {r["doc_id"]: r for r in simhash.compare_edited(docs(rows).coalesce(1)).collect()}
    many = {r["doc_id"]: r for r in simhash.compare_edited(docs(rows).repartition(7)).collect()}
    assert one == many and len(one) == 200


@pytest.mark.parametrize("radius, blocks", [(4, 6), (2, 3), (0, 1)])
def test_radius_search_is_complete(spark, radius, blocks):
    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(30)]
    marks = set(base)
    for _ in range(200):
        x = rng.choice(base)
        for b in rng.sample(range(128), rng.randint(0, 7)):
            x ^= 1 << b
        marks.add(x)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    half = lambda x: (signed(x >> 64), signed(x & ((1 << 64) - 1)))
    df = spark.createDataFrame([half(x) for x in marks], "hi long, lo long")
    got = {(r["hi"], r["lo"], r["other_hi"], r["other_lo"]) for r in simhash.within_radius(df, df, radius, blocks).collect()}
    assert got == {(*half(x), *half(y)) for x in marks for y in marks if 1 <= bin(x ^ y).count("1") <= radius}


def test_near_copies_are_counted(docs):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(5000)]
    rows = []
    for k in range(150):
        words = [rng.choice(vocabulary) for _ in range(300)]
        copy = list(words)
        spots = rng.sample(range(300), 60)
        while True:  # as many words are replaced as similarity 0.8 lets
            changed = list(copy)
            changed[spots.pop()] = "changed"
            a, b = shingles(" ".join(words), 5), shingles(" ".join(changed), 5)
            if len(a & b) < 0.8 * len(a | b):
                break
            copy = changed
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    marked = simhash.fingerprints(docs(rows), ["doc_id"], "text")
    got = {r["doc_id"]: r["n_near"] for r in simhash.near_counts(marked, F.col("doc_id") % 2 == 0).collect()}
    assert all(got[k] is None for k in range(1, 300, 2)) and all(got[k] <= 1 for k in range(0, 300, 2))
    assert sum(got[k] for k in range(0, 300, 2)) >= 0.9 * 150


def test_near_counts_against_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(128) for _ in range(20)]
    marks = base + base[:5]
    for _ in range(200):
        x = rng.choice(base)
        for b in rng.sample(range(128), rng.choice([1, 3, 8, 12, 40])):
            x ^= 1 << b
        marks.append(x)
    marked = spark.createDataFrame([(k, *simhash._halves(x)) for k, x in enumerate(marks)], "doc_id long, hi long, lo long")
    got = {r["doc_id"]: r["n_near"] for r in simhash.near_counts(marked, F.lit(True), radius=11).collect()}
    assert got == {k: sum(bin(x ^ y).count("1") <= 11 for y in marks) - 1 for k, x in enumerate(marks)}  # up to 11 of 128 bits, one of six bands differs in one bit at most


def test_nearly_all_fingerprints_in_the_radius_are_found(spark):
    """At every distance up to the radius, with the parameters of the query."""
    rng = random.Random(9)
    pairs = []
    for d in (12, 18, 20, 22, 24, 25, 26, 27):
        for _ in range(300):
            x = rng.getrandbits(128)
            pairs.append((d, x, x ^ sum(1 << b for b in rng.sample(range(128), d))))
    halves = lambda i: spark.createDataFrame([(*simhash._halves(p[i]), 1) for p in pairs], "hi long, lo long, n long")
    found = {(r["hi"], r["lo"]) for r in simhash.near_classes(halves(1), halves(2)).collect()}
    for d in (12, 18, 20, 22, 24, 25, 26, 27):
        share = sum(simhash._halves(x) in found for e, x, _ in pairs if e == d) / 300
        assert share >= 0.9 if d <= simhash.RADIUS else share == 0, (d, share)


def test_no_pair_in_the_radius_is_missed(spark):
    """Also those whose bits lie as evenly over the bands as can be."""
    rng = random.Random(12)
    pairs = []
    for d in (1, 2, 25, 26, 27):
        for _ in range(500):
            x = rng.getrandbits(128)
            y, start = rng.getrandbits(128), rng.randrange(128)
            pairs += [(d, x, x ^ sum(1 << (start + 128 * k // d) % 128 for k in range(d))), (d, y, y ^ sum(1 << b for b in rng.sample(range(128), d)))]
    halves = lambda i: spark.createDataFrame([(*simhash._halves(p[i]), 1) for p in pairs], "hi long, lo long, n long")
    found = {(r["hi"], r["lo"]): r["around"] for r in simhash.near_classes(halves(1), halves(2)).collect()}
    assert found == {simhash._halves(x): 1 for d, x, _ in pairs if d <= simhash.RADIUS}


def test_fingerprints_against_brute_force(docs, edge):
    import struct

    import xxhash
    from conftest import EDGE

    def mark(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        hashes = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]
        terms = []
        for run in [hashes[i : i + 5] for i in range(len(hashes) - 4)] if len(hashes) >= 5 else []:
            seed = 42
            for h in run:
                seed = xxhash.xxh64_intdigest(struct.pack("<Q", h), seed=seed)
            terms.append(seed)
        votes, n = [0] * 128, len(terms)
        for t in terms:
            low = xxhash.xxh64_intdigest(struct.pack("<Q", t), seed=xxhash.xxh64_intdigest(struct.pack("<i", 1), seed=42))
            for i in range(64):
                votes[i] += t >> i & 1
                votes[64 + i] += low >> i & 1
        half = lambda part: sum(1 << i for i, v in enumerate(part) if 2 * v > n)
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        return signed(half(votes[:64])), signed(half(votes[64:]))

    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["a", "bé", "C\n", "dd", "\x0be"]) for _ in range(rng.randint(5, 60)))) for k in range(30)] + [(100, None), (101, " \t")]
    got = {r["doc_id"]: (r["hi"], r["lo"]) for r in simhash.fingerprints(docs(rows), ["doc_id"], "text").collect()}
    assert got == {k: mark(t) for k, t in rows}
    many = {r["key"]: (r["hi"], r["lo"]) for r in simhash.fingerprints(edge.selectExpr("doc_id AS key", "text").distinct(), ["key"], "text").collect()}
    assert {many[k] for k, t in EDGE if not (t or "").split()} == {(0, 0)} and many[8] == many[9] == mark(EDGE[8][1])


def test_buckets_follow_the_keys_quantiles(docs):
    rows = [(k, f"text {k}") for k in range(300)] + [(10**15, "far away"), (-(10**15), "before all")]
    spread, firsts = simhash.in_order(docs(rows), "doc_id")
    sizes = [r["count"] for r in spread.filter("_guest = 0").groupBy("_bucket").count().collect()]
    assert sum(sizes) == 302 and len(sizes) > 8 and max(sizes) <= 60
    got = {r["doc_id"]: r["edited_sha256"] for r in simhash.compare_edited(docs(rows)).collect()}
    order = sorted(rows)
    for i, (k, t) in enumerate(order):
        half = len(t) // 2
        assert got[k] == hashlib.sha256((t[: len(t) - half] + order[(i + 1) % len(order)][1][:half]).encode()).hexdigest()
