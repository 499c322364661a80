"""Classifiers, BPE and packing."""

import hashlib
import os
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tesserae.llm import bpe, jaccard, langid, packing, quality, substring
from tesserae.llm.lexicon import Lexicon, build

GOOD = "the quick brown fox and the lazy dog walk along a river of the town"
BAD = "BUY!! NOW!! CHEAP$$$ ***%%% ###"


def labelled(spark, docs, n=200):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice((GOOD if k % 4 else BAD).split()) for _ in range(rng.randint(20, 400)))) for k in range(n)]
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(n)] + [(0, None), (None, 1), (1, 7)], "doc_id long, quality int")
    return docs(rows), labels


def test_quality_held_out(spark, docs):
    rows, labels = labelled(spark, docs)
    model = quality.train(rows, labels.filter("doc_id % 3 <> 1"))
    got = {r["doc_id"]: r["score"] for r in quality.score(rows, model).collect()}
    assert len(got) == 200
    assert all((got[k] >= 0.5) == (k % 4 > 0) for k in got if k % 3 == 1)


def test_quality_edges(spark, docs, edge):
    rows, labels = labelled(spark, docs)
    model = quality.train(rows, labels)
    got = quality.score(edge, model).collect()
    assert len(got) == 11 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(edge, model, carry=True).columns == [*(c for c in edge.columns if c != "score"), "score"]
    one = quality.train(rows, labels.filter("quality = 1"))
    assert all(r["score"] > 0.9 for r in quality.score(edge, one).collect())
    none = quality.train(rows, labels.limit(0))
    assert {r["score"] for r in quality.score(edge, none).collect()} == {0.5} and quality.score(docs([]), none).count() == 0


def test_language_held_out(spark, docs):
    rng = random.Random(2)
    words = {"en": "the and of with that this from are is on".split(), "de": "der die und nicht mit auf für von ist ein".split(), "fr": "le la les des une que est pour dans avec".split()}
    rows, langs = [], {}
    for k in range(300):
        langs[k] = rng.choice(sorted(words))
        rows.append((k, " ".join(rng.choice(words[langs[k]]) for _ in range(rng.randint(4, 60)))))
    table = spark.createDataFrame([(k, t, langs[k]) for k, t in rows] + [(1000, "x", None), (None, "y", "en")], "doc_id long, text string, lang string")
    model = langid.train(table.filter("doc_id % 5 <> 0"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(table, model).collect()}
    held = [k for k in range(300) if k % 5 == 0]
    assert sum(got[k][0] == langs[k] for k in held) >= 0.95 * len(held) and all(0 <= s <= 1 for _, s in got.values())
    assert (model.weights == 0).mean() > 0.3  # the L1 penalty keeps what tells nothing at zero


def test_language_edges(spark, edge, docs):
    none = langid.train(edge.limit(0))
    assert {r["lang_pred"] for r in langid.predict(edge, none).collect()} == {"und"}
    one = langid.train(edge)
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.predict(edge, one).collect()}
    assert {k for k, v in got if v == "und"} == {1, 2, 3} and (7, "en") in got
    digits = langid.predict(docs([(1, "123 !? 4"), (2, "1a")]), one).collect()
    assert [(r["lang_pred"], r["score"] > 0) for r in sorted(digits, key=lambda r: r["doc_id"])] == [("und", False), ("en", True)]


PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary(PATH)


def test_bpe_equals_the_library(vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    letters = "aAbBtThe 's'reΣσςİǅſß́éÉ一日ア½²Ⅷ٣ 　\x1c\x85\t\n#$%&<|>endofxt​😀­\x00"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", "  ", "<|endoftext|><|startoftext|>x", "#" * 500 + "ab" * 300, "a" * 400, "the" * 100, "I'm We'RE it's", "ΑΣ ΑΣ."]
    encoder = bpe.Encoder(vocabulary)
    expected = library.encode_batch(texts, add_special_tokens=False)
    for text, found in zip(texts, expected):
        ids = encoder.encode(text)
        assert ids == found.ids and vocabulary.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_memo_generations(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 5)
    texts = [f"word{i} same other{i % 3} thing" for i in range(40)]
    encoder = bpe.Encoder(vocabulary)
    assert [encoder.encode(t) for t in texts] == [bpe.Encoder(vocabulary).encode(t) for t in texts]


def test_lexicon():
    words = sorted({f"{a}{b}{c}".encode() for a in ("", "un", "re") for b in ("do", "make", "é") for c in ("", "ing", "er")})
    lexicon = Lexicon(build((w, [i, i * 2]) for i, w in enumerate(words)))
    assert [lexicon.ids(w) for w in words] == [[i, i * 2] for i in range(len(words))]
    assert lexicon.words == len(words) and lexicon.states < sum(map(len, words)) / 3  # suffixes are shared
    absent = [b"", b"un", b"doing ", b"zzz", b"\xff", b"remaker"]
    assert [lexicon.number(w) for w in absent] == [words.index(w) if w in words else -1 for w in absent] == lexicon.numbers(absent).tolist()
    assert lexicon.numbers(words).tolist() == list(range(len(words)))
    with pytest.raises(ValueError):
        build([(b"b", [1]), (b"a", [2])])
    assert Lexicon(build([])).ids(b"x") is None


def test_bpe_tables(spark, edge, docs, vocabulary):
    lexicon = bpe.compile_lexicon(edge, vocabulary)
    coded = bpe.encode(edge, vocabulary, lexicon)
    back = {(r["doc_id"], r["text"]) for r in bpe.decode(coded, vocabulary).collect()}
    plain = bpe.Encoder(vocabulary)
    rows = edge.select("doc_id", "text").collect()
    assert back == {(r["doc_id"], vocabulary.decode(plain.encode(r["text"] or ""))) for r in rows}
    digest = bpe.encode(edge, vocabulary, lexicon, output="digest").collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in digest) == sorted((r["doc_id"], len(i := plain.encode(r["text"] or "")), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest()) for r in rows)
    assert bpe.encode(docs([]), vocabulary, bpe.compile_lexicon(docs([]), vocabulary)).count() == 0


def plain_best_fit(lengths, size):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            r, i = min(fits)
            room[i] = r - n
        else:
            room.append(size - n)
    return len(room)


def test_best_fit_of_one_size_is_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(30):
        lengths = [rng.randint(1, 100) for _ in range(rng.randint(0, 120))]
        assert len(packing.best_fit(lengths, [100])[2]) == plain_best_fit(lengths, 100)


def test_best_fit_of_several_sizes():
    rng = random.Random(5)
    for _ in range(30):
        lengths = [rng.randint(1, 100) for _ in range(rng.randint(1, 120))]
        bins, offsets, final = packing.best_fit(lengths, [25, 50, 100])
        spans = {}
        for n, b, o in zip(lengths, bins, offsets):
            spans.setdefault(b, []).append((o, o + n))
        for b, found in spans.items():
            found.sort()
            assert found[0][0] == 0 and all(x[1] == y[0] for x, y in zip(found, found[1:]))
            assert found[-1][1] <= final[b] and (final[b] == 25 or found[-1][1] > final[b] // 2)
        assert sum(final) <= sum(packing.best_fit(lengths, [100])[2])
    with pytest.raises(ValueError):
        packing.best_fit([101], [100])


def test_pack_tables(edge, docs):
    rows = packing.pack(edge, capacities=(64, 128), shard_items=4).collect()
    total = {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {1: 0, 2: 0, 3: 0, 4: 1, 5: 2, 6: 2, 7: 3, 8: 60_000, 9: 60_000, 10: 1}
    assert all(r["bin_id"] is None for r in rows if not r["length"])
    used = {}
    for r in rows:
        if r["bin_id"]:
            used.setdefault(r["bin_id"], []).append((r["position"], r["position"] + r["length"], r["bin_length"]))
    for spans in used.values():
        spans.sort()
        assert all(x[1] == y[0] for x, y in zip(spans, spans[1:])) and spans[-1][1] <= spans[0][2]
    assert packing.pack(docs([])).count() == 0


def test_packed_rows_that_repeat_a_key(docs):
    long = " ".join(f"x{i}" for i in range(300))
    rows = [(5, long), (5, long), (5, long + " more"), (None, long), (None, "y"), (2**53 + 1, "a b c"), (7, "d e")]
    packed = packing.pack(docs(rows), capacities=(64, 128)).cache()
    spans = {}
    for r in packed.collect():
        spans.setdefault(r["bin_id"], []).append((r["position"], r["position"] + r["length"], r["bin_length"]))
    for own in spans.values():
        own.sort()
        assert all(x[1] <= y[0] for x, y in zip(own, own[1:])) and own[-1][1] <= own[0][2]
    made = packing.sequences(docs(rows), packed).collect()
    assert len(made) == len(spans)
    for r in made:
        assert sum(r["lengths"]) == len(r["tokens"]) <= r["bin_length"] and len(r["keys"]) == len(r["lengths"])
    whole = sorted(t for r in made for t in r["tokens"])
    assert whole == sorted(w for _, t in rows for w in t.split())
    assert {k for r in made for k in r["keys"]} == {5, None, 2**53 + 1, 7}


def test_sequences_are_the_documents_tokens(docs):
    rng = random.Random(2)
    rows = [(k, "".join(rng.choice(["a", "bb ", "\n", " ", "\x0b"]) for _ in range(rng.randint(0, 400)))) for k in range(40)]
    packed = packing.pack(docs(rows), capacities=(16, 32, 64), shard_items=10).cache()
    tokens = {r["bin_id"]: r["tokens"] for r in packing.sequences(docs(rows), packed).collect()}
    for k, text in rows:
        pieces = sorted(packed.filter(F.col("doc_id") == k).collect(), key=lambda r: r["piece"])
        assert [w for r in pieces if r["length"] for w in tokens[r["bin_id"]][r["position"] : r["position"] + r["length"]]] == text.split()
    given = docs([(1, "x"), (2, "y")]).withColumn("ids", F.array(F.col("doc_id"), F.lit(9)))  # any token ids
    own = packing.pack(given, length=F.size("ids"))
    assert [r["tokens"] for r in packing.sequences(given, own, tokens=F.col("ids")).collect()] in ([[1, 9, 2, 9]], [[2, 9, 1, 9]])


@pytest.fixture(scope="module")
def given():
    where = "/root/testdata/sf0.1"
    if not os.path.exists(f"{where}/documents.parquet"):
        pytest.skip("the given tables aren't here")
    return where


def test_quality_on_documents_held_out(spark, given):
    from tesserae.llm import queries

    labels = spark.read.parquet(f"{given}/labels.parquet").filter("quality is not null")
    rows = queries.op9_compression_quality(spark, given).filter("held_out").join(labels, "doc_id").select("quality", "predicted").collect()
    good, bad = ([r["predicted"] == q for r in rows if r["quality"] == q] for q in (1, 0))
    assert len(rows) > 1000 and sum(good) >= 0.99 * len(good) and sum(bad) >= 0.95 * len(bad)


def test_language_on_documents_held_out(spark, given):
    from tesserae.llm import queries

    docs = spark.read.parquet(f"{given}/documents.parquet").filter("lang is not null").select("doc_id", "lang")
    rows = queries.op10_language_id(spark, given).filter("held_out and lang_pred <> 'und'").join(docs, "doc_id").collect()
    assert len(rows) > 1500 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.99 * len(rows)


def test_every_language_is_learned(docs):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"{letters[i % 26]}{letters[i // 26 % 12]}{letters[i % 26]} " * 12, f"l{i % 312}") for i in range(312 * 6)]
    df = docs([(k, t) for k, t, _ in rows]).drop("lang").join(docs([]).sparkSession.createDataFrame([(k, l) for k, _, l in rows], "doc_id long, lang string"), "doc_id")
    model = langid.train(df, per_language=4, most=300, least=3)
    assert len(model.languages) == 312


def test_rows_are_carried_under_any_names(spark, docs):
    """Columns named as operators name their own, and names with dots."""
    rows, labels = labelled(spark, docs, 60)
    odd = rows.select("*", F.lit(1).alias("_scored"), F.lit(2).alias("_read"), F.lit("x").alias("a.b"), F.lit("y").alias("__scored"))
    scored = quality.score(odd, quality.train(rows, labels), carry=True)
    assert scored.columns == [*(c for c in odd.columns if c != "score"), "score"] and scored.count() == 60 and scored.first()["_scored"] == 1
    found = langid.predict(odd, langid.train(rows.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fr"))), carry=True)
    assert found.columns[-2:] == ["lang_pred", "score"] and found.first()["a.b"] == "x" and found.first()["_read"] == 2
    assert [c for c in substring.without_repeats(odd).columns if c != "_kept"] == odd.columns
    assert jaccard.one_of_each(odd).columns == odd.columns
