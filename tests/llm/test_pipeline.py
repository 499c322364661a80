"""The stages of the corpus pipeline against brute force, and on tables at the edge."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_dedup import brute_components, brute_removed

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tesserae.llm import langid, quality  # noqa: E402
from tesserae.llm.queries import fold  # noqa: E402
from tesserae.session import shared_dir  # noqa: E402

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
WORDS = {"en": "the quick brown fox and a lazy dog walk along the river of this town".split(), "de": "der schnelle braune Fuchs und ein fauler Hund laufen über die Straße".split()}


def documents(n=160, seed=1):
    rng = random.Random(seed)
    rows, made = [], []
    for k in range(n):
        lang = rng.choice(["en", "de"])
        kind = rng.random()
        if made and kind < 0.2:
            lang, words = rng.choice(made)
            words = list(words)
            if rng.random() < 0.7:
                words[rng.randrange(len(words))] = "changed"
        else:
            words = [rng.choice(WORDS[lang]) + str(rng.randrange(60)) for _ in range(rng.randint(30, 120))]
            if made and kind < 0.5:
                words += rng.choice(made)[1][:30]
        if kind > 0.85:
            words = "BUY!! NOW!! CHEAP$$$ ***".split() * rng.randint(10, 30)
        else:
            made.append((lang, words))
        text = " ".join(words)
        rows.append((k, text, lang if rng.random() < 0.8 else None, "s", len(text), "x"))
    return rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    rows = documents()
    spark.createDataFrame(rows, FIELDS).write.parquet(f"{where}/documents.parquet")
    labels = [(k, 0 if "BUY!!" in t else 1, 0) for k, t, *_ in rows if k % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_every_stage_against_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r.asDict() for r in docs.collect()}
        after = stage(spark, docs, tables)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == corpus_pipeline.COLUMNS, name
        texts = sorted((k, r["text"]) for k, r in before.items())
        got = {r["doc_id"]: r.asDict() for r in after.collect()} if "doc_id" in after.columns else after.collect()
        if name == "quality_classifier":
            labels = spark.read.parquet(f"{tables}/labels.parquet")
            scores = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.train(docs, labels.filter(fold(3) != 1))).collect()}
            assert set(got) == {k for k, s in scores.items() if s >= 0.5}
            assert all("BUY!!" not in r["text"] for r in got.values()) and len(got) == sum("BUY!!" not in t for _, t in texts)
        elif name == "language_id":
            model = langid.train(docs.filter(fold(5) != 0).filter("lang is not null"))
            found = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
            assert set(got) == {k for k, r in found.items() if r["lang_pred"] != "und" and r["score"] >= 0.5} and len(got) > 0.95 * len(texts)
        elif name == "near_duplicates":
            kept = {k for k, (_, least) in brute_components(texts, 5, 80).items() if k == least}
            assert set(got) == kept < set(before) and all(got[k]["text"] == before[k]["text"] for k in kept)
        elif name == "repeated_passages":
            expected = {k: lost for k, _, lost, _ in brute_removed(texts, 13)}
            assert set(got) == set(before) and any(expected.values())
            for k, t in texts:
                assert len(got[k]["text"].split()) == len(t.split()) - expected[k] and got[k]["n_chars"] == len(got[k]["text"])
                assert expected[k] or got[k]["text"] == t
        else:
            assert sorted(w for r in got for w in r["text"].split()) == sorted(w for _, t in texts for w in t.split())
            assert all(sum(r["lengths"]) == len(r["text"].split()) <= r["bin_length"] and len(r["lengths"]) == len(r["doc_ids"]) for r in got)
            assert {k for r in got for k in r["doc_ids"]} == {k for k, t in texts if t.split()}
        if name != corpus_pipeline.STAGES[-1][0]:
            docs = spark.createDataFrame(after.collect(), FIELDS.rpartition(", ")[0])
    assert sorted(map(str, corpus_pipeline.run(spark, tables).collect())) == sorted(map(str, got))


def test_every_stage_on_odd_tables(spark, tables, tmp_path):
    odd = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (None, "w " * 40, "en", None, 80, None), (3, " \n\t", "de", "s", 3, "x"), (4, "w " * 40, "en", "s", 80, "x"), (4, "w " * 40, "en", "s", 80, "x"), (5, "z " * 9000, None, "s", 18_000, "x")]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, FIELDS).withColumns({"score": F.lit(1), "_kept": F.lit(2), "key": F.lit("k"), "spans": F.lit(3)})
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, tables).collect()
            assert len(got) <= len(rows) + (name == "best_fit_packing") * 10, name
            if rows and name == "near_duplicates":
                assert sorted((r["doc_id"] or 0) for r in got) == [0, 1, 2, 3, 4, 4, 5]
            if rows and name == "repeated_passages":
                assert len(got) == len(rows) and {r["text"] for r in got if r["doc_id"] == 1} == {None}
    empty = tmp_path / "empty"
    spark.createDataFrame([], FIELDS).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "language_id", "near_duplicates", "repeated_passages", "best_fit_packing"]


def test_run_keeps_the_rows_of_the_last_stage_alone(spark, tables):
    here = Path(shared_dir(spark).removeprefix("file:"))
    before = set(here.iterdir())
    assert corpus_pipeline.run(spark, tables).count()
    left = {p.name.split("-")[1] for p in set(here.iterdir()) - before}
    assert "repeated_passages" in left and not left & {"quality_classifier", "language_id", "near_duplicates"}
