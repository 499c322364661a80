"""The keyed index, its writers and merges; the vector index against exact search; embedding once."""

import json
import os
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.operators import retrieve, vectors
from tesserae.operators.embed import HashEmbedder
from tesserae.operators.index import Index, index_rows
from tesserae.operators.normalize import normalize
from tesserae.operators.retrieve import search_many
from tesserae.operators.vectors import Cells, VectorIndex, encoded, fit
from tesserae.plans import ingest


def rows_of(spark, pairs):
    return spark.createDataFrame(list(pairs), "id string, text string")


def contents(index, version=None):
    return {r["id"]: r["text"] for r in index.read(version).collect()}


def size_of(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


def test_an_upsert_writes_its_rows_only(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"), buckets=8)
    text = lambda i: " ".join(str(np.random.default_rng(i).integers(1 << 60)) for _ in range(20))
    index.upsert(rows_of(spark, ((f"k{i}", text(i)) for i in range(4000))))
    before = size_of(tmp_path)
    assert index.upsert(rows_of(spark, ((f"k{i}", "new" + text(i)) for i in range(0, 4000, 100)))) == 40
    assert size_of(tmp_path) - before < 0.1 * before
    m = index.manifest()
    assert len(m.upserts) == 1 and sum(m.upserts[0][1].values()) == 40 and sum(n for _, n in m.base.values()) == 4000
    assert contents(index) == {f"k{i}": ("new" if i % 100 == 0 else "") + text(i) for i in range(4000)}
    assert contents(index, 1)["k0"] == text(0)


def test_merges_rewrite_touched_buckets_only(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"), buckets=8)
    index.upsert(rows_of(spark, ((f"k{i}", "a") for i in range(100))))
    old = index.manifest()
    index.upsert(rows_of(spark, [("k1", "b"), ("n", "c")]))
    touched = set(index.manifest().upserts[0][1])
    assert index.compact() and not index.compact()
    new = index.manifest()
    assert not new.upserts and {b for b in new.base if new.base[b] != old.base.get(b)} == touched and len(touched) <= 2
    assert contents(index) == {f"k{i}": "b" if i == 1 else "a" for i in range(100)} | {"n": "c"}
    for n in range(3):
        index.upsert(rows_of(spark, [("k2", f"v{n}"), (f"m{n}", "d")]))
    assert index.compact(base=False) and len(index.manifest().upserts) == 1
    assert contents(index)["k2"] == "v2" and len(contents(index)) == 104
    index.upsert(rows_of(spark, ((f"k{i}", "z") for i in range(60))))  # over a quarter: merged at once
    assert not index.manifest().upserts and contents(index)["k59"] == "z"
    assert index.vacuum() == 0 and index.vacuum(-5) > 0 and contents(index)["k2"] == "z" and len(os.listdir(tmp_path / "i" / "_log")) == 1


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "i")
    first, second = Index(spark, path, buckets=4), Index(spark, path, buckets=4)
    first.upsert(rows_of(spark, ((f"k{i}", "a") for i in range(60))))
    publish, met = first._published, []

    def late(number, manifest):
        if not met:
            met.append(second.upsert(rows_of(spark, [("k1", "second"), ("s", "second")])))
        return publish(number, manifest)

    monkeypatch.setattr(first, "_published", late)
    first.upsert(rows_of(spark, [("k2", "first"), ("k1", "first")]))
    got = contents(Index(spark, path))
    assert (got["k1"], got["k2"], got["s"]) == ("first", "first", "second") and first.version() == 3
    # A merge that another one, or an upsert, overtakes.
    met.clear()
    monkeypatch.setattr(first, "_published", lambda n, m: (met.append(second.upsert(rows_of(spark, [("k3", "late")]))) if not met else None, publish(n, m))[1])
    assert first.compact() and contents(second)["k3"] == "late" and len(second.manifest().upserts) == 1
    met.clear()
    monkeypatch.setattr(first, "_published", lambda n, m: (met.append(second.compact()) if not met else None, publish(n, m))[1])
    assert not first.compact() and contents(second)["k3"] == "late" and len(contents(second)) == 61


def test_bad_batches_leave_nothing(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    vectors = lambda *r: spark.createDataFrame(list(r), "id string, vector array<float>")
    with pytest.raises(ValueError, match="components"):
        index.upsert(vectors(("a", [1.0]), ("b", [1.0, 2.0])))
    with pytest.raises(Exception, match="null"):
        index.upsert(vectors((None, [1.0])))
    assert not index.exists()
    index.upsert(vectors(("a", [1.0])))
    with pytest.raises(ValueError, match="key"):
        index.upsert(rows_of(spark, [("a", "x")]).withColumnRenamed("id", "other"), key="other")
    with pytest.raises(ValueError, match="vector as"):
        index.upsert(spark.createDataFrame([("a", "x")], "id string, vector string").withColumn("vector", F.split("vector", "")))
    more = spark.createDataFrame([("c", [2.0], "t")], "id string, vector array<float>, text string")
    index.upsert(more)
    assert sorted((r["id"], r["text"]) for r in index.read().collect()) == [("a", None), ("c", "t")]
    assert index.version() == 2 + (not index.manifest().upserts)


def test_each_text_is_embedded_once(spark, tmp_path):
    class CountingEmbedder(HashEmbedder):
        """Notes each text that it is asked for in a file of a folder."""

        def __init__(self, folder):
            HashEmbedder.__init__(self)
            self.folder = folder

        def embed(self, texts):
            import uuid

            Path(self.folder, uuid.uuid4().hex).write_text(json.dumps(list(texts)))
            return HashEmbedder.embed(self, texts)

    asked = tmp_path / "asked"
    asked.mkdir()
    seen = lambda: sorted(t for p in asked.iterdir() for t in json.loads(p.read_text()))
    kind = "chunk_id string, chunk_index int, text string, token_count int, content_hash string"
    raw = lambda rows: spark.createDataFrame(rows, kind).withColumn("content_hash", F.coalesce("content_hash", F.sha2(F.col("text").cast("binary"), 256)))
    index = Index(spark, str(tmp_path / "index"))
    provider = lambda: CountingEmbedder(str(asked))
    chunks = normalize(raw([(f"c{i}", i, f"text {i // 2}", 1, None) for i in range(100)] + [("blank", 0, " ", 0, None)]), "md")
    assert ingest.ingest(chunks, index, provider) == {"upsert_count": 100}
    assert seen() == sorted(f"text {i}" for i in range(50))
    again = normalize(raw([(f"d{i}", i, f"text {i}", 1, None) for i in range(55)] + [("odd", 0, "text 3", 1, "its own hash")]), "md")
    assert ingest.ingest(again, index, provider) == {"upsert_count": 56}
    assert seen() == sorted(f"text {i}" for i in range(55))
    want = {t: [np.float32(x) for x in v] for t, v in ((f"text {i}", HashEmbedder().embed([f"text {i}"])[0]) for i in range(55))}
    got = index.read().select("id", "text", "vector").collect()
    assert len(got) == 156 and all(np.allclose(r["vector"], want[r["text"]]) for r in got)
    with pytest.raises(ValueError):
        ingest.ingest(chunks.limit(0), index, provider)
    assert index_rows(ingest.with_vectors(again, index, provider)).count() == 56


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 16))
    x = centres[rng.integers(30, size=1500)] + 0.6 * rng.standard_normal((1500, 16))
    return [(f"v{i}", v) for i, v in enumerate(x.astype(np.float32).tolist())]


KIND = "id string, vector array<float>"


def test_vector_index_finds_what_exact_search_finds(spark, tmp_path, clustered):
    rows = spark.createDataFrame(clustered, KIND)
    odd = spark.createDataFrame([("none", None), ("zero", [0.0] * 16), ("nan", [float("nan")] * 16), ("short", [1.0])], KIND)
    index = VectorIndex(spark, str(tmp_path / "v"))
    with pytest.raises(Exception):
        index.create(rows.limit(0))
    assert index.create(rows) == 1500
    index = VectorIndex(spark, str(tmp_path / "v"))  # the cells come from the folder
    queries = rows.filter("substring(id, 2) % 20 = 0").selectExpr("id AS query_id", "vector AS query_vector")
    exact = {(r["query_id"], r["id"]): r["score"] for r in search_many(rows, queries, 5).collect()}
    got = index.search(queries).collect()
    assert len({(r["query_id"], r["id"]) for r in got} & set(exact)) >= 0.9 * len(exact)
    assert all(abs(exact[r["query_id"], r["id"]] - r["score"]) < 1e-9 for r in got if (r["query_id"], r["id"]) in exact)
    assert index.search(queries.limit(0)).count() == 0 == index.search(odd.selectExpr("id AS query_id", "vector AS query_vector").filter("query_id <> 'short'")).count()
    # One query reads the codes of its cells, and the vectors of fewer than a fifth of the rows.
    m, one = index.manifest(), queries.filter("query_id = 'v20'")
    cells = {str(r["cell"]) for r in index.candidates(one).select("cell").distinct().collect()}
    assert sum(m.base[c][1] for c in cells) < 0.2 * 1500 and index.cells.probes < len(index.cells.centroids)
    plan = index._read(m, cells).select("id", "vector")._jdf.queryExecution().executedPlan().toString()
    assert "code" not in plan.partition("ReadSchema")[2]
    every = index.search(queries, probes=len(index.cells.centroids), per_hit=400)
    assert {(r["query_id"], r["id"]) for r in every.collect()} == set(exact)


def test_vector_index_follows_upserts(spark, tmp_path, clustered):
    rows = spark.createDataFrame(clustered[:400], KIND)
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.create(rows, cells=12)
    moved = [(f"v{i}", (-np.array(clustered[i][1])).tolist()) for i in range(30)] + [("new", clustered[399][1])]
    assert index.upsert(spark.createDataFrame(moved, KIND)) == 31
    ask = lambda v: {r["id"]: r["rank"] for r in index.search(spark.createDataFrame([("q", v)], "query_id string, query_vector array<float>"), probes=12).collect()}
    for _ in range(2):
        assert ask(moved[0][1])["v0"] == 1 and ask(clustered[399][1])["new"] == 1 and "v0" not in ask(clustered[0][1])
        assert index.read().count() == 401 == index.read().select("id").distinct().count()
        assert index.compact()
        index.upsert(spark.createDataFrame(moved[:1], KIND))
    before = size_of(tmp_path)
    index.upsert(spark.createDataFrame(moved[1:3], KIND))
    assert size_of(tmp_path) - before < 0.1 * before


def test_codes_are_near_their_vectors(spark, clustered):
    rows = spark.createDataFrame(clustered, KIND)
    made = fit(rows, cells=20)
    x = np.array([v for _, v in clustered], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cell, code = made.encode(x)
    assert np.abs((made.decode(cell, code) * x).sum(axis=1) - 1).mean() < 0.02 and code.shape == (1500, 8) and 1 <= made.probes <= 20
    got = {r["id"]: (r["cell"], r["code"]) for r in encoded(rows, made).collect()}
    assert all(got[f"v{i}"] == (c, bytes(k)) for i, (c, k) in enumerate(zip(cell.tolist(), code)))
    assert Cells(made.centroids, made.words).nearest(x)[:, 0].tolist() == cell.tolist()


def test_a_service_searches_by_cells(spark, tmp_path):
    from tesserae.plans import api

    kind = "chunk_id string, chunk_index int, text string, token_count int, content_hash string"
    chunks = normalize(spark.createDataFrame([(f"c{i}", i, f"text {i}", 1, "") for i in range(60)], kind), "md")
    service = api.Service(spark, VectorIndex(spark, str(tmp_path / "v")), model=lambda p: p)
    assert service.index.upsert(index_rows(ingest.with_vectors(chunks.limit(0), service.index, HashEmbedder))) == 0 and not service.index.exists()
    assert ingest.ingest(chunks, service.index) == {"upsert_count": 60}
    best = service.search("text 7", 3).orderBy(F.desc("score")).collect()
    assert best[0]["text"] == "text 7" and abs(best[0]["score"] - 1) < 1e-6 and len(best) <= 3
    assert "text 7" in service.chat("text 7", 2)["answer"]
    more = normalize(spark.createDataFrame([("n", 0, "text new", 1, "")], kind), "md")
    assert ingest.ingest(more, service.index) == {"upsert_count": 1} and service.search("text new", 1).first()["text"] == "text new"


def test_the_best_columns_hold_no_scores_beyond_them():
    """what a worker keeps of a block of scores is as small as the hits."""
    rng = np.random.default_rng(5)
    scores, ids = np.round(rng.random((64, 500)), 2), pa.array(rng.permutation(500))
    places, best = retrieve._best(scores, ids, 5)
    for held in (places, best):
        whole = held
        while whole.base is not None:
            whole = whole.base
        assert whole.nbytes <= 64 * 500
    for row, p, s in zip(scores, places, best):
        expected = sorted(range(500), key=lambda c: (-row[c], ids[c].as_py()))[:5]
        assert p.tolist() == expected and s.tolist() == row[expected].tolist()
    assert retrieve._best(scores[:, :3], ids[:3], 5)[0].shape == (64, 3) and retrieve._best(scores[:, :0], ids[:0], 5)[0].shape == (64, 0)


def test_groups_are_ranked_without_listing_pairs(spark, monkeypatch):
    """F8: blocks of a group give what its listed pairs give; odd vectors and null groups too; equal scores at the digits asked for go by id."""
    rng = np.random.default_rng(8)
    values = [(i, rng.integers(-2, 3, 4).astype(float).tolist(), None if i % 11 == 0 else int(i % 3 == 0)) for i in range(300)]
    values += [(300, None, 0), (301, [1.0, None, 0.0, 0.0], 0), (302, [1.0, 2.0], 1), (303, [float("nan"), 1.0, 1.0, 1.0], 1), (304, [float("inf"), 1.0, 0.0, 0.0], 0), (305, [1.0] * 4, 7)]
    rows = spark.createDataFrame(values, "id long, vector array<double>, label int").repartition(5)
    asked = rows.filter("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"), "label")
    listed = asked.select("query_id", "label").join(rows.select("id", "label"), "label").select("query_id", "id")
    shown = lambda hits: sorted((r["query_id"], r["rank"], r["id"], repr(round(r["score"], 9))) for r in hits.collect())
    expected = shown(vectors.rerank(listed, rows, asked, 7))
    monkeypatch.setattr(vectors, "GROUP_ROWS", 16)
    monkeypatch.setattr(vectors, "GROUP_QUERIES", 7)
    made = vectors.rerank_groups(asked, rows, "label", 7)
    assert shown(made) == expected and "BroadcastNestedLoopJoin" not in made._jdf.queryExecution().toString()
    close = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 1e-5 + 1e-6], 1), (2, [1.0, 1e-5], 1)], "id long, vector array<double>, label int")
    one = close.filter("id = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"), "label")
    assert [r["id"] for r in vectors.rerank_groups(one, close, "label", digits=9).orderBy("rank").collect()] == [0, 1, 2]
    assert [r["id"] for r in vectors.rerank_groups(one, close, "label").orderBy("rank").collect()] == [0, 2, 1]


def test_a_write_has_one_exchange_and_a_merge_leaves_the_base_in_place(spark, tmp_path, monkeypatch):
    """rows are dealt once, by bucket, and base rows of other keys aren't exchanged to be merged; also beyond what is broadcast."""
    from tesserae.operators import skew

    monkeypatch.setattr(skew, "FEW", 3)
    plans, write = [], Index._write
    monkeypatch.setattr(Index, "_write", lambda self, rows: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or write(self, rows))
    index = Index(spark, f"{tmp_path}/i", buckets=4)
    index.upsert(rows_of(spark, [(str(i), "old") for i in range(200)] + [("7", "older")]), order=F.col("text"))
    index.upsert(rows_of(spark, [(str(i), "new") for i in range(150, 190)]))
    assert index.compact() and [p.count("Repartition") for p in plans[:2]] == [1, 1] and not plans[2].startswith("Repartition")
    index.upsert(rows_of(spark, [(str(i), "last") for i in range(180, 210)]))
    expected = {str(i): "last" if i >= 180 else "new" if i >= 150 else "older" if i == 7 else "old" for i in range(210)}
    assert contents(index) == expected and index.read().count() == 210
