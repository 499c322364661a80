import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tesserae.operators.retrieve import search_many
from tesserae.operators import skew
from tesserae.operators.skew import anti_join, lookup_join, semi_join
from tesserae.session import discard, free_name, shared_dir, stored, text_batches

ROOT = Path(__file__).resolve().parent.parent


def test_entry_works_without_the_optional_parts(tmp_path):
    shutil.copytree(ROOT / "tesserae", tmp_path / "tesserae", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op1') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_llm_subpackage():
    for path in (ROOT / "tesserae").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "tesserae.llm" not in path.read_text(encoding="utf-8"), path


@pytest.mark.parametrize("top, rows", [(2, None), (1000, None), (1000, 5)])
def test_lookup_join(spark, top, rows):
    left = spark.createDataFrame([(i, None if i % 11 == 0 else i % 7 if i % 2 else 0) for i in range(200)], "i int, k int")
    right = spark.createDataFrame([(0, 120, "zero"), (1, 9, "one"), (3, 9, None), (5, 9, "five"), (77, 1, "none")], "k int, n int, v string")
    got = {(r["i"], r["k"], r["v"]) for r in lookup_join(left, right, "k", "n", spread=F.col("i"), top=top, rows=rows).collect()}
    known = {0: "zero", 1: "one", 5: "five"}
    assert got == {(r["i"], r["k"], known.get(r["k"])) for r in left.collect()}


def test_lookup_join_spreads_hot_keys(spark):
    left = spark.range(5000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 7 ELSE id END AS k")
    right = spark.range(2000).selectExpr("id AS k", "CASE WHEN id = 7 THEN 9999 ELSE 1 END AS n", "'v' AS v")
    plan = lookup_join(left, right, "k", "n", spread=F.col("id"), top=1).hint("merge")._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "LeftOuter" in line and "rs#" in line]
    assert keys and all("ls#" in line.partition("LeftOuter")[0] for line in keys)


def test_search_many(spark):
    vectors = [(i, [float(i % 3), float(i % 5), 1.0]) for i in range(60)] + [(99, [0.0, 0.0, 0.0])]
    index = spark.createDataFrame(vectors, "id long, vector array<float>").repartition(5)
    queries = index.filter("id in (4, 7)").selectExpr("id AS query_id", "vector AS query_vector")
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / ((sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5 or 1.0), 9)
    expected = []
    for q in (4, 7):
        best = sorted((-cos(vectors[q][1], v), i) for i, v in vectors)[:4]
        expected += [(q, n, i) for n, (s, i) in enumerate(best, 1)]
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in search_many(index, queries, 4, 0.0).collect()) == expected
    assert search_many(index, queries.limit(0), 4).count() == 0 == search_many(index.limit(0), queries, 4).count()
    with pytest.raises(ValueError):
        search_many(index, queries, most_queries=1)


def test_search_many_in_blocks(spark):
    index = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(70)], "id long, vector array<float>").repartition(3)
    queries = index.selectExpr("id AS query_id", "vector AS query_vector")
    rows = lambda **options: sorted(map(tuple, search_many(index, queries, 3, 0.5, **options).collect()))
    assert rows() == rows(query_block=30) and len(rows(query_block=35)) == 210


def test_search_many_beyond_20_000_queries(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<float>")
    queries = spark.range(20_001).selectExpr("id AS query_id", "array(1.0F, float(id % 2) * 2) AS query_vector")
    got = search_many(index, queries, 1)
    assert got.count() == 20_001 == got.filter("id = 1 + query_id % 2").count()


def test_caption_lines_are_whole(spark, monkeypatch):
    from tesserae.plans import chunk_queries

    elements = spark.createDataFrame([("f", 0, "paragraph", "x" * 1000, ["h"]), ("f", 1, "paragraph", "y" * 99, ["h"])], "file_id string, element_idx int, element_type string, content string, heading_path array<string>")
    monkeypatch.setattr(chunk_queries, "_elements", lambda *_: elements)
    got = {r["element_idx"]: (r["element_type"], r["content"]) for r in chunk_queries.table_captions(spark, "").collect()}
    assert got == {0: ("paragraph", "Table 1: " + "x" * 1000), 1: ("table", "y" * 99)}  # a line too long for a caption stays a paragraph


def test_stored_rows_can_be_discarded(spark):
    rows = stored(spark.range(3), "numbers")
    assert rows.count() == 3
    files = rows.inputFiles()
    discard(spark, rows)
    assert files and not any(Path(f.removeprefix("file://")).exists() for f in files)


def test_text_batches_only_lowers(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "100")
    text_batches(spark)
    assert spark.conf.get(name) == "100"
    spark.conf.set(name, "64m")
    text_batches(spark)
    assert spark.conf.get(name) == str(4 << 20)
    spark.conf.set(name, before)


@pytest.mark.parametrize("few", [100, 3])  # broadcast as they are, and through the filter
def test_semi_and_anti_join(spark, monkeypatch, few):
    monkeypatch.setattr(skew, "FEW", few)
    rows = [(i, None if i % 9 == 0 else f"t{i % 5}", i * 2, "l") for i in range(300)]
    left = spark.createDataFrame(rows, "k0 int, l string, hit int, at string")
    ids = stored(spark.createDataFrame([(i, f"t{i % 4}") for i in range(0, 300, 7)] + [(2, None)], "b int, map string"), "ids")
    known = {(i, f"t{i % 4}") for i in range(0, 300, 7)}
    got = semi_join(left, [F.col("k0"), F.col("l")], ids)
    assert got.columns == left.columns and {tuple(r) for r in got.collect()} == {r for r in rows if r[:2] in known}
    rest = anti_join(left, [F.col("k0"), F.col("l")], ids)
    assert {tuple(r) for r in rest.collect()} == {r for r in rows if r[:2] not in known}
    values = stored(ids.filter("map is not null").withColumn("v", F.col("b") + 1), "values")
    joined = skew.some_join(left, [F.col("k0"), F.col("l")], values, ["b", "map"])
    assert joined.columns == [*left.columns, "v"] and {tuple(r) for r in joined.collect()} == {(*r, r[0] + 1 if r[:2] in known else None) for r in rows}
    none = stored(ids.limit(0), "none")
    assert semi_join(left, [F.col("k0"), F.col("l")], none).count() == 0 and anti_join(left, [F.col("k0"), F.col("l")], none).count() == 300


def test_lookup_join_with_names_of_its_own(spark):
    left = spark.createDataFrame([(1, "a", 2, 3), (5, "b", 2, 3)], "hk int, rv string, ls int, l int")
    right = spark.createDataFrame([(1, 1, "x")], "hk int, n int, hv string")
    assert sorted(map(tuple, lookup_join(left, right, "hk", "n", spread=F.col("ls")).collect())) == [(1, "a", 2, 3, "x"), (5, "b", 2, 3, None)]
    assert free_name(left, "L") == "_L" and free_name(left, "x") == "x"


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                @staticmethod
                def sc():
                    class Context:
                        @staticmethod
                        def getCheckpointDir():
                            class Option:
                                @staticmethod
                                def isDefined():
                                    return False

                            return Option

                    return Context

    with pytest.raises(ValueError):
        shared_dir(Session)


def test_entry_works_without_a_package_that_the_optional_parts_need(tmp_path):
    shutil.copytree(ROOT / "tesserae", tmp_path / "tesserae", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    for name in ("public_tokenizers", "zstandard"):
        (tmp_path / f"{name}.py").write_text("raise ImportError('not here')")
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op1_') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_odd_vectors(spark):
    """Null, ragged, empty and non-finite vectors on either side."""
    nan = float("nan")
    kind = "id int, vector array<double>"
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, []), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [0.0, 1.0]), (8, [1.0, 0.0, 0.0]), (9, [0.0, 0.0])], kind)
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, []), (4, [1.0]), (5, [nan, nan]), (6, [3.0, 0.0, 0.0])], "query_id int, query_vector array<double>")
    got = {}
    for r in search_many(index, queries, 3, 0.5).collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    assert got == {1: [(1, 1.0)], 4: [(3, 1.0)], 6: [(8, 1.0)]}
    assert {(r["query_id"], r["id"]) for r in search_many(index, queries.filter("query_id = 5"), 20, 0.0).collect()} == {(5, i) for i in (1, 3, 4, 5, 6, 7, 8, 9)}
    from tesserae.operators.retrieve import search

    assert [(r["id"], r["score"]) for r in search(index, [1.0, 0.0], 3).collect()] == [(1, 1.0), (2, 0.0), (3, 0.0)]


def test_joins_carry_columns_of_any_name(spark):
    left = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], "k int, `a.b` string, `c``d` double")
    right = spark.createDataFrame([(1, 1, "v")], "k int, n int, v string")
    assert sorted(tuple(r) for r in lookup_join(left, right, "k", "n", spread=F.col("k")).collect()) == [(1, "a", 2.0, "v"), (2, "b", 3.0, None)]
    ids = stored(right.select("k"), "ids")
    assert semi_join(left, [F.col("k")], ids).columns == left.columns and anti_join(left, [F.col("k")], ids).count() == 1
    assert skew.some_join(left, [F.col("k")], stored(right.select("k", "v"), "some"), ["k"]).columns == [*left.columns, "v"]
