"""Whitening against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import whitening
from tesserae.session import stored

NAN = float("nan")


def brute(vectors, most=16):
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    once = np.unique(x, axis=0)
    n, total = len(once), once.sum(axis=0)
    c = (once * n - total) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return n, ((x * n - total).astype(object) ** 2).sum(axis=1), (x * n - total) / n @ u / np.sqrt(e), e / np.trace(v)


@pytest.mark.parametrize("width, tile", [(5, 2), (20, 8), (20, 32), (3, 3)])
def test_whitening_is_that_of_numpy(spark, width, tile):
    rng = np.random.default_rng(width)
    vectors = (rng.standard_normal((300, width)) * np.arange(1, width + 1)).astype(np.float32).tolist()
    vectors += vectors[:50] * 3  # repeated vectors count once in the fit
    rows = [(i, v) for i, v in enumerate(vectors)]
    odd = [(900, None), (901, [None] * width), (902, [NAN] * width), (903, [float("inf")] + [0.0] * (width - 1)), (904, []), (905, [1.0] * (width + 1))]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("key", F.lit("x")).withColumn("x", F.lit(1)).repartition(5)
    out, model = whitening.whiten(df, tile=tile)
    got = {r["key"]: r for r in out.collect()}
    n, deviation, white, explained = brute(vectors)
    assert sorted(got) == list(range(len(vectors))) and model.n == n == 300
    assert [got[i]["deviation"] for i in range(len(vectors))] == deviation.tolist()
    own = np.array([got[i]["whitened"] for i in range(len(vectors))])
    sign = np.sign((own * white).sum(axis=0))
    assert np.allclose(own * sign, white, atol=1e-8) and np.allclose(model.explained, explained, rtol=1e-9) and model.identity_error < 1e-9


def test_whitening_of_few_and_equal_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out, model = whitening.whiten(make([]))
    assert out.count() == 0 and model.n == 0 and model.identity_error is None
    out, model = whitening.whiten(make([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])]))
    assert [(r["deviation"], r["whitened"]) for r in out.collect()] == [(0, [None, None])] * 3 and model.n == 1 and model.explained.tolist() == [0.0, 0.0]
    out, model = whitening.whiten(make([(1, [0.0, 5.0]), (2, [2.0, 5.0])]))
    got = {r["key"]: r["whitened"] for r in out.collect()}
    assert {round(abs(w[0]), 9) for w in got.values()} == {1.0} and got[1][1] is None and model.identity_error < 1e-12 and model.explained.tolist() == [1.0, 0.0]


def test_whitening_of_very_large_entries(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [3.5, 2.0])]
    out, model = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {r["key"]: r["deviation"] for r in out.collect()}
    assert sorted(got) == [1, 2, 3] and got[1] is None and got[3] is not None and model.total[0] == 224 and model.n == 3


def test_the_covariance_is_summed_over_tiles_and_row_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-200, 200, (500, 7))
    rows = stored(spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(3), "rows")
    total = x.sum(axis=0).tolist()
    for tile, block in ((3, 50), (7, 4096), (1, 1)):
        assert np.allclose(whitening.covariance(rows, 7, 500, total, tile, block), np.cov(x.T, bias=True))
