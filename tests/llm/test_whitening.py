import math

import numpy as np
import pytest

from fleetfold.llm import whitening
from fleetfold.llm.queries import op12_embedding_whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors, k=4, scale=256):
    """Per vector (n, deviation, [whitened]), with eigenvalues; signs are free."""
    x = np.array([[math.floor(scale * float(np.float32(c))) for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), dtype=object)
    n, sums = len(fit), fit.sum(0)
    centred = (fit * n - sums).astype(float) / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    white = (x * n - sums).astype(float) / n @ vectors / np.sqrt(values)
    return n, [int(s) for s in ((x * n - sums) ** 2).sum(1)], white, values / np.trace(v)


def table(spark, vectors):
    return spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(vectors)], SCHEMA)


def compare(rows, vectors, k=4):
    n, deviation, white, explained = brute(vectors, k)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == len(vectors) * k
    signs = [np.sign(sum(got[i, c + 1].whitened * white[i, c] for i in range(len(vectors)))) for c in range(k)]
    for i in range(len(vectors)):
        for c in range(k):
            r = got[i, c + 1]
            assert (r.n, r.deviation) == (n, deviation[i])
            assert r.whitened * signs[c] == pytest.approx(white[i, c], abs=1e-8)
            assert r.explained == pytest.approx(explained[c], rel=1e-9) and r.identity_error < 1e-9


def test_against_numpy(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 24)) * np.linspace(2, 0.2, 24) + 3
    vectors = np.vstack([vectors, vectors[:50], vectors[:50]])  # copies count once
    compare(whitening.whiten(table(spark, vectors).repartition(5)).collect(), vectors)


def test_large_means_lose_no_precision(spark):
    rng = np.random.default_rng(2)
    vectors = rng.integers(-3, 4, size=(200, 6)) * np.arange(6, 0, -1) + 2.0**22
    compare(whitening.whiten(table(spark, vectors)).collect(), vectors)


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1], [9, 9, 9, 1, 1, 1], [1e6, 1, 1e-3, 1e-3, 1e-6, 0, 0], [2.0] * 12, [1], [3, 0, 0],
    list(1 + 1e-9 * np.arange(20)), list(np.linspace(1, 2, 64))])
def test_eigenpairs(values):
    rng = np.random.default_rng(3)
    d = len(values)
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    v = q * np.array(values, float) @ q.T
    v = (v + v.T) / 2
    got, vectors = whitening.leading_eigenpairs(v, 4)
    want = sorted((x for x in values if x > 1e-12 * sum(values)), reverse=True)[:4]
    assert got == pytest.approx(want, rel=1e-9, abs=1e-12 * max(values))
    assert np.abs(vectors.T @ vectors - np.eye(len(want))).max() < 1e-10
    assert np.abs(v @ vectors - vectors * got).max() < 1e-10 * max(values)


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    values = np.linalg.eigvalsh(a)
    parts = whitening.tridiagonal(a)
    for shift in rng.uniform(-12, 12, 40):
        assert whitening.inertia(*parts, shift) == (values > shift).sum()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.1, 0.2], [0.5, -0.3], [0.9, 0.4], [0.1, 0.2]]
    odd = [None, [], [nan, 0.0], [inf, 0.0], [None, 0.1], [0.5], [-0.0, 0.0]]
    rows = [(i, v, None, "x") for i, v in enumerate(good)] + [(100 + i, v, 1, None) for i, v in enumerate(odd)] + [(None, [0.3, 0.3], 1, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, component string")
    got = whitening.whiten(df).collect()
    assert {r.vec_id for r in got} == {0, 1, 2, 3, 106, None} and {r.component for r in got} == {1, 2} and {r.n for r in got} == {5}
    same = {r.component: r.whitened for r in got if r.vec_id == 0}
    assert same == {r.component: r.whitened for r in got if r.vec_id == 3}


def test_no_components(spark):
    empty = whitening.whiten(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns[:3] == ["vec_id", "component", "n"]
    assert whitening.whiten(spark.createDataFrame([(1, None, 0), (2, [], 0)], SCHEMA)).count() == 0
    assert whitening.whiten(table(spark, [[1, 2], [1, 2]])).count() == 0


def test_entries_beyond_64_bits(spark):
    rows = [(1, [3e38, 1.0], 0), (2, [-3e38, 2.0], 0), (3, [0.0, 3.0], 0)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.vec_id: r.deviation for r in got} == {1: None, 2: None, 3: 768**2 + 1} and all(abs(r.whitened) < 10 for r in got)


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    assert [r.vec_id for r in rows] == list(range(len(rows)))
    compare(op12_embedding_whitening(spark, sf_dir).collect(), [r.embedding for r in rows])
