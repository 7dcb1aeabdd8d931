import itertools

import numpy as np
import pytest

from fleetfold.llm import lattice_dedup

VECTORS = "vec_id long, embedding array<float>, label int, cls string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x") for i, v in rows], VECTORS)


def run(df, **options):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice_dedup.near_duplicates(df, **options).collect()}


def brute(ids, x, cosine=0.9):
    x = np.asarray(x, np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    label = np.array(ids)
    for _ in ids:
        label = np.array([min([label[i], *label[near[i]]]) for i in range(len(ids))])
    return {i: (int(n), int(c), i == c) for i, n, c in zip(ids, near.sum(1), label)}


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 64))
    noise = rng.normal(size=(400, 64)) * rng.uniform(0.02, 0.25, (400, 1))
    return centres[rng.integers(0, 30, 400)] + noise


def test_recall_and_precision(spark, clustered):
    want, got = brute(range(400), clustered), run(table(spark, enumerate(clustered)))
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, *_ in got.values()) >= 0.98 * sum(n for n, *_ in want.values())
    assert all(got[i][1] >= want[i][1] for i in want)


def test_full_cells_count_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(lattice_dedup, "BLOCK", 8)
    rng = np.random.default_rng(2)
    x = rng.normal(size=64) + rng.normal(size=(100, 64)) * 0.05
    assert run(table(spark, enumerate(x))) == {i: (99, 0, i == 0) for i in range(100)}


def test_pairs_at_the_threshold_are_found(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        a, z = rng.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        z -= (z @ a) * a
        z /= np.linalg.norm(z)
        rows += [(2 * i, a), (2 * i + 1, 0.905 * a + np.sqrt(1 - 0.905**2) * z)]
    got = run(table(spark, rows))
    assert sum(n for n, *_ in got.values()) / 600 >= 0.93


def test_odd_vectors(spark, clustered):
    v, w = clustered[0], clustered[1]
    rows = [(1, v), (2, v), (3, 2 * v), (4, -v), (5, None), (6, []), (7, [0.0] * 64), (8, [None, *v[1:]]), (9, [float("nan"), *v[1:]]),
            (10, [float("inf"), *v[1:]]), (11, v[:32]), (12, v[:32]), (13, w * 1e-30), (14, w * 1e30), (None, v), (2, v)]
    got = run(table(spark, rows))
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[3] == (3, 1, False) and got[4] == (0, 4, True)
    assert all(got[i] == (0, i, True) for i in (5, 6, 7, 8, 9, 10))
    assert got[11] == (1, 11, True) and got[12] == (1, 11, False) and got[13] == (1, 13, True) and got[14] == (1, 13, False)
    assert got[None] == (0, None, False)


def test_empty_table(spark):
    assert run(table(spark, [])) == {}


def test_lattice():
    roots = lattice_dedup.e8_roots()
    assert len(roots) == 240 and np.allclose((roots**2).sum(1), 2)
    rng = np.random.default_rng(4)
    y = rng.normal(size=(50, 8)) * 2
    near = lattice_dedup.nearest_e8(y)
    for p, q in zip(y, near):
        assert np.allclose(q, np.rint(q)) or np.allclose(q - 0.5, np.rint(q - 0.5))
        assert abs(q.sum() / 2 - round(q.sum() / 2)) < 1e-9
        assert ((p - q) ** 2).sum() <= ((p - q - roots) ** 2).sum(1).min() + 1e-9
    assert len(set(itertools.chain(map(tuple, roots)))) == 240
