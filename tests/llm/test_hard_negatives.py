import math
import random

import numpy as np
import pytest

from fleetfold.llm import hard_negatives
from fleetfold.llm.queries import op13_hard_negatives

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, step=100, n_pos=5, n_neg=5, window=(80, 100), scale=256):
    whole = [(i, y, [math.floor(scale * c) for c in v]) for i, y, v in rows]
    out = []
    for a, y, x in whole:
        if a % step:
            continue
        scores = [(sum(p * q for p, q in zip(x, v)), i, z) for i, z, v in whole if i != a and len(v) == len(x)]
        scores.sort(key=lambda s: (-s[0], s[1]))
        for ps, p, _ in [s for s in scores if s[2] == y][:n_pos]:
            fit = [s for s in scores if s[2] != y and window[0] * ps <= 100 * s[0] <= window[1] * ps][:n_neg]
            out += [(a, p, r + 1, n, ps, ns) for r, (ns, n, _) in enumerate(fit)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def clustered(n, width, centres, seed, noise=0.05):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, width))
    return [(i, int(rng.integers(3)), (middle[rng.integers(centres)] + noise * rng.normal(size=width)).tolist()) for i in range(n)]


@pytest.mark.parametrize("rows", [clustered(600, 8, 5, 1), clustered(600, 8, 300, 2, 1.0), clustered(500, 3, 1, 3, 0.001)])
def test_against_brute_force(spark, rows):
    got = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), anchor="vec_id % 10 = 0")
    want = brute(rows, 10)
    assert want and rows_of(got) == want


def test_many_trees_shards_and_steps(spark, monkeypatch):
    for name, size in (("TREE", 7), ("SHARD", 50), ("STEP", 20)):
        monkeypatch.setattr(hard_negatives, name, size)
    rows = clustered(400, 6, 4, 4, 0.3)
    assert rows_of(hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), anchor="vec_id % 5 = 0")) == brute(rows, 5)


def test_ties_hot_vector_and_hot_label(spark):
    rng = random.Random(5)
    rows = [(i, 0 if i % 3 else rng.randrange(4), [0.5, 0.25, -0.25] if rng.random() < 0.6 else [rng.randrange(-2, 3) / 4 for _ in range(3)])
            for i in range(500)]
    assert rows_of(hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), anchor="vec_id % 20 = 0")) == brute(rows, 20)


def test_trees_leave_candidates_out():
    """Bounds hold for every pair, and far candidates are not wanted where the tree's edges are short."""
    rng = np.random.default_rng(6)
    middle = np.repeat(rng.normal(size=(4, 16)) * 100, 50, axis=0)
    anchors = np.rint(middle + rng.normal(size=middle.shape))
    candidates = np.rint(np.repeat(rng.normal(size=(4, 16)) * 100, 100, axis=0) + rng.normal(size=(400, 16)))
    true, asked = anchors @ candidates.T, 0

    def wanted(at, low, high):
        assert (low <= true[at]).all() and (high >= true[at]).all()
        return high >= np.partition(low, -5, axis=1)[:, -5:-4]

    levels = hard_negatives.spanning_tree(anchors)
    assert sorted(k for at, _, _ in levels for k in at) == list(range(200))
    for at, pairs, scores in hard_negatives.bounded_scores(levels, anchors, candidates, wanted):
        asked += pairs.sum()
        assert (scores[pairs] == true[at][pairs]).all()
    assert asked < 0.6 * true.size


def test_odd_rows(spark):
    nan = float("nan")
    good = [(100, 1, [1.0, 0.0]), (1, 1, [0.5, 0.0]), (2, 2, [0.45, 0.0]), (3, 2, [0.1, 0.0]), (4, 1, [0.5, 0.5, 0.5])]
    odd = [(None, 1, [1.0, 0.0]), (5, None, [0.45, 0.0]), (6, 2, None), (7, 2, [nan, 0.0]), (8, 2, [None, 0.0]), (9, 2, [float("inf"), 0.0]),
           (10, 2, []), (1, 1, [0.5, 0.0]), (1, 2, [0.45, 0.0])]
    df = spark.createDataFrame([(*r, 7, "s") for r in good + odd], SCHEMA + ", rank int, tree string")
    assert rows_of(hard_negatives.mine(df)) == [(100, 1, 1, 2, 256 * 128, 256 * 115)]
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame(good[1:], SCHEMA)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame(good[:1], SCHEMA)).count() == 0


def test_negative_and_zero_scores(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [-0.5, 0.0]), (2, 1, [0.0, 1.0]), (3, 2, [0.0, 0.5]), (4, 2, [-0.45, 0.0])]
    assert rows_of(hard_negatives.mine(spark.createDataFrame(rows, SCHEMA))) == brute(rows) == [(0, 2, 1, 3, 0, 0)]


def test_large_whole_numbers(spark):
    rng = random.Random(7)
    rows = [(i, i % 2, [float(rng.randrange(-2**20, 2**20)) for _ in range(4)]) for i in range(120)]
    assert rows_of(hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), anchor="vec_id % 10 = 0")) == brute(rows, 10)
    with pytest.raises(ValueError):
        hard_negatives.mine(spark.createDataFrame([(0, 1, [1e12])], SCHEMA))


def test_query(spark, sf_dir):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [float(c) for c in r.embedding])
            for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert rows_of(op13_hard_negatives(spark, sf_dir)) == brute(rows)
