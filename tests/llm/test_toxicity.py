import math
import random
import zlib

import pytest
import xxhash

from fleetfold.llm import toxicity
from fleetfold.llm.queries import op2_toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        w = [f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(rng.randrange(20, 80))]
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "nasty", "rotten"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark, documents):
    rows, labels = corpus(1500, 1)
    return toxicity.train(documents(*rows), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_held_out_accuracy(spark, documents, model):
    rows, labels = corpus(400, 2)
    got = {r.doc_id: r.score for r in toxicity.score(documents(*rows), model).collect()}
    assert sum((got[i] >= 0.5) == bool(y) for i, y in labels) / len(labels) > 0.97


def test_weights_are_sparse_and_repeatable(spark, documents, model):
    assert 0 < len(model.index) < 400 and len(model.index) == len(model.weight)
    rows, labels = corpus(1500, 1)
    again = toxicity.train(documents(*rows[::-1]).repartition(7), spark.createDataFrame(labels[::-1], "doc_id long, toxic int"))
    assert again.index == model.index and again.weight == pytest.approx(model.weight)


def test_odd_rows(spark, documents, model):
    rows = [(1, None), (2, ""), (3, "VILE, nasty; rotten!"), (3, "VILE, nasty; rotten!"), (None, "fine"), (4, "vile " * 50_000), (5, "\u0001")]
    got = toxicity.score(documents(*rows), model).collect()
    score = {r.doc_id: r.score for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert score[1] == score[2] == score[5] < 0.5 < score[3]
    assert toxicity.score(documents(), model).count() == 0


def test_odd_labels(spark, documents):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (9, 1)], "doc_id long, toxic int")
    model = toxicity.train(documents((1, "a"), (2, "b"), (3, "c")), labels)
    assert model.index == [] and toxicity.score(documents((1, "a")), model).first().score < 0.5
    assert toxicity.train(documents(), labels.limit(0)) == toxicity.Model()


def test_states_are_averaged_over_all_shards_without_a_cut(spark, documents):
    """Every coordinate as plain runs of the shards say, averaged each epoch, the penalty only in the weights."""
    rates, rng = toxicity.Rates(), random.Random(6)
    rows = [(i, "common " + ("rare " if i % 5 == 0 else "") + f"w{rng.randrange(30)}") for i in range(400)]
    labels = {i: int(i % 10 == 0 or rng.random() < 0.1) for i, _ in rows}
    frame = spark.createDataFrame([(i,) for i in labels], "doc_id long")
    shard = {r.doc_id: r.s for r in frame.selectExpr("doc_id", "pmod(xxhash64(doc_id, 7), 5) AS s").collect()}
    places = toxicity._features()
    state = {}
    for _ in range(toxicity.EPOCHS):
        ends = []
        for s in range(5):
            mine = dict(state)
            for i, text in sorted(rows, key=lambda r: xxhash.xxh64_intdigest(str(r[0]))):
                if shard[i] == s:
                    at = [*set(places(text.encode()).tolist()), -1]
                    free = toxicity.Rates(l1=0.0)
                    w = {c: toxicity._weight(*mine.get(c, (0.0, 0.0)), rates if c >= 0 else free) for c in at}
                    g = 1 / (1 + math.exp(-sum(w.values()))) - labels[i]
                    for c in at:
                        z, n = mine.get(c, (0.0, 0.0))
                        mine[c] = (z + g - (math.sqrt(n + g * g) - math.sqrt(n)) / rates.alpha * w[c], n + g * g)
            ends.append(mine)
        state = {c: tuple(sum(e.get(c, state.get(c, (0.0, 0.0)))[k] for e in ends) / 5 for k in (0, 1)) for c in set().union(*ends)}
    want = {c: w for c in state if c >= 0 and (w := toxicity._weight(*state[c], rates))}
    model = toxicity.train(documents(*rows), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    assert want and dict(zip(model.index, model.weight)) == pytest.approx(want)


def test_filter_keeps_columns(spark):
    rows, labels = corpus(1200, 3)
    df = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    kept = toxicity.drop_toxic(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == df.columns
    left = {r.doc_id for r in kept.collect()}
    assert sum((i in left) != bool(y) for i, y in labels) / len(labels) > 0.97


def test_query(spark, sf_dir):
    rows = op2_toxicity(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)


def test_calibration_restores_the_size_of_margins(spark, documents):
    """Scores of rows not learned from: as many toxic ones over a half as there are, and the log loss no worse than uncalibrated."""
    rows, labels = corpus(2000, 4)
    df = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(documents(*rows[:1500]), df)
    plain = toxicity.Model(model.index, model.weight, toxicity.Model().bias)
    loss = {}
    for name, m in (("fitted", model), ("plain", plain)):
        got = {r.doc_id: min(max(r.score, 1e-9), 1 - 1e-9) for r in toxicity.score(documents(*rows[1500:]), m).collect()}
        loss[name] = -sum(math.log(got[i] if y else 1 - got[i]) for i, y in labels[1500:])
    assert model.slope > 0 and loss["fitted"] < loss["plain"]


def test_one_label_only_has_no_fit(spark, documents):
    labels = spark.createDataFrame([(i, 0) for i in range(50)], "doc_id long, toxic int")
    model = toxicity.train(documents(*[(i, f"word{i % 7} common") for i in range(50)]), labels)
    assert model.slope == 1.0 and toxicity.score(documents((1, "common")), model).first().score < 0.5


def test_long_training_texts_stream(spark, documents):
    rows = [(i, ("vile " if i % 2 else "fine ") * 60_000 + f"w{i}") for i in range(40)]
    model = toxicity.train(documents(*rows), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(documents((1, "vile"), (2, "fine")), model).collect()}
    assert got[1] > got[2]
