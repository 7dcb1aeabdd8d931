import random

from pyspark.sql import functions as F

from fleetfold.llm import fingerprints, jaccard_join, lattice_dedup


def test_colliding_halves_get_other_numbers(spark):
    pairs = [(1, 5), (1, 6), (1, 6), (2, 5), (3, 9), (3, 8), (3, 7)]
    df = spark.createDataFrame(pairs, "cls long, chk long")
    moved = fingerprints.colliding(df)
    assert set(moved) == {(1, 6), (3, 8), (3, 9)}
    got = {(r.chk, r.cls) for r in fingerprints.renamed(df, moved).collect()}
    assert len({c for _, c in got}) == 6 and {(5, 1), (5, 2), (7, 3)} <= got
    assert fingerprints.colliding(df.limit(0)) == {}


def test_vectors_that_share_half_a_fingerprint(spark, monkeypatch):
    """With three first halves for all vectors the result is the same as with 64-bit ones."""
    rng = random.Random(1)
    rows = []
    for g in range(12):
        centre = [rng.gauss(0, 1) for _ in range(16)]
        rows += [(len(rows) + k, [c + rng.gauss(0, 0.02) for c in centre]) for k in range(4)] + [(len(rows) + 4, centre), (len(rows) + 5, centre)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted(map(tuple, lattice_dedup.near_duplicates(df).collect()))
    monkeypatch.setattr(lattice_dedup, "_fingerprint", lambda e: (F.pmod(F.xxhash64(e), F.lit(3)), F.xxhash64(F.lit(1), e)))
    assert sorted(map(tuple, lattice_dedup.near_duplicates(df).collect())) == want


def test_sets_that_share_half_a_fingerprint(documents, words, monkeypatch):
    texts = [words(i, 60) for i in range(8)]
    rows = [(10 * i + k, t if k < 2 else t + f" x{k}") for i, t in enumerate(texts) for k in range(4)]
    docs = documents(*rows)
    want = sorted(map(tuple, jaccard_join.document_classes(docs).collect()))
    assert {r[2] for r in want} == {10 * i for i in range(8)}
    whole = jaccard_join._fingerprint
    monkeypatch.setattr(jaccard_join, "_fingerprint", lambda s: (whole(s)[0] % 3, whole(s)[1]))
    assert sorted(map(tuple, jaccard_join.document_classes(docs).collect())) == want
