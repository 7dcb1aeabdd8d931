import zlib
from collections import Counter, defaultdict

from fleetfold.llm import kd_shards


def check(df, rows):
    out = kd_shards.assign(df).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert all(0 <= r.shard < 8 and r.law == "bytes" and r.grown_shard is None for r in out)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = Counter()
    for r in out:
        total[r.shard] += r.size
    return out, total


def test_bytes_are_near_equal_and_copies_stay_together(documents, words):
    rows = [(i, words(i, 5 + i % 60), f"s{i % 5}", "de" if i % 3 else "en") for i in range(900)]
    rows += [(1000 + i, words(i % 4, 30), "s0") for i in range(80)]
    out, total = check(documents(*rows), [r[:2] for r in rows])
    assert max(total.values()) <= 1.03 * min(total.values()) and len(total) == 8
    shards = defaultdict(set)
    for r in out:
        shards[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_a_group_larger_than_a_shard_is_dealt_out(documents, words):
    rows = [(i, "the same text again") for i in range(600)] + [(1000 + i, words(i, 4)) for i in range(600)]
    _, total = check(documents(*rows), rows)
    assert max(total.values()) <= 1.1 * min(total.values())


def test_tree_splits_the_widest_dimension(documents, words):
    rows = [(i, words(i, 20), "s", "en") for i in range(400)]
    out, _ = check(documents(*rows), [r[:2] for r in rows])
    assert len({r.shard for r in out}) == 8


def test_values_of_all_magnitudes_are_split_at_their_median(spark):
    points = spark.createDataFrame([(1, [2.0 ** (-9 * k), 0.0, 0.0, 0.0]) for k in range(100)], "w long, x array<double>")
    tree, weights = kd_shards._grow(points, 1)
    assert tree.cut[0] == 2.0 ** (-9 * 50) and tree.depth <= 7
    assert sorted(weights.values()) == [1] * 100


def test_odd_rows(spark, documents, words):
    rows = [(1, None), (1, None), (None, ""), (2, "é" * 100_000), (3, "x"), (3, "y"), (-5, "z")]
    check(documents(*rows), rows)
    df = spark.createDataFrame([(1, "a", 7, 8), (2, "b", 7, 8)], "doc_id long, text string, shard int, g1 int")
    check(df, [(1, "a"), (2, "b")])
    assert kd_shards.assign(documents()).count() == 0
