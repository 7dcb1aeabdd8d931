import random
from itertools import combinations

from fleetfold.llm import decontaminate


def bench(spark, *rows):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def found(df, items):
    return {(r.doc_id, r.item_id): (r.start, r.matched, r.of) for r in decontaminate.benchmark_overlaps(df, items).collect()}


def test_whole_substituted_and_partial_passages(spark, documents, words):
    rng = random.Random(3)
    items = [words(10 + i, 15 + 9 * i, 4000) for i in range(4)]
    changed = items[3].split()
    for k in range(0, len(changed), 9):
        changed[k] = "zzz"
    rows = [(1, words(1, 50) + " " + items[0] + " " + words(2, 30)),
            (2, (words(3, 5) + ". " + " ".join(changed)).upper()),
            (3, " ".join(items[2].split()[10:])),
            (4, words(4, 400, 4000)), (5, " ".join(sorted(items[1].split(), key=lambda _: rng.random()))),
            (6, None), (7, ""), (8, items[1].replace(" ", ", ") + "\n" + items[0]), (9, " ".join(items[2].split()[:6]))]
    got = found(documents(*rows), bench(spark, *enumerate(items)))
    assert set(got) == {(1, 0), (2, 3), (3, 2), (8, 1), (8, 0)}
    assert got[1, 0] == (50, 15, 15) and got[3, 2] == (-10, 20, 20) and got[2, 3][1] >= 15


def test_against_brute_force(spark, documents):
    """Every place is scored as a plain comparison says, whether or not it holds a seed."""
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice("abcdefgh") for _ in range(24))) for i in range(3)]
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(60))) for i in range(12)]
    rows += [(50 + i, rows[i][1] + " " + items[i % 3][1][:30 + i]) for i in range(8)]
    want = {}
    for d, text in rows:
        w = text.split()
        for i, item in items:
            v = item.split()
            best = None
            for s in range(-len(v) + 8, len(w)):
                same = [0 <= s + j < len(w) and w[s + j] == v[j] for j in range(len(v))]
                top = max(sum(same[a:a + 20]) for a in range(len(v) - 19))
                if top >= 15 and (best is None or (top, -s) > (best[1], -best[0])):
                    best = (s, top, 20)
            if best:
                want[d, i] = best
    assert want and found(documents(*rows), bench(spark, *items)) == want


def test_substitutions_at_the_limit_leave_no_place_out(spark, documents, words):
    """All patterns of short items, and each fourth word replaced in long ones."""
    items = [words(30 + n, n, 10**6) for n in (8, 9, 12, 15, 16)] + [words(50 + n, n, 10**6) for n in (20, 40, 55)]
    rows, want = [], {}

    def add(item, gone):
        w = items[item].split()
        of = min(len(w), 20)
        top = max(sum(k not in gone for k in range(a, a + of)) for a in range(len(w) - of + 1))
        want[len(rows), item] = (2, top, of)
        rows.append((len(rows), "so then " + " ".join("zz" if k in gone else x for k, x in enumerate(w)) + " the end"))

    for item in range(5):
        n = len(items[item].split())
        for gone in combinations(range(n), n // 4):
            add(item, gone)
    for item in range(5, 8):
        for offset in range(4):
            add(item, range(offset, len(items[item].split()), 4))
    assert found(documents(*rows), bench(spark, *enumerate(items))) == want


def test_filter_nulls_and_repeats(spark, words):
    item = words(20, 30)
    df = spark.createDataFrame([(1, item, "a"), (1, "clean", "b"), (None, item, "c"), (None, "clean", None), (2, None, "d"), (2, None, "d")],
                               "doc_id long, text string, k1 string")
    out = decontaminate.drop_contaminated(df, bench(spark, (1, item), (1, item), (None, item), (2, None), (3, "too short")))
    assert out.columns == df.columns
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(
        [(1, "clean", "b"), (None, "clean", None), (2, None, "d"), (2, None, "d")], key=str)


def test_empty_tables(spark, documents, words):
    item = words(20, 30)
    assert found(documents(), bench(spark, (1, item))) == {}
    assert found(documents((1, item)), bench(spark)) == {}
    assert decontaminate.drop_contaminated(documents((1, item)), bench(spark)).count() == 1
    assert set(found(documents((1, words(21, 20_000) + " " + item)), bench(spark, (1, item)))) == {(1, 1)}


def test_short_items_are_found_whole(spark, documents):
    items = ["alpha beta gamma", "one two three four", "p q r s t u v", "two words", "single", "", None, "p q r s t u v x"]
    rows = [(1, "so Alpha, beta gamma!"), (2, "alpha beta delta gamma"), (3, "zero one two three four five"), (4, "one two three five"),
            (5, "p q r s t u v"), (6, "p q r s t u w"), (7, "two words single"), (8, "gamma one two three four alpha beta gamma"), (9, "p q r s t u z x")]
    got = found(documents(*rows), bench(spark, *enumerate(items)))
    assert got == {(1, 0): (1, 3, 3), (3, 1): (1, 4, 4), (5, 2): (0, 7, 7), (5, 7): (0, 7, 8), (8, 1): (1, 4, 4), (8, 0): (5, 3, 3), (6, 7): (0, 6, 8), (9, 7): (0, 7, 8)}
