from fleetfold.llm.components import connected


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    other = [(-5, 7_000), (7_000, 7_000), (None, 3)]
    df = spark.createDataFrame(chain + star + other + star, "a long, b long")
    got = {r.node: r.label for r in connected(df).collect()}
    assert got == ({i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)} | {-5: -5, 7_000: -5})


def test_no_links(spark):
    assert connected(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_hubs_among_chains(spark):
    """Stars of many links beside and behind each other; hubs get their minima by broadcast."""
    import random

    rng = random.Random(8)
    links = [(1_000, 2_000 + i) for i in range(900)] + [(5, 2_500), (2_899, 7_000)] + [(7_000, 8_000 + i) for i in range(700)]
    links += [(20_000 + i, 20_001 + i) for i in range(30)] + [(20_030, 30_000 + i) for i in range(300)]
    links = [rng.choice([(a, b), (b, a)]) for a, b in links]
    got = {r.node: r.label for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[n] == (5 if n < 20_000 else 20_000) for n in {x for e in links for x in e}) and len(got) == len({x for e in links for x in e})
