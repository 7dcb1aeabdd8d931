from collections import Counter

from fleetfold.llm import line_dedup


def brute(rows, percent, least):
    pages = {(s, t) for _, t, s in rows if t is not None}
    total = Counter(s for s, _ in pages)
    count = Counter((s, x) for s, t in pages for x in {x.strip(" ") for x in t.split("\n")} if x)
    bad = {k for k, c in count.items() if c >= least and 100 * c > percent * total[k[0]]}
    return sorted(((i, None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in bad))
                   for i, t, s in rows), key=str)


def test_against_brute_force(documents):
    rows = [(i, f"Home | About\nbody {i}\n\n  Home | About  \nshared {i % 7}", "a") for i in range(40)]
    rows += [(100 + i, f"Home | About\nown {i}", None) for i in range(3)] + [(200 + i, f"x {i}\nfoot", None) for i in range(9)]
    rows += [(300, None, "a"), (301, "", "a"), (302, "\n\n", "a"), (303, "foot", None), (5, rows[5][1], "a"), (None, "foot\nz", None)]
    rows += [(400 + i, "copy line\nsecond", "c") for i in range(20)]
    got = sorted(((r.doc_id, r.text) for r in line_dedup.drop_boilerplate(documents(*rows), percent=20, min_pages=4).collect()), key=str)
    assert got == brute(rows, 20, 4)
    assert ("Home | About" not in str([t for i, t in got if i is not None and i < 40]))
    assert [t for i, t in got if i is not None and i >= 400] == ["copy line\nsecond"] * 20


def test_columns_and_length(spark):
    df = spark.createDataFrame([(i, f"nav\nt{i}", "s", 6, "x", 1) for i in range(10)],
                               "doc_id long, text string, source string, n_chars int, host_key string, gone_lines int")
    out = line_dedup.drop_boilerplate(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert {(r.text, r.n_chars) for r in out.collect()} == {(f"t{i}", 2) for i in range(10)}


def test_empty_table_and_long_text(documents):
    assert line_dedup.drop_boilerplate(documents()).count() == 0
    text = "\n".join(["nav"] * 20_000 + ["end"])
    rows = [(i, text + str(i)) for i in range(6)]
    assert {r.text for r in line_dedup.drop_boilerplate(documents(*rows)).collect()} == {f"end{i}" for i in range(6)}


def test_hosts_of_few_pages_lose_what_repeats(documents):
    rows = [(10 * h + i, f"nav {h}\nbody {h} {i}\n nav {h}", f"host {h}") for h in range(60) for i in range(2 + h % 3)]
    rows += [(1000 + h, f"only {h}\nnav {h}", f"single {h}") for h in range(5)]
    got = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(documents(*rows)).collect()}
    assert got == {i: text if i >= 1000 else text.split("\n")[1] for i, text, _ in rows}


def test_near_copies_above_the_share_lose_what_they_share(documents):
    """5 of 100 pages are not over 5 %, 6 are; exact copies of a member add nothing."""
    shared = "first shared line\nsecond shared line\n"
    for size in (5, 6):
        rows = [(i, f"{shared}edit {i}") for i in range(size)] + [(i, f"body {i}") for i in range(size, 100)]
        rows += [(200 + i, f"{shared}edit 0") for i in range(50)]
        got = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(documents(*rows)).collect()}
        assert got == {i: text.replace(shared, "") if size == 6 else text for i, text in rows}
