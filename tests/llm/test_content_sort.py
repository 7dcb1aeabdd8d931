import hashlib
import random
import string

import pytest
from pyspark.sql import functions as F

from fleetfold.llm import content_sort
from fleetfold.llm.queries import op11_content_sort

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, pick):
    groups = {}
    for i, text in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(i)
    return sorted((i, pick(groups[t]), len(groups[t]), i == pick(groups[t]), hashlib.sha256(t.encode()).hexdigest())
                  for i, text in rows for t in [(text or "").translate(LOWER)])


@pytest.mark.parametrize("keep, pick", [("smallest", min), ("largest", max)])
def test_against_brute_force_with_a_hot_group(spark, documents, keep, pick):
    rng = random.Random(3)
    rows = [(i, "Common header " * 40 + rng.choice(["A", "b", "É"])) for i in range(300)]
    rows += [(1000 + i, f"Text {rng.randrange(400)}") for i in range(500)]
    rows += [(5000, None), (5001, ""), (5002, "é"), (5003, "É"), (5004, "x" * 2_000_000), (5005, "X" * 2_000_000)]
    rng.shuffle(rows)
    got = content_sort.copies(documents(*rows).repartition(5), keep)
    assert sorted(tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == brute(rows, pick)


def test_hot_groups_are_split(spark, documents):
    rows = documents(*[(i, "same") for i in range(400)], *[(1000 + i, f"t{i}") for i in range(400)])
    hot = content_sort._hot_groups(rows.select(F.xxhash64("text").alias("h")), 800 / 16).collect()
    assert [r.pieces for r in hot] == [8]


def test_repeated_rows_null_ids_and_other_columns(spark):
    df = spark.createDataFrame(
        [(7, "a", 1, "p"), (7, "a", 1, "p"), (7, "A", 2, "q"), (None, "a", 3, "r"), (None, "n", 4, "s"), (None, "N", 5, "t")],
        "doc_id long, text string, size int, body string")
    got = content_sort.copies(df)
    assert sorted((r.keep_id or 0, r.group_size) for r in got.collect()) == [(0, 2)] * 2 + [(7, 4)] * 4
    assert got.where("kept").count() == 2
    kept = content_sort.drop_copies(df)
    assert kept.columns == df.columns and kept.count() == 2
    assert {r.doc_id for r in kept.collect()} == {7, None}


def test_drop_copies_keeps_original_texts(spark, documents):
    kept = content_sort.drop_copies(documents((3, "ABC"), (2, "abc"), (9, "Other")), keep="largest")
    assert {(r.doc_id, r.text, r.source) for r in kept.collect()} == {(3, "ABC", "s"), (9, "Other", "s")}


def test_empty_and_wrong_choice(spark, documents):
    assert content_sort.copies(documents()).count() == 0
    with pytest.raises(ValueError):
        content_sort.copies(documents(), keep="any")


def test_plan_sorts_ranges_once_and_never_hashes_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", F.col("text").alias("body"), F.xxhash64("text").alias("h"))
    hot = content_sort._hot_groups(rows, 10.0)
    plan = content_sort._sorted(rows, hot, "smallest")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning" not in plan and plan.count("+- Sort") == 1


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op11_content_sort(spark, sf_dir).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, max)
