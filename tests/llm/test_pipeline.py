"""The pipeline over small tables, against what its stages' rules say of planted rows."""

import random

import pytest

from fleetfold.llm import packing
from fleetfold.llm.queries import vocabulary

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def tables(spark, folder, rows, benchmark, labels):
    schema = "doc_id long, text string, lang string, source string, n_chars long, part int, seq string"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def row(i, text, source="s"):
    return i, text, "en", source, None if text is None else len(text), 1, "x"


def test_planted_rows(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(4000)}"
    clean = [row(i, " ".join(word() for _ in range(60)) + f"\nfoot note\nline {i}", f"s{i % 2}") for i in range(200)]
    toxic = [row(1000 + i, "vile nasty rotten " * 3 + " ".join(word() for _ in range(30))) for i in range(40)]
    item = " ".join(f"bench{j}" for j in range(25))
    leak = [row(2000, "intro " + item), row(2001, None), row(2002, ""), row(None, "no id at all"), row(None, "no id at all")]
    copies = [row(3000 + i, clean[5][1].replace("\nline 5", f"\nline {i}x"), "s1") for i in range(3)]
    folder = tables(spark, str(tmp_path), clean + toxic + leak + copies, [(1, item), (2, None)],
                    [(i, 1, 0) for i in range(200)] + [(1000 + i, 0, 1) for i in range(40)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "part", "seq"], name
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = [r.doc_id for r in rows if r.piece == 0]
    assert sorted(i for i in ids if i is not None) == [*range(200), 2001, 2002] and ids.count(None) == 2
    by_sequence = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert by_sequence.get(r.sequence_id, 0) == r.offset
        by_sequence[r.sequence_id] = r.offset + r.length
    assert max(by_sequence.values()) <= packing.CAPACITY
    encode = packing._encoder(vocabulary("byte_bpe_50k.json"))
    whole = {r.doc_id: r.length for r in rows}
    assert whole[7] == len(encode(clean[7][1].replace("foot note\n", ""))) // 4 + 1  # the foot is boilerplate


def test_empty_tables(spark, tmp_path):
    folder = tables(spark, str(tmp_path), [], [], [])
    out = corpus_pipeline.run(spark, folder)
    assert out.count() == 0 and "sequence_id" in out.columns
