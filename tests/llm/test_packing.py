import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from fleetfold.llm import packing
from fleetfold.llm.queries import op5_best_fit_packing, vocabulary

PATH = vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encode():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]


def check(rows, texts, encode, capacity=packing.CAPACITY):
    """Pieces rebuild every document and sequences are gapless; returns the number of sequences."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for doc, own in pieces.items():
        ids, at = encode(texts[doc]), 0
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // capacity)))
        for r in own:
            part = ids[r.start:r.start + r.length]
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            assert r.length == capacity or r.piece == 0
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(sequences)


def test_whole_table(spark, sf_dir, encode):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op5_best_fit_packing(spark, sf_dir).collect()
    used = check(rows, texts, encode)
    assert used <= 1.02 * sum(r.length for r in rows) / packing.CAPACITY + 1


def test_odd_texts(documents, encode):
    texts = {1: None, 2: "", 3: " ", 4: "\n", 5: "a  b", 6: "a \n b", 7: " lead", 8: "trail ", 9: "it's 's\n's don't", 10: "<|endoftext|> x",
             11: "tab\tbed nbsp", 12: "é Ünïcödé 漢字 \U0001f600", 13: "x\n\ny", 14: "a" * 5000, 15: " ".join(map(str, range(5000))),
             16: "\r\nq\r\n", 17: "a\n b", 18: "end\n", 19: " sep   z", 20: "\x1c x\x1cy z"}
    check(packing.pack(documents(*texts.items()), PATH).collect(), texts, encode)


def test_rounds_exchange_and_keep_every_piece(spark, documents, encode, monkeypatch):
    rng = random.Random(1)
    texts = {i: " ".join(["word"] * rng.randrange(5, 40)) for i in range(800)}
    monkeypatch.setattr(packing, "_parts", lambda pieces, most: max(1, pieces // 40))
    used = check(packing.pack(documents(*texts.items()), PATH, capacity=64).collect(), texts, encode, 64)
    total = sum(len(encode(t)) for t in texts.values())
    assert used <= 1.05 * total / 64 + 1


def test_added_tokens_have_their_own_ids(documents, encode):
    texts = {1: "<|endoftext|>", 2: "hello <|endoftext|> world", 3: "a<|endoftext|><|endoftext|>b", 4: "  <|endoftext|>  x\n", 5: "<|endoftext|", 6: "x  <|endoftext|>"}
    assert encode(texts[1]) == [50256, packing.END]
    check(packing.pack(documents(*texts.items()), PATH).collect(), texts, encode)


def test_sequences_do_not_depend_on_the_session(spark, documents):
    rng = random.Random(5)
    docs = documents(*[(i, " ".join(["word"] * rng.randrange(1, 900))) for i in range(900)])
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("2", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append({(r.doc_id, r.piece, r.sequence_id, r.offset) for r in packing.pack(docs, PATH).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_long_words_are_not_held():
    import gc

    words = packing._encoder(PATH)
    words(" ".join("x" * 500 + str(i) for i in range(50)) + " short")
    tables = [d for d in gc.get_objects() if type(d).__name__ == "Chunks" and " short" in d]
    assert len(tables) == 1 and max(map(len, tables[0])) <= packing.LONGEST_WORD


def test_lower_bounds():
    assert packing.lower_bound({}, 10) == 0
    assert packing.lower_bound({6: 5}, 10) == 5
    assert packing.lower_bound({6: 5, 4: 5}, 10) == 5
    assert packing.lower_bound({4: 7}, 10) == 4  # two at most in each
    rng = random.Random(2)
    for _ in range(200):
        items = [rng.randrange(1, 11) for _ in range(rng.randrange(1, 8))]
        counts = {x: items.count(x) for x in items}
        assert packing.lower_bound(counts, 10) <= best(sorted(items, reverse=True), 10)


def best(items, capacity):
    """The fewest bins, by search."""
    low = [len(items)]

    def place(k, rooms):
        if len(rooms) >= low[0]:
            return
        if k == len(items):
            low[0] = len(rooms)
            return
        for i, room in enumerate(rooms):
            if room >= items[k]:
                place(k + 1, rooms[:i] + [room - items[k]] + rooms[i + 1:])
        place(k + 1, [*rooms, capacity - items[k]])

    place(0, [])
    return low[0]


def test_repeats_nulls_and_empty_table(spark, documents):
    df = spark.createDataFrame([(1, "a b", 1), (1, "a b", 2), (None, "c", 3), (2**53 + 1, "d", 4)], "doc_id long, text string, part int")
    rows = packing.pack(df, PATH).collect()
    assert sorted(((r.doc_id, r.length) for r in rows), key=str) == sorted([(1, 3), (1, 3), (None, 2), (2**53 + 1, 2)], key=str)
    assert len({(r.sequence_id, r.offset) for r in rows}) == 4
    assert packing.pack(documents(), PATH).count() == 0
