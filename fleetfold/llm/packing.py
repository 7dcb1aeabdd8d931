"""Packs tokenized documents into sequences: best-fit decreasing, certified by lower bounds and repacked where open."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.words import cut_lineage, small_batches

CAPACITY = 1024
END = 2
#: Fixed value: how byte-level BPE cuts a text before it merges.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces a partition packs at a time. Nothing else decides how many partitions there are.
PART_PIECES = 50_000
#: A task's table of words takes words up to so many characters, and is emptied at so many words.
LONGEST_WORD, WORDS_HELD = 64, 250_000
#: Ids go through Python as text: beside a null, pandas would hold them as floating-point numbers.
PIECES = "doc_id string, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", part long, seq int, offset long, open boolean"


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END,
         part_pieces: int = PART_PIECES) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its token ids and then ``end``. Only a document longer than
    ``capacity`` is cut, into pieces of ``capacity`` ids; its first piece takes what is left over.

    Pieces are dealt to partitions by hash and each partition runs best-fit
    decreasing. Dual feasible functions give each partition a number of sequences no
    packing of it can go below. A partition that reaches its bound is certified
    and stays. The others pass on the sequences that are not nearly full: their pieces
    are dealt anew into a quarter as many partitions, or fewer, and packed again, until all are certified or one
    partition has packed all that were left. The outcome does not depend on settings of the session.

    Strings that the vocabulary lists as added tokens become these tokens. A null text is empty, which is the one id ``end``. Repeated rows and null ids
    give pieces of their own. Other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    cut = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(_pieces(vocabulary, capacity, end), PIECES)
    pieces = cut_lineage(cut, "pieces")
    total = pieces.count()
    done, parts = [], _parts(total, part_pieces)
    rest = pieces
    for turn in count():
        dealt = rest.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(turn)), F.lit(parts)))
        packed = cut_lineage(dealt.groupBy("part").applyInPandas(_best_fit(capacity), PACKED), "packed")
        done.append(packed.where("not open").withColumn("turn", F.lit(turn)))
        rest = packed.where("open").select(*pieces.columns)
        left = rest.count()
        if parts == 1 or left == 0:
            done.append(packed.where("open").withColumn("turn", F.lit(turn)))
            break
        parts = max(1, min(_parts(left, part_pieces), parts // 4))
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    # turn, partition and place in it make the number: 4, 30 and 29 bits
    number = F.shiftleft(F.col("turn").cast("long"), 59) + F.shiftleft("part", 29) + F.col("seq")
    return whole.select(F.col("doc_id").cast("long").alias("doc_id"), "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), "offset")


def lower_bound(lengths: dict[int, int], capacity: int) -> int:
    """Sequences that any packing of so many pieces of each length needs.

    The best of the area bound and two families of dual feasible functions: one
    rounds to a k-th of the capacity, the other counts pieces above capacity minus t
    in full and those below t not at all.
    """
    total = sum(x * c for x, c in lengths.items())
    best = -(-total // capacity)
    for k in range(1, 21):
        value = sum(c * (x * k if (k + 1) * x % capacity == 0 else (k + 1) * x // capacity * capacity)
                    for x, c in lengths.items())
        best = max(best, -(-value // (k * capacity)))
    for t in {x for x in lengths if 2 * x <= capacity} | {capacity - x + 1 for x in lengths if 2 * x > capacity + 1}:
        value = sum(c * (capacity if x > capacity - t else 0 if x < t else x) for x, c in lengths.items())
        best = max(best, -(-value // capacity))
    return best


def _parts(pieces: int, part_pieces: int) -> int:
    return max(1, -(-pieces // part_pieces))


def _pieces(vocabulary: str, capacity: int, end: int) -> Callable:
    """Token counts and checksums of documents, cut to pieces.

    No token reaches across a single blank or line feed from the word before it, so
    words have the same ids wherever they stand and are looked up. Texts with
    longer white space are encoded whole.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        encode = _encoder(vocabulary)
        close = end.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc, text in zip(batch.doc_id, batch.text):
                ids = encode(text or "") + close
                size = len(ids) // 4
                first = size if size <= capacity else size % capacity or capacity
                start, length, piece = 0, first, 0
                while start < size:
                    rows.append((doc, piece, start, length, zlib.crc32(ids[4 * start:4 * (start + length)])))
                    start, length, piece = start + length, capacity, piece + 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _encoder(vocabulary: str) -> Callable[[str], bytes]:
    """Token ids of a text as little-endian unsigned 32-bit numbers.

    The vocabulary file is that of a byte-level BPE whose ids are the ranks of its
    merges; its added tokens are taken out of a text first, the longest where two begin, and have their own ids.
    """
    import json
    import re
    from pathlib import Path

    import numpy as np
    import tiktoken

    # Byte-level vocabularies write bytes as characters: printable ones as they are, the others from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    model = json.loads(Path(vocabulary).read_text("utf-8"))
    special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    if any(t.get(k) for t in model.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError("added tokens that take blanks or whole words with them are not supported")
    ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in model["model"]["vocab"].items() if t not in special}
    coder = tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    uneven = re.compile(r"\s\s").search

    def fresh(text: str) -> bytes:
        return np.array(coder.encode_ordinary(text), "<u4").tobytes()

    class Chunks(dict):
        def __missing__(self, chunk: str) -> bytes:
            ids = fresh(chunk)
            if len(chunk) <= LONGEST_WORD:
                if len(self) >= WORDS_HELD:
                    self.clear()
                self[chunk] = ids
            return ids

    known = Chunks()
    feed = fresh("\n")

    def line(text: str) -> bytes:
        head, *tail = text.split(" ")
        return known[head] + b"".join([known[c] for c in [" " + c for c in tail]])

    def plain_text(text: str) -> bytes:
        return fresh(text) if uneven(text) else feed.join(map(line, text.split("\n")))

    if not special:
        return plain_text
    added = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
    ids_of = {t: i.to_bytes(4, "little") for t, i in special.items()}

    def encode(text: str) -> bytes:
        parts = added.split(text)
        if len(parts) == 1:
            return plain_text(text)
        return b"".join(ids_of[part] if k % 2 else plain_text(part) if part else b"" for k, part in enumerate(parts))

    return encode


def _best_fit(capacity: int) -> Callable:
    """Best-fit decreasing of one partition; ``open`` marks pieces that may be packed better elsewhere."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import bisect

        pdf = pdf.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], ignore_index=True)
        by_room: dict[int, list[int]] = {}
        rooms: list[int] = []  # distinct free lengths, ascending
        free: list[int] = []
        seq, offset = [], []
        for length in pdf.length:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                mine = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
            else:
                mine, room = len(free), capacity
                free.append(capacity)
            seq.append(mine)
            offset.append(capacity - room)
            room -= length
            free[mine] = room
            if room:
                if room not in by_room:
                    by_room[room] = []
                    bisect.insort(rooms, room)
                by_room[room].append(mine)
        certified = len(free) <= lower_bound(pdf.length.value_counts().to_dict(), capacity)
        slack = sum(free) // max(1, len(free))
        loose = [not certified and f > max(slack, capacity // 64) for f in free]
        pdf["seq"], pdf["offset"] = seq, offset
        pdf["open"] = [loose[s] for s in seq]
        return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "part", "seq", "offset", "open"]]

    return run
