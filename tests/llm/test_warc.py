import base64
import glob
import gzip
import hashlib

import pytest

from fleetfold.llm import warc
from fleetfold.llm.words import scratch_path

PAGES = "page_id long, url string, html string, file string"


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def expected(rows, smallest=0):
    first = {}
    for i, _, html, *_ in rows:
        if i is not None:
            data = (html or "").encode()
            first[data] = min(i, first.get(data, i))
    out = []
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        refers = first[data] if i is not None and len(data) >= smallest and first[data] != i else None
        out.append((i, len(data), digest(data), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def read(spark, path):
    rows = warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    return sorted(map(tuple, rows), key=str)


ROWS = [(i, f"http://h/{i}", f"<p>é {i % 40}</p>" * (i % 9 + 1), "x") for i in range(300)]
ODD = [(900, None, None, None), (901, "http://a\r\nWARC-Type: x", "", "x"), (None, "http://n", "", "x"), (5, "http://again", ROWS[5][2], "x"),
       (2**53 + 1, "u", ROWS[0][2], "x"), (2**53 + 3, "u", ROWS[0][2], "x"), (902, "u", "WARC/1.1\r\n\r\n\r\nx" * 3, "x"), (903, "u", "é" * 300_000, "x"), (7, "u", "other", "x")]


def test_round_trip(spark):
    path = scratch_path(spark, "warc")
    listed = warc.write_archives(spark.createDataFrame(ROWS + ODD, PAGES), path, range_bytes=200_000, roll_bytes=600)
    assert read(spark, path) == expected(ROWS + ODD)
    files = listed.collect()
    assert sum(f.records for f in files) == len(ROWS + ODD) and max(f.roll for f in files) > 0
    names = {n.removeprefix(path + "/") for n in glob.glob(f"{path}/archives/*")}
    assert names == {f.file for f in files} and not glob.glob(f"{path}/archives/.*tmp")
    assert all(f.bytes >= 600 or f.roll == max(g.roll for g in files if g.range == f.range) for f in files)
    spans = sorted((f.first_page, f.last_page) for f in files if f.first_page is not None)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    text = gzip.open(f"{path}/{files[0].file}").read()
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_same_rows_give_the_same_files(spark):
    def sums(df):
        path = scratch_path(spark, "warc")
        return {(f.file, f.sha256) for f in warc.write_archives(df, path, range_bytes=100_000, roll_bytes=900).collect()}

    df = spark.createDataFrame(ROWS + ODD, PAGES)
    assert sums(df) == sums(df.repartition(9, "html"))


def test_small_payloads_are_all_responses(spark):
    path = scratch_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(ROWS, PAGES), path, smallest=20)
    assert read(spark, path) == expected(ROWS, 20)


def test_damage_is_noticed(spark):
    path = scratch_path(spark, "warc")
    files = warc.write_archives(spark.createDataFrame(ROWS[:30], PAGES), path).collect()
    name = f"{path}/{files[0].file}"
    data = gzip.open(name).read().replace(b"<p>", b"<q>", 1)
    with gzip.open(name, "wb") as out:
        out.write(data)
    with pytest.raises(Exception, match="damaged"):
        read(spark, path)


def test_empty_table(spark):
    path = scratch_path(spark, "warc")
    assert warc.write_archives(spark.createDataFrame([], PAGES), path).count() == 0
    assert read(spark, path) == []
