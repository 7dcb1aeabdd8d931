"""Pages as WARC archives: range-sorted, rolled by compressed size, committed by a manifest, read back and verified."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfold.llm.words import broadcast_below, cut_lineage, partitions, small_batches

RANGE_BYTES = 256 * 1024 * 1024
ROLL_BYTES = 64 * 1024 * 1024
MAX_RANGES = 65_536
BROADCAST_ROWS = 1_000_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, range int, roll int, records long, bytes long, sha256 string, first_page long, last_page long"
RECORDS = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
           "payload binary, file string")


def write_archives(pages: DataFrame, path: str, range_bytes: int = RANGE_BYTES, roll_bytes: int = ROLL_BYTES,
                   smallest: int = 0, date: str = DATE) -> DataFrame:
    """Writes a record per row of ``pages`` (``page_id, url, html``) below ``path``; returns the manifest.

    Rows are dealt to ranges of ``page_id`` whose bounds come from a sample chosen by hash,
    sorted, and written to files that end once they reach ``roll_bytes`` compressed. Each record is a gzip member of its own
    with regenerated headers and digests. The same rows and settings give the same
    files byte for byte. A task writes under a temporary name and renames the finished file, so
    a task that runs twice leaves the same file; files count once they are in the
    manifest, which Spark commits as a whole. ``path`` is a folder all executors reach.

    Of records with equal payloads of at least ``smallest`` bytes the one with the smallest
    ``page_id`` is the response and the others are revisits that refer to it; rows that repeat that ``page_id``
    are responses too. A null ``html`` is an empty payload, a null ``url`` leaves its header out,
    a row without ``page_id`` is a response nobody refers to. Other columns are ignored; an empty table gives an empty manifest.
    """
    small_batches(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload"), F.sha1(payload).alias("sha"))
    repeated = rows.where(F.octet_length("payload") >= smallest).groupBy("sha").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("sha", "first")
    repeated = cut_lineage(repeated, "repeated-payloads")
    typed = rows.join(broadcast_below(repeated, BROADCAST_ROWS), "sha", "left").withColumn(
        "refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first")))
    bounds = _bounds(pages, range_bytes)
    spark = pages.sparkSession
    of = F.pandas_udf(_range(bounds), "int")(F.coalesce("page_id", F.lit(-(2**63))))
    ranged = typed.select(of.alias("range"), "page_id", "url", "payload", "refers_to")
    dealt = ranged.repartitionByRange(max(1, min(len(bounds) + 1, max(partitions(spark), len(bounds) + 1))), "range")
    sorted_rows = dealt.sortWithinPartitions("range", "page_id", "url", "payload", "refers_to")
    # As text, ids stay exact beside nulls in pandas.
    sorted_rows = sorted_rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    sorted_rows.mapInPandas(_writer(path, roll_bytes, date), MANIFEST).write.parquet(f"{path}/manifest")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives in the manifest; every digest and length is checked on the way."""
    files = manifest(spark, path)
    return files.repartition(max(1, partitions(spark)), "file").mapInPandas(_reader(path), RECORDS)


def _bounds(pages: DataFrame, range_bytes: int) -> list[int]:
    """Upper ends of all ranges but the last, from ids whose hashes fall in a fixed share: the same for any partitioning."""
    found = pages.agg(F.count("page_id"), F.sum(F.octet_length("html"))).first()
    count, size = found[0], found[1] or 0
    ranges = min(MAX_RANGES, max(-(-size // range_bytes), min(partitions(pages.sparkSession), count // 20)))
    if ranges <= 1:
        return []
    every = max(1, count // (ranges * 32))
    ids = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id")).where(
        F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0).distinct()
    sample = sorted(r[0] for r in ids.collect())  # about 32 per range
    return sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []


def _range(bounds: list[int]) -> Callable:
    def run(ids: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series(np.searchsorted(np.array(bounds, "int64"), ids.to_numpy("int64"), side="left").astype("int32"))

    return run


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A WARC 1.1 record; the block of a revisit is the head of the response only."""
    import base64
    import hashlib
    import uuid

    def digest(data: bytes) -> str:
        return base64.b32encode(hashlib.sha1(data).digest()).decode()

    def urn(page: int | None) -> str:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest(payload)}')}>"

    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}",
             f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(path: str, roll_bytes: int, date: str) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import uuid
        import zlib

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(f"{root}/archives", recursive=True)
        done: list[tuple] = []
        state: dict = {}

        def close() -> None:
            state["out"].close()
            name = f"archives/pages-{state['range']:05d}-{state['roll']:05d}.warc.gz"
            store.move(state["temporary"], f"{root}/{name}")
            done.append((name, state["range"], state["roll"], state["records"], state["bytes"], state["sha"].hexdigest(),
                         state["first"], state["last"]))
            state["out"] = None

        def start(of: int, roll: int) -> None:
            temporary = f"{root}/archives/.{uuid.uuid4().hex}.tmp"
            state.update(range=of, roll=roll, records=0, bytes=0, sha=hashlib.sha256(), first=None, last=None,
                         temporary=temporary, out=store.open_output_stream(temporary))

        for batch in batches:
            for of, page, url, payload, refers in batch.itertuples(index=False):
                page, refers = (None if x is None else int(x) for x in (page, refers))
                if state.get("out") and (state["range"] != of or state["bytes"] >= roll_bytes):
                    close()
                if not state.get("out"):
                    start(of, state["roll"] + 1 if state.get("range") == of else 0)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = pack.compress(record(page, url, bytes(payload), refers, date)) + pack.flush()
                state["out"].write(member)
                state["sha"].update(member)
                state["records"] += 1
                state["bytes"] += len(member)
                if page is not None:
                    state["first"] = page if state["first"] is None else state["first"]
                    state["last"] = page
        if state.get("out"):
            close()
        yield _exact(done, ["file", "range", "roll", "records", "bytes", "sha256", "first_page", "last_page"])

    return run


def _reader(path: str) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, records in zip(batch.file, batch.records):
                rows, held, count = [], 0, 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as raw:
                    for row in _records(raw):
                        rows.append((*row, name))
                        held += len(row[-1])
                        count += 1
                        if held > 16_000_000 or len(rows) >= 5_000:
                            yield _frame(rows)
                            rows, held = [], 0
                if count != records:
                    raise ValueError(f"{name} has {count} records, the manifest {records}")
                if rows:
                    yield _frame(rows)

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return _exact(rows, ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "file"])


def _exact(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """Rows as a frame whose ids may be null and stay whole numbers."""
    columns = dict(zip(names, zip(*rows) if rows else [()] * len(names)))
    ids = {"page_id", "refers_to", "first_page", "last_page"}
    return pd.DataFrame({n: pd.array(list(c), dtype="Int64") if n in ids else pd.Series(list(c), dtype=object) for n, c in columns.items()})


def _records(raw) -> Iterator[tuple]:
    """Parses and verifies the records of one archive."""
    import base64
    import gzip
    import hashlib

    def digest(data: bytes) -> str:
        return base64.b32encode(hashlib.sha1(data).digest()).decode()

    with gzip.GzipFile(fileobj=raw) as lines:
        while version := lines.readline():
            if version != b"WARC/1.1\r\n":
                raise ValueError("a record does not begin with its version")
            head = {}
            while (line := lines.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode("utf-8", "surrogatepass").rstrip("\r\n").partition(": ")
                head[name] = value
            block = lines.read(int(head["Content-Length"]))
            if lines.read(4) != b"\r\n\r\n" or head["WARC-Block-Digest"] != "sha1:" + digest(block):
                raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
            http, _, payload = block.partition(b"\r\n\r\n")
            size = int(http.rpartition(b"Content-Length: ")[2])
            stated = head["WARC-Payload-Digest"].removeprefix("sha1:")
            if head["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != stated):
                raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
            page, refers = (int(head[k]) if k in head else None for k in ("WARC-Page-ID", "WARC-Refers-To-Page-ID"))
            yield page, head.get("WARC-Target-URI"), size, stated, head["WARC-Type"], refers, payload
