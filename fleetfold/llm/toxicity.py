"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.words import small_batches

#: At most about so many labelled rows are learned from, those with the smallest hashes of their ids.
MAX_ROWS = 20_000
BITS = 20
SHARDS = 5
EPOCHS = 4
#: Coordinates of a block of the state, which is averaged on the executors.
BLOCK = 1 << 14
MOVED = "block int, shard int, z binary, n binary"
AVERAGED = "block int, z binary, n binary"


@dataclass(frozen=True)
class Rates:
    """FTRL-proximal: learning rates alpha and beta, penalties l1 and l2."""
    alpha: float = 1.5
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.1


@dataclass(frozen=True)
class Model:
    """The coordinates that the L1 penalty left, with their weights, the bias, and the slope of the summed weights."""
    index: list[int] = field(default_factory=list)
    weight: list[float] = field(default_factory=list)
    bias: float = -2.0
    slope: float = 1.0


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS,
          epochs: int = EPOCHS, rates: Rates = Rates()) -> Model:
    """Learns ``label`` (0 or 1) of ``labels`` from the texts of ``docs`` with the same ``doc_id``.

    The sample is bounded by ``max_rows``. It is read once and dealt to a fixed number of
    shards by hash; each epoch every shard streams over its rows from the common state, which is broadcast (2**20 coordinates), and
    returns by how much it moved every coordinate in 32-bit floats. The moves are averaged on the executors, a block of coordinates
    at a time, over all shards; one that did not move a coordinate counts with the common state. The L1 penalty applies
    only where a weight is read, so evidence below it adds up. At the end a slope and the bias are fitted to the sample's
    labels, since averaging shrinks the margins. The outcome does not depend on partitions.

    Rows with a null id, label or text teach nothing; rows that repeat an id with
    different labels are left out, repeated texts of an id count once each. Without any labelled row
    the model has no weights and calls nothing toxic.
    """
    import numpy as np

    agreed = (labels.where(f"doc_id is not null and {label} is not null").groupBy("doc_id")
              .agg(F.min(label).alias("y"), F.max(label).alias("y1")).where("y = y1").select("doc_id", "y"))
    chosen = agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).withColumn("place", _place("doc_id"))
    if chosen.isEmpty():
        return Model()
    sample = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    shard = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(SHARDS)).cast("int").alias("shard")
    sample = sample.select(shard, "place", F.col("doc_id").cast("string").alias("doc_id"),
                           F.col("text").cast("binary").alias("text"), F.col("y").cast("int").alias("y"))
    dealt = sample.repartition(SHARDS, "shard").sortWithinPartitions("shard", "place", "doc_id", "text").persist()
    context = docs.sparkSession.sparkContext
    try:
        z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)  # the last place is the bias
        for _ in range(epochs):
            state = context.broadcast((z, n))
            moved = dealt.mapInArrow(_epoch(state, rates), MOVED).groupBy("block").applyInArrow(_average, AVERAGED)
            for r in moved.toLocalIterator():
                at = slice(r.block * BLOCK, (r.block + 1) * BLOCK)
                z[at] += np.frombuffer(r.z)
                n[at] += np.frombuffer(r.n)
            state.destroy()
        kept = np.flatnonzero(np.abs(z[:-1]) > rates.l1).tolist()
        bias = _weight(float(z[-1]), float(n[-1]), Rates(rates.alpha, rates.beta, 0.0, rates.l2)) if n[-1] else Model().bias
        model = Model(kept, [_weight(float(z[i]), float(n[i]), rates) for i in kept], bias)
        margins = dealt.select("y", F.pandas_udf(_scorer(model, as_margin=True), "double")("text").alias("m"))
        return _calibrated(model, margins.groupBy("y", "m").count().collect())
    finally:
        dealt.unpersist()


def _place(doc_id: str) -> Column:
    """The hash of an id as text that orders a shard's rows, as a signed number of the same order."""
    def run(ids: pd.Series) -> pd.Series:
        import numpy as np
        import xxhash

        return pd.Series(np.array([xxhash.xxh64_intdigest(i) - 2**63 for i in ids], np.int64))

    return F.pandas_udf(run, "long")(F.col(doc_id).cast("string"))


def _calibrated(model: Model, rows: list) -> Model:
    """The model with the slope and bias that fit its margins to the labels of the sample best.

    Averaging over shards and the penalty shrink margins, which keeps their order but not their size. Two numbers
    are fitted by Newton's method to the log loss, with targets a little inside 0 and 1 so that separable samples have a finite fit.
    """
    import numpy as np

    y, m, c = (np.array([r[k] for r in rows], float) for k in range(3))
    toxic, clean = c[y == 1].sum(), c[y == 0].sum()
    if not toxic or not clean or not model.index:
        return model
    m -= model.bias
    target = np.where(y == 1, (toxic + 1) / (toxic + 2), 1 / (clean + 2))
    x = np.stack([m, np.ones_like(m)], 1)

    def loss(w):
        t = x @ w
        return (c * (np.logaddexp(0, t) - target * t)).sum()

    w = np.array([1.0, model.bias])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (c * p * (1 - p))) @ x + 1e-9 * np.eye(2), x.T @ (c * (p - target)))
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return Model(model.index, model.weight, float(w[1]), float(w[0])) if w[0] > 0 else model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out``: the probability of the label; a null text scores as an empty one.

    The weights travel with the tasks: the L1 penalty and the bounded sample bound their number.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn(out, _score(model, text))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that a model learned from ``labels`` scores below ``threshold``, all columns as they are."""
    small_batches(docs.sparkSession)
    return docs.where(_score(train(docs, labels), "text") < threshold)


def _score(model: Model, text: str) -> Column:
    return F.pandas_udf(_scorer(model), "double")(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def _weight(z: float, n: float, rates: Rates) -> float:
    if abs(z) <= rates.l1:
        return 0.0
    sign = 1.0 if z > 0 else -1.0
    return -(z - sign * rates.l1) / ((rates.beta + n ** 0.5) / rates.alpha + rates.l2)


def _features(bits: int = BITS) -> Callable[[bytes], object]:
    """Makes the function from a text's bytes to the hashed places of its words, pairs and one-word-apart pairs."""
    import numpy as np
    import xxhash

    table = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

    class Hashes(dict):
        def __missing__(self, word: bytes) -> int:
            value = xxhash.xxh64_intdigest(word)
            if len(self) < 150_000:
                self[word] = value
            return value

    seen = Hashes()
    odd = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    shift = np.uint64(64 - bits)

    def places(text: bytes):
        words = text.translate(table).split()
        h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        grams = [h * odd[0]]
        for gap in (1, 2):
            if len(h) > gap:
                x = (h[:-gap] ^ (h[gap:] * odd[gap])) * odd[0]
                grams.append((x ^ (x >> np.uint64(29))) * odd[gap])
        return (np.concatenate(grams) >> shift).astype(np.int64)

    return places


def _epoch(state: Broadcast, rates: Rates) -> Callable:
    """One pass of each shard over its rows, which come in order: by how much it moved which coordinates, in blocks."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        z0, n0 = state.value
        places, free = _features(), Rates(rates.alpha, rates.beta, 0.0, rates.l2)
        z = n = shard = before = None
        zb = nb = 0.0

        def moved():
            z[-1], n[-1] = zb, nb
            blocks = [k for k in range(0, len(z), BLOCK) if (z[k:k + BLOCK] != z0[k:k + BLOCK]).any() or (n[k:k + BLOCK] != n0[k:k + BLOCK]).any()]
            for k in blocks:
                parts = [(a[k:k + BLOCK] - b[k:k + BLOCK]).astype(np.float32).tobytes() for a, b in ((z, z0), (n, n0))]
                yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int32()), pa.array([shard], pa.int32()),
                                                  pa.array(parts[:1], pa.binary()), pa.array(parts[1:], pa.binary())],
                                                 names=["block", "shard", "z", "n"])

        for batch in batches:
            for of, doc, text, y in zip(*(batch.column(c) for c in ("shard", "doc_id", "text", "y"))):
                of, row = of.as_py(), (doc.as_py(), text.as_py())
                if of != shard:
                    if shard is not None:
                        yield from moved()
                    shard, before, z, n = of, None, z0.copy(), n0.copy()
                    zb, nb = float(z[-1]), float(n[-1])
                if row == before:
                    continue
                before = row
                i = np.unique(places(row[1]))
                zi, ni = z[i], n[i]
                w = np.where(np.abs(zi) <= rates.l1, 0.0,
                             -(zi - np.sign(zi) * rates.l1) / ((rates.beta + np.sqrt(ni)) / rates.alpha + rates.l2))
                wb = _weight(zb, nb, free)
                p = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -30, 30)))
                g = p - float(y.as_py())
                z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / rates.alpha * w
                n[i] = ni + g * g
                zb += g - ((nb + g * g) ** 0.5 - nb ** 0.5) / rates.alpha * wb
                nb += g * g
        if shard is not None:
            yield from moved()

    return run


def _average(moves):
    """A block's moves added up in the order of the shards and divided by the number of all shards."""
    import numpy as np
    import pyarrow as pa

    order = np.argsort(moves.column("shard").to_numpy())
    total = {}
    for c in ("z", "n"):
        parts = moves.column(c).to_pylist()
        total[c] = sum(np.frombuffer(parts[k], np.float32).astype(float) for k in order) / SHARDS
    return pa.table({"block": pa.array([moves.column("block")[0].as_py()], pa.int32()),
                     **{c: pa.array([v.tobytes()], pa.binary()) for c, v in total.items()}})


def _scorer(model: Model, as_margin: bool = False) -> Callable:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        places = _features()
        weights = np.zeros(1 << BITS)
        weights[model.index] = model.weight

        def margin(text: bytes) -> float:
            i = places(text)
            return model.slope * weights[np.unique(i[weights[i] != 0])].sum() + model.bias

        for texts in batches:
            out = np.array([margin(t) for t in texts], float)
            yield pd.Series(out if as_margin else 1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return run
