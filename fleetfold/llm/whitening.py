"""Whitening of embeddings onto their leading components, found by FEAST contour integration.

Spark does the work that grows with rows: distinct vectors, sums, the centred products and the projection.
What reaches the driver is one square matrix of the vectors' dimension.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.words import cut_lineage

COMPONENTS = 4
SCALE = 256
#: Quadrature nodes on the upper half of the contour.
NODES = 16
ROUNDS = 30
SEED = 12
#: Eigenvalues up to this share of the trace count as zero.
NOTHING = 1e-12


@dataclass(frozen=True)
class Fit:
    """What the distinct vectors say: their number, sums, whole means, covariance, and its leading eigenpairs."""
    n: int
    sums: list[int]
    middle: list[int]
    trace: float
    values: list[float]
    vectors: list[list[float]]

    def rest(self) -> list[float]:
        """Mean less its whole part."""
        return [(s - self.n * m) / self.n for s, m in zip(self.sums, self.middle)]


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Rows ``vec_id, component, n, deviation, whitened, explained, identity_error`` per row and leading component.

    Entries become whole numbers, ``floor(scale * c)``. Rows with a null vector or a null or non-finite entry are
    dropped, and so are empty vectors and those not of the most frequent length (of equally frequent ones the
    greatest). The fit counts each distinct vector once: ``n`` of them, with sums S per dimension. Components are unit eigenvectors of
    their covariance, by falling eigenvalue from 1; those of eigenvalue zero are left out, so one distinct vector gives no row.

    ``deviation`` is the sum of ``(n * x - S) ** 2``, exact, null where it needs over 64 bits. ``identity_error`` is the largest
    entry of the whitened fit's covariance less the identity. Entries beyond 64 bits count as the largest 64-bit number.
    Repeated rows and null ids give rows of their own; other columns are ignored; an empty table gives an empty result.
    """
    e = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    rows = vectors.where(sound & (F.size(e) > 0)).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda c: F.floor(c * scale)).alias("x"))
    common = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    if common is None:
        return rows.mapInArrow(_project(Fit(0, [], [], 0.0, [], []), 0.0), WHITENED)
    rows = rows.where(F.size("x") == common.d)
    distinct = cut_lineage(rows.select("x").distinct(), "distinct-vectors")
    fit = fit_components(distinct, common.d, components)
    return rows.mapInArrow(_project(fit, _identity_error(distinct, fit)), WHITENED)


WHITENED = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
            "identity_error double")


def fit_components(distinct: DataFrame, width: int, components: int = COMPONENTS) -> Fit:
    """Sums, covariance and leading eigenpairs of a frame of distinct vectors ``x`` of one length.

    Rows are centred on the whole number next to each mean before they are multiplied; what is left of the
    mean is under a half and taken off the sum of products, which costs no precision.
    """
    import numpy as np

    n = distinct.count()
    added = distinct.mapInArrow(_sums, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    sums = [0] * width
    for r in added:
        sums[r.i] = int(r.s)
    middle = [round(s / n) if abs(s) < 2**52 else (2 * s + n) // (2 * n) for s in sums]
    products = np.zeros(width * width)
    for r in distinct.mapInArrow(_products(middle), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toLocalIterator():
        products[r.i] = r.v
    rest = np.array([(s - n * m) / n for s, m in zip(sums, middle)])
    v = products.reshape(width, width) / n - np.outer(rest, rest)
    v = (v + v.T) / 2
    values, vectors = leading_eigenpairs(v, components)
    return Fit(n, sums, middle, float(np.trace(v)), values.tolist(), vectors.T.tolist())


def leading_eigenpairs(v, wanted: int):
    """The ``wanted`` largest positive eigenvalues of a symmetric matrix, falling, and their unit vectors as columns.

    Counts of eigenvalues above a shift (the inertia of the shifted matrix) choose an interval that holds the
    wanted ones and some more. The resolvent is integrated along a circle through its ends by
    Gauss-Legendre quadrature, one complex solve per node, which filters a random block down to the interval's invariant
    subspace; Rayleigh-Ritz takes the pairs out of it. This repeats until residuals are as small as rounding
    allows. Then the number of pairs found inside must equal the inertia count.
    """
    import numpy as np

    d = len(v)
    size = float(np.abs(v).sum(1).max())
    diagonal, off = tridiagonal(v)

    def above(shift: float) -> int:
        return inertia(diagonal, off, shift)

    wanted = min(wanted, above(max(NOTHING * float(np.trace(v)), 1e-15 * size))) if size else 0
    if not wanted:
        return np.empty(0), np.empty((d, 0))
    inside = min(d, 2 * wanted + 4)
    top = _shift(above, 1, size)[1]
    low, high = _shift(above, inside, size) if inside < d else (-size, -size)
    low = (low + _shift(above, inside + 1, size)[1]) / 2 if inside < d else -1.01 * size
    count = above(low)
    top += 0.1 * (top - low) + 1e-12 * size

    block = min(d, count + max(4, count // 2))
    rng = np.random.default_rng(SEED)
    y = rng.normal(size=(d, block))
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(0.5j * np.pi * (1 + nodes))
    centre, radius, least = (top + low) / 2, (top - low) / 2, np.inf
    best = None
    for _ in range(ROUNDS):
        q = sum(w / 2 * (radius * t * np.linalg.solve((centre + radius * t) * np.eye(d) - v, y)).real
                for w, t in zip(weights, turn))
        u, s, _ = np.linalg.svd(q / np.linalg.norm(q, axis=0), full_matrices=False)
        u = u[:, s > 1e-13 * s[0]]
        values, w = np.linalg.eigh(u.T @ v @ u)
        y = (u @ w)[:, ::-1]
        values = values[::-1]
        y /= np.linalg.norm(y, axis=0)
        residual = np.linalg.norm(v @ y - y * values, axis=0)
        worst = residual[:min(count, len(values))].max()
        if worst < least:
            least, best = worst, (values, y, residual)
        elif least <= 1e-11 * size:
            break
        if y.shape[1] < block:
            y = np.hstack([y, rng.normal(size=(d, block - y.shape[1]))])
    values, y, residual = best
    found = int(((values > low) & (values < top) & (residual <= 1e-9 * size)).sum())
    if found != count:
        raise RuntimeError(f"{found} eigenpairs found where the inertia counts {count}")
    return values[:wanted], y[:, :wanted]


def tridiagonal(v):
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix, by Householder reflections."""
    import numpy as np

    a = np.array(v, float)
    d = len(a)
    for k in range(d - 2):
        x = a[k + 1:, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        norm = np.linalg.norm(x)
        if norm:
            x /= norm
            a[k + 1:, :] -= 2 * np.outer(x, x @ a[k + 1:, :])
            a[:, k + 1:] -= 2 * np.outer(a[:, k + 1:] @ x, x)
    return np.diag(a).copy(), np.diag(a, 1).copy()


def inertia(diagonal, off, shift: float) -> int:
    """How many eigenvalues lie above ``shift``: the positive pivots of the shifted matrix."""
    tiny, pivot, count = 1e-300, 1.0, 0
    for k, x in enumerate(diagonal):
        pivot = x - shift - (off[k - 1] ** 2 / pivot if k else 0.0)
        if pivot == 0.0:
            pivot = -tiny
        count += pivot > 0
    return count


def _shift(above: Callable[[float], int], count: int, size: float) -> tuple[float, float]:
    """Bounds of the eigenvalue numbered ``count``: at the lower one so many lie above, at the upper one fewer."""
    low, high = -1.01 * size, 1.01 * size
    while high - low > 1e-13 * size:
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if above(mid) >= count else (low, mid)
    return low, high


def _matrix(batch):
    """Whole-number vectors of a batch, all of one length, as a matrix."""
    import numpy as np

    column = batch.column(batch.schema.get_field_index("x"))
    return np.asarray(column.flatten()).astype(np.int64).reshape(len(column), -1)


def _sums(batches: Iterator) -> Iterator:
    import pyarrow as pa

    total = None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch)
            most = int(abs(x.astype(float)).max()) * len(x)
            part = [int(s) for s in (x if most < 2**62 else x.astype(object)).sum(0)]
            total = part if total is None else [a + b for a, b in zip(total, part)]
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.decimal128(38, 0))], names=["i", "s"])


def _centred(x, middle):
    """Differences from the whole means as doubles; beyond 64 bits they are taken in whole numbers of any length."""
    import numpy as np

    if abs(x.astype(float)).max() < 2**61 and max(abs(m) for m in middle) < 2**61:
        return (x - np.array(middle, np.int64)).astype(float)
    return (x.astype(object) - np.array(middle, object)).astype(float)


def _products(middle: list[int]) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total = None
        for batch in batches:
            if batch.num_rows:
                c = _centred(_matrix(batch), middle)
                total = c.T @ c if total is None else total + c.T @ c
        if total is not None:
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["i", "v"])

    return run


def _whitener(fit: Fit) -> Callable:
    import numpy as np

    rest = np.array(fit.rest())
    onto = np.array(fit.vectors).T / np.sqrt(fit.values)
    return lambda x: (_centred(x, fit.middle) - rest) @ onto


def _identity_error(distinct: DataFrame, fit: Fit) -> float:
    """Largest entry of the whitened vectors' covariance less the identity, from a pass over all of them."""
    import numpy as np

    k = len(fit.values)
    if not k:
        return 0.0

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        white, total = _whitener(fit), np.zeros((k, k + 1))
        for batch in batches:
            if batch.num_rows:
                w = white(_matrix(batch))
                total += np.hstack([w.sum(0)[:, None], w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["i", "v"])

    sums = np.zeros(k * (k + 1))
    for r in distinct.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        sums[r.i] = r.v
    sums = sums.reshape(k, k + 1) / fit.n
    return float(np.abs(sums[:, 1:] - np.outer(sums[:, 0], sums[:, 0]) - np.eye(k)).max())


def _project(fit: Fit, identity_error: float) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        k = len(fit.values)
        if not k:
            return
        white, sums, explained = _whitener(fit), np.array(fit.sums, object), [v / fit.trace for v in fit.values]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            most = max(np.abs(x.astype(float)).max() * fit.n, max(abs(float(s)) for s in fit.sums))
            if most < 2**61 and float(np.abs(off := x * fit.n - np.array(fit.sums, np.int64)).max()) ** 2 * x.shape[1] < 2**62:
                deviation = (off ** 2).sum(1).tolist()
            else:
                deviation = [s if s < 2**63 else None for s in ((x.astype(object) * fit.n - sums) ** 2).sum(1)]
            m = len(x)
            ids = batch.column(batch.schema.get_field_index("vec_id"))
            every = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                ids.take(every), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, fit.n)),
                pa.array(deviation, pa.int64()).take(every), pa.array(white(x).ravel()), pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run
