"""Embedding near-duplicates by E8 lattice hashing: random projections, neighbouring cells, exact cosine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.components import connected
from fleetfold.llm.fingerprints import colliding, renamed
from fleetfold.llm.words import broadcast_below, cut_lineage

COSINE = 0.9
TABLES = 12
PROBES = 4
SCALE = 1.0
SEED = 8
BLOCK = 256
BROADCAST_ROWS = 1_000_000
CELLS = "cls long, cells array<long>"
#: Rows that a task compares at a time, at the least a cell's block or two.
CHUNK = 8_192


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """One row per row of ``vectors`` (``vec_id``, ``embedding``): ``vec_id, n_links, component_id, kept``.

    A unit vector is projected at random to eight dimensions once per table, and its
    key is the nearest point of the E8 lattice. Two vectors meet when the key of one is the key
    of the other or one of its ``probes`` nearest neighbouring points, in any table; those
    that meet are compared by cosine in double precision and link from ``cosine`` on. At the
    default settings a pair at a cosine of 0.9 meets with a probability of about 0.97, closer ones more often.

    Equal vectors are one class and always link. ``n_links`` counts linked rows other than the row
    itself; ``component_id`` is the smallest ``vec_id`` reachable, ``kept`` whether it is the row's own.
    Full cells are cut into blocks that meet pairwise in separate tasks, and a pair
    counts only in the first cell it meets in, so no list of pairs is made.

    Classes are told apart by 128 bits; those that share the first 64 get other numbers.

    Vectors that are null, empty or zero or hold null or non-finite components link with
    nothing; vectors of different lengths do not link. A repeated ``vec_id`` is one node whose rows count
    one by one; a null one takes no part and has a null component. Other columns are ignored; an empty table gives an empty result.
    """
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    e = F.transform(F.col("embedding").cast(f"array<{kind}>"), lambda x: x + F.lit(0.0).cast(kind))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e"))
    sound = F.coalesce(F.size("e") > 0, F.lit(False)) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(sound, F.lit(False)) & F.exists("e", lambda x: x != 0) & F.col("vec_id").isNotNull()
    first, second = _fingerprint(F.col("e"))
    rows = cut_lineage(rows.select("vec_id", F.when(sound, F.col("e")).alias("e"), first.alias("cls"), second.alias("chk")), "vectors")
    moved = colliding(rows.where("e is not null").select("cls", "chk"))
    if moved:
        rows = cut_lineage(renamed(rows, moved), "vectors")
    classes = rows.where("e is not null").groupBy("cls").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    classes = cut_lineage(classes, "vector-classes")
    first = classes.select("cls", F.col("rep").alias("vec_id"))
    unique = rows.where("e is not null").join(broadcast_below(first, BROADCAST_ROWS), ["cls", "vec_id"]).select("cls", "e")
    unique = cut_lineage(unique.join(broadcast_below(classes.select("cls", "weight"), BROADCAST_ROWS), "cls"), "unique-vectors")
    keyed = cut_lineage(unique.select("cls", "e").mapInArrow(_cells(tables, probes), CELLS), "cells")

    found = _links(unique, keyed, cosine, tables, probes)
    labels = connected(found.select("a", "b")).withColumnRenamed("node", "cls")
    others = found.where("a = b").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))
    whole = classes.join(labels, "cls", "left").join(others, "cls", "left").select(
        "cls", "rep", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("label", "cls").alias("label"))
    whole = cut_lineage(whole, "class-links")
    smallest = whole.groupBy("label").agg(F.min("rep").alias("component_id"))
    by_class = cut_lineage(whole.join(smallest, "label").select("cls", "n_links", "component_id"), "class-components")
    out = rows.select("vec_id", F.when(F.col("e").isNotNull(), F.col("cls")).alias("cls")).join(
        broadcast_below(by_class, BROADCAST_ROWS), "cls", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                     F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _fingerprint(e: Column) -> tuple[Column, Column]:
    """Two 64-bit numbers that stand for a vector."""
    return F.xxhash64(e), F.xxhash64(F.lit(1), e)


def _links(unique: DataFrame, keyed: DataFrame, cosine: float, tables: int, probes: int) -> DataFrame:
    """Rows (a, b) that span the linked pairs, and rows (a, a, n) with numbers of linked rows."""
    entries = keyed.select("cls", F.posexplode("cells").alias("i", "cell"))
    entries = entries.select("cls", "cell", (F.col("i") % (1 + probes) == 0).alias("home"))
    full = entries.groupBy("cell").agg(F.count(F.lit(1)).alias("c"), F.max("home").alias("home")).where("c > 1 and home")
    full = cut_lineage(full.select("cell", F.ceil(F.col("c") / BLOCK).cast("int").alias("k")), "full-cells")
    met = entries.select("cls", "cell").join(broadcast_below(full, BROADCAST_ROWS), "cell")
    s, k = F.pmod(F.xxhash64("cls"), F.col("k")).cast("int"), F.col("k")

    def meets(t: Column) -> Column:
        return F.struct(F.least("s", t).alias("u"), F.greatest("s", t).alias("v"),
                        F.when(F.col("s") == t, 0).when(F.col("s") < t, 1).otherwise(2).alias("side"))

    placed = met.withColumn("s", s).select("cls", "cell", F.explode(F.transform(F.sequence(F.lit(0), k - 1), meets)).alias("p"))
    sent = placed.select("cls", "cell", "p.*").join(unique, "cls").select("cell", "u", "v", "side", "cls", "weight", "e")
    dealt = sent.repartition("cell", "u", "v").sortWithinPartitions("cell", "u", "v", "cls")
    return cut_lineage(dealt.mapInArrow(_blocks(cosine, tables, probes), "a long, b long, n long"), "vector-links")


def nearest_e8(points):
    """The nearest point of E8 to each row: the nearer of the two nearest points of D8 and its shifted copy."""
    import numpy as np

    def even(y):
        whole = np.rint(y)
        off = y - whole
        odd = np.flatnonzero(whole.sum(1).astype(np.int64) % 2)
        at = np.abs(off[odd]).argmax(1)
        whole[odd, at] += np.where(off[odd, at] >= 0, 1, -1)
        return whole

    a, b = even(points), even(points - 0.5) + 0.5
    return np.where((((points - a) ** 2).sum(1) <= ((points - b) ** 2).sum(1))[:, None], a, b)


def e8_roots():
    """The 240 points of E8 next to the origin."""
    from itertools import combinations, product

    import numpy as np

    roots = []
    for i, j in combinations(range(8), 2):
        for signs in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = signs
            roots.append(v)
    roots += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(roots)


def _unit(vectors):
    """Rows as unit vectors in double precision."""
    import numpy as np

    out = np.asarray(vectors, float)
    out = out / np.abs(out).max(1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _lattice_keys(tables: int, probes: int) -> Callable:
    """Makes the function from unit vectors to their cells: per table the nearest lattice point and its neighbours, nearest first."""
    import numpy as np

    roots, known = e8_roots(), {}
    odd = np.random.default_rng(SEED).integers(1, 2**62, 10, dtype=np.int64) * 2 + 1

    def keys(unit):
        width = unit.shape[1]
        if width not in known:
            known[width] = np.random.default_rng([SEED, width]).normal(size=(tables, width, 8)) * SCALE
        found = []
        for t, project in enumerate(known[width]):
            y = unit @ project
            home = nearest_e8(y)
            near = np.argsort(-((y - home) @ roots.T), axis=1, kind="stable")[:, :probes]
            points = np.concatenate([home[:, None], home[:, None] + roots[near]], 1)
            h = (np.rint(points * 2).astype(np.int64) * odd[:8]).sum(2) + (np.array([t, width]) * odd[8:]).sum()
            h ^= h >> 29
            found.append(h * odd[8])
        return np.concatenate(found, 1)

    return keys


def _cells(tables: int, probes: int) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        keys = _lattice_keys(tables, probes)
        for batch in batches:
            vectors = batch.column("e").to_pylist()
            cells = [None] * len(vectors)
            for width in {len(v) for v in vectors}:
                at = [i for i, v in enumerate(vectors) if len(v) == width]
                for i, row in zip(at, keys(_unit(np.array([vectors[i] for i in at])))):
                    cells[i] = row
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(cells, pa.list_(pa.int64()))], names=["cls", "cells"])

    return run


def _blocks(cosine: float, tables: int, probes: int) -> Callable:
    """Links inside blocks and between two, from rows sorted by cell; many small cells are compared at a time."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        compare = _compare(cosine, tables, probes)
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                table = pa.Table.from_batches(held).combine_chunks()
                last = _same_as_last(table)
                if last < rows:
                    yield compare(table.slice(0, rows - last))
                    held, rows = table.slice(rows - last).to_batches(), last
        if rows:
            yield compare(pa.Table.from_batches(held))

    return run


def _same_as_last(table) -> int:
    """Rows at the end that belong to the last cell and blocks."""
    import numpy as np

    same = np.ones(table.num_rows, bool)
    for name in ("cell", "u", "v"):
        column = table.column(name).to_numpy()
        same &= column == column[-1]
    return int(same.sum())


def _compare(cosine: float, tables: int, probes: int) -> Callable:
    import numpy as np
    import pyarrow as pa

    keys = _lattice_keys(tables, probes)

    def pairs(starts, sizes):
        """All pairs of rows of each group, a bounded number at a time."""
        first = np.concatenate([np.arange(s, s + m - 1) for s, m in zip(starts, sizes)] or [np.empty(0, int)])
        ends = np.repeat(starts + sizes, np.maximum(sizes - 1, 0))
        many = ends - first - 1
        done, upto = 0, np.cumsum(many)
        while done < len(first):
            stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + 50_000, side="right")))
            i = np.repeat(first[done:stop], many[done:stop])
            within = np.arange(len(i)) - np.repeat(np.cumsum(many[done:stop]) - many[done:stop], many[done:stop])
            yield i, i + 1 + within
            done = stop

    def compare(table):
        table = table.combine_chunks()
        cell, u, v, side, cls, weight = (table.column(c).to_numpy() for c in ("cell", "u", "v", "side", "cls", "weight"))
        lists = table.column("e").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        ends = np.asarray(lists.offsets)
        flat, width = np.asarray(lists.values), np.diff(ends)
        count, root, links = np.zeros(len(cls), np.int64), {}, []

        def top(p: int) -> int:
            while root.setdefault(p, p) != p:
                root[p] = root[root[p]]
                p = root[p]
            return p

        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            unit = _unit(flat[ends[at][:, None] + np.arange(w)])
            border = np.flatnonzero(np.concatenate([[True], (np.diff(cell[at]) != 0) | (np.diff(u[at]) != 0) | (np.diff(v[at]) != 0)]))
            for i, j in pairs(border, np.diff(np.append(border, len(at)))):
                near = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
                i, j = i[near], j[near]
                x, y = at[i], at[j]
                fits = (cls[x] != cls[y]) & ((side[x] == 0) | (side[x] != side[y]))
                i, j, x, y = i[fits], j[fits], x[fits], y[fits]
                if not len(i):
                    continue
                used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
                of = keys(unit[used]).reshape(len(used), tables, 1 + probes)
                one, two = of[place[:len(i)]], of[place[len(i):]]
                same = one[:, :, :, None] == two[:, :, None, :]
                same[:, :, 1:, 1:] = False  # a neighbour of both is nobody's own cell
                first = np.where(same.any(3), one, np.iinfo(np.int64).max).reshape(len(i), -1).min(1)
                mine = first == cell[x]
                np.add.at(count, x[mine], weight[y[mine]])
                np.add.at(count, y[mine], weight[x[mine]])
                for p, q in zip(x[mine].tolist(), y[mine].tolist()):
                    p, q = top(p), top(q)
                    if p != q:
                        root[p] = q
                        links.append((cls[p], cls[q], 0))
        a, b, n = zip(*links) if links else ((), (), ())
        some = np.flatnonzero(count)
        columns = [np.concatenate([np.array(x, np.int64), y]) for x, y in ((a, cls[some]), (b, cls[some]), (n, count[some]))]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n"])

    return compare
