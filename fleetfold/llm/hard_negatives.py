"""Hard negatives of anchor rows, searched along spanning trees of anchors.

Where an anchor's scores are known to lie between two bounds, those of a neighbouring anchor lie at most the
distance between both anchors times the candidate's norm further out. So bounds pass down a
spanning tree from a root whose scores are computed, and at every anchor only those candidates are scored
whose bounds reach into a window that matters there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetfold.llm.words import cut_lineage

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: Per cent of the positive's score that a negative's reaches at the least and at the most.
WINDOW = (80, 100)
ANCHOR = "vec_id % 100 = 0"
#: Anchors of a tree, and candidates that a task takes for one tree and looks at at a time.
TREE = 2_048
SHARD = 16_384
STEP = 2_048
#: Below this bound on scores doubles are exact, and trees are used.
EXACT = 2.0**52
NEAR = "anchor_id long, positive_id long, positive_score long"
FOUND = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def mine(vectors: DataFrame, anchor: str = ANCHOR, positives: int = POSITIVES, negatives: int = NEGATIVES,
         window: tuple[int, int] = WINDOW, scale: int = SCALE) -> DataFrame:
    """Rows ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id``, ``label`` (whole numbers) and ``embedding``. Entries become whole numbers, ``floor(scale * c)``,
    and a score is their inner product; higher ones come first, ties by smaller ``vec_id``. Rows that meet ``anchor`` are
    anchors. An anchor's positives are its first other rows of the same label; to each belong its first
    rows of other labels whose score is within ``window`` per cent of the positive's, ends included.

    Rows with a null id, label or vector, or a null or non-finite entry take no part. Of rows that repeat a ``vec_id`` the
    one with the smallest label, then vector counts. Vectors of different lengths have no score. Other columns are
    ignored; an empty table gives an empty result. Scores that could exceed 64 bits raise an error.

    Anchors and candidates are dealt by hash, whatever their labels, into blocks of bounded size, and each pair
    of blocks is a task; no task or table holds all anchors or all candidates.
    """
    e = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    sound = sound & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    rows = vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                                       F.transform(e, lambda c: F.floor(c * scale)).alias("x"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.*")
    rows = cut_lineage(rows.withColumn("anchor", F.coalesce(F.expr(anchor), F.lit(False))), "vectors")
    squares = F.aggregate("x", F.lit(0.0), lambda t, c: t + c.cast("double") * c.cast("double"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("anchors"), F.max(squares).alias("most")).first()
    if (size.most or 0) > 2.0**62:
        raise ValueError("scores of such large entries need more than 64 bits")
    deal = _Deal(trees=-(-size.anchors // TREE) or 1, shards=-(-size.n // SHARD) or 1)
    by_trees = (size.most or 0) < EXACT

    found = deal.paired(rows.where("anchor").select("vec_id", "label", "x"), rows, _positives(positives, by_trees), NEAR)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("p", F.row_number().over(best)).where(F.col("p") <= positives)
    wanted = found.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("p"))
    wanted = wanted.select(F.col("anchor_id").alias("vec_id"), F.col("p.positive_id").alias("ids"), F.col("p.positive_score").alias("scores"))
    anchors = cut_lineage(rows.where("anchor").select("vec_id", "label", "x").join(wanted, "vec_id"), "anchors")

    found = deal.paired(anchors, rows, _negatives(negatives, window, by_trees), FOUND)
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


class _Deal:
    """Blocks of anchors and shards of candidates, each block to meet each shard once."""

    def __init__(self, trees: int, shards: int) -> None:
        self.trees, self.shards = trees, shards

    def paired(self, anchors: DataFrame, rows: DataFrame, meet: Callable, schema: str) -> DataFrame:
        tree = F.pmod(F.xxhash64("vec_id"), F.lit(self.trees)).cast("int")
        shard = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(self.shards)).cast("int")
        left = anchors.withColumn("tree", tree).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(self.shards - 1))))
        right = rows.select("vec_id", "label", "x", shard.alias("shard")).withColumn(
            "tree", F.explode(F.sequence(F.lit(0), F.lit(self.trees - 1))))
        return left.groupBy("tree", "shard").cogroup(right.groupBy("tree", "shard")).applyInArrow(meet, schema)


def spanning_tree(points) -> list:
    """A minimum spanning tree as levels from a root: (points, places of their parents in the level before, edge lengths)."""
    import numpy as np

    n = len(points)
    squares = np.einsum("ij,ij->i", points, points)
    parent, far = np.full(n, -1), np.full(n, np.inf)
    depth, left = np.zeros(n, int), np.ones(n, bool)
    new = int(squares.argmin())
    far[new] = 0.0
    for _ in range(n):
        left[new] = False
        d = squares + squares[new] - 2 * (points @ points[new])
        nearer = left & (d < far)
        far[nearer], parent[nearer] = d[nearer], new
        if left.any():
            new = int(np.where(left, far, np.inf).argmin())
            depth[new] = depth[parent[new]] + 1
    place, levels = np.zeros(n, int), []
    for k in range(depth.max() + 1):
        at = np.flatnonzero(depth == k)
        place[at] = np.arange(len(at))
        up = place[parent[at]] if k else np.zeros(len(at), int)
        levels.append((at, up, np.sqrt(np.maximum(far[at], 0.0)) * (1 + 1e-9) + 1e-6))
    return levels


def bounded_scores(levels: list, anchors, candidates, wanted: Callable):
    """Goes down a tree; gives for each level its anchors, which candidates were wanted, and their scores.

    ``wanted`` gets a level's anchors with lower and upper bounds of their scores and says which pairs matter.
    Without a tree (``levels`` of one) all scores are computed.
    """
    import numpy as np

    reach = np.sqrt(np.einsum("ij,ij->i", candidates.astype(float), candidates.astype(float)))
    length = np.sqrt(np.einsum("ij,ij->i", anchors.astype(float), anchors.astype(float)))
    low = high = None
    for k, (at, up, far) in enumerate(levels):
        if k == 0:
            low = high = anchors[at] @ candidates.T
            yield at, wanted(at, low, high), low
            continue
        slack = far[:, None] * reach
        most = length[at][:, None] * reach * (1 + 1e-9) + 1e-6
        low, high = np.maximum(low[up] - slack, -most), np.minimum(high[up] + slack, most)
        pairs = wanted(at, low, high)
        some, others = np.flatnonzero(pairs.any(1)), np.flatnonzero(pairs.any(0))
        if len(some):
            low[np.ix_(some, others)] = high[np.ix_(some, others)] = anchors[at[some]] @ candidates[others].T
        yield at, pairs, low


def _levels(points, by_trees: bool) -> list:
    import numpy as np

    return spanning_tree(points) if by_trees else [(np.arange(len(points)), None, None)]


def _parts(table, width: int, by_trees: bool):
    """Ids, labels and vectors of the rows of one vector length, and which rows these are."""
    import numpy as np
    import pyarrow.compute as pc

    at = np.flatnonzero(pc.list_value_length(table.column("x")).to_numpy() == width)
    part = table.take(at)
    x = np.concatenate([np.asarray(c.flatten()) for c in part.column("x").chunks] or [np.empty(0, np.int64)])
    x = x.astype(np.float64 if by_trees else np.int64).reshape(len(at), width)
    return part, part.column("vec_id").to_numpy(), part.column("label").to_numpy(), x


def _first(scores, ids, most: int):
    """Places of the first ``most`` by falling score, then id."""
    import numpy as np

    if len(scores) > most:
        least = np.partition(scores, len(scores) - most)[len(scores) - most]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:most]]
    return np.lexsort((ids, -scores))


def _widths(table) -> list[int]:
    import pyarrow.compute as pc

    return sorted(w for w in pc.unique(pc.list_value_length(table.column("x"))).to_pylist())


def _table(schema: str, columns: list):
    import numpy as np
    import pyarrow as pa

    names = [c.split()[0] for c in schema.split(", ")]
    whole = zip(*columns) if columns else ([] for _ in names)
    return pa.table({n: pa.array(np.concatenate([np.asarray(v, np.int64) for v in c]) if columns else np.empty(0, np.int64))
                     for n, c in zip(names, whole)})


def _positives(most: int, by_trees: bool) -> Callable:
    """Per anchor the first rows of its label, from trees of the anchors of one label."""
    def meet(anchors, rows):
        import numpy as np

        out = []
        for width in _widths(anchors):
            _, a_ids, a_labels, a = _parts(anchors, width, by_trees)
            _, r_ids, r_labels, r = _parts(rows, width, by_trees)
            for label in np.unique(a_labels):
                own, mine = a[a_labels == label], a_ids[a_labels == label]
                levels = _levels(own, by_trees)
                best = [(np.empty(0, own.dtype), np.empty(0, np.int64))] * len(own)
                least = np.full(len(own), -np.inf)
                of_label = np.flatnonzero(r_labels == label)
                for start in range(0, len(of_label), STEP):
                    step = of_label[start:start + STEP]
                    ids, x = r_ids[step], r[step]

                    def wanted(at, low, high):
                        other = mine[at][:, None] != ids
                        floor = least[at]
                        if len(ids) > most and by_trees:
                            lower = np.where(other, low, -np.inf)
                            floor = np.maximum(floor, np.partition(lower, len(ids) - most, axis=1)[:, len(ids) - most])
                        return other & (high >= floor[:, None])

                    for at, pairs, scores in bounded_scores(levels, own, x, wanted):
                        for i, k in enumerate(at):
                            new = np.flatnonzero(pairs[i])
                            s = np.concatenate([best[k][0], scores[i, new]])
                            names = np.concatenate([best[k][1], ids[new]])
                            chosen = _first(s, names, most)
                            best[k] = s[chosen], names[chosen]
                            if len(chosen) == most:
                                least[k] = s[chosen[-1]]
                for k, (s, names) in enumerate(best):
                    out.append((np.full(len(s), mine[k]), names, s.astype(np.int64)))
        return _table(NEAR, out)

    return meet


def _negatives(most: int, window: tuple[int, int], by_trees: bool) -> Callable:
    """Per anchor and positive the first rows of other labels whose score is in the positive's window."""
    def meet(anchors, rows):
        import numpy as np

        out = []
        for width in _widths(anchors):
            part, mine, a_labels, a = _parts(anchors, width, by_trees)
            _, r_ids, r_labels, r = _parts(rows, width, by_trees)
            ids_of, scores_of = part.column("ids").to_pylist(), part.column("scores").to_pylist()
            spans = [[(-(-window[0] * s // 100), window[1] * s // 100) for s in scores] for scores in scores_of]
            bottom = np.array([min([b for b, t in s if b <= t], default=2**62) for s in spans], a.dtype)
            top = np.array([max([t for b, t in s if b <= t], default=-2**62) for s in spans], a.dtype)
            best = [[(np.empty(0, a.dtype), np.empty(0, np.int64)) for _ in s] for s in spans]
            levels = _levels(a, by_trees)
            for start in range(0, len(r), STEP):
                ids, labels, x = r_ids[start:start + STEP], r_labels[start:start + STEP], r[start:start + STEP]

                def wanted(at, low, high):
                    return (a_labels[at][:, None] != labels) & (high >= bottom[at][:, None]) & (low <= top[at][:, None])

                for at, pairs, scores in bounded_scores(levels, a, x, wanted):
                    pairs = pairs & (scores >= bottom[at][:, None]) & (scores <= top[at][:, None])
                    for i, k in enumerate(at):
                        new = np.flatnonzero(pairs[i])
                        if not len(new):
                            continue
                        s, names = scores[i, new], ids[new]
                        for p, (b, t) in enumerate(spans[k]):
                            inside = (s >= b) & (s <= t)
                            held = best[k][p]
                            if len(held[0]) == most:
                                inside &= s >= held[0][-1]
                            if inside.any():
                                both = np.concatenate([held[0], s[inside]]), np.concatenate([held[1], names[inside]])
                                chosen = _first(*both, most)
                                best[k][p] = both[0][chosen], both[1][chosen]
                        full = all(len(h[0]) == most for h, (b, t) in zip(best[k], spans[k]) if b <= t)
                        if full:
                            bottom[k] = min(h[0][-1] for h, (b, t) in zip(best[k], spans[k]) if b <= t)
            for k, of in enumerate(best):
                for p, (s, names) in enumerate(of):
                    if len(s):
                        out.append((np.full(len(s), mine[k]), np.full(len(s), ids_of[k][p]), np.full(len(s), scores_of[k][p]),
                                    names, s.astype(np.int64)))
        return _table(FOUND, out)

    return meet
