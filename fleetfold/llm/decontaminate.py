"""Finds benchmark passages in documents by spaced seeds, tolerant of substituted words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.words import ascii_words, broadcast_below, cut_lineage, fresh_name

#: A seed takes the words at the ones of a mask and ignores those at the noughts; the noughts at the end are not part of its span.
#: However the words are substituted in an item of 8 to 20 words of which 75 % are equal, one of these seeds is left.
MASKS = ("11110000", "11011000", "11000110")
SEEDS = tuple(m.rstrip("0") for m in MASKS)
SPAN = 8
#: Items of so many words up to SPAN - 1 are found whole only: one seed of all their words.
LEAST = 3
WINDOW = 20
PERCENT = 75
#: Up to so many distinct leading word pairs are tested before seeds are made; it changes the cost only.
LEADING_PAIRS = 50_000
BROADCAST_ROWS = 1_000_000


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """One row per text and benchmark item found in it.

    Columns: ``k1``, ``k2`` (hashes of ``doc_id`` and text), ``doc_id``, ``item_id``,
    ``start`` (word of the document where the item would begin, may be negative),
    ``matched`` (equal words in the best window) and ``of`` (its width). Words are
    runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased.

    Both sides are hashed at every word under each mask; equal hashes give the
    relative position of an item in a document, and there all words of the item are
    compared. At 75 % of up to 20 words no substitution leaves a place without a seed
    (a lower ``percent`` may). An item counts as found where at least ``percent`` of the words in a
    window of ``window`` words (the whole item, if shorter) are equal; of several
    places the one with the most equal words is returned, then the first.

    Items of three to seven words are found where all their words are equal. Those of one or two words say
    too little and are not searched; null and empty texts match nothing. Repeated rows give repeated results once per distinct
    (``doc_id``, text) and ``item_id``. A null ``doc_id`` or ``item_id`` is carried
    along as null; other columns are ignored; empty tables give an empty result.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _hashed(F.col("text")).alias("iw"))
    items = cut_lineage(items.where(F.size("iw") >= LEAST).distinct(), "items")
    short = sorted(r[0] for r in items.where(F.size("iw") < SPAN).select(F.size("iw")).distinct().collect())
    masks = [(m, mask, None) for m, mask in enumerate(SEEDS)] + [(n, "1" * n, n) for n in short]
    seeds = items.select("item_id", "iw", F.posexplode(_seeds(F.col("iw"), _positions(F.col("iw")), masks, of_items=True)).alias("i", "s"))
    seeds = cut_lineage(seeds.select("item_id", F.col("s.pos").alias("ipos"), F.col("s.h").alias("h")).where("h is not null").distinct(), "seeds")

    texts = docs.select(*_keys(docs), _hashed(F.col("text")).alias("hw"))
    here = _positions(F.col("hw"))
    pairs = items.select(F.explode(F.transform(_positions(F.col("iw")), lambda i: _pair(F.col("iw"), i))).alias("p")).distinct()
    leading = [r[0] for r in pairs.take(LEADING_PAIRS + 1)]
    if len(leading) <= LEADING_PAIRS:
        here = F.filter(here, lambda i: _pair(F.col("hw"), i).isin(leading) if leading else F.lit(False))
    hits = texts.select("k1", "k2", F.explode_outer(_seeds(F.col("hw"), here, masks)).alias("s"))
    hits = hits.select("k1", "k2", F.col("s.pos").alias("pos"), F.col("s.h").alias("h")).where("h is not null")
    places = (hits.join(broadcast_below(seeds, BROADCAST_ROWS), "h")
              .select("k1", "k2", "item_id", (F.col("pos") - F.col("ipos")).alias("start")).distinct())
    places = cut_lineage(places, "places")

    found = (docs.select("doc_id", "text", *_keys(docs)).join(broadcast_below(places, BROADCAST_ROWS), ["k1", "k2"])
             .select("k1", "k2", F.col("doc_id").cast("long").alias("doc_id"), "item_id", "start", _hashed(F.col("text")).alias("hw")))
    item = broadcast_below(items.withColumnRenamed("item_id", "id"), BROADCAST_ROWS)
    same = F.transform(F.col("iw"), lambda w, j: F.coalesce((F.get("hw", F.col("start") + j) == w).cast("int"), F.lit(0)))
    found = found.join(item, F.col("item_id").eqNullSafe(F.col("id"))).select(
        "k1", "k2", "doc_id", "item_id", "start", same.alias("same"))
    width = F.least(F.size("same"), F.lit(window))
    best = F.array_max(F.transform(
        F.sequence(F.lit(1), F.size("same") - width + 1),
        lambda a: F.aggregate(F.slice("same", a, width), F.lit(0), lambda x, y: x + y)))
    scored = found.select("k1", "k2", "doc_id", "item_id", "start", best.alias("matched"), width.alias("of"))
    scored = scored.where(100 * F.col("matched") >= percent * F.col("of"))
    return (scored.groupBy("k1", "k2", "doc_id", "item_id")
            .agg(F.max(F.struct("matched", (-F.col("start")).alias("before"), "of")).alias("m"))
            .select("k1", "k2", "doc_id", "item_id", (-F.col("m.before")).alias("start"),
                    F.col("m.matched").cast("long").alias("matched"), F.col("m.of").cast("long").alias("of")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """The documents in which no benchmark item is found, all columns as they are."""
    found = cut_lineage(benchmark_overlaps(docs, benchmark, **options).select("k1", "k2").distinct(), "contaminated")
    a, b = fresh_name(docs, "k1"), fresh_name(docs, "k2")
    k1, k2 = (F.xxhash64(*c) for c in _key_columns())
    keyed = docs.withColumns({a: k1, b: k2})
    return keyed.join(broadcast_below(found.toDF(a, b), BROADCAST_ROWS), [a, b], "left_anti").select(*docs.columns)


def _key_columns() -> tuple[list[Column], list[Column]]:
    return [F.col("doc_id"), F.col("text")], [F.lit(1), F.col("doc_id"), F.col("text")]


def _keys(docs: DataFrame) -> list[Column]:
    """A row by the hash of its id and text, so that rows with a repeated or null id stay apart."""
    return [F.xxhash64(*c).alias(n) for c, n in zip(_key_columns(), ("k1", "k2"))]


def _hashed(text: Column) -> Column:
    return F.transform(ascii_words(text), lambda w: F.xxhash64(w))


def _positions(words: Column) -> Column:
    last = F.size(words) - LEAST
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _pair(words: Column, i: Column) -> Column:
    return F.xxhash64(F.get(words, i), F.get(words, i + 1))


def _seeds(words: Column, positions: Column, masks: list, of_items: bool = False) -> Column:
    """Position and hash of the seed of each mask at each position; null where the mask runs over the end.

    A mask is (number, mask, words): with a number of words it is one of all words of items of that length, and items have
    only it or, if long, only the others.
    """
    def at(i: Column) -> Column:
        made = []
        for m, mask, whole in masks:
            fits = i + len(mask) <= F.size(words)
            if of_items:
                fits = fits & (F.size(words) >= SPAN if whole is None else F.size(words) == whole)
            h = F.xxhash64(F.lit(m), *[F.get(words, i + j) for j, one in enumerate(mask) if one == "1"])
            made.append(F.struct(i.alias("pos"), F.when(fits, h).alias("h")))
        return F.array(*made)

    return F.flatten(F.transform(positions, at))
