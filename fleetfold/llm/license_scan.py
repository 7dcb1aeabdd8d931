"""Licence labels from a positional index of rare licence words."""

from __future__ import annotations

import json
import math
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.words import ascii_words


@dataclass(frozen=True)
class Template:
    """A passage of a licence; the key phrase is mandatory and begins ``at`` words into it."""
    label: str
    words: tuple[str, ...]
    key: tuple[str, ...]
    at: int
    base: bool = False


def template(label: str, text: str, key: str | None = None, base: bool = False) -> Template:
    words, phrase = tuple(text.split()), tuple((key or text).split())
    at = next(i for i in range(len(words)) if words[i:i + len(phrase)] == phrase)
    return Template(label, words, phrase, at, base)


# Passages of public licences.
TEMPLATES = (
    template("mit", "under the mit license", base=True),
    template("apache-2", "apache license version 2", base=True),
    template("cc-by-nc", "cc by nc", base=True),
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
             "associated documentation files", "permission is hereby granted free of charge"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
             "provided that the following conditions are met", "redistribution and use in source and binary forms"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
             "hereby granted", "permission to use copy modify"),
    template("gpl-2", "gnu general public license version 2"),
    template("gpl-3", "gnu general public license version 3"),
    template("lgpl-3", "gnu lesser general public license version 3"),
    template("agpl-3", "gnu affero general public license version 3"),
    template("mpl-2", "mozilla public license version 2"),
    template("epl-2", "eclipse public license version 2"),
    template("unlicense", "this is free and unencumbered software released into the public domain",
             "free and unencumbered software"),
    template("cc0-1", "cc0 1 0 universal"),
    template("cc-by-sa", "creative commons attribution sharealike"),
    template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial "
             "portions of the software", "this permission notice shall be included in all copies"),
    template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
             "with the license", "you may not use this file except in compliance with the license"),
    template("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
             "products derived from this software without specific prior written permission",
             "may be used to endorse or promote products derived from this software"),
    template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
             "public license as published by the free software foundation", "under the terms of the gnu general public license"),
    template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
             "general public license as published by the free software foundation",
             "under the terms of the gnu lesser general public license"),
    template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0",
             "mozilla public license v 2 0"),
    template("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license",
             "under the terms of the eclipse public license"),
    template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held "
             "liable for any damages arising from the use of this software", "without any express or implied warranty"),
    template("bsl-1", "boost software license version 1 0"),
    template("ofl-1", "sil open font license version 1 1"),
    template("odbl", "open data commons open database license"),
    template("sspl-1", "server side public license version 1"),
    template("busl-1", "business source license 1 1"),
    template("artistic-2", "artistic license 2 0"),
    template("eupl", "european union public licence"),
    template("cc-by-nc", "creative commons attribution noncommercial"),
    template("cc-by-nd", "creative commons attribution noderivatives"),
)
SIMILARITY = 0.6
BUCKETS = 1024

POSTING = ("word: string, label: string, base: boolean, at: int, words: array<string>, weights: array<double>, checks: array<int>, "
           "whole: double")


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places`` of every row.

    Words are runs of ASCII letters, digits and characters beyond ASCII, with A-Z
    lower-cased. The weight of a template's word is its inverse document frequency over all
    documents. A file's words are looked up in an index of postings: each posting stands under the rarest word of a key
    phrase and says how far into its template that word is. (Since all words of a key phrase must stand in a file that holds it,
    the file's rarest word of the phrase is the phrase's rarest, and the other words need no postings of their own.) A posting gives
    the position at which its template would begin; there the other words of the phrase are intersected by their relative positions
    from the rarest on, and all must stand. The score
    of a place is the weight of the template's words that stand at their positions, of all its weight; a
    place counts from ``similarity`` on, and ``score`` is the best one (0 without any).
    ``n_base`` counts the places of base templates, whose smallest and largest beginnings are
    ``first_word`` and ``last_word`` (null without any). ``places`` lists label, first word
    and score of all places.

    The index is one value in the plan, whatever the number of templates, so that files are neither shuffled nor joined.

    A null text is empty: no words, labels ``""``. Repeated rows and null ids are
    treated like others; other columns are ignored; an empty table gives an empty result.
    """
    weights = word_weights(docs, sorted({w for t in templates for w in t.words}))
    index = _constant(_dealt(postings(templates, weights), lambda p: p["word"]), f"array<array<struct<{POSTING}>>>")
    words = F.col("words")
    texts = docs.select("doc_id", ascii_words(F.col("text")).alias("words"))
    last = F.size(words) - 1
    rare = F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), lambda i: F.size(_bucket(index, F.get(words, i))) > 0))
    located = texts.select("doc_id", "words", F.coalesce(rare, F.array().cast("array<int>")).alias("rare"))
    found = located.select("doc_id", F.size(words).cast("long").alias("n_words"), F.flatten(
        F.transform("rare", lambda i: _places(words, i, index))).alias("found"))
    counted = found.select("doc_id", "n_words", F.filter("found", lambda p: p["score"] >= similarity).alias("places"))
    base = F.filter("places", lambda p: p["base"])
    return counted.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["start"])).cast("long").alias("last_word"),
        _labels(base).alias("base_labels"), _labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"),
        F.transform("places", lambda p: F.struct(p["label"], p["start"], p["score"])).alias("places"))


def word_weights(docs: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """Inverse document frequency of each word of a fixed vocabulary over all documents."""
    known = _constant(_dealt(vocabulary, lambda w: w), "array<array<string>>")
    held = F.array_distinct(F.filter(ascii_words(F.col("text")), lambda w: F.array_contains(_bucket(known, w), w)))
    counts = docs.select(F.explode_outer(held).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("c")).collect()
    of = {r.word: r.c for r in counts}
    total = docs.count()
    return {w: math.log((total + 1) / (of.get(w, 0) + 0.5)) + 1e-6 for w in vocabulary}


def postings(templates: tuple[Template, ...], weights: dict[str, float]) -> list[dict]:
    """One posting per template, under its rarest key word; ``checks`` are the key's other places in the template, rarest first."""
    out = []
    for t in templates:
        first, *others = (t.at + j for j in sorted(range(len(t.key)), key=lambda j: (-weights[t.key[j]], j)))
        of = [weights[w] for w in t.words]
        out.append({"word": t.words[first], "label": t.label, "base": t.base, "at": first, "words": t.words, "weights": of,
                    "checks": others, "whole": math.fsum(of)})
    return out


def _places(words: Column, i: Column, index: Column) -> Column:
    """The places of all templates whose rarest key word is the word at ``i``."""
    def stands(p: Column) -> Column:
        whole = F.forall(p["checks"], lambda j: F.coalesce(F.get(words, i - p["at"] + j) == F.get(p["words"], j), F.lit(False)))
        return (p["word"] == F.get(words, i)) & (i >= p["at"]) & whole

    def place(p: Column) -> Column:
        start = i - p["at"]
        # Words that stand at their positions; slices of a text that ends within the template are shorter.
        held = F.zip_with(F.zip_with(F.slice(words, start + 1, F.size(p["words"])), p["words"], lambda a, b: a.eqNullSafe(b)),
                          p["weights"], lambda same, weight: F.when(same, weight).otherwise(F.lit(0.0)))
        share = F.aggregate(held, F.lit(0.0), lambda a, b: a + b) / p["whole"]
        score = F.when(F.size(p["checks"]) + 1 == F.size(p["words"]), F.lit(1.0)).otherwise(F.least(share, F.lit(1.0)))
        return F.struct(p["label"].alias("label"), p["base"].alias("base"), start.alias("start"), score.alias("score"))

    return F.transform(F.filter(_bucket(index, F.get(words, i)), stands), place)


def _dealt(entries: list, word) -> list[list]:
    """Entries in buckets by their word's checksum, so that a lookup reads a bucket, not the list."""
    buckets: list[list] = [[] for _ in range(BUCKETS)]
    for e in entries:
        buckets[zlib.crc32(word(e).encode()) % BUCKETS].append(e)
    return buckets


def _bucket(buckets: Column, word: Column) -> Column:
    return F.get(buckets, (F.crc32(word) % BUCKETS).cast("int"))


def _constant(value: list, kind: str) -> Column:
    """A value as one constant of the plan, which the optimizer folds."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _labels(places: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
