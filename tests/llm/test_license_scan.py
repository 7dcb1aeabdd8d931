import math
import re

import pytest

from fleetfold.llm import license_scan

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def base(text):
    w = words_of(text)
    at = [(k, label) for phrase, label in BASE.items() for p in [phrase.split()]
          for k in range(len(w)) if w[k:k + len(p)] == p]
    places = [k for k, _ in at]
    return (len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at})))


TEXTS = {
    1: "Released UNDER the MIT\nlicense, under the mit license.", 2: "Licensed under the Apache License, Version 2.0.",
    3: "CC-BY-NC 4.0 and cc by nc by nc", 4: None, 5: "", 6: "...", 7: "mit mit under the mit mit license", 8: "under the mit",
    9: "This work is licensed under the GNU General Public License, version 3.", 10: "Ünder the MİT licensé apache\x00license;version~2",
    11: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    12: "Permission is hereby granted free of charge to any dog", 13: "the license of the apache version 2",
    14: "Redistribution and use in source and binary forms, with or without changes, are permitted provided that the following conditions are met",
    15: "x " * 30_000 + "apache license version 2 " * 3, 16: "apache license version 2 apache license version 20",
}


def test_base_columns_and_labels(documents):
    got = {r.doc_id: r for r in license_scan.scan(documents(*TEXTS.items())).collect()}
    assert {i: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for i, r in got.items()} == {i: base(t) for i, t in TEXTS.items()}
    extra = {i: r.labels for i, r in got.items() if r.labels != r.base_labels}
    assert extra == {9: "gpl-3", 11: "mit", 14: "bsd"}
    assert got[2].score == 1.0 and got[4].score == 0.0 and 0.6 <= got[14].score < 1.0 and got[11].score > 0.999
    assert len(got[15].places) == 3


def brute(texts, templates, similarity):
    """Labels and places of all texts, every template tried at every word."""
    files = [words_of(t) for t in texts]
    weight = {w: math.log((len(files) + 1) / (sum(w in f for f in map(set, files)) + 0.5)) + 1e-6 for t in templates for w in t.words}
    out = []
    for f in files:
        places = []
        for t in templates:
            for start in range(len(f)):
                k = start + t.at
                if tuple(f[k:k + len(t.key)]) == t.key:
                    here = f[start:start + len(t.words)]
                    held = sum(weight[w] for w, x in zip(t.words, here) if w == x) / sum(weight[w] for w in t.words)
                    if t.words == t.key or held >= similarity:
                        places.append((t.label, start, 1.0 if t.words == t.key else min(held, 1.0)))
        out.append((",".join(sorted({p[0] for p in places})), sorted(places), max((p[2] for p in places), default=0.0)))
    return out


def mixed_texts():
    """Whole, broken, cut and repeated passages among other words, also at both ends of a text."""
    import random

    rng = random.Random(5)
    texts = list(TEXTS.values())
    for k in range(300):
        words = []
        for _ in range(rng.randrange(4)):
            passage = list(rng.choice(license_scan.TEMPLATES).words)
            for _ in range(rng.randrange(4)):
                passage[rng.randrange(len(passage))] = rng.choice(["other", "license", "the", "public"])
            cut = rng.randrange(len(passage)) if rng.random() < 0.3 else 0
            words += passage[cut:] if k % 2 else passage[:len(passage) - cut]
            words += rng.choices(["license", "public", "the", "gnu", "x", "version"], k=rng.randrange(6))
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("similarity", [0.6, 0.2])
def test_labels_places_and_scores_against_brute_force(documents, similarity):
    texts = mixed_texts()
    rows = license_scan.scan(documents(*enumerate(texts)), similarity=similarity).orderBy("doc_id").collect()
    for r, (labels, places, score) in zip(rows, brute(texts, license_scan.TEMPLATES, similarity), strict=True):
        assert r.labels == labels and r.score == pytest.approx(score, abs=1e-12)
        got = sorted((p.label, p.start, p.score) for p in r.places)
        assert [p[:2] for p in got] == [p[:2] for p in places]
        assert [p[2] for p in got] == pytest.approx([p[2] for p in places], abs=1e-12)


def test_plan_does_not_grow_with_templates(documents):
    docs = documents(*TEXTS.items())
    made = tuple(license_scan.template(f"l{k}", f"licence of rare{k} kind", f"rare{k} kind") for k in range(3000))
    sizes = set()
    for templates in license_scan.TEMPLATES[:3], license_scan.TEMPLATES + made:
        plan = license_scan.scan(docs, templates)._jdf.queryExecution()
        sizes.add(plan.analyzed().toString().count("lambda"))
        assert "from_json" not in plan.optimizedPlan().toString()
        assert "Exchange" not in plan.executedPlan().toString()
    assert len(sizes) == 1
    found = license_scan.scan(documents((1, "a licence of rare2999 kind and rare7 kind")), license_scan.TEMPLATES + made, similarity=0.4).first()
    assert found.labels == "l2999,l7" and [p.start for p in found.places] == [1, 4]


def test_rare_words_weigh_more(documents):
    weights = license_scan.word_weights(documents(*TEXTS.items()), ["the", "apache", "never"])
    assert weights["the"] < weights["apache"] < weights["never"]


def test_repeats_clashing_columns_and_empty_table(spark, documents):
    df = spark.createDataFrame([(1, "cc by nc", "a"), (1, "cc by nc", "a"), (None, "cc by nc", "b")], "doc_id long, text string, words string")
    rows = license_scan.scan(df).collect()
    assert [(r.n_base, r.labels) for r in rows] == [(1, "cc-by-nc")] * 3
    assert license_scan.scan(documents()).count() == 0
