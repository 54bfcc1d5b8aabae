"""Licence scans: a trained paragraph classifier whose predictions are confirmed by comparison with templates.

A paragraph is a line, and so is what of a notice runs on from it: a notice wrapped over any number of lines belongs to the line on
which it begins. Such a run is as many words from a pair of a template as that template has and a quarter more, whatever breaks
are among them; it is classified by itself, so a line can also hold several families. Notices of one family that share a line
count once. Of notices of two families that share words, as those of LGPL and GPL do, the one whose template agrees more counts.

The terms of a paragraph are its words (a-z, 0-9, lower-cased) and pairs of neighbouring words, each once. A sparse
multinomial logistic regression over the terms of the templates gives each family, or ``unknown``, a probability; the
temperature that calibrates it is fitted on examples held out of the training. A prediction other than unknown counts if its
probability reaches ``least`` and the word pairs of one of that family's templates stand in the paragraph to ``agreement``.

Training reads only the notices below, on the driver: whole, cut, with words dropped and among other words, against sentences
that share their words without granting anything. The scan itself is one projection of built-in functions, without any exchange.

Defined results: a null or empty text has no paragraphs with a licence; a paragraph of which no word is a term of the model is
unknown without further work, which is what its score would say; ties go to the first family by name; rows that repeat are
scanned alike; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import math
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
NOTICES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache License 2.0",
        "This project is distributed under the terms of the Apache 2.0 license",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Licensed under the BSD 3-Clause License",
        "Released under the BSD license",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Content is available under the Creative Commons Attribution License",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Available under Creative Commons BY-NC, non commercial use only",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
    ],
    "cc0": [
        "Dedicated to the public domain under CC0 1.0 Universal",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GNU GPL v3",
        "Released under the GNU General Public License version 2 or later",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Licensed under the ISC License",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 3",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "mit": [
        "Released under the MIT License",
        "Licensed under the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The Software is provided as is, without warranty of any kind, express or implied",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
}
OTHERS = [
    "All rights reserved", "Copyright 2019 the authors", "the driving licence was revoked", "a fishing license costs ten dollars", "licensed to drive a bus", "the general public was not told", "a public library in the general area",
    "the apache helicopter landed", "the mit campus in spring", "students of mit and of other schools", "version 3 of the report", "version 2 0 was released in may", "the software was released under pressure", "free software is a movement",
    "a creative director of commons", "the house of commons", "creative work and attribution of quotes", "commercial use of land", "the source of the river", "source code in binary form", "permission to enter was granted", "the use of this file",
    "under the terms of the treaty", "published by the foundation in two volumes", "this work is a novel", "this program is broadcast daily", "the public domain", "the gnu is an antelope", "the wildebeest or gnu", "mozilla is a browser", "available under the counter",
    "the warranty of the car expired", "a copy of the letter", "files and documentation", "the license plate was missing", "license", "licensed", "released", "version", "apache", "mit", "public", "general", "commons", "redistribution of wealth",
    "modification of the engine", "the following conditions apply to your ticket", "cc the manager on this mail", "by the way", "nc state won by 4 0", "law and related rights", "all copyright questions go to the editor", "identifier of the parcel", "software for any purpose",
]
STOP = {"the", "a", "an", "of", "to", "in", "and", "or", "is", "it", "for", "this", "that", "by", "as", "with", "all", "any", "be", "are", "was", "on", "not", "you", "may", "can", "s", "1", "2", "3", "4", "0", "has", "must", "above", "no", "from", "at", "de", "des"}


def words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def pairs(w: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(w, w[1:])]


def terms(w: list[str]) -> set[str]:
    return {*w, *pairs(w)}


@dataclass(frozen=True)
class Model:
    classes: list[str]  # families, then unknown
    bias: list[float]
    weights: dict[str, list[float]]
    anchors: list[str]  # words without which a paragraph has no term
    temperature: float


def examples(seed: int) -> tuple[list[set[str]], list[str]]:
    """Notices whole, with a word in ten dropped, cut by a quarter, and among other words; and sentences that are none."""
    g = random.Random(seed)
    noise = [w for s in OTHERS for w in words(s)]
    found, labels = [], []
    for family, notices in NOTICES.items():
        for text in notices:
            w = words(text)
            for _ in range(12):
                x = [y for y in w if len(w) < 8 or g.random() > 0.1]
                x = x[: max(4, len(x) * 3 // 4)] if len(x) > 12 and g.random() < 0.3 else x
                around = g.choices(noise, k=g.choice([0, 0, 5, 20]))
                found.append(terms(around[: len(around) // 2]) | terms(x) | terms(around[len(around) // 2 :]))
                labels.append(family)
            for _ in range(4):  # two or three words of a notice are not a notice
                a = g.randrange(max(1, len(w) - 3))
                found.append(terms(w[a : a + g.choice([1, 2])]))
                labels.append(UNKNOWN)
    for text in OTHERS:
        for _ in range(8):
            found.append(terms(words(text) + g.choices(noise, k=g.choice([0, 4, 12]))))
            labels.append(UNKNOWN)
    return found, labels


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@lru_cache(maxsize=1)
def trained(rounds: int = 400, rate: float = 0.5, l1: float = 2e-4) -> Model:
    """Proximal gradient descent (weights within l1 of zero vanish), then the temperature on held-out examples."""
    vocabulary = sorted({t for notices in NOTICES.values() for n in notices for t in terms(words(n)) if not {*t.split()} <= STOP})
    place = {t: i for i, t in enumerate(vocabulary)}
    classes = [*NOTICES, UNKNOWN]

    def dense(found: list[set[str]]) -> np.ndarray:
        x = np.zeros((len(found), len(vocabulary)))
        for r, f in enumerate(found):
            x[r, [place[t] for t in f if t in place]] = 1
        return x

    (a, la), (b, lb) = examples(1), examples(2)
    x, y = dense(a), np.eye(len(classes))[[classes.index(c) for c in la]]
    w, bias = np.zeros((len(vocabulary), len(classes))), np.zeros(len(classes))
    for _ in range(rounds):
        slope = softmax(x @ w + bias) - y
        w -= rate * (x.T @ slope) / len(a)
        bias -= rate * slope.mean(axis=0)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
    z, right = dense(b) @ w + bias, [classes.index(c) for c in lb]
    loss = {t: -np.log(softmax(z / t)[np.arange(len(b)), right] + 1e-12).mean() for t in np.geomspace(0.2, 5, 60)}
    kept = {t: [round(float(v), 6) for v in w[i]] for t, i in place.items() if np.any(w[i] != 0)}
    anchors = sorted({p for t in kept for p in t.split() if p not in STOP})
    kept = {t: v for t, v in kept.items() if {*t.split()} & {*anchors}}
    return Model(classes, [round(float(v), 6) for v in bias], kept, anchors, round(float(min(loss, key=loss.get)), 6))


def constant(value, kind: str) -> Column:
    """A literal of any type, folded from JSON when the plan is optimised."""
    return F.from_json(F.lit(json.dumps({"x": value})), f"struct<x: {kind}>")["x"]


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def paragraphs(text: Column, model: Model, least: float, agreement: float) -> Column:
    """array<struct<paragraph, family, probability, agreement>> of the paragraphs that hold a confirmed licence, in their order.

    Each step of the chain reads what it needs from one variable, since a lambda's expression is evaluated as often as it stands."""
    anchors, vocabulary = constant(model.anchors, "array<string>"), constant(sorted(model.weights), "array<string>")
    weights, bias = constant(model.weights, "map<string, array<double>>"), constant(model.bias, "array<double>")
    classes = constant(model.classes, "array<string>")
    distinct = [[sorted(set(pairs(words(n)))) for n in NOTICES[c]] for c in model.classes[:-1]]
    templates = constant([*distinct, []], "array<array<array<string>>>")
    # for runs of lines: each template by itself, with the number of words in which it is looked for
    notices = [{"c": c + 1, "q": sorted(set(pairs(words(n)))), "len": len(words(n)) + max(2, len(words(n)) // 4)} for c, f in enumerate(model.classes[:-1]) for n in NOTICES[f]]
    wide, fewest = max(x["len"] for x in notices), min(math.ceil(agreement * len(x["q"])) for x in notices)
    each, all_pairs = constant(notices, "array<struct<c: int, q: array<string>, len: int>>"), constant(sorted({p for x in notices for p in x["q"]}), "array<string>")
    marks = {*model.anchors}
    gaps = [next((d for d, x in enumerate(w[i:]) if x in marks), 0) for f in NOTICES.values() for w in map(words, f) for i in range(len(w))]
    near = max(gaps) + 3  # from any word of a template to the next anchor, and two words more
    two = lambda w: F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    add = lambda acc, t: F.zip_with(acc, F.element_at(weights, t), lambda a, b: a + b)

    def keep(s: Column, *names: str) -> list[Column]:
        return [s[n].alias(n) for n in names]

    def classified(x: Column, *names: str) -> Column:
        """Class and probability by the terms ``t``, where that is a family that is likely enough; ``names`` are handed on."""
        x = F.transform(x, lambda s: F.struct(*keep(s, *names), F.aggregate(F.array_intersect(s["t"], vocabulary), bias, add).alias("z")))
        x = F.transform(x, lambda s: F.struct(*keep(s, *names, "z"), F.array_max(s["z"]).alias("top")))
        x = F.transform(x, lambda s: F.struct(
            *keep(s, *names), F.array_position(s["z"], s["top"]).cast("int").alias("c"),
            (1 / F.aggregate(s["z"], F.lit(0.0), lambda a, z: a + F.exp((z - s["top"]) / model.temperature))).alias("p"),
        ))
        return F.filter(x, lambda s: (s["c"] < len(model.classes)) & (s["p"] >= least))

    def single(lines: Column) -> Column:
        x = F.filter(lines, lambda s: s["a"])
        x = F.transform(x, lambda s: F.struct(s["i"].alias("i"), F.size(s["w"]).alias("n"), F.array_distinct(F.concat(s["w"], two(s["w"]))).alias("t")))
        x = classified(x, "i", "n", "t")
        agree = lambda s: F.array_max(F.transform(F.element_at(templates, s["c"]), lambda n: F.size(F.array_intersect(n, s["t"])) / F.size(n)))
        x = F.transform(x, lambda s: F.struct(s["i"].alias("paragraph"), F.element_at(classes, s["c"]).alias("family"), s["p"].alias("probability"), agree(s).alias("agreement"), s["n"].alias("n")))
        return F.filter(x, lambda s: s["agreement"] >= agreement)

    def runs(lines: Column) -> Column:
        """Notices that begin on a line, wherever they end: a line and the ``wide`` words after it hold all of them."""
        after = lambda s: F.slice(lines, s["k"] + 2, wide)
        x = F.filter(lines, lambda s: s["a"] | F.exists(F.slice(lines, s["k"] + 2, near), lambda y: y["h"]))
        x = F.transform(x, lambda s: F.struct(*keep(s, "k", "i"), F.size(s["w"]).alias("n"), F.concat(s["w"], F.slice(F.flatten(F.transform(after(s), lambda y: F.slice(y["w"], 1, wide))), 1, wide)).alias("v")))
        x = F.transform(x, lambda s: F.struct(*keep(s, "k", "i", "n", "v"), two(s["v"]).alias("p")))
        x = F.transform(x, lambda s: F.struct(*keep(s, "k", "i", "n", "v", "p"), F.array_intersect(all_pairs, s["p"]).alias("m")))
        x = F.filter(x, lambda s: F.size(s["m"]) >= fewest)
        reached = lambda s: F.filter(each, lambda t: F.size(F.array_intersect(t["q"], s["m"])) >= agreement * F.size(t["q"]))
        x = F.flatten(F.transform(x, lambda s: F.transform(reached(s), lambda t: F.struct(*keep(s, "k", "i", "n", "v", "p"), t["c"].alias("own"), t["q"].alias("q"), t["len"].alias("len")))))
        starts = lambda s: F.filter(F.sequence(F.lit(1), s["n"]), lambda at: F.array_contains(s["q"], F.get(s["p"], at - 1)))
        best = lambda s: F.array_max(F.transform(starts(s), lambda at: F.struct((F.size(F.array_intersect(s["q"], F.slice(s["p"], at, s["len"] - 1))) / F.size(s["q"])).alias("agreement"), (-at).alias("at"))))
        x = F.transform(x, lambda s: F.struct(*keep(s, "k", "i", "n", "v", "p", "own", "q", "len"), best(s).alias("best")))
        x = F.filter(x, lambda s: s["best"]["agreement"] >= agreement)
        x = F.transform(x, lambda s: F.struct(*keep(s, "k", "i", "n", "v", "p", "own", "q", "len"), s["best"]["agreement"].alias("agreement"), (-s["best"]["at"]).alias("at")))
        ends = lambda s: F.array_max(F.filter(F.sequence(s["at"], F.least(s["at"] + s["len"] - 2, F.size(s["p"]))), lambda j: F.array_contains(s["q"], F.get(s["p"], j - 1)))) + 1 - s["n"]
        x = F.transform(x, lambda s: F.struct(*keep(s, "k", "i", "n", "at", "own", "agreement"), ends(s).alias("over"), F.array_distinct(F.concat(F.slice(s["v"], s["at"], s["len"]), F.slice(s["p"], s["at"], s["len"] - 1))).alias("t")))
        x = F.filter(classified(x, "k", "i", "n", "at", "own", "agreement", "over"), lambda s: s["c"] == s["own"])
        last = lambda s: F.aggregate(
            after(s), F.struct(s["over"].alias("left"), F.struct(s["i"].alias("line"), (s["over"] + s["n"]).alias("at")).alias("last")),
            lambda a, y: F.struct((a["left"] - F.size(y["w"])).alias("left"), F.when(a["left"] > 0, F.struct(y["i"].alias("line"), a["left"].alias("at"))).otherwise(a["last"]).alias("last")), lambda a: a["last"],
        )
        x = F.transform(x, lambda s: F.struct(s["i"].alias("paragraph"), F.element_at(classes, s["c"]).alias("family"), (-s["agreement"]).alias("less"), s["p"].alias("probability"), F.struct(s["i"].alias("line"), s["at"].alias("at")).alias("first"), last(s).alias("last")))
        better = lambda s, o: (o["family"] != s["family"]) & (o["less"] < s["less"]) & (o["first"] <= s["last"]) & (s["first"] <= o["last"])
        x = let(x, lambda r: F.filter(r, lambda s: ~F.exists(r, lambda o: better(s, o))))
        once = lambda r: F.filter(r, lambda s, j: ~F.exists(F.slice(r, 1, j), lambda o: (o["family"] == s["family"]) & (o["last"]["line"] >= s["paragraph"])))
        return let(F.array_sort(x), once)

    def both(found: Column, more: Column) -> Column:
        covers = lambda s, o: (o["paragraph"] < s["paragraph"]) & ((o["last"]["line"] > s["paragraph"]) | ((o["last"]["line"] == s["paragraph"]) & (o["last"]["at"] >= agreement * s["n"])))
        old = F.filter(found, lambda s: ~F.exists(more, lambda o: (o["family"] != s["family"]) & (-o["less"] > s["agreement"]) & covers(s, o)))
        new = F.filter(more, lambda s: ~F.exists(found, lambda o: (o["family"] == s["family"]) & o["paragraph"].between(s["paragraph"], s["last"]["line"])))
        own = ("paragraph", "family", "probability")
        return F.array_sort(F.concat(F.transform(old, lambda s: F.struct(*keep(s, *own, "agreement"))), F.transform(new, lambda s: F.struct(*keep(s, *own), (-s["less"]).alias("agreement")))))

    x = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p, i: F.struct(i.alias("i"), F.regexp_extract_all(F.lower(p), F.lit("[a-z0-9]+"), F.lit(0)).alias("w")))
    x = F.transform(F.filter(x, lambda s: F.size(s["w"]) > 0), lambda s, k: F.struct(k.alias("k"), *keep(s, "i", "w"), F.arrays_overlap(s["w"], anchors).alias("a")))
    x = F.transform(x, lambda s: F.struct(*keep(s, "k", "i", "w", "a"), (s["a"] & F.arrays_overlap(F.slice(s["w"], 1, near), anchors)).alias("h")))
    x = let(x, lambda lines: F.when(F.exists(lines, lambda s: s["a"]), lines).otherwise(F.slice(lines, 1, 0)))  # most texts have none
    return let(x, lambda lines: let(F.struct(single(lines).alias("found"), runs(lines).alias("more")), lambda x: both(x["found"], x["more"])))


def scan(docs: DataFrame, least: float = 0.5, agreement: float = 0.75, model: Model | None = None) -> DataFrame:
    """doc_id, n_paragraphs and the confirmed licences of every row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id"), F.size(F.split(text, "\n")).cast("long").alias("n_paragraphs"), paragraphs(F.col("text"), model or trained(), least, agreement).alias("licences"))


def report(docs: DataFrame, least: float = 0.5, agreement: float = 0.75) -> DataFrame:
    """doc_id, n_paragraphs, n_licences, families (sorted, comma-joined) and the least probability among them (null: none)."""
    named = scan(docs, least, agreement)
    families = F.array_join(F.array_sort(F.array_distinct(F.col("licences.family"))), ",")
    return named.select("doc_id", "n_paragraphs", F.size("licences").cast("long").alias("n_licences"), families.alias("families"), F.array_min(F.col("licences.probability")).alias("least_probability"))
