"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

Lines with a licence term, each with the words around it in its paragraph that a wrapped template
could reach, become sparse word uni- and bigrams. A multinomial logistic
regression over the grams of the templates, with a class for other paragraphs learned from the
corpus (plain lines, and term-bearing ones far from all templates), gives a family and a probability, calibrated on paragraphs held back from the fit. A
prediction counts when the paragraph also holds enough of one of the family's templates. Scoring is
a join of grams with weights and a sum; training data is of bounded size and fitted on the driver.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

# Notices by which licences announce themselves, by family.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
}
# Fixed value: terms of which every template holds one; only paragraphs with one are scored.
TERMS = "licen[sc]|copyright|permission|redistribut|public domain|free software|creative commons|spdx|warrant"
UNKNOWN = "unknown"
FAMILIES = [*sorted(TEMPLATES), UNKNOWN]
#: Plain lines of the corpus that teach the unknown class, at most, and as many with a term: those
#: with the smallest hashes. Lines with a term that hold less than ``FAR`` of every template teach it.
SAMPLE, FAR = 500, 0.3
#: Passes and step of the fit, its ridge, and what a prediction must reach.
PASSES, STEP, RIDGE = 100, 0.5, 1e-3
MIN_PROBABILITY, MIN_SIMILARITY = 0.5, 0.6

#: Words on either side of a line, and lines: no copy of a template that touches the line reaches
#: further (a written word may be several by letters and digits, such as "BY-NC").
REACH = max(len(t.replace("-", " ").replace(".", " ").split()) for texts in TEMPLATES.values() for t in texts)
#: Grams of a template that a line must add to the words around it, to be part of the copy.
ADDS = 2

SPLIT = "[^\\p{L}\\p{Nd}]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPLIT), lambda w: w != "")


def grams_of(words: Column) -> Column:
    """Distinct words and pairs of neighbouring words."""
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    pairs = F.slice(pairs, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.array_distinct(F.concat(words, pairs))


def plain_grams(text: str) -> list[str]:
    """``grams_of`` for one text, on the driver."""
    cleaned = "".join(c if c.isalpha() or c.isdecimal() else " " for c in text.lower())
    words = cleaned.split()
    return list(dict.fromkeys(words + [f"{a} {b}" for a, b in zip(words, words[1:])]))


def training_rows() -> list[tuple[list[str], str]]:
    """The templates, each whole and as its first and second halves with half the overlap."""
    rows = []
    for family, texts in sorted(TEMPLATES.items()):
        for text in texts:
            words = text.split()
            rows.append((plain_grams(text), family))
            if len(words) > 8:
                rows.append((plain_grams(" ".join(words[:len(words) * 2 // 3])), family))
                rows.append((plain_grams(" ".join(words[len(words) // 3:])), family))
    return rows


def fit(rows: list[tuple[list[str], str]]) -> tuple[dict[str, list[float]], list[float], float]:
    """Weights per gram and class, biases, and the temperature that calibrates the probabilities.

    Grams of template rows only get weights. A first fit leaves every fourth row out; the temperature
    is the one under which those are likeliest. The weights are then fitted on all rows."""
    known = sorted({g for grams, family in rows if family != UNKNOWN for g in grams})

    def logits(model: tuple, grams: tuple[str, ...]) -> list[float]:
        z = list(model[1])
        for g in grams:
            for c, w in enumerate(model[0][g]):
                z[c] += w
        return z

    def softmax(z: list[float], t: float = 1.0) -> list[float]:
        top = max(z)
        e = [math.exp((x - top) / t) for x in z]
        return [x / sum(e) for x in e]

    def trained(data: list[tuple]) -> tuple[dict[str, list[float]], list[float]]:
        weights, bias = {g: [0.0] * len(FAMILIES) for g in known}, [0.0] * len(FAMILIES)
        for _ in range(PASSES):
            for grams, label, weight in data:
                p = softmax(logits((weights, bias), grams))
                for c in range(len(FAMILIES)):
                    step = STEP * weight * ((c == label) - p[c])
                    bias[c] += step
                    for g in grams:
                        weights[g][c] += step - STEP * weight * RIDGE * weights[g][c]
        return weights, bias

    # Equal rows are one with a multiplicity: most paragraphs of the corpus share no gram at all.
    vocabulary = set(known)
    folded = Counter((tuple(g for g in grams if g in vocabulary), family) for grams, family in rows)
    sizes = Counter()
    for (_, family), n in folded.items():
        sizes[family] += n
    data = [(g, FAMILIES.index(f), n / sizes[f]) for (g, f), n in sorted(folded.items())]
    part = trained([r for i, r in enumerate(data) if i % 4])
    held = [(logits(part, g), label, n) for i, (g, label, n) in enumerate(data) if i % 4 == 0]
    temperature = min((0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=lambda t: -sum(
        n * math.log(max(softmax(z, t)[label], 1e-12)) for z, label, n in held))
    return *trained(data), temperature


def _near(lines: Column, most: int) -> Column:
    """The words of the lines up to the first without any, at most so many."""
    blank = F.array_position(F.transform(lines, lambda x: F.size(words_of(x)) == 0), True).cast("int")
    kept = F.slice(lines, F.lit(1), F.when(blank > 0, blank - 1).otherwise(F.size(lines)))
    return F.slice(F.flatten(F.transform(kept, words_of)), 1, most)


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, paragraph, body, before, after`` of the lines that hold a licence term, with the words
    on both sides of them within their paragraph (blank lines end one)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.filter(F.lower("text").rlike(TERMS))
    lines = rows.select("doc_id", F.split("text", "\n").alias("lines"))
    lines = lines.select("doc_id", "lines", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.lower(F.get("lines", i)).rlike(TERMS)).alias("at"))
    # Every line of a paragraph has a word, so that no more than REACH lines matter on either side.
    around = F.transform("at", lambda i: F.struct(
        i.alias("paragraph"), F.get("lines", i).alias("body"),
        F.slice("lines", F.greatest(i + 1 - REACH, F.lit(1)), F.least(i, F.lit(REACH))).alias("above"),
        F.slice("lines", i + 2, F.lit(REACH)).alias("below"),
    ))
    each = lines.select("doc_id", F.explode(around).alias("x")).select("doc_id", "x.*")
    up = F.transform(F.reverse("above"), lambda x: F.concat_ws(" ", F.reverse(words_of(x))))
    return each.select(
        "doc_id", "paragraph", "body", F.reverse(_near(up, REACH)).alias("before"), _near(F.col("below"), REACH).alias("after"),
    )


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, paragraph, family, probability, similarity, confirmed, body``: one row per line with
    a licence term, ``family`` 'unknown' where the classifier says so or is unsure.

    A line is judged alone and, if that confirms nothing, with the words around it in its paragraph.
    ``similarity`` is the share of the best template of the family that was found, by grams (around
    the line only of templates that the line is part of), and ``confirmed`` whether the family is
    known and that is enough. Reads ``doc_id`` and ``text`` only; NULL text counts as empty; repeated
    rows give repeated results; a table without licence terms gives no rows.
    """
    spark = docs.sparkSession
    templates = spark.createDataFrame(
        [(g, f, n, len(plain_grams(t))) for f, ts in TEMPLATES.items() for n, t in enumerate(ts) for g in plain_grams(t)],
        "gram string, family string, template int, size int",
    )
    # Lines are judged by their text and what is around it, each distinct one once.
    lines = paragraphs(docs).withColumn("key", F.sha2(F.to_json(F.struct("body", "before", "after")), 256))
    keyed = lines.select("key", "body", "before", "after").dropDuplicates(["key"])
    own = words_of(F.col("body"))
    rest = F.array_union(grams_of(F.col("before")), grams_of(F.col("after")))
    views = keyed.select("key", F.explode(F.array(
        F.struct(F.lit(0).alias("view"), grams_of(own).alias("grams"), F.array().cast("array<string>").alias("rest")),
        F.struct(F.lit(1).alias("view"), grams_of(F.concat("before", own, "after")).alias("grams"), rest.alias("rest")),
    )).alias("x")).select("key", "x.*")
    views = written(views, "license-views")
    each = views.select("key", "view", F.explode("grams").alias("gram"), "rest").select(
        "key", "view", "gram", (~F.array_contains("rest", F.col("gram"))).cast("int").alias("adds"))
    # Both small tables are made from the templates alone, a few hundred rows whatever the corpus.
    overlap = each.join(F.broadcast(templates), "gram").groupBy("key", "view", "family", "template", "size").agg(
        F.count("*").alias("n"), F.sum("adds").alias("adds")).withColumn("share", F.col("n") / F.col("size"))
    overlap = written(overlap, "license-overlap")
    held = overlap.filter(F.col("adds") >= ADDS).groupBy("key", "view", "family").agg(F.max("share").alias("similarity"))

    plain = F.filter(F.split(text_or_empty(), "\n"), lambda s: ~F.lower(s).rlike(TERMS))
    firsts = docs.select(F.get(plain, F.lit(0)).alias("line")).filter("line IS NOT NULL").distinct()
    sample = firsts.select(F.xxhash64("line").alias("h"), "line").orderBy("h", "line").limit(SAMPLE)
    others = [r["grams"] for r in sample.select(grams_of(words_of(F.col("line"))).alias("grams")).collect()]
    close = overlap.filter(F.col("share") >= FAR).select("key").distinct()
    far = views.filter("view = 0").join(close, "key", "left_anti").select(F.array_join("grams", "\n").alias("line"), "grams").dropDuplicates(["line"])
    others += [r["grams"] for r in far.orderBy(F.xxhash64("line"), "line").limit(SAMPLE).select("grams").collect()]
    weights, bias, temperature = fit(training_rows() + [(g, UNKNOWN) for g in others])
    table = spark.createDataFrame(
        [(g, *w) for g, w in weights.items()], ", ".join(["gram string", *(f"w{c} double" for c in range(len(FAMILIES)))])
    )
    sums = each.join(F.broadcast(table), "gram").groupBy("key", "view").agg(*[F.sum(f"w{c}").alias(f"w{c}") for c in range(len(FAMILIES))])
    logits = [(F.coalesce(F.col(f"w{c}"), F.lit(0.0)) + bias[c]) / temperature for c in range(len(FAMILIES))]
    scored = views.select("key", "view").join(sums, ["key", "view"], "left").select("key", "view", F.array(*logits).alias("z"))
    scored = scored.withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda a, z: a + F.exp(z - F.col("top")))
    names = F.array(*[F.lit(f) for f in FAMILIES])
    scored = scored.select("key", "view", F.get(names, (F.array_position("z", F.col("top")) - 1).cast("int")).alias("family"), (1 / total).alias("probability"))
    judged = scored.join(held, ["key", "view", "family"], "left").select(
        "key", "view", F.when(F.col("probability") >= MIN_PROBABILITY, F.col("family")).otherwise(UNKNOWN).alias("family"),
        "probability", F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
    ).withColumn("confirmed", (F.col("family") != UNKNOWN) & (F.col("similarity") >= MIN_SIMILARITY))
    # The view around the line counts where it alone confirms; else the line speaks for itself.
    best = judged.groupBy("key").agg(F.max_by(
        F.struct("family", "probability", "similarity", "confirmed"), F.struct("confirmed", -F.col("view"))).alias("x"))
    return lines.join(best.select("key", "x.*"), "key").select(
        "doc_id", "paragraph", "family", "probability", "similarity", "confirmed", "body",
    )
