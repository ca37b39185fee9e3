"""Licence scans: a trained paragraph classifier with an unknown class, confirmed by comparison with templates.

A paragraph is a line with a word; its features are its word one- and two-grams. A multinomial logistic regression with an L1 penalty,
fitted in numpy on the templates below (with dropped words and strange surroundings) against ordinary paragraphs, leaves
few grams with a weight. Scoring uses DataFrame functions only: paragraphs without any of the strong grams are unknown
whatever else they hold, so they go first; the grams of the others meet the weights (a table of bounded size), and the summed scores
are scaled to chances by a temperature set on held-out variants. A family below ``least_chance`` is unknown. A prediction is confirmed if the
paragraph shares enough grams with a template of its family, or contains one.

Null and empty texts have no licence. Null ids pass through, repeated rows are scanned each. An empty table gives an empty result.
Only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import written

# The wording of common licence notices, by family.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache 2.0 license.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GPLv3.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "Released under the ISC License.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal.",
    ),
}
# Sentences that sound like notices and are none.
STRANGERS = (
    "All rights reserved. No part of this work may be reproduced without permission.",
    "The driving license was issued in the first year of the new version of the rules.",
    "You can use, copy and modify the file if the software is free of charge.",
    "The terms of the agreement are published by the foundation for any purpose.",
    "A license is required to distribute this software in source and binary forms.",
    "The general public is free to use the work released into the open.",
    "Apache helicopters and the city of Berkeley were in the news of the public domain.",
    "Students of the institute work with commons, attribution and version 2.0 of the creative tools.",
    "Published under the terms of the contract, version 3, for sale at any later date.",
    "The copyright notice is governed by the law of the state and subject to change.",
)
FAMILIES = tuple(TEMPLATES)

_WORD = re.compile(r"[\w][\w.+-]*[\w+]|\w")
#: the same words for Spark's expressions, ASCII and other letters alike
_SPARK_WORD = r"[\p{L}\p{N}_][\p{L}\p{N}_.+-]*[\p{L}\p{N}_+]|[\p{L}\p{N}_]"


def grams(text: str) -> list[str]:
    words = _WORD.findall(text.lower())
    return sorted(set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])})


def gram_column(text: Column) -> Column:
    """The distinct one- and two-grams of a paragraph."""
    words = F.regexp_extract_all(F.lower(text), F.lit(_SPARK_WORD), 0)
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, 1_000_000_000),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(words, pairs))


@dataclass
class Model:
    weights: dict[str, np.ndarray]  # gram -> weight per family, the last for unknown
    bias: np.ndarray
    temperature: float
    strong: list[str]  # a paragraph without any of these grams is unknown

    def chances(self, text: str) -> np.ndarray:
        score = self.bias + sum((self.weights[g] for g in grams(text) if g in self.weights), np.zeros(len(self.bias)))
        score = np.exp((score - score.max()) / self.temperature)
        return score / score.sum()

    def anchor_pattern(self) -> str:
        """A pattern for lower-case text, by the first letters of the strong grams."""
        by_letter: dict[str, list[str]] = {}
        for gram in self.strong:
            by_letter.setdefault(gram[0], []).append(r"[^\p{L}\p{N}_]+".join(map(re.escape, gram[1:].split(" "))))
        return r"(?<![\p{L}\p{N}_])(?:" + "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in sorted(by_letter.items())) + r")(?![\p{L}\p{N}_])"


def strong_grams(weights: dict[str, np.ndarray], bias: np.ndarray, ordinary: list[str]) -> list[str]:
    """Grams of which a paragraph needs one to reach any family: all others together don't outweigh the bias towards unknown.
    The grams most common in ordinary paragraphs are left out first."""
    seen = Counter(g for t in ordinary for g in grams(t))
    left = bias[:-1] - bias[-1]
    strong = []
    for gram in sorted(weights, key=lambda g: (-seen[g], " " not in g, g)):
        lift = np.maximum(weights[gram][:-1] - weights[gram][-1], 0)
        if (left + lift < 0).all():
            left = left + lift
        elif lift.max() > 0:
            strong.append(gram)
    return sorted(strong)


def fit_model(ordinary: list[str], variants: int = 24, rounds: int = 300, penalty: float = 2e-4, seed: int = 7) -> Model:
    """Fit on variants of the templates against ``ordinary`` paragraphs and strangers."""
    rng = np.random.default_rng(seed)
    pool = [w for t in [*ordinary, *STRANGERS] for w in t.split()] or ["the"]

    def varied(text: str) -> str:
        words = [w for w in text.split() if rng.random() > 0.08 * (len(text.split()) > 6)]
        around = [" ".join(rng.choice(pool, rng.integers(0, 8))) if rng.random() < 0.5 else "" for _ in range(2)]
        return " ".join([around[0], *words, around[1]])

    samples = [(varied(t), f) for f, name in enumerate(FAMILIES) for t in TEMPLATES[name] for _ in range(variants)]
    samples += [(t, f) for f, name in enumerate(FAMILIES) for t in TEMPLATES[name] for _ in range(4)]
    unknown = len(FAMILIES)
    samples += [(varied(t), unknown) for t in STRANGERS for _ in range(variants)] + [(t, unknown) for t in ordinary]
    known = {g: i for i, g in enumerate(sorted({g for ts in TEMPLATES.values() for t in ts for g in grams(t)}))}
    x = np.zeros((len(samples), len(known)))
    for i, (text, _) in enumerate(samples):
        x[i, [known[g] for g in grams(text) if g in known]] = 1
    y = np.eye(unknown + 1)[[f for _, f in samples]]
    held = rng.random(len(samples)) < 0.2
    w, b = _proximal(x[~held], y[~held], rounds, penalty)
    score = x[held] @ w + b
    temperatures = np.geomspace(0.3, 3, 25)
    losses = [-np.mean(np.log(np.maximum((_softmax(score / t) * y[held]).sum(axis=1), 1e-12))) for t in temperatures]
    weights = {g: np.round(w[i], 6) for g, i in known.items() if np.abs(w[i]).max() > 1e-6}
    b = np.round(b, 6)
    return Model(weights, b, float(temperatures[int(np.argmin(losses))]), strong_grams(weights, b, ordinary))


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _proximal(x: np.ndarray, y: np.ndarray, rounds: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated proximal gradient of the multinomial loss with an L1 penalty on the weights."""
    n = len(x)
    rate = 2.0 / (np.square(x).sum(axis=1).max() + 1)
    w = np.zeros((x.shape[1], y.shape[1]))
    b = np.zeros(y.shape[1])
    w0, b0, momentum = w, b, 1.0
    for _ in range(rounds):
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        vw, vb = w + (momentum - 1) / after * (w - w0), b + (momentum - 1) / after * (b - b0)
        error = (_softmax(x @ vw + vb) - y) / n
        w0, b0, momentum = w, b, after
        w, b = vw - rate * n / 8 * (x.T @ error), vb - rate * n / 8 * error.sum(axis=0)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * n / 8 * penalty, 0)
    return w, b


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 500, paragraphs: int = 1500) -> Model:
    """The model, with ordinary paragraphs from at most ``sample`` documents chosen by a hash of their ids: at most
    ``paragraphs`` of them, none with the word licence in any form."""
    ids = docs.select(F.col(id_col).alias("doc_id")).dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "doc_id")
    lines = (texts.select(F.explode(F.split("text", "\n")).alias("p")).select(F.substring("p", 1, 400).alias("p"))
             .where(F.col("p").rlike(r"\S") & ~F.lower("p").rlike("licen[sc]e|copyright|cc by|spdx")).distinct())
    found = lines.orderBy(F.xxhash64("p"), "p").limit(paragraphs).collect()
    return fit_model([r["p"] for r in found])


def _values(spark, rows: list[str], names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({names})")


def _numbers(values) -> str:
    return f"array({', '.join(f'{v:.6f}D' for v in values)})"


def licence_paragraphs(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least_chance: float = 0.5,
                       least_shared: float = 0.6) -> DataFrame:
    """One row per paragraph of a licence: row and doc_id, paragraph (line number from 0), text, family, chance, similarity (to the
    nearest template of the family) and confirmed."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _classified(rows, model, spark, least_chance, least_shared)


def _classified(rows: DataFrame, model: Model, spark, least_chance: float, least_shared: float) -> DataFrame:
    anchored = F.lower("text").rlike(model.anchor_pattern())
    lines = (rows.where(anchored).select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "text"))
             .where(anchored))
    # read twice below, so that whole texts are searched once
    lines = written(lines, "licence-lines").withColumn("grams", gram_column(F.col("text")))
    weights = F.broadcast(_values(spark, [f"('{g}', {_numbers(v)})" for g, v in model.weights.items()], "gram, w"))
    places = range(len(FAMILIES) + 1)
    met = lines.select("row", "doc_id", "paragraph", F.explode("grams").alias("gram")).join(weights, "gram")
    sums = met.groupBy("row", "doc_id", "paragraph").agg(*[F.sum(F.col("w")[i]).alias(f"s{i}") for i in places])
    exps = F.array(*[F.exp((F.col(f"s{i}") + F.lit(float(model.bias[i]))) / model.temperature) for i in places])
    total = F.aggregate("e", F.lit(0.0), lambda a, v: a + v)
    chance = F.array_max(F.slice("e", 1, len(FAMILIES))) / total
    best = F.array_position(F.slice("e", 1, len(FAMILIES)), F.array_max(F.slice("e", 1, len(FAMILIES)))).cast("int")
    named = F.element_at(F.array(*map(F.lit, FAMILIES)), best)
    judged = (sums.withColumn("e", exps).select("row", "paragraph", named.alias("family"), chance.alias("chance"))
              .where(F.col("chance") >= least_chance))
    templates = F.broadcast(_values(spark, [
        f"('{f}', array({', '.join(repr(g) for g in grams(t))}))" for f, ts in TEMPLATES.items() for t in ts], "family, template"))
    shared = F.size(F.array_intersect("grams", "template"))
    near = F.greatest(shared / F.size("grams"), shared / F.size("template"))
    compared = judged.join(lines, ["row", "paragraph"]).join(templates, "family")
    return (compared.groupBy("row", "doc_id", "paragraph", "text", "family", "chance").agg(F.max(near).alias("similarity"))
            .withColumn("confirmed", F.col("similarity") >= least_shared))


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least_chance: float = 0.5,
         least_shared: float = 0.6) -> DataFrame:
    """One row per document: doc_id, n_licence (paragraphs with a confirmed licence), n_unconfirmed, families (the
    confirmed ones, in order, joined by commas) and chance (the largest of a confirmed one; null if none)."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = _classified(numbered, model, docs.sparkSession, least_chance, least_shared)
    sure = F.col("confirmed")
    # a document's licence paragraphs and the document itself meet by row number: one partial aggregate, no join
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("family", "string"), ("chance", "double"), ("confirmed", "boolean"))]
    both = found.select("row", "doc_id", "family", "chance", "confirmed").unionByName(numbered.select("row", "doc_id", *empty))
    return (both.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.count_if(sure).alias("n_licence"), F.count_if(~sure).alias("n_unconfirmed"),
        F.array_join(F.sort_array(F.collect_set(F.when(sure, F.col("family")))), ",").alias("families"),
        F.max(F.when(sure, F.col("chance"))).alias("chance")).drop("row"))
