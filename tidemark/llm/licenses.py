"""Licence scans: a trained paragraph classifier, confirmed by template comparison, in DataFrame functions alone.

Words of notices are looked for line by line. Lines that hold a word of the model are licence lines; a stretch of
them, without a blank line and with at most one other line between two, is a paragraph, as notices are often
wrapped.
Every licence line is judged by itself, so that a notice within ordinary text is found, and every paragraph of two
or more lines as a whole: for each family that is likelier than the class unknown, it gives a row, at its first
line, where a template confirms the family, nearly as well as the best template of any, and no line of it alone
does; its unconfirmed lines of that family give none then.

Distinct words and word pairs are the features of a sparse multinomial logistic regression over the licence
families and the class unknown, trained by proximal gradient steps on the templates (with words left out and
other words around them), on ordinary lines, and on notices whose licence has a name of no family. Features that
ordinary lines share are none. Temperature scaling calibrates the probabilities on paragraphs held out of the fit
and on licences it has never seen: half of the families at a time are left out of a trial fit, and their templates
then count as unknown.

A predicted family is confirmed if a template of it has most of its word pairs in the paragraph, and names no
other version than the paragraph does. `version` is what the paragraph itself says.

Equal lines and equal paragraphs are judged once, so a licence line that a third of all documents carry costs one
row. Texts are taken apart once, and only licence lines and their neighbours go on.

Defined results: null and empty texts have no lines and give no rows; repeated rows give repeated rows; a very
long line is one line; ties go to the class unknown, then to the family, then to the template, that comes first;
an empty table gives an empty one; other columns are not carried.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

# Public licence notices and the paragraphs of short licences, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "isc": (
        "Distributed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "agpl": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Distributed under the BSD 3-Clause License.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0",
        "Released under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "For more information, please refer to http://unlicense.org/",
        "SPDX-License-Identifier: Unlicense",
    ),
    "cc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
        "This work is licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "proprietary": (
        "All rights reserved.",
        "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ),
}
# How a notice names its licence; in the fit, with a name of no family in place of X, they are unknown.
FRAMES = (
    "Licensed under the X License, Version 1.0.",
    "Released under the X License.",
    "Distributed under the X License.",
    "This work is licensed under the X License, version 3.",
    "This program is made available under the terms of the X Public License 1.1",
    "SPDX-License-Identifier: X-1.0",
    "SPDX-License-Identifier: X",
    "See the file for the license of this version",
)
FAMILIES = (*TEMPLATES, "unknown")
#: Share of a template's word pairs that confirms a prediction.
CONFIRMED_FROM = 0.6
#: A confirmed row has the share of the pairs that its family alone has too, and more than this probability.
SURE_FROM = 0.5
#: How much less than a paragraph's best similarity a family's may be; licences share some of their wording.
NEARLY = 0.02
#: The most rows of the tables of weights and templates that go to every task.
MOST_FEATURES = 20_000
#: In words that a space parts: the number after `version` or `v`, or at the end of an SPDX identifier.
VERSION = r"(?:\b(?:version|v) ([0-9]+(?: [0-9]+)?)\b)|(?:\bspdx license identifier (?:[a-z]+ )+?([0-9]+(?: [0-9]+)?)\b)"


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def grams(words: list[str]) -> set[str]:
    return {*words, *map(" ".join, zip(words, words[1:], strict=False))}


def version_of(text: str) -> str:
    """`2 0` for version 2.0; a last number of 0 says nothing (version 3.0 is version 3); empty without one."""
    found = re.search(VERSION, " ".join(words_of(text)))
    return (found[1] or found[2] or "").removesuffix(" 0") if found else ""


@dataclass(frozen=True)
class Model:
    """weights: {feature: a number for each family}; bias: the same without features; both are already calibrated. words: every text with a feature holds one of them."""

    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    words: frozenset[str]

    def probabilities(self, text: str) -> np.ndarray:
        z = np.array(self.bias)
        for g in grams(words_of(text)):
            z = z + np.array(self.weights.get(g, (0.0,) * len(FAMILIES)))
        p = np.exp(z - z.max())
        return p / p.sum()


def soft_max(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def descend(x: np.ndarray, y: np.ndarray, steps: int, rate: float, sparsity: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of the multinomial regression; weights shrink towards 0 at every step."""
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    for _ in range(steps):
        error = (soft_max(x @ w + b) - y) / len(x)
        w -= rate * (x.T @ error)
        b -= rate * error.sum(0)
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * sparsity)
    return w, b


def train(ordinary: list[str], copies: int = 24, steps: int = 300, rate: float = 2.0, sparsity: float = 2e-4, seed: int = 3) -> Model:
    """Fit on the templates' variants, on ordinary lines, of which those that hold most of a template are left out, and on notices of made-up licences."""
    rng = random.Random(seed)
    unknown = len(FAMILIES) - 1
    pairs = [set(zip(words_of(t), words_of(t)[1:], strict=False)) for ts in TEMPLATES.values() for t in ts]
    plain = [w for w in map(words_of, ordinary) if w and not any(len(p & set(zip(w, w[1:], strict=False))) * 2 >= len(p) for p in pairs)]
    filler = [w for ws in plain for w in ws[:40]] or ["the", "of", "and", "work", "file"]
    common: dict[str, int] = {}
    for words in plain:
        for g in grams(words):
            common[g] = common.get(g, 0) + 1
    own = {g for ts in TEMPLATES.values() for t in ts for g in grams(words_of(t))}
    frequent = {g for g in own if common.get(g, 0) > 0.02 * max(1, len(plain))}
    single = {g for g in own - frequent if " " not in g and not g.isdigit()}
    place = {g: i for i, g in enumerate(sorted(single | {g for g in own - frequent if " " in g and single & set(g.split())}))}

    rows: list[tuple[set[str], int]] = []
    for k, family in enumerate(TEMPLATES):
        for template in TEMPLATES[family]:
            for _ in range(copies):
                words = [str(rng.randint(1, 9)) if w.isdigit() and rng.random() < 0.5 else w for w in words_of(template) if rng.random() > 0.1]
                around = [rng.choice(filler) for _ in range(rng.choice((0, 0, 0, 4, 12)))]
                cut = rng.randint(0, len(around))
                rows.append((grams(around[:cut] + words + around[cut:]), k))
    for words in plain[: 2 * len(rows)]:
        rows.append((grams(words), unknown))
    for frame in FRAMES:
        for _ in range(copies * 4):
            name = " ".join(rng.choice(filler) for _ in range(rng.choice((1, 1, 2))))
            words = [w for w in words_of(frame.replace("X", name)) if rng.random() > 0.1]
            rows.append((grams(words), unknown))
    generic = [w for frame in FRAMES for w in words_of(frame) if w != "x"]
    for _ in range(copies * 4):  # licence words that name no family
        rows.append((grams([rng.choice(generic if rng.random() < 0.5 else filler) for _ in range(rng.randint(3, 20))]), unknown))
    rng.shuffle(rows)
    x = np.zeros((len(rows), len(place)), np.float32)
    for r, (gs, _) in enumerate(rows):
        x[r, [place[g] for g in gs if g in place]] = 1
    kinds = np.array([k for _, k in rows])
    of = lambda k: np.eye(len(FAMILIES), dtype=np.float32)[k]

    # held out: the last quarter of the rows, and all rows of the families that a trial leaves out
    cut = len(rows) * 3 // 4
    logits, truth = [], []
    for half in (0, 1):
        absent = (kinds < unknown) & (kinds % 2 == half)
        w, b = descend(x[:cut][~absent[:cut]], of(kinds[:cut][~absent[:cut]]), steps // 2, rate, sparsity)
        tried = absent | (np.arange(len(rows)) >= cut)
        logits.append(x[tried] @ w + b)
        truth.append(np.where(absent, unknown, kinds)[tried])
    z, y = np.concatenate(logits), np.concatenate(truth)
    loss = lambda t: -np.mean(np.log(np.maximum(1e-12, soft_max(z / t)[np.arange(len(y)), y])))
    heat = min((0.25 * 1.15**i for i in range(30)), key=loss)
    w, b = descend(x[:cut], of(kinds[:cut]), steps, rate, sparsity)
    kept = np.flatnonzero(np.abs(w).sum(1) > 0)
    names = [g for i, g in enumerate(place) if i in {*kept.tolist()}]
    alone = {g for g in names if " " not in g}
    looked_for = alone | {w for g in names if not alone & {*g.split()} for w in g.split() if w in single}
    return Model({g: tuple((w[place[g]] / heat).tolist()) for g in names}, tuple((b / heat).tolist()), frozenset(looked_for))


def licence_lines(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row (one for each row of docs), i (number of the line), norm (its words) and own (whether it holds a word of the model) of the licence lines and the lines beside them."""
    single = sorted(model.words)
    words = lambda x: F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x, i: F.struct(i.alias("i"), words(x).alias("norm")))
    lines = F.transform(lines, lambda x: F.struct(x["i"], x["norm"], F.arrays_overlap(F.split(x["norm"], " "), F.array(*map(F.lit, single))).alias("own")))
    beside = lambda ls, i: F.coalesce(F.get(ls, i)["own"], F.lit(False))
    near = lambda ls: F.filter(ls, lambda x: x["own"] | beside(ls, x["i"] - 1) | beside(ls, x["i"] + 1))
    # bound once: the lines are read again for each line's neighbours
    kept = F.element_at(F.transform(F.array(lines), lambda ls: F.when(F.exists(ls, lambda x: x["own"]), near(ls))), 1)
    named = docs.select(F.col(id_column).alias("doc_id"), F.col(text), F.monotonically_increasing_id().alias("row"))
    return named.select("doc_id", "row", F.explode(kept).alias("x")).select("doc_id", "row", "x.i", "x.norm", "x.own")


def paragraphs(lines: DataFrame) -> DataFrame:
    """doc_id, row, paragraph and last (numbers of its first and last line) and norm of the stretches of two licence lines or more."""
    before = Window.partitionBy("row").orderBy("i")
    marked = lines.withColumn("last_own", F.last(F.when(F.col("own"), F.col("i")), ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)))
    gap = F.col("i") - F.col("last_own")
    begins = F.col("own") & (F.col("last_own").isNull() | (gap > 2) | ((gap == 2) & (F.lag("norm").over(before) == "")))
    placed = marked.withColumn("stretch", F.sum(begins.cast("int")).over(before))
    ends = placed.where("stretch > 0").groupBy("doc_id", "row", "stretch").agg(F.min(F.when(F.col("own"), F.col("i"))).alias("paragraph"), F.max(F.when(F.col("own"), F.col("i"))).alias("last"), F.array_sort(F.collect_list(F.struct("i", "norm"))).alias("all"))
    inside = F.transform(F.filter("all", lambda x: x["i"] <= F.col("last")), lambda x: x["norm"])
    return ends.where("paragraph < last").select("doc_id", "row", "paragraph", "last", F.array_join(F.filter(inside, lambda x: x != ""), " ").alias("norm"))


def fit(docs: DataFrame, documents: int = 200, lines: int = 4000, text: str = "text") -> Model:
    """Train with the lines of at most `documents` documents, the first by a hash of their text, as ordinary ones; of their distinct lines the first `lines` by a hash."""
    some = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).orderBy(F.xxhash64("t"), "t").limit(documents)
    found = some.select(F.explode(F.split("t", "\n")).alias("line")).where("line <> ''").distinct().orderBy(F.xxhash64("line"), "line").limit(lines)
    return train(sorted(r["line"] for r in found.collect()))


def tables(spark: SparkSession, model: Model) -> tuple[DataFrame, DataFrame]:
    """The model's weights by feature, and the templates' word pairs and versions; own: a pair that no other family's templates have."""
    weights = [(g, list(w)) for g, w in sorted(model.weights.items())]
    pairs_of = lambda template: {*map(" ".join, zip(words_of(template), words_of(template)[1:], strict=False))}
    families = Counter(g for templates in TEMPLATES.values() for g in set().union(*map(pairs_of, templates)))
    pairs = []
    for k, (family, templates) in enumerate(TEMPLATES.items()):
        for t, template in enumerate(templates):
            known = sorted(pairs_of(template))
            alone = sum(families[g] == 1 for g in known)
            pairs += [(g, k, f"{family}-{t}", t, version_of(template), len(known), families[g] == 1, alone) for g in known]
    if max(len(weights), len(pairs)) > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} features")
    return spark.createDataFrame(weights, "gram string, weights array<double>"), spark.createDataFrame(pairs, "gram string, k int, template string, t int, said string, pairs int, own boolean, alone int")


def version(norm: Column) -> Column:
    """The version that a paragraph's words name, as version_of has it."""
    found = F.regexp_extract_all(norm, F.lit(VERSION), F.lit(0))
    number = F.regexp_extract(F.get(found, 0), "([0-9]+(?: [0-9]+)?)$", 1)
    return F.coalesce(F.regexp_replace(number, " 0$", ""), F.lit(""))


def judged(norms: DataFrame, model: Model) -> DataFrame:
    """key (an MD5 of norm), family, probability, likeliest (whether no class is likelier), and the best template's comparison, of each distinct norm and each family that is likelier than unknown. Texts are shuffled once, to find the distinct ones."""
    weights, templates = tables(norms.sparkSession, model)
    once = norms.groupBy(F.md5(F.col("norm").cast("binary")).alias("key")).agg(F.first("norm").alias("norm"))
    split = once.select("key", version(F.col("norm")).alias("version"), F.split("norm", " ").alias("words"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.concat_ws(" ", F.element_at("words", i), F.element_at("words", i + 1)))
    pairs = F.when(F.size("words") > 1, pairs).otherwise(F.array().cast("array<string>"))
    wanted = sorted({*model.weights, *(" ".join(g) for ts in TEMPLATES.values() for t in ts for g in zip(words_of(t), words_of(t)[1:], strict=False))})
    # of a long paragraph's grams only those that the model or a template knows become rows
    taken = written(split.select("key", "version", F.explode(F.array_intersect(F.concat("words", pairs), F.array(*map(F.lit, wanted)))).alias("gram")))

    size = len(FAMILIES)
    sums = [F.round(F.sum(F.element_at("weights", i + 1)) + model.bias[i], 9) for i in range(size)]
    logits = taken.join(F.broadcast(weights), "gram").groupBy("key").agg(F.array(*sums).alias("z")).withColumn("top", F.array_max("z"))
    logits = logits.withColumn("total", F.aggregate("z", F.lit(0.0), lambda t, x: t + F.exp(x - F.col("top"))))
    unknown = F.element_at("z", size)
    best = F.when(unknown == F.col("top"), size - 1).otherwise(F.array_position("z", F.col("top")) - 1)
    each = F.transform(F.slice("z", 1, size - 1), lambda x, k: F.struct(k.alias("k"), x.alias("z"), F.round(F.exp(x - F.col("top")) / F.col("total"), 6).alias("probability")))
    likely = logits.select("key", best.alias("best"), F.explode(F.filter(each, lambda e: e["z"] > unknown)).alias("e")).select("key", "best", "e.k", "e.probability")

    shares = taken.join(F.broadcast(templates), "gram").groupBy("key", "k", "template").agg((F.count(F.lit(1)) / F.first("pairs")).alias("share"), ((F.first("alone") == 0) | (F.count_if("own") >= F.first("alone") * CONFIRMED_FROM)).alias("named"), *[F.first(c).alias(c) for c in ("said", "version", "t")])
    same = (F.col("said") == "") | (F.col("version") == "") | (F.col("said") == F.col("version"))
    match = shares.withColumn("fits", (F.col("share") >= CONFIRMED_FROM) & F.col("named") & same).groupBy("key", "k").agg(F.max(F.struct("fits", "share", (-F.col("t")).alias("t"), "template")).alias("m"), F.first("version").alias("version"))
    return likely.join(match, ["key", "k"], "left").select(
        "key", F.element_at(F.array(*map(F.lit, FAMILIES)), F.col("k") + 1).alias("family"), "probability", (F.col("k") == F.col("best")).alias("likeliest"), F.col("m.template").alias("template"),
        F.round(F.coalesce("m.share", F.lit(0.0)), 6).alias("similarity"), F.translate(F.coalesce("version", F.lit("")), " ", ".").alias("version"), (F.coalesce("m.fits", F.lit(False)) & (F.col("probability") > SURE_FROM)).alias("confirmed"),
    )


def scan(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, paragraph (its first line), lines, family, probability, template, similarity, version and confirmed of every line whose likeliest class is a licence family, and of every paragraph of more lines that a template confirms."""
    lines = written(licence_lines(docs, model, id_column, text))
    runs = written(paragraphs(lines))
    hit = lines.where("own").select("doc_id", "row", F.col("i").alias("paragraph"), F.col("i").alias("last"), "norm")
    found = written(judged(hit.select("norm").unionByName(runs.select("norm")), model))
    keyed = lambda rows: rows.withColumn("key", F.md5(F.col("norm").cast("binary"))).drop("norm")
    of_line = keyed(hit).join(found.where("likeliest").drop("likeliest"), "key")
    by_run = found.where("confirmed").withColumn("best", F.max("similarity").over(Window.partitionBy("key"))).where(F.col("similarity") >= F.col("best") - NEARLY)
    of_run = keyed(runs).join(by_run, "key")
    place = lambda rows: rows.select(F.col("row").alias("row_2"), F.col("family").alias("family_2"), F.col("paragraph").alias("first_2"), F.col("last").alias("last_2")).distinct()
    same = "row = row_2 AND family = family_2"
    of_run = of_run.join(place(of_line.where("confirmed")), F.expr(f"{same} AND first_2 BETWEEN paragraph AND last"), "left_anti")
    of_line = of_line.join(place(of_run), F.expr(f"{same} AND NOT confirmed AND paragraph BETWEEN first_2 AND last_2"), "left_anti")
    out = ("doc_id", "paragraph", (F.col("last") - F.col("paragraph") + 1).alias("lines"), "family", "probability", "template", "similarity", "version", "confirmed")
    return of_line.select(*out).unionByName(of_run.select(*out))
