"""License scans in native operations: a trained classifier of paragraphs, confirmed by comparison with templates.

A paragraph is a line. Its word pairs and triples that the templates know have
a weight for each class: the families of TEMPLATES, `unknown` (terms of use
that belong to none of them) and `none`. The classifier is a multinomial
logistic regression over the share that each n-gram has in the paragraph,
learned on the driver from the templates, variants of them and at most
NEGATIVES lines of the corpus; its probabilities are calibrated by a
temperature on lines kept out of learning. A family is reported where it is
the likeliest class and has LEAST_PROBABILITY or more; a paragraph that looks
like terms of use, but for which no family does, is `unknown`. A family is
confirmed if the paragraph holds LEAST_PERCENT hundredths of the 5-word
shingles of one of its templates.

Scoring is a join of the corpus's word pairs with the learned weights, which
are as many as the templates have n-grams, and a sum for each paragraph.
Weights are whole millionths, so sums don't depend on the order of rows.

`scan` scores whole lines, so that what else stands on a line thins a notice
out. `scan_passages`, which the query runs, scores overlapping windows of
SIZES words instead, across line ends: one of each size from every word that
begins a known pair (any other window holds no more than one of these). Where
reported windows overlap, the one that holds most of a template, then the
likeliest, stays; its paragraph is the line where the notice begins, and a
paragraph has one row for each family in it.

Cases: null and empty texts and lines without words are not reported; rows of
equal or null doc_id are scanned one by one; an empty table gives an empty
table (and is learned without corpus lines); further columns are not read; a
line of any length is one paragraph.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linecue.llm.common import table

NONE, UNKNOWN = "none", "unknown"
#: Bounds of what is taken from the corpus to learn from: documents, read whole, and lines of them in all.
NEGATIVE_DOCS, NEGATIVES = 200, 1500
LEAST_PROBABILITY, LEAST_PERCENT, WIDTH = 0.5, 80, 5
MILLION = 1_000_000
#: Words of the windows; a notice fills two thirds of one of them, or it is longer and fills them all.
SIZES = (3, 5, 8, 12, 18, 27, 40)

#: A line of the corpus with one of these may hold terms of any licence, so it is no example of `none`.
RIGHTS = re.compile("licen[cs]|copyright|rights reserved|public domain")

# Usual short notices of well-known licences.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 2.1 or later.",
    ],
    "agpl-3.0": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ],
    "zlib": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    ],
    "boost-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software.",
    ],
    "epl-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Licensed under the Eclipse Public License, version 2.0.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "public-domain": ["This work has been released into the public domain by its author.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."],
}
# Terms of use of no family above, and sentences that only sound like them.
OTHER_TERMS = [
    "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
    "This software is licensed, not sold, under the terms of the end user license agreement.",
    "Licensed under the terms of the company's proprietary source license; redistribution is prohibited.",
    "Released under a custom license, see the license file for the terms.",
    "Use of this material is subject to the license agreement between you and the vendor.",
]
NOT_TERMS = [
    "She renewed her driver's license at the office under the bridge.",
    "The version of the story published by the author was released in May.",
    "The city granted the permission to use the public park free of charge.",
    "They may obtain a copy of the book at the library with or without a card.",
    "The terms of the general election were agreed to in writing.",
]


def plain_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _grams(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)]


class Classifier:
    """weights: (n-grams, classes) and bias in millionths; temperature divides both."""

    def __init__(self, negatives: list[str], seed: int = 11):
        rand = np.random.default_rng(seed)
        self.classes = [*TEMPLATES, UNKNOWN, NONE]
        texts = [(w, k) for k, of in enumerate([*TEMPLATES.values(), OTHER_TERMS]) for t in of if (w := plain_words(t))]
        filler = [w for t in [*negatives, *NOT_TERMS] for w in plain_words(t)]
        rows = []
        for words, k in texts:
            for i in range(12):
                kept = [w for w in words if i == 0 or rand.random() > 0.08]
                some = lambda: [filler[j] for j in rand.integers(0, len(filler), rand.integers(0, 8))]
                rows.append((kept if i < 6 else some() + kept + some(), k))
        rows += [(plain_words(t), len(self.classes) - 1) for t in [*negatives, *NOT_TERMS * 6]]
        known = dict.fromkeys(g for w, _ in texts for g in _grams(w))
        self.grams = {g: i for i, g in enumerate(known)}
        windows = dict.fromkeys(v for w, k in rows if k == len(self.classes) - 1 for v in self._windows(w))
        rows += [(list(v), len(self.classes) - 1) for v in windows]
        x, y = np.zeros((len(rows), len(self.grams))), np.array([k for _, k in rows])
        for i, (words, _) in enumerate(rows):
            for g in _grams(words):
                if g in self.grams:
                    x[i, self.grams[g]] += 1 / max(1, len(words))
        held = np.arange(len(rows)) % 5 == 4
        weights, bias = self._fit(x[~held], y[~held])
        logits = x[held] @ weights + bias
        loss = lambda t: -np.mean((z := logits / t)[np.arange(len(z)), y[held]] - np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) - z.max(1))
        temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8), key=loss)
        self.weights = np.rint(weights / temperature * MILLION).astype(np.int64)
        self.bias = np.rint(bias / temperature * MILLION).astype(np.int64)

    def _windows(self, words: list[str]) -> list[tuple[str, ...]]:
        """The windows that begin with a known pair."""
        return [tuple(words[p : p + n]) for p in range(len(words) - 1) if f"{words[p]} {words[p + 1]}" in self.grams for n in SIZES]

    def _fit(self, x: np.ndarray, y: np.ndarray, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.classes)
        w, b, aim = np.zeros((x.shape[1], n)), np.zeros(n), np.eye(n)[y]
        first, second = [0.0, 0.0], [0.0, 0.0]
        for step in range(1, steps + 1):
            z = x @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p = (p / p.sum(1, keepdims=True) - aim) / len(y)
            for k, (param, grad) in enumerate(((w, x.T @ p + 1e-6 * w), (b, p.sum(0)))):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.99 * second[k] + 0.01 * grad * grad
                param -= 0.3 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-9)
        return w, b

    def table(self, spark: SparkSession) -> DataFrame:
        """(n, gram, w): a row an n-gram, w array<long> by class."""
        rows = [(g.count(" ") + 1, g, [int(v) for v in self.weights[i]]) for g, i in self.grams.items()]
        return spark.createDataFrame(rows, "n int, gram string, w array<long>")


def corpus_lines(docs: DataFrame) -> list[str]:
    """At most NEGATIVES lines of at most NEGATIVE_DOCS documents, none of which holds a word of RIGHTS or half of a template or of OTHER_TERMS; the same ones whatever the partitioning."""
    some = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(NEGATIVE_DOCS)
    lines = some.select(F.explode(F.split("text", "\n")).alias("line")).where(F.length(F.trim("line")) > 0).distinct()
    found = [r.line for r in lines.orderBy(F.xxhash64("line"), "line").limit(NEGATIVES).collect()]
    known = [set(_grams(plain_words(t))) for of in [*TEMPLATES.values(), OTHER_TERMS] for t in of]
    return [t for t in found if not RIGHTS.search(" ".join(plain_words(t))) and not any(2 * len(k & set(_grams(plain_words(t)))) >= len(k) for k in known)]


def _shingles(words: Column) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (WIDTH - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WIDTH))))


def scores(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, paragraph, words, logits array<double>) of the paragraphs with an n-gram that the model knows."""
    lines = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("paragraph", "line"))
    lines = lines.select("doc_id", "row", "paragraph", words_of(F.col("line")).alias("words")).where(F.size("words") > 1)
    at = lines.select("*", F.posexplode("words").alias("p", "a"))
    word = lambda k: F.get("words", F.col("p") + k)
    of = F.broadcast(model.table(docs.sparkSession))  # as many rows as the templates have n-grams
    pairs = of.where("n = 2").select(F.col("gram").alias("pair"), F.col("w").alias("w2"))
    triples = of.where("n = 3").select(F.col("gram").alias("triple"), F.col("w").alias("w3"))
    # Every known triple begins with a known pair, so the pairs' join may drop rows.
    hits = at.select("doc_id", "row", "paragraph", "words", F.concat_ws(" ", "a", word(1)).alias("pair"), F.concat_ws(" ", "a", word(1), word(2)).alias("triple"))
    hits = hits.join(F.broadcast(pairs), "pair").join(F.broadcast(triples), "triple", "left")
    total = [F.sum(F.get("w2", F.lit(k)) + F.coalesce(F.get("w3", F.lit(k)), F.lit(0))).alias(f"s{k}") for k in range(len(model.classes))]
    found = hits.groupBy("doc_id", "row", "paragraph").agg(F.first("words").alias("words"), *total)
    logits = F.array(*((F.col(f"s{k}") / F.size("words") + float(b)) / MILLION for k, b in enumerate(model.bias.tolist())))
    return found.select("doc_id", "row", "paragraph", "words", logits.alias("logits"))


def scan(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, confirmed) of every paragraph that holds terms of use; paragraphs count from 0."""
    spark = docs.sparkSession
    model = model or Classifier(corpus_lines(docs))
    none = len(model.classes) - 1
    found = scores(docs, model)
    top = F.array_max("logits")
    share = F.transform("logits", lambda z: F.exp(z - top))
    found = found.withColumn("p", F.transform(share, lambda e: e / F.aggregate(share, F.lit(0.0), lambda acc, y: acc + y)))
    named = F.slice("p", 1, none - 1)  # without unknown and none
    best = F.array_max(named)
    names = F.array(*map(F.lit, model.classes))
    family = F.when(best >= LEAST_PROBABILITY, F.get(names, F.array_position(named, best).cast("int") - 1)).when(F.get("p", F.lit(none)) < 1 - LEAST_PROBABILITY, F.lit(UNKNOWN))
    found = found.withColumns({"family": family, "best": best, "none": F.get("p", F.lit(none))}).where("family is not null")
    probability = F.when(F.col("family") == UNKNOWN, 1 - F.col("none")).otherwise(F.col("best"))
    kept = found.select("doc_id", "row", "paragraph", "family", F.round(probability, 4).alias("probability"), _shingles(F.col("words")).alias("own"))
    texts = _templates(spark)
    held = F.array_max(F.transform("templates", lambda t: 100 * F.size(F.array_intersect(t, F.col("own"))) / F.size(t)))
    out = kept.join(F.broadcast(texts), "family", "left").withColumn("similarity", F.coalesce(F.floor(held).cast("int"), F.lit(0)))
    return out.select("doc_id", "paragraph", "family", "probability", "similarity", (F.col("similarity") >= LEAST_PERCENT).alias("confirmed"))


def _templates(spark: SparkSession) -> DataFrame:
    """(family, templates): the shingles of each template."""
    texts = spark.createDataFrame([(f, plain_words(t)) for f, of in TEMPLATES.items() for t in of], "family string, words array<string>")
    return texts.select("family", _shingles(F.col("words")).alias("template")).groupBy("family").agg(F.collect_list("template").alias("templates"))


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once and not for each element that a lambda sees."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _likelihoods(logits: Column) -> Column:
    share = _bound(logits, lambda z: _bound(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top))))
    return _bound(share, lambda s: _bound(F.aggregate(s, F.lit(0.0), lambda acc, e: acc + e), lambda total: F.transform(s, lambda e: e / total)))


def _verdict(likely: Column, classes: list[str]) -> Column:
    """struct<family, probability>, or null."""
    none, names = F.get(likely, F.lit(len(classes) - 1)), F.array(*map(F.lit, classes))
    named = lambda best: F.struct(F.get(names, F.array_position(likely, best).cast("int") - 1).alias("family"), F.round(best, 4).alias("probability"))
    other = F.struct(F.lit(UNKNOWN).alias("family"), F.round(1 - none, 4).alias("probability"))
    of = lambda best: F.when(best >= LEAST_PROBABILITY, named(best)).when(none < 1 - LEAST_PROBABILITY, other)
    return _bound(F.array_max(F.slice(likely, 1, len(classes) - 2)), of)  # without unknown and none


def windows(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, row, p, line, size, sums, near): the windows from word p of a text on; near: the known places (p, h, line) up to a template's length from p."""
    lines = F.transform(F.split(F.col("text").cast("string"), "\n"), lambda x, i: F.transform(words_of(x), lambda w: F.struct(w.alias("w"), i.alias("line"))))
    whole = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.flatten(lines).alias("words"))
    at = whole.select("doc_id", "row", F.col("words.w").alias("words"), F.col("words.line").alias("lines")).select("*", F.posexplode("words").alias("p", "a"))
    word = lambda k: F.get("words", F.col("p") + k)
    of = model.table(docs.sparkSession)  # as many rows as the templates have n-grams
    pairs = of.where("n = 2").select(F.col("gram").alias("pair"), F.col("w").alias("w2"))
    triples = of.where("n = 3").select(F.col("gram").alias("triple"), F.col("w").alias("w3"))
    hits = at.withColumn("pair", F.concat_ws(" ", "a", word(1))).join(F.broadcast(pairs), "pair")
    hits = hits.withColumn("triple", F.concat_ws(" ", "pair", word(2))).join(F.broadcast(triples), "triple", "left")
    w = F.when(F.col("w3").isNull(), F.col("w2")).otherwise(F.zip_with("w2", "w3", lambda x, y: x + y))
    hits = hits.select("doc_id", "row", "p", F.get("lines", "p").alias("line"), (F.size("words") - F.col("p")).alias("left"), F.xxhash64(F.slice("words", F.col("p") + 1, WIDTH)).alias("h"), w.alias("w"))

    by_place = Window.partitionBy("row").orderBy("p")
    until = by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    longest = max(len(plain_words(t)) for of in TEMPLATES.values() for t in of)
    near = F.collect_list(F.struct("p", "h", "line")).over(by_place.rangeBetween(0, longest))
    hits = hits.select("*", F.array(*(F.sum(F.get("w", F.lit(k))).over(until) for k in range(len(model.classes)))).alias("upto"), near.alias("near"))
    ends = [F.struct(F.least(F.lit(n), "left").alias("size"), F.last("upto").over(by_place.rangeBetween(0, n - 2)).alias("end")) for n in SIZES]
    hits = hits.withColumn("ends", F.array(*ends)).select("*", F.explode("ends").alias("e"))
    sums = F.transform("e.end", lambda x, k: x - F.get("upto", k) + F.get("w", k))
    return hits.select("doc_id", "row", "p", "line", "e.size", sums.alias("sums"), "near")


def scan_passages(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """The columns of scan, for the notices anywhere in a text; a row for each family that a paragraph holds."""
    model = model or Classifier(corpus_lines(docs))
    found = windows(docs, model)
    bias = F.array(*map(F.lit, model.bias.tolist()))
    logits = F.transform("sums", lambda x, k: (x / F.col("size") + F.get(bias, k)) / MILLION)
    found = found.withColumn("verdict", _bound(_likelihoods(logits), lambda p: _verdict(p, model.classes))).where("verdict is not null")
    found = found.select("*", "verdict.*").join(F.broadcast(_templates(docs.sparkSession)), "family", "left")
    held = F.array_max(F.transform("templates", lambda t: 100 * F.size(F.array_intersect(t, F.col("near.h"))) / F.size(t)))
    places = F.filter("near", lambda x: F.coalesce(F.array_contains(F.flatten("templates"), x["h"]), F.lit(False)))
    found = found.select("doc_id", "row", "p", "line", "size", "family", "probability", F.coalesce(F.floor(held).cast("int"), F.lit(0)).alias("similarity"), places.alias("places"))
    first, last = F.get("places", F.lit(0)), F.get("places", F.size("places") - 1)
    end = F.greatest(F.col("p") + F.col("size"), last["p"] + WIDTH)
    rank = F.struct("similarity", "probability", "p", F.col("size").alias("size"), end.alias("end"), "family", F.coalesce(first["line"], "line").alias("paragraph"))
    one = found.groupBy("doc_id", "row", "p").agg(F.max(rank).alias("r"))
    # No window is longer than this.
    reach = 2 * max(*SIZES, *(len(plain_words(t)) for of in TEMPLATES.values() for t in of)) + WIDTH
    around = F.collect_list("r").over(Window.partitionBy("row").orderBy("p").rangeBetween(-reach, reach))
    beaten = F.exists("around", lambda x: (x > F.col("r")) & (x["p"] < F.col("r.end")) & (x["end"] > F.col("r.p")))
    stay = one.withColumn("around", around).where(~beaten)
    out = stay.groupBy("doc_id", "row", F.col("r.paragraph").alias("paragraph"), F.col("r.family").alias("family")).agg(F.max("r").alias("r"))
    return out.select("doc_id", "paragraph", "family", "r.probability", "r.similarity", (F.col("r.similarity") >= LEAST_PERCENT).alias("confirmed"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of use in every document."""
    return scan_passages(table(spark, sf_dir, "documents"))
