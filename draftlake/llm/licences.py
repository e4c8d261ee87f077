"""Licence scans by a trained paragraph classifier (operator 2).

Training is a small job of spark.ml on a bounded sample; scanning is DataFrame functions only.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from draftlake.llm.common import read, text_or_empty

#: Documents that the class of other paragraphs is learned from: those of smallest hash.
SAMPLE = 2_000
#: Made variants of each template and of each sentence that only resembles one.
VARIANTS = 30
MOST_GRAMS = 4_096
SURE, ALIKE = 0.5, 0.6
#: Words of a window, half of which it shares with the next: more than any template has.
SPAN = 64
OTHER = "other"

# Usual notices of each licence family.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Released under the GNU GPL version 3 or later.",
    ),
    "lgpl-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ),
    "agpl-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "mpl-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
    ),
}
# Sentences that share words with notices but name no family.
LOOKALIKES = (
    "All rights reserved.",
    "Licensed under a commercial agreement with the vendor.",
    "The driver must hold a valid license at all times.",
    "The software is provided to the public by the general office.",
    "Released under embargo until the version is final.",
    "You may not use this file.",
    "Permission was granted to use the work of the library.",
    "This work is part of a free public program.",
    "The terms of the agreement are in the second version.",
)
WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"


def grams(words: list[str]) -> list[str]:
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))})


def words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    bias: tuple[float, ...]
    weights: dict[str, tuple[float, ...]]

    def chances(self, text: str) -> dict[str, float]:
        z = np.array(self.bias) + sum((np.array(self.weights[g]) for g in grams(words(text)) if g in self.weights), np.zeros(len(self.bias)))
        p = np.exp(z - z.max())
        return dict(zip(self.families, p / p.sum(), strict=True))


def sample_paragraphs(docs: DataFrame, text: str = "text", most: int = SAMPLE) -> list[str]:
    """One paragraph of each of ``most`` documents at most, without any that speaks of licences."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: (F.length(x) > 0) & (F.length(x) < 2_000) & ~F.contains(F.lower(x), F.lit("licen")))
    one = docs.select(F.xxhash64(text).alias("h"), lines.alias("lines")).where(F.size("lines") > 0)
    one = one.select("h", F.get("lines", F.pmod("h", F.size("lines")).cast("int")).alias("x"))
    return [r["x"] for r in one.distinct().orderBy("h", "x").limit(most).collect()]


def examples(others: list[str], templates=TEMPLATES, variants: int = VARIANTS) -> list[tuple[str, list[str]]]:
    """(family, words): templates and lookalikes, whole, with words left out, and among others."""
    r = random.Random(7)
    filler = [w for x in others for w in words(x)] or ["a"]
    out = [(OTHER, words(x)) for x in others]
    for family, texts in [*templates.items(), (OTHER, LOOKALIKES)]:
        for t in texts:
            w = words(t)
            for i in range(variants):
                kept = [x for x in w if i < 3 or r.random() > 0.08] or w
                extra = [[r.choice(filler) for _ in range(r.randint(0, 8) if i % 2 else 0)] for _ in range(2)]
                out.append((family, extra[0] + kept + extra[1]))
    r.shuffle(out)
    return out


def train(spark: SparkSession, others: list[str], templates=TEMPLATES) -> Model:
    """Multinomial logistic regression over word 1- and 2-grams, tempered on a third held back."""
    rows = examples(others, templates)
    families = (*sorted(templates), OTHER)
    seen, common = {}, {}
    for family, w in rows:
        for g in grams(w):
            side = common if family == OTHER else seen
            side[g] = side.get(g, 0) + 1
    # N-grams of notices that other paragraphs seldom hold.
    own = {g for texts in templates.values() for t in texts for g in grams(words(t))}
    chosen = sorted(own, key=lambda g: (-seen.get(g, 0), g))
    rare = max(3, len(others) // 200) + VARIANTS
    vocabulary = {g: i for i, g in enumerate([g for g in chosen if common.get(g, 0) <= rare][:MOST_GRAMS])}
    data = [(float(families.index(f)), sorted(vocabulary[g] for g in grams(w) if g in vocabulary)) for f, w in rows]
    size = len(vocabulary)
    build = [(y, SparseVector(size, x, [1.0] * len(x))) for i, (y, x) in enumerate(data) if i % 3]
    fit = LogisticRegression(maxIter=60, regParam=0.003, family="multinomial", aggregationDepth=2)
    model = fit.fit(spark.createDataFrame(build, ["label", "features"]).coalesce(1))
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    held = [(int(y), x) for i, (y, x) in enumerate(data) if not i % 3]
    z = np.array([b + w[:, x].sum(axis=1) for _, x in held])

    def loss(t: float) -> float:
        s = z * t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), [y for y, _ in held]]))

    t = min((0.3, 0.5, 0.75, 1.0, 1.5, 2.0), key=loss)
    return Model(families, tuple(map(float, b * t)), {g: tuple(map(float, w[:, i] * t)) for g, i in vocabulary.items()})


def scan(docs: DataFrame, model: Model, templates=TEMPLATES, text: str = "text", key: str = "doc_id", sure: float = SURE, alike: float = ALIKE) -> DataFrame:
    """Licence paragraphs: (key, paragraph, family, probability, similarity), one row for each.

    Lines are scored, numbered from 0, and windows of ``SPAN`` words over the whole text, for notices
    wrapped over lines or within long ones. N-grams that the model knows (at most ``MOST_GRAMS``,
    sent to all tasks) are looked up and summed by line and window. A family counts if a template of
    it shares ``alike`` or more of the template's known n-grams, also of those that no closer
    family's template explains, and if its probability is ``sure`` or more, families that count
    besides it left aside. A window's family gives a row only where none of its lines has that
    family; windows in a row are one, named by the line where the notice begins. Null and empty
    texts have no paragraphs; the whole of a long text is read; repeated rows each give their rows;
    null keys are kept; other columns are not looked at.
    """
    spark = docs.sparkSession
    n = len(model.families)
    table = spark.createDataFrame([(g, list(w)) for g, w in model.weights.items()], "gram string, weights array<double>")
    known = {f: [x for t in texts if (x := [g for g in grams(words(t)) if g in model.weights])] for f, texts in templates.items()}
    table_of = spark.createDataFrame([(f, model.families.index(f), lists) for f, lists in known.items()], "family string, at int, templates array<array<string>>")
    fewest = min((alike * len(x) for lists in known.values() for x in lists), default=0)

    split = F.transform(F.split(text_or_empty(text), "\n"), lambda x: F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0)))
    each = docs.select(F.col(key).alias("k"), F.monotonically_increasing_id().alias("row"), split.alias("lines"))
    line = F.flatten(F.transform("lines", lambda x, i: F.array_repeat(i, F.size(x))))
    each = each.select("k", "row", F.flatten("lines").alias("w"), line.alias("line")).where(F.size("w") > 0)
    each = each.withColumns({"next": F.slice("w", 2, F.size("w")), "next_line": F.slice("line", 2, F.size("w"))})
    each = each.select("k", "row", F.posexplode(F.arrays_zip("w", "next", "line", "next_line")).alias("pos", "x")).select("k", "row", "pos", "x.*")
    one = F.struct(F.col("w").alias("gram"), F.lit(True).alias("inside"))
    two = F.struct(F.concat("w", F.lit(" "), "next").alias("gram"), (F.col("line") == F.col("next_line")).alias("inside"))
    each = each.select("k", "row", "pos", "line", F.explode(F.array(one, two)).alias("x")).select("k", "row", "pos", "line", "x.*")
    hits = each.join(F.broadcast(table), "gram")

    half = F.floor(F.col("pos") / (SPAN // 2)).cast("int")
    unit = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("unit"))
    units = F.array_compact(F.array(F.when(F.col("inside"), unit(0, F.col("line"))), unit(1, half), F.when(half > 0, unit(1, half - 1))))
    hits = hits.select("k", "row", "gram", "weights", "line", F.explode(units).alias("u")).select("k", "row", "u.*", "gram", "weights", "line")
    by = ["k", "row", "kind", "unit"]
    once = hits.groupBy(*by, "gram").agg(F.first("weights").alias("w"), F.min("line").alias("low"), F.max("line").alias("high"))
    sums = [F.sum(F.get("w", F.lit(i))).alias(f"z{i}") for i in range(n)]
    found = once.groupBy(*by).agg(*sums, F.collect_list(F.struct("gram", "low")).alias("places"), F.min("low").alias("low"), F.max("high").alias("high"))
    z = F.array(*(F.col(f"z{i}") + F.lit(model.bias[i]) for i in range(n)))
    found = found.where(F.size("places") >= fewest - 1e-9).select(*by, "places", "low", "high", z.alias("z"), F.col("places.gram").alias("have"))

    found = found.crossJoin(F.broadcast(table_of))
    best = F.array_max(F.transform("templates", lambda t: F.struct((F.size(F.array_intersect(t, F.col("have"))) / F.size(t)).alias("share"), t.alias("t"))))
    found = found.withColumn("best", best).where(F.col("best.share") >= alike).withColumn("own_z", F.get("z", F.col("at")))
    closer = Window.partitionBy("row", "kind", "unit").orderBy(F.desc("best.share"), F.desc("own_z"), "family").rowsBetween(Window.unboundedPreceding, -1)
    own = F.array_except("best.t", F.flatten(F.collect_list("best.t").over(closer)))
    found = found.withColumn("own", own).where((F.size("own") > 0) & (F.size(F.array_intersect("own", "have")) >= alike * F.size("own")))
    found = found.withColumn("beside", F.collect_list("at").over(Window.partitionBy("row", "kind", "unit")))
    rest = F.transform("z", lambda x, i: F.when(F.array_contains("beside", i), 0.0).otherwise(F.exp(x - F.col("own_z"))))
    found = found.withColumn("probability", 1 / (1 + F.aggregate(rest, F.lit(0.0), lambda a, x: a + x))).where(F.col("probability") >= sure)
    begins = F.array_min(F.transform(F.filter("places", lambda x: F.array_contains("best.t", x["gram"])), lambda x: x["low"]))
    found = found.select(*by, "family", "low", "high", begins.alias("begins"), F.struct(F.col("best.share").alias("similarity"), "probability").alias("s"))

    notices = Window.partitionBy("row", "family")
    found = found.withColumn("named", F.collect_list(F.when(F.col("kind") == 0, F.col("unit"))).over(notices))
    named = F.exists("named", lambda x: (x >= F.col("low")) & (x <= F.col("high")))
    found = found.where((F.col("kind") == 0) | ~named)
    turn = Window.partitionBy("row", "family", "kind").orderBy("unit")
    fresh = F.coalesce(F.col("unit") - F.lag("unit").over(turn) > 1, F.lit(False)) | (F.col("kind") == 0)
    found = found.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(turn))
    paragraph = F.when(F.col("kind") == 0, F.col("unit")).otherwise(F.col("begins"))
    found = found.groupBy("k", "row", "family", "kind", "run").agg(F.min(paragraph).alias("paragraph"), F.max("s").alias("s"))
    # Two notices of a family that begin in one long line are one row.
    found = found.groupBy("k", "row", "family", "paragraph").agg(F.max("s").alias("s"))
    return found.select(F.col("k").alias(key), "paragraph", "family", "s.probability", "s.similarity")


def op2_licences(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, train(spark, sample_paragraphs(docs)))
