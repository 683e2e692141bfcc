"""License scans: a trained paragraph classifier with template confirmation.

A paragraph is a run of lines with a word.  Each of its lines, and each window of its lines as a
wrapped header fills them, is judged.  A multinomial logistic regression over sparse word n-grams
(single words and pairs) gives each licence family a probability beside the classes of other
licences and of ordinary text; what is no ordinary text and whose best family stays under a
threshold is unknown, and a family counts only if enough of its template's word pairs are there.
Probabilities and thresholds are calibrated on labelled rows held out of the fit.  Fitting is MLlib's
LogisticRegression on template sentences and a bounded sample of corpus paragraphs; scanning joins
n-grams with the weight table, whose size the templates fix.  An n-gram is a 64-bit name, a hash of
its words' hashes, from the start; one that no template has carries no weight.  No Python runs on the
executors.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_filter, opaque, text_of, written

#: How texts say under which licence they stand.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "cc": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "isc": (
        "ISC License",
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Licensed under the MIT License.",
        "The MIT License (MIT)",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "reserved": ("All rights reserved.", "Copyright. All rights reserved."),
}
#: How licences of no family above speak.
OTHERS = (
    "Everyone may use this software for any purpose, as long as its origin is named and this permission stays with it.",
    "This software is provided as is, without any express or implied warranty of any kind.",
    "Permission is granted to anyone to use this software for any purpose, and to alter it and redistribute it freely.",
    "This work is distributed under the terms and conditions of the following license agreement.",
    "You may copy, modify, publish, sublicense or sell copies under the terms of this license.",
    "The accompanying materials are made available under the terms of the Public License which accompanies this distribution.",
    "Subject to the terms and conditions of this license, each contributor grants you a royalty-free copyright license.",
    "The copyright holder and contributors are not liable for any claim, damages or other liability arising from the use.",
    "Licensed under the terms of this license.",
    "Released under a license of its own.",
)
NONE, UNKNOWN = "none", "unknown"
#: Bound on the corpus paragraphs used as ordinary text when fitting.
MAX_ORDINARY = 2_000
#: Least share of a template's word pairs found in the paragraph.
MIN_COVERAGE = 0.6
#: One in so many ordinary paragraphs is held out; least share of held-out families that must be right,
#: and of held-out ordinary text that must not look like a licence.
HELD_OUT, RIGHT = 4, 0.99
#: Lines of a window, and from one window to the next: a header on up to five lines stands in one window.
WINDOW, STEP = 8, 4
WORD = r"[^\p{L}\p{N}.\-]+"


def paragraph_words(line: Column) -> Column:
    words = F.transform(F.split(F.lower(line), WORD), lambda w: F.rtrim(w, F.lit(".-")))
    return F.array_remove(words, "")


def named(words: Column) -> Column:
    """Of each word its hash, and whether it stands as an n-gram of its own."""
    return F.transform(words, lambda w: F.struct(F.xxhash64(w).alias("h"), (F.length(w) > 3).alias("own")))


def with_grams(rows: DataFrame, keep=None) -> DataFrame:
    """Adds x, the named words of line, and grams: names of single words of more than three letters and of all pairs of neighbours, distinct.

    With ``keep``, a test on names, only those it lets through.
    """
    rows = rows.withColumn("x", named(paragraph_words(F.col("line"))))
    keep = keep or (lambda h: F.lit(True))
    single = F.transform(F.filter("x", lambda v: v["own"] & keep(v["h"])), lambda v: v["h"])
    pairs = F.transform(F.slice("x", 1, F.greatest(F.size("x") - 1, F.lit(0))), lambda v, i: F.xxhash64(v["h"], F.get("x", i + 1)["h"]))
    return rows.withColumn("grams", F.array_distinct(F.concat(single, F.filter(pairs, keep))))


def template_rows(spark) -> DataFrame:
    rows = [(f, i, t) for f, ts in sorted({**TEMPLATES, UNKNOWN: OTHERS}.items()) for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "family string, variant int, line string").coalesce(1)


def runs(text: Column) -> Column:
    """Runs of lines between blank lines; one without a word is no paragraph."""
    return F.split(text, "\n[\\t-\\r ]*\n")


def paragraph_lines(docs: DataFrame) -> DataFrame:
    """doc_id, key, run, at, n (lines of the run), line, next (the line after it in the run): the lines with a word."""
    text = text_of()
    each = docs.select("doc_id", F.xxhash64(text).alias("key"), F.posexplode_outer(runs(text)).alias("run", "_run")).withColumn("_lines", F.split("_run", "\n"))
    rows = each.select("doc_id", "key", "run", F.size("_lines").alias("n"), "_lines", F.posexplode_outer("_lines").alias("at", "line"))
    return rows.where(F.col("line").rlike("[^\\t-\\r ]")).withColumn("next", F.get("_lines", F.col("at") + 1)).drop("_lines")


def calibrated(held: list[tuple[str, list[float]]], names: list[str]) -> tuple[float, float, float]:
    """Temperature of least log loss on held-out (class, logits); least probability of a family, and of any licence."""

    def chances(logits, heat):
        top = max(logits)
        e = [math.exp((x - top) / heat) for x in logits]
        return [x / sum(e) for x in e]

    loss = lambda heat: -sum(math.log(max(chances(x, heat)[names.index(c)], 1e-12)) for c, x in held)
    heat = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 4.0), key=lambda h: (loss(h), h))
    scored = [(c, chances(x, heat)) for c, x in held]
    # families from the most probable down, as long as enough of them are right
    best = sorted(((max(zip(p[2:], names[2:], strict=True)), c) for c, p in scored if max(p[2:]) >= 0.5), key=lambda b: -b[0][0])
    family, right = 1.0 if best else 0.5, 0
    for k, ((p, name), c) in enumerate(best, 1):
        right += name == c
        if right >= RIGHT * k:
            family = p
    plain = sorted(1 - p[0] for c, p in scored if c == NONE)
    licence = max([0.5, *plain[: math.ceil(RIGHT * len(plain))]])
    return heat, family, licence


def fit(docs: DataFrame, max_ordinary: int = MAX_ORDINARY) -> tuple[DataFrame, dict[str, float], tuple[float, float]]:
    """Weights (gram, weights by class), intercepts, and the least probabilities of a family and of any licence.

    Ordinary text is the ``max_ordinary`` least lines by hash that share no three n-grams with
    a template, nor more than half of their own, alone and several together.  Each template also appears with words around it, so the
    fit sees longer paragraphs.  Held out for calibration are a part of the ordinary lines and the
    first and last two thirds of the words of each template.
    """
    spark = docs.sparkSession
    every = template_rows(spark)
    known = with_grams(every).select("family", "grams")
    vocabulary = F.array(*[F.lit(g).cast("long") for g in sorted({g for r in known.where(F.col("family") != UNKNOWN).collect() for g in r["grams"]})])
    # the least hashes first, 8 bytes a line; only the chosen lines move as text
    least = paragraph_lines(docs).select(F.xxhash64("line").alias("h")).distinct().orderBy("h").limit(max_ordinary)
    ordinary = paragraph_lines(docs).select("line", F.xxhash64("line").alias("h")).join(F.broadcast(least), "h").dropDuplicates(["h"])
    ordinary = opaque(with_grams(ordinary).select("h", F.lit(NONE).alias("family"), "grams", F.size(F.array_intersect("grams", vocabulary)).alias("shared"))).where("shared < 3 and 2 * shared <= size(grams)").drop("shared").cache()
    held = F.pmod("h", F.lit(HELD_OUT)) == 0
    together = lambda rows: rows.groupBy("family", F.pmod("h", F.lit(max(1, max_ordinary // WINDOW))).alias("_g")).agg(F.array_distinct(F.flatten(F.collect_list("grams"))).alias("grams")).drop("_g")
    plain = ordinary.where(~held)
    padded = known.select("family", F.concat("grams", F.array(*[F.xxhash64(F.lit(w)) for w in ("ordinary", "words", "beside")])).alias("grams"))
    text = F.transform("grams", lambda g: g.cast("string")).alias("grams")
    train = known.union(padded).union(plain.drop("h")).union(together(plain)).select("family", text)
    names = [NONE, UNKNOWN, *sorted(TEMPLATES)]
    label = F.coalesce(*[F.when(F.col("family") == n, F.lit(float(i))) for i, n in enumerate(names)])
    words = CountVectorizer(inputCol="grams", outputCol="features", minDF=1.0, vocabSize=20_000, binary=True).fit(known.select("family", text))
    rows = words.transform(train.withColumn("label", label).withColumn("weight", F.when(F.col("family") == NONE, 1.0).otherwise(20.0))).select("label", "weight", "features").coalesce(1).cache()
    model = LogisticRegression(family="multinomial", weightCol="weight", regParam=0.002, maxIter=60).fit(rows)
    rows.unpersist()
    matrix, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    place = {int(g): j for j, g in enumerate(words.vocabulary)}
    cut = F.split("line", " ")
    part = F.greatest(F.lit(2), F.ceil(F.size(cut) * 2 / 3).cast("int"))
    parts = every.select("family", F.explode_outer(F.array(F.slice(cut, 1, part), F.slice(cut, F.greatest(F.lit(1), F.size(cut) - part + 1), part))).alias("_p")).select("family", F.array_join("_p", " ").alias("line"))
    apart = ordinary.where(held)
    rows = with_grams(parts).select("family", "grams").union(apart.drop("h")).union(together(apart)).collect()
    ordinary.unpersist()
    logits = [(r["family"], [float(bias[k]) + sum(float(matrix[k, place[g]]) for g in set(r["grams"]) if g in place) for k in range(len(names))]) for r in rows]
    heat, family, licence = calibrated(logits, names)
    table = [(g, [round(float(matrix[k, j]) / heat, 6) for k in range(len(names))]) for g, j in place.items()]
    return spark.createDataFrame(table, "gram long, w array<double>").coalesce(1), {n: round(float(b) / heat, 6) for n, b in zip(names, bias, strict=True)}, (family, licence)


def license_scan(docs: DataFrame, min_probability: float | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per row of ``docs``: n_paragraphs, n_licensed, n_unconfirmed, n_unknown, families (sorted).

    n_licensed counts paragraphs of a confirmed family, n_unconfirmed others of a probable family that no
    template confirms, n_unknown others that are licences of no probable family.  ``min_probability``
    of a family is the calibrated one unless given.  Null or empty text has no paragraph; rows that
    repeat a doc_id, or have none, each get their row; other columns are not read; an empty table gives
    none.  A text of any length is cut into lines and runs; what is gathered for a run are its n-grams
    that templates have, so at most the weight table for each of its lines.
    """
    spark = docs.sparkSession
    weights, bias, (family, licence) = fit(docs)
    least = family if min_probability is None else min_probability
    names = list(bias)
    pairs = with_grams(template_rows(spark).where(F.col("family") != UNKNOWN)).select("family", "variant", F.size("grams").alias("need"), F.explode_outer("grams").alias("gram"))
    # no unit can pass whose n-grams, each at its best against ordinary text, leave that ahead
    best_gain = F.array_max(F.transform(F.slice("w", 2, len(names) - 1), lambda v: v - F.get("w", 0)))
    gains = weights.select("gram", F.greatest(best_gain, F.lit(0.0)).alias("gain"))
    ahead = max(bias[n] for n in names[1:]) - bias[NONE]
    enough = -ahead - math.log(len(names) - 1) + math.log(0.5) - 1e-6  # thresholds are 0.5 at least
    if min(least, licence) < 0.5:
        enough = -math.inf
    maybe = hash_filter(weights.select(F.col("gram").alias("h")), 1024)
    # the pair across a line's end belongs to windows only
    first = F.rtrim(F.get(F.array_remove(F.split(F.lower("next"), WORD, 3), ""), 0), F.lit(".-"))
    rows = with_grams(paragraph_lines(docs), maybe).withColumn("over", F.xxhash64(F.try_element_at("x", F.lit(-1))["h"], F.xxhash64(first)))
    gram = lambda g, cross: F.struct(g.alias("gram"), F.lit(cross).alias("cross"))
    over = F.filter(F.array(F.when(first.isNotNull() & (F.size("x") > 0), F.col("over"))), lambda g: g.isNotNull() & maybe(g))
    grams = F.concat(F.transform("grams", lambda g: gram(g, False)), F.transform(over, lambda g: gram(g, True)))
    # outer: a test for empty arrays, pushed below, would compute the n-grams twice
    each = rows.select("doc_id", "key", "run", "at", "n", F.explode_outer(grams).alias("g")).select("doc_id", "key", "run", "at", "n", "g.*")
    met = each.join(F.broadcast(weights.select("gram")), "gram", "left_semi").repartition("doc_id", "key", "run")
    # a line is unit at, window w (lines from STEP * w) is unit -1 - w; a run of one line has no window
    none = F.array().cast("array<int>")
    w = F.floor(F.col("at") / STEP).cast("int")
    windows = F.when(F.col("n") > 1, F.filter(F.array(*[-1 - w + k for k in range(WINDOW // STEP)]), lambda u: u < 0)).otherwise(none)
    units = F.concat(F.when(F.col("cross"), none).otherwise(F.array("at")), windows)
    met = met.select("doc_id", "key", "run", F.explode_outer(units).alias("unit"), "gram").where("unit is not null").distinct()
    unit_of = ["doc_id", "key", "run", "unit"]
    open_ = met.join(F.broadcast(gains), "gram").withColumn("most", F.sum("gain").over(Window.partitionBy(*unit_of))).where(F.col("most") >= enough).select(*unit_of, "gram")
    sums = [F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(len(names))]
    unit = open_.join(F.broadcast(weights), "gram").groupBy(*unit_of).agg(*sums, F.collect_list("gram").alias("grams"))
    unit = unit.withColumn("logits", F.array(*[F.col(f"s{i}") + F.lit(bias[n]) for i, n in enumerate(names)])).drop(*[f"s{i}" for i in range(len(names))])
    unit = unit.withColumn("e", F.transform("logits", lambda x: F.exp(x - F.array_max("logits")))).withColumn("total", F.aggregate("e", F.lit(0.0), lambda acc, x: acc + x))
    families = F.array(*map(F.lit, names))
    best = F.array_max(F.transform(F.slice("e", 3, len(names) - 2), lambda x, i: F.struct((x / F.col("total")).alias("p"), F.get(families, i + 2).alias("family"))))
    unit = unit.withColumn("best", best).withColumn("licence", 1 - F.get("e", 0) / F.col("total")).where((F.col("best.p") >= least) | (F.col("licence") > licence))
    probable = F.col("best.p") >= least
    # few rows, read twice below
    unit = written(unit.select(*unit_of, F.col("best.family").alias("family"), probable.alias("probable"), "grams"), "license-units")
    # how much of each template of its family a probable unit has
    cover = unit.where("probable").select(*unit_of, "family", F.explode("grams").alias("gram")).join(F.broadcast(pairs), ["family", "gram"])
    cover = cover.groupBy(*unit_of, "variant", "need").agg(F.count("*").alias("have")).groupBy(*unit_of).agg(F.max(F.col("have") / F.col("need")).alias("cover"))
    # null-safe: rows without a doc_id have units too
    unit, cover = unit.drop("grams"), cover.withColumnsRenamed({c: f"_{c}" for c in unit_of})
    unit = unit.join(cover, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("key") == F.col("_key")) & (F.col("run") == F.col("_run")) & (F.col("unit") == F.col("_unit")), "left")
    unit = unit.select("doc_id", "key", "run", "family", "probable", (F.col("probable") & (F.coalesce("cover", F.lit(0.0)) >= min_coverage)).alias("sure"))
    part = unit.groupBy("doc_id", "key", "run").agg(F.bool_or("sure").alias("sure"), F.bool_or("probable").alias("probable"), F.collect_set(F.when(F.col("sure"), F.col("family"))).alias("f"))
    found = part.groupBy("doc_id", "key").agg(F.count_if("sure").alias("yes"), F.count_if(~F.col("sure") & F.col("probable")).alias("no"), F.count_if(~F.col("probable")).alias("other"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("f")))).alias("f"))
    found = found.withColumnsRenamed({"doc_id": "_id", "key": "_k"})
    text = text_of()
    rows = docs.select("doc_id", F.xxhash64(text).alias("key"), F.size(F.filter(runs(text), lambda x: x.rlike("[^\\t-\\r ]"))).cast("long").alias("n_paragraphs"))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_k")), "left")
    count = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return out.select("doc_id", "n_paragraphs", count("yes", "n_licensed"), count("no", "n_unconfirmed"), count("other", "n_unknown"), F.coalesce("f", F.array().cast("array<string>")).alias("families"))
