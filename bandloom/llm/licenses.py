"""Licence scan: a trained paragraph classifier confirmed by templates, natively.

A paragraph is a block of lines between lines without a letter or digit. It is scored with its
lines joined, as notices are wrapped, and each of its lines besides, as lists of notices are
not. A multinomial logistic regression over word n-grams is fitted with Spark ML on notices of each licence family, their shortened variants, and
paragraphs that are no notices. A second, one-dimensional regression turns the
margin over the unknown class into a calibrated probability of being a notice at
all. A family counts only if a template of it confirms it by shared n-grams.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.llm.positions import KEY_BITS, order_key
from bandloom.llm.words import bind
from bandloom.session import cut_lineage

UNKNOWN = "unknown"
ORDERS = (1, 2, 3)
ANCHOR_LETTERS = 5
# Bound on the corpus paragraphs that the unknown class is fitted on.
UNKNOWN_ROWS = 2000
# Corpus text that shares this many of the longest n-grams with notices may be one, so it does not stand for the unknown class.
DOUBTFUL_GRAMS = 3
MIN_PROBABILITY = 0.5
MIN_SHARED = 0.6

# Public short notices by family, lower-cased words when compared.
NOTICES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc0": (
        "Dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Released under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
}
# Lines that use words of notices without being one.
NOT_NOTICES: tuple[str, ...] = (
    "You need a driving license to rent a car.",
    "The public library is free for children under twelve.",
    "The general told the public that the software was late.",
    "Permission to build the bridge was granted last year.",
    "The conditions of the work are described in the following chapter.",
    "Our software version 2.0 was released under pressure.",
    "The source of the river is subject to change without notice.",
    "This document describes the terms of the contract between the parties.",
    "The institute of technology published the international version.",
    "She obtained a copy of the file from the author.",
    "All conditions must be met before the program is used.",
    "A creative person may modify the form for any purpose.",
)


def paragraph_words(line: Column) -> Column:
    """Lower-case words of a paragraph, without punctuation around and inside them."""
    plain = F.trim(F.regexp_replace(F.lower(line), "[^\\p{L}\\p{N}.+-]+|[.+-]+(?=\\s|$)|(?<=\\s)[.+-]+", " "))
    return F.filter(F.split(plain, " +", -1), lambda w: w != "")


def blocks(text: Column) -> Column:
    """The paragraphs of a text with their line ends; those without a letter or digit are left out."""
    parts = F.split(F.coalesce(text.cast("string"), F.lit("")), "\n[^\\p{L}\\p{N}\n]*(?=\n)", -1)
    return F.filter(parts, lambda b: b.rlike("[\\p{L}\\p{N}]"))


def units(docs: DataFrame, text_col: str) -> DataFrame:
    """(the columns of `docs`, paragraph, at, line): every line of a paragraph, and as line -1 the whole paragraph if it has several."""
    each = docs.select(*docs.columns, F.posexplode(blocks(F.col(text_col))).alias("paragraph", "_block"))
    lines = F.filter(F.split("_block", "\n", -1), lambda x: x != "")
    listed = F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    whole = F.array(F.struct(F.lit(-1).alias("at"), F.col("_block").alias("line")))
    both = F.when(F.size(lines) > 1, F.concat(whole, listed)).otherwise(listed)
    return each.select(*docs.columns, "paragraph", F.explode(both).alias("_unit")).select(*docs.columns, "paragraph", "_unit.at", "_unit.line")


def grams(words: Column) -> Column:
    """Word n-grams of ORDERS, joined by spaces, repeats kept."""
    def order(held: Column, n: int) -> Column:
        places = F.sequence(F.lit(1), F.size(held) - n + 1)
        some = F.transform(places, lambda i: F.array_join(F.slice(held, i, F.lit(n)), " "))
        return F.when(F.size(held) >= n, some).otherwise(F.array().cast("array<string>"))

    return bind(words, lambda held: F.concat(*[order(held, n) for n in ORDERS]))


@dataclass
class LicenceModel:
    """Small tables of a fitted classifier: weights per n-gram, intercepts, calibration, anchors."""

    families: list[str]
    weights: DataFrame
    intercepts: list[float]
    scale: float
    shift: float
    anchors: list[str]


def _notices(spark: SparkSession) -> DataFrame:
    rows = [(family, at, text) for family, texts in NOTICES.items() for at, text in enumerate(texts)]
    return spark.createDataFrame(rows, "family string, template int, line string")


def _thinned(words: Column, n: int, at: int) -> Column:
    """The words without every n-th, counted from `at`."""
    return F.array_join(F.filter(words, lambda w, i: (i + at) % n != 0), " ")


def _variants(notices: DataFrame) -> DataFrame:
    """Each notice whole, without its first or last words, with words around it, and with every n-th word left out."""
    words = F.split("line", " ")
    size = F.size(words)
    forms = [
        F.col("line"),
        F.array_join(F.slice(words, 2, F.greatest(size - 1, F.lit(1))), " "),
        F.array_join(F.slice(words, 1, F.greatest(size - 1, F.lit(1))), " "),
        F.concat(F.lit("Copyright (c) 2020 The Authors. "), F.col("line")),
        F.concat(F.lit("Note: "), F.col("line"), F.lit(" All rights reserved.")),
        *[_thinned(words, n, at) for n, at in ((4, 1), (5, 2), (7, 3))],
    ]
    return notices.select("family", F.posexplode(F.array(*forms)).alias("variant", "line"))


def fit_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unknown_rows: int = UNKNOWN_ROWS, seed: str = "licence") -> LicenceModel:
    """Fit on the notices and on at most `unknown_rows` corpus paragraphs and lines, the documented bound.

    They are those of least digest of document, text and place among about `unknown_rows`
    documents. Only text without the stem "licen" that shares fewer than DOUBTFUL_GRAMS
    of the longest n-grams with notices stands for the unknown class. Every fourth row calibrates.
    """
    spark = docs.sparkSession
    notices = _notices(spark)
    count = docs.count()
    sampled = docs.filter(order_key(F.lit(seed), F.col(id_col)) < F.lit(int(min(1.0, unknown_rows / max(count, 1)) * (1 << KEY_BITS))))
    lines = units(sampled.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), "text")
    lines = lines.filter(~F.lower("line").contains("licen") & (F.length("line") > 20))
    long_grams = notices.select(F.explode(grams(paragraph_words(F.col("line")))).alias("gram")).filter(F.size(F.split("gram", " ")) == ORDERS[-1])
    known = F.array(*[F.lit(r.gram) for r in long_grams.distinct().orderBy("gram").collect()])
    lines = lines.filter(F.size(F.array_intersect(grams(paragraph_words(F.col("line"))), known)) < DOUBTFUL_GRAMS)
    place = order_key(F.lit(f"{seed}|unit"), F.col("doc"), F.xxhash64("text").cast("string"), F.col("paragraph"), F.col("at"))
    lines = lines.orderBy(place, "line").limit(unknown_rows).select("line")
    others = lines.unionByName(spark.createDataFrame([(x,) for x in NOT_NOTICES], "line string")).select(F.lit(UNKNOWN).alias("family"), "line")
    rows = _variants(notices).select("family", "line").unionByName(others)
    rows = rows.select("family", grams(paragraph_words(F.col("line"))).alias("grams"), F.pmod(F.xxhash64("line"), F.lit(4)).alias("fold"))
    rows = cut_lineage(rows, "notices").coalesce(2).cache()

    # The vocabulary comes from the notices, so its size is fixed: n-grams with a longer word.
    listed = notices.select(F.explode(grams(paragraph_words(F.col("line")))).alias("gram")).distinct().orderBy("gram").collect()
    vocabulary = [r.gram for r in listed if any(len(w) >= ANCHOR_LETTERS for w in r.gram.split(" "))]
    families = [*sorted(NOTICES), UNKNOWN]
    number = F.create_map(*[F.lit(x) for i, f in enumerate(families) for x in (f, float(i))])
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features")
    counter.setBinary(True)
    marked = counter.transform(rows.withColumn("label", number[F.col("family")]))
    model = LogisticRegression(regParam=0.003, elasticNetParam=0.0, maxIter=60, family="multinomial").fit(marked.filter("fold <> 3"))
    held = model.transform(marked).withColumn("raw", vector_to_array("rawPrediction"))
    held = held.select(_margin(F.col("raw")).alias("margin"), (F.col("family") != UNKNOWN).cast("double").alias("label"), "fold")
    platt = LogisticRegression(regParam=0.01, maxIter=30)
    from pyspark.ml.feature import VectorAssembler

    calibrated = platt.fit(VectorAssembler(inputCols=["margin"], outputCol="features").transform(held.filter("fold = 3")))
    rows.unpersist()
    matrix = model.coefficientMatrix.toArray()
    table = [(gram, [float(x) for x in matrix[:, i]]) for i, gram in enumerate(vocabulary)]
    weights = spark.createDataFrame(table, "gram string, weight array<double>")
    anchors = sorted({w for gram in vocabulary for w in gram.split(" ") if len(w) >= ANCHOR_LETTERS})
    return LicenceModel(families, weights, [float(x) for x in model.interceptVector], float(calibrated.coefficients[0]), float(calibrated.intercept), anchors)


def _margin(raw: Column) -> Column:
    """Best family's score above the unknown class, which is the last."""
    return F.array_max(F.slice(raw, 1, len(NOTICES))) - F.element_at(raw, -1)


def scan_licences(
    docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text",
    min_probability: float = MIN_PROBABILITY, min_shared: float = MIN_SHARED,
) -> DataFrame:
    """Rows (doc, key, paragraph, line, family, probability, shared) of what is taken for a notice.

    Every paragraph of every text is scored, whole (line null) and line by line; those
    without an anchor word of the vocabulary have no features and are unknown without further work. `shared` is
    the largest share of a template's n-grams found in the paragraph among templates
    of the predicted family; below `min_shared` the prediction is not confirmed and
    the paragraph stays unknown.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = units(docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("key"), text.alias("_text")), "_text")
    anchors = F.array(*[F.lit(a) for a in model.anchors])
    words = lines.select("doc", "key", "paragraph", "at", paragraph_words(F.col("line")).alias("words"))
    near = words.filter(F.arrays_overlap("words", anchors)).distinct()
    found = near.select("doc", "key", "paragraph", "at", F.explode(F.array_distinct(grams(F.col("words")))).alias("gram"))
    # Weights and template n-grams come from the fixed notices, a few hundred rows.
    shares = _notices(spark).select("family", "template", F.explode(F.array_distinct(grams(paragraph_words(F.col("line"))))).alias("gram"))
    templates = shares.groupBy("gram").agg(F.collect_list(F.struct("family", "template")).alias("of"))
    sizes = {(r.family, r.template): r["count"] for r in shares.groupBy("family", "template").count().collect()}
    table = model.weights.join(templates, "gram", "full")
    scored = found.join(F.broadcast(table), "gram")
    n = len(model.families)
    sums = [F.sum(F.coalesce(F.get("weight", F.lit(i)), F.lit(0.0))).alias(f"s{i}") for i in range(n)]
    hits = [F.sum(F.coalesce(F.array_contains("of", F.struct(F.lit(f).alias("family"), F.lit(t).alias("template"))), F.lit(False)).cast("int")).alias(f"h_{f}_{t}") for f, t in sizes]
    per = scored.groupBy("doc", "key", "paragraph", "at").agg(*sums, *hits)
    raw = F.array(*[F.col(f"s{i}") + F.lit(b) for i, b in enumerate(model.intercepts)])
    per = per.withColumn("raw", raw).withColumn("probability", 1 / (1 + F.exp(-(_margin(F.col("raw")) * model.scale + model.shift))))
    best = F.array_position(F.slice("raw", 1, n - 1), F.array_max(F.slice("raw", 1, n - 1))).cast("int")
    per = per.withColumn("family", F.get(F.array(*[F.lit(f) for f in model.families]), best - 1))
    shared = None
    for family in NOTICES:
        of = F.greatest(*[F.col(f"`h_{f}_{t}`") / F.lit(float(s)) for (f, t), s in sizes.items() if f == family], F.lit(0.0))
        shared = F.when(F.col("family") == family, of) if shared is None else shared.when(F.col("family") == family, of)
    per = per.withColumn("shared", shared).filter((F.col("probability") >= min_probability) & (F.col("shared") >= min_shared))
    line = F.when(F.col("at") >= 0, F.col("at"))
    return per.select("doc", "key", "paragraph", line.alias("line"), "family", "probability", "shared")


def document_licences(docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_paragraphs, n_notices, families (sorted), probability (of the surest notice).

    Null and empty texts have no paragraph, nor has text without a letter or digit. A notice
    is a family found in a paragraph, as a whole or in any of its lines.
    Documents without a notice have no families and a null probability. Rows that
    repeat id and text each get the same result; null ids are scanned like others.
    An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    count = F.size(blocks(text)).cast("bigint")
    every = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("key"), count.alias("n_paragraphs"))
    notes = scan_licences(docs, model, id_col, text_col).groupBy("doc", "key").agg(
        F.count_distinct("paragraph", "family").alias("n_notices"), F.sort_array(F.collect_set("family")).alias("families"), F.max("probability").alias("probability")
    )
    notes = notes.withColumnsRenamed({"doc": "_doc", "key": "_key"})
    joined = every.join(notes, every["doc"].eqNullSafe(notes["_doc"]) & (every["key"] == notes["_key"]), "left")
    return joined.select(
        F.col("doc").alias(id_col), "n_paragraphs", F.coalesce("n_notices", F.lit(0).cast("bigint")).alias("n_notices"),
        F.coalesce("families", F.array().cast("array<string>")).alias("families"), "probability",
    )
