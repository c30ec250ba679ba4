"""Notices wrapped over lines, and the scan against a plain scorer."""

import math
import re

from cases import prose
from pyspark.sql import functions as F

from bandloom.llm import licenses

SCHEMA = "doc_id bigint, text string, line string, paragraph int, at string, _block string"
WRAPPED = {
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance\nwith the License.",
    "mit": "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and associated\ndocumentation files (the \"Software\"), to deal in it.",
}


def commented(text):
    return "/*\n" + "\n".join(f" * {x}" for x in text.split("\n")) + "\n */"


def documents(spark):
    rows = [(100 + i, prose(i, 60) + "\n\n" + prose(i + 500, 30) + "\n" + prose(i + 900, 20)) for i in range(60)]
    for i, text in enumerate(WRAPPED.values()):
        rows += [(i, f"{prose(i, 40)}\n\n{text}\n \t\n{prose(i, 9)}"), (20 + i, commented(text) + "\n\n" + prose(i, 30)), (40 + i, text.replace("\n", "\r\n"))]
    rows += [(60, None), (61, ""), (62, "\n\n \n***\n"), (63, "\n".join("." * (i % 3) for i in range(20_000))), (None, WRAPPED["gpl"]), (None, WRAPPED["mit"]), (0, WRAPPED["mit"])]
    return spark.createDataFrame([(*r, "", 0, "", "") for r in rows], SCHEMA)


def plain_scan(model, text):
    """(paragraph, line, family) found by going through the text once."""
    weights = {r.gram: r.weight for r in model.weights.collect()}

    def words(line):
        bare = re.sub(r"[^\w.+-]+|_+", " ", line.lower())
        return [w.strip(".+-") for w in bare.split() if w.strip(".+-")]

    def grams(line):
        w = words(line)
        return {" ".join(w[i:i + n]) for n in licenses.ORDERS for i in range(len(w) - n + 1)}

    found, block, parts = [], [], []
    for line in [*text.split("\n"), ""]:
        if re.search(r"[^\W_]", line):
            block.append(line)
        elif block:
            parts.append(block)
            block = []
    for p, block in enumerate(parts):
        for at, line in [(None, "\n".join(block))] * (len(block) > 1) + list(enumerate(block)):
            held = grams(line)
            if not any(w in model.anchors for g in held for w in g.split()):
                continue
            raw = [b + sum(weights[g][i] for g in held if g in weights) for i, b in enumerate(model.intercepts)]
            best = max(range(len(raw) - 1), key=lambda i: raw[i])
            chance = 1 / (1 + math.exp(-((raw[best] - raw[-1]) * model.scale + model.shift)))
            family = model.families[best]
            shared = max(len(held & grams(t)) / len(grams(t)) for t in licenses.NOTICES[family])
            if chance >= licenses.MIN_PROBABILITY and shared >= licenses.MIN_SHARED:
                found.append((p, at, family))
    return found


def test_wrapped_notices_are_found_as_a_plain_scorer_does(spark):
    docs = documents(spark)
    model = licenses.fit_licences(docs)
    out = {(r.doc_id, tuple(r.families)) for r in licenses.document_licences(docs, model).collect()}
    for i, family in enumerate(WRAPPED):
        assert {(i, (family,)), (20 + i, (family,)), (40 + i, (family,))} <= out
    assert {(None, ("gpl",)), (None, ("mit",)), (0, ("mit",)), (60, ()), (61, ()), (62, ()), (63, ())} <= out
    assert all(not families for i, families in out if i is not None and i >= 60)
    # Lines between paragraphs and at their ends hold comment signs only, which shifts no place of a line with words.
    plain = docs.filter("doc_id IS NULL OR doc_id < 20 OR doc_id >= 40")
    want = {(r.doc_id, p, at, f) for r in plain.collect() for p, at, f in plain_scan(model, r.text or "")}
    got = {(r.doc, r.paragraph, r.line, r.family) for r in licenses.scan_licences(plain, model).collect()}
    assert got == want and len(want) >= 10


def test_unknown_rows_do_not_depend_on_the_layout(spark):
    docs = documents(spark)
    scores = []
    for n in (1, 5):
        model = licenses.fit_licences(docs.repartition(n), unknown_rows=40)
        scores.append([model.scale, model.shift, *model.intercepts])
    assert all(abs(a - b) < 1e-6 for a, b in zip(*scores))


def test_paragraphs_are_counted(spark):
    texts = ["a\n\nb", "a\nb", "\n\na\n \n\n\nb c\n", "***\n--", "", "a\n//\n// \nb"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.n for r in df.select(F.size(licenses.blocks(F.col("text"))).alias("n")).collect()] == [2, 1, 2, 0, 0, 2]
