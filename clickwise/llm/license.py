"""Licence notices by a trained paragraph classifier, in DataFrame functions only.

A paragraph is a run of lines with letters or digits, so wrapped and
commented notices are whole. Windows of a template's length, and of half as
much again, that hold enough of its word pairs are judged one by one: their
word 1- and 2-grams that occur in any notice template are the features; a
multinomial logistic regression, fitted on a bounded sample of lines, gives
each family and the class ``unknown`` a calibrated probability (temperature
on held-out rows). A predicted family stands only if one of its templates
shares enough word pairs. Of windows that overlap one stands.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickwise.llm.common import stored

# Public notice wordings by family.
TEMPLATES = (
    ("MIT", "released under the mit license"),
    ("MIT", "licensed under the mit license"),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "licensed under the apache license version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the license"),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3"),
    ("GPL-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3"),
    ("GPL-2.0", "licensed under the gnu general public license version 2"),
    ("LGPL", "licensed under the gnu lesser general public license"),
    ("AGPL-3.0", "licensed under the gnu affero general public license version 3"),
    ("BSD", "licensed under the bsd 3 clause license"),
    ("BSD", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("CC-BY-NC", "licensed under cc by nc 4.0"),
    ("CC-BY", "licensed under cc by 4.0"),
    ("CC-BY-SA", "licensed under cc by sa 4.0"),
    ("CC-BY-SA", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("CC0", "dedicated to the public domain under cc0 1.0 universal"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("Proprietary", "all rights reserved"),
    ("Proprietary", "all rights reserved no part may be reproduced without written permission"),
)
DECOYS = (
    "a driving license is required", "the license office is open", "version 3 was released today", "this work is under way",
    "the general public is welcome", "the terms of the sale are public", "the software is free to try", "he was licensed to drive",
)
FAMILIES = [*dict.fromkeys(f for f, _ in TEMPLATES), "unknown"]
_WORD = r"[a-z0-9]+(?:\.[0-9]+)*"


def _grams(words: list[str]) -> list[str]:
    return sorted({*words, *(" ".join(p) for p in zip(words, words[1:]))})


VOCABULARY = sorted({g for _, t in TEMPLATES for g in _grams(t.split())})
_INDEX = {g: k for k, g in enumerate(VOCABULARY)}
_PAIRS = [[_INDEX[g] for g in _grams(t.split()) if " " in g] for _, t in TEMPLATES]


def lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, tag, para, line)``: the lines of each row, numbered from 0."""
    one = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"), "text")
    return one.select("doc_id", "tag", F.posexplode(F.split("text", "\n")).alias("para", "line"))


def _text_key():
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def _pairs(w):
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def _likely(words, min_overlap: float):
    """Whether ``words`` hold the share ``min_overlap`` of any template's pairs; lambda arguments are computed once."""
    every = F.lit(sorted({VOCABULARY[k] for pairs in _PAIRS for k in pairs}))

    def any_template(g):
        out = F.lit(False)
        for pairs in _PAIRS:
            out = out | (F.size(F.array_intersect(g, F.lit([VOCABULARY[k] for k in pairs]))) >= F.lit(min_overlap * len(pairs)))
        return out
    found = F.transform(F.array(words), lambda w: F.array_intersect(_pairs(w), every))
    return F.exists(found, lambda g: (F.size(g) > 0) & any_template(g))


def paragraphs(docs: DataFrame, min_overlap: float) -> DataFrame:
    """``(key, para, w)``: the words of each paragraph that may hold a notice; equal texts have one key."""
    parts = docs.select(_text_key().alias("key"), F.posexplode(F.split("text", r"\n(?:[^\p{L}\p{N}\n]*\n)+")).alias("para", "line"))
    words = F.regexp_extract_all(F.lower("line"), F.lit(_WORD), F.lit(0))
    return parts.where(_likely(words, min_overlap)).select("key", "para", words.alias("w"))


def _pairs_at(parts: DataFrame):
    """The word pairs of each paragraph with their places."""
    return parts.select("key", "para", F.posexplode(_pairs(F.col("w"))).alias("at", "gram"))


def windows(docs: DataFrame, min_overlap: float) -> DataFrame:
    """``(key, para, start, width, line)``: the windows that hold the share ``min_overlap`` of a template's pairs."""
    spark = docs.sparkSession
    known = [(t, VOCABULARY[k], k, len(pairs)) for t, pairs in enumerate(_PAIRS) for k in pairs]
    table = F.broadcast(spark.createDataFrame(known, "t int, gram string, k int, n int"))
    some = stored(paragraphs(docs, min_overlap).dropDuplicates(["key", "para"]), "license-paragraphs")
    sizes = F.broadcast(spark.createDataFrame([(t, n + half * (n // 2)) for t, (_, text) in enumerate(TEMPLATES)
                                               for n in [len(text.split())] for half in (0, 1)], "t int, width int"))
    # Pairs at most width - 2 places on; in steps of width - 1.5 places one frame serves every width.
    near = Window.partitionBy("key", "para", "t", "width").orderBy(F.col("at") / (F.col("width") - 1.5)).rangeBetween(0, 1)
    found = (_pairs_at(some).join(table, "gram").join(sizes, "t").withColumn("d", F.size(F.collect_set("k").over(near)))
             .where(F.col("d") >= min_overlap * F.col("n")).select("key", "para", F.col("at").alias("start"), "width"))
    return (some.join(found.distinct(), ["key", "para"])
            .select("key", "para", "start", "width", F.array_join(F.slice("w", F.col("start") + 1, F.col("width")), " ").alias("line")))


def _features(spark, lines: DataFrame, *keys: str) -> DataFrame:
    """Add ``f``, the sorted vocabulary numbers in ``line``; lines without any are left out."""
    words = F.regexp_extract_all(F.lower("line"), F.lit(_WORD), F.lit(0))
    pairs = F.transform(F.arrays_zip(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))).alias("a"),
                                     F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("b")),
                        lambda x: F.concat_ws(" ", x["a"], x["b"]))
    vocabulary = spark.range(1).select(F.posexplode(F.lit(VOCABULARY)).alias("k", "gram"))
    grams = lines.select(*keys, words.alias("w")).select(*keys, F.explode(F.concat("w", pairs)).alias("gram"))
    return grams.join(F.broadcast(vocabulary), "gram").groupBy(*keys).agg(F.sort_array(F.collect_set("k")).alias("f"))


def _softmax(z, heat=1.0):
    top = max(z)
    e = [math.exp((x - top) / heat) for x in z]
    return [x / sum(e) for x in e]


def train(docs: DataFrame, max_unknown: int = 2000, epochs: int = 60, rate: float = 0.5, l2: float = 1e-3) -> dict:
    """Fit on the templates, with words left out in turn, the decoys and at most ``max_unknown`` corpus lines.

    Corpus lines that mention a licence may be notices, so they are no examples of ``unknown``.
    """
    spark = docs.sparkSession
    plain = (lines(docs).where(~F.lower("line").rlike("licen|copyright|gnu|apache|permission|redistribut|public domain"))
             .orderBy(F.xxhash64("doc_id", "tag", "para"), "doc_id", "tag", "para").limit(max_unknown))
    unknown = [r.f for r in _features(spark, plain, "doc_id", "tag", "para").select("f").collect()]
    rows = [(f, "unknown") for f in sorted(unknown)]
    for line in DECOYS:
        rows += [([_INDEX[g] for g in _grams(line.split()) if g in _INDEX], "unknown")] * 10
    for family, line in TEMPLATES:
        words = line.split()
        for skip in range(-10, len(words)):
            rows.append(([_INDEX[g] for g in _grams([w for k, w in enumerate(words) if k != skip]) if g in _INDEX], family))
    n = len(FAMILIES)
    w = [[0.0] * n for _ in VOCABULARY]
    bias = [0.0] * n
    bias[-1] = 1.0

    def logits(f):
        return [b + sum(w[k][c] for k in f) for c, b in enumerate(bias)]
    held = [(f, FAMILIES.index(y)) for k, (f, y) in enumerate(rows) if k % 4 == 3]
    seen = [(f, FAMILIES.index(y)) for k, (f, y) in enumerate(rows) if k % 4 != 3]
    for epoch in range(epochs):
        step = rate / (1 + epoch / 10)
        # A fixed stride mixes the classes without a random order.
        for k in range(len(seen)):
            f, y = seen[k * 997 % len(seen)]
            size = step / (1 + len(f))
            for c, p in enumerate(_softmax(logits(f))):
                e = p - (c == y)
                bias[c] -= size * e
                for j in f:
                    w[j][c] -= size * (e + l2 * w[j][c])
    heats = (0.5, 0.75, 1.0, 1.5, 2.0, 3.0)
    outs = [(logits(f), y) for f, y in held]
    heat = min(heats, key=lambda t: -sum(math.log(max(1e-12, _softmax(z, t)[y])) for z, y in outs))
    return {"w": w, "bias": bias, "heat": heat}


def notices(docs: DataFrame, model: dict, min_probability: float = 0.5, min_overlap: float = 0.6) -> DataFrame:
    """Confirmed notices: key, para, start, family, probability, overlap (of the best template), none over another."""
    spark, place = docs.sparkSession, ["key", "para", "start", "width"]
    grams = stored(_features(spark, windows(docs, min_overlap), *place).select(*place, F.explode("f").alias("k")), "license-grams")
    # The model and the templates are tables of vocabulary size, joined to the grams of the windows.
    weights = F.broadcast(spark.createDataFrame([(k, w) for k, w in enumerate(model["w"])], "k int, w array<double>"))
    z = [F.sum(F.get("w", c)) + F.lit(b) for c, b in enumerate(model["bias"])]
    found = grams.join(weights, "k").groupBy(*place).agg(F.array(*z).alias("z"))
    e = F.transform("z", lambda x: F.exp((x - F.array_max("z")) / model["heat"]))
    found = found.withColumn("e", e).withColumn("c", F.array_position("e", F.array_max("e")).cast("int"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    found = (found.withColumn("family", F.element_at(F.lit(FAMILIES), F.col("c")))
             .withColumn("probability", F.array_max("e") / total)
             .where((F.col("family") != "unknown") & (F.col("probability") >= min_probability)))
    known = [(k, t, family, len(pairs)) for t, ((family, _), pairs) in enumerate(zip(TEMPLATES, _PAIRS)) for k in pairs]
    templates = F.broadcast(spark.createDataFrame(known, "k int, t int, family string, of int"))
    shared = grams.join(templates, "k").groupBy(*place, "family", "t", "of").agg(F.count("*").alias("n"))
    best = shared.groupBy(*place, "family").agg(F.max(F.col("n") / F.col("of")).alias("overlap"),
                                                F.max(F.when(F.col("n") >= min_overlap * F.col("of"), F.col("n"))).cast("double").alias("pairs"))
    found = found.drop("z", "e", "c").join(best, [*place, "family"]).where(F.col("overlap") >= min_overlap)
    # The window of most pairs first, then the surest, then the narrowest; each that touches none taken before.
    order = F.struct((-F.col("pairs")).alias("a"), (-F.col("probability")).alias("b"), "width", "start", "family", "probability", "overlap")
    lists = found.groupBy("key", "para").agg(F.sort_array(F.collect_list(order)).alias("l"))
    apart = lambda x, y: (x["start"] >= y["start"] + y["width"]) | (y["start"] >= x["start"] + x["width"])
    taken = F.aggregate("l", F.slice("l", 1, 0), lambda acc, x: F.when(F.forall(acc, lambda y: apart(x, y)), F.array_append(acc, x)).otherwise(acc))
    return (lists.select("key", "para", F.explode(taken).alias("x"))
            .select("key", "para", "x.start", "x.family", "x.probability", "x.overlap"))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_notices, families (sorted, comma-joined), best_probability for every distinct row of ``docs``.

    Null and empty texts have no notices. Rows equal in doc_id and text give one row.
    """
    got = notices(docs, train(docs)).groupBy("key").agg(
        F.count("*").alias("n"), F.concat_ws(",", F.array_sort(F.collect_set("family"))).alias("families"),
        F.max("probability").alias("best_probability"))
    rows = docs.select("doc_id", _text_key().alias("key")).distinct()
    return rows.join(got, "key", "left").select(
        "doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_notices"),
        F.coalesce("families", F.lit("")).alias("families"), "best_probability")
