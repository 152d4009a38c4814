"""Licence notices in documents: a trained paragraph classifier, confirmed against templates.

A window of words is a sparse vector of word bigrams and trigrams. One logistic regression per
licence family is fitted by proximal gradient steps, which keep few weights, to the templates and to
all distinct paragraphs without a licence. Paragraphs of the same features are one row with a count,
and a step is one aggregation over these rows. What no family claims with at least the calibrated
probability is ``unknown``: the cut is the least at which at most one in a hundred of all held-out
paragraphs without a licence is claimed. A claim is confirmed if a template of its family shares
enough of its bigrams with the words around the window.

A text is scored in windows of several sizes that begin at each weighted pair of words, so neither
the words around a notice nor the line breaks within it count. Of overlapping windows the best one is
claimed, for the paragraph (line) it begins in, and one for each paragraph. A document with too few
weighted pairs for any claim is passed over; the rest are scored within their rows. No text is
shuffled; paragraphs are told apart by 128 bits of hash.

Defined results
    null or empty text   no paragraphs
    null doc_id          kept
    repeated rows        each is scanned
    empty table          empty result
    extra columns        ignored
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.storage import Workspace

# Notices by which the licences ask to be named, and notices of no known licence.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Use of this source code is governed by a BSD-style license."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unknown", "All rights reserved. No part of this publication may be reproduced without permission."),
    ("unknown", "This software is proprietary and confidential; no license is granted."),
    ("unknown", "See the license terms of the publisher before you use this file."),
    ("unknown", "A driving license is needed for this version of the work."),
]
UNKNOWN = "unknown"
STEPS, RATE, SHRINK, INTERCEPT = 12, 3.0, 0.002, -2.0
#: Least share of a template's bigrams in a confirmed paragraph.
SIMILAR = 0.6
#: Words of a window, and words before it that count for its confirmation.
SIZES, BEFORE = (6, 7, 8, 10, 12, 14, 17, 20, 24, 29, 35, 42, 50), 10
_HINT = r"(?i)licen[sc]|copyright|warrant|permission|redistribut|creative commons"


def tokens(text: Column) -> Column:
    """Lower-cased words and numbers."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _bound(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function`` of ``value``, which is evaluated once, however often it is used and wherever the plan moves it."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def grams(words: Column, n: int) -> Column:
    """The distinct runs of ``n`` words."""

    def runs(w: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda k: F.array_join(F.slice(w, k, n), " "))
        return F.when(F.size(w) >= n, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))

    return _bound(words, runs)


def terms(words: Column) -> Column:
    return _bound(words, lambda w: F.concat(grams(w, 2), grams(w, 3)))


def _forms() -> list[tuple[str, list[list[str]]]]:
    """The word pairs of each template of each known family."""
    out: dict[str, list[list[str]]] = {}
    for family, line in TEMPLATES:
        if family != UNKNOWN:
            words = [w for w in re.split(r"[\W_]+", line.lower()) if w]
            out.setdefault(family, []).append(sorted({f"{a} {b}" for a, b in zip(words, words[1:])}))
    return sorted(out.items())


def _likeness(pairs: Column, forms: list[list[str]]) -> Column:
    """The greatest share of one of ``forms`` among ``pairs``."""
    shares = [F.size(F.array_intersect(F.expr(_literal(f)), pairs)) / len(f) for f in forms]
    return F.array_max(F.array(*shares))


def _vocabulary(spark: SparkSession) -> list[str]:
    """The terms of the templates of known licences; no other term can speak for a licence."""
    known = spark.createDataFrame([(t,) for f, t in TEMPLATES if f != UNKNOWN], "line string")
    return sorted(r.term for r in known.select(F.explode(terms(tokens(F.col("line")))).alias("term")).distinct().collect())


def _numbers(values: list[float]) -> Column:
    """A constant array, in a plan of three nodes."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def _sum(ids: Column, weights: Column) -> Column:
    """The sum of the weights at ``ids`` (from 0)."""
    return F.aggregate(ids, F.lit(0.0), lambda total, i: total + F.get(weights, i))


def _literal(words: list[str]) -> str:
    """An SQL array; the words are letters, digits and spaces only, so they can stand in quotes as they are."""
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def _paragraphs(docs: DataFrame) -> DataFrame:
    """(line, around): a row for each line; ``around`` has its neighbours too, if the line has a word of licensing."""

    def each(lines: Column) -> Column:
        def one(line: Column, k: Column) -> Column:
            around = F.array_join(F.slice(lines, F.greatest(k, F.lit(1)), F.when(k == 0, 2).otherwise(3)), " ")
            return F.struct(line.alias("line"), F.when(line.rlike(_HINT), around).alias("around"))

        return F.transform(lines, one)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.explode(_bound(F.split(text, "\n"), each)).alias("e")).select("e.line", "e.around")


def _features(words: Column, vocabulary: list[str]) -> Column:
    """(words, n, ids): the number of words, and if one of the terms is in ``vocabulary``, that of distinct terms, and the places of the known ones."""
    pairs, place = [t for t in vocabulary if t.count(" ") == 1], F.expr(_literal(vocabulary))

    def following(w: Column, n: int) -> Column:
        made = F.transform(w, lambda a, k: F.concat(a, *[x for i in range(1, n) for x in (F.lit(" "), F.get(w, k + i))]))
        return F.size(F.array_distinct(F.array_compact(made)))

    def of(w: Column) -> Column:
        at = F.transform(w, lambda a, k: F.when(F.concat(a, F.lit(" "), F.get(w, k + 1)).isin(pairs), k))

        def found(hits: Column) -> Column:
            # At the end of the words a pair stands for a triple, too; it counts once. A known triple begins with a known pair.
            places = F.transform(hits, lambda k: F.array(*[F.array_position(place, F.array_join(F.slice(w, k + 1, n), " ")).cast("int") - 1 for n in (2, 3)]))
            ids = F.array_sort(F.array_distinct(F.filter(F.flatten(places), lambda i: i >= 0)))
            n = F.when(F.size(hits) > 0, following(w, 2) + following(w, 3)).otherwise(0)
            return F.struct(F.size(w).alias("words"), n.alias("n"), ids.alias("ids"))

        return _bound(F.array_compact(at), found)

    return _bound(words, of)


def _fit(rows: DataFrame, vocabulary: list[str]) -> dict[str, list[float]]:
    """The weights of each family after all steps; ``rows`` has label, x, share (of its label, times its count) and ids.

    A step's sums are of whole numbers, so that they do not depend on the order of the rows; the driver
    has one number of each family and term.
    """
    families, unit = sorted({f for f, _ in TEMPLATES} - {UNKNOWN}), 1 << 50
    weights = {f: [0.0] * len(vocabulary) for f in families}
    for _ in range(STEPS):
        errors = []
        for k, family in enumerate(families):
            margin = INTERCEPT + F.col("x") * _sum(F.col("ids"), _numbers(weights[family]))
            error = F.col("share") * F.col("x") * (1 / (1 + F.exp(-margin)) - F.when(F.col("label") == family, 1.0).otherwise(0.0))
            errors.append(F.round(error * float(unit)).cast("long").alias(f"e{k}"))
        each = rows.select("ids", *errors).select(F.explode("ids").alias("at"), *[f"e{k}" for k in range(len(families))])
        for r in each.groupBy("at").agg(*[F.sum(f"e{k}").alias(f"e{k}") for k in range(len(families))]).collect():
            for k, family in enumerate(families):
                weights[family][r.at] -= RATE * r[f"e{k}"] / unit
        for family, w in weights.items():
            weights[family] = [math.copysign(max(abs(z) - SHRINK, 0.0), z) for z in w]
    return weights


def _at_rank(values: DataFrame, rank: int) -> float | None:
    """The ``m`` of ``values`` that ``rank`` rows stand above, if there are as many; by histograms, each within a bin of the one before."""
    total, low, high = values.agg(F.count("m"), F.min("m"), F.max("m")).first()
    if total <= rank:
        return None
    while low < high:
        place = F.least(F.floor((F.col("m") - low) / ((high - low) / 1024)), F.lit(1023))
        bins = values.where(F.col("m").between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("m").alias("low"), F.max("m").alias("high"))
        for r in sorted(bins.collect(), key=lambda r: -r.bin):
            if rank < r.n:
                low, high = r.low, r.high
                break
            rank -= r.n
    return low


def train(docs: DataFrame, work: Workspace) -> tuple[DataFrame, float]:
    """The weights (term, family, w) and the calibrated least probability."""
    spark, vocabulary = docs.sparkSession, _vocabulary(docs.sparkSession)
    # A line with a word of licensing has no licence if it is like no template, whatever stands before and after.
    like = _bound(grams(tokens(F.col("around")), 2), lambda p: F.greatest(*[_likeness(p, f) for _, f in _forms()]))
    # Odd lines (by hash) are held out for the calibration; every template is learned from.
    # Lines with a word of licensing are not learned from, as a notice of another wording may be among them.
    one, hint = F.xxhash64("line"), F.col("around").isNotNull()
    lines = _paragraphs(docs).select(
        one.alias("one"),
        F.xxhash64(F.lit(UNKNOWN), "line").alias("two"),
        (hint | (F.pmod(one, F.lit(2)) == 1)).alias("held"),
        F.when(F.col("line").isin([x for _, x in TEMPLATES]), False).when(hint, like < SIMILAR).otherwise(True).alias("plain"),
        _features(tokens(F.col("line")), vocabulary).alias("f"),
        "line",
    )
    known = F.size("f.ids") > 0
    lines = work.put(lines.select("one", "two", "held", "plain", "f", F.when(F.col("held") & F.col("plain") & known, F.col("line")).alias("line")), "lines")
    lines = lines.where("plain and f.words > 1").select("one", "two", "held", "line", "f.*")
    # A line without a term of the templates has no gradient, but it counts in its label's share.
    kinds = lines.select("one", "two", "held", *[F.when(F.col("held"), None).otherwise(F.col(c)).alias(c) for c in ("n", "ids")]).distinct()
    kinds = kinds.groupBy("held", "n", "ids").agg(F.count("*").alias("count")).select(F.lit(UNKNOWN).alias("label"), "held", "n", "ids", "count")
    fixed = spark.createDataFrame(TEMPLATES, "label string, line string").select("label", _features(tokens(F.col("line")), vocabulary).alias("f"))
    rows = work.put(kinds.union(fixed.select("label", F.lit(False), "f.n", "f.ids", F.lit(1))), "rows")
    sizes = {(r.label, r.held): r.n for r in rows.groupBy("label", "held").agg(F.sum("count").alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("label") == label, F.col("count") / n) for (label, held), n in sorted(sizes.items()) if not held])
    x = 1 / F.sqrt(F.greatest(F.col("n"), F.lit(1)))
    fitted = _fit(rows.where("not held and size(ids) > 0").select("label", x.alias("x"), share.alias("share"), "ids"), vocabulary)
    weights = spark.createDataFrame([(t, f, z) for f, of in fitted.items() for t, z in zip(vocabulary, of) if z], "term string, family string, w double")
    # Of n held-out negatives at most n / 100 may have a window above the cut. No window of a line has more than all its weights above 0.
    most = F.greatest(*[_sum(F.col("ids"), _numbers([max(z, 0.0) for z in of])) for of in fitted.values()])
    margin = F.array_max(F.transform(_windows(tokens(F.col("line")), _by_family(weights), 0.0), lambda c: c["margin"]))
    margins = lines.where("line is not null").where(INTERCEPT + most >= 0).select("one", "two", margin.alias("m"))
    margins = work.put(margins.groupBy("one", "two").agg(F.max("m").alias("m")), "margins")
    top = _at_rank(margins.where("m is not null"), sizes.get((UNKNOWN, True), 0) // 100)
    return weights, 0.5 if top is None else max(0.5, 1 / (1 + math.exp(-top)) + 1e-9)


def _by_family(weights: DataFrame) -> dict[str, dict[str, float]]:
    """The weights of each family; at most one row per template term and family reaches the driver."""
    by: dict[str, dict[str, float]] = {}
    for r in weights.collect():
        by.setdefault(r.family, {})[r.term] = r.w
    return by


def _total(places: Column, weights: Column) -> Column:
    """The sum of the weights at ``places`` (from 1)."""
    return F.aggregate(places, F.lit(0.0), lambda total, k: total + F.element_at(weights, k.cast("int")))


_CLAIM = "struct<margin:double,family:string,size:int,at:int>"


def _needed(by: dict[str, dict[str, float]], least: float) -> tuple[list[str], int]:
    """The weighted pairs of words, and how many of them a window with a margin of ``least`` holds at least.

    A weighted term is a weighted pair or begins with one, and a pair begins two terms at most.
    """
    weights = [w for of in by.values() for w in of.values()]
    greatest = max(weights, default=0.0)
    need = max(1, math.ceil((least - INTERCEPT) * math.sqrt(2 * SIZES[0] - 3) / (2 * greatest) - 1e-9)) if greatest > 0 else 1 << 30
    return sorted({" ".join(t.split(" ")[:2]) for of in by.values() for t in of}), need


def _may_claim(text: Column, by: dict[str, dict[str, float]], least: float) -> Column:
    """False only for a text without a window that can be claimed: the words of no weighted pair stand anywhere in it."""
    pairs, _ = _needed(by, least)
    words = sorted({w for p in pairs for w in p.split(" ")})
    if not words:
        return F.lit(False)
    seen = lambda low: F.array(*[F.contains(low, F.lit(w)) for w in words])
    places = F.expr("array(" + ", ".join(f"struct({words.index(a)} AS a, {words.index(b)} AS b)" for a, b in (p.split(" ") for p in pairs)) + ")")
    return _bound(_bound(F.lower(text), seen), lambda has: F.exists(places, lambda p: F.get(has, p["a"]) & F.get(has, p["b"])))


def _windows(words: Column, by: dict[str, dict[str, float]], least: float) -> Column:
    """An array of (margin, family, size, at): the best window at each weighted pair of ``words``, if its margin is ``least`` or more."""
    vocabulary = sorted({t for of in by.values() for t in of})
    if not vocabulary:
        return F.array().cast(f"array<{_CLAIM}>")
    place, columns = F.expr(_literal(vocabulary)), [(f, F.expr("array(" + ", ".join(f"{of.get(t, 0.0)!r}D" for t in vocabulary) + ")")) for f, of in sorted(by.items())]
    pairs, need = _needed(by, least)
    term = lambda w, k, n: F.array_join(F.slice(w, k + 1, n), " ")

    def scored(w: Column, at: Column) -> Column:
        def terms_of(v: Column) -> Column:
            def found(n: int) -> Column:
                made = F.transform(v, lambda _, k: F.when(k + n <= F.size(v), F.struct((k + n).alias("end"), term(v, k, n).alias("term"))))
                kept = F.filter(made, lambda q: F.coalesce(q["term"].isin(vocabulary), F.lit(False)))
                return F.transform(kept, lambda q: F.struct(q["end"].alias("end"), F.array_position(place, q["term"]).alias("id")))

            return F.concat(found(2), found(3))

        def best(size: Column, length: Column, known: Column) -> Column:
            ids = F.array_distinct(F.transform(F.filter(known, lambda q: q["end"] <= size), lambda q: q["id"]))
            x = 1 / F.sqrt(F.greatest(2 * F.least(size, length) - 3, F.lit(1)))
            each = lambda i: F.array_max(F.array(*[F.struct((INTERCEPT + x * _total(i, c)).alias("margin"), F.lit(f).alias("family")) for f, c in columns]))
            return _bound(_bound(ids, each), lambda b: F.struct(b["margin"].alias("margin"), b["family"].alias("family"), size.alias("size"), at.alias("at")))

        sizes = F.expr("array(" + ", ".join(map(str, SIZES)) + ")")
        by_size = lambda v: _bound(terms_of(v), lambda known: F.array_max(F.transform(sizes, lambda z: best(z, F.size(v), known))))
        return _bound(F.slice(w, at + 1, SIZES[-1]), by_size)

    def of(w: Column) -> Column:
        at = F.transform(w, lambda a, k: F.when(F.concat(a, F.lit(" "), F.coalesce(F.get(w, k + 1), F.lit(""))).isin(pairs), k))
        enough = lambda h, p, i: F.coalesce(F.get(h, i + (need - 1)) < p + SIZES[-1], F.lit(False))
        near = lambda h: F.filter(h, lambda p, i: enough(h, p, i) | (p > F.size(w) - SIZES[0]))
        return F.transform(_bound(F.array_compact(at), near), lambda p: scored(w, p))

    return F.filter(_bound(words, of), lambda c: c["margin"] >= least).cast(f"array<{_CLAIM}>")


def _apart(claims: Column) -> Column:
    """Of ``claims`` (with their line) the best, and so on, that neither overlap nor share a line."""
    order = F.array_sort(claims, lambda a, b: F.when(a["margin"] != b["margin"], F.when(a["margin"] > b["margin"], -1).otherwise(1)).otherwise(a["at"] - b["at"]))
    meets = lambda a, c: (a["line"] == c["line"]) | ((a["at"] < c["at"] + c["size"]) & (c["at"] < a["at"] + a["size"]))
    none = F.array().cast(f"array<{_CLAIM[:-1]},line:int>>")
    return F.aggregate(order, none, lambda kept, c: F.when(F.exists(kept, lambda a: meets(a, c)), kept).otherwise(F.concat(kept, F.array(c))))


def scan(docs: DataFrame) -> DataFrame:
    """A row for each claimed paragraph: doc_id, paragraph, family, probability, similarity, confirmed."""
    work = Workspace(docs.sparkSession, "licences")
    weights, cut = train(docs, work)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    by, least = _by_family(weights), math.log(cut / (1 - cut))
    claims = _windows(tokens(text), by, least)
    # Always true, and not deterministic: the plan must not evaluate the claims once more in a filter below.
    once = F.monotonically_increasing_id() >= 0
    found = docs.where(_may_claim(text, by, least)).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.when(once, claims).alias("claims")).where(F.size("claims") > 0)
    # The line of every word.
    lines = F.flatten(F.transform(F.split("text", "\n"), lambda line, k: F.array_repeat(k, F.size(tokens(line)))))
    placed = _bound(lines, lambda of: F.transform("claims", lambda c: F.struct(*[c[k].alias(k) for k in ("margin", "family", "size", "at")], F.get(of, c["at"]).alias("line"))))
    chosen = found.select("doc_id", F.when(once, _bound(placed, _apart)).alias("claims"), tokens(F.col("text")).alias("words"))
    around = F.transform("claims", lambda c: F.struct(c.alias("c"), F.slice("words", F.greatest(c["at"] - (BEFORE - 1), F.lit(1)), BEFORE + SIZES[-1]).alias("words")))
    rows = chosen.select("doc_id", F.when(once, around).alias("claims")).select("doc_id", F.explode("claims").alias("e"))
    rows = rows.select("doc_id", F.col("e.c.line").cast("long").alias("paragraph"), "e.c.family", (1 / (1 + F.exp(-F.col("e.c.margin")))).alias("probability"), grams(F.col("e.words"), 2).alias("pairs"))
    likeness = F.coalesce(*[F.when(F.col("family") == family, _likeness(F.col("pairs"), forms)) for family, forms in _forms()])
    return rows.select(
        "doc_id",
        "paragraph",
        "family",
        F.round("probability", 6).alias("probability"),
        F.round(likeness, 6).alias("similarity"),
        (likeness >= SIMILAR).alias("confirmed"),
    )
