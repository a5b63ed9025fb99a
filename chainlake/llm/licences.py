"""Licence scan: a trained paragraph classifier whose predictions templates confirm. No Python runs on the executors.

A paragraph is a line, or the fewest words around it, over any number of lines, that together hold a template (wrapped
notices); words that are looked at are twice as many as the longest template has. It is described by its word 1- and 2-grams. Sparse logistic regression over
hashed grams tells licence families and an unknown class apart. It learns families from variations of
their notices (words left out, others put in front and behind), and the unknown class from sentences and from
the corpus's own paragraphs that are far from every template, so its labels don't come from the rule that
confirms predictions. A second, one-dimensional regression on held-back rows of both kinds calibrates the
probability that a paragraph is a known licence at all. A family counts only if the paragraph also holds
most grams of one of that family's templates with its telling words, so lines that lack every anchor word
of the templates need no joining.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.llm.shared import least_by_hash, stored

#: Notices by family. Families are classes; a family's notices are its templates.
TEMPLATES = {
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "You may not use this file except in compliance with the Apache License", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: GPL-3.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "SPDX-License-Identifier: GPL-2.0"],
    "LGPL": ["Licensed under the GNU Lesser General Public License", "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3", "modify it under the terms of the GNU Affero General Public License", "SPDX-License-Identifier: AGPL-3.0"],
    "BSD": ["Licensed under the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "SPDX-License-Identifier: BSD"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, Version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA"],
    "CC-BY": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY"],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "SPDX-License-Identifier: CC-BY-ND"],
    "CC-BY-NC-SA": ["Licensed under CC BY-NC-SA 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-SA"],
    "CC-BY-NC-ND": ["Licensed under CC BY-NC-ND 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-ND"],
    "CC0": ["Released under CC0 1.0 Universal", "dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication license", "SPDX-License-Identifier: CC0-1.0"],
    "ISC": ["Licensed under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"],
    "Unlicense": ["Released under the Unlicense", "This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0", "SPDX-License-Identifier: BSL-1.0"],
    "Zlib": ["Licensed under the zlib License", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "SPDX-License-Identifier: Zlib"],
    "WTFPL": ["Licensed under the WTFPL", "SPDX-License-Identifier: WTFPL"],
    "proprietary": ["Copyright, all rights reserved", "No part of this publication may be reproduced without the prior written permission of the copyright owner"],
}
#: Sentences on licences that name none (fixed values).
UNKNOWN = [
    "See the license file for details", "Licensed under terms to be announced", "This work is licensed under an agreement with the owner", "The driver holds a licence", "Copyright law is a branch of law",
    "Released under the old name", "Permission to enter was not granted", "He was licensed to practise in the county", "The public domain of the region", "Redistribution of wealth and use of land",
]
#: Words that a template's paragraph must hold if the template does, and words that speak against a family (fixed values).
TELLING = ["version 2", "version 3", "gpl 2.0", "gpl 3.0", *"mit isc unlicense unencumbered apache gnu lesser affero bsd mozilla cc cc0 nc sa nd noncommercial sharealike noderivatives spdx agpl lgpl mpl boost bsl zlib wtfpl".split()]
FOREIGN = {
    "GPL-3.0": "affero lesser library".split(), "GPL-2.0": "affero lesser library".split(), "CC-BY": "nc sa nd noncommercial sharealike noderivatives noderivs".split(), "CC-BY-NC": "sa nd sharealike noderivatives noderivs".split(),
    "CC-BY-SA": "nc nd noncommercial noderivatives noderivs".split(), "CC-BY-ND": "nc sa noncommercial sharealike".split(), "CC-BY-NC-SA": "nd noderivatives noderivs".split(), "CC-BY-NC-ND": "sa sharealike".split(),
}
#: A notice after these words isn't one.
NEGATED = r"(?i)(?:\b(?:not|never|neither|nor|no longer|cannot be)|n[’']t)\s+(?:\w+\s+){0,2}(?:released|licen[cs]ed|distributed|available|dedicated|covered|offered|published)\s+(?:to you\s+)?under\b"
#: Lines that speak of licences; they count as cues whether or not they hold a template.
CUES = r"(?i)licen[cs]e|spdx|wtfpl|copyright|permission is hereby|redistribut|cc0|public domain|reproduced without"
WORDS = r"([\p{L}\p{N}]+(?:[.][\p{N}]+)*)"
#: Share of a template's grams that a paragraph must hold.
CONFIRM = 0.75
#: Words before and after an anchor's line that may belong to its notice: twice those of the longest template.
AROUND = 2 * max(len(t.split()) for group in TEMPLATES.values() for t in group)
FEATURES = 1 << 12
#: The most distinct cue paragraphs, and the most other paragraphs, that the classifier is fitted on, by hash order.
MAX_CUE, MAX_OTHER, OTHER_DOCS = 20_000, 5_000, 1_000
#: Variations of each notice that the classifier learns from; every fourth calibrates. In each about a LEFT_OUT-th of the words is missing.
VARIATIONS, LEFT_OUT = 40, 8
#: Paragraphs of the corpus that hold less than this share of every template are of the unknown class; others that aren't sure stay out of the fit.
FAR = 0.5
#: Words that may stand around a notice (fixed values).
AROUND_WORDS = "file code project copy text page note see also here our all rights contact author version date 2024 http www com".split()
FAMILIES = list(TEMPLATES)
_COMMON = set("the of and to in a is are with that any this under by be for or it not no may as an all on from use you modify work terms form source following without part".split())


def anchors() -> list[str]:
    """Words of which every set of lines holds one that holds CONFIRM of a template's grams."""
    chosen: set[str] = {"license", "licensed", "copyright", "permission", "redistribution"}
    for text in (t for group in TEMPLATES.values() for t in group):
        words = re.findall(r"[^\W_]+(?:[.]\d+)*", text.lower())
        grams = {(w,) for w in words} | set(zip(words, words[1:]))
        left = lambda without: sum(not without & set(g) for g in grams)  # noqa: B023, E731
        while left(chosen) >= CONFIRM * len(grams):
            chosen.add(min(set(words) - chosen, key=lambda w: (w in _COMMON, left(chosen | {w}), -len(w), w)))  # noqa: B023
    return sorted(chosen)


def _grams(paragraph: Column) -> Column:
    words = F.regexp_extract_all(F.lower(paragraph), F.lit(WORDS), F.lit(1))
    with_pairs = lambda w: F.array_distinct(F.concat(w, F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.slice(w, i, 2)))).otherwise(F.array().cast("array<string>"))))
    return F.transform(F.array(words), with_pairs).getItem(0)


def _templates(spark: SparkSession) -> DataFrame:
    """(class, paragraph): class 0 is unknown, k + 1 the k-th family. Made of literals, in the JVM."""
    rows = [F.struct(F.lit(0).alias("class"), F.lit(t).alias("paragraph")) for t in UNKNOWN]
    rows += [F.struct(F.lit(k + 1).alias("class"), F.lit(t).alias("paragraph")) for k, f in enumerate(FAMILIES) for t in TEMPLATES[f]]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.class", "r.paragraph")


def _variations(templates: DataFrame) -> DataFrame:
    """(class, paragraph, back): each template many times, with words left out, and others before and after."""
    words = F.split("paragraph", " ")
    draw = lambda n, *of: F.pmod(F.xxhash64(*of), F.lit(n))
    some = lambda seed: F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.element_at(F.array(*map(F.lit, AROUND_WORDS)), (draw(len(AROUND_WORDS), F.col("paragraph"), F.col("v"), i, F.lit(seed)) + 1).cast("int")))
    many = templates.select("class", "paragraph", F.explode(F.sequence(F.lit(0), F.lit(VARIATIONS - 1))).alias("v"))
    kept = F.filter(words, lambda w, i: (F.col("v") == 0) | (draw(LEFT_OUT, F.col("paragraph"), F.col("v"), i) > 0))
    before, after = (F.when(draw(2, F.col("paragraph"), F.col("v"), F.lit(k)) == 0, some(k)).otherwise(F.array().cast("array<string>")) for k in (1, 2))
    return many.select("class", F.array_join(F.concat(before, kept, after), " ").alias("paragraph"), (F.col("v") % 4 == 3).alias("back"))


def _constant(grams: list[str]) -> Column:
    """An array that is folded into one literal, so that expressions with many templates stay short."""
    return F.split(F.lit("\t".join(grams)), "\t")


def _held(grams: Column, known: dict[int, list[list[str]]], telling: bool = True) -> Column:
    """Of each class from 1, the largest share of a template's grams that `grams` holds; with `telling`, 0 without its telling words."""
    share = lambda t: F.size(F.array_intersect(grams, _constant(t))) / F.lit(float(len(t)))

    def told(k: int, t: list[str]) -> Column:
        held = share(t)
        if not telling:
            return held
        if tell := [w for w in TELLING if w in t]:
            held = F.when(F.size(F.array_intersect(grams, _constant(tell))) == len(tell), held).otherwise(F.lit(0.0))
        if against := FOREIGN.get(FAMILIES[k - 1]):
            held = F.when(F.arrays_overlap(grams, _constant(against)), F.lit(0.0)).otherwise(held)
        return held

    best = [F.greatest(*[told(k, t) for t in known[k]], F.lit(0.0)) for k in sorted(known)]
    return F.array(*best)


def _known(templates: DataFrame) -> dict[int, list[list[str]]]:
    """The grams of each class's templates."""
    known: dict[int, list[list[str]]] = {}
    for r in templates.where("class > 0").collect():  # the fixed templates
        known.setdefault(r["class"], []).append(r["grams"])
    return known


def paragraphs(docs: DataFrame, known: dict[int, list[list[str]]], id_column: str, column: str) -> DataFrame:
    """(id, n_paragraphs, cues): lines with a word, and the paragraphs of lines with a cue or in a notice."""
    anchor = r"(?iu)(?<![\p{L}\p{N}])(?:" + "|".join(map(re.escape, anchors())) + r")(?![\p{L}\p{N}])|" + CUES[4:]
    word = r"[\p{L}\p{N}]"
    first_words = r"^(?:[^\p{L}\p{N}]*[\p{L}\p{N}]+){1,%d}" % AROUND
    after = lambda text: F.regexp_extract(text, first_words, 0)
    before = lambda text: F.reverse(after(F.reverse(text)))
    # a line with a word has at least one, so that AROUND such lines hold all the words that are looked at
    spot = lambda lines: lambda x, i: F.when(
        x.rlike(anchor), F.struct(x.alias("line"), before(F.concat_ws(" ", F.slice(lines, F.greatest(i - AROUND + 1, F.lit(1)), F.least(i, F.lit(AROUND))))).alias("before"), after(F.concat_ws(" ", F.slice(lines, i + 2, F.lit(AROUND)))).alias("after"))
    )
    split = F.split(F.coalesce(F.col(column), F.lit("")), "\n")
    spots = F.transform(F.array(F.filter(split, lambda x: x.rlike(word))), lambda lines: F.filter(F.transform(lines, spot(lines)), lambda x: x.isNotNull())).getItem(0)

    def holds(text: Column) -> Column:
        return F.transform(F.array(_grams(text)), lambda g: F.array_max(_held(g, known)) >= CONFIRM).getItem(0)

    steps = [0, *(AROUND // k for k in (12, 6, 4, 3, 2, 1))]
    reach = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in sorted(((a, b) for a in steps for b in steps if a + b), key=lambda x: (sum(x), x))])

    def paragraph(p: Column) -> Column:
        def within(w: Column) -> Column:
            left, right = w["left"], w["right"]
            some = lambda r: F.concat_ws(" ", F.slice(left, F.greatest(F.size(left) - r["a"] + 1, F.lit(1)), r["a"]), F.array(p["line"]), F.slice(right, F.lit(1), r["b"]))
            return F.get(F.filter(F.transform(reach, some), holds), F.lit(0))

        own = F.when(p["line"].rlike(CUES), p["line"])
        shortest = F.transform(F.array(F.struct(F.split(p["before"], r"\s+").alias("left"), F.split(p["after"], r"\s+").alias("right"))), within).getItem(0)
        texts = F.array(p["line"], F.concat_ws(" ", p["before"], p["line"], p["after"]))
        found = F.transform(F.array(F.transform(texts, holds)), lambda h: F.when(h[0], p["line"]).when(h[1], F.coalesce(shortest, own)).otherwise(own)).getItem(0)
        whole = F.concat_ws(" ", F.array_join(F.slice(F.split(p["before"], r"\s+"), -4, 4), " "), p["line"])  # a denial may stand on the line before
        return F.transform(F.array(found), lambda x: F.when(x.isNotNull() & whole.rlike(NEGATED) & ~x.rlike(NEGATED), whole).otherwise(x)).getItem(0)

    rows = docs.select(F.col(id_column).alias("_id"), F.size(F.filter(split, lambda x: x.rlike(word))).cast("long").alias("n_paragraphs"), spots.alias("spots"))
    return rows.select("_id", "n_paragraphs", F.filter(F.transform("spots", paragraph), lambda x: x.isNotNull()).alias("cues"))


class LicenceModel:
    def __init__(self, classifier, calibration, known):
        self.classifier, self.calibration, self.known = classifier, calibration, known

    def _margins(self, rows: DataFrame) -> DataFrame:
        """Adds shares, class (the likeliest family from 1, of the confirmed ones if any), and margin: its log odds against unknown."""
        hashed = HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="hashed").transform(rows)
        raw = self.classifier.transform(hashed.withColumn("shares", _held(F.col("grams"), self.known))).withColumn("raw", vector_to_array("rawPrediction"))
        families = F.slice("raw", 2, len(FAMILIES))
        confirmed = F.zip_with(families, F.col("shares"), lambda x, held: F.when(held >= CONFIRM, x))
        best = F.coalesce(F.array_max(confirmed), F.array_max(families))
        place = F.when(F.array_max(confirmed).isNotNull(), F.array_position(confirmed, F.array_max(confirmed))).otherwise(F.array_position(families, F.array_max(families)))
        return raw.withColumn("class", place.cast("int")).withColumn("margin", best - F.get("raw", F.lit(0))).drop("hashed", "rawPrediction", "probability", "prediction", "raw")

    def predict(self, rows: DataFrame) -> DataFrame:
        """`rows` with grams, and: class, chance (calibrated, that the paragraph is of a known family), held (share of its template's grams)."""
        slope, shift = self.calibration
        out = self._margins(rows).withColumn("chance", 1 / (1 + F.exp(-(F.col("margin") * slope + shift))))
        return out.withColumn("held", F.get("shares", F.col("class") - 1)).drop("shares")


def fit(spark: SparkSession, cues: DataFrame, others: DataFrame) -> LicenceModel:
    """From variations of the templates, and paragraphs with cues that are far from every template, and others (both unknown)."""
    templates = _templates(spark)
    known = _known(templates.withColumn("grams", _grams(F.col("paragraph"))))
    cues = least_by_hash(cues.select("paragraph").distinct(), "paragraph", MAX_CUE).withColumn("grams", _grams(F.col("paragraph")))
    far = cues.where(F.array_max(_held(F.col("grams"), known, False)) < FAR).select("paragraph", "grams")
    unknown = far.unionByName(others.select("paragraph").withColumn("grams", _grams(F.col("paragraph"))))
    unknown = unknown.select(F.lit(0).alias("class"), "grams", (F.pmod(F.xxhash64("paragraph", F.lit(3)), F.lit(4)) == 0).alias("back"))
    rows = unknown.unionByName(_variations(templates).select("class", _grams(F.col("paragraph")).alias("grams"), "back"))
    rows = stored(rows.withColumn("label", F.col("class").cast("double")).select("label", "grams", "back").coalesce(4), "paragraphs")
    counts = {r.label: r["count"] for r in rows.where("not back").groupBy("label").count().collect()}  # a row for each class
    weight = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, sum(counts.values()) / len(counts) / n)]), F.col("label"))  # classes weigh alike
    hashed = HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(rows.where("not back").withColumn("weight", weight))
    classifier = LogisticRegression(maxIter=60, regParam=1e-3, elasticNetParam=0.5, family="multinomial", weightCol="weight").setFeaturesCol("features").fit(hashed.select("label", "features", "weight"))
    classifier.setFeaturesCol("hashed")
    model = LicenceModel(classifier, (1.0, 0.0), known)
    held_back = model._margins(rows.where("back")).select((F.col("label") > 0).cast("double").alias("label"), array_to_vector(F.array("margin")).alias("features"))
    sides = {r.label: r["count"] for r in held_back.groupBy("label").count().collect()}  # both: variations of notices and of sentences are always there
    even = held_back.withColumn("weight", F.when(F.col("label") == 1, F.lit(1 / sides[1.0])).otherwise(F.lit(1 / sides[0.0])) * max(sides.values()))
    line = LogisticRegression(maxIter=50, regParam=1e-3, weightCol="weight").fit(even)
    model.calibration = (float(line.coefficients[0]), float(line.intercept))
    return model


def licence_scan(docs: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """(id, n_paragraphs, n_cues, families, family, chance, n_unknown) of every row of `docs`.

    families: those confirmed in some paragraph, sorted (not by a notice that is denied: "is not released under"); family: of the likeliest paragraph, ties
    to the first by name; chance: that paragraph's, else the largest of all cue paragraphs, 0
    without any; n_unknown: cue paragraphs that name no confirmed family. Null and empty texts have
    no paragraphs. Rows of equal id (null included) share their families. Other columns are ignored.
    """
    spark = docs.sparkSession
    known = _known(_templates(spark).withColumn("grams", _grams(F.col("paragraph"))))
    split = stored(paragraphs(docs, known, id_column, column), "cues")
    cues = split.where(F.size("cues") > 0).select("_id", F.explode("cues").alias("paragraph"))
    ids = F.broadcast(least_by_hash(docs.select(F.col(id_column).alias("_id")).where("_id is not null").distinct(), "_id", OTHER_DOCS))
    some = docs.select(F.col(id_column).alias("_id"), F.col(column).alias("_text")).join(ids, "_id", "left_semi")
    others = stored(some.select(F.explode(F.split("_text", "\n")).alias("paragraph")).where(f"paragraph rlike '[a-zA-Z]' and not paragraph rlike '{CUES}'").distinct(), "others")
    model = fit(spark, cues, least_by_hash(others, "paragraph", MAX_OTHER))
    scored = model.predict(cues.withColumn("grams", _grams(F.col("paragraph"))))
    sure = (F.col("chance") >= 0.5) & (F.col("held") >= CONFIRM)
    name = F.when(sure, F.element_at(F.array(*map(F.lit, FAMILIES)), F.col("class")))
    scored = scored.select("_id", F.when(~F.col("paragraph").rlike(NEGATED), name).alias("name"), "chance").groupBy("_id").agg(
        F.count("*").alias("n_cues"), F.sort_array(F.collect_set("name")).alias("families"), F.max(F.when(F.col("name").isNotNull(), F.struct("chance", "name"))).alias("best"), F.max("chance").alias("most"), F.count_if(F.col("name").isNull()).alias("n_unknown")
    )
    found = scored.withColumnRenamed("_id", "_of")
    out = split.join(found, F.col("_id").eqNullSafe(F.col("_of")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        F.col("_id").alias(id_column), "n_paragraphs", zero("n_cues"), F.coalesce("families", F.array().cast("array<string>")).alias("families"),
        F.col("best.name").alias("family"), F.coalesce("best.chance", "most", F.lit(0.0)).alias("chance"), zero("n_unknown"),
    )
