"""License scans by a trained paragraph classifier, in DataFrame and Spark ML operations only.

A text falls into paragraphs at line breaks and at sentence ends before a capital letter. Word uni- and bigrams of a
paragraph are a sparse vector over the vocabulary of the training rows, and a multinomial logistic regression names its
licence family or ``none``. Training rows are made from written notices of each family (the templates, with words left
out in a repeatable way), from sentences that only speak of licences, and from paragraphs of a bounded sample of the
corpus that share no three words in a row with a notice. A quarter of the notices, sentences and paragraphs is held out with
all its variants: on it the temperature of the probabilities is chosen, and the least probability at
which accepted families are right, with notices of families that the classifier does not know among the rows. The classifier
that serves is then fitted on all rows.

A paragraph is of a family if its calibrated probability reaches that bound and a template of the family confirms it: the
paragraph holds most of the template's word trigrams (of shorter templates, of its words), or most of its own trigrams are
the template's, as those of a wrapped notice's lines. Whatever else is not ``none``
is of the class ``unknown``. No paragraph is left out, and all texts are read whole: a paragraph goes past the classifier only
where the classifier's own weights prove that it calls it ``none`` (``Model.open``).

Null and empty texts have no paragraphs and no licences. One row comes out for each row that goes in, rows that repeat an
id or have a null id too. Ties of probability go to the family named first. The counts that leave a task are one row a
document, so no key is hot.
"""

import math

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblens.llm.common import keep

# Notices of each family, as their licensors word them.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache 2.0 license.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; Licensed under CC BY-SA 4.0.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 3.0, for noncommercial use only.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "proprietary": [
        "Copyright by the author. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This software is proprietary and confidential; unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}
#: Notices of families that the classifier does not know; they only calibrate.
OTHERS = [
    "Licensed under the Eclipse Public License, version 2.0.",
    "Released under the zlib license.",
    "This font is licensed under the SIL Open Font License, version 1.1.",
    "Distributed under the Boost Software License, version 1.0.",
    "Licensed under the Artistic License, version 2.0.",
    "Data made available under the Open Database License.",
]
#: Sentences that speak of licences and grant none.
MENTIONS = [
    "He lost his driving licence after the accident last year.",
    "The licence fee will rise again in April, the minister said.",
    "The author takes some poetic license with the order of events.",
    "The warranty covers the battery for two years from the date of purchase.",
    "Students learn about copyright law and the public domain in the second term.",
    "You need written permission from a parent to join the trip.",
    "The general public was not admitted to the hearing.",
    "Their new version sold two million copies in a week.",
    "A software company sued its former partner over the distribution of profits.",
    "The council may refuse a liquor license without giving reasons.",
]
#: Variants of each notice; documents of the corpus sample and the most paragraphs taken from them; size of the vocabulary.
VARIANTS, SAMPLE_DOCS, SAMPLE_PARAGRAPHS, VOCABULARY = 12, 400, 3000, 16384
#: Share of a template that confirms, and the precision that calibration asks for.
CONFIRMS, PRECISION = 0.6, 0.99
NONE = "none"
WORD = r"[\p{L}\p{N}]+(?:[.+][\p{N}]+)*"


def paragraphs(text: Column) -> Column:
    """A line that goes on with a small letter or a bracket, after comment signs at most, is one with the line before."""
    unwrapped = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<!\n)\r?\n[ \t*#/]*(?=[\p{Ll}(])", " ")
    return F.filter(F.split(unwrapped, r"[\r\n]+|(?<=[.!?;])\s+(?=\p{Lu})"), lambda p: F.length(p) > 0)


def words(paragraph: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(paragraph, F.lit(""))), F.lit(WORD), F.lit(0))


def grams(w: Column, n: int) -> Column:
    """The n-grams of words; none of fewer words."""
    starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))


def terms(w: Column) -> Column:
    """Unigrams and bigrams, by shifting the words against themselves."""
    pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(w, pairs)


def confirming(w: Column) -> Column:
    return F.array_distinct(F.when(F.size(w) >= 5, grams(w, 3)).otherwise(w))


def written(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """(family, text) of fixed rows, made in the JVM."""
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(t).alias("text")) for f, t in texts])))


def training(docs: DataFrame) -> DataFrame:
    """(family, terms, calibrate): notices with some words left out, mentions, and paragraphs of the corpus sample."""
    spark = docs.sparkSession
    notices = [(f, t) for f, ts in TEMPLATES.items() for t in ts] + [("", t) for t in OTHERS] + [(NONE, t) for t in MENTIONS]
    rows = written(spark, notices).select("family", F.explode(paragraphs(F.col("text"))).alias("text")).withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
    # Variant 0 is whole; the others lose up to a sixth of their words.
    lost = lambda x, i: F.pmod(F.xxhash64(x, i, F.col("variant")), F.lit(100)) >= F.pmod(F.col("variant"), F.lit(4)) * 5
    rows = rows.select("family", F.filter(words(F.col("text")), lost).alias("w"), (F.pmod(F.xxhash64("text"), F.lit(4)) == 0).alias("calibrate"))
    ids = docs.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).distinct()  # SAMPLE_DOCS ids at most
    plain = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(F.explode(paragraphs(F.col("text"))).alias("text"))
    # What shares three words in a row with a notice may be one, and is no example of none.
    told = written(spark, notices).where(F.col("family") != NONE).select(F.explode(paragraphs(F.col("text"))).alias("text"))
    # The words are kept before more is made of them, or they would be cut out for each use.
    told, plain = (keep(df.distinct().select("text", words(F.col("text")).alias("w"))) for df in (told, plain))
    known = sorted({g for r in told.select(confirming(F.col("w")).alias("g")).collect() for g in r.g})  # of the notices above
    plain = plain.where(~F.arrays_overlap(confirming(F.col("w")), F.array(*map(F.lit, known))))
    plain = plain.orderBy(F.xxhash64("text"), "text").limit(SAMPLE_PARAGRAPHS).select(F.lit(NONE).alias("family"), "w", (F.pmod(F.xxhash64("text"), F.lit(4)) == 0).alias("calibrate"))
    return keep(rows.where("family <> '' or calibrate").union(plain).where(F.size("w") > 0).select("family", terms(F.col("w")).alias("terms"), "calibrate"))


class Model:
    """What the scan needs: vocabulary, classifier, temperature and least probability."""

    def __init__(self, vocabulary: CountVectorizerModel, classifier: LogisticRegressionModel, temperature: float, least: float):
        self.vocabulary, self.classifier, self.temperature, self.least = vocabulary, classifier, temperature, least

    def logits(self, rows: DataFrame) -> DataFrame:
        """Rows (terms, ...) with the array ``z`` of raw scores in the order of the classes."""
        return self.classifier.transform(self.vocabulary.transform(rows)).withColumn("z", vector_to_array("rawPrediction")).drop("features", "rawPrediction", "probability", "prediction")

    def gains(self) -> tuple[float, dict[str, float]]:
        """What the best family has over ``none`` at most: without words, and more by each word that can add to it.

        A word's part is the most that it and a pair beginning with it can add, and never less than 0.
        """
        c, b = self.classifier.coefficientMatrix.toArray(), self.classifier.interceptVector.toArray()
        own, pairs = {}, {}
        for term, gain in zip(self.vocabulary.vocabulary, (c[:-1] - c[-1]).max(axis=0), strict=True):
            if gain > 0:
                first, _, second = term.partition(" ")
                into = pairs if second else own
                into[first] = max(into.get(first, 0.0), float(gain))
        return float((b[:-1] - b[-1]).max()), {w: own.get(w, 0.0) + pairs.get(w, 0.0) for w in sorted({*own, *pairs})}

    def open(self, rows: DataFrame) -> DataFrame:
        """Rows (w, ...) with ``open``, whether the classifier may call the words other than ``none``; false proves that it does not."""
        start, parts = self.gains()
        adding = CountVectorizerModel.from_vocabulary([*parts] or [NONE], inputCol="w", outputCol="_adding")
        v, part = F.unwrap_udt("_adding"), F.array(*[F.lit(x) for x in parts.values()] or [F.lit(0.0)])
        more = F.zip_with(v["indices"], v["values"], lambda i, n: n * F.get(part, i))
        most = F.when(F.size(v["indices"]) > 0, F.aggregate(more, F.lit(start), lambda a, x: a + x)).otherwise(start)
        return adding.transform(rows).withColumn("open", most >= -1e-6).drop("_adding")


def classes() -> list[str]:
    return [*TEMPLATES, NONE]


def best(z: Column) -> Column:
    """The class of the greatest raw score, from 0; of equal ones the first."""
    return F.array_position(z, F.array_max(z)).cast("int") - 1


def chance(z: Column, of: Column, temperature: float) -> Column:
    """The share that softmax over a temperature gives a raw score."""
    return 1.0 / F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(F.least((x - of) / temperature, F.lit(700.0))))


def fit(docs: DataFrame) -> Model:
    rows = training(docs)
    index = F.array_position(F.array(*[F.lit(c) for c in classes()]), F.col("family")).cast("double") - 1
    rows = rows.withColumn("label", index)
    vocabulary = CountVectorizer(inputCol="terms", outputCol="features", vocabSize=VOCABULARY, minDF=1.0, binary=True).fit(rows.where("family <> ''"))
    learner = LogisticRegression(family="multinomial", regParam=3e-4, maxIter=60, standardization=False, probabilityCol="probability")
    fitted = lambda part: learner.fit(vocabulary.transform(part).select("label", "features").coalesce(1))
    model = Model(vocabulary, fitted(rows.where("not calibrate")), 1.0, 0.5)
    held = keep(model.logits(rows.where("calibrate")).select("label", "z"))
    grid = [0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]
    own = F.element_at("z", F.col("label").cast("int") + 1)
    losses = [F.sum(-F.log(F.greatest(chance(F.col("z"), own, t), F.lit(1e-12)))).alias(f"t{i}") for i, t in enumerate(grid)]
    got = held.where("label >= 0").agg(*losses).first()
    model.temperature = min(grid, key=lambda t: (got[grid.index(t)] if got[grid.index(t)] is not None else math.inf, t))
    called = held.select(best(F.col("z")).alias("c"), "label", chance(F.col("z"), F.array_max("z"), model.temperature).alias("p")).where(F.col("c") < len(TEMPLATES))
    steps = [x / 100 for x in range(30, 100, 3)]
    right = called.agg(*[F.avg(F.when(F.col("p") >= s, (F.col("c") == F.col("label")).cast("double"))).alias(f"s{i}") for i, s in enumerate(steps)]).first()
    model.least = next((s for s, x in zip(steps, right, strict=True) if x is not None and x >= PRECISION), steps[-1])
    model.classifier = fitted(rows.where("family <> ''"))
    return model


def templates(spark: SparkSession) -> DataFrame:
    """(family, shapes): what confirms each family, of fixed size."""
    rows = written(spark, [(f, t) for f, ts in TEMPLATES.items() for t in ts]).select("family", F.explode(paragraphs(F.col("text"))).alias("text"))
    return rows.groupBy("family").agg(F.collect_list(confirming(words(F.col("text")))).alias("shapes"))


def judged(rows: DataFrame, model: Model) -> DataFrame:
    """Rows (paragraph, ...) with ``family`` (a family, unknown or none), ``chance`` and ``confirmed`` (share of a template)."""
    # The words are a column of their own: written into what is made of them, they would be cut out again for each use.
    w = F.col("w")
    scored = model.logits(rows.withColumn("w", words(F.col("paragraph"))).withColumn("terms", terms(w))).drop("terms")
    scored = scored.withColumn("guess", F.element_at(F.array(*[F.lit(c) for c in classes()]), best(F.col("z")) + 1))
    # Almost all paragraphs are of no family, and need no probability and no template.
    scored = scored.withColumn("chance", F.when(F.col("guess") != NONE, chance(F.col("z"), F.array_max("z"), model.temperature))).drop("z")
    scored = scored.join(F.broadcast(templates(rows.sparkSession)).withColumnRenamed("family", "guess"), "guess", "left")
    shape = confirming(w)
    both = lambda t: F.size(F.array_intersect(t, shape))
    # A line of a wrapped notice holds a part of the template and little else.
    own = lambda t: F.when(F.size(w) >= 5, both(t) / F.size(shape)).otherwise(0.0)
    share = lambda t: F.greatest(both(t) / F.size(t), F.size(F.array_intersect(t, F.array_distinct(w))) / F.size(t), own(t))
    scored = scored.withColumn("confirmed", F.when(F.col("guess") != NONE, F.coalesce(F.array_max(F.transform("shapes", share)), F.lit(0.0)))).drop("shapes")
    sure = (F.col("chance") >= model.least) & (F.col("confirmed") >= CONFIRMS)
    return scored.withColumn("family", F.when(F.col("guess") == NONE, NONE).when(sure, F.col("guess")).otherwise("unknown")).drop("guess", "w")


def license_scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_judged, n_licenses, n_unknown, families, chance) of documents (doc_id, text).

    n_judged: all paragraphs, each of which the classifier judges; families: the confirmed families by name, comma-joined;
    chance: the greatest calibrated one of a confirmed family, or null.
    """
    model = model or fit(docs)
    cut = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", paragraphs(F.col("text")).alias("ps"))
    # Counted before it is taken apart, or each paragraph would carry its document's whole list.
    cut = cut.select("row", "doc_id", F.size("ps").alias("n_judged"), "ps")
    rows = cut.select("row", "doc_id", "n_judged", F.posexplode_outer("ps").alias("at", "paragraph"))
    # The first paragraph stays for its document's row; the others that are proven none add nothing to it.
    rows = model.open(rows.withColumn("w", words(F.col("paragraph")))).where("open or at is null or at = 0").drop("open", "at", "w")
    told = judged(rows, model)
    known = ~F.col("family").isin(NONE, "unknown")
    by_row = told.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_judged").cast("long").alias("n_judged"),
        F.count(F.when(known, 1)).alias("n_licenses"),
        F.count(F.when(F.col("family") == "unknown", 1)).alias("n_unknown"),
        F.array_join(F.array_sort(F.collect_set(F.when(known, F.col("family")))), ",").alias("families"),
        F.max(F.when(known, F.round("chance", 6))).alias("chance"),
    )
    return by_row.drop("row")
