"""Licence families of the paragraphs of a text, with Spark's own functions only.

Every paragraph (line) is read as windows of words. Hashed word unigrams and
bigrams, those that some notice has, go into a multinomial logistic regression
over the licence families and `unknown`, trained here: on the notices below,
cut, thinned and set between words of the corpus, and on look-alikes and two
thirds of all windows of the corpus as `unknown`. The other third sets the least
probability at which a family counts, so that `unknown` is calibrated to this
corpus. Windows with the same n-grams are one weighted example, so no window is
left out and few rows are kept. A prediction is confirmed by comparison with the
family's notices: the share of a notice's bigrams that the window has.

Cases: null and empty texts and paragraphs without a word have no window and no
family. A paragraph may name several families; each is reported. Repeated rows
are reported each. On an empty table the look-alikes are the only `unknown`
examples. Further columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskloom import fixed

from . import common

UNKNOWN = "unknown"
FEATURES = 1 << 14  # hashed n-grams
WINDOW, STEP = 32, 16  # words
BALANCE = 4.0  # weight of all windows of the corpus, for 1 of the notices' examples
FILLERS = 12  # texts of the corpus that notices are set between
BINS = 10_000  # of probabilities, for calibration
ALARM = 0.999  # share of calibration windows that must stay below the least probability
SIMILAR = 0.6  # share of a notice's bigrams that confirms a family

# Public licence notices by family.
NOTICES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache 2.0 license.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This software is licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GPL version 2.",
        "Released under the GNU GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the LGPL.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is licensed under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "Released under the AGPL.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form without prior written permission.",
        "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited.",
    ],
}

# Look-alikes: our own sentences that use the words of licences without being one.
LOOKALIKES = [
    "She got her driving licence last summer and bought a small car.",
    "The city issues a fishing license to any person over the age of sixteen.",
    "The general public was invited to the opening of the library.",
    "He studied at MIT and later worked in software for a bank.",
    "The Apache people lived in the southwest of the continent.",
    "Version 2.0 of the program brings a new menu and fewer errors.",
    "You may not use this door except in an emergency.",
    "Please read the terms and conditions of your travel insurance.",
    "The restaurant lost its liquor license after the inspection.",
    "A copy of the report can be found in the file on the desk.",
    "The public foundation gave free meals to every school in the district.",
    "Copyright law was the subject of the second lecture.",
    "The warranty of the washing machine covers any kind of defect.",
    "All seats are reserved for members of the club.",
    "The gnu is a large antelope of the African plains.",
    "Creative people often work better without restrictions.",
]


def words(text: Column) -> Column:
    """Lower-case words; ASCII signs and blanks part them."""
    return F.filter(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda word: word != "")


def local(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """(family, text) from literals, without any Python on the executors."""
    made = F.array(*[F.struct(F.lit(family).alias("family"), F.lit(text).alias("text")) for family, text in rows])
    return spark.range(1, numPartitions=1).select(F.explode(made).alias("row")).select("row.*")


def notices(spark: SparkSession) -> DataFrame:
    rows = [(family, text) for family, texts in NOTICES.items() for text in texts]
    return local(spark, rows).select("family", words(F.col("text")).alias("words"))


def terms(spark: SparkSession) -> list[str]:
    """The n-grams that tell families: words and word pairs of the notices, but no lone stop word."""
    paired = NGram(n=2, inputCol="words", outputCol="pairs").transform(notices(spark))
    rows = paired.select(F.explode(F.concat("words", "pairs")).alias("term")).distinct().collect()
    return sorted({row["term"] for row in rows} - set(fixed.STOP_WORDS))


def known(grams: Column, among: list[str]) -> Column:
    """The n-grams, null where they aren't among the given ones."""
    return F.transform(grams, lambda gram: F.when(gram.isin(among), gram))


def pairs(all_words: str) -> Column:
    """Pairs of neighbouring words; the last word has none and gives null."""
    after = F.slice(all_words, 2, F.size(all_words))
    return F.zip_with(all_words, after, lambda word, following: F.concat(word, F.lit(" "), following))


def grams(own_words: Column, own_pairs: Column) -> Column:
    """The different n-grams of words and pairs that aren't null, in order."""
    return F.sort_array(F.array_distinct(F.array_compact(F.concat(own_words, own_pairs))))


def windows(documents: DataFrame, among: list[str] | None = None) -> DataFrame:
    """(id, paragraph, first, words): every paragraph as windows of words that overlap by half.

    With n-grams given, `grams` has those of them that a window has.
    """
    # Outer explodes and single steps: otherwise Spark works out the words several times.
    lines = documents.select("id", F.posexplode_outer(F.split("text", "\n")).alias("paragraph", "line"))
    split = lines.select("id", "paragraph", words(F.col("line")).alias("all"))
    many = F.greatest(F.lit(0), F.ceil((F.size("all") - WINDOW) / STEP)).cast("int")
    starts = F.when(F.size("all") > 0, F.transform(F.sequence(F.lit(0), many), lambda i: i * STEP))
    # Looked up once a line, as each word is in two windows.
    looked = [] if among is None else [known(F.col("all"), among).alias("one"), known(pairs("all"), among).alias("two")]
    each = split.select("*", starts.alias("starts"), *looked)
    each = each.select("*", F.explode_outer("starts").alias("first")).filter("first IS NOT NULL")
    cut = lambda name, size: F.slice(name, F.col("first") + 1, size)
    own = [] if among is None else [grams(cut("one", WINDOW), cut("two", WINDOW - 1)).alias("grams")]
    return each.select("id", "paragraph", "first", cut("all", WINDOW).alias("words"), *own)


def read(documents: DataFrame) -> DataFrame:
    """(id, paragraph, first, grams) of every window, written: fit and scan both use it."""
    found = windows(documents, terms(documents.sparkSession)).select("id", "paragraph", "first", "grams")
    return common.stage(found, "licence-windows")


def with_grams(df: DataFrame, among: list[str]) -> DataFrame:
    """Adds `grams` for the column `words`."""
    return df.withColumn("grams", grams(known(F.col("words"), among), known(pairs("words"), among)))


def features(df: DataFrame) -> DataFrame:
    """Adds the hashed `features` of the column `grams`."""
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(df)


def positives(spark: SparkSession, fillers: DataFrame) -> DataFrame:
    """(family, words): notices whole, thinned, cut to windows, and between words of the corpus."""
    own = notices(spark)
    seed = own.select("family", "words", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("seed"))
    thinned = F.filter(
        "words", lambda word, i: (F.pmod(F.xxhash64(word, i, "seed"), F.lit(12)) > 0) | (F.col("seed") == 0)
    )
    made = seed.select("family", "seed", thinned.alias("words"))
    around = fillers.select("turn", F.slice("words", 1, 24).alias("filler"))
    number = F.pmod(F.xxhash64("words", "seed"), F.lit(FILLERS)).cast("int")
    # One filler per row, found by its number: a join of two bounded tables.
    set_in = made.withColumn("turn", number).join(around, "turn")
    before = F.slice("filler", 1, F.col("seed") * 2 + 1)
    after = F.slice("filler", F.col("seed") * 2 + 2, 24)
    embedded = set_in.select("family", F.concat(before, "words", after).alias("words"))
    return made.select("family", "words").union(embedded).select("family", F.slice("words", 1, 2 * WINDOW).alias("words"))


class Classifier:
    """The fitted regression, its classes and n-grams, and the least probability of a family."""

    def __init__(self, fitted: LogisticRegressionModel, classes: list[str], among: list[str], least: float):
        self.fitted, self.classes, self.among, self.least = fitted, classes, among, least

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds `family` and `probability` of the likeliest family by `grams`, without regard to `least`."""
        scored = self.fitted.transform(features(df))
        chances = vector_to_array("probability")
        known = F.slice(chances, 2, len(self.classes) - 1)
        scored = scored.withColumn("chances", known).withColumn("chance", F.array_max("chances"))
        names = F.array(*[F.lit(name) for name in self.classes[1:]])
        family = F.element_at(names, F.array_position("chances", F.col("chance")).cast("int"))
        named = scored.withColumn("family", family)
        dropped = named.drop("rawPrediction", "prediction", "features", "chances", "probability")
        return dropped.withColumnRenamed("chance", "probability")


def counted(looked: DataFrame) -> DataFrame:
    """(kept_out, grams, n): how many of the windows that read gives have the same n-grams.

    A third of the windows, chosen by a hash, is kept out of training. Windows that are
    much like a notice don't count.
    """
    place = F.xxhash64("id", "paragraph", "first")
    each = looked.select((F.pmod(place, F.lit(3)) == 0).alias("kept_out"), "grams")
    found = common.stage(each.groupBy("kept_out", "grams").agg(F.count("*").alias("n")), "licence-counts")
    every = F.concat(*bigrams(looked.sparkSession).values())
    return found.filter(similarity(every) < 0.3)


def fillers(documents: DataFrame, among: list[str]) -> DataFrame:
    """(turn, words): windows of the corpus to set notices between, a few by a hash of the id."""
    turn = F.pmod(F.xxhash64("id"), F.lit(1009)).cast("int")
    picked = windows(documents.filter(turn < FILLERS), among).select(turn.alias("turn"), "words", "grams")
    every = F.concat(*bigrams(documents.sparkSession).values())
    plain = common.stage(picked, "licence-fillers").filter(similarity(every) < 0.3)
    return plain.groupBy("turn").agg(F.min("words").alias("words"))


def fit(documents: DataFrame, looked: DataFrame | None = None) -> Classifier:
    """Classifier for a corpus of rows (id, text); looked: what read gives for it, if there already.

    `unknown` is learned from two thirds of all windows, and the least probability is set on
    the others; windows that are much like a notice are left out.
    """
    spark = documents.sparkSession
    among = terms(spark)
    plain = counted(read(documents) if looked is None else looked)
    examples = with_grams(positives(spark, fillers(documents, among)), among).select("family", "grams")
    examples = common.stage(examples, "licence-examples")
    other = local(spark, [(UNKNOWN, text) for text in LOOKALIKES]).select("family", words(F.col("text")).alias("words"))
    other = examples.union(with_grams(other, among).select("family", "grams")).withColumn("weight", F.lit(1.0))
    learned = plain.filter("NOT kept_out")
    total = learned.agg(F.sum("n")).first()[0] or 1
    weight = F.col("n") * F.lit(BALANCE * examples.count() / total)
    classes = [UNKNOWN, *sorted(NOTICES)]
    number = F.array_position(F.array(*[F.lit(name) for name in classes]), F.col("family")) - 1
    rows = other.union(learned.select(F.lit(UNKNOWN).alias("family"), "grams", weight.alias("weight")))
    rows = features(rows).select("features", number.cast("double").alias("label"), "weight")
    rows = common.stage(rows, "licence-training")
    fitted = LogisticRegression(
        family="multinomial", regParam=1e-3, maxIter=60, standardization=False, weightCol="weight"
    ).fit(rows)
    model = Classifier(fitted, classes, among, 0.5)
    model.least = least_probability(model.predict(plain.filter("kept_out")))
    return model


def least_probability(predicted: DataFrame) -> float:
    """The least probability of a family, by how many windows (n) have which `probability`."""
    bin_of = F.floor(F.col("probability") * BINS)
    bins = predicted.groupBy(bin_of.alias("bin")).agg(F.max("probability").alias("most"), F.sum("n").alias("n"))
    rows = bins.orderBy("bin").collect()  # BINS + 1 at most
    reached, bound = 0, ALARM * sum(row["n"] for row in rows)
    for row in rows:
        reached += row["n"]
        if reached >= bound:
            return min(max(0.5, row["most"]), 0.95)
    return 0.5


def bigrams(spark: SparkSession) -> dict[str, Column]:
    """Per family, the bigrams of each of its notices, as constants."""
    paired = NGram(n=2, inputCol="words", outputCol="own").transform(notices(spark))
    rows = paired.select("family", F.array_distinct("own").alias("own")).collect()  # the notices above
    constant = lambda own: F.array(*[F.lit(pair) for pair in own])
    return {name: F.array(*[constant(row["own"]) for row in rows if row["family"] == name]) for name in NOTICES}


def similarity(known: Column) -> Column:
    """The largest share of any notice's bigrams that the window has."""
    shares = F.transform(known, lambda own: F.size(F.array_intersect(own, "grams")) / F.size(own))
    return F.round(F.array_max(shares), 6)


def scan(documents: DataFrame, model: Classifier, looked: DataFrame | None = None) -> DataFrame:
    """(id, paragraph, first, family, probability, similarity, confirmed) of the windows of a family.

    Windows with the same n-grams have one prediction, so different n-grams are predicted once.
    """
    looked = read(documents) if looked is None else looked
    different = common.stage(looked.select("grams").distinct(), "licence-grams")
    judged = common.stage(model.predict(different).select("grams", "family", "probability"), "licence-families")
    constants = bigrams(documents.sparkSession)
    pairs = [part for name, own in constants.items() for part in (F.lit(name), own)]
    near = similarity(F.element_at(F.create_map(*pairs), F.col("family")))
    found = judged.filter(F.col("probability") >= model.least).withColumn("similarity", near)
    return looked.join(found, "grams").select(
        "id",
        "paragraph",
        "first",
        "family",
        "probability",
        "similarity",
        (F.col("similarity") >= SIMILAR).alias("confirmed"),
    )
