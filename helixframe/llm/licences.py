"""Licence scans with DataFrame functions only.

A passage is named by a logistic regression over its words and word pairs, trained here on variants of licence lines, on
sentences that only speak of licences, and on ordinary lines of the corpus; how sure it must be against the class 'unknown' is
calibrated on template lines that the calibrated fit hasn't seen. A prediction counts only if the passage also compares well
with a line of that family. Both have to agree, so the cheaper side goes first: places where a line's word pairs stand close
together are found, and the words there and around are what the classifier reads. Line ends are nothing but white space,
because licence texts are wrapped; sentence ends are words of their own, so that 'all rights reserved to the states' differs
from 'all rights reserved.'"""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, small_broadcasts, stash

UNKNOWN = "unknown"
# fixed values: characteristic lines of public licences, by family; disclaimers that many licences share are not among them
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MIT", "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This program is free software; you can redistribute it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("LGPL", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("LGPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("BSD", "Licensed under the BSD 3-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright (c) 2024 the authors. All rights reserved."),
    ("Proprietary", "No part of this publication may be reproduced, distributed or transmitted in any form or by any means without the prior written permission of the publisher."),
]
# fixed values: sentences that speak of licences, rights or their names without granting anything
ORDINARY = [
    "The driver showed a licence to the officer at the gate.", "The apache helicopter landed near the base.", "She studied at MIT and then moved to a public school.",
    "The general public was not allowed to enter.", "All rights of way must be kept clear.", "The free software meeting is on Tuesday.", "He holds a fishing license and a permit.",
    "The restaurant lost its license to serve wine.", "Human rights were discussed in the second part.", "The reserved seats are in the first row.", "Version 3 of the report is under review.",
    "This work is under way and will be released in May.", "The public license office opens at nine.", "The copy of the letter was distributed without permission.", "A new version 2.0 of the game was released.",
    "The project is under the terms of the agreement with the city.", "Mozilla and other browsers show this page.", "The bridge is provided as it is.",
    "The court held that the MIT license does not cover patents.", "Many companies avoid the GNU General Public License for fear of its terms.", "The Apache License was written by a foundation in the nineties.",
    "Lawyers argued about whether copyright law should be reformed.", "The treaty left all rights reserved to the states untouched.", "He explained how the BSD license differs from other licenses.",
    "The publisher gave permission to use a copy of the photograph.", "Critics say the license is unclear about the use of source code.", "A permission notice was posted at the door of the town hall.",
    "The author waived the fee and released the song to the public.", "The library changed its license from one year to the next.", "The software was distributed on disks with the magazine.",
    "The Free Software Foundation published a statement about phones.", "Creative Commons held its summit in Lisbon this year.", "The bank was granted a license to operate in the region.",
    "The hotel had all tables reserved for the wedding.", "Copyright holders asked the platform to remove the films.", "Redistribution of wealth was the subject of the debate.",
    "The conditions of use are printed on the back of the ticket.", "Under the license the club may sell drinks until midnight.", "The general license fee for television rises in spring.", "Version 2 of the plan was rejected by the council.",
]
#: Ordinary lines come from so many documents, those with the lowest hashes of their ids; n-grams that are features.
BACKGROUND, VOCABULARY = 400, 8192
#: The calibration comes from so many fits, each scored on the template lines and sentences that it hasn't seen.
FOLDS = 3
#: The end of a sentence as a word.
STOP = "¶"
#: The classifier reads a place and so many words before and after it.
AROUND = 8
_CELL = 256


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits, and STOP for the end of a sentence."""
    ended = F.regexp_replace(text, "[.!?]+[\"'”’)\\]]*(?=\\s|$)", f" {STOP} ")
    return F.filter(F.split(F.lower(ended), rf"[^\p{{L}}\p{{N}}{STOP}]+"), lambda w: w != "")


def plain_words(text: str) -> list[str]:
    """words_of in the driver, for the fixed lines."""
    return [w for w in re.split(rf"[^0-9a-z{STOP}]+", re.sub("[.!?]+[\"')\\]]*(?=\\s|$)", f" {STOP} ", text).lower()) if w]


def plain_pairs(text: str) -> list[str]:
    """A line's different word pairs. A line that ends without a stop begins and ends anywhere."""
    w = plain_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


@lru_cache(maxsize=8)
def anchors(confirm: float) -> tuple[str, ...]:
    """Words of which every text has one that holds the share `confirm` of some line's pairs: in each line too few pairs are
    without any of them. Chosen greedily, the word that is missing in most lines' pairs first; function words aren't taken."""
    dull = set("a an and or of the to in is it its this that with without by for on at as be are any all no not may you can from under other do so if was has each used use".split()) | {STOP}
    open_ = [(set(p), math.ceil(confirm * len(p) - 1e-9)) for p in (plain_pairs(t) for _, t in TEMPLATES)]
    chosen: list[str] = []
    while True:
        open_ = [(p, need) for p, need in ((p, need) for p, need in open_) if len(p) >= need]
        gain: dict[str, int] = {}
        for p, _ in open_:
            for w in {w for pair in p for w in pair.split(" ")} - dull:
                if len(w) > 1 and w.isalpha():
                    gain[w] = gain.get(w, 0) + 1
        if not open_:
            return tuple(chosen)
        if not gain:
            raise ValueError("a line of nothing but function words has no anchor")
        long = {w: n for w, n in gain.items() if len(w) > 3} or gain  # short words are costlier to look for
        chosen.append(max(sorted(long), key=lambda w: (long[w], len(w))))
        open_ = [({pair for pair in p if chosen[-1] not in pair.split(" ")}, need) for p, need in open_]


def grams_of(words: Column) -> Column:
    """Words and pairs of neighbours."""
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.concat(words, F.coalesce(pairs, F.array().cast("array<string>")))


def _local(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small table of fixed size from the driver."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _training(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """family, grams, fold, hard: template lines whole, without their first or last word, in parts, and between ordinary words;
    sentences that only speak of licences, alone and between others; ordinary lines of the corpus. All variants of a line are in
    its fold. A corpus line that holds a third of some template line's pairs may be a licence and is no ordinary line."""
    place: dict[str, int] = {}
    rows = []
    for family, text in TEMPLATES:  # the lines of a family alternate between the folds
        place[family] = place.get(family, -1) + 1
        rows.append({"family": family, "line": text, "fold": place[family] % FOLDS})
    lines = _local(spark, rows, "family string, line string, fold int").withColumn("w", words_of(F.col("line")))
    n = F.size("w")
    step = F.greatest(F.lit(1), F.floor(n / 4).cast("int"))
    wide = F.greatest(F.least(n, F.lit(3)), F.ceil(n * 0.6).cast("int"))
    starts = F.sequence(F.lit(1), n - wide + 1, step)
    split = lambda text: F.split(F.lit(text), " ")
    variants = F.concat(
        F.array(F.col("w"), F.col("w"), F.concat(split("the"), "w"), F.concat(F.col("w"), split("see the file for more of this")), F.concat(split(f"copyright by the authors of this work {STOP}"), "w")),
        F.when(n >= 8, F.transform(starts, lambda s: F.slice("w", s, wide))).otherwise(F.array().cast("array<array<string>>")),
    )
    yes = lines.select("family", F.explode(variants).alias("w"), "fold", F.lit(False).alias("hard"))
    hard = _local(spark, [{"line": x, "fold": i % FOLDS} for i, x in enumerate(ORDINARY)], "line string, fold int").withColumn("w", words_of(F.col("line")))
    around = F.array(F.col("w"), F.concat(split(f"it was said on monday {STOP}"), "w"), F.concat("w", split(f"the meeting ended late {STOP}")))
    no = hard.select(F.lit(UNKNOWN).alias("family"), F.explode(around).alias("w"), "fold", F.lit(True).alias("hard"))

    few = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col), F.lit("background")).alias("_h"))
    cut = few.select("_h").orderBy("_h").limit(BACKGROUND).agg(F.max("_h")).first()[0]
    plain = few.where(F.col("_h") <= F.lit(cut if cut is not None else 0)).select("id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("id", "at", words_of(F.col("line")).alias("w")).where("size(w) > 2")
    pairs = _local(spark, [{"template": i, "n": len(p), "gram": g} for i, (_, t) in enumerate(TEMPLATES) for p in [plain_pairs(t)] for g in p], "template int, n int, gram string")
    like = plain.select("id", "at", F.explode(F.array_distinct(grams_of(F.col("w")))).alias("gram")).join(F.broadcast(pairs), "gram").groupBy("id", "at", "template").agg((F.count(F.lit(1)) / F.first("n")).alias("share")).where("share > 1 / 3D")
    plain = plain.join(like.select("id", "at").distinct(), ["id", "at"], "left_anti")
    # a line goes into rows of the size of a place, so that none is cut and none outweighs the others
    parts = F.transform(F.sequence(F.lit(1), F.size("w"), F.lit(64)), lambda s: F.slice("w", s, 64))
    plain = plain.select(F.lit(UNKNOWN).alias("family"), F.explode(parts).alias("w"), F.pmod(F.xxhash64("id", "at"), F.lit(FOLDS)).cast("int").alias("fold"), F.lit(False).alias("hard"))
    return yes.unionByName(no).unionByName(plain).select("family", grams_of(F.col("w")).alias("grams"), "fold", "hard")


def train(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str], list[float], tuple[float, float]]:
    """The weights (gram, w: one number per family), the families, their intercepts and the calibration's slope and shift.

    The calibration, of whether a passage is of a licence at all, comes from FOLDS fits, each scored on the template lines and
    sentences that it hasn't seen in any variant; the weights come from one more fit on all. The fit is bounded by BACKGROUND
    documents, whose lines are all used and used whole."""
    small_broadcasts(spark)
    rows = stash(_training(spark, docs, id_col, text_col).coalesce(4), "licence_rows")
    families = sorted({f for f, _ in TEMPLATES}) + [UNKNOWN]
    label = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")).cast("double") - 1
    n, strange, tough = rows.agg(F.count(F.lit(1)), F.sum((F.col("family") != UNKNOWN).cast("long")), F.sum(F.col("hard").cast("long"))).first()
    weight = F.when(F.col("family") != UNKNOWN, F.lit(max(1.0, 0.5 * n / strange))).when(F.col("hard"), F.lit(max(1.0, 0.3 * n / tough))).otherwise(F.lit(1.0))
    rows = rows.withColumn("label", label).withColumn("weight", weight)
    counts = CountVectorizer(inputCol="grams", outputCol="x", binary=True, vocabSize=VOCABULARY, minDF=1.0).fit(rows.where((F.col("family") != UNKNOWN) | F.col("hard")))
    # single words that the corpus' ordinary lines use as well say little and occur everywhere: they are no features
    single = F.broadcast(_local(spark, [{"g": g} for g in counts.vocabulary if " " not in g], "g string"))
    common = rows.where((F.col("family") == UNKNOWN) & ~F.col("hard")).select(F.explode(F.array_distinct("grams")).alias("g")).join(single, "g").groupBy("g").count().where("count > 1").select("g")
    common = {r.g for r in common.collect()} | {STOP}  # part of the vocabulary
    counts = type(counts).from_vocabulary([g for g in counts.vocabulary if g not in common], inputCol="grams", outputCol="x").setBinary(True)
    x = stash(counts.transform(rows).select("x", "label", "weight", "fold").coalesce(1), "licence_features")
    fit = lambda part: LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", family="multinomial", regParam=1e-4, maxIter=25).fit(part)
    raw = vector_to_array(F.col("rawPrediction"))
    best = F.array_max(F.slice(raw, 1, len(families) - 1))
    margin = (best - F.element_at(raw, -1)).alias("margin")
    right = (F.col("label") < len(families) - 1).cast("double").alias("label")
    held = None
    for k in range(FOLDS):
        one = fit(x.where(F.col("fold") != k)).transform(x.where(F.col("fold") == k)).select(margin, right, "weight")
        held = one if held is None else held.unionByName(one)
    platt = LogisticRegression(featuresCol="m", labelCol="label", weightCol="weight", regParam=1e-3, maxIter=50).fit(VectorAssembler(inputCols=["margin"], outputCol="m").transform(held))
    model = fit(x)
    matrix = model.coefficientMatrix.toArray()
    weights = _local(spark, [{"gram": g, "w2": matrix[:, i].tolist()} for i, g in enumerate(counts.vocabulary)], "gram string, w2 array<double>")
    return stash(weights, "licence_weights"), families, model.interceptVector.toArray().tolist(), (float(platt.coefficients[0]), float(platt.intercept))


def _names(lines: list[tuple[str, str]]) -> list[str]:
    """Pairs of words that tell nothing about a family: more than three have them, and they hold no number."""
    seen: dict[str, set[str]] = {}
    for family, text in lines:
        for g in plain_pairs(text):
            seen.setdefault(g, set()).add(family)
    return [g for g, f in seen.items() if len(f) > 3 and not re.search(r"\d", g)]


def _grams(docs: DataFrame, confirm: float, id_col: str, text_col: str) -> DataFrame:
    """row, id, at (the word's place in the text), line and gram, for the words and pairs of rows that have an anchor. Pairs run
    across line ends; a line end may also end a sentence, so the last word of a line has the pair with STOP too. An empty line
    is a STOP. In SPDX expressions each alternative is read with the tag before it."""
    text = F.col(text_col).cast("string")
    known = anchors(confirm)
    short = "|".join(a for a in known if len(a) <= 3)

    def anchored(low: Column) -> Column:
        some = F.lit(False)
        for a in known:
            some = some | low.contains(a) if len(a) > 3 else some
        hit = F.lit(False)
        for a in known:
            hit = hit | low.contains(a) if len(a) <= 3 else hit
        return some | (hit & low.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{short})(?![\p{{L}}\p{{N}}])")) if short else some

    some = F.exists(F.array(F.lower(text)), anchored)  # an array of one, so that the text is lowered once and not for each anchor
    low = F.lower(text)
    spdx = F.regexp_replace(text, r"(?i)[ \t]+(?:or|and)[ \t]+\(?(?<=spdx-license-identifier:[ \tA-Za-z0-9.+()-]{1,200})", " SPDX-License-Identifier: ")
    rows = docs.where(text.isNotNull() & some).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.when(low.contains("spdx-license-identifier"), spdx).otherwise(text).alias("text"))
    rows = rows.select("row", "id", F.transform(F.split("text", "\n"), lambda t: F.when(F.trim(t) == "", F.array(F.lit(STOP))).otherwise(words_of(t))).alias("lines"))
    rows = rows.select("row", "id", F.flatten("lines").alias("w"), F.flatten(F.transform("lines", lambda x, i: F.array_repeat(i, F.size(x)))).alias("l"))
    tail = lambda c: F.slice(c, F.lit(2), F.size(c))
    rows = rows.where("size(w) > 0").select("row", "id", F.posexplode(F.arrays_zip("w", "l", tail(F.col("w")).alias("v"), tail(F.col("l")).alias("m"))).alias("at", "x"))
    word, after = F.col("x.w"), F.col("x.v")
    last = F.col("x.m").isNull() | (F.col("x.m") != F.col("x.l"))
    ends = F.when(last & (word != STOP) & (after.isNull() | (after != STOP)), F.concat(word, F.lit(f" {STOP}")))
    three = F.array(word, F.concat(word, F.lit(" "), after), ends)
    return rows.select("row", "id", "at", F.col("x.l").alias("line"), F.explode(three).alias("gram")).where("gram is not null")


def _islands(df: DataFrame, key: list[str]) -> DataFrame:
    """df (lo, hi) with `island`, a number for each run of overlapping stretches of a key."""
    by = Window.partitionBy(*key).orderBy("lo", "hi")
    before = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("new", F.when(F.col("lo") <= before, 0).otherwise(1))
    return df.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def _cells(lo: Column, hi: Column) -> Column:
    return F.explode(F.sequence(F.floor(lo / _CELL).cast("int"), F.floor(hi / _CELL).cast("int")))


def find_licences(docs: DataFrame, confirm: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per licence found: id_col, paragraph (the number of the line, from 0, in which it begins), family, probability
    (calibrated, against 'unknown') and coverage (the share of a template line's word pairs that stand there).

    A place is a stretch of words that is at most a third longer than a template line and holds at least the share `confirm` of
    the line's pairs; line ends don't matter. Its family is reported if the classifier gives it a calibrated probability of one
    half at least, reading the place and AROUND words on either side. A place may name several families, but not one that has
    nothing there but what a better covered one's lines say too (CC BY in CC BY-NC). Places of a family that overlap are one.

    Null and empty texts have none; the same id may stand on several rows, which are read each for itself, as are rows without
    an id. Texts are read whole. Other columns are ignored; an empty table gives an empty result."""
    spark = docs.sparkSession
    weights, families, intercepts, (slope, shift) = train(spark, docs, id_col, text_col)
    made = [(i, f, plain_pairs(t), len(plain_words(t))) for i, (f, t) in enumerate(TEMPLATES)]
    lines = _local(spark, [{"template": i, "family": f, "pairs": len(p), "need": math.ceil(confirm * len(p) - 1e-9), "reach": n - 2 + max(1, n // 3), "gram": g} for i, f, p, n in made for g in p], "template int, family string, pairs int, need int, reach int, gram string")
    lines = stash(lines, "licence_lines")
    vocabulary = weights.select("gram").unionByName(lines.select("gram")).distinct()  # VOCABULARY and the templates at most
    met = stash(_grams(docs, confirm, id_col, text_col).join(F.broadcast(vocabulary), "gram"), "licence_grams")

    # places: the pairs of a line that stand close together, counted from each pair on
    hits = met.where(F.col("gram").contains(" ")).join(F.broadcast(lines), "gram")
    enough = hits.groupBy("row", "template").agg(F.count_distinct("gram").alias("n"), F.first("need").alias("need")).where("n >= need").select("row", "template")
    hits = hits.join(enough, ["row", "template"], "left_semi")
    # lines have different lengths; a frame is as long as the longest, and cut to the line's own
    longest = max(n - 2 + max(1, n // 3) for _, _, _, n in made)
    ahead = Window.partitionBy("row", "template").orderBy("at").rangeBetween(0, longest)
    near = hits.withColumn("near", F.collect_list(F.struct("at", "gram")).over(ahead))
    near = near.withColumn("near", F.filter("near", lambda x: x["at"] <= F.col("at") + F.col("reach")))
    near = near.withColumn("n", F.size(F.array_distinct(F.transform("near", lambda x: x["gram"])))).where("n >= need")
    near = near.select("row", "id", "template", "family", "line", F.col("at").alias("lo"), (F.array_max(F.transform("near", lambda x: x["at"])) + 1).alias("hi"), (F.col("n") / F.col("pairs")).alias("coverage"), F.col("n").alias("size"))
    best = F.max_by(F.struct("id", "template", "line", "lo", "hi", "coverage", "size"), F.struct("coverage", "size", -F.col("hi") + F.col("lo"), -F.col("template"))).alias("best")
    places = _islands(near, ["row", "family"]).groupBy("row", "family", "island").agg(best)
    places = stash(places.select("row", "family", "island", "best.*"), "licence_places")

    # sureness of each family from what stands there and around
    i = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")).cast("int")
    read = bounded(places).select("row", "family", "island", (F.col("lo") - AROUND).alias("from"), (F.col("hi") + AROUND).alias("to"))
    read = read.withColumn("cell", _cells(F.greatest("from", F.lit(0)), F.col("to")))
    inside = met.withColumn("cell", F.floor(F.col("at") / _CELL).cast("int")).join(F.broadcast(weights), "gram").join(read, ["row", "cell"]).where(F.col("at").between(F.col("from"), F.col("to")))
    inside = inside.groupBy("row", "family", "island", "gram").agg(F.first("w2").alias("w2"))
    margin = F.sum(F.element_at("w2", i) - F.element_at("w2", -1))
    start = F.element_at(F.array(*[F.lit(b) for b in intercepts]), i) - F.lit(intercepts[-1])
    sure = inside.groupBy("row", "family", "island").agg(margin.alias("margin")).withColumn("probability", 1 / (1 + F.exp(-(F.lit(slope) * (F.col("margin") + start) + F.lit(shift)))))
    named = stash(places.join(sure.where("probability >= 0.5").drop("margin"), ["row", "family", "island"]), "licence_named")

    # a family needs a telling pair that no line of a better covered family of an overlapping place has
    dull = F.array(*[F.lit(g) for g in _names(TEMPLATES)])
    own = lines.groupBy("family").agg(F.collect_set("gram").alias("all"))
    tells = lines.where(~F.array_contains(dull, F.col("gram"))).select("family", "gram")
    celled = named.withColumn("cell", _cells(F.col("lo"), F.col("hi")))
    told = celled.select("row", "family", "island", "cell", "lo", "hi").join(F.broadcast(tells), "family").join(met.select("row", "gram", "at", F.floor(F.col("at") / _CELL).cast("int").alias("cell")), ["row", "cell", "gram"])
    told = told.where(F.col("at").between(F.col("lo"), F.col("hi"))).groupBy("row", "family", "island").agg(F.collect_set("gram").alias("tells"))
    rank = F.struct("coverage", "size", "probability", "family")
    better = celled.select("row", "cell", F.col("family").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), rank.alias("above")).join(F.broadcast(own.withColumnRenamed("family", "other")), "other")
    worse = celled.withColumn("rank", rank).select("row", "family", "island", "cell", "lo", "hi", "rank").join(told, ["row", "family", "island"], "left")
    worse = worse.join(better, ["row", "cell"]).where((F.col("above") > F.col("rank")) & (F.col("lo") <= F.col("hi2")) & (F.col("lo2") <= F.col("hi")))
    worse = worse.where(F.size(F.array_except(F.coalesce("tells", F.array().cast("array<string>")), "all")) == 0).select("row", "family", "island").distinct()
    left = named.join(worse, ["row", "family", "island"], "left_anti")
    return left.select(F.col("id").alias(id_col), F.col("line").alias("paragraph"), "family", F.round("probability", 6).alias("probability"), F.round("coverage", 6).alias("coverage"))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of docs: id_col, n_paragraphs (lines; 0 for a null or empty text), n_licences (families found, by place),
    families (their names in order, joined by commas) and best_probability (0 without any). Rows with equal ids share what is
    found in any of them. See find_licences."""
    found = stash(find_licences(docs, id_col=id_col, text_col=text_col, **options), "licences")
    per = found.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("n"), F.concat_ws(",", F.sort_array(F.collect_set("family"))).alias("f"), F.max("probability").alias("p"))
    per = bounded(stash(per, "licence_ids"))
    text = F.col(text_col).cast("string")
    count = F.when(text.isNull() | (text == ""), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    out = docs.select(F.col(id_col), count.cast("long").alias("n_paragraphs")).join(per, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    return out.select(id_col, "n_paragraphs", F.coalesce("n", F.lit(0)).cast("long").alias("n_licences"), F.coalesce("f", F.lit("")).alias("families"), F.coalesce("p", F.lit(0.0)).alias("best_probability"))
