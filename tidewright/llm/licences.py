"""Licence scans: a trained paragraph classifier whose predictions are confirmed against templates.

Paragraphs are cut at blank lines once comment signs are taken off; wrapped lines are joined. Each sentence of a paragraph, and each side of an
"or" between two licence names, is judged for itself, so that a notice of two licences gives both. Features are single words and word
pairs after common words are dropped. A multinomial logistic regression over licence families and an unknown class is trained on
licence texts and notices, shortened and padded forms of them, and unrelated sentences that use the same words. Its
probabilities are calibrated by one temperature on other notices, which are worded anew and not trained on. A family is reported for a paragraph when its
calibrated probability reaches the threshold in one of its sentences and a template of it is alike enough, or, unconfirmed, when the
probability is near one and nothing else in the paragraph is confirmed. Scanning is DataFrame operations alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import query, read, texts_of

UNKNOWN = "unknown"
THRESHOLD = 0.5
LIKENESS = 0.6
SURE = 0.95  # probability from which an unconfirmed family is reported

STOP = (
    "a an and any are as at be by for from in is it its of on or that the their this to under was were with you your our we i "
    "not no all may can will shall if but these those such which who has have had do does"
).split()

# Sentences that name or state each family.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is distributed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "Apache License, Version 2.0",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version.",
        "Licensed under the GPL version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU General Public License v3.0 or later",
        "GNU General Public License version 3, 29 June 2007",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it under the terms of the GNU General Public License version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "Licensed under the GPL version 2.",
        "GNU General Public License v2.0 only",
        "GNU General Public License version 2, June 1991",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License.",
        "Licensed under the LGPL version 2.1 or later.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Licensed under the 3-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Mozilla Public License, version 2.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "cc0": (
        "Released under CC0 1.0.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
}
# Sentences about other things in words that licences use.
OTHER = (
    "A driving license is needed to rent a car.",
    "The general public was asked to use the other door.",
    "Version 3 of the report was released on Monday.",
    "Version 2 of the software was released without notice.",
    "The files and the associated documentation were lost.",
    "The company distributed free copies of the book.",
    "A person obtaining a permit must pay a charge.",
    "The creative team and the commons committee met.",
    "The work is subject to changes and later corrections.",
    "The source of the river is protected.",
    "Conditions in the later forms are restricted.",
    "Apache helicopters were seen over the Mozilla office.",
    "MIT is a university.",
    "The lesser clause was dropped by the library.",
    "Attribution of the painting is uncertain, and the universal share is binary.",
    "The project terms were permitted after compliance checks.",
    "Public domain and domain names are different matters.",
    "You can modify the program or the redistribution of seats.",
    "She was granted a license to fish, free of restriction.",
    "The international version has 4.0 liters and 2.0 liters of fuel, or 1.0 at least.",
)
# Notices worded anew, on which the probabilities are calibrated.
HELD_OUT = {
    "mit": (
        "Available under the terms of the MIT license, see the file LICENSE.",
        "Copyright 2019 the authors, MIT license.",
        "Permission is granted, free of charge, to any person obtaining a copy of this software to use, copy and modify the Software without restriction.",
    ),
    "apache-2.0": (
        "The code is available under the Apache License 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 and may not use this file except in compliance with it.",
    ),
    "gpl-3.0": (
        "You may copy this under the GNU General Public License, version 3 or any later version.",
        "Distributed under the terms of the GPL, version 3.",
    ),
    "gpl-2.0": (
        "You may copy this under the GNU General Public License, version 2.",
        "It can be modified under the terms of version 2 of the GNU General Public License.",
    ),
    "lgpl": ("You can use this library under the GNU Lesser General Public License, version 2.1.",),
    "bsd": ("Distributed under a BSD license.", "The sources may be used in source and binary forms provided that this list of conditions is retained, see the BSD license."),
    "mpl-2.0": ("Subject to the Mozilla Public License, see version 2.0 at mozilla.org.",),
    "cc-by-nc": ("The text is available under a Creative Commons Attribution NonCommercial license.",),
    "cc-by": ("The text is available under the Creative Commons Attribution 4.0 license.",),
    "cc-by-sa": ("The text is available under the Creative Commons Attribution ShareAlike license.",),
    "cc0": ("All rights are waived under CC0 1.0.",),
    UNKNOWN: (
        "I lost my license last year, and version 3 of the form is public.",
        "The general was asked about the free software of the public library.",
        "No charge is made to any person for a copy of the plan.",
        "The source of the noise was found in the binary star.",
        "A fisher without a license can not use the river.",
        "The foundation published version 2 of its yearly report.",
        "The apache people live under the laws of the state.",
        "They met at MIT to see the forms.",
    ),
}
# Words put around sentences so that the classifier learns to pass over what it does not know.
PADS = (("note", "readme"), ("section", "footer"), ("corpus", "item"), ("page", "end"))


def words_of(text: Column) -> Column:
    """Words and numbers in lower case."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def telling(words: Column) -> Column:
    """The words without the common ones."""
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOP))


def grams_of(words: Column) -> Column:
    """Distinct words and pairs of words."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>"))))


def paragraphs_of(text: Column) -> Column:
    """Paragraphs with their lines joined; comment signs at either end of a line do not count."""
    bare = F.regexp_replace(text, r"(?m)^[ \t]*(?:/\*+|\*+/|\*|//+|#+|--+|;+|%+|<!--)[ \t]*|(?:\*+/|-->)[ \t\r]*$", "")
    return F.transform(F.split(bare, r"\n[ \t\r]*\n+", -1), lambda p: F.regexp_replace(p, r"\s+", " "))


def sentences_of(paragraph: Column) -> Column:
    """Sentences, and the sides of an "or", "and" or slash in front of a licence name."""
    name = r"(?:the )?(?:mit|apache|bsd|gpl|lgpl|gnu|mpl|mozilla|cc0|cc|creative)\b"
    return F.split(paragraph, rf"(?<=[.!?])\s+(?=[\p{{Lu}}\"(\[])|(?i)\s+(?:or|and)\s+(?={name})|[/|]\s*(?={name})")


def _forms() -> list[tuple[str, str, bool]]:
    """`(family, sentence, held_out)`: templates whole, padded and cut by a word at either end; other notices are held out."""
    rows = []
    for family, sentences in [*TEMPLATES.items(), (UNKNOWN, OTHER)]:
        for sentence in sentences:
            parts = sentence.split()
            rows.append((family, sentence, False))
            rows += [(family, f"{a} {sentence} {b}", False) for a, b in PADS]
            if len(parts) > 6:
                rows += [(family, " ".join(parts[1:]), False), (family, " ".join(parts[:-1]), False)]
    rows += [(UNKNOWN, f"{a} {b}", False) for a, b in PADS]
    return rows + [(family, sentence, True) for family, sentences in HELD_OUT.items() for sentence in sentences]


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]  # gram to one weight for each family, known class last
    bias: tuple[float, ...]
    temperature: float
    threshold: float


def _softmax_regression(x: np.ndarray, y: np.ndarray, classes: int, penalty: float, rounds: int = 400) -> np.ndarray:
    """Weights with the bias in the last row, by gradient steps with momentum on the mean loss."""
    design = np.column_stack([x, np.ones(len(x))])
    weights, speed = np.zeros((design.shape[1], classes)), np.zeros((design.shape[1], classes))
    wanted = np.eye(classes)[y]
    ridge = np.full((design.shape[1], 1), penalty)
    ridge[-1] = 0.0
    for _ in range(rounds):
        z = design @ weights
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed - 0.3 * (design.T @ (p - wanted) / len(design) + ridge * weights)
        weights = weights + speed
    return weights


def train(spark: SparkSession, threshold: float = THRESHOLD, penalty: float = 0.0005) -> Model:
    """Fit on the forms that are not held out; the temperature minimises the loss on the held-out ones.

    The forms are a fixed list of a few hundred sentences. Spark cuts them into grams as it does the
    documents; the fit itself runs on the driver.
    """
    families = (*TEMPLATES, UNKNOWN)
    number = {f: i for i, f in enumerate(families)}
    listed = spark.createDataFrame([(number[f], s, h) for f, s, h in _forms()], "label int, text string, held boolean").coalesce(1)
    cut = listed.select("label", "held", F.explode(sentences_of(F.col("text"))).alias("sentence"))
    rows = cut.select("label", "held", grams_of(telling(words_of(F.col("sentence")))).alias("grams")).collect()
    # Words of the paddings are no features, so an unknown word never counts for or against a family.
    padding = {w for pair in PADS for w in pair}
    fit = [r for r in rows if not r["held"]]
    vocabulary = sorted({g for r in fit for g in r["grams"] if not padding & set(g.split(" "))})
    place = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(fit), len(vocabulary)))
    for i, r in enumerate(fit):
        x[i, [place[g] for g in r["grams"] if g in place]] = 1.0
    learned = _softmax_regression(x, np.array([r["label"] for r in fit]), len(families), penalty)
    weights = {g: tuple(float(w) for w in learned[i]) for g, i in place.items()}
    model = Model(families, weights, tuple(float(w) for w in learned[-1]), 1.0, threshold)
    held = [(r["label"], r["grams"]) for r in rows if r["held"]]

    def loss(temperature: float) -> float:
        total = 0.0
        for label, grams in held:
            z = [b + sum(weights[g][k] for g in grams if g in weights) for k, b in enumerate(model.bias)]
            z = [x / temperature for x in z]
            top = max(z)
            total += top + math.log(sum(math.exp(x - top) for x in z)) - z[label]
        return total

    steps = [0.25 * 1.1**k for k in range(31)]
    return Model(families, weights, model.bias, min(steps, key=loss), threshold)


def scan_licences(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, likeness: float = LIKENESS
) -> DataFrame:
    """One row for each paragraph and licence family in it: `doc_id, paragraph, family, probability, template, likeness, confirmed`.

    Paragraphs are counted from 0. `probability` is the calibrated one of the family in the sentence where it is highest; sentences for which the
    unknown class or no family reaches the threshold count for nothing. `template` is the text of the
    family that shares most grams, `likeness` the share of its grams that the paragraph holds, `confirmed` whether that reaches
    the bound. What is not confirmed is reported from a probability of `SURE`, where it is the surest in a paragraph without a confirmed family.
    Missing and empty texts have no paragraphs with words and give no rows; repeated rows are
    reported once each, a missing id stays missing; an empty table gives an empty result. Columns beyond id and text are not read.
    """
    spark = docs.sparkSession
    model = train(spark, threshold)
    families = model.families
    vocabulary = sorted({w for gram in model.weights for w in gram.split(" ")})
    cut = (
        texts_of(docs, id_col, text_col)
        .withColumn("row", F.monotonically_increasing_id())
        .select("doc_id", "row", F.posexplode(paragraphs_of(F.col("text"))).alias("paragraph", "line"))
        .select("doc_id", "row", "paragraph", F.posexplode(sentences_of(F.col("line"))).alias("sentence", "line"))
    )
    # A sentence without any word of the vocabulary has no features and is unknown. The explode keeps
    # Catalyst from working out the words anew wherever they are used.
    key = ["row", "paragraph", "sentence"]
    worded = cut.select("doc_id", *key, F.explode(F.array(words_of(F.col("line")))).alias("words")).filter(
        F.arrays_overlap("words", F.array(*[F.lit(w) for w in vocabulary]))
    )
    worded = worded.select("doc_id", *key, F.explode(F.array(telling(F.col("words")))).alias("words"))
    grams = worded.select("doc_id", *key, F.explode(grams_of(F.col("words"))).alias("gram"))
    # Tables of the model's own vocabulary: their size is fixed by the templates.
    weight_rows = [(g, list(w)) for g, w in model.weights.items()]
    weights = spark.createDataFrame(weight_rows, "gram string, weights array<double>")
    sums = [F.sum(F.col("weights")[k]).alias(f"z{k}") for k in range(len(families))]
    scored = grams.join(F.broadcast(weights), "gram").groupBy(*key).agg(
        F.first("doc_id", ignorenulls=False).alias("doc_id"), F.collect_set("gram").alias("grams"), *sums
    )
    z = F.array(*[(F.col(f"z{k}") + model.bias[k]) / model.temperature for k in range(len(families))])
    odds = F.transform("z", lambda x: F.exp(x - F.array_max("z")))
    total = F.aggregate("odds", F.lit(0.0), lambda a, b: a + b)
    chance = F.transform(F.slice("odds", 1, len(families) - 1), lambda x: x / F.col("total"))  # the last class is unknown
    number = F.array_position("chance", F.col("probability")).cast("int")
    judged = (
        scored.select("doc_id", *key, "grams", F.explode(F.array(z)).alias("z"))
        .select("doc_id", *key, "grams", F.explode(F.array(odds)).alias("odds"))
        .withColumn("total", total)
        .withColumn("chance", chance)
        .withColumn("probability", F.array_max("chance"))
        .withColumn("family", F.when(F.col("probability") >= threshold, F.element_at(F.array(*[F.lit(f) for f in families[:-1]]), number)))
    )
    # Grams of a paragraph are of the vocabulary, families are few.
    whole = judged.groupBy("row", "paragraph").agg(
        F.first("doc_id", ignorenulls=False).alias("doc_id"), F.array_distinct(F.flatten(F.collect_set("grams"))).alias("grams"),
        *[F.max(F.when(F.col("family") == f, F.col("probability"))).alias(f"p{k}") for k, f in enumerate(families[:-1])],
    )
    hits = F.array(*[F.struct(F.lit(f).alias("family"), F.col(f"p{k}").alias("probability")) for k, f in enumerate(families[:-1])])
    best = whole.select("doc_id", "row", "paragraph", "grams", F.inline(F.filter(hits, lambda h: h["probability"].isNotNull())))
    compared = spark.createDataFrame(
        [(f, i, s) for f, many in TEMPLATES.items() for i, s in enumerate(many)],
        T.StructType([T.StructField("family", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("template", T.StringType())]),
    )
    own = F.array_distinct(F.flatten(F.transform(sentences_of(F.col("template")), lambda s: grams_of(telling(words_of(s))))))
    compared = compared.withColumn("own", own).groupBy("family").agg(F.collect_list(F.struct("n", "template", "own")).alias("templates"))
    share = lambda t: F.size(F.array_intersect(t["own"], F.col("grams"))) / F.size(t["own"])
    closest = F.array_max(F.transform("templates", lambda t: F.struct(share(t).alias("likeness"), (-t["n"]).alias("n"), t["template"].alias("template"))))
    matched = best.join(F.broadcast(compared), "family").withColumn("closest", closest)
    matched = matched.withColumn("confirmed", F.col("closest.likeness") >= likeness)
    found = matched.select("doc_id", "row", "paragraph", "family", "probability", "closest", "confirmed")
    surest = F.max(F.struct("confirmed", "probability", "family")).alias("top")
    kept = found.groupBy("row", "paragraph").agg(surest, F.collect_list(F.struct("doc_id", "family", "probability", "closest", "confirmed")).alias("all"))
    rows = kept.select("paragraph", "top", F.inline("all")).filter(
        F.col("confirmed") | ~F.col("top.confirmed") & (F.col("probability") >= SURE) & (F.col("family") == F.col("top.family"))
    )
    return rows.select(
        "doc_id", "paragraph", "family", "probability", F.col("closest.template").alias("template"), F.col("closest.likeness").alias("likeness"), "confirmed"
    )


@query("op4_licence_scan")
def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(read(spark, sf_dir, "documents"))
