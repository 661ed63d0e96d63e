"""Licences of files: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above.

A file is cut into units: each line, each paragraph (lines up to an empty one) and each sentence of a paragraph
are compared to the notices, so a one-line notice and a header comment are each compared as a whole. The whole
text is compared to the full texts of ``license_texts``, so a licence file is as well. Units and templates are sparse vectors of
words; a word weighs its number in the unit times ``ln((1 + files) / (1 + files with it)) + 1``, counted over
all files. Words that no template has weigh like a word of no file. The best template of a file is its licence
if the cosine reaches the threshold; Proprietary is it only if no other licence does.

A unit can reach the threshold only if it has one of a template's anchors: so many of its heaviest words that
the others together are too light. Units without an anchor are left out before anything is shuffled; by the
inequality of Cauchy and Schwarz this loses nothing.

A file without a licence of its own takes that of the nearest directory, its own first, that has a licence
file (LICENSE, LICENCE or COPYING, with any ending) with a licence. Directories meet their ancestors by path
joins. Everything is a column expression or a DataFrame operation; templates are a parameter of the caller
and the driver sees only them and the counts of their words.

Defined cases: a null or empty text has no licence of its own; ties go to the template that is first by name, after Proprietary has lost to all others;
a null path is a file outside every directory; rows equal in doc_id, path and text are one file; several
licence files of one directory count with the best. Empty tables give empty tables; other columns are not
looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

THRESHOLD = 0.6
_LICENSE_FILE = r"(?i)^(licen[sc]e|copying)([.\-_].*)?$"

# Notices by which files name their licence, as their publishers word them.
TEMPLATES = {
    "AGPL-3.0": [
        "GNU Affero General Public License",
        "GNU Affero General Public License Version 3, 19 November 2007",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "GPL-2.0": [
        "GNU General Public License Version 2, June 1991",
        "This work is licensed under the GNU General Public License, version 2.",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "GNU General Public License Version 3, 29 June 2007",
        "This work is licensed under the GNU General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": ["Released under the ISC License."],
    "LGPL-2.1": [
        "GNU Lesser General Public License Version 2.1, February 1999",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "GNU Lesser General Public License",
        "GNU Lesser General Public License Version 3, 29 June 2007",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Proprietary": ["All rights reserved."],
}


#: Licence files in full.
FULL_TEXTS = {path.stem: [path.read_text()] for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
#: Loses to any other licence: licence files carry its words too.
_WEAKEST = "Proprietary"


def _words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9.]+", re.sub(r"\.(?![0-9])", " ", text.lower())) if w]


def _words(text: Column) -> Column:
    """Letters and digits, and dots inside numbers, like ``_words_of``."""
    plain = F.regexp_replace(F.lower(text), r"\.(?![0-9])", " ")
    return F.array_remove(F.split(plain, "[^a-z0-9.]+"), "")


def _anchors(weights: dict[str, float], threshold: float, first: dict[str, float]) -> set[str]:
    """Words, those of the largest ``first`` before others, without which no unit reaches the threshold."""
    length = math.sqrt(sum(w * w for w in weights.values()))
    chosen: set[str] = set()
    for word in sorted(weights, key=lambda w: (-first[w], w)):
        rest = math.sqrt(sum(w * w for other, w in weights.items() if other not in chosen))
        if rest < threshold * length * (1 - 1e-9):
            break
        chosen.add(word)
    return chosen


def own_licenses(spark: SparkSession, files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD, full_texts: dict[str, list[str]] = FULL_TEXTS) -> DataFrame:
    """doc_id, version, license, score: files that carry a notice, with the best of their units, or are a licence in full. ``files`` has doc_id and text."""
    counted = [(whole, name, i, Counter(_words_of(text))) for whole, given in ((False, templates), (True, full_texts)) for name in sorted(given) for i, text in enumerate(given[name])]
    vocabulary = sorted({word for *_, words in counted for word in words})
    known = F.array(*[F.lit(w) for w in vocabulary])
    texts = files.select("doc_id", F.crc32(F.coalesce("text", F.lit(""))).alias("version"), F.coalesce("text", F.lit("")).alias("text"))

    has = texts.select(F.array_intersect(_words(F.col("text")), known).alias("words"))
    counts = has.select(F.explode(F.array_append("words", F.lit(""))).alias("word")).groupBy("word").agg(F.count("*").alias("files")).collect()
    files_with = {row["word"]: row["files"] for row in counts}  # a row for each word of a template
    total = files_with.get("", 0)
    idf = {word: math.log((1 + total) / (1 + files_with.get(word, 0))) + 1 for word in vocabulary}
    unseen = math.log(1 + total) + 1

    rows, anchors = [], {False: set(), True: set()}
    for whole, name, i, words in counted:
        weights = {word: n * idf[word] for word, n in words.items()}
        length = math.sqrt(sum(w * w for w in weights.values()))
        # Full texts have common words many times; rare words let fewer files through.
        anchors[whole] |= _anchors(weights, threshold, idf if whole else weights)
        rows += [(whole, name, i, word, weight / length) for word, weight in weights.items()]
    template = spark.createDataFrame(rows, "whole boolean, license string, notice int, word string, share double")
    frequency = spark.createDataFrame(sorted(idf.items()), "word string, idf double")

    marks, full_marks = (F.array(*[F.lit(w) for w in sorted(anchors[whole])]) for whole in (False, True))
    lines = F.split("text", "\n")
    paragraphs = F.split("text", r"\n[ \t\r]*\n")
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(p, r"(?<=[.!?;:])\s+")))
    parts = (
        texts.where(F.arrays_overlap(_words(F.col("text")), marks))
        .select("doc_id", "version", F.posexplode(F.array_distinct(F.concat(lines, paragraphs, sentences))).alias("unit", "text"))
        .select("doc_id", "version", "unit", _words(F.col("text")).alias("words"))
        .where(F.arrays_overlap("words", marks))
    )
    in_full = (
        texts.select("doc_id", "version", F.lit(-1).alias("unit"), _words(F.col("text")).alias("words"))
        .where(F.arrays_overlap("words", full_marks))
    )
    units = parts.unionByName(in_full).distinct()
    vector = (
        units.select("doc_id", "version", "unit", F.explode("words").alias("word")).groupBy("doc_id", "version", "unit", "word").agg(F.count("*").alias("n"))
        .join(F.broadcast(frequency), "word", "left")  # the words of the templates
        .withColumn("weight", F.col("n") * F.coalesce("idf", F.lit(unseen)))
    )
    length = vector.groupBy("doc_id", "version", "unit").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    keys = ["doc_id", "version", "unit"]
    products = vector.where(F.col("idf").isNotNull()).join(F.broadcast(template), "word").where((F.col("unit") == -1) == F.col("whole")).groupBy(*keys, "license", "notice").agg(F.sum(F.col("weight") * F.col("share")).alias("product"))
    same = F.col("p.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("p.version") == F.col("l.version")) & (F.col("p.unit") == F.col("l.unit"))
    scored = products.alias("p").join(length.alias("l"), same).select("p.doc_id", "p.version", "license", F.round(F.col("product") / F.col("length"), 9).alias("score")).where(F.col("score") >= threshold)
    best = scored.groupBy("doc_id", "version", "license").agg(F.max("score").alias("score"))
    order = Window.partitionBy("doc_id", "version").orderBy(F.col("license") == _WEAKEST, F.desc("score"), "license")
    return best.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1).drop("_n")


def scan_licenses(spark: SparkSession, files: DataFrame, folder: str, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, own_license, own_score, inherited_license, inherited_from, license for every row of ``files``.

    ``files`` has doc_id, path (directories split by /) and text. Inheritance is worked out once for each
    directory, not for each file, so a directory with a third of all files costs one row there.
    """
    own_licenses(spark, files, templates, threshold).write.parquet(f"{folder}/own")
    own = spark.read.parquet(f"{folder}/own")
    listed = files.select("doc_id", "path", F.crc32(F.coalesce("text", F.lit(""))).alias("version"))
    same = F.col("f.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("f.version") == F.col("o.version"))
    directory = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    marked = (
        listed.alias("f").join(own.alias("o"), same, "left")
        .select("f.doc_id", "path", F.col("license").alias("own_license"), F.col("score").alias("own_score"))
        .withColumn("directory", directory)
    )
    marked.write.parquet(f"{folder}/marked")
    marked = spark.read.parquet(f"{folder}/marked")

    is_license_file = F.substring_index("path", "/", -1).rlike(_LICENSE_FILE) & F.col("own_license").isNotNull()
    by_name = marked.where(is_license_file).groupBy("directory", "own_license").agg(F.max("own_score").alias("score"))
    first = Window.partitionBy("directory").orderBy(F.col("own_license") == _WEAKEST, F.desc("score"), "own_license")
    licensed = (
        by_name.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1)
        .select(F.col("directory").alias("ancestor"), F.col("own_license").alias("inherited_license"))
    )
    parts = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    chains = marked.where(F.col("directory").isNotNull()).select("directory").distinct().select("directory", F.posexplode(above).alias("depth", "ancestor"))
    nearest = (
        chains.join(licensed, "ancestor").groupBy("directory")
        .agg(F.max_by(F.struct("inherited_license", "ancestor"), "depth").alias("found"))
        .select("directory", F.col("found.inherited_license").alias("inherited_license"), F.col("found.ancestor").alias("inherited_from"))
    )
    return (
        marked.join(nearest, "directory", "left")
        .select("doc_id", "path", "own_license", "own_score", "inherited_license", "inherited_from", F.coalesce("own_license", "inherited_license").alias("license"))
    )
