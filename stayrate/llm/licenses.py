"""License notices found by MinHash bands over overlapping windows, in DataFrame
functions only.

Templates are put into classes by their number of shingles, doubling from class to class;
one of fewer words than a shingle is one shingle of its own length, and its class cuts texts
at that length, so that it is found inside any text.
A class reads a text in windows of twice its largest template, half a template apart, so
a copy with up to half its length of inserted words lies in one window. A window that
holds the wanted share of a template has a Jaccard similarity with it above a bound known
from the sizes; the number of bands of a class follows from that bound and the accepted
chance of a miss. What the bands retrieve is verified by its exact share of shingles.

A window can only match if it holds one of its class's anchors: words chosen so that the
shingles without any of them are too few for a match. Texts and windows without anchors
are passed over, which loses nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINMENT = 0.8
MISS = 1e-6

# Wordings of common notices and whole short licenses, and the tag lines of
# common identifiers.
NOTICES = (
    ("All-rights-reserved", "All rights reserved."),
    ("Apache-2.0-short", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-short", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT-short", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software. The Software is provided as is, without warranty of any "
        "kind, express or implied, including but not limited to the warranties of merchantability, fitness for a "
        "particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for "
        "any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, "
        "out of or in connection with the Software or the use or other dealings in the Software.",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. This software is provided by the "
        "copyright holders and contributors as is and any express or implied warranties, including, but not "
        "limited to, the implied warranties of merchantability and fitness for a particular purpose are "
        "disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, "
        "incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of "
        "substitute goods or services; loss of use, data, or profits; or business interruption) however caused "
        "and on any theory of liability, whether in contract, strict liability, or tort (including negligence or "
        "otherwise) arising in any way out of the use of this software, even if advised of the possibility of "
        "such damage.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "Zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions: 1. The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a "
        "product, an acknowledgment in the product documentation would be appreciated but is not required. 2. "
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
        "original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
)
IDENTIFIERS = (
    "MIT", "ISC", "0BSD", "Zlib", "Unlicense", "CC0-1.0", "Apache-2.0", "MPL-2.0", "EPL-2.0", "BSD-2-Clause",
    "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only",
    "LGPL-3.0-only", "AGPL-3.0-only",
)
TEMPLATES = (*NOTICES, *((f"SPDX:{name}", f"SPDX-License-Identifier: {name}") for name in IDENTIFIERS))


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[^0-9a-z\x80-\U0010ffff]+", text.lower()) if w]


def template_shingles(text: str) -> list[str]:
    words = template_words(text)
    size = min(SHINGLE, len(words))
    return sorted({" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}) if words else []


def least_matches(size: int, containment: float) -> int:
    return max(1, math.ceil(containment * size - 1e-9))


def anchors(shingles: Sequence[str], containment: float) -> set[str]:
    """Words such that a match without any of them is impossible, long words first."""
    rest, chosen = [set(s.split()) for s in shingles], set()
    while len(rest) >= least_matches(len(shingles), containment):
        words = sorted({w for s in rest for w in s})
        best = max(words, key=lambda w: (len(w) ** 2 * sum(w in s for s in rest), w))
        chosen.add(best)
        rest = [s for s in rest if best not in s]
    return chosen


def class_number(shingles: Sequence[str]) -> int:
    """Words of a shingle and size class of their number, in one number."""
    return 100 * len(shingles[0].split()) + len(shingles).bit_length()


@dataclass(frozen=True)
class SizeClass:
    number: int
    shingle: int
    window: int
    stride: int
    bands: int
    anchors: tuple[str, ...]


def size_classes(templates: Sequence[tuple[str, str]], containment: float = CONTAINMENT, miss: float = MISS) -> list[SizeClass]:
    groups: dict[int, list[list[str]]] = {}
    for _, text in templates:
        shingles = template_shingles(text)
        if shingles:
            groups.setdefault(class_number(shingles), []).append(shingles)
    found = []
    for number, members in sorted(groups.items()):
        largest = max(map(len, members))
        window = 2 * largest
        jaccard = min(m / (len(s) + window - m) for s in members for m in [least_matches(len(s), containment)])
        bands = math.ceil(math.log(miss) / math.log(1 - jaccard))
        words = sorted(set().union(*(anchors(s, containment) for s in members)))
        found.append(SizeClass(number, number // 100, window, max(1, largest // 2), bands, tuple(words)))
    return found


def words_of(text: Column) -> Column:
    """Words of letters and digits in lower case; a NULL text has none."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^0-9a-z\x{80}-\x{10ffff}]+", " ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def shingles_of(words: Column, shingle: Column) -> Column:
    """Distinct runs of ``shingle`` words; none if there are fewer words."""
    last = F.greatest(F.size(words) - shingle + 1, F.lit(1))
    runs = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, shingle), " "))
    return F.when(F.size(words) < shingle, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def signature(hashes: Column, bands: Column) -> Column:
    """Smallest hash under each of ``bands`` random orders."""
    return F.transform(F.sequence(F.lit(1), bands), lambda j: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, j))))


def _table(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    """A few rows of literals as a plan of their own."""
    cells = [F.struct(*[F.lit(list(v) if isinstance(v, tuple) else v).alias(k) for k, v in row.items()]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*cells)))


def template_bands(spark: SparkSession, templates: Sequence[tuple[str, str]], classes: Sequence[SizeClass]) -> DataFrame:
    by_number = {c.number: c for c in classes}
    rows = []
    for name, text in templates:
        shingles = template_shingles(text)
        if shingles:
            own = by_number[class_number(shingles)]
            rows.append({"class": own.number, "license_id": name, "bands": own.bands, "wanted": tuple(shingles)})
    hashes = F.transform("wanted", lambda s: F.xxhash64(s))
    return _table(spark, rows).select(
        "class", "license_id", "wanted", F.posexplode(signature(hashes, F.col("bands"))).alias("band", "value")
    )


def windows(docs: DataFrame, text: Column, classes: Sequence[SizeClass], carried: Sequence[str]) -> DataFrame:
    """Windows that hold an anchor of their class: carried columns, class, shingle, bands,
    start, words."""
    every = sorted({w for c in classes for w in c.anchors})
    some = r"(?<![0-9a-z\x{80}-\x{10ffff}])(?:" + "|".join(map(re.escape, every)) + r")(?![0-9a-z\x{80}-\x{10ffff}])"
    kinds = [
        F.struct(
            F.lit(c.number).alias("number"), F.lit(c.window + c.shingle - 1).alias("width"), F.lit(c.stride).alias("stride"),
            F.lit(c.shingle).alias("shingle"),
            F.lit(c.bands).alias("bands"), F.lit(list(c.anchors)).alias("anchors"),
        )
        for c in classes
    ]
    named = docs.where(F.lower(text).rlike(some)).withColumn("__words", words_of(text))
    by_class = named.select(*carried, "__words", F.explode(F.array(*kinds)).alias("c"))
    at = F.filter(F.sequence(F.lit(0), F.size("__words") - 1), lambda i: F.array_contains("c.anchors", F.get("__words", i)))
    stride, width = F.col("c.stride"), F.col("c.width")
    first = lambda p: F.greatest(F.ceil((p - width + 1) / stride), F.lit(0)).cast("int")
    numbers = F.flatten(F.transform("__at", lambda p: F.sequence(first(p), F.floor(p / stride).cast("int"))))
    placed = by_class.withColumn("__at", at).withColumn("k", F.explode(F.array_distinct(numbers)))
    start = F.col("k") * stride
    return placed.select(
        *carried, F.col("c.number").alias("class"), F.col("c.shingle").alias("shingle"), F.col("c.bands").alias("bands"), start.alias("start"), F.slice("__words", start + 1, width).alias("words")
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT, miss: float = MISS) -> DataFrame:
    """One row per id and license found: id, license_id, containment, n_shingles, start_word.

    ``containment`` is the largest share of the template's shingles in one window and
    ``start_word`` the first such window's first word. ``templates`` is a parameter (id,
    text) held in the plan. Templates of under five words are one shingle, found wherever a
    text holds it; those without words match nothing. NULL texts count as empty,
    repeated ids as one document; an empty table gives no rows.
    """
    spark = docs.sparkSession
    classes = size_classes(templates, containment, miss)
    id_type = docs.schema[id_col].dataType.simpleString()
    if not classes:
        return docs.where("false").select(id_col, F.lit("").alias("license_id"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("n_shingles"), F.lit(0).cast("long").alias("start_word"))
    small = docs.select(F.col(id_col).cast(id_type).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    found = windows(small, F.col("__text"), classes, ["__id"])
    hashed = F.transform(shingles_of(F.col("words"), F.col("shingle")), lambda s: F.xxhash64(s))
    marked = found.withColumn("__hashes", hashed).where(F.size("__hashes") > 0).select(
        "__id", "class", "shingle", "start", "words", F.posexplode(signature(F.col("__hashes"), F.col("bands"))).alias("band", "value")
    )
    pairs = marked.join(template_bands(spark, templates, classes), ["class", "band", "value"])
    matched = F.size(F.array_intersect(shingles_of(F.col("words"), F.col("shingle")), F.col("wanted")))
    share = pairs.withColumn("share", matched / F.size("wanted")).where(F.col("share") >= containment - 1e-9)
    return share.groupBy("__id", "license_id").agg(
        F.max("share").alias("containment"),
        F.max(F.size("wanted")).cast("long").alias("n_shingles"),
        F.min_by("start", F.struct(-F.col("share"), F.col("start"))).cast("long").alias("start_word"),
    ).withColumnRenamed("__id", id_col)
