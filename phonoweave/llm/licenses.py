"""License scans by MinHash over overlapping text windows.

Words are runs of letters and digits, lower-cased; shingles are five words. A template of m words is looked for in windows of
W words, W the smallest of 16, 32, 64, ... that is at least 2 m; windows start every W / 2 words, so any passage of m words is
whole inside one. A window that holds 0.8 of a template's shingles has a Jaccard similarity with it of at least
0.8 t / (W - 4 + 0.2 t), t the template's shingles; with one row to a band, the class of W gets so many bands that a window
at that bound collides with a chance of at least 1 - 1e-6. Windows without any template shingle can't collide and get no
signature: a window is made where a template's shingle occurs. Retrieved templates are verified
by exact shingle containment.

Null, blank and empty texts match nothing; a text shorter than a window is one window. Rows repeated with one doc_id and
license give one row, that of the highest containment and then the smallest place; null is a doc_id like others. Other
columns are not read. Templates need five words at least. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoweave.llm.common import Scratch, materialize, row_key, shingle_hashes, with_marks

SHINGLE, CONTAINMENT, MISS, LEAST_WINDOW = 5, 0.8, 1e-6, 16

#: Notices of public licenses.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def license_words(text: Column) -> Column:
    """Array of runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def license_hashes(text: Column) -> Column:
    return F.transform(license_words(text), lambda w: F.xxhash64(w))


def window_class(n_words: int) -> int:
    size = LEAST_WINDOW
    while size < 2 * n_words:
        size *= 2
    return size


def bands(window: int, shingles: int, containment: float = CONTAINMENT, miss: float = MISS) -> int:
    """Bands of one row each that leave at most the given chance of missing a window at the bound."""
    needed = math.ceil(containment * shingles)
    least = needed / (window - SHINGLE + 1 + shingles - needed)
    return max(1, math.ceil(math.log(miss) / math.log1p(-least))) if least < 1 else 1


def template_table(spark: SparkSession, templates: Iterable[tuple[str, str]]) -> tuple[DataFrame, dict[int, int]]:
    """The templates' shingles by window class, and the bands of each class."""
    rows, per_class = [], {}
    for number, (license_id, text) in enumerate(templates):
        n = len(re.findall(r"[^\W_]+", text))
        if n < SHINGLE:
            raise ValueError(f"a template needs {SHINGLE} words: {text!r}")
        size = window_class(n)
        per_class[size] = max(per_class.get(size, 0), bands(size, n - SHINGLE + 1))
        rows.append((number, license_id, text, size))
    table = spark.createDataFrame(rows, "template int, license_id string, text string, size int")
    return table.select("template", "license_id", "size", F.array_distinct(shingle_hashes(license_hashes(F.col("text")), SHINGLE)).alias("wanted")), per_class


def signature(shingles: Column, n: Column) -> Column:
    """Array of (k, v): the least hash of each of n bands."""
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(k.alias("k"), F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, k))).alias("v")))


def license_scan(docs: DataFrame, templates: Iterable[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license_id, containment, start (word place of the first such window): a row for each document and license found."""
    with Scratch(docs.sparkSession) as scratch:
        return materialize(_scan(docs, templates, containment, scratch), "licenses")


def _scan(docs: DataFrame, templates: Iterable[tuple[str, str]], containment: float, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    wanted, per_class = template_table(spark, templates)
    count = F.element_at(F.create_map(*[F.lit(x) for pair in per_class.items() for x in pair]), F.col("size"))
    texts = docs.select(row_key(docs).alias("row"), shingle_hashes(license_hashes(F.col("text")), SHINGLE).alias("s"))
    # Outer: an inner explode would first compute the array once more, for a filter.
    places = wanted.select("size", F.explode("wanted").alias("h")).distinct()
    hits = texts.select("row", F.posexplode_outer("s").alias("p", "h")).join(F.broadcast(places), "h")
    half = F.col("size") / 2
    anchors = scratch.keep(hits.select("row", "size", (F.floor(F.col("p") / half) * half).cast("int").alias("at")).distinct(), "license-anchors")
    start = F.greatest(F.lit(0), F.least(F.col("at"), F.size("w") - F.col("size")))
    windows = (
        with_marks(docs, anchors)
        .select("doc_id", license_hashes(F.col("text")).alias("w"), F.explode("marks").alias("m"))
        .select("doc_id", "w", "m.size", "m.at")
        .select("doc_id", "size", start.alias("start"), F.slice("w", start + 1, F.col("size")).alias("w"))
        .distinct()
        .select("doc_id", "size", "start", F.array_distinct(shingle_hashes(F.col("w"), SHINGLE)).alias("shingles"))
    )
    keyed = wanted.select("template", "license_id", "size", "wanted", F.explode(signature(F.col("wanted"), count)).alias("b")).select("template", "license_id", "size", "wanted", "b.k", "b.v")
    retrieved = (
        windows.withColumn("b", F.explode(signature(F.col("shingles"), count)))
        .select("doc_id", "size", "start", "shingles", "b.k", "b.v")
        .join(F.broadcast(keyed), ["size", "k", "v"])  # a list of notices, a few hundred bands each
    )
    share = F.size(F.array_intersect("wanted", "shingles")) / F.size("wanted")
    return (
        retrieved.withColumn("containment", share)
        .where(F.col("containment") >= containment)
        .groupBy("doc_id", "license_id")
        .agg(F.max(F.struct(F.round("containment", 6).alias("containment"), (-F.col("start")).alias("start"))).alias("best"))
        .select("doc_id", "license_id", "best.containment", (-F.col("best.start")).alias("start"))
    )
