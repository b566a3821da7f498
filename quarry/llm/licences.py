"""Licence scan: Dice coefficient over word bigrams against licence notices.

DataFrame expressions only, without a shuffle: every unit of a text (each
line, each paragraph, and the whole text if its size can fit a template) is
normalised (A-Z lower-cased, everything but a-z and 0-9 a space) and its set
of word bigrams compared with each template's. A template is compared only
where the sizes allow the threshold t: sizes a, b need 2 * min / (a + b) >= t.
Before that, a text must hold an *anchor*: for every template, words are chosen
so that any unit that reaches t holds one of them (they cover all but fewer
than the needed bigrams), so this loses nothing.

Null and empty texts have no match. Ties go to the larger template, then to
the smaller name. Equal units of a text count once. Repeated rows get a row each.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Well-known public notices, as their licences word them (fixed values).
TEMPLATES: list[tuple[str, str]] = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
]
THRESHOLD = 0.8
#: A template has at most this many words, which bounds the plan and the units that are compared.
MAX_WORDS = 2000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", "".join(c.lower() if c in _UPPER else c for c in text))


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def size_bounds(n: int, t: float) -> tuple[int, int]:
    """Sizes that can reach Dice t against a set of n."""
    return math.ceil(n * t / (2 - t) - 1e-9), math.floor(n * (2 - t) / t + 1e-9)


def anchors(templates: list[tuple[str, str]], t: float) -> list[str]:
    """Words of which any unit that reaches t against a template holds one."""
    out: set[str] = set()
    for _, text in templates:
        grams = set(bigrams_of(text))
        need = size_bounds(len(grams), t)[0]  # a match shares at least as many bigrams
        left = {g for g in grams if not out & set(g.split())}
        while len(left) >= need:
            # long words first: they are rare in texts
            best = max({w for g in left for w in g.split()}, key=lambda w: (min(len(w), 7), sum(w in g.split() for g in left), w))
            out.add(best)
            left = {g for g in left if best not in g.split()}
    return sorted(w for w in out if not any(v != w and v in w for v in out))  # a word holds what is inside it


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, licence, score, n_matches: the best match of each row, and how many units match; null and 0 without."""
    templates = TEMPLATES if templates is None else templates
    if not 0 < threshold <= 1:
        raise ValueError("threshold is above 0 and at most 1")
    made = [(name, bigrams_of(text)) for name, text in templates]
    if any(not g or len(g) >= MAX_WORDS for _, g in made):
        raise ValueError(f"a template has two to {MAX_WORDS} words")
    most = max((size_bounds(len(g), threshold)[1] for _, g in made), default=0)
    text = F.translate(F.col(text_col), _UPPER, _LOWER)
    df = docs.select(F.col(id_col), F.coalesce(text, F.lit("")).alias("_t"))
    held: Column = F.lit(False)
    for a in anchors(templates, threshold):
        held = held | F.contains("_t", F.lit(a))
    lines, paragraphs = F.split("_t", "\n"), F.split("_t", r"\n[ \t\r]*\n")
    units = F.array_distinct(F.concat(lines, paragraphs, F.array("_t")))
    word_lists = F.transform(units, lambda u: F.filter(F.split(u, r"[^a-z0-9]+"), lambda w: w != ""))
    # a unit has more words than distinct bigrams: longer ones may still fit by repetition, so the set decides
    sets = F.transform(word_lists, lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))))

    def scores(s: Column) -> Column:
        n = F.size(s)
        each = []
        for name, grams in made:
            lo, hi = size_bounds(len(grams), threshold)
            dice = F.lit(2.0) * F.size(F.array_intersect(s, F.array(*map(F.lit, grams)))) / (n + F.lit(len(grams)))
            each.append(F.when((n >= lo) & (n <= hi), F.struct(dice.alias("score"), F.lit(len(grams)).alias("size"), F.lit(name).alias("licence"))))
        return F.reduce(F.array(*each), F.lit(None).cast("struct<score:double,size:int,licence:string>"), lambda m, x: F.when(m.isNull() | (x["score"] > m["score"]) | ((x["score"] == m["score"]) & ((x["size"] > m["size"]) | ((x["size"] == m["size"]) & (x["licence"] < m["licence"])))), x).otherwise(m))

    found = F.filter(F.transform(F.filter(sets, lambda s: F.size(s) <= most), scores), lambda m: m["score"] >= threshold)
    empty = F.array().cast("array<struct<score:double,size:int,licence:string>>")
    df = df.withColumn("_found", F.when(held, found).otherwise(empty) if made else empty)
    best = F.reduce("_found", F.lit(None).cast("struct<score:double,size:int,licence:string>"), lambda m, x: F.when(m.isNull() | (x["score"] > m["score"]) | ((x["score"] == m["score"]) & ((x["size"] > m["size"]) | ((x["size"] == m["size"]) & (x["licence"] < m["licence"])))), x).otherwise(m))
    return df.withColumn("_best", best).select(F.col(id_col), F.col("_best.licence").alias("licence"), F.coalesce("_best.score", F.lit(0.0)).alias("score"), F.size("_found").alias("n_matches"))
