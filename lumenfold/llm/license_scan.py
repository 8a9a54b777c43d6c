"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 5
#: A window that holds 0.8 of a template's shingles agrees with it in a band with a probability of 0.45 at least.
BANDS = 24
CONTAINMENT = 0.8
SPLIT = r"[^\p{L}\p{N}]+"

#: Public license notices, by a short name. A parameter: its size is known, so it may be broadcast.
TEMPLATES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-2": "Licensed under the MIT license. See LICENSE file in the project root for full license information.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda w: w != "")


def _once(value: Column, use) -> Column:
    """use(value) with the value computed once for a row, however often, and in whatever lambda, it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingles_of(words: Column, size: int = WORDS) -> Column:
    """Hashes of the runs of `size` words, in order."""
    hashes = lambda w: F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(size))))).otherwise(F.array().cast("array<bigint>"))
    return _once(words, hashes)


def _minima(shingles: Column, bands: int) -> Column:
    return _once(shingles, lambda s: F.array(*[F.array_min(F.transform(s, _hash_with(k))) for k in range(bands)]))


def _hash_with(seed: int):
    return lambda x: F.xxhash64(x, F.lit(seed))


def _class_of(n: int) -> int:
    return math.ceil(math.log(n) / math.log(1.3) - 1e-9)


def license_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, containment: float = CONTAINMENT, bands: int = BANDS) -> DataFrame:
    """(doc_id, license, first_word, matched, n_shingles, containment): each document's licenses, one row for each template found.

    Words are lower-cased runs of letters and digits; shingles are five words. Templates are classed by their number
    of shingles, classes growing by 1.3. A class's windows are as long as its longest template plus a step of an eighth
    of its shortest, so some window holds all of any passage as long as the template. Windows and templates meet where a band
    of one minimum agrees. At the least similarity that a window with 0.8 of a template has, about 0.45, 24 bands miss
    it with a probability under 1e-6; a whole copy is missed still more seldom. Shingles of the window and a quarter more are then
    intersected with the template's. A window without any template's shingle can't agree with one, which a set lookup finds first, so minima are
    taken of the others alone. first_word is the window's place, in words from 0; of equal containments the first.
    Null, empty and short texts match nothing; texts of any length are read whole. Templates of fewer than five words
    are not accepted. An id gets what any of its rows matches, and null ids are one such group: of several matches of
    a template the best, then the first, counts. Extra columns of any name are left out; an empty table gives none.
    """
    spark: SparkSession = docs.sparkSession
    known = spark.createDataFrame(sorted((templates if templates is not None else TEMPLATES).items()), "license string, body string")
    known = known.select("license", F.array_distinct(shingles_of(words_of(F.col("body")))).alias("wanted"))
    listed = known.collect()  # the parameter, hashed
    if any(not r["wanted"] for r in listed):
        raise ValueError("a template needs at least five words")
    every = sorted({h for r in listed for h in r["wanted"]})
    classes: dict[int, list] = {}
    for r in listed:
        classes.setdefault(_class_of(len(r["wanted"])), []).append(len(r["wanted"]))
    shapes = {c: (max(v) + (s := max(1, min(v) // 8)) - (1 if max(v) == 1 else 0), s) for c, v in classes.items()}
    table = spark.createDataFrame([(r["license"], r["wanted"], _class_of(len(r["wanted"]))) for r in listed], "license string, wanted array<bigint>, class int")
    bound = table.withColumn("low", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(bands - 1)).alias("band"), _minima(F.col("wanted"), bands).alias("value")))).select("license", "class", F.col("low.band").alias("band"), F.col("low.value").alias("value"))

    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    # generators keep later projections and filters from being merged with the hashing, which would repeat it
    hashed = texts.select("id", F.explode(F.array(shingles_of(words_of(F.col("text"))))).alias("h"))
    places = F.filter(F.transform("h", lambda x, i: F.when(x.isin(every), i)), lambda i: i.isNotNull())
    hashed = hashed.select("id", "h", F.explode(F.array(places)).alias("hits")).where(F.size("hits") > 0)
    steps = F.array(*[F.struct(F.lit(c).alias("class"), F.lit(length).alias("length"), F.lit(step).alias("step")) for c, (length, step) in sorted(shapes.items())])
    framed = hashed.select("id", "h", "hits", F.explode(steps).alias("w")).select("id", "h", "hits", "w.*")
    # windows begin at multiples of the step; those that hold a template's shingle are looked at
    first = lambda i: F.greatest(F.lit(0), F.ceil((i - F.col("length") + 1) / F.col("step")).cast("int"))
    starts = F.array_distinct(F.flatten(F.transform("hits", lambda i: F.sequence(first(i), F.floor(i / F.col("step")).cast("int")))))
    cut = F.transform(starts, lambda k: F.struct((k * F.col("step") + 1).alias("start"), F.slice("h", k * F.col("step") + 1, F.col("length")).alias("part"), F.slice("h", k * F.col("step") + 1, F.ceil(F.col("length") * 1.25).cast("int")).alias("wide")))
    windows = framed.select("id", "class", F.explode(cut).alias("x")).select("id", "class", "x.*")
    keyed = windows.select("id", "class", "start", "wide", F.posexplode(_minima(F.col("part"), bands)).alias("band", "value"))
    # rows that repeat an id, or have none, are told apart by what the window holds
    candidates = keyed.join(F.broadcast(bound), ["class", "band", "value"]).groupBy("id", "class", "start", "license", F.xxhash64("wide").alias("_same")).agg(F.first("wide").alias("wide"))
    checked = candidates.join(F.broadcast(table.select("license", "wanted")), "license")
    checked = checked.select("id", "license", (F.col("start") - 1).alias("first_word"), F.size(F.array_intersect("wide", "wanted")).alias("matched"), F.size("wanted").alias("n_shingles"))
    checked = checked.withColumn("containment", F.col("matched") / F.col("n_shingles")).where(F.col("containment") >= containment)
    best = checked.groupBy("id", "license").agg(F.min(F.struct((-F.col("containment")).alias("c"), "first_word", "matched", "n_shingles")).alias("b"))
    return best.select(F.col("id").alias(id_col), "license", F.col("b.first_word").alias("first_word"), F.col("b.matched").alias("matched"), F.col("b.n_shingles").alias("n_shingles"), (-F.col("b.c")).alias("containment"))
