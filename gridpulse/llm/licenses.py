"""License notices in documents: MinHash bands of overlapping windows find templates, shingles verify them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.llm.texts import in_set, let, plain_words, set_values, text_key

SHINGLE = 5             # words in a shingle
# Shingles between the starts of two windows, each of which holds twice as many and overlaps half of the next; and the
# least shingles of a template that is looked up by such windows. Shorter ones go by windows of a single shingle.
STEPS = {8: 16, 2: 5}
BANDS = 8               # bands of one row each
BROADCAST_TEMPLATE_WORDS = 250_000
ROW = "SELECT -2 AS ask, 0L AS value, 'row' AS kind, array('') AS templates"

# Public license notices.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                 "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
                 "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
                 "sublicense, and/or sell copies of the Software",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                         "except in compliance with the License. You may obtain a copy of the License at "
                         "http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are "
                          "permitted provided that the following conditions are met",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                  "General Public License as published by the Free Software Foundation",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                   "Lesser General Public License as published by the Free Software Foundation",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
                      "the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring "
                "rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
                "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
                "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
                "conditions: The above copyright notice and this permission notice shall be included in all copies or "
                "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
                "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
                "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
                "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
                "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
                "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
                "IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
                "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
                "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
                "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
                "PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                         "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
                         "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
                         "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
                         "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE "
                         "COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
                         "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
                         "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
                         "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
                         "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
                         "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY "
                         "WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
                 "liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
                 "software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject "
                 "to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that "
                 "you wrote the original software. If you use this software in a product, an acknowledgment in the product "
                 "documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, "
                 "and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from "
                 "any source distribution.",
}


def template_table(spark: SparkSession, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame(sorted(templates.items()), "template_id string, text string")


def collision_probability(similarity: float, bands: int = BANDS) -> float:
    """Chance that two windows of this Jaccard similarity share a band."""
    return 1 - (1 - similarity) ** bands


def shingle_hashes(words: Column) -> Column:
    """64-bit hashes of all 5-word shingles, by place; a shorter text is one shingle, an empty one none."""
    def hashes(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0)))
        return F.when(F.size(w) > 0, F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)])))

    return let(words, hashes)


def _masks() -> list[int]:
    """One mask per band, with the band's number as its top bits, as signed 64-bit numbers."""
    masks = [(b << 61) + (1 << 60) for b in range(BANDS)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def band_values(shingles: Column, step: int, every: bool = False, known: list[int] | None = None) -> Column:
    """The different (band, value) pairs of all windows of twice ``step`` shingles.

    Band b's permutation of the hashes is XOR with a mask whose top bits are b, so its minimum is the hash
    nearest to the b-th corner of the hash space: each band looks at other shingles of the window. Windows start
    every ``step`` shingles and join two neighbouring blocks, whose minima are computed once; with ``every`` they
    start at every shingle. A text shorter than a window is one window. Of the values only ``known`` ones are
    returned, if given.
    """
    def lows(b: int, mask: int) -> Column:
        def low(i: Column, size: int) -> Column:
            return F.array_min(F.transform(F.slice(shingles, i, size), lambda h: h.bitwiseXOR(F.lit(mask))))

        if every:
            least = F.transform(F.sequence(F.lit(1), F.greatest(F.size(shingles) - (2 * step - 1), F.lit(1))),
                                lambda i: low(i, 2 * step))
        else:
            blocks = F.transform(F.sequence(F.lit(1), F.size(shingles), F.lit(step)), lambda i: low(i, step))
            least = let(blocks, lambda v: F.transform(v, lambda x, i: F.least(x, F.get(v, i + 1))))
        if known is not None:
            least = F.filter(least, lambda h: in_set(h, known))
        return F.transform(F.array_distinct(least), lambda h: F.struct(F.lit(b).alias("band"), h.alias("value")))

    return F.concat(*[lows(b, m) for b, m in enumerate(_masks())])


def template_index(templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sizes: template_id and its number of shingles; index: ask, value, kind, template ids).

    ``ask`` -1 asks for shingles: kind "shingle" for verification, and kind "window" for the shortest templates,
    whose windows are their single shingles, of which any band is the hash itself. ``ask`` from 0 on asks for a band of
    windows of one of the sizes of ``STEPS``, each template by the largest it fills, at every offset, so that any
    window of a copied notice meets its equal.
    """
    rows = templates.select(F.col("template_id"), shingle_hashes(plain_words(F.col("text"))).alias("s")).where("s IS NOT NULL")
    rows = rows.withColumn("runs", F.col("s")).withColumn("s", F.array_distinct("s")).withColumn("n", F.size("s"))

    def entry(ask: Column, value: Column, kind: str) -> Column:
        return F.struct(ask.cast("int").alias("ask"), value.alias("value"), F.lit(kind).alias("kind"))

    windows = F.transform("s", lambda v: entry(F.lit(-1), v, "window"))
    for k, (step, least) in reversed(list(enumerate(STEPS.items()))):
        windows = F.when(F.col("n") >= least, F.transform(band_values(F.col("runs"), step, every=True), _window_entry(
            entry, k))).otherwise(windows)
    values = F.concat(F.transform("s", lambda v: entry(F.lit(-1), v, "shingle")), windows)
    index = rows.select("template_id", F.explode(values).alias("e")).select("e.*", "template_id") \
        .groupBy("ask", "value", "kind").agg(F.collect_set("template_id").alias("templates"))
    return rows.select("template_id", F.col("n").alias("shingles")), index


def _window_entry(entry, size: int):
    return lambda p: entry(p["band"] + size * BANDS, p["value"], "window")


def _probe(size: int):
    return lambda p: F.struct((p["band"] + size * BANDS).alias("ask"), p["value"].alias("value"))


def scan_licenses(docs: DataFrame, templates: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  least: float = 0.8) -> DataFrame:
    """One row per row: key, and ``found``: array of (template_id, containment) by template.

    A template is found if a band of one of its windows equals a band of a window of the document, and at least
    ``least`` of the template's different shingles stand in the document. A document window that lies in a copied
    notice equals a template window, so it collides for certain; one of similarity 0.6 still does with probability
    0.999, of 0.8 with 0.99999 (``collision_probability``).
    The index comes from the templates alone; it is broadcast up to ``BROADCAST_TEMPLATE_WORDS`` words of them,
    and joined by shuffle beyond. Null and empty texts have none; repeated rows give repeated rows; templates
    without words match nothing.
    """
    sizes, index = template_index(templates)
    words = templates.select(F.coalesce(F.sum(F.size(plain_words(F.col("text")))), F.lit(0))).first()[0]
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    base = base.select(text_key(F.col("doc_id"), F.col("text")).alias("key"),
                       F.coalesce(shingle_hashes(plain_words(F.col("text"))), F.array().cast("array<bigint>")).alias("s"))
    # Hashes that no template has are dropped where they arise, unless there are too many templates for a hash set;
    # the join would drop them as well.
    shingles, *bands = (set_values(index.where(test), "value") for test in (
        "ask = -1", *(f"ask DIV {BANDS} = {k} AND ask >= 0" for k in range(len(STEPS)))))
    base = base.withColumn("own", F.col("s") if shingles is None else F.filter("s", lambda v: in_set(v, shingles)))
    none = F.array().cast("array<struct<ask:int,value:bigint>>")
    probes = F.concat(
        F.array(F.struct(F.lit(-2).alias("ask"), F.lit(0).cast("bigint").alias("value"))),
        F.transform(F.array_distinct("own"), lambda v: F.struct(F.lit(-1).alias("ask"), v.alias("value"))),
        # Equal bands are equal shingles: a document without a shingle of any template has no window to look up.
        *[F.when(F.size("own") > 0, F.transform(band_values(F.col("s"), step, known=bands[k]), _probe(k))).otherwise(none)
          for k, step in enumerate(STEPS)])
    # ``ask`` -2 stands for the document itself, so that documents without a hit come through the join.
    asked = base.select("key", F.explode_outer(probes).alias("p")).select("key", "p.ask", "p.value")
    index = index.unionByName(templates.sparkSession.sql(ROW))
    small = words <= BROADCAST_TEMPLATE_WORDS
    hits = asked.join(F.broadcast(index) if small else index, ["ask", "value"])
    # One row per (document, template): verified shingles are counted, bands only make it a candidate.
    pairs = hits.select("key", "kind", "value", F.explode("templates").alias("template_id"))
    counted = pairs.groupBy("key", "template_id").agg(
        F.count_if(F.col("kind") == "row").alias("rows"), F.max(F.col("kind") == "window").alias("candidate"),
        F.size(F.collect_set(F.when(F.col("kind") == "shingle", F.col("value")))).alias("shared"))
    judged = counted.join(F.broadcast(sizes) if small else sizes, "template_id", "left")
    share = F.col("shared") / F.col("shingles")
    found = F.when(F.col("candidate") & (share >= least), F.struct("template_id", share.alias("containment")))
    return judged.groupBy("key").agg(F.max("rows").alias("rows"), F.array_sort(F.collect_list(found)).alias("found")) \
        .withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int")))).drop("_copy", "rows")
