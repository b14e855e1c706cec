"""License scanning: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import if_small, keep, text_or_empty

#: Public license notices and statements (fixed values).
TEMPLATES = {
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
WORDS, CONTAINED = 5, 0.8
#: One row a band. A window is up to six times as long as a template, so with 80 % of it it is at least 0.8 / 6.2 similar, and 1 - (1 - 0.8 / 6.2)**80 > 0.9999.
BANDS, STRETCH = 80, 3
HASHES = 5


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def shingles(words: Column, n: int = WORDS) -> Column:
    """64-bit hashes of each run of n words, in order; none for fewer words."""
    count = F.size(words) - (n - 1)
    places = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(n)]))


def _signature(window: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.array_min(F.transform(window, lambda s: F.xxhash64(s, b))))


def template_table(spark: SparkSession, templates: dict[str, str] | DataFrame) -> DataFrame:
    """template, parts (its distinct shingles), span (their number, rounded up to a power of two)."""
    rows = templates if isinstance(templates, DataFrame) else spark.createDataFrame(sorted(templates.items()), "template string, text string")
    rows = rows.select("template", F.array_distinct(shingles(words(F.col("text")))).alias("parts")).filter("size(parts) > 0")
    return rows.withColumn("span", F.pow(F.lit(2), F.ceil(F.log2(F.size("parts")) - 1e-9)).cast("int"))


def _places(part: Column, bits: int) -> list[Column]:
    """A shingle's places in a Bloom filter; all but the first take another hash, which is worked out only if those before were found."""
    return [F.pmod(part if k == 0 else F.xxhash64(part, F.lit(k)), F.lit(bits)) for k in range(HASHES)]


def _filters(library: DataFrame) -> tuple[DataFrame, int, list[int]]:
    """One row of Bloom filters: of all templates' shingles (array known), and for each span of those of its templates (known_<span>); their bits; the spans.

    64 bits a shingle of the library and five hashes, so that one foreign shingle in 300,000 seems known.
    """
    parts = keep(library.select("span", F.explode("parts").alias("part")).distinct(), "parts")
    spans = sorted(r[0] for r in parts.select("span").distinct().collect())  # at most one a power of two
    if not spans:
        return parts, 0, spans
    bits = max(1 << 12, 1 << (64 * parts.count() - 1).bit_length())
    places = parts.select("span", F.explode(F.array(*_places(F.col("part"), bits))).alias("place"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftright("place", 6).alias("word")
    held = keep(places.groupBy("span", word).agg(F.bit_or(bit).alias("bits")), "words")
    every = library.sparkSession.range(bits // 64).withColumnRenamed("id", "word").join(held.groupBy("word").agg(F.bit_or("bits").alias("bits")), "word", "left")
    for span in spans:
        every = every.join(held.filter(F.col("span") == span).select("word", F.col("bits").alias(f"bits_{span}")), "word", "left")
    names = ["", *[f"_{n}" for n in spans]]
    words = F.array_sort(F.collect_list(F.struct("word", *[F.coalesce(f"bits{n}", F.lit(0).cast("long")).alias(f"bits{n}") for n in names])))
    one = every.agg(words.alias("words")).select(*[F.col("words").getField(f"bits{n}").alias(f"known{n}") for n in names])
    return keep(one, "filters"), bits, spans


def _any_known(parts: Column, known: str, bits: int) -> Column:
    """Whether the filter holds any of the shingles."""

    def has(part: Column) -> Column:
        found = F.lit(True)
        for place in _places(part, bits):
            word = F.get(F.col(known), F.shiftright(place, 6).cast("int"))
            found = found & (F.call_function("shiftrightunsigned", word, place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return found

    return F.exists(parts, has)


def license_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | DataFrame | None = None, contained: float = CONTAINED) -> DataFrame:
    """(row, id, template, start, containment) of each window verified; one row with a null template for a document without.

    A text's shingles of five words are hashed once. For each template length, rounded up to a
    power of two, windows of three times that length start at every such length; texts, and
    windows, in which a Bloom filter of that length's templates finds no shingle can't contain
    one and go no further. The bands of the others' MinHash signatures retrieve templates, and those of
    which a window holds the share ``contained`` of shingles match. ``start`` counts shingles
    to the window. The library, a dict or a table (template, text), is kept as tables: its
    filters are one broadcast row, and it is broadcast itself if it is small.

    Nulls: a null text is empty; a null id is kept. Rows that repeat match each; texts of
    fewer than five words match nothing; an empty table gives no rows. Other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    library = keep(template_table(spark, TEMPLATES if templates is None else templates), "library")
    filters, bits, spans = _filters(library)
    if not spans:
        return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.expr("cast(null as string) AS template"), F.expr("cast(null as int) AS start"), F.expr("cast(null as double) AS containment"))
    rows = docs.select(F.col(id_col).alias("id"), words(text_or_empty(text_col)).alias("words")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("row", "id", shingles(F.col("words")).alias("parts")).crossJoin(F.broadcast(filters))  # one row
    rows = rows.select("row", "id", F.when(_any_known(F.col("parts"), "known", bits), F.col("parts")).alias("parts"), *[f"known_{n}" for n in spans])

    def windows(span: int) -> Column:
        starts = F.sequence(F.lit(0), F.size("parts") - 1, F.lit(span))
        cut = F.transform(starts, lambda i: F.struct(F.lit(span).alias("span"), i.alias("start"), F.slice("parts", i + 1, STRETCH * span).alias("window")))
        return F.filter(cut, lambda w: _any_known(w["window"], f"known_{span}", bits))

    none = F.array().cast("array<struct<span:int,start:int,window:array<bigint>>>")
    held = keep(rows.select("row", "id", F.when(F.col("parts").isNotNull(), F.concat(*[windows(n) for n in spans])).otherwise(none).alias("windows")), "windows")
    each = held.filter(F.size("windows") > 0).select("row", F.inline("windows"))
    tried = each.select("row", "span", "start", "window", F.posexplode(_signature(F.col("window"))).alias("b", "value"))
    banded = keep(library.select(F.col("template").alias("of"), F.col("span").alias("of_span"), F.posexplode(_signature(F.col("parts"))).alias("band", "least")), "bands")
    found = tried.join(if_small(banded), (F.col("span") == F.col("of_span")) & (F.col("b") == F.col("band")) & (F.col("value") == F.col("least")))
    found = found.join(if_small(keep(library.select("template", F.col("parts").alias("of_parts")), "templates")), F.col("of") == F.col("template"))
    share = F.size(F.array_intersect("window", "of_parts")) / F.size("of_parts")
    sure = keep(found.withColumn("containment", share).filter(F.col("containment") >= contained).select("row", "template", "start", "containment").distinct(), "licensed")  # several bands may find one
    return held.select("row", "id").join(sure, "row", "left").select("row", "id", "template", "start", "containment")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | DataFrame | None = None, contained: float = CONTAINED) -> DataFrame:
    """One row per document: id, licenses (names in order, comma-joined), n_licenses, containment (the largest, 0 without)."""
    found = license_matches(docs, id_col, text_col, templates, contained)
    names = F.array_sort(F.collect_set("template"))
    out = found.groupBy("row").agg(F.first("id").alias(id_col), names.alias("names"), F.coalesce(F.max("containment"), F.lit(0.0)).alias("containment"))
    return out.select(id_col, F.array_join("names", ",").alias("licenses"), F.size("names").cast("long").alias("n_licenses"), "containment")
