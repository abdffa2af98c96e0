"""License scan: MinHash over text windows, with DataFrame functions only.

Texts and templates become words (runs of letters and digits, lower case) and
shingles of five words. For each template size the text is cut into
overlapping windows about twice as long as the template, so that a copy lies
whole in one even if half as many words again stand in between (names, a
comment's marks); bands of MinHash values retrieve templates for a window,
and the exact share of the template's shingles in it decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

SHINGLE, CONTAINMENT = 5, 0.8
#: Different shingles of all templates together at most; more are an error.
MAX_HASHES = 50_000
#: A window that holds CONTAINMENT of a template is missed with this probability at most.
MISS = 1e-6

#: Notices as their licences publish them: (template, licence, text).
TEMPLATES = (
    ("mit-short", "MIT", "Released under the MIT License."),
    ("mit-line", "MIT", "Licensed under the MIT License."),
    ("mit-grant", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-short", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-header", "Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl3-work", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-header", "GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd-terms", "BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-header", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc-grant", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("cc-by", "CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("mit-full", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc-full", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd-2-full", "BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("cc-by-work", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _each(words: Column, make) -> Column:
    """make(five words) at each shingle of the array. The array is bound once, so it is computed once a row."""
    last = lambda ws: F.greatest(F.size(ws) - SHINGLE, F.lit(0))
    at = lambda ws: F.transform(F.sequence(F.lit(0), last(ws)), lambda i: make(*(F.get(ws, i + k) for k in range(SHINGLE))))
    return F.get(F.transform(F.array(words), at), F.lit(0))


def _hashes(words: Column) -> Column:
    return _each(words, F.xxhash64)


def _strings(words: Column) -> Column:
    return F.array_distinct(_each(words, lambda *w: F.concat_ws(" ", *w)))


def windows_for(n: int) -> tuple[int, int, int]:
    """(shingles in a window, stride, bands) for templates of n shingles.

    A copy over at most 3n/2 shingles of the text, wherever it starts, lies
    whole in the window that starts at the stride before it. At CONTAINMENT
    the Jaccard similarity of template and window is at least j, so that all
    bands of one value each miss with probability (1 - j) ** bands.
    """
    stride = max(1, n // 2)
    size = n + n // 2 + stride - 1
    need = math.ceil(CONTAINMENT * n)
    j = need / (size + n - need)
    return size, stride, 1 if j == 1 else math.ceil(math.log(MISS) / math.log(1 - j))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    rows = spark.createDataFrame([list(t) for t in templates], "template string, license string, body string")
    return rows.select("template", "license", _strings(_words(F.col("body"))).alias("shingles"), F.array_distinct(_hashes(_words(F.col("body")))).alias("hashes"))


def scan(documents: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, template, license, containment, n_windows, first_word: the templates found in each document.

    containment is the largest share in a window, n_windows how many windows
    reach CONTAINMENT, first_word where the first of them starts. A copy that
    is spread over more than one and a half times the template's length counts
    with what one window holds of it. A text or
    template of fewer than five words is one shingle of all its words. Null
    and empty texts, an empty table or no templates give no rows; rows that
    repeat a doc_id are one document; rows without an id are one, too. Extra
    columns are not read.

    Texts that share no shingle with any template cannot match and are left
    out before windows are made; the test is exact. Templates are a parameter:
    at most MAX_HASHES shingles, as their hashes are literals of the plan.
    """
    spark = documents.sparkSession
    known = template_table(spark, templates).collect()  # as long as the parameter
    schema = "doc_id bigint, template string, license string, containment double, n_windows bigint, first_word int"
    if not known:
        return spark.createDataFrame([], schema)
    everything = sorted({h for t in known for h in t["hashes"]})
    if len(everything) > MAX_HASHES:
        raise ValueError(f"the templates have {len(everything)} shingles, more than {MAX_HASHES}")
    words = documents.select("doc_id", _words(F.col("text")).alias("words"))
    near = written(words.where(F.size("words") > 0).select("doc_id", "words", _hashes(F.col("words")).alias("hashes")).where(F.arrays_overlap("hashes", F.lit(everything))), "license-near")
    # Few texts are left, wherever they lay; dealt anew, each task gets its share of windows.
    near = near.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("_metadata.file_path", "_metadata.row_index"))
    own: dict[int, set[int]] = {}
    for t in known:
        own.setdefault(len(t["hashes"]), set()).update(t["hashes"])
    cut = near.select("doc_id", F.explode(F.concat(*(_windows(n, sorted(h)) for n, h in sorted(own.items())))).alias("x")).select("doc_id", "x.*")
    probes = cut.select("doc_id", "n", "first_word", "w", F.explode(_signature(F.col("h"), F.col("bands"))).alias("b")).select("doc_id", "n", "first_word", "w", "b.*")
    rows = spark.createDataFrame([(*t, len(t["hashes"]), windows_for(len(t["hashes"]))[2]) for t in known], "template string, license string, shingles array<string>, hashes array<bigint>, n int, bands int")
    index = rows.select("n", "template", "license", "shingles", F.explode(_signature(F.col("hashes"), F.col("bands"))).alias("b")).select("n", "template", "license", "shingles", "b.*")
    share = F.size(F.array_intersect(_strings(F.col("w")), F.col("shingles"))) / F.size("shingles")
    found = (
        probes.join(F.broadcast(index), ["n", "band", "value"])
        .select("doc_id", "template", "license", "first_word", share.alias("containment"))
        .where(F.col("containment") >= CONTAINMENT)
        .dropDuplicates(["doc_id", "template", "first_word"])  # bands that agree retrieve a window once each
    )
    return (
        found.groupBy("doc_id", "template", "license")
        .agg(F.max("containment").alias("containment"), F.count(F.lit(1)).alias("n_windows"), F.min("first_word").alias("first_word"))
    )


def _signature(hashes: Column, bands: Column) -> Column:
    """Band number and MinHash value of each band."""
    return F.transform(F.sequence(F.lit(0), bands - 1), lambda k: F.struct(k.alias("band"), F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, k))).alias("value")))


def _windows(n: int, hashes: list[int]) -> Column:
    """The windows for templates of n shingles; those without any of their hashes cannot match and are left out."""
    size, stride, bands = windows_for(n)
    made = F.transform(
        F.sequence(F.lit(0), F.size("hashes") - 1, F.lit(stride)),
        lambda at: F.struct(F.lit(n).alias("n"), F.lit(bands).alias("bands"), at.alias("first_word"), F.slice("hashes", at + 1, size).alias("h"), F.slice("words", at + 1, size + SHINGLE - 1).alias("w")),
    )
    return F.when(F.arrays_overlap("hashes", F.lit(hashes)), F.filter(made, lambda x: F.arrays_overlap(x["h"], F.lit(hashes)))).otherwise(F.slice(made, 1, 0))
