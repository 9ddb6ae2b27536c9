"""License scans by diagonal voting, in DataFrame operations only.

Method: the hash of every ``k`` consecutive words of every text is joined to the places of the same hash in the license
templates (a table of fixed size, so it is broadcast).  A hit at text place p and template place t votes for the diagonal
p - t.  Votes are summed by document, template and diagonal; neighbouring diagonals (a word more or less) are merged; and
a merged span is verified by the share of the template's k-grams it covers and by its length.  Beside this stand the base
phrases, found where their words follow one another.

Only hits are shuffled, never texts or all k-grams.  No Python runs on the executors.

Defined cases: null texts count as empty; rows without a doc_id take no part; repeated rows give repeated results, and rows of one
id with other texts are judged each by itself; a phrase or template may occur any number of times; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.llm._base import texts

#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Opening or notice texts of public licenses.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-2": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc-by": "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    "cc-by-nc": "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
}


def word_list(text: Column) -> Column:
    """Lower-cased (A-Z) words of ASCII letters, digits and everything beyond ASCII."""
    upper = "".join(map(chr, range(65, 91)))
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    return F.filter(parts, lambda w: w != "")  # a gap at either end leaves an empty part


def with_words(docs: DataFrame) -> DataFrame:
    """doc_id, row and w, the words; made by a generator, so that the optimizer can't repeat the splitting in each use of w.

    ``row`` tells rows of one id apart by their texts.
    """
    return docs.select("doc_id", F.xxhash64("text").alias("row"), F.explode(F.array(word_list(F.col("text")))).alias("w"))


def _places(words: Column, padded: Column, phrase: str) -> Column:
    """All start places of a phrase; texts without it as a string are settled without looking at single words."""
    own = phrase.split()

    def here(i: Column) -> Column:
        fits = F.get(words, i) == own[0]
        for j, w in enumerate(own[1:], 1):
            fits = fits & (F.get(words, i + j) == w)
        return F.coalesce(fits, F.lit(False))

    return F.when(F.contains(padded, F.lit(f" {phrase} ")), F.filter(F.sequence(F.lit(0), F.size(words) - len(own)), here)).otherwise(F.array().cast("array<int>"))


def _grams(words: Column, k: int) -> Column:
    """Hashes of the k words from each place on."""
    starts = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))


def scan_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, k: int = 5, drift: int = 4, cover: float = 0.5) -> DataFrame:
    """Verified spans: doc_id, row (the text's xxhash64), label, first_word, end_word (exclusive), coverage of the template's k-grams."""
    docs = texts(docs, key, text)
    known = docs.sparkSession.createDataFrame(list((templates or TEMPLATES).items()), "label string, body string")
    known = known.select("label", _grams(word_list(F.col("body")), k).alias("g"))
    known = known.select("label", F.size("g").alias("grams"), F.posexplode("g").alias("t", "h"))
    at = with_words(docs).select("doc_id", "row", F.posexplode(_grams(F.col("w"), k)).alias("p", "h"))
    hits = at.join(F.broadcast(known), "h").withColumn("diagonal", F.col("p") - F.col("t"))
    votes = hits.groupBy("doc_id", "row", "label", "grams", "diagonal").agg(F.collect_set("t").alias("ts"), F.min("p").alias("lo"), F.max("p").alias("hi"))
    order = W.partitionBy("doc_id", "row", "label").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > drift, F.lit(True))
    merged = votes.withColumn("far", far.cast("int")).withColumn("span", F.sum("far").over(order))
    merged = merged.groupBy("doc_id", "row", "label", "grams", "span").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ts")))).alias("votes"), F.min("lo").alias("first_word"), (F.max("hi") + k).alias("end_word"))
    merged = merged.withColumn("coverage", F.col("votes") / F.col("grams"))
    good = (F.col("coverage") >= cover) & (F.col("end_word") - F.col("first_word") <= 2 * (F.col("grams") + k))
    return merged.where(good).select("doc_id", "row", "label", "first_word", "end_word", "coverage")


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, **options) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is 1 with a base phrase, else the largest coverage of a verified span, else 0.
    """
    phrases = phrases or PHRASES
    rows = with_words(texts(docs, key, text))
    rows = rows.withColumn("padded", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")))
    names = [f"at_{i}" for i in range(len(phrases))]
    rows = rows.select("doc_id", "row", F.size("w").cast("long").alias("n_words"), *(_places(F.col("w"), F.col("padded"), p).alias(n) for n, p in zip(names, phrases, strict=True)))
    every = F.concat(*names)
    base = F.array_sort(F.array_distinct(F.filter(F.array(*(F.when(F.size(n) > 0, F.lit(v)) for n, v in zip(names, phrases.values(), strict=True))), lambda x: x.isNotNull())))
    rows = rows.select("doc_id", "row", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), base.alias("base"))
    found = scan_spans(docs, key, text, **options).groupBy("doc_id", "row").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("best"))
    both = rows.join(found, ["doc_id", "row"], "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
