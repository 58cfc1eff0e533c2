"""License scans: phrases by place, and an exact set-similarity join of text blocks with templates."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, functions as F

from alertloom.llm.common import ascii_lower, settled
from alertloom.runtime import broadcast_if_small

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: A block holds a template if this share of the template's distinct words stands within a window of the block ...
CONTAINMENT = 0.9
#: ... that is as many times as long as the template.
SPAN = 3
#: The sentences of common licenses and of the notices that their authors ask for, one template each.
TEMPLATES = (
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("boost", "Distributed under the Boost Software License, Version 1.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "All rights reserved."),
)
#: Distinct template words that may be sent to every task.
VOCABULARY = 20_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Blocks end at a sentence mark before white space, or at a blank line; notices are wrapped, so a single line break ends none.
BLOCK_END = r"[.!?]+[\x09-\x0D\x20]+|(?>\r\n|[\n\r])[\x09\x0B\x0C\x20]*[\n\r]"


def template_words(text: str) -> list[str]:
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    return list(dict.fromkeys(w for w in re.split(NOT_WORD, lower) if w))


def _spaced(text):
    """The words of a lower-cased text with single spaces around each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, NOT_WORD, " ")), F.lit(" "))


def _count_spaces(text):
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _places(spaced, n_words, phrase: str):
    """(count, first, last) of the places where the phrase's words stand consecutively."""
    own, size = f" {phrase} ", phrase.count(" ") + 1
    there = F.contains(spaced, F.lit(own))
    # A look-ahead matches no characters, so places may share words.
    count = F.when(there, F.regexp_count(spaced, F.lit(f"(?={own})"))).otherwise(0).cast("long")
    first = F.when(there, _count_spaces(F.substring(spaced, F.lit(1), F.locate(own, spaced) - 1)))
    behind = F.reverse(spaced)
    after = _count_spaces(F.substring(behind, F.lit(1), F.locate(own[::-1], behind) - 1))
    return count, first, F.when(there, n_words - after - size)


def _frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents of the whole table each template word stands."""
    there = docs.select(F.explode(F.array_intersect(F.split(_spaced(F.col("text")), " "), F.lit(vocabulary))).alias("word"))
    return {r["word"]: r["n"] for r in there.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def scan_licenses(
    docs: DataFrame, templates=TEMPLATES, phrases: dict[str, str] = PHRASES, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Phrases and template blocks of every whole text, one row per document.

    Columns: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.
    ``score`` is 1 if a phrase stands in the text, else the largest containment of a
    template in a window of a block at or above the threshold, else 0. Blocks end at sentence
    marks and blank lines; a window is ``SPAN`` times as long as the template, so words that are
    scattered over a long block make no notice.

    The join is exact. Template words are ordered from rare to frequent by counts over the
    whole table. A block that holds a template's required number of words shares the first
    shared word with the template's prefix; blocks without any prefix word are dropped in
    the scan, and so are blocks with fewer template words than any template requires. What
    is left meets the templates by an equi-join on prefix words, with length and positional
    filters, and every window is verified by intersection. Templates travel with the plan, ``VOCABULARY``
    distinct words at most; their index is broadcast when its measured size allows.

    A null text counts as empty: no words, no labels, score 0. A very long text is one row
    with as many blocks as it has sentences, and the windows of a block without an end slide over it. Rows with null or repeated
    identifiers are scanned one by one. Other columns are not read. An empty table gives
    an empty result.
    """
    sets = [(label, template_words(text)) for label, text in templates]
    sets = [(label, words) for label, words in sets if words]
    vocabulary = sorted({w for _, words in sets for w in words})
    if len(vocabulary) > VOCABULARY:
        raise ValueError(f"templates have {len(vocabulary)} distinct words; {VOCABULARY} may travel with a plan")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))

    frequency = _frequencies(texts, vocabulary)
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    need = [max(1, math.ceil(containment * len(words) - 1e-9)) for _, words in sets]
    ordered = [sorted(rank[w] for w in words) for _, words in sets]
    prefixes = sorted({r for ranks, o in zip(ordered, need, strict=True) for r in ranks[: len(ranks) - o + 1]})
    by_rank = sorted(rank, key=rank.get)
    least = min(need)

    spaced = texts.select("doc_id", "text", _spaced(F.col("text")).alias("spaced"))
    counted = spaced.withColumn("n_words", F.when(F.col("spaced") == "  ", 0).otherwise(_count_spaces(F.col("spaced")) - 1).cast("long"))
    found = [_places(F.col("spaced"), F.col("n_words"), p) for p in phrases]
    ranks = F.create_map(*[F.lit(x) for w, r in rank.items() for x in (w, r)])

    def of_block(block):
        words = F.array_intersect(F.split(_spaced(block), " "), F.lit(by_rank))
        return F.struct(F.array_sort(F.transform(words, lambda w: ranks[w])).alias("b"), block.alias("text"))

    def held(x):
        # Only a block that holds a prefix word can meet a template.
        return (F.size(x["b"]) >= least) & F.arrays_overlap(x["b"], F.lit(prefixes))

    likely = F.arrays_overlap(F.split("spaced", " "), F.lit([by_rank[r] for r in prefixes]))
    blocks = F.filter(F.transform(F.split("text", BLOCK_END), of_block), held)
    blocks = F.transform(blocks, lambda x: F.struct(x["b"].alias("b"), F.filter(F.split(_spaced(x["text"]), " "), lambda w: w != "").alias("words")))
    none = "array<struct<b: array<int>, words: array<string>>>"
    firsts, lasts = [f for _, f, _ in found], [b for _, _, b in found]
    base = settled(
        counted.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "n_words",
            sum((c for c, _, _ in found), F.lit(0).cast("long")).alias("n_base"),
            F.array_min(F.array(*firsts)).alias("first_word"), F.array_max(F.array(*lasts)).alias("last_word"),
            F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(f.isNotNull(), label) for f, label in zip(firsts, phrases.values(), strict=True)])))).alias("base"),
            F.when(likely, blocks).otherwise(F.array().cast(none)).alias("blocks"),
        ),
        "licenses",
    )

    entries = [
        (k, label, ranks_, words, o, r, i)
        for k, ((label, words), ranks_, o) in enumerate(zip(sets, ordered, need, strict=True)) for i, r in enumerate(ranks_[: len(ranks_) - o + 1])
    ]
    index = spark.createDataFrame(entries, "template int, label string, t array<int>, t_words array<string>, need int, word int, i int")
    cut = base.select("row", F.posexplode("blocks").alias("block", "x")).select("row", "block", "x.b", "x.words")
    probes = cut.select("row", "block", "b", "words", F.posexplode(F.slice("b", F.lit(1), F.size("b") - least + 1)).alias("j", "word"))
    room = 1 + F.least(F.size("t") - F.col("i") - 1, F.size("b") - F.col("j") - 1)
    met = probes.join(broadcast_if_small(index), "word").where((F.size("b") >= F.col("need")) & (room >= F.col("need")))
    met = met.where(F.size(F.array_intersect("b", "t")) >= F.col("need"))
    # A template meets a block once for each prefix word that both hold; one is enough.
    met = met.groupBy("row", "block", "template").agg(F.first("label").alias("label"), F.first("t").alias("t"), F.first("t_words").alias("t_words"), F.first("need").alias("need"), F.first("words").alias("words"))
    window = lambda k: F.slice("words", k, SPAN * F.size("t_words"))
    shared = F.array_max(F.transform(F.sequence(F.lit(1), F.size("words")), lambda k: F.size(F.array_intersect(window(k), F.col("t_words")))))
    hits = met.withColumn("shared", shared).where("shared >= need").groupBy("row").agg(
        F.collect_set("label").alias("more"), F.max(F.col("shared") / F.size("t")).alias("contained")
    )
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    return base.drop("blocks").join(hits, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("contained", F.lit(0.0))).alias("score"),
    )
