"""License notices by diagonal voting, in DataFrame operations.

Every run of three words of every text is joined with the positions of that run in known license texts. A match votes
for the diagonal (position in the text minus position in the license). An inserted or missing word moves the rest of a
notice to a neighbouring diagonal, so close diagonals are merged into one span, which is verified by the share of the license's runs
that it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Between words: ASCII without letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3
#: Diagonals at most so far apart belong to one span.
SLACK = 4
#: Least share of a license's runs in a span.
COVERAGE = 0.6
#: Templates are broadcast, so their size is checked.
MAX_TEMPLATE_WORDS = 100_000

#: Phrases and labels fixed by contract.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Creative Commons licenses by label: the short name, and as much of the full one as no other license has.
_CC = (
    ("cc-by", "CC BY", "Commons Attribution"),
    ("cc-by-sa", "CC BY-SA", "Attribution-ShareAlike"),
    ("cc-by-nc", "CC BY-NC", "Attribution-NonCommercial"),
    ("cc-by-nd", "CC BY-ND", "Attribution-NoDerivatives"),
    ("cc-by-nd", "CC BY-ND", "Attribution-NoDerivs"),
    ("cc-by-nc-sa", "CC BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("cc-by-nc-nd", "CC BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    ("cc-by-nc-nd", "CC BY-NC-ND", "Attribution-NonCommercial-NoDerivs"),
)
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Wording of public licenses and of their usual notices.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("boost", "Distributed under the Boost Software License, Version 1.0"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("cc0", "CC0 1.0 Universal"),
    *((label, f"{name} {version}") for label, short, full in _CC for name in (short, full) for version in _CC_VERSIONS),
)


def words_of(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.array_remove(F.split(F.translate(text, upper, upper.lower()), BETWEEN), "")


def runs_of(words: Column) -> Column:
    """Hash of each run of GRAM words."""
    return F.when(F.size(words) < GRAM, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(words) - GRAM), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(GRAM)]))
    )


def template_runs(df: DataFrame, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """(template, label, runs, at, run) of every position of every template."""
    if sum(len(text.split()) for _, text in templates) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {MAX_TEMPLATE_WORDS} words")
    rows = df.sparkSession.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, text string")
    hashed = rows.select("template", "label", words_of(F.col("text")).alias("words")).select("template", "label", runs_of(F.col("words")).alias("all"))
    return hashed.select("template", "label", F.size("all").alias("runs"), F.posexplode("all").alias("at", "run"))


def license_spans(texts: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(doc_id, text_hash, label, first_word, last_word, coverage) of verified spans in (doc_id, text)."""
    words = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    runs = words.select("doc_id", "text_hash", F.posexplode(runs_of(F.col("words"))).alias("place", "run"))
    votes = runs.join(F.broadcast(template_runs(texts, templates)), "run")
    keys = ["doc_id", "text_hash", "template", "label", "runs"]
    diagonals = votes.groupBy(*keys, (F.col("place") - F.col("at")).alias("diagonal")).agg(F.min("place").alias("first"), F.max("place").alias("last"), F.collect_set("at").alias("seen"))
    order = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > SLACK, F.lit(True))
    merged = diagonals.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(order))
    spans = merged.groupBy(*keys, "span").agg(F.min("first").alias("first_word"), (F.max("last") + GRAM - 1).alias("last_word"), F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("n_seen"))
    verified = spans.withColumn("coverage", F.col("n_seen") / F.col("runs")).filter(F.col("coverage") >= COVERAGE)
    return verified.select("doc_id", "text_hash", "label", "first_word", "last_word", "coverage")


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """License phrases and notices of every text.

    Returns one row per input row: doc_id, n_words, n_base (places where a fixed phrase stands), first_word, last_word (the
    least and greatest of their starts, or null), base_labels, labels (with those of verified notices; both distinct,
    sorted and comma-joined), score (the largest share of a notice found; a phrase is found whole).

    Null texts count as empty: no words, no places, empty labels, score 0. Rows that repeat an id are told apart by their
    texts. Other columns are ignored; an empty table gives no rows.
    """
    texts = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    split = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), F.lower("text").contains("license").alias("may_have"), words_of(F.col("text")).alias("words"))

    def places(phrase: str) -> Column:
        parts = phrase.split()
        here = lambda i: F.forall(F.array(*[F.coalesce(F.get("words", i + k) == word, F.lit(False)) for k, word in enumerate(parts)]), lambda x: x)
        return F.when(F.col("may_have") & (F.size("words") > 0), F.filter(F.sequence(F.lit(0), F.size("words") - 1), here)).otherwise(F.array().cast("array<int>"))

    found = split.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), *[places(p).alias(label) for label, p in PHRASES.items()])
    starts = F.concat(*PHRASES)
    base = found.select(
        "doc_id",
        "text_hash",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.filter(F.array(*[F.when(F.size(label) > 0, F.lit(label)) for label in PHRASES]), lambda x: x.isNotNull()).alias("base"),
    )
    spans = license_spans(texts, templates).groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("coverage"))
    b, s = base.alias("b"), spans.alias("s")
    joined = b.join(s, F.col("b.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("b.text_hash") == F.col("s.text_hash")), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return joined.select(
        "b.doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("coverage", F.lit(0.0))).alias("score"),
    )
