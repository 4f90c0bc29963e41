"""License scans by diagonal voting, in DataFrame functions throughout.

Every rolling word k-gram of the documents is joined to the k-grams of the license templates. A match votes for the
diagonal, place in the document less place in the template; neighbouring diagonals merge, which lets words be missing or
added, and a merged span is verified by the share of the template's words that it covers and by its length.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import gram_at, join_rows, materialize, placed_words

GRAM = 3
SLACK = 3
COVER = 0.6

# The phrases and labels of the contract.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Sentences that the public license texts and their usual notices are known by.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE",
    ],
    "apache": [
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license",
    ],
    "gpl": [
        "it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program",
    ],
    "lgpl": [
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
    ],
    "agpl": [
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\")",
    ],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"],
    "bsl": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "cc0": ["the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work"],
    "cc-by-nc-sa": ["licensed under CC BY-NC-SA 4.0", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "cc-by-nc-nd": ["licensed under CC BY-NC-ND 4.0", "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "cc-by-nc": ["licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by": ["licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
}


def template_words() -> list[tuple[int, str, list[str]]]:
    """(number, label, words) of each template."""
    texts = [(label, t) for label, ts in TEMPLATES.items() for t in ts]
    return [(i, label, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())) for i, (label, t) in enumerate(texts)]


def template_grams(spark: SparkSession, k: int = GRAM) -> DataFrame:
    """(template, label, t_words, t_pos, gram): some five hundred rows, fixed with the templates."""
    rows = [(i, label, len(w), p, w[p : p + k]) for i, label, w in template_words() for p in range(len(w) - k + 1)]
    return spark.createDataFrame(rows, "template int, label string, t_words int, t_pos int, words array<string>").select("template", "label", "t_words", "t_pos", gram_at(F.transform("words", lambda w: F.xxhash64(w)), F.lit(0), k).alias("gram"))


def matches(docs: DataFrame, k: int = GRAM) -> DataFrame:
    """(doc_id, __k, n_words, pos, base, hits): places of phrases and of template k-grams; hits are (template, label, t_words, t_pos).

    One pass over the texts; the first place of each document, or a null one where it has no words, always has one row.
    """
    placed = placed_words(docs)
    base = F.lit(None).cast("string")
    for phrase, label in PHRASES.items():
        same = F.col("x") == F.xxhash64(F.lit(phrase.split()[0]))
        for i, w in enumerate(phrase.split()):
            same &= F.get("all", F.col("pos") + i) == w
        base = F.when(same, label).otherwise(base)
    gram = F.when(F.col("pos") + k <= F.size("all"), gram_at("h", F.col("pos"), k))
    keyed = placed.select("doc_id", "__k", F.size("all").cast("long").alias("n_words"), "pos", base.alias("base"), gram.alias("gram"))
    grams = template_grams(docs.sparkSession, k).groupBy("gram").agg(F.collect_list(F.struct("template", "label", "t_words", "t_pos")).alias("hits"))
    grams = F.broadcast(grams)  # fixed with the templates
    return keyed.join(grams, "gram", "left").filter("base is not null or hits is not null or coalesce(pos, 0) = 0").drop("gram")


def spans(found: DataFrame, k: int = GRAM, slack: int = SLACK, cover: float = COVER) -> DataFrame:
    """(doc_id, __k, label, covered): verified spans, covered being the share of the template's words."""
    votes = found.filter("hits is not null").select("doc_id", "__k", "pos", F.inline("hits")).withColumn("diag", F.col("pos") - F.col("t_pos"))
    lanes = votes.groupBy("doc_id", "__k", "template", "label", "t_words", "diag").agg(F.collect_set("t_pos").alias("at"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    order = Window.partitionBy("doc_id", "__k", "template").orderBy("diag")
    fresh = F.coalesce(F.col("diag") - F.lag("diag").over(order) > slack, F.lit(True)).cast("int")
    lanes = lanes.withColumn("fresh", fresh).withColumn("lane", F.sum("fresh").over(order))
    merged = lanes.groupBy("doc_id", "__k", "template", "label", "t_words", "lane").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.min("first").alias("first"), F.max("last").alias("last"))
    words = F.size(F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + (k - 1))))))
    covered = merged.withColumn("words", words).withColumn("covered", F.col("words") / F.col("t_words"))
    true = (F.col("covered") >= cover) & (F.col("last") + k - F.col("first") <= 1.5 * F.col("t_words") + slack)
    # licenses that differ in a word overlap; the template with most words there is meant, and of several the one with least missing
    along = Window.partitionBy("doc_id", "__k").orderBy("first", "last")
    apart = F.col("first") >= F.coalesce(F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1)) + k, F.lit(0))
    places = covered.filter(true).withColumn("apart", apart.cast("int")).withColumn("place", F.sum("apart").over(along))
    rank = F.struct("words", "covered")
    best = F.max(rank).over(Window.partitionBy("doc_id", "__k", "place"))
    return places.withColumn("most", best).filter(rank == F.col("most")).select("doc_id", "__k", "label", "covered")


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, __k, n_words, n_base, first_word, last_word, base_labels, labels and score for every row of docs.

    Base columns count the places where a phrase's words stand one after the other; labels also has those of verified
    spans. score is 1 where a phrase stands, else the best cover of a verified span, else 0. Null and empty texts have no
    words and no labels; long texts are scanned whole; rows repeated exactly get equal results, and overlapping
    templates that cover as many words and as large a share all count. Columns besides doc_id and text are ignored, whatever their names; an empty table gives
    an empty one.
    """
    found = materialize(matches(docs), "license-matches")
    base = found.filter("base is not null").select("doc_id", "__k", "pos", "base").distinct()
    base = base.groupBy("doc_id", "__k").agg(F.count(F.lit(1)).alias("n_base"), F.min("pos").cast("long").alias("first_word"), F.max("pos").cast("long").alias("last_word"), F.collect_set("base").alias("bases"))
    span = spans(found).groupBy("doc_id", "__k").agg(F.collect_set("label").alias("more"), F.max("covered").alias("covered"))
    rows = found.filter("coalesce(pos, 0) = 0").select("doc_id", "__k", "n_words")
    rows = join_rows(join_rows(rows, base, "left"), span, "left")
    none = F.array().cast("array<string>")
    bases, more = F.coalesce("bases", none), F.coalesce("more", none)
    return rows.select(
        "doc_id",
        "__k",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.array_sort(bases), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(bases, more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("covered", F.lit(0.0))).alias("score"),
    )


def license_digest(docs: DataFrame) -> DataFrame:
    """The columns of the contract."""
    return license_scan(docs).drop("__k")
