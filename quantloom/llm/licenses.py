"""License scans by an exact set-similarity join, in DataFrame operations only.

A text block is a line, or of longer lines each window of BLOCK words that starts every BLOCK / 2 words, so
a passage of up to half a block lies whole in one. A template is the set of its words. A block is found for a
template if it holds `percent` of that set. The join: the templates' words are ordered by their number over
the whole corpus, rarest first. A block that holds enough of a template has one of the template's first words
(prefix filter: size - required + 1 of them), has at least as many of the templates' words as required (length
filter), and from the first word that both share as many are left in both (positional filter). What passes is
counted exactly. Words that no template has can't be shared, so blocks carry only the others.

Texts are read twice: for the words' numbers, and for the places of the base phrases and the blocks that
hold a prefix word. These go to a table with a row number for each document, so what is found comes
back by a unique key and no key is hot. What is broadcast is made from the templates alone.

A score is 1 where a base phrase stands, else the largest part of a template found in a block, else 0.

Defined cases: a null text is empty; a document without words has no places and score 0; null and repeated
doc_ids stay rows of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: The characters of words, the base phrases and their labels.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"  # lower-cased text has no A-Z, so this is all but \x00-\x2F, \x3A-\x60, \x7B-\x7F
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Sentences of well-known licences.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
PERCENT = 90
BLOCK = 64


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def _lines() -> Column:
    """The words of each line."""
    low = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.split(low, "\n"), lambda x: F.regexp_extract_all(x, F.lit(WORD), F.lit(0)))


def _places(phrase: str) -> Column:
    """Where the phrase's words stand one after the other in `words`."""
    parts = phrase.split(" ")
    here = " and ".join(f"get(words, i + {k}) = '{p}'" for k, p in enumerate(parts))
    return F.expr(f"if(array_contains(words, '{parts[0]}') and array_contains(words, '{parts[-1]}'), filter(sequence(0, size(words) - 1), i -> {here}), array())")


def _templates(templates: tuple[tuple[str, str], ...], percent: int) -> list[tuple[str, frozenset[str], int]]:
    """Label, word set and required number of words of each template."""
    out = []
    for label, text in templates:
        words = words_of(text)
        if not words or len(words) > BLOCK // 2:
            raise ValueError(f"a template has 1 to {BLOCK // 2} words: {text}")
        size = len(set(words))
        out.append((label, frozenset(words), -(-percent * size // 100)))
    return out


def ranks_of(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """The templates' words by their number in all texts, rarest first. Words of one text are counted
    before they are sent."""
    some = F.flatten(F.transform(_lines(), lambda line: F.filter(line, lambda w: w.isin(vocabulary))))
    counts = {r.w: r["n"] for r in docs.select(F.explode(some).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # a row for each word of the templates
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def scanned(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """A row for each document with its base places and the blocks that may hold a template; and a row for each
    block found: row, line, start (of its words in the line), label and the part of the template in it."""
    spark = docs.sparkSession
    known = _templates(templates, percent)
    rank = ranks_of(docs, sorted(set().union(*[words for _, words, _ in known])))
    ordered = [(label, sorted(rank[w] for w in words), need) for label, words, need in known]
    prefix = {r for _, ranks, need in ordered for r in ranks[: len(ranks) - need + 1]}
    rare, least = [w for w, r in rank.items() if r in prefix], min(need for _, _, need in known)

    half = BLOCK // 2
    starts = f"sequence(0, greatest(0, size(l) - {half} - 1), {half})"
    blocks = F.expr(f"flatten(transform(lines, (l, k) -> transform({starts}, s -> struct(k as line, s as start, slice(l, s + 1, {BLOCK}) as words))))")
    blocks = F.filter(blocks, lambda b: F.exists(b["words"], lambda w: w.isin(rare)))
    known_words = F.transform(blocks, lambda b: F.struct(b["line"].alias("line"), b["start"].alias("start"), F.array_distinct(F.filter(b["words"], lambda w: w.isin(list(rank)))).alias("words")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _lines().alias("lines")).withColumn("words", F.flatten("lines"))
    places = [_places(p).alias(f"p{i}") for i, p in enumerate(PHRASES)]
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), *places, F.filter(known_words, lambda b: F.size(b["words"]) >= least).alias("blocks"))
    every = F.flatten(F.array(*[f"p{i}" for i in range(len(PHRASES))]))
    labels = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(x)) for i, x in enumerate(PHRASES.values())]))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", every.alias("places"), F.array_sort(F.array_distinct(labels)).alias("base"), "blocks")
    table = written(rows, "license-rows")

    number = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    each = table.select("row", F.explode("blocks").alias("b")).select("row", "b.line", "b.start", F.array_sort(F.transform("b.words", lambda w: number[w])).alias("ranks"))
    tokens = each.select("*", F.posexplode("ranks").alias("j", "rank"))
    index = [(r, i, t, label, ranks, need) for t, (label, ranks, need) in enumerate(ordered) for i, r in enumerate(ranks[: len(ranks) - need + 1])]
    index = spark.createDataFrame(index, "rank int, i int, template int, label string, wanted array<int>, need int")
    met = tokens.join(F.broadcast(index), "rank").filter("size(ranks) >= need and 1 + least(size(wanted) - i - 1, size(ranks) - j - 1) >= need")
    met = met.select("row", "line", "start", "template", "label", "need", F.size(F.array_intersect("ranks", "wanted")).alias("both"), F.size("wanted").alias("size")).filter("both >= need")
    found = met.groupBy("row", "line", "start", "template", "label").agg((F.first("both") / F.first("size")).alias("part"))
    return table, found


def license_scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row."""
    table, found = scanned(docs, templates, percent)
    more = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("part").alias("part"))
    out = table.join(more, "row", "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("part", F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )
