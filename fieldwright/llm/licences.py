"""Licence scan with a positional index of rare words; DataFrame functions only.

Every template contributes its ``RARE`` words of the lowest document frequency in the corpus to an index
of (word, template, position). A file looks up all of these words that it holds;
each occurrence votes for a template at the place where the template would begin. A
template is found if enough of its rare words agree on one place and its key phrase stands in the file.
Files without an indexed word need no more than the word split.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwright.llm.common import ascii_lower

#: Words are runs of ASCII letters, digits and all that is not ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases whose places are counted, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
RARE = 4
#: Share of a template's rare words that must agree.
ENOUGH = 0.75
#: Bits of a code below the template's number.
START_BITS = 44


@dataclass(frozen=True)
class Template:
    label: str
    key_phrase: str
    text: str


#: Well-known sentences of public licences, in the scan's words.
TEMPLATES = (
    Template("mit", "mit license", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache", "apache license", "licensed under the apache license version 2 0"),
    Template("gpl", "general public license", "this work is licensed under the gnu general public license version"),
    Template("gpl", "gnu general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("lgpl", "lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    Template("cc-by", "creative commons attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
)


def normal(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, joined by one space; empty for null."""
    return ascii_lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BETWEEN, " ")))


def count_words(words: Column) -> Column:
    """Number of words in a string of words joined by one space, with or without spaces at its ends."""
    bare = F.trim(words)
    return F.when(bare == "", 0).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1).cast("long")


def document_frequency(words: DataFrame) -> dict[str, int]:
    """In how many of all files each template word occurs. words: column ``words``; at most as many results as template words."""
    vocabulary = sorted({w for t in TEMPLATES for w in t.text.split()})
    held = F.array_intersect("words", F.array(*map(F.lit, vocabulary)))
    found = dict(words.select(F.explode(held).alias("word")).groupBy("word").count().collect())
    return {w: found.get(w, 0) for w in vocabulary}


def rare_index(frequency: dict[str, int]) -> list[list[tuple[str, int]]]:
    """For each template its rarest words with their positions."""
    index = []
    for template in TEMPLATES:
        words = template.text.split()
        rare = sorted(set(words), key=lambda w: (frequency.get(w, 0), w))[:RARE]
        index.append([(w, words.index(w)) for w in sorted(rare, key=words.index)])
    return index


def postings(index: list[list[tuple[str, int]]]) -> Column:
    """Rare word -> codes of the templates that hold it.

    A code plus 8 x the word's place in a file gives template, place of the template's beginning and number of the
    word, from high to low bits.
    """
    of: dict[str, list[int]] = {}
    for template, words in enumerate(index):
        for number, (word, position) in enumerate(words):
            of.setdefault(word, []).append((template << START_BITS) + (((1 << 24) - position) << 3) + number)
    return F.create_map(*[x for w, codes in of.items() for x in (F.lit(w), F.array(*[F.lit(c).cast("long") for c in codes]))])


def agreeing(codes: Column, words: int) -> Column:
    """Templates (numbers) of which so many rare words agree on one beginning; codes are distinct and sorted."""
    starts = F.transform(codes, lambda c: F.shiftright(c, 3))
    # in sorted order that many agree if an entry equals the one so many less one places on
    same = F.zip_with(starts, F.slice(starts, words, F.greatest(F.size(starts), F.lit(1))), lambda a, b: F.when(a == b, F.shiftright(a, START_BITS - 3).cast("int")))
    return F.array_distinct(F.array_compact(same))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of all phrases, first_word and last_word are their least and greatest
    start in words from 0 (null without a place). base_labels are the phrases' labels, labels also those of
    templates found; distinct, sorted, comma-joined, empty if none. score: 1 with a base label, else the
    greatest share of rare words of a template found, else 0. Null text counts as empty; repeated rows and
    null doc_ids give a row each. Further columns play no part. No documents: no rows.
    """
    rows = docs.select("doc_id", normal(F.col("text").cast("string")).alias("normal"))
    rows = rows.withColumn("words", F.split("normal", " ", -1))
    frequency = document_frequency(rows.select("words"))
    index = rare_index(frequency)
    order = sorted({w for postings in index for w, _ in postings}, key=lambda w: (frequency[w], w))
    rows = rows.withColumn("n_words", count_words(F.col("normal"))).withColumn("padded", F.concat(F.lit(" "), "normal", F.lit(" ")))
    places, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES:
        inside = F.col("padded").contains(f" {phrase} ")
        before = F.substring_index("padded", f" {phrase} ", 1)
        after = F.substring_index("padded", f" {phrase} ", -1)
        places.append(F.when(inside, F.regexp_count("padded", F.lit(f" {phrase}(?= )"))).otherwise(0))
        firsts.append(F.when(inside, count_words(before)))
        lasts.append(F.when(inside, F.col("n_words") - count_words(after) - len(phrase.split())))
        labels.append(F.when(inside, F.lit(label)))
    rows = rows.withColumn("n_base", reduce(lambda a, b: a + b, places).cast("long")).withColumn("first_word", F.least(*firsts)).withColumn("last_word", F.greatest(*lasts))
    rows = rows.withColumn("_base", F.array_compact(F.array(*labels)))
    # all indexed words that the file holds, at most RARE for each template
    rows = rows.withColumn("_rare", F.array_intersect(F.array(*map(F.lit, order)), "words"))
    at = F.transform("words", lambda w, i: F.when(F.array_contains("_rare", w), F.transform(F.element_at(postings(index), w), lambda c: c + i.cast("long") * 8)))
    codes = F.array_sort(F.array_distinct(F.flatten(F.filter(at, lambda h: h.isNotNull()))))
    rows = rows.withColumn("_codes", F.when(F.size("_rare") > 0, codes).otherwise(F.array().cast("array<bigint>")))
    keys = F.array(*[F.lit(f" {t.key_phrase} ") for t in TEMPLATES])
    names = F.array(*[F.lit(t.label) for t in TEMPLATES])
    least = max(1, math.ceil(ENOUGH * RARE))
    verified = lambda m: F.filter(agreeing(F.col("_codes"), m), lambda t: F.contains(F.col("padded"), F.element_at(keys, t + 1)))
    for m in range(least, RARE + 1):
        rows = rows.withColumn(f"_found{m}", verified(m))
    found = F.transform(F.col(f"_found{least}"), lambda t: F.element_at(names, t + 1))
    best = F.lit(0.0)
    for m in range(least, RARE + 1):
        best = F.when(F.size(f"_found{m}") > 0, F.lit(m / RARE)).otherwise(best)
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("_base")).alias("base_labels"), joined(F.concat("_base", found)).alias("labels"),
        F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
