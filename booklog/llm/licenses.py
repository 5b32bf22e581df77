"""License scans: phrases, and templates found by an exact set-similarity join.

Everything runs on built-in functions. A block is a window of consecutive words, twice as long
as the longest template of its class and starting every so many words, so that every notice
stands whole in some block. A template is found where a block holds at least ``THRESHOLD`` of
the template's distinct words.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored, whole_text

THRESHOLD = 0.8
# Phrases of the base labels.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
# Short notices and longer standard passages of public licenses.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-text": "Unless required by applicable law or agreed to in writing, software distributed under the "
    "License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met.",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
    "your option) any later version.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
    "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files, to deal in the Software without restriction.",
    "mpl-2.0-text": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
    "the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
# The longest template of each class, in words; blocks have twice as many.
CLASSES = (16, 64)
_WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The one letter beyond ASCII whose lower case is an ASCII letter, and a stand-in for it.
_KELVIN, _STAND_IN = "\u212a", "\ue000"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    size_class: int

    @property
    def least(self) -> int:
        """Distinct words that a block must share."""
        return math.ceil(THRESHOLD * len(self.words) - 1e-9)


def templates() -> list[Template]:
    found = []
    for label, text in TEMPLATES.items():
        words = re.findall("[a-z0-9]+", text.lower())
        size_class = min(size for size in CLASSES if size >= len(words))
        found.append(Template(label, tuple(dict.fromkeys(words)), size_class))
    return found


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case, in order.

    ``lower`` also changes letters beyond ASCII, which neither moves a word's bounds nor makes
    it equal to a word of a phrase or template.
    """
    lowered = F.lower(F.replace(text, F.lit(_KELVIN), F.lit(_STAND_IN)))
    return F.array_remove(F.split(lowered, _WORD_BREAK), "")


def _places(words: Column, phrase: str) -> Column:
    def stands(at):
        equal = [F.get(words, at + k) == word for k, word in enumerate(phrase.split())]
        return F.coalesce(equal[0] & equal[1] & equal[-1], F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), stands)


def _literals(values) -> Column:
    return F.array(*(F.lit(x) for x in values)) if values else F.array().cast("array<string>")


def _windows(words: Column, last: Column, size: int, known: Column, least: int) -> Column:
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.array_intersect(F.slice(words, k * size + 1, 2 * size), known),
    )
    return F.filter(windows, lambda tokens: F.size(tokens) >= least)


def scanned(docs: DataFrame) -> DataFrame:
    """One pass over the texts, stored: base columns, and the blocks that can hold a template.

    A block keeps only its distinct words that occur in templates of its class; it is kept
    where these are as many as the least demanding template needs (the length filter).
    """
    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("words", words_of(F.col("text"))).drop("text")
    words = F.col("words")
    none = F.array().cast("array<int>")
    licensed = F.array_contains(words, "license")
    rows = rows.withColumns(
        {f"at_{label}": F.when(licensed, _places(words, p)).otherwise(none) for label, p in PHRASES.items()}
    )
    every = F.concat(*(F.col(f"at_{label}") for label in PHRASES))
    blocks = []
    for size in CLASSES:
        mine = [t for t in templates() if t.size_class == size]
        known = _literals(sorted({w for t in mine for w in t.words}))
        least = min(t.least for t in mine)
        last = F.greatest(F.lit(0), F.ceil(F.size(words) / F.lit(size)).cast("int") - 2)
        kept = _windows(words, last, size, known, least)
        able = F.size(F.array_intersect(words, known)) >= least
        blocks.append(F.when(able, kept).otherwise(F.array().cast("array<array<string>>")).alias(f"blocks_{size}"))
    return stored(
        rows.select(
            "row",
            F.col("doc_id").cast("long").alias("doc_id"),
            F.size(words).cast("long").alias("n_words"),
            F.size(every).cast("long").alias("n_base"),
            F.array_min(every).cast("long").alias("first_word"),
            F.array_max(every).cast("long").alias("last_word"),
            F.filter(
                F.array(*(F.when(F.size(f"at_{label}") > 0, label) for label in sorted(PHRASES))),
                lambda x: x.isNotNull(),
            ).alias("base"),
            *blocks,
        ),
        "license-blocks",
    )


def template_matches(scan: DataFrame) -> DataFrame:
    """``row, label, containment`` of every template that some block of the row holds.

    Words are ordered by how many blocks hold them, the rarest first. Two sets that share
    enough words share one among the first few of either; those prefixes are joined, pairs
    whose places leave too few words are dropped, and the rest is counted out on whole sets.
    """
    spark = scan.sparkSession
    found = None
    for size in CLASSES:
        mine = [t for t in templates() if t.size_class == size]
        blocks = scan.select("row", F.posexplode(f"blocks_{size}").alias("block", "tokens"))
        # A row per template word at most: the templates are constants.
        counts = {r.token: r.n for r in blocks.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
        ordered = sorted({w for t in mine for w in t.words}, key=lambda w: (counts.get(w, 0), w))
        rank = {word: at for at, word in enumerate(ordered)}
        prefixes = [
            (word, t.label, at, len(t.words), t.least, sorted(t.words, key=rank.__getitem__))
            for t in mine
            for at, word in enumerate(sorted(t.words, key=rank.__getitem__)[: len(t.words) - t.least + 1])
        ]
        sought = spark.createDataFrame(
            prefixes, "token string, label string, at int, size int, least int, template array<string>"
        )
        least = min(t.least for t in mine)
        sets = blocks.select("row", "block", F.array_intersect(_literals(ordered), "tokens").alias("tokens"))
        heads = sets.select(
            "row", "block", "tokens", F.posexplode(F.slice("tokens", F.lit(1), F.size("tokens") - least + 1)).alias("place", "token")
        )
        left = F.least(F.size("tokens") - F.col("place"), F.col("size") - F.col("at"))
        pairs = heads.join(F.broadcast(sought), "token").filter((F.size("tokens") >= F.col("least")) & (left >= F.col("least")))
        overlap = F.size(F.array_intersect("tokens", "template"))
        held = pairs.filter(overlap >= F.col("least")).select("row", "label", (overlap / F.col("size")).alias("containment"))
        found = held if found is None else found.unionByName(held)
    return found.groupBy("row", "label").agg(F.max("containment").alias("containment"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Labels, places and a score for every row of ``docs``.

    ``n_base, first_word, last_word, base_labels`` tell of the phrases; ``labels`` adds those
    of the templates, in order. ``score`` is 1 where a phrase stands, else the largest
    containment among the templates found, else 0. A null or empty text has no words and no
    labels; rows with null or repeated ids keep their own row; other columns are not read.
    """
    scan = scanned(docs)
    matches = template_matches(scan).groupBy("row").agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("best")
    )
    joined = scan.drop(*(f"blocks_{size}" for size in CLASSES)).join(matches, "row", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def oracle_sql() -> str:
    """The same result by brute force: every block against every template."""
    rows = ", ".join(
        f"('{t.label}', {t.size_class}, {t.least}, {list(t.words)!r})" for t in templates()
    )
    places = ", ".join(
        "list_filter(range(len(w)), lambda i: "
        + " AND ".join(f"w[i + {k + 1}] IS NOT DISTINCT FROM '{x}'" for k, x in enumerate(p.split()))
        + f") AS at_{label}"
        for label, p in PHRASES.items()
    )
    return f"""
    WITH templates(label, size, least, words) AS (VALUES {rows}),
    texts AS (
      SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    base AS (SELECT r, doc_id, len(w) AS n_words, {places} FROM texts),
    blocks AS (
      SELECT r, size, list_distinct(w[k * size + 1 : k * size + 2 * size]) AS b
      FROM texts, (SELECT DISTINCT size FROM templates),
        unnest(range(greatest(0, ((len(w) + size - 1) // size) - 2) + 1)) AS t(k)),
    held AS (
      SELECT r, label, max(len(list_intersect(b, words)) / len(words)) AS c
      FROM blocks JOIN templates USING (size)
      WHERE len(list_intersect(b, words)) >= least GROUP BY ALL),
    best AS (SELECT r, list(label) AS found, max(c) AS c FROM held GROUP BY r),
    labelled AS (
      SELECT *, at_mit || at_apache || at_gpl AS places, list_sort(list_filter(
        [CASE WHEN len(at_apache) > 0 THEN 'apache' END, CASE WHEN len(at_gpl) > 0 THEN 'gpl' END,
         CASE WHEN len(at_mit) > 0 THEN 'mit' END], lambda x: x IS NOT NULL)) AS b
      FROM base LEFT JOIN best USING (r))
    SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word,
      list_max(places) AS last_word, array_to_string(b, ',') AS base_labels,
      array_to_string(list_sort(list_distinct(b || coalesce(found, []))), ',') AS labels,
      CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(c, 0) END::DOUBLE AS score
    FROM labelled"""
