"""License texts and notices, found by an exact set-similarity join against templates.

A text block is a window of words, and its set is what it holds of the templates' words. A
template matches a block that holds at least ``threshold`` of the template's distinct
words. The join finds every such pair without comparing all pairs: words are ordered by how
many documents hold them, rarest first; a matching pair must share a word in both prefixes
(prefix filter), the block must hold enough words at all (length filter), and what follows
the first shared word on both sides must suffice (positional filter). Everything runs in
DataFrame functions: one scan of the texts, a join with the templates' prefixes, and a join
of the few hits with one narrow row per document.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sftlens.llm.tables import text_of, written

# Words of a lower-cased text; everything else separates.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases that name a license by themselves.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Rows of the template index that may be broadcast.
MAX_BROADCAST_ROWS = 100_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Template:
    name: str
    label: str
    text: str

    @property
    def words(self) -> list[str]:
        return re.findall(WORD, self.text.translate(str.maketrans(_UPPER, _UPPER.lower())))


# Public license notices and texts, without names and years.
TEMPLATES = (
    Template(
        "gpl-3-notice", "gpl-3", "This work is licensed under the GNU General Public License, version 3."
    ),
    Template(
        "cc-by-notice",
        "cc-by",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    Template(
        "cc-by-nc-notice",
        "cc-by-nc",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    Template(
        "mpl-2-notice",
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
        "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    Template(
        "apache-2-notice",
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    Template(
        "gpl-program",
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, "
        "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    Template(
        "isc-text",
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all "
        "copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
        "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    Template(
        "mit-text",
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in "
        "all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF "
        "ANY KIND, EXPRESS OR IMPLIED.",
    ),
    Template(
        "bsd-text",
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
)


@dataclass(frozen=True)
class _Kind:
    """Templates of one size class: blocks are ``2 * step`` words, one every ``step`` words."""

    step: int
    templates: tuple[Template, ...]

    @property
    def vocabulary(self) -> list[str]:
        return sorted({w for t in self.templates for w in t.words})

    def least(self, threshold: float) -> int:
        return min(needed(t, threshold) for t in self.templates)


def needed(template: Template, threshold: float) -> int:
    """Distinct words of the template that a block must hold."""
    return max(1, math.ceil(round(threshold * len(set(template.words)), 9)))


def kinds_of(templates: Sequence[Template]) -> list[_Kind]:
    """Templates by the power of two that holds their words, so that no block dwarfs its template."""
    by_step: dict[int, list[Template]] = {}
    for t in templates:
        if t.words:
            by_step.setdefault(1 << (len(t.words) - 1).bit_length(), []).append(t)
    return [_Kind(step, tuple(group)) for step, group in sorted(by_step.items())]


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _blocks(kind: _Kind, least: int) -> Column:
    """The blocks of ``words`` with enough template words, null unless the whole text has them."""
    own = _strings(kind.vocabulary)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("words") - 1) / kind.step).cast("int")))

    def block(at: Column) -> Column:
        words = F.slice("words", at * kind.step + 1, 2 * kind.step)
        return F.struct(
            F.lit(kind.step).alias("step"),
            (at * kind.step).alias("first"),
            F.array_intersect(own, words).alias("terms"),
        )

    return F.when(
        F.size(F.array_intersect("terms", own)) >= least,
        F.filter(F.transform(starts, block), lambda b: F.size(b["terms"]) >= least),
    )


def _scanned(docs: DataFrame, kinds: list[_Kind], phrases: Sequence[tuple[str, str]], threshold: float) -> DataFrame:
    """One row per document: ids, phrase places, its template words, and blocks long enough to match."""
    text = text_of()
    # Other letters keep their case, as a lower-cased form could turn into an ASCII letter.
    lower = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )
    spaced = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.trim(F.regexp_replace(lower, SEPARATOR, " ")).alias("spaced"),
    ).select(
        "doc_id",
        F.concat(F.lit(" "), "spaced", F.lit(" ")).alias("line"),
        F.when(F.col("spaced") == "", F.array().cast("array<string>"))
        .otherwise(F.split("spaced", " "))
        .alias("words"),
    )
    n_words = F.size("words").cast("long")
    # Around the places of a phrase: the words before the first and after the last one.
    cuts = [
        F.when(F.contains("line", F.lit(f" {phrase} ")), F.split("line", f" {re.escape(phrase)}(?= )"))
        for phrase, _ in phrases
    ]
    cut = spaced.select("doc_id", "words", *[c.alias(f"cut{i}") for i, c in enumerate(cuts)])
    places = [
        F.when(F.col(f"cut{i}").isNotNull(), F.size(f"cut{i}") - 1).otherwise(0) for i in range(len(phrases))
    ]
    first = [_spaces(F.element_at(f"cut{i}", 1)) for i in range(len(phrases))]
    last = [
        n_words - (_spaces(F.element_at(f"cut{i}", -1)) - 1) - len(phrase.split(" "))
        for i, (phrase, _) in enumerate(phrases)
    ]
    none = F.lit(None).cast("long")
    vocabulary = sorted({w for k in kinds for w in k.vocabulary})
    known = cut.withColumn("terms", F.array_intersect(_strings(vocabulary), "words"))
    blocks = [_blocks(k, k.least(threshold)) for k in kinds]
    empty = F.array().cast("array<struct<step:int,first:int,terms:array<string>>>")
    return known.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        n_words.alias("n_words"),
        reduce(lambda a, b: a + b, places, F.lit(0)).cast("long").alias("n_base"),
        F.least(*first, none, none).cast("long").alias("first_word"),
        F.greatest(*last, none, none).cast("long").alias("last_word"),
        F.array_sort(
            F.array_distinct(
                F.array_compact(F.array(*[F.when(p > 0, F.lit(n)) for p, (_, n) in zip(places, phrases)]))
            )
        )
        .cast("array<string>")
        .alias("base"),
        "terms",
        F.concat(*[F.coalesce(b, empty) for b in blocks], empty).alias("blocks"),
    )


def _index(kinds: list[_Kind], rank: dict[str, int], threshold: float) -> list[tuple]:
    """Prefix words of every template, with their place among its words, rarest first."""
    rows = []
    for k in kinds:
        for t in k.templates:
            ordered = sorted(set(t.words), key=lambda w: (rank[w], w))
            enough = needed(t, threshold)
            for place, word in enumerate(ordered[: len(ordered) - enough + 1]):
                rows.append((k.step, word, t.name, t.label, place, enough, ordered))
    return rows


def _matches(scanned: DataFrame, kinds: list[_Kind], threshold: float) -> DataFrame:
    """``row, template, label, first, containment`` of every block and template that match."""
    spark = scanned.sparkSession
    # One row per template word, whatever the number of documents.
    counted = scanned.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    held = {r["term"]: r["count"] for r in counted}
    words = sorted({w for k in kinds for w in k.vocabulary}, key=lambda w: (held.get(w, 0), w))
    rank = {w: i for i, w in enumerate(words)}
    rows = _index(kinds, rank, threshold)
    fields = ("step", "term", "template", "label", "place", "enough", "ordered")
    schema = "array<struct<step:int,term:string,template:string,label:string,place:int,enough:int,ordered:array<string>>>"
    text = json.dumps([dict(zip(fields, row)) for row in rows])
    index = spark.range(1).select(F.inline(F.from_json(F.lit(text), schema)))
    if len(rows) <= MAX_BROADCAST_ROWS:
        index = F.broadcast(index)
    ordered, least = F.lit(None).cast("array<string>"), F.lit(0)
    for k in kinds:
        mine = F.col("block.step") == k.step
        names = _strings(sorted(k.vocabulary, key=rank.__getitem__))
        ordered = F.when(mine, F.array_intersect(names, "block.terms")).otherwise(ordered)
        least = F.when(mine, F.lit(k.least(threshold))).otherwise(least)
    probes = (
        scanned.where(F.size("blocks") > 0)
        .select("row", F.explode("blocks").alias("block"))
        .select("row", "block.step", "block.first", ordered.alias("held"), least.alias("least"))
        .select(
            "row",
            "step",
            "first",
            "held",
            F.posexplode(F.slice("held", F.lit(1), F.size("held") - F.col("least") + 1)).alias("at", "term"),
        )
    )
    size, wanted = F.size("held"), F.size("ordered")
    common = F.array_intersect("held", "ordered")
    return (
        probes.join(index, ["step", "term"])
        .where(size >= F.col("enough"))
        .where(F.col("at") <= size - F.col("enough"))
        .where(1 + F.least(wanted - F.col("place") - 1, size - F.col("at") - 1) >= F.col("enough"))
        .withColumn("common", common)
        # A pair is met once per shared prefix word; its first one stands for it.
        .where((F.size("common") >= F.col("enough")) & (F.element_at("common", 1) == F.col("term")))
        .select("row", "template", "label", "first", (F.size("common") / wanted).alias("containment"))
    )


def find_licenses(
    docs: DataFrame,
    templates: Sequence[Template] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    threshold: float = 0.8,
) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` per document.

    ``n_base`` counts the places of all phrases, ``first_word`` and ``last_word`` are the
    smallest and largest start among them. ``labels`` adds to the phrases' labels those of
    all templates that match a block. ``score`` is 1 with a phrase, else the highest
    containment among the matches, else 0.

    A null or empty text has no words, no places and no labels. Every row counts for itself,
    also with a null or repeated doc_id; equal texts get equal results. Very long texts are
    more blocks of the same size. An empty table gives no rows. Other columns are ignored.
    """
    kinds = kinds_of(templates)
    scanned = written(_scanned(docs, kinds, phrases, threshold), "license-scan")
    found = (
        _matches(scanned, kinds, threshold)
        .groupBy("row")
        .agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    )
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return scanned.join(found, "row", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def license_blocks(
    docs: DataFrame, templates: Sequence[Template] = TEMPLATES, threshold: float = 0.8
) -> DataFrame:
    """``doc_id, template, label, first_word, n_words, containment`` of every matching block.

    ``n_words`` is the nominal length of the block, which the end of the text may cut. Rows
    without a match, null and empty texts among them, and empty tables give nothing.
    """
    kinds = kinds_of(templates)
    scanned = written(_scanned(docs, kinds, (), threshold), "license-scan")
    lengths = {t.name: 2 * k.step for k in kinds for t in k.templates}
    length = F.create_map(*[F.lit(x) for pair in lengths.items() for x in pair])
    return (
        scanned.select("row", "doc_id")
        .join(_matches(scanned, kinds, threshold), "row")
        .select(
            "doc_id",
            "template",
            "label",
            F.col("first").cast("long").alias("first_word"),
            length[F.col("template")].cast("long").alias("n_words"),
            "containment",
        )
    )
