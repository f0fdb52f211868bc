"""Licence scans by sentence rules, with DataFrame functions only.

Sentences may be wrapped over lines; numbers of list items are dropped. Every
sentence of a text is normalised (lower case, runs of anything but letters
and digits as one space) and looked up among known licence sentences. What is
found is a sequence of sentence identifiers, broken where other sentences stand
between. Rules are identifier sequences in a fixed order, longer ones first; a
rule takes what it matches, so that a part of a full licence is not reported once
more by a shorter rule.

Defined cases: a null or empty text has no licence; a licence that occurs twice
is listed once and counted twice; rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .fingerprints import let

#: Identifier and normalised sentence.
SENTENCES: list[tuple[str, str]] = [
    ("AP1", "licensed under the apache license version 2 0"),
    ("AP1", "this project is licensed under the apache license 2 0"),
    ("AP2", "licensed under the apache license version 2 0 the license"),
    ("AP3", "you may not use this file except in compliance with the license"),
    ("AP4", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("MI1", "released under the mit license"),
    ("MI1", "licensed under the mit license"),
    ("MI1", "this project is licensed under the mit license"),
    ("MI2", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("MI3", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MI4", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("GP1", "this work is licensed under the gnu general public license version 3"),
    ("GP1", "licensed under the gnu general public license version 3"),
    ("GP2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GP3", "see the gnu general public license for more details"),
    ("BS1", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BS2", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BS3", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("BS4", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("CN1", "licensed under cc by nc 4 0"),
    ("CN1", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("CB1", "licensed under cc by 4 0"),
    ("CB1", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("CS1", "licensed under cc by sa 4 0"),
    ("AP5", "spdx license identifier apache 2 0"),
    ("MI5", "spdx license identifier mit"),
    ("GP5", "spdx license identifier gpl 3 0 or later"),
    ("GP5", "spdx license identifier gpl 3 0 only"),
    ("BS5", "spdx license identifier bsd 3 clause"),
]

#: Rules in the order they are tried: licence, identifiers.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("BSD-3-Clause", ("BS1", "BS2", "BS3", "BS4")),
    ("Apache-2.0", ("AP2", "AP3", "AP4")),
    ("MIT", ("MI2", "MI3", "MI4")),
    ("BSD-2-Clause", ("BS1", "BS2", "BS3")),
    ("GPL-3.0", ("GP2", "GP3")),
    ("Apache-2.0", ("AP1",)),
    ("Apache-2.0", ("AP2",)),
    ("Apache-2.0", ("AP5",)),
    ("MIT", ("MI1",)),
    ("MIT", ("MI2",)),
    ("MIT", ("MI5",)),
    ("GPL-3.0", ("GP1",)),
    ("GPL-3.0", ("GP2",)),
    ("GPL-3.0", ("GP5",)),
    ("BSD-3-Clause", ("BS5",)),
    ("CC-BY-NC-4.0", ("CN1",)),
    ("CC-BY-4.0", ("CB1",)),
    ("CC-BY-SA-4.0", ("CS1",)),
]

#: Every known sentence has one of these, so a text without them has no known sentence.
ANCHORS = ("licen", "redistribut", "copyright", "software")
BREAK = r"[.!?;:]+\s+|[.!?;:]*\n\s*"

#: What the scan knows beyond the SQL's tables above: sentences of official notices that stand between or hold several.
MORE_SENTENCES: list[tuple[str, str]] = [
    ("AP2  AP3", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("GP4", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GP6", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
]
MORE_RULES: list[tuple[str, tuple[str, ...]]] = [
    ("GPL-3.0", ("GP2", "GP4", "GP3")),
    ("GPL-2.0", ("GP6", "GP4", "GP3")),
    ("GPL-2.0", ("GP6", "GP3")),
    ("GPL-2.0", ("GP6",)),
]
MORE_ANCHORS = ("distributed in the hope",)

#: Sentences end at blank lines (or lines of marks only) and at .!? before white space. A blank line before an address ends none.
SENTENCE = r"[.!?]+\s+|(?<!license at)[ \t\r]*\n(?:[^\p{L}\p{N}\n]*\n)+"
#: A sentence that isn't known is looked up in parts: between ; and :, then line by line.
CLAUSE, LINE = r"(?<!identifier)[;:]+\s+", r"\s*\n\s*"
#: What stands on lines by itself: the number of a list's item, and a copyright notice.
ITEM = r"(?m)^[^\p{L}\p{N}\n]{0,8}\(?[0-9]{1,2}[.)][ \t]+"
NOTICE = r"(?m)^([^\p{L}\p{N}\n]{0,8}copyright\s*(?:\(c\)|©|[0-9]{4})[^\n]*)$"


def sentence_ids(text: Column) -> Column:
    """The identifiers of the text's known sentences as ' AP2 AP3 - MI1 ', '-' where others stand between."""
    known = F.create_map(*(F.lit(x) for name, sentence in (*SENTENCES, *MORE_SENTENCES) for x in (sentence, name)))
    plain = lambda s: F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " "))
    anchored = lambda s: F.exists(F.array(*(F.lit(a) for a in (*ANCHORS, *MORE_ANCHORS))), lambda a: F.contains(s, a))

    def named(s: Column, breaks: tuple[str, ...]) -> Column:
        found = F.try_element_at(known, plain(s))
        other = F.flatten(F.transform(F.split(s, breaks[0]), lambda part: named(part, breaks[1:]))) if breaks else F.array(F.lit("-"))
        return F.when(~anchored(s), F.array(F.lit("-"))).when(found.isNotNull(), F.array(found)).otherwise(other)

    own = F.regexp_replace(F.regexp_replace(F.lower(text), ITEM, "\n\n"), NOTICE, "\n\n$1\n\n")
    names = F.flatten(F.transform(F.split(own, SENTENCE), lambda s: named(s, (CLAUSE, LINE))))
    joined = F.concat(F.lit(" "), F.array_join(names, "  "), F.lit(" "))
    return F.regexp_replace(joined, r"(?: - )+", " - ")


def _taking(name: str, run: str) -> Callable[[Column], Column]:
    """Moves every occurrence of run from what is left to the hits, as name."""

    def take(s: Column) -> Column:
        rest = F.replace(s["rest"], F.lit(run), F.lit(" + "))
        times = (F.length(s["rest"]) - F.length(rest)) / F.lit(len(run) - 3)
        return F.struct(rest.alias("rest"), F.concat(s["hits"], F.array_repeat(F.lit(name), times.cast("int"))).alias("hits"))

    return take


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids, licenses (in the rules' order, joined by ', '), n_matches (of rules)."""
    text = text_of()
    found = F.when(F.lower(text).rlike("|".join(ANCHORS)), sentence_ids(text)).otherwise(F.lit(" - "))
    seen = docs.select("doc_id", found.alias("sentence_ids"))
    none = F.array().cast("array<string>")
    state = F.struct(F.col("sentence_ids").alias("rest"), none.alias("hits"))
    for name, ids in (*MORE_RULES, *RULES):
        # each identifier stands between two blanks of its own, so replace() takes neighbours too
        state = let(state, _taking(name, "".join(f" {x} " for x in ids)))
    hits = seen.withColumn("hits", F.when(F.col("sentence_ids") == " - ", none).otherwise(state["hits"]))
    return hits.select("doc_id", F.trim("sentence_ids").alias("sentence_ids"), F.array_join(F.array_distinct("hits"), ", ").alias("licenses"), F.size("hits").cast("long").alias("n_matches"))
