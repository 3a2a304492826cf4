"""Licence scan: Dice coefficient over word bigrams against licence templates, in DataFrame functions only.

A text is looked at by line, by paragraph (between blank lines) and whole. A
unit is normalised (lower case; white space and ASCII punctuation separate
words) and cut into its set of word bigrams, held as 64-bit hashes. The Dice coefficient with a
template of b bigrams can reach t only if the unit has between t b / (2 - t)
and (2 - t) b / t bigrams: the templates are listed under every admissible
number, and a unit is compared with those under its own. The template list is
bounded by its parameters and is broadcast; texts are not shuffled. A notice
that shares its line or paragraph with more words than the bounds admit is not
found.

Defined results: null and empty texts, and units of one word, match nothing;
the best unit counts for each document and licence (ties: the earliest kind,
place); texts of any length are looked at whole; rows with equal doc_id are taken together, those without doc_id under
a null one; documents without a match give no row; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _util as U

THRESHOLD = 0.8

#: Names and wording of public licences and of their usual notices.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Licensed under the 3-Clause BSD License."),
    ("BSD-2-Clause", "Licensed under the 2-Clause BSD License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("WTFPL", "This program is free software. It comes without any warranty, to the extent permitted by applicable law."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)


def words_of(text: str) -> list[str]:
    return [x for x in re.split(r"[\s!-/:-@\[-`{-~]+", text.lower()) if x]


def bigrams(text: str) -> list[str]:
    w = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def admissible(templates=TEMPLATES, threshold: float = THRESHOLD):
    """(number of bigrams of a unit, licence, template words) for every number that can reach the threshold."""
    for name, text in templates:
        b = len(bigrams(text))
        for n in range(math.ceil(threshold * b / (2 - threshold) - 1e-9), math.floor((2 - threshold) * b / threshold + 1e-9) + 1):
            yield n, name, words_of(text)


def pair_hashes(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice (6 places), unit (line, paragraph or text) and its place, from 0."""
    listed = list(admissible(templates, threshold))
    by_size = docs.sparkSession.createDataFrame(listed, "n int, license string, words array<string>")
    by_size = F.broadcast(by_size.select("n", "license", F.array_distinct(pair_hashes(F.col("words"))).alias("template")))
    most = max(n for n, _, _ in listed)
    low = F.lower("text")
    place = lambda kind, parts: F.transform(parts, lambda u, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), u.alias("body")))
    paragraphs = F.split(low, r"\n[ \t\r]*\n")
    # whole texts and paragraphs of a single line are looked at as lines
    units = F.concat(
        place("line", F.split(low, r"\n")),
        F.when(F.size(paragraphs) > 1, F.filter(place("paragraph", paragraphs), lambda u: F.contains(u["body"], F.lit("\n")))).otherwise(F.expr("array()")),
        F.when(F.contains(low, F.lit("\n")), place("text", F.array(low))).otherwise(F.expr("array()")),
    )
    # each step behind a generator of one row, so that no expression is copied into another
    once = lambda c: F.explode_outer(F.array(c))
    words = F.filter(F.split("u.body", r"[\s\p{Punct}]+"), lambda w: w != "")
    step = docs.select("doc_id", F.explode_outer(units).alias("u")).select("doc_id", F.col("u.kind").alias("unit"), F.col("u.place").alias("place"), once(words).alias("words"))
    step = step.where(F.size("words") > min(n for n, _, _ in listed)).select("doc_id", "unit", "place", once(F.array_distinct(pair_hashes(F.col("words")))).alias("own"))
    found = step.select("*", F.size("own").alias("n")).where(F.col("n").between(1, most)).join(by_size, "n")
    dice = F.round(2.0 * F.size(F.array_intersect("own", "template")) / (F.col("n") + F.size("template")), 6)
    found = found.select("doc_id", "license", "unit", "place", once(dice).alias("dice"))
    best = F.min(F.struct((-F.col("dice")).alias("d"), "unit", "place"))
    return found.where(F.col("dice") >= threshold).groupBy("doc_id", "license").agg(best.alias("b")).select("doc_id", "license", (-F.col("b.d")).alias("dice"), F.col("b.unit").alias("unit"), F.col("b.place").cast("long").alias("place"))


def op6_dice_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(U.spread(U.table(spark, sf_dir, "documents").select("doc_id", "text")))


def _oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({q(name)}, [{', '.join(q(b) for b in bigrams(text))}])" for name, text in TEMPLATES)
    return f"""
WITH templates AS (SELECT * FROM (VALUES {rows}) AS t(license, template)),
d AS (SELECT doc_id, lower(text) AS low FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, 'line' AS unit, unnest(string_split(low, chr(10))) AS body, unnest(range(len(string_split(low, chr(10))))) AS place FROM d
  UNION ALL SELECT * FROM (SELECT doc_id, 'paragraph', unnest(string_split_regex(low, '\\n[ \\t\\r]*\\n')) AS body, unnest(range(len(string_split_regex(low, '\\n[ \\t\\r]*\\n')))) FROM d WHERE len(string_split_regex(low, '\\n[ \\t\\r]*\\n')) > 1) WHERE contains(body, chr(10))
  UNION ALL SELECT doc_id, 'text', low, 0 FROM d WHERE contains(low, chr(10))),
w AS (SELECT doc_id, unit, place, list_filter(string_split_regex(body, '[\\s!-/:-@\\[-`{{-~]+'), lambda x: x <> '') AS words FROM units),
own AS (SELECT doc_id, unit, place, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS own FROM w WHERE len(words) > 1),
scored AS (SELECT doc_id, license, unit, place, round(2.0::DOUBLE * len(list_intersect(own, template)) / (len(own) + len(template)), 6) AS dice FROM own, templates),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY dice DESC, unit, place) AS r FROM scored WHERE dice >= {THRESHOLD})
SELECT doc_id, license, dice, unit, CAST(place AS BIGINT) AS place FROM ranked WHERE r = 1"""


ORACLE_SQL = {"op6_dice_licenses": _oracle()}
